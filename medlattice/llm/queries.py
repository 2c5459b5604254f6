"""The queries of this subpackage, over whole tables with production parameters; their SQL is in oracle.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import collect_control, materialise, table
from .broken_pairs import broken_pairs
from .common import label_key
from .near_duplicates import NearDuplicates, link_counts, linked_pairs, near_duplicates
from .pii_crf import personal_data, redact_fields
from .packing import bin_report, pack_instructions, pack_texts
from .mixing import Mix, mix_sources
from .quota_sample import SEED, QuotaSample, quota_sample
from .reading_level import TOLERANCE, ReadingLevels, reading_levels
from .splitting import piece_rows, split_oversized

#: Of each sampled field: its table, id and label.
SAMPLED = {"specialty": ("records", "record_id", "specialty"), "question_type": ("questions", "question_id", "question_type")}
#: Of each field of size_limits in characters: its table, key and text.
SPLIT = {
    "records.content": ("records", "record_id", "content"), "articles.abstract": ("articles", "pubmed_id", "abstract"),
    "trials.detailed_description": ("trials", "nct_id", "detailed_description")
}
#: Limits of a container of instruction data besides its tokens.
MAX_SEGMENTS, MAX_LOSS_TOKENS = 64, 3072


def _sample(spark: SparkSession, d: str, field: str) -> QuotaSample:
    name, key, label = SAMPLED[field]
    return quota_sample(table(spark, d, name), key, label, table(spark, d, "sample_targets").where(F.col("field_name") == field))


def _both(spark: SparkSession, d: str, part: str) -> DataFrame:
    a, b = (getattr(_sample(spark, d, f), part).select(F.lit(f).alias("field_name"), "*") for f in SAMPLED)
    return a.unionByName(b)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, "report").where("falls_short").select("field_name", "category")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, "report")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return _both(spark, d, "sample")


def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    """Of each field: usable ids, ids drawn, and how often a rule of the sample is broken (floors, availability, smallest keys)."""
    out = None
    for f in SAMPLED:
        name, key, label = SAMPLED[f]
        got = _sample(spark, d, f)
        ids = table(spark, d, name).select(F.col(key).cast("string").alias("item_id"), label_key(F.col(label)).alias("k"))
        listed = table(spark, d, "sample_targets").where(F.col("field_name") == f).select("category", label_key(F.col("category")).alias("k"))
        usable = ids.join(F.broadcast(listed), "k").groupBy("item_id").agg(F.min("category").alias("category"))  # targets: a control table
        drawn = got.sample.select("item_id", F.lit(1).alias("drawn"))
        # as an unsigned number the key rises with the hash read with its first bit turned over
        rank = F.col("key").bitwiseXOR(F.lit(-(1 << 63)))
        keyed = usable.withColumn("key", F.xxhash64(F.lit(SEED), "item_id")).withColumn("key", rank).join(drawn, "item_id", "left")
        edge = keyed.where("drawn = 1").groupBy("category").agg(F.max("key").alias("edge"))
        passed = keyed.join(F.broadcast(edge), "category").where("drawn is null and key < edge")  # one row per category
        r = got.report
        broken = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
        floors = r.agg(
            F.max("usable_rows").alias("usable"), F.sum("sampled").alias("drawn"), broken(F.col("sampled") < F.least("min_rows", "available")).alias("below_floor"),
            broken(F.col("sampled") > F.col("available")).alias("above_available"), broken(F.col("sampled") != F.col("quota")).alias("off_quota"))
        counts = passed.agg(F.count("*").alias("passed_over"))
        one = floors.withColumn("_one", F.lit(1)).join(counts.withColumn("_one", F.lit(1)), "_one").drop("_one").select(F.lit(f).alias("field_name"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def _splits(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    limits = {r.field_name: r for r in collect_control(table(spark, d, "size_limits").where("unit = 'characters'"))}
    return {
        f: split_oversized(table(spark, d, name), key, text, limits[f].max_size, limits[f].overlap_size) for f,
        (name, key, text) in SPLIT.items() if f in limits
    }


def _union(parts: dict[str, DataFrame]) -> DataFrame:
    out = None
    for f, df in parts.items():
        named = df.select(F.lit(f).alias("field_name"), "*")
        out = named if out is None else out.unionByName(named)
    return out


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    forced = F.exists("pieces", lambda p: p["cut"] == "character")
    return _union(_splits(spark, d)).select("field_name", "item_key", F.when(forced, "forced").otherwise("natural").alias("cut"))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _union({f: piece_rows(s) for f, s in _splits(spark, d).items()})


def p2_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized item: the hash of what its pieces give when they are put together again, and whether each fits."""
    limits = {r.field_name: r for r in collect_control(table(spark, d, "size_limits").where("unit = 'characters'"))}
    step = lambda acc, x: F.concat(acc, F.substr(x["text"], F.length(acc) - x["begin"] + 1))
    parts = {}
    for f, split in _splits(spark, d).items():
        fits = F.forall("pieces", lambda x: (F.length(x["text"]) <= limits[f].max_size) & (F.length(x["text"]) == x["end"] - x["begin"]))
        shares = F.forall(F.sequence(F.lit(1), F.size("pieces") - 1), lambda i: F.get("pieces", i)["begin"] <= F.get("pieces", i - 1)["end"])
        parts[f] = split.select("item_key", F.md5(F.aggregate("pieces", F.lit(""), step)).alias("text_hash"), (fits & shares).alias("fits"))
    return _union(parts)


def _redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_fields(table(spark, d, "records"), "record_id", ["content", "description"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return personal_data(_redacted(spark, d)).where("item_key is not null").withColumnRenamed("item_key", "record_id")


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return _redacted(spark, d).select(F.col("item_key").alias("record_id"), "field_name", "redacted", F.size("found").alias("replaced"))


def p3_restored(spark: SparkSession, d: str) -> DataFrame:
    """Of each text: the hash of the redacted text with every placeholder turned back, which must be that of the text."""

    def back(acc, x):
        mark = F.concat(F.lit("["), F.upper(x["pii_type"]), F.lit("]"))
        at = F.position(mark, acc["rest"])
        told = F.concat(acc["told"], F.substr(acc["rest"], F.lit(1), at - 1), x["pii_text"])
        return F.struct(told.alias("told"), F.substr(acc["rest"], at + F.length(mark)).alias("rest"))

    start = F.struct(F.lit("").alias("told"), F.col("redacted").alias("rest"))
    restored = F.aggregate("found", start, back, lambda acc: F.concat(acc["told"], acc["rest"]))
    return _redacted(spark, d).where("redacted is not null").select(F.col("item_key").alias("record_id"), "field_name", F.md5(restored).alias("text_hash"))


def _near(spark: SparkSession, d: str) -> NearDuplicates:
    return near_duplicates(table(spark, d, "records"), "record_id", "content", words=3, threshold=0.5)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(_near(spark, d)).select(F.col("id_a").alias("record_id_a"), F.col("id_b").alias("record_id_b"))


def p4_record_links(spark: SparkSession, d: str) -> DataFrame:
    return link_counts(_near(spark, d)).withColumnRenamed("item_id", "record_id")


def p4_article_links(spark: SparkSession, d: str) -> DataFrame:
    return link_counts(near_duplicates(table(spark, d, "articles"), "pubmed_id", "abstract")).withColumnRenamed("item_id", "pubmed_id")


def p4_article_pairs(spark: SparkSession, d: str) -> DataFrame:
    return linked_pairs(near_duplicates(table(spark, d, "articles"), "pubmed_id", "abstract"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(table(spark, d, "responses"), "response_id", "query_text", "answer").withColumnRenamed("item_id", "response_id")


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    return p5_found(spark, d).groupBy("defect").agg(F.count("*").alias("pairs"))


def _container(spark: SparkSession, d: str) -> int:
    return collect_control(table(spark, d, "size_limits").where("field_name = 'documents.text'"))[0].max_size


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return pack_texts(table(spark, d, "documents"), "doc_id", "text", _container(spark, d))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).where("segments > 1 and segment_no = 0").select(F.col("doc_id").cast("bigint").alias("doc_id"))


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return bin_report(_packed(spark, d), _container(spark, d))


def p6_instruction_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_instructions(table(spark, d, "responses"), "response_id", "query_text", "answer", _container(spark, d), MAX_SEGMENTS, MAX_LOSS_TOKENS)


def _rules(packed: DataFrame, tokens: int, segments: int, loss: int) -> DataFrame:
    """Rows packed, rows without tokens, tokens lost or doubled, containers over a limit, and whether they are few."""
    length = F.col("token_end") - F.col("token_begin")
    items = packed.agg(
        F.sum(F.when(F.col("segment_no") == 0, 1).otherwise(0)).alias("items"), F.count_if(F.col("bin").isNull()).alias("empty_items"),
        F.count_if((F.col("segment_no") == 0) & (F.col("token_begin") != 0)).alias("late_begins"), F.count_if(length > tokens).alias("long_segments"))
    bins = packed.where("bin is not null").groupBy("bin").agg(F.sum(length).alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l"))
    needed = F.greatest(F.sum("t") / tokens, F.sum("s") / segments, F.sum("l") / loss)
    full = bins.agg(
        F.count_if((F.col("t") > tokens) | (F.col("s") > segments) | (F.col("l") > loss)).alias("overfull"),
        F.coalesce(F.count("*") <= 1.05 * needed + 2, F.lit(True)).alias("few_containers"))
    whole = packed.where("bin is not null").groupBy("doc_id").agg(
        F.sum(length).alias("t"), F.sum(F.when(F.col("segment_no") == F.col("segments") - 1, F.col("token_end"))).alias("e")
    )
    gaps = whole.agg(F.count_if(F.col("t") != F.col("e")).alias("torn_items"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(items).join(one(full), "_one").join(one(gaps), "_one").drop("_one")


def p6_rules(spark: SparkSession, d: str) -> DataFrame:
    size = _container(spark, d)
    return _rules(materialise(_packed(spark, d), "rules"), size, size, size)


def p6_instruction_rules(spark: SparkSession, d: str) -> DataFrame:
    return _rules(materialise(p6_instruction_containers(spark, d), "rules"), _container(spark, d), MAX_SEGMENTS, MAX_LOSS_TOKENS)


def _mix(spark: SparkSession, d: str) -> Mix:
    return mix_sources(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report.where("falls_short").select("source_name")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).report


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).picks


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """Of each source: whether it falls short, whether a document is used too often, and whether its size meets its target (or all it may give)."""
    mix = _mix(spark, d)
    largest = mix.picks.groupBy("source_name").agg(F.max("size").alias("largest"))
    may = F.least("target_size", F.col("source_size") * F.col("max_repeats"))
    return mix.report.join(largest, "source_name", "left").select(
        "source_name", "falls_short", (F.col("most_copies") > F.col("max_repeats")).alias("too_often"),
        (F.abs(F.col("reached_size") - may) <= F.coalesce("largest", F.lit(0)) + 0.01 * may).alias("on_target"))


def _graded(spark: SparkSession, d: str) -> ReadingLevels:
    return reading_levels(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "graded_texts"))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _graded(spark, d).levels


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).select("doc_id", "band")


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    return p8_levels(spark, d).groupBy("band").agg(
        F.count("*").alias("documents"), F.sum("n_words").alias("words"), F.round(F.avg("level"), 4).alias("mean_level")
    )


def p8_convergence(spark: SparkSession, d: str) -> DataFrame:
    found = _graded(spark, d)
    return spark.createDataFrame([(found.rounds, round(found.change, 6), found.change <= TOLERANCE)], "rounds int, last_change double, settled boolean")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    p1_found, p1_report, p1_sample, p1_rules, p2_found, p2_pieces, p2_rebuilt, p3_found, p3_redacted, p3_restored, p4_found, p4_record_links, p4_article_links, p4_article_pairs, p5_found, p5_defects,
    p6_found, p6_containers, p6_fill, p6_instruction_containers, p6_rules, p6_instruction_rules, p7_found, p7_shares, p7_mix, p7_rules,
    p8_found, p8_levels, p8_profile, p8_convergence,
)}
