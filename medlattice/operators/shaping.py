"""Record and question normalisers, splits, balanced and combined benchmarks, synthetic cases and narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..session import collect_control

# Lead-ins of instruction rows and the ranges of generated measurements.
INSTRUCTIONS = {
    "pubmedqa": "Answer the following biomedical question based on research findings:",
    "medqa": "Answer the following medical question with a concise and accurate response:"
}
MEASURES = (
    ("Heart Rate", 40, 180), ("Respiratory Rate", 8, 40), ("Systolic BP", 80, 200), ("Diastolic BP", 40, 120), ("Temperature", 35, 41),
    ("Glucose", 40, 400), ("Weight", 40, 140), ("Height", 150, 200)
)
AGE_RANGE = (18, 90)


def record_text(row_no: Column, specialty: Column, sample: Column, description: Column, content: Column, keywords: Column) -> Column:
    """The text of a record under its header lines; null for null or blank content."""
    known = lambda c: F.coalesce(c, F.lit("Unknown"))
    body = F.regexp_replace(content, r"\n\s*\n", "\n\n")
    text = F.concat(
        F.lit("ID: "), F.format_string("record_%05d", row_no), F.lit("\nSPECIALTY: "), known(specialty), F.lit("\nSAMPLE TYPE: "), known(sample),
        F.lit("\nDESCRIPTION: "), known(description), F.lit("\n\nCONTENT:\n"), body, F.lit("\n\nKEYWORDS: "), F.coalesce(keywords, F.lit("")),
        F.lit("\n")
    )
    return F.when(content.rlike(r"\S"), text)


def exact_answer(kind: Column, exact: Column) -> Column:
    """Exact answer of a question (array of arrays of strings) by its type."""
    flat = F.flatten(exact)
    return F.when(kind == "yesno", F.when(F.size(flat) > 0, "Yes").otherwise("No")).when(
        kind.isin("factoid", "list"), F.coalesce(F.array_join(flat, ", "), F.lit(""))
    )


def normalise_questions(raw: DataFrame) -> DataFrame:
    """Rows (id, type, body, ideal_answer array, exact_answer array of arrays, documents, snippets, concepts) in question form."""
    return raw.select(
        "id", "type", F.col("body").alias("question"), F.coalesce(F.get("ideal_answer", F.lit(0)), F.lit("")).alias("ideal_answer"),
        exact_answer(F.col("type"), F.col("exact_answer")).alias("exact_answer"), "documents", "snippets", "concepts"
    )


def seeded_order(seed: int, key: Column) -> Column:
    """The same order in any engine: hash of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


#: Rows that a bucket of equal leading hash digits should hold at most on average, when ranks are counted out.
BUCKET_ROWS = 20_000


def split_ranks(df: DataFrame, order: str, ties: str | None = None, group: str | None = None) -> DataFrame:
    """Adds _rank (from 1) and _total by a hexadecimal column, in all or per group, without ordering all rows in one task.

    Rows are counted per leading digits, of which there are as many as the size asks for; only buckets are ordered.
    """
    rows = df.count()
    digits = 3
    while digits < 8 and rows > BUCKET_ROWS * 16**digits:
        digits += 1
    keys = ["_b"] if group is None else [group, "_b"]
    same = Window.partitionBy(*keys[:-1])
    keyed = df.withColumn("_b", F.substring(order, 1, digits))
    before = F.coalesce(F.sum("_n").over(same.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before")
    counts = keyed.groupBy(*keys).agg(F.count("*").alias("_n")).select(*keys, before, F.sum("_n").over(same).alias("_total"))
    within = F.row_number().over(Window.partitionBy(*keys).orderBy(order, *([ties] if ties else [])))
    if group is None:
        met = keyed.join(counts, "_b")
    else:  # a missing group is a group of its own
        told = counts.withColumnRenamed(group, "_g").withColumnRenamed("_b", "_c")
        met = keyed.join(told, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_c"))).drop("_g", "_c")
    return met.withColumn("_rank", F.col("_before") + within).drop("_b", "_before")


def split_by_share(df: DataFrame, key: str, share: float, seed: int = 42) -> DataFrame:
    """D3: split_name 'train' for the first int(n x share) rows in seeded order, 'test' for the rest."""
    ranked = split_ranks(df.withColumn("_h", seeded_order(seed, F.col(key))), "_h", key)
    name = F.when(F.col("_rank") <= F.floor(F.col("_total") * share), "train").otherwise("test")
    return ranked.withColumn("split_name", name).drop("_h", "_total", "_rank")


def split_stats(split: DataFrame, kind: str) -> DataFrame:
    """Rows in all, of train and test, and of train by type."""
    return split.groupBy(F.col(kind).alias("type")).agg(
        F.count("*").alias("total"), F.count_if(F.col("split_name") == "train").alias("train_count"),
        F.count_if(F.col("split_name") == "test").alias("test_count")
    )


def flatten_squad(nested: DataFrame) -> DataFrame:
    """data[].paragraphs[].qas[] to id, question, context, answer (the first, or '')."""
    p = nested.select(F.explode("data").alias("d")).select(F.explode("d.paragraphs").alias("p"))
    q = p.select(F.col("p.context").alias("context"), F.explode("p.qas").alias("q"))
    return q.select(
        F.col("q.id").alias("id"), F.col("q.question").alias("question"), "context",
        F.coalesce(F.get("q.answers", F.lit(0))["text"], F.lit("")).alias("answer"), F.lit("BioASQ").alias("source")
    )


def pubmedqa_pairs(items: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Rows (pmid, QUESTION, CONTEXTS, LONG_ANSWER, final_decision, PUBDATE, JOURNAL); truth: pmid, answer."""
    context = F.array_join(F.coalesce("CONTEXTS", F.array().cast("array<string>")), " ")
    known = {"yes": "Yes. ", "no": "No. ", "maybe": "Maybe. "}
    lead = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in known.items() for x in kv)), F.col("final_decision")), F.lit(""))
    rows = items if truth is None else items.join(truth.withColumnRenamed("answer", "_truth"), "pmid", "left")
    given = F.lit(None).cast("string") if truth is None else F.col("_truth")
    answer = F.coalesce(given, F.when(F.col("LONG_ANSWER") != "", F.col("LONG_ANSWER")), F.concat(lead, context))
    meta = F.struct(
        F.lit("PubMedQA").alias("source"), F.col("pmid"),
        *(F.coalesce(c, F.lit("")).alias(a) for c, a in (("final_decision", "label"), ("PUBDATE", "pubdate"), ("JOURNAL", "journal")))
    )
    return rows.select(
        F.concat(F.lit("pubmedqa_"), "pmid").alias("id"), F.coalesce("QUESTION", F.lit("")).alias("question"), answer.alias("answer"),
        meta.alias("metadata")
    )


def medqa_pairs(items: DataFrame, position: str) -> DataFrame:
    """Rows (position, question, answer, options map, answer_idx, meta_info); options become values in key order."""
    options = F.transform(F.array_sort(F.map_entries("options")), lambda e: e["value"])
    meta = F.struct(
        F.lit("MedQA").alias("source"), F.coalesce(options, F.array().cast("array<string>")).alias("options"),
        F.coalesce("answer_idx", F.lit("")).alias("answer_idx"), F.coalesce("meta_info", F.lit("")).alias("meta_info")
    )
    return items.select(
        F.concat(F.lit("medqa_"), F.col(position).cast("string")).alias("id"), F.coalesce("question", F.lit("")).alias("question"),
        F.coalesce("answer", F.lit("")).alias("answer"), meta.alias("metadata")
    )


def instruction_rows(pairs: DataFrame, dataset: str) -> DataFrame:
    """Id, instruction, input, output."""
    return pairs.select("id", F.lit(INSTRUCTIONS[dataset]).alias("instruction"), F.col("question").alias("input"), F.col("answer").alias("output"))


def combine_balanced(df: DataFrame, dataset: str, key: str, cap: int | None = None, balance: bool = True, seed: int = 42) -> DataFrame:
    """Rows of every dataset cut to `cap` and to the size of the smallest, with split_name train, dev or test (70, 15, 15 %) if more than ten are left."""
    out = df
    if cap is not None or balance:
        most = [] if cap is None else [cap]
        if balance:
            most.append(min((r.n for r in collect_control(df.groupBy(dataset).agg(F.count("*").alias("n")))), default=0))  # one row per dataset
        ranked = split_ranks(df.withColumn("_h", seeded_order(seed, F.col(key))), "_h", key, dataset)
        out = ranked.where(F.col("_rank") <= min(most)).drop("_h", "_rank", "_total")
    named = F.concat_ws("|", F.col(dataset).cast("string"), F.col(key).cast("string"))
    out = split_ranks(out.withColumn("_h", seeded_order(seed + 1, named)), "_h", key)
    n, r = F.col("_total"), F.col("_rank")
    a, b = F.floor(n * 0.7), F.floor(n * 0.7) + F.floor(n * 0.15)
    return out.withColumn("split_name", F.when(n > 10, F.when(r <= a, "train").when(r <= b, "dev").otherwise("test"))).drop("_h", "_total", "_rank")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The n rows with the smallest seeded hash of their key."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def comprehensive(bioasq: DataFrame, pubmedqa: DataFrame, medqa: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """All BioASQ questions, n PubMedQA pairs as yes/no and n MedQA pairs as factoid questions; id, type, question, answer, source."""
    shape = lambda df, kind, source: df.select("id", kind.alias("type"), "question", "answer", F.lit(source).alias("source"))
    return shape(bioasq, F.col("type"), "bioasq").unionByName(
        shape(sample_rows(pubmedqa, "id", n, seed), F.lit("yesno"), "pubmedqa")
    ).unionByName(shape(sample_rows(medqa, "id", n, seed), F.lit("factoid"), "medqa"))


def benchmark_stats(benchmark: DataFrame) -> DataFrame:
    """Questions per dataset."""
    return benchmark.groupBy("source").agg(F.count("*").alias("questions"))


def with_defaults(df: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Missing values of the named columns filled in; missing columns added."""
    return df.select(
        *(c for c in df.columns if c not in defaults),
        *((F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v)).alias(c) for c, v in defaults.items())
    )


def source_list(hits: DataFrame) -> DataFrame:
    """source_type, title (the document's first line), id and score of hits."""
    return hits.select(
        "query_id", F.col("source").alias("source_type"), F.element_at(F.split("document", "\n"), 1).alias("title"), F.col("doc_id").alias("id"),
        "score"
    )


def synthetic_cases(spark: SparkSession, n: int, seed: int = 1) -> DataFrame:
    """N generated intensive-care cases; every value is a hash of seed, case and variable, the same in any engine."""
    digest = lambda name: F.md5(F.concat(F.lit(f"{seed}|"), F.col("id").cast("string"), F.lit(f"|{name}")))
    unit = lambda name: F.conv(F.substring(digest(name), 1, 8), 16, 10).cast("double") / float(1 << 32)
    item = lambda name, value: F.struct(F.lit(name).alias("variable"), value.cast("string").alias("value"))
    ranged = lambda name, lo, hi: F.round(lo + unit(name) * (hi - lo), 1)
    demographics = F.array(
        item("Age", F.floor(AGE_RANGE[0] + unit("Age") * (AGE_RANGE[1] - AGE_RANGE[0] + 1))),
        item("Gender", F.when(unit("Gender") < 0.5, "M").otherwise("F"))
    )
    vitals, labs = (F.array(*(item(m, ranged(m, lo, hi)) for m, lo, hi in MEASURES[a:b])) for a, b in ((0, 5), (5, 8)))
    return spark.range(n).select(
        F.format_string("patient_%05d", "id").alias("patient_id"), F.when(unit("outcome") < 0.8, "survived").otherwise("deceased").alias("outcome"),
        F.floor(1 + unit("stay") * 30).cast("int").alias("length_of_stay"), demographics.alias("demographics"), vitals.alias("vitals"),
        labs.alias("labs"), F.concat(demographics, vitals, labs).alias("all_measurements")
    )


def narrative(case: str = "") -> Column:
    """Text of a case row (demographics, vitals, labs, outcome, length_of_stay); empty and zero values are left out."""
    col = lambda n: F.coalesce(F.col(case + n), F.array().cast("array<struct<variable string, value string>>"))
    some = lambda v: v.isNotNull() & ~v.isin("", "0", "0.0")
    pick = lambda n: F.get(
        F.transform(F.filter(col("demographics"), lambda x: (x["variable"] == n)), lambda x: x["value"]),
        F.size(F.filter(col("demographics"), lambda x: x["variable"] == n)) - 1
    )
    listed = lambda n: F.array_join(
        F.transform(F.filter(col(n), lambda x: some(x["variable"]) & some(x["value"])), lambda x: F.concat(x["variable"], F.lit(" is "), x["value"])),
        ", "
    )
    age, gender = pick("Age"), pick("Gender")
    sex = F.when(gender == "M", "male").otherwise("female")
    has_age, has_gender = F.coalesce(some(age), F.lit(False)), F.coalesce(some(gender), F.lit(False))
    who = F.when(
        has_age & has_gender, F.concat(F.lit("The patient is a "), age, F.lit("-year-old "), sex, F.lit(". "))
    ).when(
        has_age, F.concat(F.lit("The patient is "), age, F.lit(" years old. "))
    ).when(has_gender, F.concat(F.lit("The patient is "), sex, F.lit(". "))).otherwise("")
    part = lambda lead, n: F.when(listed(n) != "", F.concat(F.lit(lead), listed(n), F.lit(". "))).otherwise("")
    end = F.concat(
        F.lit("Patient outcome: "), F.coalesce(F.col(case + "outcome"), F.lit("unknown")), F.lit(". Length of stay: "),
        F.coalesce(F.col(case + "length_of_stay").cast("string"), F.lit("unknown")), F.lit(" days.")
    )
    return F.concat(F.lit("Patient admitted to ICU. "), who, part("Vital signs: ", "vitals"), part("Laboratory findings: ", "labs"), end)


def parse_records(texts: DataFrame, text: str) -> DataFrame:
    """M2: fields of record texts under header lines."""
    one = lambda name: trimmed(F.regexp_extract(F.col(text), rf"(?m)^{name}: ?(.*)$", 1))
    words = F.filter(F.transform(F.split(one("KEYWORDS"), ","), trimmed), lambda x: x != "")
    return texts.select(
        one("ID").alias("record_id"), one("SPECIALTY").alias("specialty"), one("SAMPLE TYPE").alias("sample_type"),
        one("DESCRIPTION").alias("description"), trimmed(F.regexp_extract(F.col(text), r"(?s)CONTENT:\n(.*?)\n\nKEYWORDS:", 1)).alias("content"),
        words.alias("keywords")
    )
