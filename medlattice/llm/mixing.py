"""Problem 7: mixing sources to target weights by pivotal dependent rounding.

Every document of a source is to be taken c times on average, c being what the source must give divided by what it has.
The whole part of c is certain; the fractions are rounded by pivotal rounding: two fractional documents meet, one takes
the mass of both until it is 0 or 1, and the other goes on. Documents are dealt into cells by a hash of what they are, so
that the picks don't depend on how rows are spread. Within a cell they meet in order of size, so that mass moves between
documents of like size and the total size stays close to its target. Each cell leaves at most one fractional document per
source; these residuals meet in a reduction tree of fixed fan-in.
"""

from __future__ import annotations

from dataclasses import dataclass

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import collect_control, materialise
from .common import TOKENIZER_DIR, label_key, with_token_counts

#: Residuals that meet in one task of the reduction tree.
FAN_IN = 512
#: Documents that a cell holds on average; bounds the memory of a task.
CELL = 50_000
_NEAR = 1e-9


@dataclass(frozen=True)
class Mix:
    """picks: doc_id, source_name, size, copies (1 or more). report: one row per target source."""

    picks: DataFrame
    report: DataFrame


def _draw(seed: int, a: str, b: str) -> float:
    """A number in [0, 1) that only depends on the two that meet."""
    return xxhash.xxh64_intdigest(f"{a}\x1f{b}", seed) / 2**64


def pivotal(ids: list, ps: list[float], seed: int) -> tuple[dict, tuple | None]:
    """Round fractions to 0 or 1 by successive meetings; returns decided ids and the one (id, p) left over, if any.

    Each id keeps its expectation p, and the number of ones differs from sum(ps) by less than one.
    """
    done: dict = {}
    held = None
    for i, p in zip(ids, ps):
        if p <= _NEAR or p >= 1 - _NEAR:
            done[i] = int(p > 0.5)
            continue
        if held is None:
            held = (i, p)
            continue
        j, q = held
        total = p + q
        if total < 1 - _NEAR:  # one drops out, the other takes its mass
            keep, drop = (i, j) if _draw(seed, str(j), str(i)) * total < p else (j, i)
            done[drop] = 0
            held = (keep, total)
        elif total > 1 + _NEAR:  # one is taken, the other keeps the rest
            take, rest = (i, j) if _draw(seed, str(j), str(i)) * (2 - total) < 1 - q else (j, i)
            done[take] = 1
            held = (rest, total - 1)
        else:
            take, drop = (i, j) if _draw(seed, str(j), str(i)) * total < p else (j, i)
            done[take], done[drop] = 1, 0
            held = None
    return done, held


def _settle(pdf, seed: int, last: bool):
    """pdf (src, doc_id, size, whole, p) with `extra` decided; null for the one left over, which keeps the mass in p."""
    import pandas as pd

    out = []
    for src, g in pdf.groupby("src", sort=True):
        g = g.sort_values(["size", "doc_id"])
        done, held = pivotal(g["doc_id"].tolist(), g["p"].tolist(), seed)
        if held is not None and last:
            done[held[0]] = int(_draw(seed, str(held[0]), "") < held[1])
            held = None
        g = g.assign(extra=g["doc_id"].map(done).astype("float64"))
        if held is not None:
            g.loc[g["doc_id"] == held[0], "p"] = held[1]
        out.append(g)
    return pd.concat(out) if out else pdf.assign(extra=pd.Series(dtype="float64"))


def mix_sources(docs: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, seed: int = 11, tokenizer_dir: str = TOKENIZER_DIR) -> Mix:
    """Pick documents with repetition so that each source gives target_weight of a mix of mix_fraction x the total size.

    targets: source_name, target_weight, max_repeats, mix_fraction. Sizes are tokens of whole texts. A source whose
    size x max_repeats is below its share gives all it may and is reported as short; its share is not passed on.

    Defined cases. Documents without a listed source count for the total size but are never picked. Null or empty text:
    size 0, picked like others (it adds nothing). Null id: counts for sizes, never picked. A repeated id is a document of
    its own each time. Empty documents: empty picks, all sizes 0, no source short. Targets with the same key (letters
    a-z): weights added, larger max_repeats. Null weight or repeats: 0. Other columns are not read.
    """
    spark = docs.sparkSession
    found: dict[str, list] = {}
    fraction = 0.0
    for r in sorted(
        collect_control(
            targets.select(
                F.col("source_name").cast("string").alias("name"), label_key(F.col("source_name").cast("string")).alias("k"),
                F.coalesce("target_weight", F.lit(0.0)).cast("double").alias("w"), F.coalesce("max_repeats", F.lit(0)).cast("int").alias("m"),
                F.coalesce("mix_fraction", F.lit(0.0)).cast("double").alias("f")
            )
        ),
        key=lambda r: (r.k or "", r.name or "")
    ):
        if r.k:
            t = found.setdefault(r.k, [r.name, 0.0, 0])
            t[1], t[2], fraction = t[1] + r.w, max(t[2], r.m), max(fraction, r.f)
    keys = sorted(found)
    listed = F.broadcast(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, src int"))  # CONTROL_ROWS at most
    renamed = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(source_col).cast("string").alias("label"), F.col(text_col).alias("text"))
    sized = with_token_counts(renamed, {"size": "text"}, ["doc_id", "label"], tokenizer_dir)
    sized = materialise(
        sized.withColumn("k", label_key(F.col("label"))).join(listed, "k", "left").select(
            "doc_id", F.coalesce("src", F.lit(-1)).alias("src"), "size"
        ),
        "mix-sized"
    )

    counted = sized.groupBy("src").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()  # CONTROL_ROWS + 1 at most
    sizes = {r.src: r.s for r in counted}
    total = sum(sizes.values())
    aim = [found[k][1] * fraction * total for k in keys]
    have = [sizes.get(i, 0) for i in range(len(keys))]
    rates = [min(float(found[k][2]), aim[i] / have[i]) if have[i] else 0.0 for i, k in enumerate(keys)]
    rate = F.broadcast(spark.createDataFrame([(i, int(r + _NEAR), max(0.0, r - int(r + _NEAR))) for i, r in enumerate(rates)], "src int, whole int, p double"))
    ready = sized.where("src >= 0 and doc_id is not null").join(rate, "src").select("src", "doc_id", "size", "whole", "p")
    shape = "src int, doc_id string, size long, whole int, p double, extra double"

    # equal rows are told apart by a running number, so a repeated id keeps its draws wherever its rows lie
    alike = ready.groupBy("src", "doc_id", "size", "whole", "p").agg(F.count("*").cast("int").alias("n"))
    each = alike.select("src", "doc_id", "size", "whole", "p", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    tagged = each.withColumn("doc_id", F.concat_ws("#", "doc_id", F.col("size").cast("string"), F.col("k").cast("string"))).drop("k")
    cells = max(1, -(-sum(r.n for r in counted) // CELL))
    dealt = tagged.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(cells)))
    meet = lambda pdf: _settle(pdf.drop(columns="cell"), seed, False)
    level = materialise(dealt.groupBy("cell").applyInPandas(meet, shape), "mix-level0")
    settle = lambda last: lambda pdf: _settle(pdf.drop(columns="node"), seed, last)
    parts, round_no = [], 0
    while True:
        parts.append(level.where("extra is not null"))
        left = level.where("extra is null").drop("extra")
        per_source = left.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
        if not per_source:
            break
        last, round_no = per_source <= FAN_IN, round_no + 1
        ranked = left.withColumn("node", F.lit(0) if last else F.pmod(F.xxhash64(F.lit(round_no), "doc_id"), F.lit(-(-per_source // FAN_IN) * 2)))
        level = materialise(ranked.groupBy("src", "node").applyInPandas(settle(last), shape), f"mix-level{round_no}")
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    names = F.broadcast(spark.createDataFrame([(i, found[k][0]) for i, k in enumerate(keys)], "src int, source_name string"))
    picks = chosen.withColumn("copies", F.col("whole") + F.col("extra").cast("int")).where("copies > 0").join(names, "src").select(
        F.regexp_replace("doc_id", "#[0-9]+#[0-9]+$", "").alias("doc_id"), "source_name", "size", "copies"
    )

    head = spark.createDataFrame(
        [(found[k][0], found[k][1], found[k][2], have[i], total, aim[i], have[i] * found[k][2] < aim[i]) for i, k in enumerate(keys)],
        "source_name string, target_weight double, max_repeats int, source_size long, total_size long, target_size double, falls_short boolean"
    )
    reached = picks.groupBy("source_name").agg(F.sum(F.col("size") * F.col("copies")).alias("r"), F.sum("copies").alias("c"), F.max("copies").alias("m"))
    report = head.join(reached, "source_name", "left").select(
        *head.columns, F.coalesce("r", F.lit(0)).alias("reached_size"), F.coalesce("c", F.lit(0)).alias("documents"),
        F.coalesce("m", F.lit(0)).alias("most_copies")
    )
    whole = F.sum("reached_size").over(Window.partitionBy())
    return Mix(picks, report.withColumn("reached_share", F.when(whole > 0, F.col("reached_size") / whole).otherwise(F.lit(0.0))))
