"""Problem 1: a sample whose categories follow target proportions.

Categories are counted, integer quotas are allotted by largest remainder within floors and availability, and of each
category the items with the smallest random keys are taken. The keys are hashes of the item's id, so a sample can be
repeated and does not depend on how rows are spread. No category is ever sorted as a whole: a histogram of the keys tells
below which bucket all items are taken, and only the one bucket at the border is ranked.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import collect_control, materialise
from .common import label_key

#: Rows that a border bucket should hold on average; the number of buckets follows from it and the size of the input.
BUCKET_ROWS = 20_000
#: Seed of the random keys.
SEED = 7


@dataclass(frozen=True)
class QuotaSample:
    """sample: item_id, category. report: one row per target category."""

    sample: DataFrame
    report: DataFrame


def allot(total: int, shares: list[float], floors: list[int], caps: list[int]) -> list[int]:
    """Integer quotas that sum to `total` where caps and floors allow it.

    Every category gets at least min(floor, cap) and at most its cap. What a capped category can't take goes to the
    others in proportion to their shares; fractions are settled by largest remainder, ties by position.
    """
    n = len(shares)
    lows = [min(max(f, 0), c) for f, c in zip(floors, caps)]
    quota: list[float] = [0.0] * n
    free = {i for i in range(n) if shares[i] > 0 and caps[i] > 0}
    for i in set(range(n)) - free:
        quota[i] = lows[i]
    while free:
        left = total - sum(quota[i] for i in range(n) if i not in free)
        weight = sum(shares[i] for i in free)
        want = {i: max(left, 0) * shares[i] / weight for i in free}
        over = [i for i in free if want[i] > caps[i]]
        under = [i for i in free if want[i] < lows[i]]
        excess = sum(want[i] - caps[i] for i in over) - sum(lows[i] - want[i] for i in under)
        if not over and not under:
            for i in free:
                quota[i] = want[i]
            break
        # settle the side that weighs more, as its change decides what is left for the others
        for i in over if over and (excess >= 0 or not under) else under:
            quota[i] = caps[i] if i in over else lows[i]
            free.discard(i)
    whole = [math.floor(q + 1e-9) for q in quota]
    goal = min(round(sum(quota)), max(total, sum(lows)), sum(caps))
    for i in sorted(free, key=lambda i: (-(quota[i] - whole[i]), i)):
        if sum(whole) >= goal:
            break
        if whole[i] < caps[i]:
            whole[i] += 1
    return whole


def quota_sample(items: DataFrame, id_col: str, label_col: str, targets: DataFrame, seed: int = SEED) -> QuotaSample:
    """Draw a sample of the distinct ids of `items` that follows `targets` (category, target_share, sample_fraction, min_rows).

    Usable are distinct, non-null ids whose label names a target category (same letters a-z). The sample has
    sample_fraction of them, each category its share, at least min_rows where it has them, at most what it has. The report
    tells targets that could not be met by a row or more, and why (short_by): 'availability' where a category has fewer items
    than its target (falls_short), 'floors of others' where the min_rows of other categories took the room.

    Defined cases. Null id or label, blank or unlisted label: not usable. Repeated ids: once; with labels of several
    listed categories, the first by key. Ties of random keys: by id. Empty items: an empty sample, all quotas 0, no
    case. Empty targets: nothing usable. Targets with the same key: one category, shares added, larger min_rows, first
    spelling. Null share, fraction or min_rows: 0. Other columns of `items`, whatever their names, are not read.
    """
    spark = items.sparkSession
    found: dict[str, list] = {}
    for r in sorted(
        collect_control(
            targets.select(
                F.col("category").cast("string"), label_key(F.col("category").cast("string")).alias("k"),
                F.coalesce("target_share", F.lit(0.0)).cast("double").alias("s"), F.coalesce("sample_fraction", F.lit(0.0)).cast("double").alias("f"),
                F.coalesce("min_rows", F.lit(0)).cast("int").alias("m")
            )
        ),
        key=lambda r: (r.k or "", r.category or "")
    ):
        if r.k:
            t = found.setdefault(r.k, [r.category, 0.0, r.f, 0])
            t[1], t[2], t[3] = t[1] + r.s, max(t[2], r.f), max(t[3], r.m)
    keys = sorted(found)
    listed = F.broadcast(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k string, cat int"))  # CONTROL_ROWS at most
    named = items.select(
        F.col(id_col).cast("string").alias("item_id"), label_key(F.col(label_col).cast("string")).alias("k")
    ).where("item_id is not null").join(listed, "k")
    usable = named.groupBy("item_id").agg(F.min("cat").alias("cat")).withColumn("key", F.xxhash64(F.lit(seed), "item_id"))
    usable = materialise(usable, "quota-usable")

    counted = {r.cat: r.n for r in usable.groupBy("cat").agg(F.count("*").alias("n")).collect()}  # CONTROL_ROWS at most
    caps = [counted.get(i, 0) for i in range(len(keys))]
    rows = sum(caps)
    fraction = max([found[k][2] for k in keys], default=0.0)
    shares, floors = [found[k][1] for k in keys], [found[k][3] for k in keys]
    quotas = allot(math.floor(fraction * rows + 0.5), shares, floors, caps) if keys else []

    buckets = max(1, min(1 << 20, rows // BUCKET_ROWS))
    plan = F.broadcast(spark.createDataFrame([(i, q) for i, q in enumerate(quotas)], "cat int, quota long"))
    bucketed = usable.withColumn("bucket", F.shiftright(F.shiftrightunsigned("key", 44) * buckets, 20))  # rises with the key, read as unsigned
    counts = bucketed.groupBy("cat", "bucket").agg(F.count("*").alias("n")).join(plan, "cat")
    before = F.sum("n").over(Window.partitionBy("cat").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    need = counts.withColumn("need", F.col("quota") - F.coalesce(before, F.lit(0))).where("need > 0").select(
        "cat", "bucket", "need", (F.col("need") >= F.col("n")).alias("whole")
    )
    hit = bucketed.join(need, ["cat", "bucket"])
    # turning the first bit over orders signed numbers as the buckets do, by their unsigned value
    border = hit.where("not whole").withColumn(
        "at", F.row_number().over(Window.partitionBy("cat", "bucket").orderBy(F.col("key").bitwiseXOR(F.lit(-(1 << 63))), "item_id"))
    ).where("at <= need")
    names = F.broadcast(spark.createDataFrame([(i, found[k][0]) for i, k in enumerate(keys)], "cat int, category string"))
    drawn = hit.where("whole").select("item_id", "cat").unionByName(border.select("item_id", "cat"))
    sample = materialise(drawn.join(names, "cat").select("item_id", "category"), "quota-sample")

    goals = [s * found[k][2] * rows for k, s in zip(keys, shares)]
    head = spark.createDataFrame(
        [(found[k][0], shares[i], floors[i], rows, caps[i], goals[i], quotas[i], caps[i] < goals[i]) for i, k in enumerate(keys)],
        "category string, target_share double, min_rows int, usable_rows long, available long, target_rows double, quota long, falls_short boolean"
    )
    report = head.join(sample.groupBy("category").agg(F.count("*").alias("n")), "category", "left").withColumn("sampled", F.coalesce("n", F.lit(0))).drop("n")
    total = F.sum("sampled").over(Window.partitionBy())
    cause = F.when(F.col("falls_short"), F.lit("availability")).when(F.col("sampled") + 1 <= F.col("target_rows"), F.lit("floors of others"))
    report = report.withColumn("short_by", cause)
    report = report.withColumn(
        "reached_share", F.when(total > 0, F.col("sampled") / total).otherwise(F.lit(0.0))
    ).withColumn("missing", F.greatest(F.lit(0.0), F.col("target_rows") - F.col("sampled")))
    return QuotaSample(sample, report)
