"""Problem 6: filling containers of fixed capacity, by vector bin packing with the dot-product heuristic.

A container limits three sums at once: tokens, number of segments and loss-bearing tokens. An open container takes, again
and again, the item that fits and has the largest dot product of its direction (weighted sizes at unit length) with what
is left of the container; of items that point alike, the largest. Items are packed in blocks within partitions, without a shuffle; what lies in containers that stayed too
empty is packed once more in a second round over all blocks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import TOKENIZER_DIR, with_token_counts

#: Items packed together; bounds the memory and time of a task and has hardly any influence on the space lost.
BLOCK = 8_000
#: A container less full than this (by its fullest limit) is emptied and its items are packed again in the second round.
FULL = 0.985
PLACED = "item long, doc_id string, segment_no int, segments int, token_begin long, token_end long, loss_tokens long, bin string"


def pack(sizes: np.ndarray, capacity: np.ndarray) -> list[list[int]]:
    """Containers as lists of row numbers of `sizes` (n x 3, each within `capacity`), by the dot-product heuristic."""
    n = len(sizes)
    if not n:
        return []
    rel = sizes / capacity.astype("float64")
    need = rel.sum(axis=0)
    weight = (need / need.max()) ** 4  # a limit that is in short supply counts, one that hardly binds doesn't
    size = (rel * weight).sum(axis=1)
    order = np.argsort(-size, kind="stable")
    rel, size = rel[order], size[order]
    aim = rel * weight
    aim /= np.linalg.norm(aim, axis=1, keepdims=True)
    by_size = 1e-3 * size / size[0]
    live = np.arange(n)
    bins = []
    while len(live):
        left = np.ones(rel.shape[1])
        own: list[int] = []
        r, u, tie = rel[live], aim[live], by_size[live]
        fits = np.ones(len(live), dtype=bool)
        while True:
            fits &= (r <= left + 1e-12).all(axis=1)
            if not fits.any():
                break
            want = left * weight
            score = np.round(u @ (want / max(np.linalg.norm(want), 1e-12)), 2) + tie
            k = int(np.where(fits, score, -1.0).argmax())
            own.append(k)
            fits[k] = False
            left = left - r[k]
        bins.append([int(order[live[k]]) for k in own])
        keep = np.ones(len(live), dtype=bool)
        keep[own] = False
        live = live[keep]
    return bins


def _pack_frames(frames, limits: tuple[int, int, int], block: int, final: bool, seed: str):
    """Pack the items of a partition block by block; items in containers that stay too empty move on to the next block."""
    import pandas as pd

    cap = np.array(limits, dtype="float64")
    held: list = []
    count = 0

    def settle(last: bool):
        nonlocal held, count
        pdf = pd.concat(held, ignore_index=True)
        sizes = np.stack([(pdf["token_end"] - pdf["token_begin"]).to_numpy("float64"), np.ones(len(pdf)), pdf["loss_tokens"].to_numpy("float64")], axis=1)
        names = np.empty(len(pdf), dtype=object)
        bins = pack(sizes, cap)
        full = [own for own in bins if (sizes[own].sum(axis=0) / cap).max() >= FULL]
        # few items are carried over to the next block; in the final round there is no later chance for the others
        carried = not last and len(pdf) - sum(map(len, full)) < block // 2
        for own in bins if final and not carried else full:
            names[own] = f"{seed}-{pdf['item'][own[0]]}-{pdf['segment_no'][own[0]]}"  # ids may repeat or be null, items don't
        pdf["bin"] = names
        held = []
        count = 0
        if carried:  # else hardly anything fills a container here; the first round leaves it to the second
            rest = pdf[pdf["bin"].isna()]
            held, count = [rest.drop(columns="bin")], len(rest)
            pdf = pdf[pdf["bin"].notna()]
        return pdf

    for pdf in frames:
        held.append(pdf)
        count += len(pdf)
        if count >= block:
            yield settle(False)
    if held:
        yield settle(True)


def pack_items(items: DataFrame, limits: tuple[int, int, int], block: int = BLOCK) -> DataFrame:
    """Containers for items (doc_id string, tokens long, loss_tokens long); limits: tokens, segments, loss-bearing tokens.

    Result: doc_id, segment_no, segments, token_begin, token_end, loss_tokens, bin. An item within the limits comes out
    as one segment; one that exceeds the tokens or loss tokens of a container is cut into the fewest equal shares of it.

    Defined cases. No tokens (null or empty text): one empty segment in no container (bin null). Null id: packed like
    any other. Repeated ids: each an item of its own. Empty table: empty result. Limits below 1: ValueError.
    """
    if min(limits) < 1:
        raise ValueError("limits must be positive")
    size, _, loss = limits
    numbered = materialise(items.withColumn("item", F.monotonically_increasing_id()), "pack-sized")
    parts = F.greatest(F.ceil(F.col("tokens") / size), F.ceil(F.col("loss_tokens") / loss), F.lit(1)).cast("int")
    cut = lambda x, i: F.floor(F.col(x) * i / F.col("segments")).cast("long")
    full = lambda i: F.least(i * F.lit(size).cast("long"), F.col("tokens"))
    place = lambda i: F.when(F.col("by_tokens"), full(i)).otherwise(cut("tokens", i))
    whole = numbered.withColumn("segments", parts).withColumn("by_tokens", F.ceil(F.col("tokens") / size) >= F.col("segments"))
    segs = whole.select("*", F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment_no"))
    i = F.col("segment_no")
    bears = (cut("loss_tokens", i + 1) - cut("loss_tokens", i)).alias("loss_tokens")
    segs = segs.select("item", "doc_id", "segment_no", "segments", place(i).alias("token_begin"), place(i + 1).alias("token_end"), bears)
    none = segs.where("token_end = token_begin").withColumn("bin", F.lit(None).cast("string"))
    some = segs.where("token_end > token_begin")
    first = materialise(some.mapInPandas(lambda fs: _pack_frames(fs, limits, block, False, "a"), PLACED), "pack-first")
    left = first.where("bin is null").drop("bin")
    n = left.count()
    second = left.repartition(max(1, -(-n // (4 * block)))).mapInPandas(lambda fs: _pack_frames(fs, limits, 2 * block, True, "b"), PLACED)
    return first.where("bin is not null").unionByName(second).unionByName(none).drop("item")


def pack_texts(
    docs: DataFrame, id_col: str, text_col: str, max_tokens: int, max_segments: int | None = None, tokenizer_dir: str = TOKENIZER_DIR
) -> DataFrame:
    """pack_items() of whole texts measured in tokens; every token bears loss. Without max_segments only tokens are limited."""
    named = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("text"))
    sized = with_token_counts(named, {"tokens": "text"}, ["doc_id"], tokenizer_dir)
    return pack_items(sized.withColumn("loss_tokens", F.col("tokens")), (max_tokens, max_segments or max_tokens, max_tokens))


def pack_instructions(
    pairs: DataFrame, id_col: str, prompt_col: str, answer_col: str, max_tokens: int, max_segments: int, max_loss_tokens: int,
    tokenizer_dir: str = TOKENIZER_DIR,
) -> DataFrame:
    """pack_items() of prompt and answer pairs; only the tokens of the answer bear loss."""
    named = pairs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(prompt_col).alias("p"), F.col(answer_col).alias("a"))
    sized = with_token_counts(named, {"prompt_tokens": "p", "loss_tokens": "a"}, ["doc_id"], tokenizer_dir)
    both = sized.select("doc_id", (F.col("prompt_tokens") + F.col("loss_tokens")).alias("tokens"), "loss_tokens")
    return pack_items(both, (max_tokens, max_segments, max_loss_tokens))


def bin_report(packed: DataFrame, max_tokens: int) -> DataFrame:
    """Containers, tokens and mean fill of pack_items()."""
    bins = packed.where("bin is not null").groupBy("bin").agg(F.sum(F.col("token_end") - F.col("token_begin")).alias("t"), F.count("*").alias("s"))
    return bins.agg(
        F.count("*").alias("containers"), F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("s"), F.lit(0)).alias("segments"),
        F.round(F.coalesce(F.avg(F.col("t") / max_tokens), F.lit(0.0)), 4).alias("mean_fill")
    )
