"""Problem 4: records that share most of their words, by fast similarity sketching, banding and exact verification.

A text is the set of its runs of `words` consecutive words. The sketch of a set has T coordinates and is filled in rounds
(Dahlgaard, Knudsen and Thorup, "Fast Similarity Sketching", 2017): in each of the first T rounds every element is thrown
at one hashed bin with a hashed value, in round T + i every element is thrown at bin i, and a bin keeps its least
(round, value). After at most 2 T rounds every coordinate is filled, mostly after a few; two sets agree in a coordinate
with probability equal to their similarity, with concentration like that of independent coordinates.

Runs of ROWS coordinates form band keys. Texts that share a key are candidates; a bit of every coordinate travels with
the key, so that most chance meetings end inside the join. What is left is verified on the whole sets.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise

T, ROWS, BANDS = 192, 3, 30
#: Standard deviations below the expected number of agreeing bits down to which a meeting is a candidate; a pair at the
#: threshold misses it with probability below 0.003. (T bits, each equal with probability (1 + similarity) / 2.)
BITS_SD = 2.8
#: Band keys that a task looks at together; bounds memory.
MEETING = 200_000
#: Classes of one band key that one task compares. A key of more is cut into blocks, and every pair of its blocks is
#: compared in a task of its own, by the same test: the work of a crowded key is spread, and none of its pairs is left out.
BLOCK = 10_000
#: Classes that may be broadcast (8 bytes each); beyond it, the same join is made by a shuffle.
BROADCAST_CLASSES = 500_000
#: Characters of text handled at once by NumPy; bounds memory, not texts.
CHUNK = 1_000_000
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, 64-bit hash) of every distinct run of `words` words, sorted; words are maximal runs of a-z and 0-9 in `texts`, UTF-8 in lower case."""
    buf = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
    if not len(buf):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends_at = np.cumsum(lengths + 1)
    edge = np.diff(_WORD[buf].astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if len(starts) < words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    doc = np.searchsorted(ends_at, starts, side="right")
    base = _U(0x100000001B3)
    power = np.full(len(buf), base, dtype=np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[buf] * power)])
    inverse = np.full(len(buf), _U(pow(int(base), -1, 1 << 64)), dtype=np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse)
    word = _mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _ODD)
    n = len(word) - words + 1
    run = np.zeros(n, dtype=np.uint64)
    for i in range(words):
        run = _mix(run * _U(3) + word[i : i + n] + _U(i + 1))
    inside = doc[:n] == doc[words - 1 :]
    d, h = doc[:n][inside], run[inside]
    order = np.lexsort((h, d))
    d, h = d[order], h[order]
    first = np.ones(len(d), dtype=bool)
    first[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[first], h[first]


def sketch(doc: np.ndarray, h: np.ndarray, n: int, t: int = T) -> np.ndarray:
    """n x t sketch of the sets given by shingles(); rows of empty sets are all ones in binary. See the module's text."""
    full = _U(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, full, dtype=np.uint64)
    live_doc, live_h = doc, h
    for i in range(2 * t):
        if not len(live_h):
            break
        x = _mix(live_h + np.array([i + 1], dtype=np.uint64) * _ODD)
        bins = (x % _U(t)).astype(np.int64) if i < t else np.full(len(x), i - t, dtype=np.int64)
        np.minimum.at(out, live_doc * t + bins, (_U(i) << _U(52)) | (x >> _U(12)))
        if i % 4 == 3:  # texts whose bins are all filled are done: later rounds can't undercut earlier ones
            open_docs = (out.reshape(n, t) == full).any(axis=1)
            keep = open_docs[live_doc]
            if not keep.all():
                live_doc, live_h = live_doc[keep], live_h[keep]
    return out.reshape(n, t)


def _chunks(batches, column: str):
    """(batch, texts as UTF-8, first row) in portions of about CHUNK characters."""
    for b in batches:
        texts = [x.encode() if x else b"" for x in b.column(column).to_pylist()]
        begin = size = 0
        for i, x in enumerate(texts):
            size += len(x) + 1
            if size >= CHUNK:
                yield b.slice(begin, i + 1 - begin), texts[begin : i + 1]
                begin, size = i + 1, 0
        if begin < len(texts):
            yield b.slice(begin), texts[begin:]


def _band_batches(batches, words: int):
    """(key, cls, bits) per text and band; a class already sent by this task is not sent again."""
    seen: set = set()
    salts = (np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD)[None, :]
    for b, texts in _chunks(batches, "text"):
        cls = b.column("cls").to_numpy()
        own = np.unique(cls, return_index=True)[1]
        own = [i for i in own if cls[i] not in seen]
        if len(seen) > 500_000:  # only saves rows; the join drops what is sent twice
            seen.clear()
        seen.update(cls[own])
        doc, h = shingles([texts[i] for i in own], words)
        filled = np.unique(doc)
        if not len(filled):
            continue
        doc = np.searchsorted(filled, doc)
        own_cls = cls[own][filled]
        s = sketch(doc, h, len(filled))
        key = np.zeros((len(filled), BANDS), dtype=np.uint64)
        for r in range(ROWS):
            key = _mix(key * _U(3) + s[:, r : BANDS * ROWS : ROWS] + salts)
        bits = (_mix(s) & _U(1)).reshape(len(filled), T // 64, 64)
        packed = (bits << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
        column = lambda x: pa.array(np.repeat(x, BANDS).view(np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key.ravel().view(np.int64)), column(own_cls), *(column(packed[:, i].copy()) for i in range(T // 64))], names=_KEYED
        )


_KEYED = ["key", "cls", *(f"bits{i}" for i in range(T // 64))]
#: A pair (cls_a, cls_b), or a member of a crowded key (cls_a, null, key, bits, number of its block).
_MET = ["cls_a", "cls_b", "key", *_KEYED[2:], "no"]


def _agreeing(rows: np.ndarray, i: np.ndarray, j: np.ndarray, least: int) -> np.ndarray:
    """Which of the pairs of rows (columns i and j of `rows`, as in _KEYED) agree in at least `least` bits."""
    apart = sum(np.bitwise_count((rows[k, i] ^ rows[k, j]).view(np.uint64)).astype(np.int64) for k in range(2, len(rows)))
    return T - apart >= least


def _met_batch(pairs: list, crowd: list) -> pa.RecordBatch:
    """Rows of _MET: pairs as (cls_a, cls_b), and members of crowded keys as (rows as in _KEYED, number of their block)."""
    a = np.concatenate([np.empty(0, np.int64), *(x for x, _ in pairs), *(rows[1] for rows, _ in crowd)])
    b = np.concatenate([np.empty(0, np.int64), *(y for _, y in pairs)])
    n, extra = len(a), len(a) - len(b)
    no_pair = np.arange(n) >= len(b)
    out = [pa.array(a), pa.array(np.append(b, np.zeros(extra, np.int64)), mask=no_pair)]
    for k in (0, *range(2, len(_KEYED))):
        own = np.concatenate([np.zeros(len(b), np.int64), *(rows[k] for rows, _ in crowd)])
        out.append(pa.array(own, mask=~no_pair))
    number = np.concatenate([np.zeros(len(b), np.int64), *(no for _, no in crowd)])
    return pa.RecordBatch.from_arrays([*out, pa.array(number, mask=~no_pair)], names=_MET)


def _meetings(batches, least: int, block: int):
    """Pairs of classes with the same band key and at least `least` agreeing bits.

    Rows come sorted by key and class. A key of more than `block` classes is not compared here: its members come out with
    their bits and the number of their block, to be compared block by block in tasks of their own (_block_meetings).
    """
    held: list[np.ndarray] = []
    count = 0
    crowded, past = None, 0  # the crowded key that is going on, and how many of its members have gone out

    def settle(last: bool):
        nonlocal held, count, crowded, past
        rows = np.concatenate(held, axis=1)
        new = np.ones(rows.shape[1], dtype=bool)
        new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        rows = rows[:, new]
        key = rows[0]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(begins, len(key)))
        hot = sizes > block
        goes_on = crowded is not None and key[0] == crowded
        hot[0] |= goes_on
        held, count = [], 0
        ready = len(sizes)
        if not last and not hot[-1]:  # the last key may go on
            ready -= 1
            held, count = [rows[:, begins[-1] :]], int(sizes[-1])
        crowd = []
        for g in np.flatnonzero(hot[:ready]):
            at = np.arange(sizes[g]) + (past if g == 0 and goes_on else 0)
            crowd.append((rows[:, begins[g] : begins[g] + sizes[g]], at // block))
        if hot[-1] and not last:
            past = int(sizes[-1]) + (past if len(sizes) == 1 and goes_on else 0)
            crowded = key[-1]
            held, count = [rows[:, -1:]], 1  # a class sent twice is told by it
            crowd[-1] = (crowd[-1][0][:, :-1], crowd[-1][1][:-1])
            past -= 1
        else:
            crowded, past = None, 0
        size = np.repeat(sizes, sizes)
        left = np.repeat(begins + sizes, sizes) - np.arange(len(key)) - 1  # later members of the same key
        i = np.flatnonzero((size > 1) & np.repeat(~hot & (np.arange(len(sizes)) < ready), sizes))
        pairs, step = [], 0
        while True:
            step += 1
            i = i[left[i] >= step]
            if not len(i):
                break
            close = i[_agreeing(rows, i, i + step, least)]
            pairs.append((rows[1, close], rows[1, close + step]))
        return _met_batch(pairs, crowd)

    for x in batches:
        held.append(np.stack([x.column(c).to_numpy() for c in _KEYED]))
        count += x.num_rows
        if count >= max(MEETING, 2 * block):
            yield settle(False)
    if held and count:
        yield settle(True)


def _block_meetings(batches, least: int):
    """The pairs of two blocks of a crowded key, or of one block with itself. Rows come sorted by key, lo, hi and at."""
    held: list[np.ndarray] = []
    names = [*_KEYED, "lo", "hi", "at"]

    def settle(rows: np.ndarray):
        lo, hi, at = rows[-3:]
        two = len(rows) - 3
        second = np.flatnonzero(at == hi)
        pairs = []
        for n, i in enumerate(np.flatnonzero(at == lo)):
            j = second[n + 1 :] if lo[0] == hi[0] else second
            close = j[_agreeing(rows[:two], np.full(len(j), i), j, least)]
            a, b = np.full(len(close), rows[1, i]), rows[1, close]
            pairs.append((np.minimum(a, b), np.maximum(a, b)))
        return _met_batch(pairs, [])

    for x in batches:
        rows = np.stack([x.column(c).to_numpy() for c in names])
        mark = rows[[0, -3, -2]]
        cuts = [0, *(np.flatnonzero((mark[:, 1:] != mark[:, :-1]).any(axis=0)) + 1), rows.shape[1]]
        for b, e in zip(cuts, cuts[1:]):
            part = rows[:, b:e]
            if held and (held[-1][[0, -3, -2], -1] != part[[0, -3, -2], 0]).any():
                yield settle(np.concatenate(held, axis=1))
                held = []
            held.append(part)
    if held:
        yield settle(np.concatenate(held, axis=1))


def _pairs_met(keyed: DataFrame, least: int, block: int) -> DataFrame:
    """cls_a < cls_b of the classes that share a band key and agree in at least `least` bits, once."""
    bits = _KEYED[2:]
    types = ", ".join(f"{c} long" for c in _MET)
    sorted_keys = keyed.repartition("key").sortWithinPartitions("key", "cls")
    met = materialise(sorted_keys.mapInArrow(lambda bs: _meetings(bs, least, block), types), "dup-met")
    members = met.where("cls_b is null").select("key", F.col("cls_a").alias("cls"), *bits, F.col("no").alias("at"))
    blocks = members.groupBy("key").agg(F.max("at").alias("most"))  # one row per crowded key
    lo_hi = F.transform(F.sequence(F.lit(0).cast("long"), F.col("most")), lambda j: F.struct(F.least("at", j).alias("lo"), F.greatest("at", j).alias("hi")))
    each = members.join(blocks, "key").select("key", "cls", *bits, F.explode(lo_hi).alias("p"), "at")
    spread_out = each.select("key", "cls", *bits, "p.lo", "p.hi", "at").repartition("key", "lo", "hi")
    within = spread_out.sortWithinPartitions("key", "lo", "hi", "at", "cls").mapInArrow(lambda bs: _block_meetings(bs, least), types)
    return met.where("cls_b is not null").select("cls_a", "cls_b").unionByName(within.select("cls_a", "cls_b")).distinct()


def _set_batches(batches, words: int):
    """(cls, n, hashes) per text that has any run of words."""
    for b, texts in _chunks(batches, "text"):
        cls = b.column("cls").to_numpy()
        doc, h = shingles(texts, words)
        filled, n = np.unique(doc, return_counts=True)
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(cls[filled]), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))],
            names=["cls", "n", "hashes"]
        )


@dataclass(frozen=True)
class NearDuplicates:
    """members: item_id, cls (texts of the same class are equal but for case). links: cls_a < cls_b, similarity."""

    members: DataFrame
    links: DataFrame


def near_duplicates(items: DataFrame, id_col: str, text_col: str, words: int = 5, threshold: float = 0.8, block: int = BLOCK) -> NearDuplicates:
    """Classes of equal texts and the links between classes whose sets of word runs have at least the given similarity.

    Texts are compared in lower case and whole. Copies meet once, as a class, so that a text repeated by a third of all
    rows costs no more than any other. The classes of a band key are compared in blocks of `block`, whose size changes
    the tasks and never the result. Classes are told by a 64-bit hash of the text.

    Defined cases. Null, blank or shorter texts than `words` words: in no class. Null id: not used. Repeated ids: once per
    distinct text. Empty table: empty results. Other columns are not read.
    """
    text = F.lower(F.col(text_col).cast("string"))
    base = items.select(
        F.col(id_col).cast("string").alias("item_id"), text.alias("text")
    ).where("item_id is not null and text is not null").withColumn("cls", F.xxhash64("text"))
    run = "[a-z0-9]+" + "[^a-z0-9]+[a-z0-9]+" * (words - 1)
    members = materialise(base.where(F.col("text").rlike(run)).select("item_id", "cls").distinct(), "dup-members")

    p = (1 + threshold) / 2
    least = int(T * p - BITS_SD * (T * p * (1 - p)) ** 0.5)
    keyed = base.select("cls", "text").mapInArrow(lambda bs: _band_batches(bs, words), ", ".join(f"{c} long" for c in _KEYED))
    candidates = materialise(_pairs_met(keyed, least, block), "dup-pairs")

    wanted = materialise(candidates.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct(), "dup-wanted")
    hint = F.broadcast(wanted) if wanted.count() <= BROADCAST_CLASSES else wanted
    sets = base.select("cls", "text").join(hint, "cls", "left_semi").mapInArrow(
        lambda bs: _set_batches(bs, words), "cls long, n int, hashes array<long>"
    ).dropDuplicates(["cls"])
    one = sets.select(F.col("cls").alias("cls_a"), F.col("n").alias("n_a"), F.col("hashes").alias("h_a"))
    two = sets.select(F.col("cls").alias("cls_b"), F.col("n").alias("n_b"), F.col("hashes").alias("h_b"))
    joined = candidates.join(one, "cls_a").join(two, "cls_b")

    def verify(batches):
        for x in batches:
            ha, hb = x.column("h_a"), x.column("h_b")
            oa, ob = ha.offsets.to_numpy(), hb.offsets.to_numpy()
            va, vb = ha.values.to_numpy(), hb.values.to_numpy()
            common = np.fromiter(
                (len(np.intersect1d(va[oa[i] : oa[i + 1]], vb[ob[i] : ob[i + 1]], assume_unique=True)) for i in range(x.num_rows)), np.int64,
                x.num_rows
            )
            union = x.column("n_a").to_numpy().astype(np.int64) + x.column("n_b").to_numpy() - common
            yield pa.RecordBatch.from_arrays(
                [x.column("cls_a"), x.column("cls_b"), pa.array(common / np.maximum(union, 1))], names=["cls_a", "cls_b", "similarity"]
            )

    links = joined.mapInArrow(verify, "cls_a long, cls_b long, similarity double").where(F.col("similarity") >= threshold)
    return NearDuplicates(members, materialise(links, "dup-links"))


#: Items of a class that are joined as one list; larger classes are several lists.
TOGETHER = 1_000


def _blocks_of(members: DataFrame, classes: DataFrame) -> DataFrame:
    """cls, blocks, block and items (an array of about TOGETHER item ids) for the members of `classes`."""
    size = members.groupBy("cls").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("blocks")).where("blocks > 1")
    told = members.join(classes, "cls", "left_semi").join(size, "cls", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    block = F.pmod(F.xxhash64("item_id"), F.col("blocks")).cast("int").alias("block")
    return told.groupBy("cls", "blocks", block).agg(F.collect_list("item_id").alias("items"))


def linked_pairs(found: NearDuplicates) -> DataFrame:
    """Every pair of distinct item ids in the same class or in linked classes, id_a < id_b, once.

    Members meet as lists of bounded length, each pair of lists in a row of its own, so no task holds a whole class and
    its pairs; the result itself has n (n - 1) / 2 rows for n copies. `members` and `links` say the same in one row per item and link.
    """
    m, links = found.members, found.links.select("cls_a", "cls_b")
    several = m.groupBy("cls").agg(F.count("*").alias("n")).where("n > 1").select("cls")
    either = links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls"))
    lists = materialise(_blocks_of(m, several.unionByName(either).distinct()), "dup-lists")
    side = lambda c, i: lists.select(F.col("cls").alias(f"cls_{c}"), F.col("block").alias(f"block_{c}"), F.col("items").alias(i))
    count = lists.select("cls", "blocks").distinct()
    numbers = lambda c, n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(f"block_{c}")
    across = links.join(count.toDF("cls_a", "n_a"), "cls_a").join(count.toDF("cls_b", "n_b"), "cls_b").select(
        "cls_a", "cls_b", numbers("a", "n_a"), "n_b"
    ).select(
        "cls_a", "block_a", "cls_b", numbers("b", "n_b")
    )
    own = lists.join(several, "cls", "left_semi").select(
        F.col("cls").alias("cls_a"), F.col("block").alias("block_a"), F.col("cls").alias("cls_b"),
        F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("block_b")
    )
    met = across.unionByName(own).join(side("a", "x"), ["cls_a", "block_a"]).join(side("b", "y"), ["cls_b", "block_b"])
    one_list = ((F.col("cls_a") == F.col("cls_b")) & (F.col("block_a") == F.col("block_b"))).alias("one_list")
    each = met.select(one_list, F.explode("x").alias("x"), "y").select("one_list", "x", F.explode("y").alias("y"))
    return each.where("x <> y and (x < y or not one_list)").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def link_counts(found: NearDuplicates) -> DataFrame:
    """One row per item: its class and the numbers of copies in the class and of links of the class.

    Members meet at most one row per class, so a class of a third of all items is split by adaptive execution.
    """
    both = found.links.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("links"))
    size = found.members.groupBy("cls").agg(F.count("*").alias("copies")).where("copies > 1")
    told = found.members.join(size.join(both, "cls", "full"), "cls", "left")
    return told.select("item_id", F.col("cls").alias("class_id"), F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
