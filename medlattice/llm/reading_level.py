"""Problem 8: how demanding each text is to read, by harmonic propagation on a document-word graph.

Documents and the words they hold (with a few surface marks: mean word and sentence length) are the two sides of a graph.
Graded texts are clamped to their level. In each round a document takes the weighted mean of its words and a word the mean
of its documents; a word that graded texts hold stays tied to their mean (a "dongle" node whose pull is n / (n + TIE) for n
graded texts). Words whose documents agree weigh more; the weights are set in the first rounds and then kept, so that what
follows is a linear iteration with one fixed point. It goes on until no word's level moves by more than a tolerance; the
rounds taken and the last change are part of the result. The borders between bands lie midway between the mean levels that
the graded texts of neighbouring bands get, each scored without its own grade.

The graph has the words that at least SHARE of the documents hold, and those of graded texts. If a document holds m words on
average, there are at most m / SHARE such words, however many documents there are: their levels are sent to every task,
documents stay where they are, and only sums per task and word are shuffled. The same plan runs at every size.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import collect_control, materialise, spread
from .languages import FUNCTION_WORDS, LANGUAGES_OF

BANDS = ("easy", "plain", "skilled", "expert")
TIE, EASE = 2.0, 0.05
#: Share of the documents that must hold a word, rounds that set the words' weights, and when to stop.
SHARE, SETTING, TOLERANCE, MOST_ROUNDS = 0.0005, 2, 0.001, 40
#: Words that a text must have, and the share of words of another language's function words from which it isn't English.
LEAST_WORDS, FOREIGN = 40, 0.06

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_TABLE_LINE = re.compile(r"^.*(?:\|.*\||\t.*\t).*$|^\s*[-+=|\s]{3,}$", re.M)
_CELL_LINE = re.compile(r"^[^\n.!?]{0,60}?[:;,|\t ]\s*[<>]?-?\d+(?:[.,]\d+)?\s*[^\s.!?]{0,8}[ \t]*$", re.M)
_SENTENCE = re.compile(r"[.!?](?:\s|$)|\n+")
_ENGLISH = frozenset(FUNCTION_WORDS["en"])
#: Languages of the words that speak against English.
_AGAINST = {
    w: langs for w, langs in LANGUAGES_OF.items() if len(w) > 1 and w not in _ENGLISH and w not in (
        "is", "me", "non", "per", "no", "es", "die", "do", "man", "dan", "den", "har", "bed", "data", "plus", "via", "car"
    )
}


def prose_words(text: str | None) -> list[str]:
    """Words of an English prose text without table lines, in lower case; empty if it is no such text."""
    if not text:
        return []
    x = html.unescape(text) if "&" in text else text
    if "\n" in x or "\r" in x or len(x) < 200:  # else the whole text is one line, too long for a cell
        x = _CELL_LINE.sub("", _TABLE_LINE.sub("", x))
    elif "|" in x or "\t" in x:
        x = _TABLE_LINE.sub("", x)
    told = 0
    for t in x.split():
        told += any(map(str.isalnum, t))
        if told >= LEAST_WORDS:
            break
    else:
        return []
    words = _WORD.findall(x.lower())
    if not words:
        return []
    letters = "".join(words)
    if len(letters.encode("ascii", "ignore")) < 0.9 * len(letters):
        return []
    own = 0
    foreign: Counter = Counter()
    for w, n in Counter(words).items():
        if w in _ENGLISH:
            own += n
        for lang in _AGAINST.get(w, ()):
            foreign[lang] += n
    most = max(foreign.values(), default=0)
    return words if own >= 2 * most or most < FOREIGN * len(words) else []


def marks(text: str, words: list[str]) -> list[int]:
    """Hashes of the distinct words and surface marks of a text."""
    sentences = max(1, len(_SENTENCE.findall(text.strip())))
    own = set(words)
    own.add(f"~word length {round(2 * sum(map(len, words)) / len(words))}")
    own.add(f"~sentence length {min(12, len(words) // sentences // 4)}")
    digest = xxhash.xxh3_64_intdigest
    return sorted([digest(w) - (1 << 63) for w in own])


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], np.diff(offsets)


def _levels(place: np.ndarray, sizes: np.ndarray, level: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Level of each document, given as the places of its words, or NaN for one without words that have a level."""
    w = weight[place]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    total = np.bincount(doc, w, len(sizes))
    value = np.bincount(doc, w * level[place], len(sizes))
    return np.where(total > 0, value / np.where(total > 0, total, 1.0), np.nan)


def _vocabulary(docs: DataFrame, graded: np.ndarray, share: float) -> np.ndarray:
    """Sorted hashes of the words that at least `share` of the documents hold (two at least), and those of graded texts."""

    def count(batches):
        """Words and documents that hold them, summed per task; (null, documents)."""
        seen: list[np.ndarray] = []
        rows = held = 0

        def flush():
            word, n = np.unique(np.concatenate(seen), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word), pa.array(n)], names=["word", "n"])

        for b in batches:
            flat, _ = _lists(b.column("marks"))
            seen.append(flat)
            rows, held = rows + b.num_rows, held + len(flat)
            if held > 5_000_000:
                yield flush()
                seen, held = [], 0
        if seen:
            yield flush()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([rows])], names=["word", "n"])

    counts = materialise(docs.select("marks").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "reading-counts")
    total = counts.where("word is null").first()
    least = max(2.0, share * (total.n if total else 0))
    kept = counts.where(F.col("word").isNotNull() & (F.col("n") >= least)).select("word").toPandas()["word"].to_numpy(np.int64)  # mean words / SHARE at most
    return np.union1d(kept, graded)


@dataclass(frozen=True)
class ReadingLevels:
    """levels: doc_id, n_words, level, band. rounds taken, and the largest change of a word's level in the last one."""

    levels: DataFrame
    rounds: int
    change: float


def reading_levels(
    docs: DataFrame, id_col: str, text_col: str, graded: DataFrame, share: float = SHARE, tolerance: float = TOLERANCE, most_rounds: int = MOST_ROUNDS
) -> ReadingLevels:
    """doc_id, n_words, level (0 easy .. 3 expert, continuous) and band of every document of English prose.

    graded: item_id, band, text; a control table. Texts are read whole; English and prose are told by the text itself.
    share: see the module's text. Rounds end when no level moves by more than `tolerance`, or after most_rounds.

    Defined cases. Null, blank, foreign or tabular texts and texts under LEAST_WORDS words: no row. Null id: no row.
    Repeated ids: each row has its result. No graded text of any band: empty result. Bands other than BANDS and graded
    texts without words: not used. A document none of whose words is tied to a graded text: the mean of the graded
    levels. Empty documents: empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    told = [(r.band, r.text or "") for r in collect_control(graded.select("band", "text")) if r.band in BANDS]
    read_graded = [(BANDS.index(b), html.unescape(t), prose_words(t) or [w.lower() for w in _WORD.findall(t)]) for b, t in told]
    rows = [(y, np.array(marks(t, w), np.int64)) for y, t, w in read_graded if w]
    kind = docs.schema[id_col].dataType.simpleString()
    base = spread(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))).where("doc_id is not null and text is not null")
    if not rows:
        return ReadingLevels(spark.createDataFrame([], f"doc_id {kind}, n_words int, level double, band string"), 0, 0.0)

    def read(batches):
        for b in batches:
            keep, n, found = [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                w = prose_words(t)
                if w:
                    keep.append(i)
                    n.append(len(w))
                    found.append(marks(html.unescape(t) if "&" in t else t, w))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int32()), pa.array(found, pa.list_(pa.int64()))],
                names=["doc_id", "n_words", "marks"]
            )

    marked = materialise(base.mapInArrow(read, f"doc_id {kind}, n_words int, marks array<long>"), "reading-marks")
    word = _vocabulary(marked, np.unique(np.concatenate([m for _, m in rows])), share)
    size = len(word)
    sent_words = spark.sparkContext.broadcast(word)

    def place(batches):
        """The places of each document's words in the vocabulary."""
        for b in batches:
            flat, sizes = _lists(b.column("marks"))
            at = np.minimum(np.searchsorted(sent_words.value, flat), size - 1)
            there = sent_words.value[at] == flat
            ends = np.concatenate([[0], np.cumsum(there)])[np.concatenate([[0], np.cumsum(sizes)])]
            column = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at[there].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), column], names=["doc_id", "n_words", "places"])

    placed = materialise(marked.mapInArrow(place, f"doc_id {kind}, n_words int, places array<int>"), "reading-places")

    # what graded texts say of each word: how many (g), their mean (m) and variance (v)
    at = np.concatenate([np.searchsorted(word, m) for _, m in rows])
    grade = np.concatenate([np.full(len(m), float(y)) for y, m in rows])
    g = np.bincount(at, minlength=size).astype(float)
    one = np.maximum(g, 1.0)
    m = np.bincount(at, grade, size) / one
    v = np.maximum(np.bincount(at, grade**2, size) / one - m * m, 0.0)
    level, weight = m.copy(), np.where(g > 0, 1.0 / (v + EASE), 0.0)
    mean = np.zeros(size)
    n = np.zeros(size)

    def sums(level: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of each word: documents with a level that hold it, the sum of their levels and of the squares."""
        sent = spark.sparkContext.broadcast((level, weight))

        def run(batches):
            total = np.zeros((3, size))
            for b in batches:
                flat, sizes = _lists(b.column("places"))
                s = np.repeat(_levels(flat, sizes, *sent.value), sizes)
                use = ~np.isnan(s)
                flat, s = flat[use], s[use]
                total += [np.bincount(flat, x, size) for x in (np.ones(len(s)), s, s * s)]
            hit = np.flatnonzero(total[0])
            yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), *(pa.array(x[hit]) for x in total)], names=["place", "n", "s", "q"])

        added = placed.select("places").mapInArrow(
            run, "place int, n double, s double, q double"
        ).groupBy("place").agg(*(F.sum(c).alias(c) for c in "nsq")).toPandas()
        out = np.zeros((3, size))
        out[:, added["place"].to_numpy(np.int64)] = added[["n", "s", "q"]].to_numpy(float).T
        sent.destroy()
        return out

    pull = g / (g + TIE)
    rounds, change = 0, np.inf
    while rounds < most_rounds and change > tolerance:
        n, total, squares = sums(level, weight)
        has = n > 0
        mean = np.where(has, total / np.maximum(n, 1.0), m)
        moved = np.where(g > 0, np.where(has, pull * m + (1 - pull) * mean, m), mean)
        if rounds < SETTING:
            apart = np.maximum(squares / np.maximum(n, 1.0) - mean * mean, 0.0)
            vary = np.where(g > 0, np.where(has, pull * v + (1 - pull) * apart, v), apart)
            weight = np.where((g > 0) | (n > 1), 1.0 / (vary + EASE), 0.0)
        rounds += 1
        change = float(np.abs(np.where(weight > 0, moved - level, 0.0)).max()) if rounds > 1 else np.inf
        level = moved

    # borders: each graded text is scored by its words without its own grade
    own_level = {}
    for y, ms in rows:
        p = np.searchsorted(word, ms)
        others = g[p] - 1
        rest = (g[p] * m[p] - y) / np.maximum(others, 1.0)
        tied = np.where(n[p] > 0, (others * rest + TIE * mean[p]) / (others + TIE), rest)
        w = np.where((others > 0) | (n[p] > 1), weight[p], 0.0)
        if w.sum() > 0:
            own_level.setdefault(y, []).append(float((w * tied).sum() / w.sum()))
    means = {y: float(np.mean(x)) for y, x in sorted(own_level.items())}
    if not means:  # the words of each graded text are its own
        means = {y: float(y) for y, _ in rows}
    there = sorted(means)
    middle = float(np.mean([y for y, _ in rows]))
    known = spark.sparkContext.broadcast((level, weight))

    def finish(batches):
        for b in batches:
            flat, sizes = _lists(b.column("places"))
            s = _levels(flat, sizes, *known.value)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("n_words"), pa.array(np.where(np.isnan(s), middle, s))], names=["doc_id", "n_words", "level"]
            )

    scored = placed.mapInArrow(finish, f"doc_id {kind}, n_words int, level double")
    # piecewise linear from the graded texts' means to the levels 0 .. 3
    x = F.col("level")
    band, scale = F.lit(BANDS[there[0]]), F.lit(float(there[0]))
    for a, b in zip(there, there[1:]):
        band = F.when(x >= (means[a] + means[b]) / 2, F.lit(BANDS[b])).otherwise(band)
        width = max(means[b] - means[a], 1e-9)
        scale = F.when(x >= means[a], F.least(a + (x - means[a]) / width * (b - a), F.lit(float(b)))).otherwise(scale)
    return ReadingLevels(scored.select("doc_id", "n_words", F.round(scale, 4).alias("level"), band.alias("band")), rounds, change)
