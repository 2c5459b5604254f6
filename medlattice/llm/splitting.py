"""Problem 2: splitting oversized texts at natural boundaries.

A hierarchy of separators (section, paragraph, sentence, word, character) breaks a text into atoms: a part that is short
enough at one level is not broken further. Atoms are packed greedily into pieces up to the limit, and each piece after
the first starts `overlap` characters before the cut.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = ("section", "paragraph", "sentence", "word", "character")
#: Where a part of each level may end; the match's end is the cut. A section starts with a heading line or a heading in capitals.
_CUTS = (
    re.compile(r"(?:^|[\r\n]|(?<=[.,;] )|(?<=[.,;]))(?=(?:#{1,6} |[A-Z][A-Z /&-]{3,40}(?::|  |\r?\n)))"),
    re.compile(r"(?:\r\n|\n|\r)(?:[ \t]*(?:\r\n|\n|\r))*"),
    re.compile(r"[.!?][\"')\]]*[ \t]+|[。！？]+"),
    re.compile(r"[ \t\r\n]+"),
)
PIECES = T.ArrayType(T.StructType([
    T.StructField("piece_no", T.IntegerType()), T.StructField("begin", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("cut", T.StringType()), T.StructField("text", T.StringType()),
]))


def split_text(text: str, max_size: int, overlap: int, snap: bool = False) -> list[tuple[int, int, str]]:
    """(begin, end, level of the cut at the end) of each piece; text[begin:end] is the piece, begin <= the end before.

    Neighbours share exactly `overlap` characters, or fewer where an unbroken run of characters would not fit otherwise.
    snap: the shared part begins after a blank where it has one, so that it holds whole words and may be shorter.
    """
    n = len(text)
    if n <= max_size:
        return [(0, n, "end")]
    room = max_size - overlap
    cuts = [[m.end() for m in rx.finditer(text) if 0 < m.end() < n] for rx in _CUTS]
    ends: list[tuple[int, int]] = []  # end of each atom, level of that end

    def atoms(begin: int, end: int, level: int) -> None:
        """Break text[begin:end], which is longer than its room, at the given level."""
        if level == 4:
            for at in range(begin + room, end, room):
                ends.append((at, 4))
            return
        own = cuts[level]
        at = begin
        for cut in [*own[bisect_right(own, begin) : bisect_left(own, end)], end]:
            # a run without blanks stays whole up to the limit; the overlap gives way to it
            if cut - at > (room if level < 3 else max_size):
                if level == 3:
                    blank = cut - len(text[at:cut]) + len(text[at:cut].rstrip(" \t\r\n"))
                    if blank - at <= max_size:  # only the blanks after the word are too many: any of them is a boundary
                        if blank > at:
                            ends.append((blank, 3))
                        for x in range(max(blank, at) + room, cut, room):
                            ends.append((x, 3))
                    else:
                        atoms(at, cut, 4)
                else:
                    atoms(at, cut, level + 1)
            if cut < end:
                ends.append((cut, level))
            at = cut

    atoms(0, n, 0)
    ends.append((n, 0))
    pieces, begin, last, kind = [], 0, 0, 0
    for end, level in ends:
        if end - begin > max_size:
            pieces.append((begin, last, LEVELS[kind]))
            begin = max(last - overlap, end - max_size, begin + 1)
            if snap and (blank := _CUTS[3].search(text, max(begin - 1, 0), last)) and blank.end() < last:
                begin = blank.end()
        last, kind = end, level
    pieces.append((begin, n, "end"))
    return pieces


def split_oversized(df: DataFrame, key: str, text: str, max_size: int, overlap: int, snap: bool = False) -> DataFrame:
    """Each text of more than max_size characters (code points) once per key: key, n_chars, pieces.

    Neighbours share `overlap` characters, which may begin within a word; with snap they share the whole words of these.
    The length filter runs in the JVM, so only oversized texts are shuffled (to find repeated keys) and reach Python.

    Defined cases. Null, empty or short enough texts: no row. Null key: no row. Repeated keys: the longest text, ties by
    text. A run without blank, tab or line break beyond max_size is cut by force (cut = 'character'). Empty table:
    empty result. Other columns are not read. max_size < 1 or overlap outside 0 .. max_size - 1: ValueError.
    """
    if max_size < 1 or not 0 <= overlap < max_size:
        raise ValueError("max_size must be positive and overlap below it")
    long = df.select(
        F.col(key).cast("string").alias("item_key"), F.col(text).cast("string").alias("text")
    ).where(F.col("item_key").isNotNull() & (F.length("text") > max_size))
    once = long.groupBy("item_key").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("m")).select(
        "item_key", F.col("m.n").alias("n_chars"), F.col("m.text").alias("text")
    )

    @F.pandas_udf(PIECES)
    def pieces(texts):
        import pandas as pd

        return pd.Series([[(i, b, e, c, t[b:e]) for i, (b, e, c) in enumerate(split_text(t, max_size, overlap, snap))] for t in texts])

    return once.select("item_key", "n_chars", pieces("text").alias("pieces"))


def piece_rows(split: DataFrame) -> DataFrame:
    """One row per piece of split_oversized()."""
    return split.select("item_key", F.explode("pieces").alias("p")).select("item_key", "p.*")
