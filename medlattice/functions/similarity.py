"""Text similarity that built-in functions can't express, as Arrow-batched functions."""

from __future__ import annotations

import math
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(original: pd.Series, other: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two texts; the order of the arguments matters. Null if either is null."""
    return pd.Series(
        [None if a is None or b is None else 1.0 if a == b else SequenceMatcher(None, a, b).ratio() for a, b in zip(original, other)], dtype="float64"
    )


def lcs_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[str, int] = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    row = (1 << len(a)) - 1
    full = row
    for w in b:
        hit = row & where.get(w, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - bin(row).count("1")


def rouge_l(candidate: str, reference: str) -> float:
    """F measure of the longest common subsequence of words."""
    a, b = candidate.split(), reference.split()
    if not a or not b:
        return 0.0
    n = lcs_length(a, b)
    return 2.0 * n / (len(a) + len(b)) if n else 0.0


def bleu(candidate: str, reference: str, order: int = 4) -> float:
    """BLEU with uniform weights up to 4-grams and brevity penalty; 0 where an order has no match."""
    a, b = candidate.split(), reference.split()
    if not a or not b:
        return 0.0
    total = 0.0
    for n in range(1, order + 1):
        x, y = (Counter(zip(*(t[i:] for i in range(n)))) for t in (a, b))
        hit = sum((x & y).values())
        if not hit:
            return 0.0
        total += math.log(hit / sum(x.values())) / order
    return math.exp(total + min(0.0, 1 - len(b) / len(a)))


@F.pandas_udf(T.DoubleType())
def rouge_l_f(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([rouge_l(a or "", b or "") for a, b in zip(candidate, reference)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def bleu_4(candidate: pd.Series, reference: pd.Series) -> pd.Series:
    return pd.Series([bleu(a or "", b or "") for a, b in zip(candidate, reference)], dtype="float64")
