"""Column functions for text that several operators share."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Non-empty runs of non-blank characters, in order, as str.split() gives them; null for null."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def trimmed(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def capitalised(text: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))


def sentences(text: Column, pattern: str = r"[.!?] ") -> Column:
    return F.split(text, pattern)


#: What SQL's engine (RE2) takes for \s, and a word boundary told by ASCII letters, digits and the underscore alone.
SQL_BLANKS, SQL_BOUNDARY = r"\t\n\f\r ", r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def sql_pattern(pattern: str) -> str:
    r"""The pattern with \b and \s as SQL has them.

    Java's \b counts letters of every script up to version 17 and only ASCII ones from 19 on; its \s has one blank more.
    """
    in_class, out = False, []
    for x in re.findall(r"\\.|.", pattern, re.S):
        in_class = x == "[" or (in_class and x != "]")
        out.append(SQL_BOUNDARY if x == r"\b" else (SQL_BLANKS if in_class else f"[{SQL_BLANKS}]") if x == r"\s" else x)
    return "".join(out)


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def replace_each(text: Column, found: Column, token: str) -> Column:
    """Every occurrence of every found string replaced, one after the other."""
    return F.aggregate(found, text, lambda acc, x: F.replace(acc, x, F.lit(token)))


def replace_chain(text: Column, rules: list[tuple[str, str]], regex: bool = False) -> Column:
    """Rules (pattern or string, replacement) in order."""
    step = (lambda c, r: F.regexp_replace(c, r[0], r[1])) if regex else (lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])))
    return reduce(step, rules, text)


def any_contains(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(n) for n in needles])
