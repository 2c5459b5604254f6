"""Functions that SQL text can call, registered with a session."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators.privacy import patterns
from .similarity import bleu_4, rouge_l_f, sequence_ratio


@udtf(returnType="pii_type string, pos int, instance string")
class PiiMatches:
    """pii_matches(text, level): one row per match, in the order of the types and of the text.

    A wrapper for SQL text, called once per row; over whole tables use operators.privacy.detected_rows, which stays in the JVM.
    """

    def eval(self, text: str, level: str):
        for kind, pattern in patterns(level or "minimal"):
            for i, m in enumerate(re.finditer(pattern, text or "")):
                yield kind, i, m.group()


def register(spark: SparkSession) -> None:
    spark.udtf.register("pii_matches", PiiMatches)
    for name, f in (("sequence_ratio", sequence_ratio), ("rouge_l", rouge_l_f), ("bleu_4", bleu_4)):
        spark.udf.register(name, f)
