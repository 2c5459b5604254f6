"""The stateless operators on streams, and leakage by event window. Batch and stream share the same column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.privacy import LEAK_TYPES, is_sensitive, match_count, redact


def redact_stream(stream: DataFrame, text: str, level: str = "standard") -> DataFrame:
    """Adds redacted and sensitive; nothing is kept between batches."""
    return stream.withColumn("redacted", redact(F.col(text), level)).withColumn("sensitive", is_sensitive(F.col(text)))


def leakage_by_window(stream: DataFrame, text: str, at: str, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Texts and their pattern matches per event-time window; rows later than `late` are left out, as state must end."""
    counted = stream.withWatermark(at, late).select(F.window(at, window).alias("w"), match_count(F.coalesce(F.col(text), F.lit("")), LEAK_TYPES).alias("n"))
    return counted.groupBy("w").agg(F.count("*").alias("texts"), F.sum("n").alias("matches")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "texts", "matches",
        F.least(F.col("matches") / F.col("texts") / 10, F.lit(1.0)).alias("leakage")
    )
