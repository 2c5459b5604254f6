"""Sinks for results, split question sets and the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import _exists


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON files, in folders by split and type where asked for."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_texts(df: DataFrame, text: str, path: str) -> None:
    """The text column alone, one record per line with line breaks escaped."""
    df.where(F.col(text).isNotNull()).select(F.regexp_replace(text, "\n", r"\\n").alias("value")).write.mode("overwrite").text(path)


def write_pairs(refined: DataFrame, path: str) -> None:
    """Of each refined document its text, in a folder `texts/document_id=...`, and what else is known of it, in JSON under `metadata`."""
    texts = refined.where("final_synthetic_data is not null").select("document_id", F.col("final_synthetic_data").alias("value"))
    texts.write.mode("overwrite").partitionBy("document_id").text(f"{path}/texts")
    refined.drop("final_synthetic_data").write.mode("overwrite").json(f"{path}/metadata")


def write_csv(df: DataFrame, path: str) -> None:
    """S18."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True)


def save_index(index: DataFrame, path: str, model: str) -> None:
    """Rows (item_id, text, embedding) of a vector index; the model's name travels as a column."""
    index.withColumn("model", F.lit(model)).write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, str | None]:
    """The index and its model's name; a missing index is an error, an empty one isn't."""
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path)
    row = df.select("model").first()
    return df.drop("model"), row.model if row else None
