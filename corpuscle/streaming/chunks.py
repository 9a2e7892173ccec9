"""Chunks and clean pages of files as they arrive. The functions keep no state, so streams need nothing of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpuscle.functions import folds, text


def transcripts(spark: SparkSession, path: str, schema: str = "id STRING, text STRING, language STRING") -> DataFrame:
    return spark.readStream.schema(schema).json(path)


def chunked(rows: DataFrame, max_chars: int = 800) -> DataFrame:
    """(id, idx, text) of rows (id, text)."""
    return rows.select("id", F.posexplode(folds.pack_words(F.col("text"), max_chars)).alias("idx", "text"))


def cleaned(rows: DataFrame, html: str = "html") -> DataFrame:
    return rows.withColumn("text", text.clean_html(F.col(html)))


def start(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what has arrived so far as Parquet, and stops."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
