"""The pipeline: quality, near-duplicates, repeated passages, packing. Each stage works on all its predecessor kept.

Rows: null texts count as empty; all stages but the last keep them, as empty texts, if the classifier does. Of texts
without words one stays. Ties and repeated rows are equal texts: the smallest doc_id stays, a null one last. An empty
table goes through all stages as one. Columns besides those of documents are not carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscle.llm import mil, neardup, packing, suffix
from corpuscle.llm.queries import WORD_BPE
from corpuscle.llm.shared import new_path, scratch, tables

#: A document stays if its score is at least this; half, as a clean document must not go.
KEEP = 0.5
#: Words of a repeated passage, its bytes (words of two letters on average), and the grams by which it is found.
PASSAGE_WORDS, PASSAGE, GRAM = 51, 150, 60
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = mil.fit(docs, tables(spark, sf_dir, "labels"), "quality")
    return mil.score(docs.select(*COLUMNS), model, name="_score").where(F.col("_score") >= KEEP).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: the one with the smallest doc_id."""
    return neardup.one_of_each(docs.select(*COLUMNS), width=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of over fifty words that occur elsewhere, too, or twice in them; a character that is
    cut in two goes with its passage. Runs of repeated strings of `PASSAGE` bytes that hold fewer words stay."""

    kept = suffix.deduplicated(docs.select("doc_id", "text", "lang", "source"), length=PASSAGE, least_words=PASSAGE_WORDS, gram=GRAM, as_text=True)
    return kept.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.char_length("kept").cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each document's pieces in sequences of 4096 tokens."""
    made = packing.pieces(docs, WORD_BPE, end=1, capacity=4096)
    return packing.pack(made.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), 4096)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("packed", packed),
]

#: SQL cannot express the classifier, so the rows are tested against plain versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
