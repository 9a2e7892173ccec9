"""Character vocabularies, encoded batches, greedy CTC decoding, timelines and chapter ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions.text import characters, strip

#: Special tokens: their ids are 0 and 1.
BLANK, UNK = "<blank>", "<unk>"


def vocabulary(df: DataFrame, text: str) -> DataFrame:
    """(token, token_id): the specials, then the characters of the lower-cased texts by code point, without line ends
    and tabs. Characters are made distinct before they are numbered, so the numbering sees one row for each."""
    chars = df.select(F.explode(F.array_distinct(characters(F.lower(F.col(text))))).alias("token")).where(~F.col("token").isin("\n", "\r", "\t")).distinct()
    numbered = chars.select("token", (F.row_number().over(Window.orderBy("token")) + 1).cast("long").alias("token_id"))
    specials = df.sparkSession.sql(f"SELECT * FROM VALUES ('{BLANK}', 0L), ('{UNK}', 1L) AS t(token, token_id)")
    return specials.unionByName(numbered)


def encode(df: DataFrame, vocab: DataFrame, text: str, out: str = "ids", stripped: bool = True) -> DataFrame:
    """df with the ids of the lower-cased text's characters, 1 for unknown ones; null counts as empty.

    The vocabulary has a row for each character of Unicode at most; it is read once and goes to the tasks as an array
    over code points. Tokens of more than one character are no character's.
    """
    table = np.ones(0x110000, np.int64)
    for r in vocab.where(F.length("token") == 1).select("token", "token_id").toLocalIterator():
        table[ord(r["token"])] = r["token_id"]
    table = table[: int(np.flatnonzero(table != 1).max(initial=0)) + 2].copy()  # the last one stands for all beyond

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: table[np.minimum(np.frombuffer(t.encode("utf-32-le"), np.uint32), len(table) - 1)])

    lowered = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumn(out, ids(strip(lowered) if stripped else lowered))


def pad_batches(df: DataFrame, ids: str, order: str, size: int = 4) -> DataFrame:
    """df with batch, length, and padded: zeros up to the batch's longest. A batch holds the rows whose number in
    `order` has the same quotient by `size`; numbers without gaps give batches of that size. So no task has to see
    all rows, as it would to number them anew."""
    numbered = df.withColumn("batch", F.floor(F.col(order) / size).cast("long"))
    longest = F.max(F.size(ids)).over(Window.partitionBy("batch"))
    padded = F.concat(F.col(ids), F.array_repeat(F.lit(0).cast("long"), longest - F.size(ids)))
    return numbered.withColumn("length", F.size(ids).cast("long")).withColumn("padded", padded)


def best_index(logits: Column) -> Column:
    """The place of the first largest value, from 0."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("long")


def ctc_decode(df: DataFrame, utt: str, t: str, logits: str, vocab: DataFrame, blank: int = 0) -> DataFrame:
    """(utt, text): the best index of each frame, without blanks and repeats of the frame before, as characters."""
    w = Window.partitionBy(utt).orderBy(t)
    best = df.select(utt, t, best_index(F.col(logits)).alias("_i")).withColumn("_before", F.lag("_i").over(w))
    kept = (F.col("_i") != blank) & ~F.col("_i").eqNullSafe(F.col("_before"))
    named = best.withColumn("_kept", kept).join(F.broadcast(vocab.select(F.col("token_id").alias("_i"), "token")), "_i", "left")
    lists = F.array_sort(F.collect_list(F.when(F.col("_kept"), F.struct(F.col(t).alias("t"), F.coalesce("token", F.lit("")).alias("c")))))
    return named.groupBy(utt).agg(F.array_join(F.transform(lists, lambda x: x["c"]), "").alias("text"))


def timeline(df: DataFrame, doc: str, index: str, length: str, total: str) -> DataFrame:
    """df with start and end of each piece: the total is shared out by length."""
    w = Window.partitionBy(doc).orderBy(index)
    before = F.coalesce(F.sum(length).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    whole = F.sum(length).over(Window.partitionBy(doc))
    share = lambda x: F.when(whole > 0, F.col(total) * x / whole).otherwise(F.lit(0.0))
    return df.withColumn("start", share(before)).withColumn("end", share(before + F.col(length)))


def chapter_items(df: DataFrame, doc: str, index: str, text: str, start: str | None, end: str | None) -> DataFrame:
    """(doc, text) from the first item that holds `start` through the first from there that holds `end`; items are
    joined by blank lines, empty ones left out. Without a start, from the first item; no match gives no row."""
    holds = lambda marker: F.contains(F.lower(F.col(text)), F.lit(marker.lower()))
    rows = df.where(F.coalesce(F.col(text), F.lit("")) != "")
    w = Window.partitionBy(doc).orderBy(index)
    began = F.max((holds(start) if start is not None else F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_on", began).where("_on = 1")
    stops = (holds(end) if end is not None else F.lit(False)).cast("int")
    rows = rows.withColumn("_over", F.coalesce(F.sum(stops).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).where("_over = 0")
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(index).alias("i"), F.col(text).alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def chapter_text(text: Column, start: str | None, end: str | None) -> Column:
    """The text from the first `start` (or the beginning) through the first `end` from there (or to the end)."""
    low = F.lower(text)
    first = F.greatest(F.locate(start.lower(), low) if start else F.lit(1), F.lit(1))
    last = F.length(text) + 1
    if end:
        found = F.locate(end.lower(), F.substring(low, first, F.length(low)))
        last = F.when(found > 0, first + found - 1 + len(end)).otherwise(last)
    return F.substring(text, first, last - first)
