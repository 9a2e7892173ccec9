"""Helpers that the training-data operators share: the shared folder and written tables.

Results are lazy, so the tables they read stay in the shared folder: until the end of a `scratch` scope, or until the
folder's owner clears it.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it.

    Only where that setting is absent and all runs on one machine a folder of our own is made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='corpuscle-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_SCOPES: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Written tables of the operators called inside are deleted at the end: results must have been stored by then."""
    _SCOPES.append([])
    try:
        yield
    finally:
        jvm = spark.sparkContext._jvm
        for path in _SCOPES.pop():
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written as a table in the shared folder and read back: later stages survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """df, written to the shared folder in buckets of a key: joins by the key then leave its rows where they are.

    Spark knows buckets only of tables with a name; the name goes again as soon as it is looked up, the files stay.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"corpuscle_{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").bucketBy(n, key).sortBy(key).option("path", new_path(spark, name)).saveAsTable(table)
    made = spark.table(table)
    made.schema  # looked up
    spark.sql(f"DROP TABLE {table}")
    return made


#: Bytes of a batch that goes to a Python worker.
BATCH = 4 << 20


def small_batches(spark: SparkSession) -> None:
    """From now on batches for Python workers are bounded by their bytes, not by rows alone, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))


def trim() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (given := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        given(0)


def lean(f: Callable) -> Callable:
    """f, a function of batches, whose worker gives freed memory back to the system when a task is over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def bounded(texts: pa.Array, size: int) -> Iterator[tuple[int, int]]:
    """Runs of rows whose texts have `size` bytes at most together, or are one row."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    total = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    at = 0
    while at < len(lengths):
        stop = max(at + 1, int(np.searchsorted(total, total[at] + size, "right")) - 1)
        yield at, stop
        at = stop


def zipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, a text, becomes its hash, its length in bytes, and its bytes in zstd; null counts as empty."""
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        raw = [x or b"" for x in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
        made = [pa.array([hashlib.sha256(x).digest() for x in raw], pa.binary()), pa.array([len(x) for x in raw], pa.int64()), pa.array([z.compress(x) if x else b"" for x in raw], pa.binary())]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], *made], [*b.schema.names[:-1], "sha", "n_bytes", "z"])


def unzipped(z: bytes | None) -> bytes:
    return zstandard.decompress(z) if z else b""


def texts_by_id(df: DataFrame, text: str, columns: list[T.StructField], name: str) -> DataFrame:
    """(id, c0.., sha, n_bytes, z) of df, in buckets of a new id: columns under numbers, and the text by zipped()."""
    small_batches(df.sparkSession)
    kinds = [T.StructField(f"c{i}", f.dataType) for i, f in enumerate(columns)]
    made = [T.StructField("sha", T.BinaryType()), T.StructField("n_bytes", T.LongType()), T.StructField("z", T.BinaryType())]
    rows = df.select(*(F.col(f"`{f.name}`").alias(k.name) for f, k in zip(columns, kinds, strict=True)), F.col(f"`{text}`").cast("string").alias("_text"))
    return bucketed(rows.mapInArrow(lean(zipped), T.StructType([*kinds, *made])).withColumn("id", F.monotonically_increasing_id()), "id", name)


def tables(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
