"""Sinks: JSON lines, subtitles, packed projects and vocabularies."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpuscle.functions.timing import cue


def _line(c: Column) -> Column:
    """The text without a line end after it, as the sink adds one."""
    return F.when(F.endswith(c, F.lit("\n")), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


def jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines with all fields, null ones too; mode `append` adds to what is there."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def chunk_records(chunks: DataFrame, doc: str = "doc_id", idx: str = "idx", text: str = "text", language: str = "language", source: str = "asr") -> DataFrame:
    """(id, doc_id, text, meta) of chunks."""
    of = F.col(doc).cast("string")
    meta = F.struct(F.coalesce(F.col(language), F.lit("")).alias("language"), F.lit(source).alias("source"))
    return chunks.select(F.concat(of, F.lit("::c"), F.col(idx).cast("string")).alias("id"), of.alias("doc_id"), F.col(text).alias("text"), meta.alias("meta"))


def subtitles(cues: DataFrame, doc: str, path: str) -> None:
    """A folder for each document with its cues (doc, cue, start, end, text) as one text."""
    one = cue(F.col("cue"), F.col("start"), F.col("end"), F.col("text"))
    whole = cues.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue", one.alias("s")))), lambda x: x["s"]), "").alias("value"))
    whole.withColumn("value", _line(F.col("value"))).write.partitionBy(doc).text(path)


def packed(df: DataFrame, root: str, path: str) -> None:
    """A folder for each root with its packed text."""
    df.select(root, _line(F.col("packed")).alias("value")).write.partitionBy(root).text(path)


def vocabulary(vocab: DataFrame, path: str) -> None:
    """The tokens by id, as a JSON list."""
    tokens = F.transform(F.array_sort(F.collect_list(F.struct("token_id", "token"))), lambda x: x["token"])
    vocab.agg(F.to_json(tokens).alias("value")).write.text(path)


def solution(chosen: DataFrame, path: str) -> None:
    """The number of chosen items, then their ids in order."""
    ids = F.array_sort(F.collect_list("item_id"))
    text = F.concat(F.size(ids).cast("string"), F.lit("\n"), F.array_join(F.transform(ids, lambda x: x.cast("string")), " "))
    chosen.agg(text.alias("value")).write.text(path)


def wav(pieces: DataFrame, doc: str, path: str, rate: int = 24_000, seconds: float = 0.2) -> DataFrame:
    """(doc, file, frames, seconds): of each document one WAV file of 16 bits under `path`, written as its pieces (doc,
    idx, samples: bytes) come, each followed by a pause. The rows of a document meet in one task, one piece at a time.

    A file has another name until it is whole, so a repeated task does no harm. The folder is one that pyarrow's file
    systems reach. The result is lazy: files are written when it is read.
    """
    from corpuscle.operators.signal import silence

    pause = b"\0\0" * silence(rate, seconds)
    kind = pieces.schema[doc].dataType
    schema = T.StructType([T.StructField(doc, kind), T.StructField("file", T.StringType()), T.StructField("frames", T.LongType()), T.StructField("seconds", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        system.create_dir(root, recursive=True)
        own, out, size, made = None, None, 0, []

        def ended() -> None:
            out.close()
            # The head tells the length, which is known only now: it goes before the samples in the final file.
            name = f"{root}/{own}.wav"
            with system.open_output_stream(f"{name}.new", compression=None) as whole, system.open_input_stream(f"{name}.part", compression=None) as source:
                whole.write(wav_head(size, rate))
                while data := source.read(1 << 20):
                    whole.write(data)
            system.move(f"{name}.new", name)
            system.delete_file(f"{name}.part")
            made.append((own, name, size // 2, size / 2 / rate))

        for b in batches:
            for d, samples in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if out is None or d != own:
                    if out is not None:
                        ended()
                    own, size = d, 0
                    out = system.open_output_stream(f"{root}/{own}.wav.part", compression=None)
                for data in (samples or b"", pause):
                    out.write(data)
                    size += len(data)
        if out is not None:
            ended()
        columns = list(zip(*made, strict=True)) if made else [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (to_arrow_type(kind), pa.string(), pa.int64(), pa.float64()), strict=True)], schema.fieldNames())

    return pieces.select(doc, "samples", "idx").repartition(doc).sortWithinPartitions(doc, "idx").select(doc, "samples").mapInArrow(run, schema)


def wav_head(size: int, rate: int) -> bytes:
    """The head of a mono WAV file of 16 bits with so many bytes of samples."""
    return b"RIFF" + struct.pack("<I", 36 + size) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, 2 * rate, 2, 16) + b"data" + struct.pack("<I", size)
