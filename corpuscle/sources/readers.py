"""Sources: JSON lines, texts, file listings, books, WAV files, and small text formats."""

from __future__ import annotations

import io
import posixpath
import wave
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpuscle.functions.text import basename, clean_html, stem, strip, suffix
from corpuscle.operators.files import probably_binary
from corpuscle.operators.media import AUDIO, IMAGE
from corpuscle.operators.signal import mono, resample

MANIFEST = "id STRING, audio STRING"
TRANSCRIPT = "id STRING, text STRING, segments ARRAY<STRUCT<start DOUBLE, end DOUBLE, text STRING>>, language STRING"
CHUNK = "id STRING, doc_id STRING, text STRING, meta STRUCT<language STRING, source STRING>"
# Extensions of recordings, encodings tried in order, and what a WAV file for recognition may be.
RECORDINGS = ["wav", "mp3", "m4a", "flac"]
LADDER = ("utf-8", "utf-16", "utf-16le", "utf-16be", "cp1252", "latin-1")
SHORT_LADDER = ("utf-8", "cp1252", "latin-1")
RATES = (8000, 16000, 32000, 44100, 48000)


def jsonl(spark: SparkSession, path: str, schema: str, required: tuple[str, ...] = ("id",)) -> DataFrame:
    """JSON lines of a schema; lines that are no JSON, or lack a required field, raise. Blank lines are skipped."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for name in required:
        df = df.withColumn(name, F.when(F.col(name).isNull(), F.raise_error(F.lit(f"a line lacks {name}")).cast(df.schema[name].dataType)).otherwise(F.col(name)))
    return df


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, MANIFEST, ("id", "audio"))


def transcripts(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, TRANSCRIPT, ("id", "text"))


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return jsonl(spark, path, CHUNK, ("id", "text"))


def binaries(spark: SparkSession, path: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """Files as rows; contents are read only if selected, and filters on `length` reach the scan."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def recordings(spark: SparkSession, path: str) -> DataFrame:
    """(id, audio) of the recordings in a folder and those below."""
    return binaries(spark, path).where(suffix(F.col("path")).isin(RECORDINGS)).select(stem(F.col("path")).alias("id"), F.col("path").alias("audio"))


def wavs(spark: SparkSession, path: str) -> DataFrame:
    """(id, path) of the WAV files of a folder alone."""
    return binaries(spark, path, recursive=False, pattern="*.wav").select(stem(F.col("path")).alias("id"), "path")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text) of the text files of a folder, stripped."""
    df = spark.read.option("pathGlobFilter", "*.txt").text(path, wholetext=True)
    return df.select(stem(F.col("_metadata.file_path")).alias("id"), strip(F.col("value")).alias("text"))


def decoder(encodings: tuple[str, ...] = SHORT_LADDER):
    """A function of binary columns: the text in the first encoding that fits."""

    @F.pandas_udf(T.StringType())
    def decoded(content: pd.Series) -> pd.Series:
        def one(x: bytes | None) -> str | None:
            for name in encodings if x is not None else ():
                try:
                    return x.decode(name)
                except UnicodeDecodeError:
                    continue
            return None if x is None else x.decode("utf-8", "ignore")

        return content.map(one)

    return decoded


@F.pandas_udf(T.StringType())
def decode_replacing(content: pd.Series) -> pd.Series:
    """UTF-8, with U+FFFD for what is none."""
    return content.map(lambda x: None if x is None else x.decode("utf-8", "replace"))


def project_files(spark: SparkSession, root: str) -> DataFrame:
    """(root, path, size, binary, text) of the files below a folder, with paths from there."""
    base = "/" + root.split("://")[-1].strip("/")
    df = binaries(spark, root).select(F.lit(base).alias("root"), F.expr(f"substring(regexp_replace(path, '^[a-z]+:/*', '/'), {len(base) + 2})").alias("path"), F.col("length").alias("size"), "content")
    return df.withColumn("binary", probably_binary(F.col("content"))).withColumn("text", decode_replacing(F.col("content"))).drop("content")


PAGE_KINDS = ("application/xhtml+xml", "text/html")


def _pages(content: bytes) -> Iterator[str]:
    """Names of a book's pages: in the order of its manifest, or by name where it has none that can be read."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        try:
            box = ElementTree.fromstring(z.read("META-INF/container.xml"))
            package = next(x.get("full-path") for x in box.iter() if x.tag.endswith("rootfile"))
            items = [x for x in ElementTree.fromstring(z.read(package)).iter() if x.tag.endswith("}item") or x.tag == "item"]
            hrefs = [unquote(x.get("href")) for x in items if x.get("media-type") in PAGE_KINDS]
            found = [posixpath.normpath(posixpath.join(posixpath.dirname(package), h)) for h in hrefs]
        except (KeyError, StopIteration, ElementTree.ParseError, TypeError, zipfile.BadZipFile, zlib.error):
            found = []
        if not found:
            found = sorted(n for n in names if n.lower().endswith((".html", ".htm", ".xhtml")))
        for name in found:
            try:
                yield z.read(name).decode("utf-8", "ignore")
            except (KeyError, zipfile.BadZipFile, zlib.error, OSError, RuntimeError):
                continue


def book_items(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, idx, text): the pages of zipped books in the order of the book's manifest, or by name without one, as
    clean text. A page that cannot be read is left out; a file that is no book has no pages. With `strict` a book
    without any text raises."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                found = 0
                try:
                    for i, html in enumerate(_pages(content)):
                        rows.append((path, i, html))
                        found += bool(html.strip())
                except (zipfile.BadZipFile, ValueError):
                    pass
                if strict and not found:
                    raise ValueError(f"no text in {path}")
            yield pd.DataFrame(rows, columns=["path", "idx", "html"])

    df = binaries(spark, path).select("path", "content").mapInPandas(pages, "path string, idx int, html string")
    return df.select("path", "idx", clean_html(F.col("html")).alias("text"))


def wav_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, channels, width, rate, frames, seconds, accepted): accepted are mono files of 16 bits at usual rates. A
    file whose header cannot be read has nulls and is not accepted."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    with wave.open(io.BytesIO(content)) as w:
                        rows.append((path, w.getnchannels(), w.getsampwidth(), w.getframerate(), w.getnframes()))
                except (wave.Error, EOFError, ValueError):
                    rows.append((path, None, None, None, None))
            made = pd.DataFrame(rows, columns=["path", "channels", "width", "rate", "frames"])
            yield made.astype({c: "Int64" for c in made.columns[1:]})

    df = binaries(spark, path, pattern="*.wav").select("path", "content").mapInPandas(heads, "path string, channels int, width int, rate int, frames long")
    ok = F.coalesce((F.col("channels") == 1) & (F.col("width") == 2) & F.col("rate").isin(*RATES), F.lit(False))
    return df.withColumn("seconds", F.col("frames") / F.nullif(F.col("rate"), F.lit(0))).withColumn("accepted", ok)


def wav_samples(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(id, path, rate, samples): recordings as mono samples from -1 to 1 at one rate, of PCM with 8 to 32 bits; null
    samples where a file cannot be read. Feeds `signal.features`."""

    def decoded(content: bytes) -> np.ndarray | None:
        try:
            with wave.open(io.BytesIO(content)) as w:
                width, channels, own = w.getsampwidth(), w.getnchannels(), w.getframerate()
                raw = np.frombuffer(w.readframes(w.getnframes()), np.uint8)
        except (wave.Error, EOFError, ValueError):
            return None
        raw = raw[: len(raw) // (width * channels) * width * channels].reshape(-1, width)
        if width == 1:
            x = (raw[:, 0].astype(np.float64) - 128) / 128
        else:  # the bytes become the upper ones of 32 bits
            wide = np.zeros((len(raw), 4), np.uint8)
            wide[:, 4 - width :] = raw
            x = wide.view("<i4")[:, 0] / 2.0**31
        return resample(mono(x.reshape(-1, channels).T), own, rate)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [decoded(c) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "rate": rate, "samples": [None if x is None else x.astype(np.float32) for x in made]})

    df = binaries(spark, path, pattern="*.wav").select("path", "content").mapInPandas(run, "path string, rate int, samples array<float>")
    return df.select(stem(F.col("path")).alias("id"), "path", "rate", "samples")


def with_transcripts(recordings: DataFrame, texts: DataFrame) -> DataFrame:
    """(id, ..., text): recordings with the text of the same name; a recording without one raises when it is read."""
    joined = recordings.join(texts.select("id", "text", F.lit(True).alias("_has")), "id", "left")
    lacks = F.raise_error(F.concat(F.lit("no transcript for "), F.col("id"))).cast("string")
    return joined.withColumn("text", F.when(F.col("_has").isNull(), lacks).otherwise(F.col("text"))).drop("_has")


def uploads(spark: SparkSession, path: str, mode: str | None = None) -> DataFrame:
    """(filename, content_type, mode, content) of the files of a folder, with the usual type of each extension."""
    kinds = {x: "audio/" + x for x in AUDIO} | {x: "image/" + x for x in IMAGE}
    table = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    name = basename(F.col("path"))
    return binaries(spark, path).select(name.alias("filename"), F.coalesce(F.try_element_at(table, suffix(F.col("path"))), F.lit("application/octet-stream")).alias("content_type"), F.lit(mode).cast("string").alias("mode"), "content")


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """The paths as the file system names them in full; raises for one that does not exist."""
    jvm, out = spark.sparkContext._jvm, []
    for p in paths:
        where = jvm.org.apache.hadoop.fs.Path(p)
        system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(where):
            raise FileNotFoundError(p)
        out.append(system.makeQualified(where).toString())
    return out


def requirements(spark: SparkSession, path: str) -> DataFrame:
    """(package, line) of a list of requirements, without blank lines and comments."""
    line = strip(F.col("value"))
    name = F.lower(F.regexp_extract(line, r"^(.*?)(==|>=|<=|$)", 1))
    return spark.read.text(path).where((line != "") & ~F.startswith(line, F.lit("#"))).select(name.alias("package"), line.alias("line"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(token, token_id) of a JSON list of tokens."""
    df = spark.read.text(path, wholetext=True)
    return df.select(F.posexplode(F.from_json("value", "array<string>")).alias("token_id", "token")).select("token", F.col("token_id").cast("long"))


def knapsack(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Items (item_id from 1, w, v) and the capacity of a file: a line `n W`, then a line `w v` for each item."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.filter(F.split("value", r"\s+"), lambda x: x != "")).alias("i", "x"))
    numbers = lines.select("i", F.col("x").cast("long"))
    capacity = numbers.where("i = 1").first()["x"]
    items = numbers.where("i > 1").groupBy(F.floor(F.col("i") / 2).cast("long").alias("item_id"))
    return items.agg(F.max(F.when(F.col("i") % 2 == 0, F.col("x"))).alias("w"), F.max(F.when(F.col("i") % 2 == 1, F.col("x"))).alias("v")), capacity
