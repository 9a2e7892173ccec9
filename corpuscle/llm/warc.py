"""WARC archives as a PySpark data source.

Writing: each task writes one archive of gzip members, a member for each record, and beside it an index of where the
records begin, and reports where blocks of records begin. The commit of the write puts the reports of the tasks that
succeeded into a manifest of its own, under another name until it is whole; files of lost or repeated attempts are in
no manifest and are never read. An overwriting commit then deletes what older manifests name.

Reading: the driver plans a partition for each block of the manifests, or for each archive where there are none. A task
reads a record's headers first. Of records that pushed filters reject, and of payloads that nothing asks for, no more
is inflated than the first bytes: where the index or a length tells the next record's place, the task seeks to it.
A damaged archive gives the records before the damage, and raises only with the option `strict`.

The folder must be one that pyarrow's file systems reach from driver and executors (spark.checkpoint.dir is).

Rows: null payloads count as empty, null addresses are left out, line ends in addresses are percent-encoded. Repeated
rows make repeated records. An empty table makes archives without records. Columns not named here are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, WriterCommitMessage

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of an archive after which a new block, and so a new partition, begins.
BLOCK = 4 << 20
#: Bytes of uncompressed payload in one batch of rows.
BATCH = 16 << 20
READ = 1 << 18
#: Bytes that are inflated at once, so that a record's headers cost no more.
INFLATE = 1 << 14
#: What an archive's index is called, after the archive's name; and the manifests of whole commits.
INDEX, MANIFEST = ".index", re.compile(r"_manifest-[0-9a-f]{32}\.json")

SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("payload", T.BinaryType()),
    ]
)
#: Columns that filters are pushed down on, and the header field each comes from.
PUSHED = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "page_id": "x-page-id", "refers_to": "x-refers-to-page-id"}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def record(kind: str, page: int | None, uri: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record: the payload behind HTTP headers; a revisit keeps the headers alone."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_name(page)), ("WARC-Date", date), ("WARC-Target-URI", uri and uri.replace("\r", "%0D").replace("\n", "%0A"))]
    fields += [("X-Page-Id", page), ("X-Payload-Bytes", len(payload)), ("WARC-Payload-Digest", f"sha1:{digest(payload)}")]
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_name(refers_to)), ("X-Refers-To-Page-Id", refers_to)]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def manifests(system: fs.FileSystem, root: str) -> list[str]:
    if system.get_file_info(root).type != fs.FileType.Directory:
        return []
    return sorted(f.path for f in system.get_file_info(fs.FileSelector(root)) if MANIFEST.fullmatch(f.base_name))


def listed(system: fs.FileSystem, manifest: str) -> list[tuple[str, list[tuple[int, int]]]]:
    with system.open_input_stream(manifest) as source:
        return json.loads(source.read())


def deleted(system: fs.FileSystem, path: str) -> None:
    if system.get_file_info(path).type == fs.FileType.File:
        system.delete_file(path)


@dataclass
class Written(WriterCommitMessage):
    file: str
    blocks: list[tuple[int, int]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, date: str, overwrite: bool):
        self.path, self.date, self.overwrite = path, date, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        name, blocks, start, at, index = f"{uuid.uuid4().hex}.warc.gz", [], 0, 0, []
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for b in iterator:
                columns = {f.name: b.column(i) for i, f in enumerate(b.schema)}
                for i in range(b.num_rows):
                    kind, page, uri, payload, refers_to = (columns[c][i].as_py() for c in ("record_type", "page_id", "target_uri", "payload", "refers_to"))
                    z = zlib.compressobj(4, zlib.DEFLATED, 31)
                    data = z.compress(record(kind, page, uri, payload or b"", refers_to, self.date)) + z.flush()
                    out.write(data)
                    index.append(at)
                    at += len(data)
                    if at - start >= BLOCK:
                        blocks.append((start, at - start))
                        start = at
        if at > start:
            blocks.append((start, at - start))
        with system.open_output_stream(f"{root}/{name}{INDEX}", compression=None) as out:
            out.write(np.array(index, "<i8").tobytes())
        return Written(name, blocks)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        system.create_dir(root, recursive=True)
        old, name = manifests(system, root) if self.overwrite else [], uuid.uuid4().hex
        with system.open_output_stream(f"{root}/_new-{name}", compression=None) as out:
            out.write(json.dumps([[m.file, m.blocks] for m in messages if m is not None]).encode())
        system.move(f"{root}/_new-{name}", f"{root}/_manifest-{name}.json")
        for manifest in old:
            files = listed(system, manifest)
            system.delete_file(manifest)
            for file, _ in files:
                deleted(system, f"{root}/{file}")
                deleted(system, f"{root}/{file}{INDEX}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = file_system(self.path)
        for m in messages:
            if m is not None:
                deleted(system, f"{root}/{m.file}")
                deleted(system, f"{root}/{m.file}{INDEX}")


@dataclass
class Block(InputPartition):
    file: str
    start: int
    size: int | None
    indexed: bool


class Stretch:
    """The bytes of an archive from start to end, inflated if they are gzip members."""

    def __init__(self, source, start: int, end: int, zipped: bool):
        self._source, self._at, self._end, self._zipped = source, start, end, zipped
        self._z, self._left, self._held = zlib.decompressobj(31), b"", b""  # _left: read, but not inflated

    def _raw(self) -> bytes:
        if self._at >= self._end:
            return b""
        self._source.seek(self._at)
        data = self._source.read(min(READ, self._end - self._at))
        self._at += len(data)
        return data

    def _fill(self) -> bool:
        """Holds more bytes; whether there are any."""
        if not self._zipped:
            data = self._raw()
            self._held += data
            return bool(data)
        while True:
            if self._z.eof:
                self._left, self._z = self._z.unused_data, zlib.decompressobj(31)
            data = self._left or self._raw()
            if not data:
                return False
            made = self._z.decompress(data, INFLATE)
            self._left = self._z.unconsumed_tail
            if made:
                self._held += made
                return True

    def head(self) -> bytes | None:
        """A record's version and headers; None at the end."""
        while b"\r\n\r\n" not in (held := self._held.lstrip(b"\r\n")):
            if not self._fill():
                if held:
                    raise EOFError("an archive ends inside a record's headers")
                return None
        head, _, self._held = held.partition(b"\r\n\r\n")
        return head

    def take(self, n: int) -> bytes:
        parts = []
        while n > len(self._held):
            parts.append(self._held)
            n, self._held = n - len(self._held), b""
            if not self._fill():
                raise EOFError("an archive ends inside a record")
        parts.append(self._held[:n])
        self._held = self._held[n:]
        return b"".join(parts)

    def skip(self, n: int) -> None:
        if not self._zipped and n > len(self._held):
            self._at += n - len(self._held)
            self._held = b""
            if self._at > self._end:
                raise EOFError("an archive ends inside a record")
            return
        while n > len(self._held):
            n, self._held = n - len(self._held), b""
            if not self._fill():
                raise EOFError("an archive ends inside a record")
        self._held = self._held[n:]


def records(source, start: int, end: int, zipped: bool, places: np.ndarray | None = None) -> Iterator[tuple[dict[str, str], Callable[[], bytes]]]:
    """(headers, a function that gives the block) of each record; the function may be called before the next one.

    places: where each record begins, if an index tells; without, a zipped record that is not wanted is inflated.
    """
    for a, b in [(start, end)] if places is None else pairwise([*places.tolist(), end]):
        stretch = Stretch(source, a, b, zipped)
        while (head := stretch.head()) is not None:
            headers = parsed(head)
            left = [int(headers["content-length"])]

            def block(stretch=stretch, left=left) -> bytes:
                n, left[0] = left[0], 0
                return stretch.take(n)

            yield headers, block
            if places is not None:
                break
            stretch.skip(left[0])


def parsed(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool, verify: bool, strict: bool):
        self.path, self.payload, self.verify, self.strict = path, payload, verify, strict
        self.wanted: dict[str, set[str]] = {}
        self.present: set[str] = set()

    def pushFilters(self, filters):  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", ())
            field = PUSHED.get(column[0]) if len(column) == 1 else None
            values = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else None
            if field and values is not None:
                found = {str(v) for v in values if v is not None}
                self.wanted[field] = self.wanted[field] & found if field in self.wanted else found
            elif field and isinstance(f, IsNotNull):
                self.present.add(field)
            else:
                yield f

    def partitions(self) -> list[Block]:
        system, root = file_system(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [Block(root, 0, None, False)]
        whole = manifests(system, root)
        if whole:
            return [Block(f"{root}/{name}", start, size, True) for m in whole for name, blocks in listed(system, m) for start, size in blocks] or [Block("", 0, 0, False)]
        files = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.path.endswith((".warc", ".warc.gz"))]
        return [Block(f, 0, None, False) for f in sorted(files)] or [Block("", 0, 0, False)]

    def _kept(self, headers: dict[str, str]) -> bool:
        return all(headers.get(k) in v for k, v in self.wanted.items()) and all(k in headers for k in self.present)

    def read(self, partition: Block) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        system, _ = file_system(self.path)
        rows, size = [], 0
        with system.open_input_file(partition.file) as source:
            end = source.size() if partition.size is None else partition.start + partition.size
            found = records(source, partition.start, end, partition.file.endswith(".gz"), self._places(system, partition, end))
            while True:
                try:
                    headers, block = next(found)
                    if not self._kept(headers):
                        continue
                    rows.append(self._row(headers, block))
                except StopIteration:
                    break
                except (EOFError, zlib.error) as damage:
                    if self.strict:
                        raise ValueError(f"{partition.file}: {damage}") from damage
                    break
                size += len(rows[-1]["payload"] or b"") + 1000
                if size >= BATCH:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _places(system: fs.FileSystem, partition: Block, end: int) -> np.ndarray | None:
        if not partition.indexed:
            return None
        with system.open_input_stream(f"{partition.file}{INDEX}", compression=None) as source:
            places = np.frombuffer(source.read(), "<i8")
        return places[(places >= partition.start) & (places < end)]

    def _row(self, headers: dict[str, str], block: Callable[[], bytes]) -> dict:
        kind, told = headers.get("warc-type"), headers.get("warc-payload-digest", "").rpartition(":")[2] or None
        number = lambda x: int(x) if x is not None else None
        size, own, payload, again = number(headers.get("x-payload-bytes")), None, None, kind == "revisit"
        if size is None or not again and (self.payload or self.verify or not told):
            payload, http = block(), {}
            if headers.get("content-type", "").startswith("application/http"):
                head, _, payload = payload.partition(b"\r\n\r\n")
                http = parsed(head)
            if not again and (self.verify or not told):
                own = digest(payload)
                if told and self.verify and own != told:
                    raise ValueError(f"{headers.get('warc-record-id')}: the payload's digest is {own}, its header says {told}")
            size = number(http.get("content-length")) if again else len(payload)
        return {
            "record_id": headers.get("warc-record-id"),
            "record_type": kind,
            "target_uri": headers.get("warc-target-uri"),
            "page_id": number(headers.get("x-page-id")),
            "refers_to": number(headers.get("x-refers-to-page-id")),
            "payload_digest": own or told,
            "payload_bytes": size,
            "headers": list(headers.items()),
            "payload": payload if self.payload and not again else None,
        }

    @staticmethod
    def _batch(rows: list[dict]) -> pa.RecordBatch:
        s = pa.string()
        kinds = {"headers": pa.map_(s, s), "payload": pa.binary(), "page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64()}
        names = [f.name for f in SCHEMA.fields]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], kinds.get(n, s)) for n in names], schema=pa.schema([(n, kinds.get(n, s)) for n in names]))


class WarcDataSource(DataSource):
    """Format `warc`. Options: path; payload (true): whether payloads are returned; verify (false): whether digests
    are recomputed and compared; strict (false): whether a damaged archive raises; date: the records' date when writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def _flag(self, name: str, default: str) -> bool:
        return self.options.get(name, default).lower() == "true"

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(self.options["path"], self._flag("payload", "true"), self._flag("verify", "false"), self._flag("strict", "false"))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def deduplicated(df: DataFrame, key: str, uri: str, payload: str, least: int = 0) -> DataFrame:
    """Rows for writing: of equal payloads of at least `least` bytes, those with the smallest key are responses and
    the others revisit them. Only hashes are grouped; rows with a null key revisit, if their payload has a key."""
    rows = df.select(F.col(key).cast("long").alias("page_id"), F.col(uri).alias("target_uri"), F.coalesce(payload, F.lit(b"")).alias("payload"))
    rows = rows.withColumn("_sha", F.when(F.length("payload") >= least, F.sha2("payload", 256)))
    firsts = rows.groupBy(F.col("_sha").alias("_of")).agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(firsts, F.col("_sha") == F.col("_of"), "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "page_id", "target_uri", F.when(again, F.col("_first")).alias("refers_to"), "payload"
    )
