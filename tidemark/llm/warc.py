"""WARC archives as a Python data source, and an archive of pages whose repeated payloads are revisits.

``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").mode("append").save(folder)`` after ``register``.

Columns name headers: ``record_type`` is WARC-Type, ``target_uri`` WARC-Target-URI, ``content_type`` Content-Type and so on
(underscores for hyphens, case ignored, with or without the prefix ``WARC-``); ``http_status`` and ``http_<name>`` belong to the
HTTP head at the start of the block; ``payload`` is what follows that head (the whole block, if there is none);
``headers`` is a map of all WARC headers, named in lower case. Any of them may be asked for by ``schema``; a column that a
record lacks is null, and so is a number that can't be read.

Reading: a partition is a stretch of whole records of a file, from the split points that the writer noted; other archives
(``*.warc``, ``*.warc.gz``) are a partition a file. Predicates on WARC headers are pushed down: a record's WARC headers are
parsed first, and where they fail, the block is jumped over. In compressed archives (one gzip member a record) the
writer notes each member's length in the member's own header (extra field ``sl``), so unwanted payloads are not even
inflated beyond the first bytes; members of other writers are inflated and thrown away. The HTTP head is parsed only if asked for,
and the payload only taken if it is in the schema.

Writing: an attempt of a task writes a file under a name of its own; the commit writes one manifest with the files of the
attempts that count. Files without a manifest entry, left by lost executors, are never read.

Files are reached by pyarrow's file systems (local or mounted folders, and the stores it knows by their scheme).
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, MapType, StringType, StructType

from tidemark.llm.common import ensure_columns, slices
from tidemark.llm.storing import small_or_shuffled, stored
from tidemark.runtime import with_imports

SPLIT_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
BATCH_ROWS = 4096
BUFFER = 1 << 18
LEVEL = 1
SCHEMA = ("record_type string, record_id string, record_date string, target_uri string, content_type string, content_length bigint, "
          "payload_digest string, refers_to string, http_status int, http_content_type string, http_content_length bigint, payload binary")
#: Fixed values of the format.
_VERSION = b"WARC/1.1"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PLAIN_HEADERS = {"content_type", "content_length", "content_encoding"}
_GZIP_HEAD = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H2sH", 12, b"sl", 8)
_GZIP_FIXED = len(_GZIP_HEAD) + 8


def _store(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def header_of(column: str) -> str:
    """The WARC header that a column names, in lower case."""
    name = {"record_type": "warc-type", "record_date": "warc-date"}.get(column.lower())
    plain = column.lower().replace("_", "-")
    return name or (plain if column.lower() in _PLAIN_HEADERS or plain.startswith("warc-") else f"warc-{plain}")


# reading


class _Plain:
    """The bytes of an uncompressed record at the file's position."""

    def __init__(self, file: io.BufferedReader) -> None:
        self.file, self.start, self.taken = file, file.tell(), 0

    def more(self, n: int) -> bytes:
        found = self.file.read(n)
        self.taken += len(found)
        return found

    def finish(self) -> None:
        pass

    def leave(self, length: int) -> None:
        self.file.seek(self.start + length)


class _Member:
    """The bytes of one gzip member; ``leave`` jumps to the next one, by the noted length if there is one."""

    def __init__(self, file: io.BufferedReader) -> None:
        self.file, self.start, self.taken = file, file.tell(), 0
        head = file.read(_GZIP_FIXED)
        self.length = struct.unpack_from("<I", head, len(_GZIP_HEAD))[0] if head.startswith(_GZIP_HEAD) and len(head) == _GZIP_FIXED else None
        file.seek(self.start)
        self.inflate = zlib.decompressobj(wbits=31)
        self.rest = b""

    def more(self, n: int) -> bytes:
        found = b""
        while len(found) < n and not self.inflate.eof:
            feed = self.inflate.unconsumed_tail or self.file.read(min(max(n, 1024), BUFFER))
            if not feed:
                raise ValueError(f"truncated gzip member at byte {self.start}")
            found += self.inflate.decompress(feed, n - len(found))
        self.taken += len(found)
        return found

    def finish(self) -> None:
        """Reads on to the end, where the checksum is."""
        while not self.inflate.eof:
            self.more(BUFFER)

    def leave(self, length: int) -> None:
        if self.length:
            self.file.seek(self.start + self.length)
            return
        self.finish()
        self.file.seek(self.file.tell() - len(self.inflate.unused_data))


def _head(source: _Plain | _Member, held: bytes) -> tuple[bytes, bytes]:
    """The lines up to the first empty one, and what was read beyond."""
    while (end := held.find(b"\r\n\r\n")) < 0:
        more = source.more(1024)
        if not more:
            return held, b""
        held += more
    return held[:end], held[end + 4:]


def _fields(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    last = None
    for line in lines:
        if line[:1] in b" \t" and line and last:
            found[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if colon:
            last = name.strip().lower().decode("utf-8", "replace")
            found.setdefault(last, value.strip().decode("utf-8", "replace"))
    return found


def _number(text: str | None) -> int | None:
    digits = (text or "").strip()
    return int(digits) if digits.lstrip("-").isdecimal() and digits.isascii() and len(digits) < 19 else None


_COMPARE = {
    ds.EqualTo: lambda a, b: a == b, ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b, ds.In: lambda a, b: a in b, ds.StringStartsWith: lambda a, b: a.startswith(b),
    ds.StringEndsWith: lambda a, b: a.endswith(b), ds.StringContains: lambda a, b: b in a,
}


class WarcReader(ds.DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema, self.tests = path, schema, []
        self.numbers = {f.name for f in schema.fields if isinstance(f.dataType, IntegralType)}

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:  # noqa: N802
        for f in filters:
            if self._known(f):
                self.tests.append(f)
            else:
                yield f

    def _known(self, f: ds.Filter) -> bool:
        if isinstance(f, ds.Not):
            return self._known(f.child)
        kinds = (*_COMPARE, ds.IsNull, ds.IsNotNull)
        own = isinstance(f, kinds) and len(f.attribute) == 1 and f.attribute[0] in self.schema.names
        if not own or f.attribute[0] in ("payload", "headers") or f.attribute[0].startswith("http_"):
            return False
        value = getattr(f, "value", None)
        values = value if isinstance(f, ds.In) else [value]
        kind = int if f.attribute[0] in self.numbers else str
        if kind is str and isinstance(f, (ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)):
            return False  # Spark compares UTF-8 bytes
        return isinstance(f, (ds.IsNull, ds.IsNotNull)) or all(isinstance(v, kind) for v in values)

    def _value(self, fields: dict[str, str], column: str) -> str | int | None:
        text = fields.get(header_of(column))
        return _number(text) if column in self.numbers else text

    def _holds(self, f: ds.Filter, fields: dict[str, str]) -> bool | None:
        """As SQL: a comparison with null is null, and so is its negation."""
        if isinstance(f, ds.Not):
            held = self._holds(f.child, fields)
            return None if held is None else not held
        value = self._value(fields, f.attribute[0])
        if isinstance(f, (ds.IsNull, ds.IsNotNull)):
            return (value is None) == isinstance(f, ds.IsNull)
        return None if value is None else _COMPARE[type(f)](value, f.value)

    def partitions(self) -> list[ds.InputPartition]:
        store, root = _store(self.path)
        found = store.get_file_info(pyarrow.fs.FileSelector(root)) if store.get_file_info(root).type == pyarrow.fs.FileType.Directory else [store.get_file_info(root)]
        manifests = [x.path for x in found if x.base_name.startswith("_manifest-")]
        if manifests:
            files = []
            for m in manifests:
                with store.open_input_stream(m) as text:
                    files += [(f"{root}/{f['name']}", [*f["splits"], f["bytes"]]) for f in json.loads(text.read())]
        else:
            files = [(x.path, [0, x.size]) for x in found if x.type == pyarrow.fs.FileType.File and x.base_name.endswith((".warc", ".warc.gz"))]
        parts = [ds.InputPartition((name, a, b)) for name, splits in sorted(files) for a, b in zip(splits, splits[1:]) if b > a]
        return parts or [ds.InputPartition(None)]

    def read(self, partition: ds.InputPartition) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if partition.value is None:
            return
        name, begin, end = partition.value
        store, _ = _store(self.path)
        rows: list[list] = []
        held = 0
        with io.BufferedReader(store.open_input_file(name), BUFFER) as file:
            file.seek(begin)
            while file.tell() < end:
                row, size = self._record(file, name)
                if row is not None:
                    rows.append(row)
                    held += size
                if held >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                    yield self._batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows, schema)

    @staticmethod
    def _batch(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def _record(self, file: io.BufferedReader, name: str) -> tuple[list | None, int]:
        start = file.tell()
        packed = file.read(2) == b"\x1f\x8b"
        file.seek(start)
        source = _Member(file) if packed else _Plain(file)
        head, held = _head(source, b"")
        lines = head.split(b"\r\n")
        fields = _fields(lines[1:])
        length = _number(fields.get("content-length"))
        if not lines[0].lstrip().startswith(b"WARC/") or length is None or length < 0:
            raise ValueError(f"no WARC record at byte {start} of {name}")
        whole = len(head) + 4 + length + 4
        row, size = None, 0
        if all(self._holds(t, fields) for t in self.tests):
            row, size = self._row(source, fields, held, length)
        source.leave(whole)
        return row, size

    def _row(self, source: _Plain | _Member, fields: dict[str, str], held: bytes, length: int) -> tuple[list, int]:
        names = [n.lower() for n in self.schema.names]
        http: dict[str, str] = {}
        payload, status = None, None
        if "payload" in names or any(n.startswith("http_") for n in names):
            begun = held[:length]
            has_http = fields.get("content-type", "").lower().replace(" ", "").startswith("application/http")
            if has_http:
                first, rest = _head(_Bounded(source, length - len(begun)), begun)
                lines = first.split(b"\r\n")
                http = _fields(lines[1:])
                words = lines[0].split()
                status = _number(words[1].decode("ascii", "replace")) if len(words) > 1 else None
                left = length - len(first) - 4
                begun = rest
            else:
                left = length
            if "payload" in names:
                parts, have = [begun], len(begun)
                while have < left:
                    more = source.more(min(left - have, BATCH_BYTES))
                    if not more:
                        raise ValueError(f"truncated record {fields.get('warc-record-id')}")
                    parts.append(more)
                    have += len(more)
                payload = b"".join(parts)[: max(0, left)]
                source.finish()
        row: list = []
        for f in self.schema.fields:
            n = f.name.lower()
            if n == "payload":
                row.append(payload)
            elif n == "headers":
                row.append(list(fields.items()))
            elif n == "http_status":
                row.append(status)
            elif n.startswith("http_"):
                text = http.get(n[5:].replace("_", "-"))
                row.append(_number(text) if f.name in self.numbers else text)
            else:
                row.append(self._value(fields, f.name))
        return row, len(payload or b"") + 512


class _Bounded:
    """A source that ends where the record's block ends."""

    def __init__(self, source: _Plain | _Member, left: int) -> None:
        self.source, self.left = source, left

    def more(self, n: int) -> bytes:
        found = self.source.more(min(n, self.left)) if self.left > 0 else b""
        self.left -= len(found)
        return found


# writing


@dataclass
class Written(ds.WriterCommitMessage):
    name: str
    bytes: int
    splits: list[int]


def _line(name: str, value: object) -> bytes:
    """A header line; control characters in values (line ends above all) are percent-coded."""
    text = "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))
    return f"{name}: {text}\r\n".encode()


def _cased(header: str) -> str:
    words = ["WARC" if w == "warc" else "ID" if w == "id" else "URI" if w == "uri" else w.capitalize() for w in header.split("-")]
    return "-".join(words)


def record_bytes(row: dict[str, object], payload: bytes) -> bytes:
    """One record: WARC headers, an HTTP head if ``http_status`` is given, the payload."""
    block = payload
    if row.get("http_status") is not None:
        http = b"".join(_line(_cased(n[5:].replace("_", "-")), v) for n, v in row.items() if n.startswith("http_") and n != "http_status" and v is not None)
        block = f"HTTP/1.1 {row['http_status']} OK\r\n".encode() + http + b"\r\n" + payload
    own = b"".join(_line(_cased(header_of(n)), v) for n, v in row.items() if not n.startswith("http_") and n != "content_length" and v is not None)
    return b"".join([_VERSION, b"\r\n", own, _line("Content-Length", len(block)), b"\r\n", block, b"\r\n\r\n"])


def _gzipped(record: bytes, level: int) -> bytes:
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    length = _GZIP_FIXED + len(body) + 8
    if length >= 1 << 32:
        length = 0  # unknown: the reader inflates the member
    return _GZIP_HEAD + struct.pack("<II", length, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool, options: dict[str, str]) -> None:
        self.path, self.overwrite = path, overwrite
        self.packed = options.get("compression", "gzip") == "gzip"
        self.level = int(options.get("level", LEVEL))
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.names = schema.names
        if not {"record_id", "record_type", "record_date"} <= set(self.names):
            raise ValueError("a WARC record needs record_id, record_type and record_date")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}"
        at, splits = 0, [0]
        with store.open_output_stream(f"{root}/{name}", compression=None, buffer_size=BUFFER) as out:
            for part, payloads in slices(_payloads(iterator), "payload"):
                others = part.drop_columns(["payload"]).to_pylist()
                for row, payload in zip(others, payloads):
                    if at - splits[-1] >= self.split:
                        splits.append(at)
                    record = record_bytes(row, payload)
                    record = _gzipped(record, self.level) if self.packed else record
                    out.write(record)
                    at += len(record)
        return Written(name, at, splits)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        old = [x for x in store.get_file_info(pyarrow.fs.FileSelector(root)) if x.type == pyarrow.fs.FileType.File] if self.overwrite else []
        kept = {m.name for m in messages if m}
        with store.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([{"name": m.name, "bytes": m.bytes, "splits": m.splits} for m in messages if m and m.bytes]).encode())
        for x in old:
            if x.base_name not in kept:
                store.delete_file(x.path)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _store(self.path)
        for m in messages:
            if m and store.get_file_info(f"{root}/{m.name}").type == pyarrow.fs.FileType.File:
                store.delete_file(f"{root}/{m.name}")


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if "payload" not in batch.schema.names:
            batch = batch.append_column("payload", pa.nulls(batch.num_rows, pa.binary()))
        yield batch


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        for f in schema.fields:
            kind = BinaryType if f.name == "payload" else MapType if f.name == "headers" else (StringType, IntegralType)
            if not isinstance(f.dataType, kind):
                raise ValueError(f"column {f.name} can't be {f.dataType.simpleString()}")
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], schema, overwrite, {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> SparkSession:
    """Makes the format ``warc`` known to the session and lets Spark push predicates down to it."""
    with_imports(spark.range(0))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark


# an archive of pages

LEAST_REVISITED = 100
BROADCAST_REPEATS = 50_000
CAPTURED = "2000-01-01T00:00:00Z"


def _record_id(page: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.substring(digest, 1, 32), F.lit(">"))


def page_records(pages: DataFrame, *, least: int = LEAST_REVISITED, captured: str = CAPTURED) -> DataFrame:
    """One WARC record per page: of equal payloads of ``least`` bytes or more the one with the smallest page_id is the response.

    The digests find their group by (digest, salt), the salt being drawn from page_id, so a payload that a third of all
    pages share is dealt over all tasks; payloads are exchanged only if the repeats are too many to be broadcast.
    """
    salts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html")).select(
        "page_id", "url", F.encode("html", "utf-8").alias("payload"), F.sha2("html", 256).alias("digest"),
        F.octet_length("html").cast("long").alias("bytes"), F.pmod(F.xxhash64("page_id"), F.lit(salts)).alias("salt"))
    entries = rows.where(F.col("bytes") >= least).groupBy("digest", "salt").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = entries.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    repeats = stored(entries.select("digest", "salt").join(groups, "digest"), "repeats")
    marked = rows.join(small_or_shuffled(repeats, BROADCAST_REPEATS), ["digest", "salt"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return marked.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), _record_id(F.col("page_id"), F.col("digest")).alias("record_id"),
        F.lit(captured).alias("record_date"), F.col("url").alias("target_uri"), F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.when(revisit, _record_id(F.col("first"), F.col("digest"))).alias("refers_to"), F.when(revisit, _REVISIT).alias("profile"),
        F.lit("application/http;msgtype=response").alias("content_type"), F.lit(200).alias("http_status"),
        F.lit("text/html; charset=utf-8").alias("http_content_type"), F.col("bytes").alias("http_content_length"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_pages(pages: DataFrame, path: str, *, least: int = LEAST_REVISITED, captured: str = CAPTURED) -> None:
    """Writes the archives of ``page_records`` below ``path``.

    Null html counts as empty, null url has no header. Null page_ids are never the smallest of a group unless all are
    null; then all are responses, and so are rows that repeat the smallest page_id. Payloads of any size are kept
    whole (one at a time is held as bytes). An empty table gives an archive without records. Other columns are ignored.
    """
    ensure_columns(pages, "page_id", "url", "html")
    register(pages.sparkSession)
    page_records(pages, least=least, captured=captured).write.format("warc").mode("append").save(path)


def _page(column: str) -> Column:
    return F.regexp_extract(column, r"^<urn:x-page:(-?[0-9]+):", 1).try_cast("long")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``.

    Responses are measured by their payload. Revisits have none: their payload's length and digest stand in their
    headers, and payloads are not touched while they are read.
    """
    source = register(spark).read.format("warc")
    responses = source.schema("record_type string, record_id string, payload binary").load(path).where("record_type = 'response'").select(
        _page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"),
        "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = source.schema("record_type string, record_id string, payload_digest string, refers_to string, http_content_length bigint").load(path).where(
        "record_type = 'revisit'").select(
        _page("record_id").alias("page_id"), F.col("http_content_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"),
        "record_type", _page("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)
