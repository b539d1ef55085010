"""WARC archives as a Spark data source written in Python, with pushed-down record types and headers, and skipped payloads.

Each record is its own gzip member, whose header has the 'sl' extra field of the WARC standard: the
member's compressed and plain lengths. A reader inflates a record's header lines only, and steps over the rest of the member
unless the record is wanted.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, record_date string, payload_digest string, payload_length long, refers_to string, headers map<string,string>, payload binary"
#: Column -> header; these can be pushed down.
HEADERS = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "record_date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To"}
#: Extension header: plain bytes of the full payload, for revisits too.
LENGTH = "X-Payload-Length"
#: Bytes of archive to a file when writing, and to a task when reading.
FILE_BYTES = 64 << 20
TASK_BYTES = 16 << 20
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Bytes of a member's beginning that are read to find its header lines.
HEAD = 4096
_MEMBER = struct.Struct("<4sIBBHHHII")  # gzip header with XLEN, and the subfield 'sl' (two bytes as a number, length 8, two lengths)
_SL = 0x6C73


def pack_record(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """One record as a gzip member with skip lengths."""
    plain = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(payload)}\r\n\r\n").encode() + payload + b"\r\n\r\n"
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(plain) + deflate.flush()
    size = _MEMBER.size + len(body) + 8
    return _MEMBER.pack(b"\x1f\x8b\x08\x04", 0, 0, 255, 12, _SL, 8, size, len(plain) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(plain), len(plain) & 0xFFFFFFFF)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class WarcSource(DataSource):
    """format("warc"): option path; for reading also payload ('false' never inflates one)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options, overwrite)


class Files(InputPartition):
    def __init__(self, files: list[str]):
        self.files = files


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.payload = options["path"], options.get("payload", "true") != "false"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        """Equality and IN on columns that are headers are ours; Spark keeps the rest."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                header = HEADERS[f.attribute[0]]
                self.wanted[header] = self.wanted[header] & values if header in self.wanted else values
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        store, root = _filesystem(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        tasks, size = [[]], 0
        for f in sorted((f for f in found if f.is_file and f.path.endswith((".warc", ".warc.gz")) and "/_" not in f.path.removeprefix(root)), key=lambda f: f.path):
            if tasks[-1] and size + f.size > TASK_BYTES:
                tasks.append([])
                size = 0
            tasks[-1].append(f.path)
            size += f.size
        return [Files(t) for t in tasks if t] or [Files([])]

    def read(self, partition):
        store, _ = _filesystem(self.path)
        for path in partition.files:
            with store.open_input_file(path) as file:
                yield from self._records(file, path.endswith(".gz"))

    def _records(self, file, zipped: bool):
        at, end = 0, file.size()
        while at < end:
            step, headers, payload = (_member if zipped else _plain)(file, at, end)
            if headers is not None and all(headers.get(h) in v for h, v in self.wanted.items()):
                yield self._row(headers, payload() if self.payload else None)
            at += step

    @staticmethod
    def _row(headers, payload):
        length = headers.get(LENGTH)
        return (*(headers.get(HEADERS[c]) for c in ("record_id", "record_type", "target_uri", "record_date", "payload_digest")), int(length) if length else None, headers.get("WARC-Refers-To"), headers, payload)


def _lines(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return dict(x.split(": ", 1) for x in lines[1:] if ": " in x)


def _member(file, at: int, end: int):
    """(bytes to the next member, headers, payload on demand) of the member at a place."""
    start = file.read_at(min(HEAD, end - at), at)
    if start[:2] != b"\x1f\x8b":
        raise ValueError(f"no gzip member at byte {at}")
    size = None
    if start[3] & 4 and len(start) >= _MEMBER.size:
        fields = _MEMBER.unpack_from(start)
        size = fields[7] if fields[5] == _SL else None
    if size is None:  # written without skip lengths: the member must be inflated to find its end
        inflate, plain, read = zlib.decompressobj(31), b"", at
        while not inflate.eof:
            piece = file.read_at(min(1 << 20, end - read), read)
            if not piece:
                raise ValueError(f"the member at byte {at} is cut off")
            plain += inflate.decompress(piece)
            read += len(piece)
        size = read - at - len(inflate.unused_data)
        head, _, body = plain.partition(b"\r\n\r\n")
        headers = _lines(head)
        return size, headers, lambda: body[: int(headers["Content-Length"])]
    inflate, head, read = zlib.decompressobj(31), b"", 0
    while b"\r\n\r\n" not in head:
        piece = start if not read else file.read_at(min(HEAD, size - read), at + read)
        if not piece:
            raise ValueError(f"the record at byte {at} has no end of headers")
        head += inflate.decompress(piece[: size - read], HEAD)
        read += len(piece)
        while b"\r\n\r\n" not in head and inflate.unconsumed_tail:
            head += inflate.decompress(inflate.unconsumed_tail, HEAD)
    headers = _lines(head.partition(b"\r\n\r\n")[0])

    def payload() -> bytes:
        plain = zlib.decompressobj(31).decompress(file.read_at(size, at))
        begin = plain.index(b"\r\n\r\n") + 4
        return plain[begin : begin + int(headers["Content-Length"])]

    return size, headers, payload


def _plain(file, at: int, end: int):
    head, step = b"", HEAD
    while b"\r\n\r\n" not in head:
        if len(head) >= end - at:
            raise ValueError(f"the record at byte {at} has no end of headers")
        head = file.read_at(min(step, end - at), at)
        step *= 2
    lines = head.partition(b"\r\n\r\n")[0]
    headers, begin = _lines(lines), at + len(lines) + 4
    length = int(headers["Content-Length"])
    return len(lines) + 4 + length + 4, headers, lambda: file.read_at(length, begin)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceArrowWriter):
    """Rows of SCHEMA as records. A task writes under _temporary; only the files of committed tasks are moved into place."""

    def __init__(self, options, overwrite: bool):
        self.path, self.job, self.overwrite = options["path"], uuid.uuid4().hex, overwrite

    def _at(self, *parts: str):
        store, root = _filesystem(self.path)
        return store, posixpath.join(root, *parts)

    def write(self, iterator):
        from pyspark import TaskContext

        task = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}"
        store, folder = self._at("_temporary", self.job)
        store.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size >= FILE_BYTES:
                    if out:
                        out.close()
                    files.append(f"{task}-{len(files):03d}.warc.gz")
                    out, size = store.open_output_stream(posixpath.join(folder, files[-1]), compression=None), 0
                size += out.write(pack_record(_headers(row), row["payload"] or b"")) or 0
        if out:
            out.close()
        return Written(files)

    def commit(self, messages):
        store, root = self._at()
        store.create_dir(root, recursive=True)
        for m in messages:
            for f in m.files if m else []:
                store.move(posixpath.join(root, "_temporary", self.job, f), posixpath.join(root, f))
        self.abort(messages)

    def abort(self, messages):
        from pyarrow import fs

        store, folder = self._at("_temporary", self.job)
        if store.get_file_info(folder).type != fs.FileType.NotFound:
            store.delete_dir(folder)


def _headers(row: dict) -> list[tuple[str, str]]:
    """Known columns first, then what the map of headers has besides; line breaks in values become blanks."""
    known = [(HEADERS[c], row[c]) for c in HEADERS if row.get(c) is not None]
    if row.get("payload_length") is not None:
        known.append((LENGTH, str(row["payload_length"])))
    taken = {k for k, _ in known} | {"Content-Length"}
    known += [(k, v) for k, v in (row.get("headers") or []) if k not in taken and v is not None]
    return [(k, " ".join(v.split("\r\n")).replace("\n", " ").replace("\r", " ")) for k, v in known]


def as_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Pages as rows of SCHEMA. Of those with equal payloads of least_bytes or more, the one with the smallest id is a response; the others revisit it, without payload.

    A null html is an empty payload, a null url has no header. Rows that repeat an id: all but one of equal
    payloads revisit it only if their id differs; the same id stays a response. Null ids count as larger than all others and stay responses.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("_id"), F.col(url).alias("target_uri"), body.alias("payload"))
    rows = rows.withColumns({"payload_length": F.length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    ids = pages.select(F.col(page_id).alias("_first"), F.length(body).alias("_n"), F.sha2(body, 256).alias("payload_digest"))
    firsts = ids.where(F.col("_n") >= least_bytes).groupBy("payload_digest").agg(F.min("_first").alias("_first"), F.count("*").alias("_copies")).where("_copies > 1").drop("_copies")
    joined = rows.join(firsts, "payload_digest", "left")
    again = F.col("_first").isNotNull() & (F.col("_first") < F.col("_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return joined.select(
        name(F.col("_id")).alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), "target_uri", F.lit("1970-01-01T00:00:00Z").alias("record_date"),
        F.concat(F.lit("sha256:"), "payload_digest").alias("payload_digest"), "payload_length", F.when(again, name(F.col("_first"))).alias("refers_to"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html; charset=utf-8")).alias("headers"), F.when(~again, F.col("payload")).alias("payload"),
    )


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write(records: DataFrame, path: str) -> None:
    """Write rows of SCHEMA as archives; an executor's lost attempt leaves nothing behind."""
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


#: DuckDB, from the pages themselves.
ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
  CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
