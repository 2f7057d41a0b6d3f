"""WARC archives as a Python data source, and de-duplicated archives of pages.

Reading plans a partition for each group of files, takes predicates on record type and header columns, parses a
record's headers first, and goes past the block of a record that no predicate wants: by its length in a plain file,
by the member length that the writer leaves in each gzip member, or, in gzip files of other writers, by inflating
without decoding. Writing makes a gzip member for each record and publishes files only when the job commits.

Defined cases: a null payload is an empty one; a null URL or page id has no header and reads back as null; equal
payloads below the size limit are never revisits; rows with the same page id and payload are the same record; an empty
table makes an archive without files, which reads as no rows.
"""

from __future__ import annotations

import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from tessella.llm.shared import new_path, stash

SCHEMA = "record_type string, record_id string, target_uri string, page_id bigint, payload_digest string, refers_to string, payload binary"
#: Header of each column but the payload.
HEADERS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "page_id": "x-page-id",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES = 8 << 20


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else pafs.FileSystem.from_uri("file://" + path.removeprefix("file:"))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def make_record(headers: dict[str, str | None], block: bytes) -> bytes:
    """One gzip member; its extra field "sl" has the lengths of the member and of the record."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers.items() if v is not None), f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    deflate = zlib.compressobj(3, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    length = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, length & 0xFFFFFFFF, len(raw) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _parse(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if colon:
            out[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    return out


class _Source:
    """A file that is read forwards; plain or gzip, record by record."""

    def __init__(self, file):
        self.file = file
        self.kept = b""

    def peek(self, n: int) -> bytes:
        while len(self.kept) < n and (more := self.file.read(max(n - len(self.kept), 1 << 18))):
            self.kept += more
        return self.kept[:n]

    def skip(self, n: int) -> None:
        if n <= len(self.kept):
            self.kept = self.kept[n:]
        else:
            self.file.seek(n - len(self.kept), 1)
            self.kept = b""

    def records(self, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
        """Headers and block of each record whose headers are wanted."""
        while start := self.peek(24):
            if start[:2] == b"\x1f\x8b":
                yield from self._member(start, wanted)
            elif start[:5] == b"WARC/":
                n = 1 << 12
                while (at := self.peek(n).find(b"\r\n\r\n")) < 0:
                    if len(self.kept) < n:
                        raise ValueError("a record's headers don't end")
                    n *= 2
                headers = _parse(self.kept[:at])
                size = int(headers.get("content-length", 0))
                self.skip(at + 4)
                if wanted(headers):
                    yield headers, self.peek(size)
                self.skip(size + 4)
            elif start[:2] == b"\r\n":
                self.skip(2)
            else:
                raise ValueError(f"no record starts with {start[:8]!r}")

    def _member(self, start: bytes, wanted) -> Iterator[tuple[dict[str, str], bytes]]:
        length = 0
        if len(start) == 24 and start[3] & 4 and start[12:14] == b"sl":
            length = struct.unpack("<I", start[16:20])[0]
        inflate = zlib.decompressobj(31)
        raw, used = b"", 0

        def more(limit: int) -> bool:
            """Inflate up to limit further bytes; False at the member's end."""
            nonlocal raw, used
            if inflate.eof:
                return False
            if not (chunk := inflate.unconsumed_tail):
                if used >= len(self.kept) and not self.peek(used + 1)[used:]:
                    raise ValueError("the last gzip member is cut off")
                chunk = self.kept[used : used + (1 << 16)]
                used += len(chunk)
            raw += inflate.decompress(chunk, limit)
            return True

        while b"\r\n\r\n" not in raw and more(2048):
            pass
        head, _, block = raw.partition(b"\r\n\r\n")
        headers = _parse(head)
        if wanted(headers):
            while more(1 << 20):
                pass
            block = raw[len(head) + 4 :]
            yield headers, block[: int(headers.get("content-length", len(block)))]
        elif length:
            self.skip(length)
            return
        else:
            while more(1 << 20):
                raw = b""
        self.skip(used - len(inflate.unused_data))


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.target = int(options.get("partitionbytes", 64 << 20))
        self.payload = str(options.get("payload", "true")).lower() == "true"
        self.tests: list[tuple[str, list]] = []

    def pushFilters(self, filters):
        for f in filters:
            name = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name in HEADERS:
                self.tests.append((name, [f.value] if isinstance(f, EqualTo) else list(f.value)))
            else:
                yield f

    def partitions(self):
        system, root = _filesystem(self.path)
        found = system.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)) if system.get_file_info(root).type != pafs.FileType.File else [system.get_file_info(root)]
        found = [x for x in found if x.is_file and x.path.endswith((".warc", ".warc.gz")) and not x.base_name.startswith((".", "_"))]
        out, size = [_Files([])], 0
        for x in sorted(found, key=lambda x: x.path):
            if out[-1].paths and size + x.size > self.target:
                out.append(_Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out

    def read(self, partition):
        names = [*HEADERS, "payload"]
        kinds = [pa.string()] * 3 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()]

        def value(headers: dict[str, str], name: str):
            x = headers.get(HEADERS[name])
            if x is None:
                return None
            return int(x) if name == "page_id" else x.removeprefix("sha1:") if name == "payload_digest" else x

        def wanted(headers: dict[str, str]) -> bool:
            return all(value(headers, name) in values for name, values in self.tests)

        system, _ = _filesystem(self.path)
        rows, size = [], 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                for headers, block in _Source(file).records(wanted):
                    payload = None
                    if self.payload:
                        http = headers.get("content-type", "").startswith("application/http")
                        payload = block.partition(b"\r\n\r\n")[2] if http else block
                        size += len(payload)
                    rows.append([*(value(headers, n) for n in HEADERS), payload])
                    if size >= BATCH_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


@dataclass
class _Written(WriterCommitMessage):
    paths: list[str]


class _Writer(DataSourceArrowWriter):
    """Rows (record_type, target_uri, page_id, payload_digest, refers_to, payload) as gzip records. Tasks write hidden
    files of their own; those of the tasks that count get their names at commit."""

    def __init__(self, options):
        self.path = options["path"]
        self.most = int(options.get("filebytes", 256 << 20))
        self.date = options.get("date", "1970-01-01T00:00:00Z")

    def record(self, kind, uri, page_id, digest, refers_to, payload) -> bytes:
        revisit = kind == "revisit"
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload or b'')}\r\n\r\n".encode()
        headers = {
            "WARC-Type": kind,
            "WARC-Record-ID": record_id(page_id, digest),
            "WARC-Date": self.date,
            "WARC-Target-URI": None if uri is None else urllib.parse.quote(uri, safe="".join(map(chr, range(33, 127)))),
            "X-Page-Id": None if page_id is None else str(page_id),
            "WARC-Payload-Digest": f"sha1:{digest}",
            "WARC-Profile": PROFILE if revisit else None,
            "WARC-Refers-To": refers_to if revisit else None,
            "Content-Type": "application/http; msgtype=response",
        }
        return make_record(headers, http if revisit else http + (payload or b""))

    def write(self, iterator):
        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        paths, out = [], None
        for batch in iterator:
            for row in zip(*(batch.column(n).to_pylist() for n in ("record_type", "target_uri", "page_id", "payload_digest", "refers_to", "payload"))):
                if out is None:
                    paths.append(f"{root}/.part-{uuid.uuid4().hex}.warc.gz")
                    out = system.open_output_stream(paths[-1], compression=None)
                out.write(self.record(*row))
                if out.tell() >= self.most:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(paths)

    def commit(self, messages):
        system, _ = _filesystem(self.path)
        for m in messages:
            for p in m.paths if m else []:
                folder, _, name = p.rpartition("/")
                system.move(p, f"{folder}/{name[1:]}")

    def abort(self, messages):
        system, _ = _filesystem(self.path)
        for m in messages:
            for p in m.paths if m else []:
                system.delete_file(p)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options)


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under path. Filters on header columns are tested before a block is read."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_archive(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000) -> None:
    """A record for each page. Of equal payloads of at least least bytes, the page with the largest id is a response
    and the others revisit it. The largest ids are found by a pre-aggregated maximum for each digest."""
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    payload = F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(url).cast("string").alias("target_uri"), F.col(key).cast("bigint").alias("page_id"), payload.alias("payload"))
    rows = rows.withColumns({"payload_digest": F.sha1("payload"), "_n": F.octet_length("payload")})
    large = rows.where(F.col("_n") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("_first"), F.count("*").alias("_rows"))
    rows = rows.join(large.where("_rows > 1"), "payload_digest", "left")
    again = F.coalesce((F.col("_n") >= least) & F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id")), F.lit(False))

    @F.arrow_udf("string")
    def named(first: pa.Array, digest: pa.Array) -> pa.Array:
        return pa.array([None if i is None else record_id(i, d) for i, d in zip(first.to_pylist(), digest.to_pylist())], pa.string())

    out = rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "target_uri",
        "page_id",
        "payload_digest",
        named(F.when(again, F.col("_first")), F.col("payload_digest")).alias("refers_to"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def archive_report(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each record, from the archive alone: sizes
    and digests are those of the payloads read; a revisit has those of the response that it names."""
    records = read_warc(spark, path)
    responses = records.where("record_type = 'response'")
    responses = responses.select("record_id", "page_id", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    responses = stash(responses, "warc-responses")
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select("page_id", "refers_to")
    named = responses.withColumnsRenamed({"page_id": "first"}).dropDuplicates(["record_id"])
    revisits = revisits.join(named, revisits.refers_to == named.record_id, "left")
    none = F.lit(None).cast("bigint")
    columns = ["payload_bytes", "payload_digest"]
    return responses.select("page_id", *columns, F.lit("response").alias("record_type"), none.alias("refers_to")).unionByName(
        revisits.select("page_id", *columns, F.lit("revisit").alias("record_type"), F.col("first").alias("refers_to"))
    )


def archive_roundtrip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to a new archive in the shared folder and report what is read back."""
    path = new_path(pages.sparkSession, "archive")
    write_archive(pages, path, **options)
    return archive_report(pages.sparkSession, path)
