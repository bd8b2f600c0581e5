"""WARC archives: writing, normalising and reading them back.

`write` makes one record a row, as a response or, where an equal payload has been stored under a smaller id, as a revisit
of that one. Spark's text writer puts them down with the record separator as line separator and gzip as codec, so each
file is one gzip stream over all its records, as many crawlers leave them. `normalise` takes such archives (several
members do no harm either), inflates each file once from its start to its end, cuts the stream into records by their
lengths, writes every record as a gzip member of its own, and an index of ids, offsets and lengths beside each archive.
`read` takes members by that index: any range of it can be read alone, so one large archive is read by many tasks.

Archives are read by Spark's text source, from wherever Spark can read. Normalised archives are written and read by
pyarrow's file systems (file, hdfs, s3, gs), in a folder that all executors share. Each attempt at a task writes files of
its own names, and only what the rows of the successful attempt name counts: an attempt that was lost leaves files that no
index row points at.

Results: payload null is empty. Rows with a null id are responses unless their payload stands under an id; rows that
repeat the smallest id of a payload are responses too. Line breaks in an address are percent-encoded. An empty table gives
no rows. A file that ends within a record, or holds something else, is an error that names it; so is a payload
that doesn't match its digest.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import small
from .common import Scratch

BREAK = "\r\n"
GAP = BREAK + BREAK
GAP_BYTES = GAP.encode()
BASE_32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
URN = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ_BYTES = 8 << 20  # members that lie together are read at once, up to so many bytes
TASK_BYTES = 64 << 20  # of archives that one task reads
INDEX = "archive string, offset long, length long, record_id string, record_type string, target_uri string, payload_digest string"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32: five hexadecimal digits are four of base 32."""
    hexed = F.sha1(payload)
    digits = F.concat(*(F.lpad(F.conv(F.substring(hexed, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)))
    return F.translate(F.upper(digits), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE_32)


def _lines(*fields: tuple[str, Column | str | None]) -> Column:
    """Header lines; those without a value are left out."""
    parts = [F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value, F.lit(BREAK)) for name, value in fields]
    return F.concat(*(F.coalesce(p, F.lit("")) for p in parts))


def records(df: DataFrame, record_id: str, url: str, payload: str, min_bytes: int = 0, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """(value): a record for each row of df, without the gap that ends it. Payloads are equal if their SHA-256 and their lengths are."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = df.select(F.col(record_id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), body.alias("body"))
    keyed = rows.withColumns({"n": F.length("body").cast("long"), "key": F.unhex(F.sha2("body", 256))})
    stored = keyed.where(F.col("n") >= min_bytes).groupBy("key", "n").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1 and least is not null")
    met = keyed.join(stored.select("key", "n", "least"), ["key", "n"], "left")
    again = F.col("least").isNotNull() & ~F.col("id").eqNullSafe(F.col("least"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}"), _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", F.col("n").cast("string"))), F.lit(BREAK))
    length = F.length(F.col("http").cast("binary")) + F.when(F.col("again"), 0).otherwise(F.col("n"))
    head = F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        _lines(
            ("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
            ("WARC-Record-ID", urn("id")),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
            ("WARC-Refers-To", F.when(F.col("again"), urn("least"))),
            ("WARC-Profile", F.when(F.col("again"), PROFILE)),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_sha1(F.col("body")))),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", length.cast("string")),
        ),
        F.lit(BREAK),
        F.col("http"),
    )
    shown = met.withColumns({"again": again, "http": http}).select(head.cast("binary").alias("head"), F.when(F.col("again"), F.lit(b"")).otherwise(F.col("body")).alias("rest"))
    return shown.select(F.concat("head", "rest").cast("string").alias("value"))


def write(df: DataFrame, folder: str, record_id: str, url: str, payload: str, **options) -> None:
    """Archives of one gzip stream each."""
    records(df, record_id, url, payload, **options).write.option("lineSep", GAP).option("compression", "gzip").text(folder)


class Stream:
    """Cuts a stream of bytes into records by the lengths that their headers give."""

    def __init__(self, name: str):
        self.name, self.held, self.need, self.head = name, bytearray(), 0, 0

    def add(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
        """(header fields, block, whole record) of each record that is complete with these bytes."""
        self.held += data
        while True:
            if not self.need:
                while self.held.startswith(b"\r\n"):
                    del self.held[:2]
                self.head = self.held.find(GAP_BYTES) + len(GAP_BYTES)
                if self.head < len(GAP_BYTES):
                    return
                self.fields = header(bytes(self.held[: self.head]), self.name)
                self.need = self.head + int(self.fields["content-length"]) + len(GAP_BYTES)
            if len(self.held) < self.need:
                return
            whole = bytes(self.held[: self.need])
            del self.held[: self.need]
            head, self.need = self.head, 0
            yield self.fields, whole[head : -len(GAP_BYTES)], whole

    def end(self) -> None:
        if self.need or self.held.strip(b"\r\n"):
            raise ValueError(f"{self.name} ends within a record")


def header(data: bytes, name: str) -> dict[str, str]:
    first, *rest = data.decode("utf-8", "replace").split(BREAK)
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in rest if line)}
    if not first.startswith("WARC/") or not fields.get("content-length", "").isdigit():
        raise ValueError(f"{name} holds something that is no WARC record: {first[:60]!r}")
    return fields


def _open(folder: str):
    """pyarrow's file system and path for the address of a folder or file."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrites the archives in `source` to `target`, a member for each record, with an index file beside each. The rows are the
    index (INDEX); as each run of this plan writes archives anew, store the rows and read only those."""
    pieces = spark.read.option("lineSep", GAP).text(source).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("file"))
    names = [f.split()[0] for f in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open(target)
        store.create_dir(root, recursive=True)
        file = stream = out = None
        rows: list[tuple] = []
        lines: list[bytes] = []
        path, at = "", 0

        def close() -> None:
            stream.end()
            out.close()
            with store.open_output_stream(f"{root}/{path}.idx") as f:
                f.write(b"".join(lines))

        for batch in small(batches):
            for piece, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != file:
                    if out is not None:
                        close()
                    stem = name.rpartition("/")[2].removesuffix(".gz").removesuffix(".txt").removesuffix(".warc")
                    path, at, file, lines = f"{stem}-{uuid.uuid4().hex[:12]}.warc.gz", 0, name, []
                    stream, out = Stream(name), store.open_output_stream(f"{root}/{path}", compression=None)
                for fields, _, whole in stream.add(piece + GAP_BYTES):
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packer.compress(whole) + packer.flush()
                    out.write(member)
                    told = [fields.get(x, "") for x in ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest")]
                    rows.append((f"{target}/{path}", at, len(member), *told))
                    lines.append("\t".join([str(at), str(len(member)), *(x.replace("\t", "%09") for x in told)]).encode() + b"\n")
                    at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], names=names)
                rows = []
        if out is not None:
            close()

    return pieces.mapInArrow(run, INDEX)


def _record(whole: bytes, archive: str) -> tuple:
    """A row of RECORD of the bytes of one record."""
    fields, block, _ = next(Stream(archive).add(whole))
    http, _, payload = block.partition(GAP_BYTES)
    given = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields.get("warc-type") == "revisit":
        found = re.search(rb"(?im)^content-length:\s*(\d+)", http)
        size, digest = int(found[1]) if found else None, given
    else:
        size, digest = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if given and given != digest:
            raise ValueError(f"{archive}: the payload of {fields.get('warc-record-id')} doesn't match its digest")
    return fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), size, digest, payload


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """(RECORD) The records that the rows of an index name. Without `payloads` these are read and checked, but not returned."""
    spark = index.sparkSession
    whole = index.agg(F.sum("length")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-whole // TASK_BYTES))
    names = [f.split()[0] for f in RECORD.split(", ")]

    def runs(rows: list[tuple[str, int, int]]) -> Iterator[list[tuple[str, int, int]]]:
        now: list[tuple[str, int, int]] = []
        for row in rows:
            if now and (row[0] != now[0][0] or row[1] != now[-1][1] + now[-1][2] or row[1] + row[2] - now[0][1] > READ_BYTES):
                yield now
                now = []
            now.append(row)
        if now:
            yield now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in small(batches):
            wanted = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            for together in runs(wanted):
                if together[0][0] != name:
                    if file is not None:
                        file.close()
                    name = together[0][0]
                    store, path = _open(name)
                    file = store.open_input_file(path)
                first = together[0][1]
                data = file.read_at(together[-1][1] + together[-1][2] - first, first)
                rows = [_record(zlib.decompress(data[a - first : a - first + n], 31), name) for _, a, n in together]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
                if not payloads:
                    cols[-1] = [None] * len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)
        if file is not None:
            file.close()

    return index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset").mapInArrow(run, RECORD)


def number(urn: str) -> Column:
    """The id in a record's name; null where it has none."""
    return F.regexp_extract(urn, rf"^<{URN}(-?\d+)>$", 1).try_cast("long")


def round_trip(df: DataFrame, record_id: str, url: str, payload: str, min_bytes: int = 0) -> DataFrame:
    """Writes the rows as archives, normalises these and reads them back: RECORD without payloads, from archives in the shared
    folder that go when the application ends."""
    store = Scratch(df.sparkSession, "warc")
    root = store.folder()
    write(df, f"{root}/whole", record_id, url, payload, min_bytes=min_bytes)
    index = store.keep(normalise(df.sparkSession, f"{root}/whole", f"{root}/members"))
    store.delete(f"{root}/whole")
    return read(index, payloads=False)
