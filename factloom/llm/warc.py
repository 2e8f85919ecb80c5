"""WARC archives: one gzip member per record, written and read by Spark tasks (operator 9)."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, join_groups, shared_dir, small_batches

CRLF = b"\r\n"
#: Bytes that the reader takes from a file at a time.
READ = 1 << 16
#: Digests of repeated payloads that are broadcast at most (some 60 bytes each).
MOST_BROADCAST = 500_000
#: What every record of one run is dated, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """An archive that breaks the format or does not hold what its digests say."""


@dataclass
class Record:
    """Named fields (lower case) of a record, and its block."""

    fields: dict[str, str] = field(default_factory=dict)
    block: bytes = b""

    @property
    def payload(self) -> bytes:
        return self.block.partition(CRLF + CRLF)[2]

    @property
    def http(self) -> dict[str, str]:
        lines = self.block.partition(CRLF + CRLF)[0].decode("utf-8", "replace").split("\r\n")[1:]
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def digest(data: bytes) -> str:
    """A SHA-1 digest the way archives label it."""
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(kind: str, uri: str, payload: bytes, record_id: str, extra: dict[str, str]) -> bytes:
    """One record in a gzip member of its own; a revisit keeps the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{record_id}>", "WARC-Date": DATE, "WARC-Target-URI": uri,
        "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Type": "application/http; msgtype=response",
        **extra, "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head.encode() + block + CRLF + CRLF) + packer.flush()


def members(stream) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream one after the other, each as an iterator of its bytes.

    zlib gets READ bytes at a time; what it leaves after the end of a member starts the next. An
    iterator must be used up before the next one is taken.
    """
    rest = stream.read(READ)
    while rest:
        unpacker = zlib.decompressobj(31)

        def data() -> Iterator[bytes]:
            nonlocal rest
            while not unpacker.eof:
                if not rest:
                    raise WarcError("the archive ends within a gzip member")
                try:
                    out = unpacker.decompress(rest, READ * 4)
                except zlib.error as e:
                    raise WarcError(f"damaged gzip member: {e}") from e
                rest = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail or stream.read(READ)
                if out:
                    yield out
            if not rest:
                rest = stream.read(READ)

        yield data()


def read_records(stream) -> Iterator[Record]:
    """The records of an archive in order, framed by Content-Length, with their digests verified."""
    for member in members(stream):
        got = bytearray()
        end = -1
        for piece in member:
            got += piece
            if (end := got.find(CRLF + CRLF, max(0, len(got) - len(piece) - 3))) >= 0:
                break
        if end < 0 or not got.startswith(b"WARC/1."):
            raise WarcError("a gzip member does not start with a record header")
        lines = bytes(got[:end]).decode("utf-8").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not fields.get("content-length", "").isdigit():
            raise WarcError("a record has no Content-Length")
        length = int(fields["content-length"])
        body = bytearray(got[end + 4 :])
        for piece in member:
            body += piece
            if len(body) > length + 4:
                raise WarcError(f"a record of {length} bytes goes on after them")
        if len(body) != length + 4 or not body.endswith(CRLF + CRLF):
            raise WarcError(f"a record of {length} bytes has {len(body) - 4}")
        record = Record(fields, bytes(body[:length]))
        checks = [("warc-block-digest", record.block)]
        if fields.get("warc-type") != "revisit":
            checks.append(("warc-payload-digest", record.payload))
        for name, data in checks:
            if name in fields and fields[name] != digest(data):
                raise WarcError(f"{name} of {fields.get('warc-record-id')} does not match")
        yield record


# --- Spark ------------------------------------------------------------------------------------


def filesystem(uri: str):
    """The pyarrow filesystem of a URI or local path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def with_types(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """Adds payload_digest, record_type and refers_to to (page_id, url, payload binary).

    Of equal payloads of at least `min_bytes` the one with the largest page_id is the response (all
    rows that share this page_id are). The largest is found by a pre-aggregated group per digest;
    only digests that occur more than once are joined back: by broadcast while they are at most
    MOST_BROADCAST (then no page is shuffled), else by an exchange that deals hot ones over tasks.
    """
    pages = pages.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    groups = pages.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n"))
    groups = checkpointed(groups.where("n > 1"))
    n_groups, n_rows = groups.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n_groups <= MOST_BROADCAST:
        joined = pages.join(F.broadcast(groups.drop("n")), "payload_digest", "left")
    else:
        joined = join_groups(pages, groups, ["payload_digest"], "n", n_rows, ["page_id"])
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("original")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records of `with_types` into archives under `folder`, one per partition.

    A task writes under a name of its own attempt and reports it in its row, so what a lost or
    repeated task left behind is never read. Returns (path, records).
    """

    def write(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        n = 0
        with fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in batches:
                columns = [batch.column(batch.schema.get_field_index(c)) for c in ("page_id", "url", "payload", "record_type", "refers_to")]
                for page_id, url, payload, kind, refers_to in zip(*columns, strict=True):
                    page, origin = page_id.as_py(), refers_to.as_py()
                    own = lambda x: str(uuid.uuid5(uuid.NAMESPACE_URL, f"page:{x}"))
                    uri = " ".join((url.as_py() or "urn:none").split())
                    extra = {} if page is None else {"WARC-Page-ID": str(page)}
                    if kind.as_py() == "revisit":
                        extra |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": f"<urn:uuid:{own(origin)}>", "WARC-Refers-To-Page-ID": str(origin)}
                    out.write(record_bytes(kind.as_py(), uri, payload.as_py(), own(page), extra))
                    n += 1
        yield pa.record_batch([pa.array([name]), pa.array([n], pa.int64())], ["path", "records"])

    return pages.mapInArrow(write, "path string, records long")


def read_archives(paths: DataFrame, folder: str) -> DataFrame:
    """Reads the archives named in `paths` back, a record per row.

    A file is streamed; a task holds one record at a time and a batch of rows without payloads. For
    a revisit the payload's length comes from the HTTP header that the record keeps.
    """

    def read(batches):
        fs, root = filesystem(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(f"{root}/{path}", compression=None, buffer_size=READ) as stream:
                    for r in read_records(stream):
                        f = r.fields
                        kind = f["warc-type"]
                        length = len(r.payload) if kind == "response" else int(r.http["content-length"])
                        sha = base64.b32decode(f["warc-payload-digest"].removeprefix("sha1:")).hex()
                        ids = [int(f[k]) if k in f else None for k in ("warc-page-id", "warc-refers-to-page-id")]
                        rows.append((ids[0], f.get("warc-target-uri"), length, sha, kind, ids[1], f["warc-record-id"]))
                        if len(rows) == 4096:
                            yield _rows(rows)
                            rows = []
                if rows:
                    yield _rows(rows)

    return paths.select("path").mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "record_id"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 1000, folder: str | None = None) -> DataFrame:
    """Writes `pages` (page_id, url, html) as archives and reads every record back.

    A null html is an empty payload, a null url is written as urn:none, a null page_id is read back
    as null and never refers to another page. Repeated rows give a record each. An empty table gives
    archives without records. Other columns are ignored. Archives stay in the shared folder.
    """
    small_batches(spark)
    folder = folder or f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    written = checkpointed(write_archives(with_types(pages.select("page_id", "url", payload.alias("payload")), min_bytes), folder))
    return read_archives(written.where("records > 0").repartition(spark.sparkContext.defaultParallelism), folder)


def op9_warc_round_trip(spark, sf_dir):
    """Every page as it is read back from its archive."""
    return round_trip(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS original FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
  CASE WHEN p.payload_bytes >= 1000 AND p.page_id <> g.original THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.payload_bytes >= 1000 AND p.page_id <> g.original THEN g.original END AS refers_to
FROM p LEFT JOIN g USING (payload_digest)
"""
