"""WARC archives with an index written first, and coalesced range reads.

Writing: each task appends gzip members, a record each, to an archive file of its own and yields an index row per
record: file, offset, length, URL and payload digest. The index becomes a table before anything is read. Reading:
selected index rows are sorted by file and offset, ranges that lie close together become one read, and records are
cut from it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.common import col, shared_path, whole_text

#: Payloads of at least so many bytes are stored once.
LEAST_SHARED = 1_000
#: Bytes between two records that are read along rather than starting a new read, and the bytes of one read.
GAP, READ = 64 << 10, 4 << 20
#: zlib level of the members.
LEVEL = 3
#: Fixed value: the date of all records, so that archives can be told apart by content alone.
DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if uri.startswith("s3a://"):
        uri = "s3://" + uri[6:]
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:") and not uri.startswith("file://"):
            uri = "file://" + uri[5:]
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def record_id(page_id, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url}')}>"


def _line(value: str) -> str:
    """A header value: one line, other control characters as percent escapes."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in value)


def record(page_id, url: str, payload: bytes, digest: str, size: int, refers_to=None, refers_url: str = "", revisit: bool = False) -> bytes:
    """One uncompressed WARC/1.1 record. A revisit has the HTTP head alone; its payload is the referred record's."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {size}{CRLF}{CRLF}".encode()
    body = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, url)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Page-Id: {'' if page_id is None else page_id}", f"WARC-Payload-Length: {size}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, refers_url)}", f"WARC-Refers-To-Target-URI: {_line(refers_url)}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return CRLF.join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def member(data: bytes, level: int = LEVEL) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split(CRLF)
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the archives under ``path`` and returns their index, a written table.

    Of pages with equal payloads of LEAST_SHARED bytes and more the one with the largest page_id is the response,
    the others revisit it; rows that repeat that page are responses as well. Null html is an empty payload, a null
    url an empty one; a null page_id can only be a response if all its copies are null. An attempt that fails leaves
    a file that no index row names.
    """
    spark = pages.sparkSession
    rows = pages.select(col(page_id).cast("long").alias("page_id"), F.coalesce(col(url), F.lit("")).alias("url"), F.encode(whole_text(html), "UTF-8").alias("payload")).withColumn("digest", F.sha1("payload"))
    # only digests met twice need a response named; the largest id of a digest and its url by a partial aggregate
    sized = rows.select("digest", "page_id", "url", F.octet_length("payload").alias("size")).where(F.col("size") >= LEAST_SHARED)
    copied = sized.groupBy("digest", "size").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "url")).alias("k")).where("n > 1 and k.page_id is not null").select("digest", F.col("k.page_id").alias("keeper"), F.col("k.url").alias("keeper_url"))
    marked = rows.join(copied, "digest", "left")
    scheme, root = path.rstrip("/"), "archives"

    def write(batches):
        fs, base = file_system(scheme)
        folder = f"{base}/{root}"
        fs.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                found = {k: [] for k in ("file", "offset", "length", "page_id", "url", "digest", "record_type")}
                for p, u, body, digest, keeper, keeper_url in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "keeper", "keeper_url")), strict=True):
                    revisit = keeper is not None and p != keeper
                    raw = member(record(p, u, b"" if revisit else body, digest, len(body), keeper, keeper_url or "", revisit))
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out = fs.open_output_stream(f"{folder}/{name}", compression=None)
                        info = member(f"WARC/1.1{CRLF}WARC-Type: warcinfo{CRLF}WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>{CRLF}WARC-Date: {DATE}{CRLF}Content-Type: application/warc-fields{CRLF}Content-Length: 0{CRLF}{CRLF}{CRLF}{CRLF}".encode())
                        out.write(info)
                        at = len(info)
                    out.write(raw)
                    for k, v in zip(found, (name, at, len(raw), p, u, digest, "revisit" if revisit else "response"), strict=True):
                        found[k].append(v)
                    at += len(raw)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(found.values(), kinds, strict=True)], names=list(found))
        finally:
            if out is not None:
                out.close()

    index = marked.select("page_id", "url", "payload", "digest", "keeper", "keeper_url").mapInArrow(write, "file string, offset long, length long, page_id long, url string, digest string, record_type string")
    index.write.parquet(f"{path}/index")
    return spark.read.schema(index.schema).parquet(f"{path}/index")


def coalesced(ranges: Iterator[tuple[str, int, int]], gap: int = GAP, most: int = READ) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """(file, start, end, ranges): reads that cover neighbouring sorted ranges of one file."""
    held: list[tuple[int, int]] = []
    name, end = None, 0
    for f, offset, length in ranges:
        if held and (f != name or offset > end + gap or max(end, offset + length) - held[0][0] > most):
            yield name, held[0][0], end, held
            held, end = [], 0
        name, end = f, max(end, offset + length)
        held.append((offset, length))
    if held:
        yield name, held[0][0], end, held


def read_records(index: DataFrame, path: str) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the index rows selected, from the archives.

    A response's payload is read and its length and digest are taken from it; one that doesn't fit its header is an
    error. A revisit has those of the payload it refers to in its headers. Rows selected twice are read once a row.
    """
    parts = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # runs of one file stay together and in order, and a large archive is dealt to several tasks
    ordered = index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    scheme = path.rstrip("/")

    def read(batches):
        fs, base = file_system(scheme)

        def selected():
            for batch in batches:
                yield from zip(batch.column("file").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True)

        opened, handle = None, None
        for name, start, end, ranges in coalesced(selected()):
            if name != opened:
                if handle:
                    handle.close()
                opened, handle = name, fs.open_input_file(f"{base}/archives/{name}")
            data = handle.read_at(end - start, start)
            rows = []
            for offset, length in ranges:
                headers, block = parse(zlib.decompress(data[offset - start : offset - start + length], 31))
                digest, size = headers["warc-payload-digest"].removeprefix("sha1:"), int(headers["warc-payload-length"])
                if headers["warc-type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{name} at {offset}: the payload isn't what its header says")
                page, refers = headers["warc-page-id"], headers.get("warc-refers-to-page-id")
                rows.append((int(page) if page else None, headers["warc-target-uri"], size, digest, headers["warc-type"], int(refers) if refers else None))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
            names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=list(names))
        if handle:
            handle.close()

    return ordered.mapInArrow(read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back."""
    from wordloom.llm.common import table, text_batches

    text_batches(spark)
    path = shared_path(spark, "warc")
    index = write_archives(table(spark, sf_dir, "pages"), path)
    return read_records(index, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as payload_digest, coalesce(url, '') as url from pages),
k as (select payload_digest, max(page_id) as keeper from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when keeper is not null and page_id is distinct from keeper then 'revisit' else 'response' end as record_type,
  case when keeper is not null and page_id is distinct from keeper then keeper end as refers_to, url
from p left join k using (payload_digest)
"""
