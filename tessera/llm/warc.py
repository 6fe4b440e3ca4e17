"""WARC archives: a writer with digest revisits and a salvage reader.

Tasks write gzip-per-record archives into the shared folder; a file counts once its task's manifest
row is committed, so a retried task leaves no second copy behind. The reader walks members (or bare
``WARC/`` version lines); after a failed check (bad header, broken deflate stream, CRC, length or digest)
it searches for the next member or version line that parses, goes on there, and logs the bytes
between as a quarantined gap. Of a damaged gzip member the records before the fault are kept, as far as they inflate and pass their checks.

Defined results: null html is an empty payload; null or hostile URLs are percent-encoded; a record
with a null page_id is always a response and is never referred to; equal page_ids with equal payloads are
responses together if they are the smallest; repeated rows are records each; a very long page is one record, built in one task; other columns are not read; an empty table makes no archive and no records. An archive is read as one cell, which
Spark bounds at 2 GB; the writer begins another after ROLL_BYTES.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import Scratch
from tessera.llm import by_value

MIN_REVISIT = 100
#: Compressed bytes after which a task begins another archive.
ROLL_BYTES = 4 << 20
FEED = 1 << 15
#: A record whose header is longer is broken.
MAX_HEADER = 1 << 20
MAGIC = b"\x1f\x8b\x08"
RECORD = "file string, offset long, length long, kind string, page_id long, record_type string, refers_to long, url string, payload_bytes long, payload_digest string, payload binary, reason string"


def with_record_types(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds ``digest, first_id``; first_id is set on rows that revisit the smallest page of equal payload."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumn("digest", F.sha2("html", 256))
    tmp = Scratch(pages.sparkSession, "warc-first")
    some = p.where(F.octet_length("html") >= min_revisit).where("page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first <> last")
    some = tmp.save(some.select("digest", "first"))
    j = p.join(some, "digest", "left")
    return j.select("page_id", "url", "html", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("first_id"))


def record(page_id, url, html: bytes, digest: str, first_id) -> bytes:
    name = "null" if page_id is None else str(page_id)
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if first_id is not None else http + html
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first_id is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if first_id is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first_id}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _write(root: str, level: int = 3):
    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        out, size, n, name = None, 0, 0, None

        def close():
            out.close()
            store.move(f"{base}/.{name}", f"{base}/{name}")
            return pa.RecordBatch.from_pydict({"name": [name], "bytes": [size], "records": [n]})

        for b in batches:
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/.{name}", compression=None)
                z = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, html.encode(), digest, first)) + z.flush()
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= ROLL_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(typed: DataFrame, root: str) -> DataFrame:
    """Write the rows of ``with_record_types`` below ``root``; returns the committed manifest (``name, bytes, records``)."""
    spark = typed.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(root)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    manifest = typed.select("page_id", "url", "html", "digest", "first_id").mapInArrow(_write(root), "name string, bytes long, records long")
    return Scratch(spark, "warc-manifest").save(manifest)


class Broken(Exception):
    pass


def member_at(data: memoryview, pos: int):
    """The gzip member at ``pos``: what could be inflated, where it ends, and what is wrong with it (None: whole)."""
    z, out, at = zlib.decompressobj(31), [], pos
    while not z.eof:
        if at >= len(data):
            return b"".join(out), at, "cut off"
        before, size = z.copy(), FEED
        try:
            out.append(z.decompress(data[at : at + size]))
            at += size
        except zlib.error:
            # keep all that comes out before the fault: go on from the copy in ever smaller steps
            z = before
            while size:
                before = z.copy()
                try:
                    out.append(z.decompress(data[at : at + size]))
                    at += size
                except zlib.error:
                    z, size = before, size // 2
            return b"".join(out), at, "deflate or CRC"
    return b"".join(out), min(at, len(data)) - len(z.unused_data), None


def place_of(data: memoryview, pos: int, size: int, step: int = 512) -> int:
    """Where the member at ``pos`` has given ``size`` bytes (it gives as many)."""
    z, have, at = zlib.decompressobj(31), 0, pos
    while step:
        while have < size:
            before = z.copy()
            try:
                got = len(z.decompress(data[at : at + step]))
            except zlib.error:
                got = size
            if have + got >= size and step > 1:
                z = before
                break
            have, at = have + got, at + step
        step = 1 if step > 1 else 0
    return min(at, len(data))


def fields_of(lines: list) -> dict:
    """Header fields by name, folded lines joined. Broken if another record's header begins in the midst of it."""
    joined: list = []
    for x in lines:
        if x[:1] in (" ", "\t") and joined:
            joined[-1] += " " + x.strip()
        else:
            joined.append(x)
    names = [x.partition(":")[0].strip().lower() for x in joined]
    for i, x in enumerate(joined):
        if ":" not in x:
            raise Broken("header line")
        # a header cut off in a line runs into the next version line, after which its fields come again; a URL may end alike
        if re.search(r"WARC/1\.\d$", x) and set(names[: i + 1]) & set(names[i + 1 :]) - {"warc-concurrent-to"}:
            raise Broken("header line")
    return {k: x.partition(":")[2].strip() for k, x in zip(names, joined)}


def parse_record(raw: bytes, pos: int, head_end: int | None = None):
    """Fields of the record at ``pos`` of plain WARC bytes, and its end. head_end: where its first blank line begins, if known."""
    if raw[pos : pos + 5] != b"WARC/":
        raise Broken("no version line")
    head_end = raw.find(b"\r\n\r\n", pos) if head_end is None else head_end
    if not 0 <= head_end - pos <= MAX_HEADER:
        raise Broken("no end of header")
    lines = raw[pos:head_end].decode("utf-8", "replace").split("\r\n")[1:]
    head = fields_of(lines)
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        raise Broken("no length") from None
    start, stop = head_end + 4, head_end + 4 + length
    if length < 0 or raw[stop : stop + 4] != b"\r\n\r\n":
        raise Broken("length")
    block = raw[start:stop]
    said = head.get("warc-block-digest", "")
    if said.startswith("sha256:") and hashlib.sha256(block).hexdigest() != said[7:]:
        raise Broken("block digest")
    http, _, body = block.partition(b"\r\n\r\n")
    kind = head.get("warc-type", "")
    digest, size = head.get("warc-payload-digest", "").removeprefix("sha256:"), None
    if kind == "response":
        real = hashlib.sha256(body).hexdigest()
        if digest and real != digest:
            raise Broken("payload digest")
        digest, size = real, len(body)
    elif m := re.search(rb"(?im)^content-length:\s*(\d+)", http):
        size = int(m[1])

    def page(key):
        m = re.fullmatch(r"<urn:page:(-?\d+)>", head.get(key, ""))
        return int(m[1]) if m else None

    return {"page_id": page("warc-record-id"), "record_type": kind, "refers_to": page("warc-refers-to"), "url": head.get("warc-target-uri"), "payload_bytes": size, "payload_digest": digest, "payload": body if kind == "response" else None}, stop + 4


def salvage(data: bytes, packed: bool = True):
    """Records (``kind`` record) and quarantined gaps (``kind`` gap) of one archive, in order, covering every byte.

    A gzip member may hold several records. All its rows have the member's offset; the first has its length, the others 0. Of a damaged member all records that can be
    inflated and pass their checks are kept; the rest of it, from the end of the last of them, is a gap (of length 0 if nothing is left of it).
    """
    view, pos, n = memoryview(data), 0, len(data)
    gap, why = None, ""
    # next place of each, searched for again only once passed: the time is linear in the bytes
    marks = {b"WARC/1.": -1} | ({MAGIC: -1} if packed else {})
    blank = -1

    def take(at):
        nonlocal blank
        if packed and data[at : at + 3] == MAGIC:
            raw, end, fault = member_at(view, at)
            rows = list(salvage(raw, False))
            ends = [x["offset"] + x["length"] for x in rows if x["kind"] == "record"]
            if not ends:
                raise Broken(fault or (rows[0]["reason"] if rows else "empty member"))
            if fault:
                rows = [x for x in rows if x["kind"] == "record" or x["offset"] < max(ends)]
                return rows, place_of(view, at, max(ends)), fault
            return rows, end, None
        if blank < at:
            blank = blank if (blank := data.find(b"\r\n\r\n", at)) >= 0 else n + MAX_HEADER + 1
        fields, end = parse_record(data, at, blank)
        return [fields | {"kind": "record"}], end, None

    while pos < n:
        try:
            rows, end, fault = take(pos)
        except Broken as e:
            if gap is None:
                gap, why = pos, str(e)
            for mark, at in marks.items():
                if at <= pos:
                    marks[mark] = at if (at := data.find(mark, pos + 1)) >= 0 else n
            pos = min(marks.values())
            continue
        if gap is not None:
            yield {"kind": "gap", "offset": gap, "length": pos - gap, "reason": why}
            gap = None
        for i, x in enumerate(rows):
            yield x | {"offset": pos, "length": 0 if i else end - pos}
        pos = end
        if fault:
            gap, why = pos, fault
    if gap is not None:
        yield {"kind": "gap", "offset": gap, "length": n - gap, "reason": why}


def _read(payloads: bool):
    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1)):
                rows, size = [], 0
                for r in salvage(content.as_py() or b""):
                    row = {k: r.get(k) for k in NAMES} | {"file": path}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    size += len(row["payload"] or b"") + 200
                    if size > FEED * 256:
                        yield pa.RecordBatch.from_pylist(rows, SCHEMA)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, SCHEMA)

    return run


NAMES = [x.split()[0] for x in RECORD.split(", ")]
SCHEMA = pa.schema([(x.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]]) for x in RECORD.split(", ")])


def read_archives(spark: SparkSession, root: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """Records and gaps (see RECORD) of the archives below ``root``; with a manifest, of its files only."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(root).select("path", "content")
    if manifest is not None:
        files = files.withColumn("name", F.substring_index("path", "/", -1)).join(manifest.select("name"), "name", "left_semi").select("path", "content")
    return files.mapInArrow(_read(payloads), RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "warc").root
    manifest = write_archives(with_record_types(spark.read.parquet(f"{sf_dir}/pages.parquet")), root)
    return read_archives(spark, root, manifest, payloads=False).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN octet_length(encode(h)) >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS m FROM p)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id > m THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > m THEN m END AS refers_to
FROM f
"""

by_value(__name__)
