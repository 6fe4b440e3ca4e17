"""Substring dedup: Rabin-Karp hashes of every token window, counted in Spark.

1. Each task hashes every ``width``-word window of its texts and sends (hash, document) in blocks,
   dealt by hash.
2. Per hash bucket the smallest document id of each hash is found; a window is repeated in a
   document when that id is smaller. The repeated windows go back, dealt by document bucket.
3. Next to the texts, repeated windows are merged into maximal word intervals and cut.

The number of buckets follows the total size, so that a bucket holds BUCKET_BYTES of text (above BUCKET_BYTES * MAX_BUCKETS in
all, 2 TB, as much more as it takes; 95 MB at 100 TB). A very common window is one hash, sent once per document at most, and all other hashes
are spread evenly. Windows are compared by 64 bits of hash and 8 of a second one, and the bucket adds its own bits of a third (20 at 100 TB).

Defined results: a null text has no words; a row with a null id keeps its words and makes no other
row lose any; rows that share an id, repeated rows too, never remove from each other; a very long text is handled by one task in some 60 bytes a word; extra columns are
not read; empty tables give empty tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import by_value
from tessera.llm import kernels as K

WIDTH = 13
#: Text bytes whose windows a bucket holds; above MAX_BUCKETS buckets they grow instead.
BUCKET_BYTES = 4 << 20
MAX_BUCKETS = 1 << 19
#: Windows that a task gathers before it deals them to buckets.
FLUSH = 1 << 20


RESULT = "doc_id long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,end:long>>"


def buckets_for(df: DataFrame, text: str, bytes_each: int = BUCKET_BYTES) -> int:
    total = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return int(min(MAX_BUCKETS, max(16, -(-total // bytes_each))))


def id_bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """What ``pmod(xxhash64(doc_id), n)`` gives in Spark."""
    return K.xxhash64_long(ids) % n


def windows(part: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, width: int):
    """64 bits of hash, 8 more, 24 more for the bucket, first word and text of each window."""
    words = K.span_hashes(part, starts, ends)
    h, at, text = K.window_hashes(words, first, width)
    other, _, _ = K.window_hashes(K.mix(words + np.uint64(1)), first, width, K.P_BYTE)
    return h, other.astype(np.uint8), (other >> np.uint64(40)).astype(np.int64), at, text


def pack(ids: np.ndarray, h: np.ndarray, more: np.ndarray) -> bytes:
    """Windows of one bucket, ids ascending: runs of an id as steps and lengths in few bytes, then the hashes."""
    new = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1])
    runs = np.diff(np.concatenate([new, [len(ids)]]))
    steps = np.diff(ids[new])
    kinds = [np.min_scalar_type(int(x.max())) if len(x) else np.dtype(np.uint8) for x in (steps, runs)]
    head = np.array([len(new), ids[0], kinds[0].itemsize, kinds[1].itemsize], np.int64)
    return b"".join(x.tobytes() for x in (head, steps.astype(kinds[0]), runs.astype(kinds[1]), h, more))


def unpack(blob: bytes):
    n, first, a, b = np.frombuffer(blob, np.int64, 4).tolist()
    at = 32
    steps = np.frombuffer(blob, f"u{a}", n - 1, at)
    at += a * (n - 1)
    runs = np.frombuffer(blob, f"u{b}", n, at)
    at += b * n
    many = int(runs.sum())
    ids = np.concatenate([[first], first + np.cumsum(steps.astype(np.int64))])
    return np.repeat(ids, runs), np.frombuffer(blob, np.uint64, many, at), np.frombuffer(blob, np.uint8, many, at + 8 * many)


def _windows_out(width: int, n: int):
    def run(batches):
        held, size = [], 0

        def flush():
            ids, h, more, bucket = (np.concatenate(x) for x in zip(*held))
            # a text lies in one flush: a window that it repeats is sent once
            once = np.sort(np.unique(mark_of(h, more, ids), return_index=True)[1])
            ids, h, more, bucket = ids[once], h[once], more[once], bucket[once].astype(np.min_scalar_type(n))
            if np.any(np.diff(ids) < 0):
                order = np.argsort(ids, kind="stable")
                ids, h, more, bucket = ids[order], h[order], more[order], bucket[order]
            order = np.argsort(bucket, kind="stable")
            ids, h, more, bucket = ids[order], h[order], more[order], bucket[order]
            cut = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for i in range(0, len(cut) - 1, 1024):
                ends = cut[i : i + 1025]
                blobs = [pack(ids[a:b], h[a:b], more[a:b]) for a, b in zip(ends[:-1], ends[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[ends[:-1]].astype(np.int32)), pa.array(blobs, pa.binary())], ["bucket", "block"])

        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            buf, off = K.buffer(b.column(1))
            for i, j in K.chunks(off):
                part = buf[off[i] : off[j]]
                h, more, bucket, _, text = windows(part, *K.word_spans(part, off[i : j + 1] - off[i]), width)
                if len(h):
                    held.append((ids[i:j][text], h, more, bucket % n))
                    size += len(h)
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return run


def mark_of(h: np.ndarray, more: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return K.mix(h ^ K.mix(ids.astype(np.uint64) ^ (more.astype(np.uint64) << np.uint64(56))))


def _repeated(n: int):
    def run(table: pa.Table) -> pa.Table:
        ids, h, more = (np.concatenate(x) for x in zip(*map(unpack, table.column("block").to_pylist())))
        order = np.lexsort((more, h))
        ids, h, more = ids[order], h[order], more[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (more[1:] != more[:-1])
        least = np.minimum.reduceat(ids, np.flatnonzero(new))[np.cumsum(new) - 1]
        hit = ids > least
        marks = mark_of(h[hit], more[hit], ids[hit])
        to = id_bucket(ids[hit], n)
        order = np.argsort(to, kind="stable")
        to, marks = to[order], marks[order]
        cut = np.flatnonzero(np.diff(to)) + 1
        keys, blobs = [], []
        for a, b in zip(np.concatenate([[0], cut]), np.concatenate([cut, [len(to)]])):
            if b > a:
                keys.append(int(to[a]))
                blobs.append(np.unique(marks[a:b]).tobytes())
        return pa.table({"bucket": pa.array(keys, pa.int64()), "marks": pa.array(blobs, pa.binary())})

    return run


def _cut(width: int):
    def run(docs: pa.Table, marks: pa.Table) -> pa.Table:
        found = [np.frombuffer(b, np.uint64) for b in marks.column("marks").to_pylist()]
        return cut(docs, np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64), width)

    return run


def _uncut(width: int):
    def run(batches):
        for b in batches:
            yield from cut(pa.Table.from_batches([b]), np.zeros(0, np.uint64), width).to_batches()

    return run


def cut(docs: pa.Table, marked: np.ndarray, width: int) -> pa.Table:
    column = docs.column("doc_id").combine_chunks()
    known = ~np.asarray(column.is_null())
    ids = column.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    buf, off = K.buffer(docs.column("text"))
    out = {"n_words": [], "n_removed": [], "kept_text": [], "removed": []}
    for i, j in K.chunks(off):
        part, o = buf[off[i] : off[j]].copy(), off[i : j + 1] - off[i]
        starts, ends, first = K.word_spans(part, o)
        gone = np.zeros(len(starts) + 1, np.int64)
        if len(marked) and len(starts):
            h, more, _, at, text = windows(part, starts, ends, first, width)
            key = mark_of(h, more, ids[i:j][text])
            place = np.minimum(np.searchsorted(marked, key), len(marked) - 1)
            hit = (marked[place] == key) & known[i:j][text]
            np.add.at(gone, at[hit], 1)
            np.add.at(gone, at[hit] + width, -1)
        gone = np.cumsum(gone)[:-1] > 0
        n_words = np.diff(first)
        lost = np.concatenate([[0], np.cumsum(gone)])
        out["n_words"].append(n_words)
        out["n_removed"].append(lost[first[1:]] - lost[first[:-1]])
        # bytes of kept words, and one space after each but the last of its text
        text_of = np.repeat(np.arange(j - i), n_words)
        kept = np.flatnonzero(~gone)
        more = np.zeros(len(kept), bool)
        more[:-1] = text_of[kept[1:]] == text_of[kept[:-1]]
        part[ends[kept[more]]] = 0x20
        edge = np.zeros(len(part) + 2, np.int64)
        np.add.at(edge, starts[kept], 1)
        np.add.at(edge, ends[kept] + more, -1)
        keep = np.cumsum(edge)[: len(part)] > 0
        to = np.concatenate([[0], np.cumsum(keep)])[o]
        out["kept_text"].append(pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(part[keep])).cast(pa.string()))
        # maximal intervals of removed words, per text
        flip = np.concatenate([[False], gone, [False]])
        open_ = gone & (~flip[:-2] | np.isin(np.arange(len(gone)), first[:-1]))
        close = gone & (~flip[2:] | np.isin(np.arange(len(gone)) + 1, first[:-1]))
        a, z = np.flatnonzero(open_), np.flatnonzero(close) + 1
        t = text_of[a] if len(a) else np.zeros(0, np.int64)
        spans = pa.StructArray.from_arrays([pa.array(a - first[:-1][t], pa.int64()), pa.array(z - first[:-1][t], pa.int64())], ["start", "end"])
        out["removed"].append(pa.ListArray.from_arrays(pa.array(np.searchsorted(t, np.arange(j - i + 1)), pa.int32()), spans))
    if not out["n_words"]:
        return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept_text": pa.array([], pa.string()), "removed": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})
    return pa.table({
        "doc_id": column.cast(pa.int64()),
        "n_words": np.concatenate(out["n_words"]).astype(np.int64), "n_removed": np.concatenate(out["n_removed"]).astype(np.int64),
        "kept_text": pa.chunked_array(out["kept_text"]), "removed": pa.chunked_array(out["removed"]),
    })


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_words, n_removed, kept_text, removed`` (word intervals, end exclusive).

    A word goes when some ``width``-word window over it also starts in a row with a smaller id.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = buckets_for(d, "text")
    blocks = d.where("doc_id is not null and text is not null").mapInArrow(_windows_out(width, n), "bucket int, block binary")
    marks = blocks.groupBy("bucket").applyInArrow(_repeated(n), "bucket long, marks binary")
    dealt = d.where("doc_id is not null").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(n)))
    out = dealt.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_cut(width), RESULT)
    return out.union(d.where("doc_id is null").mapInArrow(_uncut(width), RESULT))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH w AS (SELECT doc_id, rowid AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
           FROM (SELECT doc_id, text, row_number() OVER () AS rowid FROM documents)),
win AS (SELECT doc_id, rid, i, array_to_string(ws[i:i + 12], ' ') AS k
        FROM (SELECT doc_id, rid, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE doc_id IS NOT NULL)),
low AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k HAVING min(doc_id) <> max(doc_id)),
hit AS (SELECT DISTINCT rid, i + o AS p FROM win JOIN low USING (k), (SELECT unnest(range(0, 13)) AS o) WHERE doc_id > m),
gone AS (SELECT rid, list(p) AS ps, count(*) AS n FROM hit GROUP BY rid)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(ws, ' ')
              ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(ws) + 1), lambda x: NOT list_contains(ps, x)), lambda x: ws[x]), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN gone USING (rid)
"""

by_value(__name__)
