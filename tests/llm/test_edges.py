"""Hot keys, hostile values, repeated rows and sizes that the other tests do not reach."""

import gzip
import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, embedding_dedup, kernels, line_dedup, mixing, substring_dedup, toxicity, warc


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_many_lines_with_one_common_segment(spark):
    """100,000 lines of one length that share a third of their characters: found by longer signatures, not by all pairs."""
    line = F.concat(F.lit("the same opening of lines "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 52))
    near = F.concat(F.substring(line, 1, 40), F.lit("#"), F.substring(line, 42, 100))
    d = spark.range(100_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 100 == 99, F.concat(line, F.lit("\n"), near)).otherwise(line).alias("text"))
    out = line_dedup.with_lines_removed(d).agg(F.sum("n_removed").alias("n"), F.max("n_removed").alias("most")).first()
    assert (out["n"], out["most"]) == (1000, 1)


def test_thousands_of_numbered_lines_are_one_class(spark):
    """Lines that are all near one another through their neighbours: checked about once each, not pair by pair."""
    line = "Annual report of the company, page {:04d} of 9000, all rights reserved by the owner"
    rows = [(k, "\n".join(line.format(i) for i in range(k * 100, k * 100 + 100)) + f"\nshort {k}") for k in range(40)]
    began = time.time()
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"]) for r in line_dedup.with_lines_removed(documents(spark, rows)).collect()}
    assert got == {k: (101, 100 if k else 99) for k in range(40)} and time.time() - began < 200


def test_lines_of_a_repeated_id(spark):
    a, b = "a line that is long enough to be compared", "another line that is long enough as well"
    rows = [(5, a), (5, b), (5, a), (4, b + "!"), (-1, "x\n" + a), (7, "x"), (8, "")]
    got = line_dedup.with_lines_removed(documents(spark, rows)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(5, ""), (5, ""), (5, ""), (4, b + "!"), (-1, "x\n" + a), (7, ""), (8, "")])


URLS = ["https://example.org/WARC/1.1/", "http://a/WARC/1.0", "u: v", "a\r\nWARC/1.1\r\nContent-Length: 3", "\x00\x7f é\t", "", "x" * 5000, "WARC/1.1", "http://[::1]:80/?q=%0D%0A"]


def test_hostile_urls_and_large_payloads(spark, tmp_path):
    body = "z" * 1_500_000
    rows = [(i, u, f"page {i} " * 20) for i, u in enumerate(URLS)] + [(50, "u", body), (51, "u", body), (52, "u", "WARC/1.1\r\n\r\n" * 20)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    root = f"file://{tmp_path}/w"
    got = warc.read_archives(spark, root, warc.write_archives(warc.with_record_types(d), root)).collect()
    assert {r["kind"] for r in got} == {"record"}
    assert {(r["page_id"], r["payload_digest"], r["refers_to"]) for r in got} == {(i, hashlib.sha256(h.encode()).hexdigest(), 50 if i == 51 else None) for i, _, h in rows}


@pytest.mark.parametrize("pack", [gzip.compress, bytes])
def test_salvage_of_a_spoiled_archive_equals_the_untouched_rows(pack):
    parts = [pack(warc.record(i, "u", bytes([65 + i % 26]) * 2000, hashlib.sha256(bytes([65 + i % 26]) * 2000).hexdigest(), None)) for i in range(400)]
    rng = random.Random(0)
    bad = set(rng.sample(range(400), 60))
    data = b"".join(x if i not in bad else x[: len(x) // 2] + bytes([x[len(x) // 2] ^ 255]) + x[len(x) // 2 + 1 :] for i, x in enumerate(parts))
    out = list(warc.salvage(data))
    assert [r["page_id"] for r in out if r["kind"] == "record"] == [i for i in range(400) if i not in bad]
    assert sum(r["length"] for r in out) == len(data)


def test_salvage_takes_linear_time():
    rng = np.random.default_rng(0)
    noise = b"".join(rng.bytes(200) + (b"WARC/1.0\r\nx" if i % 2 else warc.MAGIC) for i in range(40_000))
    began = time.time()
    out = list(warc.salvage(noise))
    assert [r["kind"] for r in out] == ["gap"] and time.time() - began < 20


def test_strided_ids_are_dealt_evenly(spark):
    ids = np.arange(0, 1_600_000, 16)
    assert np.bincount(substring_dedup.id_bucket(ids, 64), minlength=64).max() < 2 * len(ids) / 64
    few = [-(1 << 62), -1, 0, 1, 16, 1 << 40]
    want = [r[0] for r in spark.createDataFrame([(x,) for x in few], "i long").select(F.xxhash64("i")).collect()]
    assert kernels.xxhash64_long(np.array(few)).tolist() == want


def test_windows_survive_small_flushes_and_unordered_ids(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "FLUSH", 10)
    rng = random.Random(1)
    common = " ".join(f"c{k}" for k in range(20))
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(15)) + " " + common) for i in (9, 3, -4, 7, 7)] + [(None, common)]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in substring_dedup.remove_repeats(documents(spark, rows)).collect()), key=str)
    assert got == sorted([(9, 20), (3, 20), (-4, 0), (7, 20), (7, 20), (None, 0)], key=str)


def test_a_text_of_one_repeated_word_sends_its_window_once(spark):
    """200,000 equal words have 199,988 windows and one hash; other texts lose what they share with it."""
    text = "w " * 200_000
    batch = pa.RecordBatch.from_arrays([pa.array([5, 9]), pa.array([text, "w " * 50])], ["doc_id", "text"])
    sent = [substring_dedup.unpack(x) for b in substring_dedup._windows_out(13, 16)([batch]) for x in b.column("block").to_pylist()]
    assert sum(len(h) for _, h, _ in sent) == 2
    got = substring_dedup.remove_repeats(documents(spark, [(5, text), (9, "w " * 50), (7, "a b")])).select("doc_id", "n_words", "n_removed").collect()
    assert sorted(map(tuple, got)) == [(5, 200_000, 0), (7, 2, 0), (9, 50, 50)]


def test_mixing_with_repeated_rows_and_odd_ids(spark):
    rows = [(i, "w " * n, s) for i, n, s in [(-5, 300, "a"), (-5, 300, "a"), (-5, 10, "b"), (None, 200, "b"), (None, 200, "b"), (0, 400, None)]]
    got = mixing.mix_counts(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=8 * mixing.BLOCK_WORDS)


def test_leak_ties_and_repeated_items(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    hurt = item.replace("quick", "quack")
    rows = [(1, f"{hurt} and {hurt}"), (1, f"{hurt} and {hurt}"), (2, f"{item} {item}")]
    b = spark.createDataFrame([(1, item), (1, item), (2, item)], "item_id long, text string")
    got = [(r["doc_id"], r["item_id"], r["distance"], r["start"]) for r in decontaminate.find_leaks(documents(spark, rows), b).collect()]
    assert sorted(got) == sorted([(1, i, 1, 0) for _ in range(2) for i in (1, 1, 2)] + [(2, i, 0, 0) for i in (1, 1, 2)])


def test_toxicity_of_repeated_rows(spark):
    rows = [(i, "bad worse word" if i % 3 == 0 else "fine good word") for i in range(120)] + [(3, "bad worse word"), (3, "bad worse word")]
    model = toxicity.train(documents(spark, rows), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int"))
    got = {(r["doc_id"], r["score"]) for r in toxicity.score(documents(spark, rows), model).where("doc_id = 3").collect()}
    assert len(got) == 1 and next(iter(got))[1] > 0.5


def test_vectors_with_ties_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    axis = [1.0] + [0.0] * 7
    rows = [(i, [1.0] + [0.0] * (i % 7) + [0.1] + [0.0] * (6 - i % 7), 1) for i in range(40)] + [(99, axis, 1), (98, axis, 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: (40, 0) for i in [*range(40), 99]} | {98: (0, 98)}
