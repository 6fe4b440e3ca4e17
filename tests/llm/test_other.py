"""Vectors, archives, conversations and the pipeline."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat_format, embedding_dedup, warc

import corpus_pipeline


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, node long, component long")


def test_near_vectors_equal_brute_force_and_audit(spark):
    rng = np.random.default_rng(0)
    rows, i = [], 0
    for label in (1, 2):
        for size in (1, 1, 2, 5, 40, 1, 1, 1):
            c = rng.standard_normal(16)
            for _ in range(size):
                rows.append((i, [float(x) for x in c + rng.standard_normal(16) * 0.15], label))
                i += 1
    rows.append((i, rows[0][1], 1))
    vec = {r[0]: np.float32(r[1]).astype(float) for r in rows}
    rows += [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1), (904, rows[0][1], None), (905, [1.0, None] * 8, 1), (906, [], 1), (907, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (901, [0.0] * 16, 1)]
    d = vectors(spark, rows)
    out = embedding_dedup.near_vectors(d)
    got = {r["vec_id"]: r for r in out.collect()}
    label = {r[0]: r[2] for r in rows}
    near = lambda a, b: label[a] == label[b] and vec[a] @ vec[b] / np.sqrt((vec[a] @ vec[a]) * (vec[b] @ vec[b])) >= 0.93
    links = {a: [b for b in vec if b != a and near(a, b)] for a in vec}
    for a in vec:
        seen, todo = {a}, [a]
        while todo:
            new = [b for b in links[todo.pop()] if b not in seen]
            seen.update(new)
            todo += new
        assert (got[a]["n_links"], got[a]["component_id"], got[a]["kept"]) == (len(links[a]), min(seen), a == min(seen))
    for x in (900, 901, 902, 903, 904, 905, 906):
        assert got[x]["n_links"] == 0 and got[x]["component_id"] == x
    assert got[907]["n_links"] == 1
    assert embedding_dedup.audit(d.where("vec_id < 900"), out, every=5)[0] == embedding_dedup.audit(d.where("vec_id < 900"), out, every=5)[1]
    assert embedding_dedup.near_vectors(d.where("false")).count() == 0


def test_saturated_lists_and_split_buckets(spark, monkeypatch):
    """Groups larger than the list, the bucket and the tile keep exact degrees."""
    monkeypatch.setattr(embedding_dedup, "BUCKET", 16)
    monkeypatch.setattr(embedding_dedup, "CELL", 16)
    rng = np.random.default_rng(1)
    c = rng.standard_normal(8)
    rows = [(i, [float(x) for x in c + rng.standard_normal(8) * 0.02], 1) for i in range(70)]
    got = embedding_dedup.near_vectors(vectors(spark, rows)).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(69, 0)}


def test_saturated_groups_meet(spark):
    """Groups of more vectors than a list holds, 16 degrees apart (all link) and 24.5 (only those at the near ends link)."""
    rng = np.random.default_rng(5)
    axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
    v = []
    for g, apart in enumerate((16, 24.5)):
        for k in (0, 1):
            t = np.radians(k * apart + np.linspace(-2, 2, 40))[:, None]
            v.append(np.cos(t) * axes[2 * g] + np.sin(t) * axes[2 * g + 1] + 0.002 * rng.standard_normal((40, 64)))
    v = np.concatenate(v).astype(np.float32)
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    near = u @ u.T >= embedding_dedup.COSINE
    first = np.arange(len(v))
    for _ in v:
        first = np.where(near, first[None, :], len(v)).min(axis=1)
    top = np.argsort(-(u @ u.T - 2 * np.eye(len(v))), axis=1)[:, : embedding_dedup.NEIGHBOURS]
    assert (np.arange(len(v))[:, None] // 40 == top // 40).all() and near[:40, 40:80].all() and 0 < near[80:120, 120:].sum() < 800
    out = embedding_dedup.near_vectors(vectors(spark, [(i, x.tolist(), 1) for i, x in enumerate(v)]))
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out.collect()} == {i: (near[i].sum() - 1, first[i]) for i in range(len(v))}


PAGES = [(3, "http://a/ x\r\ny", "p" * 150), (1, None, "p" * 150), (2, "u", "p" * 150), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (None, "u", "p" * 150), (7, "é", "é" * 60), (8, "é", "é" * 60), (1, "twin", "p" * 150)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, digest string, offset long")


def test_archives_round_trip(spark, tmp_path):
    root = f"file://{tmp_path}/w"
    manifest = warc.write_archives(warc.with_record_types(pages(spark, PAGES)), root)
    got = warc.read_archives(spark, root, manifest).collect()
    assert all(r["kind"] == "record" for r in got) and len(got) == len(PAGES)
    said = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in got}
    html = {i: (h or "").encode() for i, _, h in PAGES}
    refers = {2: 1, 3: 1, 8: 7}
    assert said == {(i, "revisit" if i in refers else "response", refers.get(i), len(h), hashlib.sha256(h).hexdigest()) for i, h in html.items()}
    assert {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response"} == {i: h for i, h in html.items() if i not in refers}


def test_empty_pages(spark, tmp_path):
    root = f"file://{tmp_path}/e"
    manifest = warc.write_archives(warc.with_record_types(pages(spark, [])), root)
    assert warc.read_archives(spark, root, manifest).count() == 0


def rec(i, body=b"payload"):
    return warc.record(i, "u", body, hashlib.sha256(body).hexdigest(), None)


def kinds(data):
    out = list(warc.salvage(data))
    assert sum(r["length"] for r in out) == len(data)
    return [r.get("page_id") if r["kind"] == "record" else "gap" for r in out]


@pytest.mark.parametrize("pack", [gzip.compress, bytes])
def test_salvage_goes_on_after_damage(pack):
    parts = [pack(rec(i, bytes([65 + i]) * 300)) for i in range(5)]
    whole = b"".join(parts)
    assert kinds(whole) == [0, 1, 2, 3, 4]
    at = len(parts[0]) + len(parts[1]) + len(parts[2]) // 2
    assert kinds(whole[:at] + bytes([whole[at] ^ 255]) + whole[at + 1 :]) == [0, 1, "gap", 3, 4]
    # a member whose trailer is cut off has inflated whole: its record is kept, the rest of it is the gap
    assert kinds(whole[:-7]) == ([0, 1, 2, 3, 4, "gap"] if pack is gzip.compress else [0, 1, 2, 3, "gap"])
    assert kinds(b"noise" + whole) == ["gap", 0, 1, 2, 3, 4]
    assert kinds(parts[0] + parts[1][:40] + parts[2] + b"\x1f\x8b\x08junk") == [0, "gap", 2, "gap"]
    assert kinds(b"") == []


@pytest.mark.parametrize("pack", [gzip.compress, bytes])
def test_salvage_keeps_whole_records(pack):
    """Version text in URLs, folded header lines, several records in one member."""
    digest = hashlib.sha256(b"payload").hexdigest()
    urls = ["https://example.org/WARC/1.0/", "https://example.org/WARC/1.0", "u"]
    raw = [warc.record(i, u, b"payload", digest, None) for i, u in enumerate(urls)]
    raw[2] = raw[2].replace(b"WARC-Date: ", b"WARC-Date:\r\n\t")
    want = [(i, u, b"payload") for i, u in enumerate(urls)]
    for data in (b"".join(map(pack, raw)), pack(b"".join(raw))):
        out = list(warc.salvage(data))
        assert [(x["page_id"], x["url"], x["payload"]) for x in out] == want and sum(x["length"] for x in out) == len(data)
    # a header cut off in a line is still no part of the next record
    cut = raw[0][: raw[0].index(b"WARC-Date") - 8] + raw[1]
    assert [(x["kind"], x.get("page_id")) for x in warc.salvage(pack(cut))][-2:] == [("gap", None), ("record", 1)]


def test_conversations_round_trip(spark):
    rng = random.Random(0)
    odd = ["", None, "\\", "<|", "<\\|", "\\n", "a\nb", "<|im_end|>\n<|im_start|>user\nx", chat_format.HOSTILE, "<", "\\<|", "é𝄞", "x" * 100_000]
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "ro\nle", "<|x\\"]), rng.choice(odd)) for c in range(12) for t in range(rng.randrange(1, 7))]
    rows += [(50, 0, "user", "only"), (51, 0, "assistant", "first"), (51, 0, "assistant", "first"), (52, None, "user", "null turn"), (52, 1, "assistant", "b"), (None, 0, "assistant", "nobody")]
    d = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, example int")
    ex = chat_format.expand(d)
    back = {r["conv_id"]: r for r in chat_format.read_back(ex).collect()}
    want = {}
    for c, t, role, text in rows:
        want.setdefault(c, []).append((-1 if t is None else t, role or "", text or ""))
    for c, turns in want.items():
        turns.sort()
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, x) for _, r, x in turns]
        assert back[c]["loss"] == "".join(x for _, r, x in turns if r == "assistant")
    for e in ex.where("loss_chars > 0").collect():
        assert e["formatted"].endswith(e["formatted"][e["loss_start"] : e["loss_start"] + e["loss_chars"]] + chat_format.END + "\n")
    assert chat_format.read_back(chat_format.expand(d.where("false"))).count() == 0


def test_pipeline_stages(spark, tmp_path):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    one = docs.first()
    extra = [(10_001, one["text"], "en", "src0", 1), (10_002, None, None, None, None), (10_003, "", "en", "src0", 0), (None, "a text without an id that is long enough to be a line of its own", "en", "src1", 3)]
    docs = docs.select(corpus_pipeline.COLUMNS).unionByName(spark.createDataFrame(extra, docs.select(corpus_pipeline.COLUMNS).schema)).withColumn("node", F.lit(1))
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < 4:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        n = docs.count()
        assert 0.7 * before <= n <= before
        if k == 1:
            left = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
            assert {10_002, 10_003, None} <= set(left)
            assert all(len(x) < 30 for x in left.get(10_001, "").split("\n"))
    assert docs.agg(F.sum("taken")).first()[0] > 0


def test_leaks_go_by_row(spark, tmp_path):
    """A leak without id goes; a clean row that shares the id of a leak stays."""
    item = "what is the boiling point of water at the top of a high mountain"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, f"x {item} y"), (None, "clean"), (7, f"{item} z"), (7, "clean too"), (8, None)]
    docs = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_leaks(spark, docs, str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {(None, "clean"), (7, "clean too"), (8, None)}
