"""Whitening against exact integers and numpy; weak supervision against per-document loops."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality_rules as Q
from tessera.llm import whitening as W

VECTORS = "vec_id long, embedding array<double>, label int, n long, x string"


def exact(rows, size):
    """Whitening by definition, of valid rows ``(id, integers)``."""
    fit = sorted({tuple(x) for _, x in rows})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    z = np.array([[(n * v - t) / n for v, t in zip(x, s)] for x in fit])
    v = z.T @ z / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    return n, e, np.trace(v), {x: (sum((n * a - t) ** 2 for a, t in zip(x, s)), np.array([(n * a - t) / n for a, t in zip(x, s)]) @ q) for x in fit}


@pytest.mark.parametrize("values,blocks", [(131_072, 1024), (40, 3)])
def test_whitening_equals_exact_integers(spark, monkeypatch, values, blocks):
    """In one block, and in blocks of 8 rows, three to a panel."""
    monkeypatch.setattr(W, "BLOCK_VALUES", values), monkeypatch.setattr(W, "BLOCKS", blocks), monkeypatch.setattr(W, "TASK_BLOCKS", 1)
    rng = np.random.default_rng(0)
    data = [(i, list(map(float, rng.normal(size=5) * [1, 2, 3, 4, 5]))) for i in range(80)]
    data += [(80, data[0][1]), (81, data[0][1]), (None, data[1][1]), (5, data[2][1])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0, 4.0]), (93, [math.nan] * 5), (94, [math.inf, 0.0, 0.0, 0.0, 0.0]), (95, [1.0, 2.0]), (96, [1e300] * 5)]
    d = spark.createDataFrame([(i, v, 1, 7, "y") for i, v in data + bad], VECTORS)
    got = W.whiten(d).collect()
    ints = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in data]
    n, e, total, want = exact(ints, 5)
    assert sorted(str(r["id"]) for r in got) == sorted(str(i) for i, _ in ints)
    by = {i: x for i, x in ints if i != 5}
    signs = None
    for r in got:
        if r["id"] == 5:
            continue
        dev, proj = want[by[r["id"]]]
        ratio = np.array(r["whitened"]) * np.sqrt(e) / proj
        signs = np.sign(ratio) if signs is None else signs
        assert r["n"] == n == 80 and r["deviation"] == dev and np.allclose(ratio, signs, atol=1e-9) and np.allclose(r["explained"], e / total, rtol=1e-9) and r["identity_error"] < 1e-10


def test_whitening_without_variance_and_with_large_entries(spark):
    make = lambda rows: spark.createDataFrame([(i, v, 0, 0, "") for i, v in enumerate(rows)], VECTORS)
    for rows in ([], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 5, [[]]):
        assert W.whiten(make(rows)).count() == 0
    flat = W.whiten(make([[float(i), 2.0 * i, 7.0] for i in range(10)])).collect()
    assert len(flat) == 10 and {len(r["whitened"]) for r in flat} == {1} and flat[0]["explained"] == pytest.approx([1.0])
    large = W.whiten(make([[1e15 * i, 1.0] for i in range(4)])).collect()
    assert len(large) == 4 and {r["deviation"] for r in large} == {None}
    mixed = W.whiten(make([[1.0], [2.0], [1.0, 2.0], [3.0, 1.0]])).select("id").collect()
    assert sorted(r["id"] for r in mixed) == [2, 3]


def stats_by_loops(text):
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)]


TEXTS = [None, "", " \t\n\v\f\r", "a", "a b c a b c", "x x x x", "l\nl\nl \n\n\n l\r\nl", "# * $ | <> %&", "é ü   ß　x", "\x1c\x1d a\x85b", "w " * 2_000 + "\n" + "line\n" * 500, "İ" * 50, "a b c d a b x b c d"]


def test_statistics_by_loops(spark):
    d = spark.createDataFrame([(i, t, i, "z") for i, t in enumerate(TEXTS)] + [(None, "a b", 0, "")], "doc_id long, text string, n_words int, quality string")
    got = {r["doc_id"]: list(r)[1:6] for r in Q.statistics(d).collect()}
    assert got == {i: stats_by_loops(t) for i, t in enumerate(TEXTS)} | {None: [2, 2, 0, 0, 0]}
    assert Q.judge(d.limit(0)).count() == 0
    assert Q.judge(d.unionByName(d)).count() == 2 * (len(TEXTS) + 1)


def posterior_by_loops(votes, rounds=400):
    """Expectation-maximisation document by document."""
    k, n = len(votes[0]), len(votes)
    strength = max(n * Q.PRIOR_SHARE, 1)
    a, b, odds = [Q.BAD_VOTE_ON_BAD] * k, [Q.GOOD_VOTE_ON_GOOD] * k, math.log(Q.GOOD_SHARE / (1 - Q.GOOD_SHARE))
    for _ in range(rounds):
        p = []
        for v in votes:
            s = odds
            for j, x in enumerate(v):
                s += math.log((1 - b[j]) / a[j]) if x == Q.BAD else math.log(b[j] / (1 - a[j])) if x == Q.GOOD else 0
            p.append(1 / (1 + math.exp(-s)))
        last = p
        mean = lambda hits, all_, prior: (sum(hits) + strength * prior) / (sum(all_) + strength)
        a = [mean([1 - q for q, v in zip(p, votes) if v[j] == Q.BAD], [1 - q for q, v in zip(p, votes) if v[j]], Q.BAD_VOTE_ON_BAD) for j in range(k)]
        b = [mean([q for q, v in zip(p, votes) if v[j] == Q.GOOD], [q for q, v in zip(p, votes) if v[j]], Q.GOOD_VOTE_ON_GOOD) for j in range(k)]
        share = mean(p, [1] * n, Q.GOOD_SHARE)
        odds = math.log(share / (1 - share))
    return last


def test_posterior_by_loops_and_labels(spark):
    """All documents of a given table: posteriors equal loops over documents, and agree with labels that were never seen."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rules = Q.default_rules()
    st = Q.statistics(d)
    model = Q.fit(st, rules)
    rows = st.select("doc_id", F.array(*[r.vote() for r in rules]).alias("v"), model.posterior().alias("p")).collect()
    assert np.allclose([r["p"] for r in rows], posterior_by_loops([r["v"] for r in rows]), atol=1e-6)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [(labels[r["doc_id"]], r["kept"]) for r in Q.judge(d).where("not base_failed").collect() if r["doc_id"] in labels]
    assert sum(kept for good, kept in judged if good) / sum(good for good, _ in judged) > 0.99
    assert sum(not kept for good, kept in judged if not good) / sum(not good for good, _ in judged) > 0.95


def test_rules_abstain_and_ties():
    odds, table = Q.fit_votes(np.zeros((1, 2), np.int64), np.array([5.0]))
    assert odds > 0 and (table[:, Q.ABSTAIN] == 0).all() and (table[:, Q.BAD] < 0).all() and (table[:, Q.GOOD] > 0).all()
    odds, _ = Q.fit_votes(np.zeros((0, 2), np.int64), np.zeros(0))
    assert odds == pytest.approx(math.log(4))
