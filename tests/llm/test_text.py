"""Text operators against brute force, and their edge cases: nulls, blanks, long texts, repeats, empty tables, clashing columns."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, line_dedup, mixing, ngram_jaccard, substring_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, component long, k long, score double, row long, size long"


def documents(spark, rows):
    """Rows (doc_id, text[, lang, source]) with columns whose names operators use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None, 1, 2, 3, 0.5, 4, 5) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(rng, n, vocab=40):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    base = [words(rng, rng.randrange(1, 60), 400) for _ in range(25)]
    rows = list(enumerate(base))
    for i in range(30):
        w = rng.choice(base).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9)}"
        rows.append((100 + i, ("\n" if i % 3 else " ").join(w).upper() if i % 4 == 0 else " ".join(w)))
    rows += [(7, base[7]), (7, base[8]), (200, None), (201, ""), (202, " \t\r\n\x0b\x0c "), (None, base[3]), (203, "one two"), (204, "ONE two one two"), (205, "one\ttwo"), (206, words(rng, 20000, 5000))]
    return rows


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_components_equal_brute_force(spark, corpus, monkeypatch, small):
    if small:  # blocks in tiles, trees for all but pairs, ids joined instead of broadcast
        for name, value in (("NEAR", 4), ("TILE", 3), ("ALL", 2), ("LEAF", 2), ("BROADCAST_IDS", 0)):
            monkeypatch.setattr(ngram_jaccard, name, value)
    sets = [(i, shingles(t)) for i, t in corpus]
    parent = list(range(len(sets)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, (ia, sa) in enumerate(sets):
        for b, (ib, sb) in enumerate(sets[:a]):
            if ia is not None and ib is not None and sa and sb and (100 * len(sa & sb) >= 75 * len(sa | sb)):
                parent[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(sets):
        if i is not None:
            low[find(a)] = min(i, low.get(find(a), i))
    want = sorted(((i, len(s), None if i is None else low[find(a)]) for a, (i, s) in enumerate(sets)), key=str)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_jaccard.jaccard_components(documents(spark, corpus)).collect()), key=str)
    assert got == want


def test_tree_join_finds_every_pair_over_the_bound():
    import numpy as np

    rng = np.random.default_rng(0)
    points = rng.integers(0, 3, (60, 16)).astype(np.uint16)
    points[30:] = np.maximum(points[:30] + rng.integers(-1, 2, (30, 16)) * (rng.random((30, 16)) < 0.1), 0)
    sizes = points.sum(axis=1).astype(np.int64)
    a, b = ngram_jaccard.tree_join(points, sizes, 75, 100)
    want = {frozenset((i, j)) for i in range(60) for j in range(i) if np.minimum(points[i], points[j]).sum() * 175 >= 75 * (sizes[i] + sizes[j])}
    assert {frozenset(p) for p in zip(a.tolist(), b.tolist())} == want


def test_tree_prunes_boxes_of_unlike_groups():
    import numpy as np

    rng = np.random.default_rng(0)
    centre = rng.poisson(1.5, (64, 256))
    points = np.repeat(centre, 32, axis=0) + (rng.random((2048, 256)) < 0.02)
    points = points[rng.permutation(len(points))].astype(np.uint16)
    seen: list = []
    a, _ = ngram_jaccard.tree_join(points, points.sum(axis=1).astype(np.int64), 75, 100, seen)
    assert len(a) == 64 * 32 * 31 // 2
    shares = [kept / pairs for pairs, kept in seen]
    assert shares[-2] < 0.25  # box pairs above the points: unlike groups part
    assert sum(pairs for pairs, _ in seen) < 0.2 * 2048 * 2047 / 2


def cut(rows, width):
    first = {}
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in docs:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in docs:
        gone = {p for k in range(len(w) - width + 1) if i is not None and first[tuple(w[k : k + width])] < i for p in range(k, k + width)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


def test_substring_cuts_equal_brute_force(spark, corpus):
    d = substring_dedup.remove_repeats(documents(spark, corpus), width=6)
    rows = d.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in rows), key=str) == cut(corpus, 6)
    for r in rows:
        spans = [(s["start"], s["end"]) for s in r["removed"]]
        assert sum(b - a for a, b in spans) == r["n_removed"] and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        k, what = rng.randrange(len(s)), rng.randrange(3)
        s[k : k + 1] = [[], [rng.choice("abé")], [s[k], rng.choice("abé")]][what]
        s = s or ["a"]
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_banded_automaton_equals_dynamic_programming(spark, edits):
    rng = random.Random(edits)
    pairs = [("", ""), ("", "a"), ("ab", ""), ("", "abcd")]
    for _ in range(150):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(1, 14)))
        pairs.append((a, edited(rng, a, rng.randrange(0, edits + 3))))
    d = spark.createDataFrame(pairs, "a string, b string").select("a", "b", line_dedup.within_edits(F.col("a"), F.col("b"), edits).alias("ok"))
    assert [(r["a"], r["b"]) for r in d.collect() if r["ok"] != (distance(r["a"], r["b"]) <= edits)] == []


@pytest.mark.parametrize("all_hot", [False, True])
def test_line_dedup_equals_brute_force(spark, monkeypatch, all_hot):
    if all_hot:  # every signature that two lines share goes by longer ones
        monkeypatch.setattr(line_dedup, "SAMPLE", 1)
        monkeypatch.setattr(line_dedup, "HOT_LEAST", 2)
    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(30, 50))) for _ in range(12)]
    rows = [(i, "\n".join(edited(rng, rng.choice(base), rng.randrange(0, 4)) if rng.random() < 0.8 else "short" for _ in range(rng.randrange(1, 6)))) for i in range(30)]
    rows += [(90, None), (91, ""), (92, "\n \n\t"), (95, " \n"), (93, base[0] * 2000), (94, base[0] * 2000), (3, rows[3][1])]
    lines = sorted({x for _, t in rows for x in (t or "").split("\n") if x.strip()})
    comp = {x: x for x in lines}
    for a in lines:
        for b in lines:
            if a < b and abs(len(a) - len(b)) <= 2 and 30 <= min(len(a), len(b)) < 1000 and distance(a, b) <= 2 and comp[a] != comp[b]:
                old, new = comp[b], comp[a]
                comp = {k: new if v == old else v for k, v in comp.items()}
    first = {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        for p, x in enumerate((t or "").split("\n")):
            if x in comp:
                first.setdefault(comp[x], (i, p))
    want = sorted(((i, None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if x not in comp or first[comp[x]] == (i, p))) for i, t in rows), key=str)
    got = line_dedup.with_lines_removed(documents(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want


def test_myers_equals_dynamic_programming():
    rng = random.Random(1)
    for _ in range(80):
        p, t = ("".join(rng.choice("ab") for _ in range(rng.randrange(1, n))) for n in (9, 20))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        best, end = decontaminate.myers(p, t)
        assert best == min(row) and row[end] == best


def test_leaks_within_the_budget_are_found(spark):
    rng = random.Random(2)
    items = [words(rng, 30, 3000) for _ in range(4)] + ["", None, "tiny"]
    hurt = list(items[1])
    hurt[10], hurt[60] = "Q", "Q"
    rows = [(1, f"before  {items[0].upper()}\nafter"), (2, "x " + "".join(hurt) + " y"), (3, words(rng, 60, 3000)), (4, None), (5, ""), (None, items[2]), (6, words(rng, 30000, 3000) + " " + items[3]), (1, "other")]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for size in (4_000_000, 300):
        got = decontaminate.find_leaks(documents(spark, rows), b, pass_chars=size).collect()
        assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == {(1, 0, 0), (2, 1, 2), (None, 2, 0), (6, 3, 0)}
    at = next(r for r in got if r["doc_id"] == 1)
    assert decontaminate.normal(rows[0][1])[at["start"] : at["stop"]] == items[0]


def test_segments_are_the_maximal_ones():
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(60):
        s = rng.integers(-4, 5, 14).astype(float)

        def split(lo, hi):
            """Ruzzo and Tompa's definition: the best segment, then both sides of it."""
            best = max(((s[a:b].sum(), -(b - a), a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
            if best[0] <= 0:
                return []
            _, _, a, b = best
            return split(lo, a) + [(a, b, s[a:b].sum())] + split(b, hi)

        assert sum(x for *_, x in toxicity.segments(s)) == pytest.approx(sum(x for *_, x in split(0, len(s))))


def bad_text(rng, toxic):
    w = words(rng, rng.randrange(5, 60), 200).split()
    for _ in range(4 * toxic):
        w.insert(rng.randrange(len(w)), rng.choice(["grumble", "grumbler", "snarl"]))
    return " ".join(w)


def test_toxicity_learns_and_keeps_its_fold_out(spark):
    rng = random.Random(4)
    rows = [(i, bad_text(rng, i % 4 == 0)) for i in range(300)] + [(900, None), (901, ""), (None, "snarl snarl snarl snarl"), (902, words(rng, 20000, 200)), (903, "grumbly grumbled snarls grumbles")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)] + [(5, None), (None, 1), (4, 1)], "doc_id long, toxic int")
    d = documents(spark, rows)
    model = toxicity.train(d, labels)
    got = {r["doc_id"]: r for r in toxicity.score(d, model).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i]["score"] >= 0.5) == (i % 4 == 0) for i in held) >= 0.95 * len(held)
    assert got[900]["score"] < 0.5 and got[901]["score"] < 0.5 and got[902]["score"] < 0.5 and got[None]["score"] >= 0.5 and got[903]["score"] >= 0.5
    assert got[None]["segments"] and not got[901]["segments"]


def test_toxicity_without_labels(spark):
    d = documents(spark, [(1, "a b")])
    assert toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int")) is None
    assert toxicity.score(d, None).first()["score"] == 0


def sample(rng, lang, n):
    parts = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "eln", "ung", "ver"], "cc": ["eau", "oux", "ier", "que"]}[lang]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_languages_and_mixtures(spark):
    rng = random.Random(6)
    rows = [(i, sample(rng, ("aa", "bb", "cc")[i % 3], rng.randrange(3, 60)), ("aa", "bb", "cc")[i % 3]) for i in range(150)]
    model = langid.train(documents(spark, [*rows, (None, "zz", None), (1, None, "aa")]))
    test = [(0, sample(rng, "bb", 40)), (1, sample(rng, "aa", 60) + " " + sample(rng, "cc", 30)), (2, None), (3, ""), (4, "123 !?"), (None, sample(rng, "cc", 20)), (5, sample(rng, "bb", 30000)), (0, "ка")]
    got = langid.detect(documents(spark, test), model).collect()
    by = {(r["doc_id"], r["lang_pred"]): r for r in got}
    assert by[(0, "bb")]["score"] == 1 and (5, "bb") in by and (None, "cc") in by
    assert 0.5 < by[(1, "aa")]["score"] < 0.9 and set(by[(1, "aa")]["mixture"]) == {"aa", "cc"}
    for i in (2, 3, 4):
        assert by[(i, "und")]["score"] == 0


def test_no_training_rows_is_undetermined(spark):
    d = documents(spark, [(1, "abc", None)])
    assert langid.detect(d, langid.train(d)).first()["lang_pred"] == "und"


def test_mix_meets_targets_and_repeats_at_most_twice(spark):
    rng = random.Random(8)
    rows = [(i, words(rng, rng.choice([1, 20, 400, 3000])), "en", rng.choice(["hot", "hot", "hot", "b", "c", None])) for i in range(120)] + [(500, None, "en", "b"), (500, "", "en", "b"), (None, words(rng, 50), "en", "z")]
    got = mixing.mix_counts(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    targets = {r["source_size"]: r["target"] for r in got}
    for size, target in targets.items():
        taken = sum(r["taken"] for r in got if r["source_size"] == size)
        assert target <= 2 * size and abs(taken - target) <= 8 * mixing.BLOCK_WORDS
    assert sum(targets.values()) == pytest.approx(1.5 * sum(r["size"] for r in got))
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_counts(documents(spark, rows)).collect()))


def test_schedule_is_spread_evenly(spark):
    rng = random.Random(9)
    rows = [(i, words(rng, 500), "en", "ab"[i % 2]) for i in range(40)]
    pieces, _, sources = mixing.mix_schedule(documents(spark, rows))
    share = {r["s"]: r["hi"] - r["lo"] for r in sources.collect()}
    first = [r["s"] for r in pieces.select("slot", "s").distinct().where("slot < 100").collect()]
    for s, p in share.items():
        assert abs(first.count(s) - 100 * p) <= 4


def test_empty_tables(spark):
    d = documents(spark, [])
    b = spark.createDataFrame([], "item_id long, text string")
    assert ngram_jaccard.jaccard_components(d).count() == 0
    assert substring_dedup.remove_repeats(d).count() == 0
    assert line_dedup.with_lines_removed(d).count() == 0
    assert mixing.mix_counts(d).count() == 0
    assert decontaminate.find_leaks(d, b).count() == 0
    assert decontaminate.find_leaks(documents(spark, [(1, "a")]), b).count() == 0
    assert langid.detect(d, langid.train(d)).count() == 0
    assert toxicity.score(d, toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))).count() == 0
