"""Queries without SQL, against plain Python versions of their definitions."""

import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, langid, line_dedup, mixing, ngram_jaccard, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def made_up(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) for _ in range(n))


# toxicity


def byte_words(text):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return re.findall(rb"[a-z\x80-\xff]+", low)


def maximal(s, lo, hi):
    """The best segment, then what is left of it and right of it."""
    best = max(((sum(s[a:b]), a - b, a, b) for a in range(lo, hi) for b in range(a + 1, hi + 1)), default=(0,))
    if best[0] <= 0:
        return []
    total, _, a, b = best
    return maximal(s, lo, a) + [total] + maximal(s, b, hi)


def plain_scores(rows, labels, law):
    """Scores by counts in dictionaries, the definition of segments, and the law given."""
    counts = [{}, {}, {}]
    for i, text in rows:
        if i in labels and zlib.crc32(str(i).encode()) % 5 not in (0, 4):
            for w in byte_words(text):
                for level, (size, _) in enumerate(toxicity.LEVELS):
                    n = counts[level].setdefault(w[: size or None], [0, 0])
                    n[0] += labels[i]
                    n[1] += 1
    base = sum(a for a, _ in counts[2].values()) / sum(b for _, b in counts[2].values())

    def odds(w):
        p = base
        for (size, _), level, strength in zip(toxicity.LEVELS, counts, toxicity.PRIOR):
            n1, n = level.get(w[: size or None], (0, 0))
            p = (n1 + strength * p) / (n + strength)
        return math.log(p / (1 - p)) - math.log(base / (1 - base))

    out = []
    for i, text in rows:
        s = [odds(w) - law["drift"] for w in byte_words(text)]
        found = maximal(s, 0, len(s))
        each = [law["lam"] * x - math.log(law["k"] * max(len(s), 1)) for x in found]
        strong = sum(x for x in each if x > -math.log(toxicity.SIGNIFICANT))
        z = strong or max([0.0, *each])
        out.append((i, 1 / (1 + math.exp(-(law["a"] * z + law["b"])))))
    return out


def toxic_rows(rng, n):
    rows = []
    for i in range(n):
        w = made_up(rng, rng.randrange(1, 40), PLAIN).split()
        for _ in range(3 * (i % 4 == 0)):
            w.insert(rng.randrange(len(w) + 1), rng.choice(["grumble", "grumbler", "Snarl", "pfüü"]))
        rows.append((i, " ".join(w)))
    return rows, {i: int(i % 4 == 0) for i in range(n)}


PLAIN = ["river", "stone", "walk", "walked", "blue", "green", "house", "quiet", "grum", "morning", "über", "fields"]


def test_toxicity_equals_plain_python(spark):
    rows, labels = toxic_rows(random.Random(1), 200)
    rows += [(900, None), (901, ""), (902, "12 34"), (7, rows[7][1]), (8, rows[0][1])]
    model = toxicity.train(documents(spark, rows), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    got = sorted((r["doc_id"], r["score"]) for r in toxicity.score(documents(spark, rows), model).collect())
    want = sorted(plain_scores(rows, labels, model["law"]))
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [x for _, x in got] == pytest.approx([x for _, x in want], abs=1e-5)


def test_the_drift_is_chosen_without_the_held_out_fold(spark):
    rows, labels = toxic_rows(random.Random(2), 200)
    d = documents(spark, rows)
    law = toxicity.train(d, spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))["law"]
    other = {i: 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y for i, y in labels.items()}
    assert toxicity.train(d, spark.createDataFrame(list(other.items()), "doc_id long, toxic int"))["law"] == law


# decontamination


def least_distance(item, text):
    """Least edits of ``item`` to a substring of ``text``, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return min(row)


def leak_rows(rng, items, n):
    rows = []
    for i in range(n):
        t = list(made_up(rng, rng.randrange(5, 40), PLAIN))
        if i % 2:
            body = list(rng.choice(items))
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(body))
                body[at : at + rng.randrange(0, 2)] = rng.choice(["", "q", "q"])
            at = rng.randrange(len(t))
            t[at:at] = body
        rows.append((i, "".join(t)))
    return rows


@pytest.mark.parametrize("pass_chars", [4_000_000, 200])
def test_leaks_equal_dynamic_programming(spark, pass_chars):
    rng = random.Random(3)
    items = [made_up(rng, n, PLAIN) for n in (14, 14, 9, 6, 3)]
    items += [items[0], items[1] + " and more"]  # a repeated item, and one that holds another
    rows = leak_rows(rng, items, 40) + [(90, f"{items[2]} x {items[2]}"), (90, "walk"), (91, None), (92, " "), (None, items[3])]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(documents(spark, rows), b, pass_chars=pass_chars).collect()}
    want = set()
    for i, t in rows:
        for k, item in enumerate(items):
            n = least_distance(item, decontaminate.normal(t or ""))
            if n <= int(len(item) * decontaminate.RATE):
                want.add((i, k, n))
    assert got == want and len({n for *_, n in want}) > 2


# language


def plain_trigrams(text):
    b = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in (text or "").encode()]
    b = [32, *b, 32]
    return [(((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 2654435769) & 0xFFFFFFFF) >> (32 - langid.BITS) for i in range(1, len(b) - 1) if b[i] != 32]


def plain_language(text, model):
    """Proportions by expectation-maximisation over nested sets of languages, one trigram at a time."""
    f = plain_trigrams(text)
    m = len(model)
    if not f:
        return [0.0] * m
    p = [[row[x] for row in model] for x in f]
    single = [sum(math.log(q[k]) for q in p) for k in range(m)]
    best = max(range(m), key=lambda k: (single[k], -k))
    value, out = single[best], [float(k == best) for k in range(m)]

    def em(allowed):
        pi = [1 / len(allowed) if k in allowed else 0.0 for k in range(m)]
        for _ in range(langid.ROUNDS):
            new = [0.0] * m
            for q in p:
                mass = sum(a * b for a, b in zip(pi, q))
                for k in range(m):
                    new[k] += pi[k] * q[k] / mass
            pi = [x / sum(new) for x in new]
        return pi, sum(math.log(sum(a * b for a, b in zip(pi, q))) for q in p)

    price = langid.PENALTY * math.log(max(len(f), 2))
    full, gain = em(range(m))
    order = sorted(range(m), key=lambda k: (-full[k], k))
    for n in range(2, m + 1):
        if gain - price * (n - 1) <= value:
            break
        pi, like = em(order[:n])
        if like - price * (n - 1) > value:
            value, out = like - price * (n - 1), pi
    return out


SYLLABLES = {"aa": ["ka", "to", "mi", "ru"], "bb": ["sch", "eln", "ung", "ver"], "cc": ["eau", "oux", "ier", "qué"], "dd": ["ska", "ёж", "ты", "ru"]}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))


@pytest.mark.parametrize("langs", [["aa"], ["aa", "bb", "cc", "dd"]])
def test_languages_equal_plain_python(spark, langs, monkeypatch):
    monkeypatch.setattr(langid, "CELLS", 4000)  # a few texts at once
    rng = random.Random(5)
    train = [(i, spoken(rng, langs[i % len(langs)], rng.randrange(2, 30)), langs[i % len(langs)]) for i in range(60)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    table = []
    for lang in langs:
        n = [langid.ALPHA] * (1 << langid.BITS)
        for _, t, x in train:
            for f in plain_trigrams(t) if x == lang else ():
                n[f] += 1
        table.append([x / sum(n) for x in n])
    tests = [spoken(rng, rng.choice(langs), rng.randrange(1, 30)) for _ in range(20)]
    tests += [spoken(rng, langs[0], 30) + " " + spoken(rng, langs[-1], 25), " ".join(spoken(rng, x, 20) for x in langs), tests[0], "", "42", None]
    got = {r["doc_id"]: r for r in langid.detect(documents(spark, list(enumerate(tests))), model).collect()}
    for i, t in enumerate(tests):
        pi = plain_language(t, table)
        top = max(range(len(langs)), key=lambda k: (pi[k], -k))
        known = sum(pi) > 0
        assert got[i]["lang_pred"] == (langs[top] if known else "und")
        assert got[i]["score"] == pytest.approx(pi[top] if known else 0, abs=1e-6)
        assert got[i]["mixture"] == pytest.approx({x: v for x, v in zip(langs, pi) if v > 0.005}, abs=1e-6)


# pipeline


def near_lines(a, b):
    return min(len(a), len(b)) >= line_dedup.MIN_CHARS and abs(len(a) - len(b)) <= line_dedup.EDITS and least_distance(a, b) <= line_dedup.EDITS and edits(a, b) <= line_dedup.EDITS


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def classes(n, linked):
    root = list(range(n))
    for a in range(n):
        for b in range(a):
            if root[a] != root[b] and linked(a, b):
                old = root[a]
                root = [root[b] if x == old else x for x in root]
    return root


def plain_line_dedup(rows):
    lines = sorted({x for r in rows for x in (r[1] or "").split("\n") if WORD.search(x)})
    root = dict(zip(lines, classes(len(lines), lambda a, b: near_lines(lines[a], lines[b]))))
    first = {}
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for p, x in enumerate((t or "").split("\n")):
            if x in root:
                first.setdefault(root[x], (i, p))
    out = []
    for i, t, *rest in rows:
        kept = [x for p, x in enumerate(t.split("\n")) if x not in root or first[root[x]] == (i, p)] if t is not None else None
        text = t if kept is None or len(kept) == t.count("\n") + 1 else "\n".join(kept)
        if text == t or WORD.search(text):
            out.append((i, text, *rest[:-1], rest[-1] if text == t else len(text)))
    return out


def plain_document_dedup(rows):
    rows = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for r in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = classes(len(rows), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]))
    return [r for k, r in enumerate(rows) if root.index(root[k]) == k]


def test_pipeline_equals_brute_force(spark, tmp_path):
    rng = random.Random(7)
    bad, labels = toxic_rows(rng, 80)
    items = [made_up(rng, 10, PLAIN) for _ in range(3)]
    base = [made_up(rng, 60, [a + b for a in PLAIN for b in PLAIN]) for _ in range(6)]
    rows = [(i, t) for i, t in bad] + [(100 + i, t) for i, t in leak_rows(rng, items, 20)]
    for k, t in enumerate(base):
        w = t.split()
        rows += [(200 + k, t), (300 + k, " ".join([*w[:-2], "other", "end"])), (400 + k, t + "\nall rights are reserved by the authors 2020"), (500 + k, "short line\nall rights are reserved by the author 2021\n" + " ".join(w[::-1]))]
    rows += [(200, base[0]), (201, base[0][::-1]), (600, None), (601, ""), (None, base[1] + " x"), (602, "short line")]
    table = [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    label_rows = spark.createDataFrame([(i, 1, y) for i, y in labels.items()], "doc_id long, quality int, toxic int")
    label_rows.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    law = toxicity.train(documents(spark, rows), label_rows)["law"]
    left = [r for r, (_, s) in zip(table, plain_scores(rows, labels, law)) if s < 0.5]
    assert 15 <= len(table) - len(left) <= 40
    left = plain_line_dedup(left)
    left = plain_document_dedup(left)
    clean = [r for r in left if not any(least_distance(x, decontaminate.normal(r[1] or "")) <= int(len(x) * decontaminate.RATE) for x in items)]
    assert len(clean) < len(left)
    want = sorted(((r[0], len(WORD.findall(r[1] or ""))) for r in clean), key=str)
    assert sorted(((r["doc_id"], r["size"]) for r in got), key=str) == want
    sizes = {}
    for r in clean:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1] or ""))
    targets, open_ = {}, {s: w for s, w in zip(sorted(sizes), (5, 2, 1))}
    budget = 1.5 * sum(sizes.values())
    while open_:
        over = [s for s, w in open_.items() if (budget - sum(targets.values())) * w / sum(open_.values()) > 2 * sizes[s]]
        if not over:
            left_over, total = budget - sum(targets.values()), sum(open_.values())
            targets |= {s: left_over * w / total for s, w in open_.items()}
            break
        for s in over:
            targets[s] = 2 * sizes[s]
            open_.pop(s)
    assert {r["source_size"]: r["target"] for r in got} == pytest.approx({sizes[s]: t for s, t in targets.items()})
    for s, t in targets.items():
        assert abs(sum(r["taken"] for r in got if r["source_size"] == sizes[s]) - t) <= 8 * mixing.BLOCK_WORDS
    assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_rows_that_share_an_id_live_apart(spark):
    rng = random.Random(8)
    a, b = (made_up(rng, 40, [x + y for x in PLAIN for y in PLAIN]) for _ in range(2))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, None), (3, None), (4, a), (4, a), (None, a + " z"), (None, "alone")]
    out = corpus_pipeline.dedup_documents(spark, documents(spark, rows), "x").collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted([(1, a), (2, b), (3, None), (None, "alone")], key=str)


def test_rows_whose_keys_clash_are_told_apart(spark, tmp_path, monkeypatch):
    """With a key of two bits nearly all rows clash: no row goes but those that a full key would drop."""
    rng = random.Random(9)
    a, b, c = (made_up(rng, 40, [x + y for x in PLAIN for y in PLAIN]) for _ in range(3))
    item = "the quick brown fox jumps over the lazy dog again and again"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = documents(spark, [(i, t) for i, t in enumerate([a, b, c, f"{a} {item}", f"{b} {item} {c}", b + " more", c + " again"])] + [(1, b), (None, item)])
    want = sorted(map(str, corpus_pipeline.drop_leaks(spark, rows, str(tmp_path)).collect()))
    assert len(want) == 6
    monkeypatch.setattr(corpus_pipeline, "row_key", lambda: F.coalesce(F.col("doc_id"), F.lit(0)) % 3)
    assert sorted(map(str, corpus_pipeline.drop_leaks(spark, rows, str(tmp_path)).collect())) == want
    kept = [r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, rows, str(tmp_path)).collect()]
    assert len(kept) == 8 and sorted(set(kept), key=str) == sorted([*range(7), None], key=str)


def test_stages_can_be_composed_and_run_side_by_side(spark, tmp_path):
    """One stage reads another's unread result; two runs over one folder do not touch each other's tables."""
    from concurrent.futures import ThreadPoolExecutor

    rng = random.Random(10)
    texts = [made_up(rng, 60, [x + y for x in PLAIN for y in PLAIN]) for _ in range(30)]
    documents(spark, [(i, texts[i % 25]) for i in range(30)]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, texts[3][:60])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d = spark.read.parquet(f"{tmp_path}/documents.parquet")
    out = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, str(tmp_path))
    whole = sorted(r["doc_id"] for r in out.collect())
    assert whole == [i for i in range(25) if i != 3]
    with ThreadPoolExecutor(2) as pool:
        for got in pool.map(lambda _: corpus_pipeline.run(spark, str(tmp_path)).collect(), range(2)):
            assert sorted(r["doc_id"] for r in got) == whole


def test_pipeline_of_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_scratch_of_unread_results_stays(spark):
    from tessera.core import scratch_scope

    d = documents(spark, [(1, "a b c d e f"), (2, "a b c d e f")])
    with scratch_scope():
        x = ngram_jaccard.jaccard_components(d)
        with scratch_scope():
            assert mixing.mix_counts(d).agg(F.count("*")).first()[0] == 2
        assert {r["component_id"] for r in x.collect()} == {1}
