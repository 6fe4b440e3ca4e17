"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and white space is collapsed. An item of length L may be found with up to
``floor(L * rate)`` edits. It is split into one piece more than that, so at least one piece occurs unchanged
in any match. One Aho-Corasick pass over each text finds all piece hits; hits of an item on nearby diagonals share
a window, and Myers' bit-parallel distance decides it.

The items of one pass are a bounded batch (PASS_CHARS); a larger benchmark takes several passes over the texts.

Defined results: null and blank texts match nothing; null and blank items are ignored; items below
``1 / rate`` characters match exactly only; repeated items are separate items, repeated rows are found each for itself; a null doc_id is carried; of equally near places the first is given; a very long text is
searched whole by one task, window by window; other columns are not read; empty texts, items or tables give no row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import by_value

RATE = 0.05
PASS_CHARS = 4_000_000
OUT = "doc_id long, item_id long, distance int, budget int, start long, stop long"


def normal(text: str) -> str:
    return " ".join(text.lower().split())


def pieces(item: str, budget: int):
    """``budget + 1`` pieces of nearly equal length with their offsets."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(cuts[i], item[cuts[i] : cuts[i + 1]]) for i in range(n) if cuts[i + 1] > cuts[i]]


def myers(pattern: str, text: str):
    """Least edit distance of ``pattern`` to a substring of ``text`` and where that substring ends (first such)."""
    m = len(pattern)
    where: dict = {}
    for i, ch in enumerate(pattern):
        where[ch] = where.get(ch, 0) | (1 << i)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = mask, 0, m
    best, end = m, 0
    for i, ch in enumerate(text):
        eq = where.get(ch, 0)
        x = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | ~(x | up), up & x
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        x2 = eq | down
        up, down = (minus | ~(x2 | plus)) & mask, plus & x2
        if score < best:
            best, end = score, i + 1
    return best, end


def _scan(items: list, rate: float):
    def run(batches):
        import ahocorasick

        known, words = {}, {}
        for item_id, raw in items:
            text = normal(raw)
            if text:
                budget = int(len(text) * rate)
                key = len(known)
                known[key] = (item_id, text, budget, text[::-1])
                for at, piece in pieces(text, budget):
                    words.setdefault(piece, []).append((key, at))
        auto = ahocorasick.Automaton()
        for piece, use in words.items():
            auto.add_word(piece, (len(piece), use))
        if words:
            auto.make_automaton()
        for b in batches:
            rows = []
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                if not raw or not words:
                    continue
                text = normal(raw)
                diagonals: dict = {}
                for last, (size, use) in auto.iter(text):
                    for key, at in use:
                        diagonals.setdefault(key, []).append(last + 1 - size - at)
                for key, found in diagonals.items():
                    item_id, item, budget, back = known[key]
                    best, tried = None, None
                    for d in sorted(set(found)):
                        if text.startswith(item, d) and d >= 0:
                            best = (0, d, d + len(item))
                            break
                    windows: list = []
                    for d in sorted(set(found)) if best is None and budget else ():
                        if windows and d - windows[-1][1] <= budget:
                            windows[-1][1] = d
                        else:
                            windows.append([d, d])
                    for a, z in windows:
                        lo, hi = max(0, a - budget), z + len(item) + budget
                        distance, end = myers(item, text[lo:hi])
                        if distance <= budget and (best is None or distance < best[0]):
                            stop = lo + end
                            tried = myers(back, text[max(0, stop - len(item) - budget) : stop][::-1])
                            best = (distance, stop - tried[1], stop)
                    if best is not None:
                        rows.append((doc_id, item_id, best[0], budget, best[1], best[2]))
            if rows:
                cols = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "item_id", "distance", "budget", "start", "stop"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, pass_chars: int = PASS_CHARS) -> DataFrame:
    """One row per text and item found: the least distance, the item's budget, and where (in the normalised text)."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    passes = max(1, -(-2 * total // pass_chars) if total > pass_chars else 1)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for k in range(passes):
        batch = items if passes == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k)
        found = d.mapInArrow(_scan([(r["item_id"], r["text"]) for r in batch.collect()], rate), OUT)
        out = found if out is None else out.unionByName(found)
    return out


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


by_value(__name__)
