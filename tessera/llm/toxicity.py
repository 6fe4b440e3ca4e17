"""Toxicity by maximum-scoring segments of token log-odds.

Log-odds of words (toxic against other labelled texts) have Dirichlet priors in three levels: a word's prior is
the estimate of its first six bytes, theirs that of the first four, theirs the class shares. So an unseen
form of a known stem still scores. Each token scores its log-odds less a drift, so that ordinary text drifts
down (of DRIFTS the one with the best likelihood on the calibrating texts); one linear scan (Ruzzo & Tompa 1999) finds all maximal segments. Under the extreme-value law a clean text
of n tokens has about ``K n exp(-lambda S)`` segments of score S by chance; K and lambda are fitted on
clean labelled texts that the log-odds did not see. The evidence of a text without a segment is 0, that of another is the sum of ``lambda S - log(K n)`` over its significant segments (that of its best one, if none is), and a logistic curve fitted on the same texts turns it into a score.

The labelled sample is at most MAX_LABELED rows in expectation (chosen by hash of the id; a parameter), so it
can be broadcast; scoring covers every text whole.

Defined results: null or empty text has no tokens and takes the score of the least evidence; null ids are scored and never learned
from; several labels of one id: the largest; no labelled rows, or one class only: score 0 for all; very long texts are scored whole, in
linear time; repeated rows score alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import by_value
from tessera.llm import kernels as K

MAX_LABELED = 40_000
#: Prefix bytes (0: the whole word) and table bits of each level; prior strength; drifts per token to choose from.
LEVELS = ((4, 18), (6, 18), (0, 20))
PRIOR = (20.0, 8.0, 4.0)
DRIFTS = (0.5, 1.0, 2.0, 3.0)
SIGNIFICANT = 0.05


def tokens(buf: np.ndarray, off: np.ndarray):
    """Feature index of every word at each level, and the first word of each text. Words are runs of ASCII letters and non-ASCII bytes, lower case."""
    low = np.arange(256, dtype=np.uint8)
    low[:128] = 32
    low[97:123] = np.arange(97, 123)
    low[65:91] = np.arange(97, 123)
    b = low[buf]
    starts, ends, first = K.word_spans(b, off)
    out = []
    for size, bits in LEVELS:
        stop = np.minimum(starts + size, ends) if size else ends
        out.append((K.span_hashes(b, starts, stop) >> np.uint64(64 - bits)).astype(np.int64))
    return out, starts, ends, first


def _count(batches):
    sums = [np.zeros((2, 1 << bits), np.int64) for _, bits in LEVELS]
    for b in batches:
        buf, off = K.buffer(b.column(0))
        y = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for i, j in K.chunks(off):
            feats, _, _, first = tokens(buf[off[i] : off[j]], off[i : j + 1] - off[i])
            label = np.repeat(y[i:j], np.diff(first))
            for f, s in zip(feats, sums):
                for c in (0, 1):
                    s[c] += np.bincount(f[label == c], minlength=s.shape[1])
    for level, s in enumerate(sums):
        at = np.flatnonzero(s.sum(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), level, np.int32)), pa.array(at), pa.array(s[0][at]), pa.array(s[1][at])], ["level", "feature", "n0", "n1"])


BLOCK = 1 << 12


def _pack(table: pa.Table) -> pa.Table:
    """Counts of one block of features as two arrays: the driver takes a few hundred rows instead of one a feature."""
    at = table.column("feature").to_numpy() % BLOCK
    both = []
    for c in ("n0", "n1"):
        n = np.zeros(BLOCK, np.float32)
        n[at] = table.column(c).to_numpy()
        both.append(pa.array([n.tobytes()], pa.binary()))
    return pa.table({"level": table.column("level").slice(0, 1), "block": table.column("block").slice(0, 1), "n0": both[0], "n1": both[1]})


def log_odds(model, feats):
    """Posterior log-odds of each token over the class shares."""
    base = model["base"]
    p = np.full(len(feats[0]), base)
    for (n1, n), f, strength in zip(model["tables"], feats, PRIOR):
        p = (n1[f] + strength * p) / (n[f] + strength)
    return np.log(p / (1 - p)) - np.log(base / (1 - base))


def segments(score: np.ndarray):
    """All maximal scoring segments ``(start, end, score)`` of one text, in linear time over its positive tokens.

    Every segment kept has a link to the last one before it whose left sum is lower. A search for a lower left sum follows links, and so passes each segment once.
    """
    at = np.flatnonzero(score > 0)
    if not len(at):
        return []
    total = np.concatenate([[0.0], np.cumsum(score)])
    kept: list = []
    for a, left, right in zip(at.tolist(), total[at].tolist(), total[at + 1].tolist()):
        begin = a
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((begin, a + 1, left, right, j))
                break
            begin, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(b, e, r - x) for b, e, x, r, _ in kept]


def text_segments(model, buf, off, drifts):
    """Per text: number of tokens, and for each drift its segments."""
    feats, starts, ends, first = tokens(buf, off)
    odds = log_odds(model, feats) if len(starts) else np.zeros(0)
    found = []
    for drift in drifts:
        s = odds - drift
        some = np.zeros(len(s) + 1, np.int64)
        np.cumsum(s > 0, out=some[1:])
        found.append([segments(s[first[d] : first[d + 1]]) if some[first[d + 1]] > some[first[d]] else [] for d in range(len(off) - 1)])
    return np.diff(first), found


def evidence(law, n: int, found) -> float:
    if not found:
        return 0.0  # every text has a best score of 0 or more
    base = np.log(law["k"] * max(n, 1))
    each = [law["lam"] * s - base for _, _, s in found]
    strong = sum(x for x in each if x > -np.log(SIGNIFICANT))
    return strong if strong else max(0.0, *each)


def _measure(model):
    """Scores of all segments of labelled texts, for each of DRIFTS."""

    def run(batches):
        for b in batches:
            buf, off = K.buffer(b.column(0))
            for i, j in K.chunks(off):
                n, found = text_segments(model, buf[off[i] : off[j]], off[i : j + 1] - off[i], DRIFTS)
                scores = [[[s for _, _, s in x] for x in each] for each in zip(*found)]
                yield pa.RecordBatch.from_arrays([b.column(1).slice(i, j - i).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(scores, pa.list_(pa.list_(pa.float64())))], ["y", "n", "scores"])

    return run


def gumbel(n: np.ndarray, most: np.ndarray):
    """lambda and K by likelihood over a grid, texts without a positive token censored at 0."""
    pos = most > 0
    best = (-np.inf, 1.0, 1e-3)
    for lam in sorted(np.linspace(0.2, 3.0, 57), key=lambda x: abs(x - 1)):  # log-odds have lambda 1 in theory: it stays if the texts can't tell
        x = n * np.exp(-lam * most)
        k = max(int(pos.sum()), 1) / max(float(x.sum()), 1e-9)
        like = float((np.log(lam * k * n[pos]) - lam * most[pos] - k * x[pos]).sum() - k * x[~pos].sum())
        if like > best[0]:
            best = (like, float(lam), float(k))
    return best[1], best[2]


def logistic(z: np.ndarray, y: np.ndarray):
    """Slope, offset and loss by ridge Newton steps with Platt's smoothed targets.

    Four added texts of even odds at the significance level place the curve where the sample leaves a gap.
    """
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.append(np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2)), [0.5] * 4)
    z = np.append(z, [-np.log(SIGNIFICANT)] * 4)
    scale = max(float(z.std()), 1e-6)
    x = np.stack([z / scale, np.ones(len(z))], axis=1)
    w = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(w):
        v = x @ w
        return float((np.logaddexp(0, v) - t * v).sum() + 0.5 * (w[0] * w[0]) * 1e-2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - t) + np.array([1e-2 * w[0], 0])
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-2, 1e-6])
        step, size, now = np.linalg.solve(h, g), 1.0, loss(w)
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1]), loss(w)


def train(docs: DataFrame, labels: DataFrame, fold=None, max_labeled: int = MAX_LABELED):
    """The model, learned from labelled rows with ``fold`` (a column over doc_id; never 0) not 0; fold 4 calibrates."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) if fold is None else fold
    some = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).withColumn("fold", fold).where("fold <> 0")
    rows = some.count()
    if rows > max_labeled:
        some = some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * max_labeled / rows))
    some = some.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"), F.first("fold").alias("fold"))
    seen = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    counts = seen.where("fold <> 4").select("text", "y").mapInArrow(_count, "level int, feature long, n0 long, n1 long").groupBy("level", "feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.withColumn("block", F.floor(F.col("feature") / BLOCK)).groupBy("level", "block").applyInArrow(_pack, "level int, block long, n0 binary, n1 binary")
    tables = [(np.zeros(1 << bits, np.float32), np.zeros(1 << bits, np.float32)) for _, bits in LEVELS]
    for r in counts.collect():
        n1, n = tables[r["level"]]
        part = slice(r["block"] * BLOCK, (r["block"] + 1) * BLOCK)
        n1[part] = np.frombuffer(r["n1"], np.float32)
        n[part] = n1[part] + np.frombuffer(r["n0"], np.float32)
    n1, n = (float(x.sum()) for x in tables[-1])
    if not 0 < n1 < n:
        return None
    model = {"base": n1 / n, "tables": tables}
    kind = "y long, n long, scores array<array<double>>"
    held = seen.where("fold = 4").select("text", "y").mapInArrow(_measure(model), kind).toPandas()
    if not 0 < held["y"].sum() < len(held):
        held = seen.select("text", "y").mapInArrow(_measure(model), kind).toPandas()
    y, size = held["y"].to_numpy(dtype=float), np.maximum(held["n"].to_numpy(dtype=float), 1)
    if not 0 < y.sum() < len(y):
        return None
    return model | {"law": min((calibrate(drift, y, size, [x[k] for x in held["scores"]]) for k, drift in enumerate(DRIFTS)), key=lambda x: x["loss"])}


def calibrate(drift: float, y: np.ndarray, size: np.ndarray, scores) -> dict:
    """Extreme-value law and logistic curve of labelled texts that the log-odds did not see; scores: of all segments of each text."""
    most = np.array([max(x, default=0.0) for x in scores])
    lam, k = gumbel(size[y == 0], most[y == 0])
    law = {"drift": drift, "lam": lam, "k": k}
    z = np.array([evidence(law, n, [(0, 0, s) for s in x]) for n, x in zip(size, scores)])
    law["a"], law["b"], law["loss"] = logistic(z, y)
    return law


def _score(model, names):
    def run(batches):
        for b in batches:
            buf, off = K.buffer(b.column(0))
            for i, j in K.chunks(off):
                if model is None:
                    score, parts = np.zeros(j - i), [[]] * (j - i)
                else:
                    law = model["law"]
                    n, (found,) = text_segments(model, buf[off[i] : off[j]], off[i : j + 1] - off[i], [law["drift"]])
                    z = np.array([evidence(law, int(a), x) for a, x in zip(n, found)])
                    score = 1 / (1 + np.exp(-np.clip(law["a"] * z + law["b"], -500, 500)))
                    parts = [[{"start": s, "end": e, "score": v, "expected": float(law["k"] * a * np.exp(-law["lam"] * v))} for s, e, v in x if law["k"] * a * np.exp(-law["lam"] * v) < SIGNIFICANT] for a, x in zip(n.tolist(), found)]
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in b.columns[1:]), pa.array(score), pa.array(parts, SEGMENTS)], [*names, "score", "segments"])

    return run


SEGMENTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))


def score(docs: DataFrame, model, keep=("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``score`` and ``segments`` (significant passages as token intervals, with chance expectation)."""
    names = list(keep)
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.select(F.col("text").alias("_scored"), *names).mapInArrow(_score(model, names), schema + "score double, segments array<struct<start:long,end:long,score:double,expected:double>>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


by_value(__name__)
