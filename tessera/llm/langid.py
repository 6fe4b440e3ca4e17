"""Language ID by multilingual mixture inference.

A language is a distribution over hashed byte trigrams (counted over all training rows). For each text,
expectation-maximisation finds the proportions that best explain its trigram counts as a mixture; nested sets
of languages (by proportion) are compared by likelihood less ``PENALTY * log(trigrams)`` per further
language, and the largest proportion of the chosen set is the prediction.

Defined results: null text, or text without a letter: ``und``, score 0; null ids are predicted but
never learned from; without training rows all is ``und``; ties go to the first language in code-point order.
The model is languages x 2**14 numbers, gathered as one block a language; tasks work on as many texts at once as CELLS numbers hold.
Very long texts are predicted whole; repeated rows alike; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import by_value
from tessera.llm import kernels as K

BITS = 14
#: Numbers (languages x distinct trigrams) that a task holds at once.
CELLS = 1 << 22
ALPHA = 0.5
PENALTY = 3.0
ROUNDS = 12


def trigrams(buf: np.ndarray, off: np.ndarray, bits: int = BITS):
    """Hashed trigrams centred on each letter byte, and the first of each text. ASCII other than letters counts as blank."""
    low = np.arange(256, dtype=np.uint8)
    low[:128] = 32
    low[97:123] = np.arange(97, 123)
    low[65:91] = np.arange(97, 123)
    b = low[buf].astype(np.uint32)
    prev, nxt = np.full(len(b), 32, np.uint32), np.full(len(b), 32, np.uint32)
    prev[1:], nxt[:-1] = b[:-1], b[1:]
    edge = off[(off > 0) & (off < len(b))]
    prev[edge] = 32
    nxt[edge - 1] = 32
    at = np.flatnonzero(b != 32)
    x = (prev[at] << 16 | b[at] << 8 | nxt[at]) * np.uint32(2654435769)
    return (x >> np.uint32(32 - bits)).astype(np.int64), np.searchsorted(at, off)


def _count(bits: int):
    def run(batches):
        sums: dict = {}
        for b in batches:
            langs = b.column(1).to_pylist()
            buf, off = K.buffer(b.column(0))
            for i, j in K.chunks(off):
                f, first = trigrams(buf[off[i] : off[j]], off[i : j + 1] - off[i], bits)
                names, which = np.unique(np.array(langs[i:j], dtype=object), return_inverse=True)
                both = np.bincount(np.repeat(which, np.diff(first)) * (1 << bits) + f, minlength=len(names) << bits).reshape(len(names), -1)
                for name, row in zip(names, both):
                    sums[name] = sums.get(name, 0) + row
        for name, row in sums.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(row[at].astype(np.int64))], ["lang", "feature", "n"])

    return run


def train(rows: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS):
    """``(languages, log probabilities)`` from all rows with a text and a language."""
    counts = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(text, lang).mapInArrow(_count(bits), "lang string, feature long, n long")
    packed = counts.groupBy("lang", "feature").agg(F.sum("n").alias("n")).groupBy("lang").applyInArrow(_pack(bits), "lang string, n binary")
    got = sorted((r["lang"], r["n"]) for r in packed.collect())
    table = np.array([np.frombuffer(n, np.float64) for _, n in got]).reshape(len(got), 1 << bits) + ALPHA
    return [lang for lang, _ in got], np.log(table / table.sum(axis=1, keepdims=True))


def _pack(bits: int):
    """All counts of one language in one cell."""

    def run(table: pa.Table) -> pa.Table:
        n = np.zeros(1 << bits)
        n[table.column("feature").to_numpy()] = table.column("n").to_numpy()
        return pa.table({"lang": table.column("lang").slice(0, 1), "n": pa.array([n.tobytes()], pa.binary())})

    return run


def mixtures(f: np.ndarray, first: np.ndarray, logp: np.ndarray):
    """Proportions of each language per text (texts without features: all zero)."""
    n_lang, n_feat = logp.shape
    n = len(first) - 1
    total = np.diff(first)
    out = np.zeros((n, n_lang))
    keep = np.flatnonzero(total)
    if not len(keep):
        return out
    # distinct trigrams of each text and their counts
    both, c = np.unique(np.repeat(np.arange(n), total) * n_feat + f, return_counts=True)
    at, c = both % n_feat, c.astype(float)
    start = np.append(np.searchsorted(both // n_feat, keep), len(both))
    lp = logp[:, at]
    single = np.add.reduceat(lp * c, start[:-1], axis=1).T
    best = single.argmax(axis=1)
    out[keep, best] = 1
    if n_lang == 1:
        return out
    p = np.exp(lp)

    def em(docs, allowed):
        """Proportions and log-likelihood of the texts ``docs`` with the languages ``allowed`` (texts x languages)."""
        idx = np.concatenate([np.arange(start[d], start[d + 1]) for d in docs])
        s = np.concatenate([[0], np.cumsum((start[1:] - start[:-1])[docs])])
        doc = np.repeat(np.arange(len(docs)), np.diff(s))
        pi = allowed / allowed.sum(axis=1, keepdims=True)
        q, w = p[:, idx].T, c[idx]
        for _ in range(ROUNDS):
            r = pi[doc] * q
            mass = r.sum(axis=1)
            pi = np.add.reduceat(r * (w / mass)[:, None], s[:-1], axis=0)
            pi /= pi.sum(axis=1, keepdims=True)
        return pi, np.add.reduceat(w * np.log((pi[doc] * q).sum(axis=1)), s[:-1])

    price = PENALTY * np.log(np.maximum(total[keep], 2))
    value = single.max(axis=1)
    # a mixture of all languages bounds what any set of them can gain over the best single one
    docs = np.arange(len(keep))
    full, gain = em(docs, np.ones((len(docs), n_lang)))
    docs = np.flatnonzero(gain - price > value)
    rank = np.argsort(np.argsort(-full, axis=1, kind="stable"), axis=1)
    for k in range(2, n_lang + 1):
        if not len(docs):
            break
        pi, like = em(docs, (rank[docs] < k).astype(float))
        score = like - price[docs] * (k - 1)
        good = score > value[docs]
        value[docs[good]] = score[good]
        out[keep[docs[good]]] = pi[good]
        docs = docs[gain[docs] - price[docs] * k > value[docs]]
    return out


def _predict(langs: list, logp: np.ndarray):
    def run(batches):
        names = np.array([*langs, "und"], dtype=object)
        for b in batches:
            buf, off = K.buffer(b.column(1))
            letters = np.asarray(b.column(2).fill_null(False))
            for i, j in K.chunks(off, max(1, min(K.CHUNK_BYTES, CELLS // max(len(langs), 1)))):
                if langs:
                    f, first = trigrams(buf[off[i] : off[j]], off[i : j + 1] - off[i], int(logp.shape[1]).bit_length() - 1)
                    pi = mixtures(f, first, logp)
                else:
                    pi = np.zeros((j - i, 1))
                known = letters[i:j] & (pi.sum(axis=1) > 0)
                pred = np.where(known, pi.argmax(axis=1), len(langs))
                score = np.where(known, np.minimum(pi.max(axis=1), 1.0), 0.0)
                parts = [[(langs[k], float(x)) for k, x in enumerate(row) if x > 0.005] if ok else [] for row, ok in zip(pi, known)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(pa.int64()), pa.array(names[pred], pa.string()), pa.array(score), pa.array(parts, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "mixture"])

    return run


def detect(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, lang_pred, score`` and ``mixture`` (proportions over 0.005)."""
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(text_col).rlike(r"\p{L}").alias("letters"))
    return d.mapInArrow(_predict(*model), "doc_id long, lang_pred string, score double, mixture map<string,double>")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    model = train(docs.where(rest != 2))
    out = detect(docs, model).select("doc_id", "lang_pred", "score")
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


by_value(__name__)
