"""Document quality by weak supervision: rules vote or abstain, and what they are worth is learned without labels.

Each rule looks at one statistic of a whole text and votes good, votes bad or abstains. The latent quality of a document and, for each rule and
each quality, the probability that a vote is right are estimated by expectation-maximisation over the counts of vote patterns of **all** documents
(Dawid & Skene 1979; Ratner et al. 2016). A pattern is a number below 3 ** rules, so the table that the driver iterates on is bounded by the rules
and not by the documents. The posterior is a sum of log odds, one per vote, and replaces a filter in which every rule must pass.

Defined results: a null text has no words, and so has a blank one; such texts abstain from most rules. Repeated rows and rows without id are
judged like others; extra columns are ignored; a very long text is handled by one task in about 60 bytes a word; without documents the result is empty
and the accuracies are the priors; a tie (posterior exactly a half) is kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.core import Scratch
from tessera.llm import by_value

#: Votes in a pattern, base 3.
ABSTAIN, BAD, GOOD = 0, 1, 2
#: Priors: a rule knows one kind of defect, so a bad document gets its bad vote only now and then, and a good document hardly ever; most documents are good.
#: They are where the search begins, keep "good" on the side of the rules, and weigh as much as this share of all documents.
BAD_VOTE_ON_BAD, GOOD_VOTE_ON_GOOD, GOOD_SHARE, PRIOR_SHARE = 0.25, 0.995, 0.8, 0.01
ROUNDS, SETTLED = 500, 1e-9
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_echo_words", "n_lettered_words", "n_word_bytes", "n_letter_bytes", "n_ascii_letters", "n_upper"]
_SPACE = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"

_B = np.arange(256)
_UPPER = (_B >= 65) & (_B <= 90)
_ASCII = _UPPER | (_B >= 97) & (_B <= 122)
_LETTER = _ASCII | (_B >= 128)
#: Letters (and bytes of other scripts) become ``a``, blanks stay, the rest becomes a full stop.
_SHAPE = bytes(ord("a") if _LETTER[i] else i if chr(i) in _SPACE else ord(".") for i in range(256))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, the first finding included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for k in range(width):
        w = (w ^ (w >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    _, where, count = np.unique(w, return_inverse=True, return_counts=True)
    hit = count[where] > 1
    if not hit.any():
        return 0
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= hit
    return int(covered.sum())


def text_stats(text: str | None) -> list[int]:
    """The numbers of one text, in the order of ``STATS``."""
    if not text:
        return [0] * len(STATS)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # bytes are split at exactly the six ASCII blanks
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    of = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    blanks = int(sum(of[ord(c)] for c in _SPACE))
    lettered = sum(b"a" in w for w in data.translate(_SHAPE).split())
    echo = sum(a == b for a, b in zip(words, words[1:]))
    ended = sum(x.rstrip(_SPACE)[-1] in ".!?…:;\"'”»)。！？" for x in lines)
    return [
        len(words), len(text) - blanks, int(sum(of[ord(c)] for c in _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), ended, echo, lettered,
        len(data) - blanks, int(of[_LETTER].sum()), int(of[_ASCII].sum()), int(of[_UPPER].sum()),
    ]


def _stats(batches):
    for b in batches:
        rows = np.array([text_stats(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(np.ascontiguousarray(rows[:, i])) for i in range(len(STATS)))], ["doc_id", *STATS])


def statistics(documents: DataFrame) -> DataFrame:
    """``doc_id`` and the statistics of every whole text."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string")).mapInArrow(_stats, f"doc_id {kind}, " + ", ".join(f"{s} long" for s in STATS))


@dataclass(frozen=True)
class Rule:
    """Good where ``ratio`` lies in ``good`` (ends included), bad where it lies outside ``fair``; else, and where ``when`` does not hold, it abstains."""

    name: str
    ratio: Column
    when: Column
    good: tuple[float, float]
    fair: tuple[float, float]

    def vote(self) -> Column:
        bad = (self.ratio < self.fair[0]) | (self.ratio > self.fair[1])
        good = self.ratio.between(*self.good)
        return F.when(F.coalesce(~self.when, F.lit(True)), F.lit(ABSTAIN)).when(bad, F.lit(BAD)).when(good, F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


def default_rules() -> list[Rule]:
    """Ten rules on shares that do not depend on the length of a text."""
    share = lambda a, b: F.try_divide(F.col(a), F.col(b))
    some = F.col("n_words") >= 10
    return [
        Rule("word_length", share("word_chars", "n_words"), some, (3.0, 7.0), (2.5, 10.0)),
        Rule("symbols", share("n_symbols", "n_words"), some, (0.0, 0.02), (0.0, 0.1)),
        Rule("repeated_lines", share("n_dup_lines", "n_lines"), F.col("n_lines") >= 4, (0.0, 0.05), (0.0, 0.3)),
        Rule("repeated_windows", share("n_repeat_words", "n_words"), some, (0.0, 0.1), (0.0, 0.3)),
        Rule("echoes", share("n_echo_words", "n_words"), some, (0.0, 0.02), (0.0, 0.1)),
        Rule("words_with_letters", share("n_lettered_words", "n_words"), some, (0.95, 1.0), (0.8, 1.0)),
        Rule("letters", share("n_letter_bytes", "n_word_bytes"), some, (0.9, 1.0), (0.75, 1.0)),
        Rule("capitals", share("n_upper", "n_ascii_letters"), some & (F.col("n_ascii_letters") * 2 > F.col("n_word_bytes")), (0.0, 0.1), (0.0, 0.3)),
        Rule("sentence_ends", share("n_ended_lines", "n_lines"), some, (0.7, 1.0), (0.2, 1.0)),
        Rule("length", F.col("n_words").cast("double"), F.lit(True), (80.0, math.inf), (20.0, math.inf)),
    ]


def pattern_of(rules: list[Rule]) -> Column:
    return sum((r.vote() * 3**i for i, r in enumerate(rules)), F.lit(0)).cast("int")


def fit_votes(votes: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """Log odds of good before any vote, and the log odds that each rule's vote adds (columns: abstain, bad, good).

    ``votes``: distinct patterns (rows) by rules, with the ``counts`` of documents. Given a quality, rules err independently; an abstention says nothing.
    """
    total = float(counts.sum())
    strength = max(total * PRIOR_SHARE, 1.0)
    bad, good = votes == BAD, votes == GOOD
    right = np.repeat([[BAD_VOTE_ON_BAD], [GOOD_VOTE_ON_GOOD]], votes.shape[1], 1)  # votes of bad on bad documents, votes of good on good ones
    odds = math.log(GOOD_SHARE / (1 - GOOD_SHARE))
    table = np.zeros((votes.shape[1], 3))
    for _ in range(ROUNDS):
        table = np.stack([np.zeros(votes.shape[1]), np.log(1 - right[1]) - np.log(right[0]), np.log(right[1]) - np.log(1 - right[0])], 1)
        score = odds + bad @ table[:, BAD] + good @ table[:, GOOD]
        p = 1 / (1 + np.exp(-np.clip(score, -700, 700)))
        w1, w0 = counts * p, counts * (1 - p)
        of = lambda hit, all_, prior: (hit + strength * prior) / (all_ + strength)
        new = np.stack([of(w0 @ bad, w0 @ (bad | good), BAD_VOTE_ON_BAD), of(w1 @ good, w1 @ (bad | good), GOOD_VOTE_ON_GOOD)])
        share = of(w1.sum(), total, GOOD_SHARE)
        moved = np.abs(new - right).max()
        right, odds = new, math.log(share / (1 - share))
        if moved < SETTLED:
            break
    return odds, table


@dataclass(frozen=True)
class QualityModel:
    rules: list[Rule]
    prior: float
    table: np.ndarray

    def posterior(self) -> Column:
        """Probability that a document is good, from its statistics."""
        odds = F.lit(float(self.prior))
        for r, row in zip(self.rules, self.table, strict=True):
            v = r.vote()
            odds = odds + F.when(v == BAD, F.lit(float(row[BAD]))).when(v == GOOD, F.lit(float(row[GOOD]))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-odds))


def fit(stats: DataFrame, rules: list[Rule] | None = None) -> QualityModel:
    """Accuracies of the rules from the votes on all documents; the driver receives one count for each vote pattern that occurs."""
    rules = default_rules() if rules is None else rules
    if len(rules) > 12:
        raise ValueError("at most 12 rules: patterns are counted one by one")
    rows = stats.groupBy(pattern_of(rules).alias("pattern")).agg(F.count("*").alias("n")).collect()
    pattern = np.array([r["pattern"] for r in rows], np.int64)
    votes = pattern[:, None] // 3 ** np.arange(len(rules)) % 3
    return QualityModel(rules, *fit_votes(votes, np.array([r["n"] for r in rows], float)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(documents: DataFrame, rules: list[Rule] | None = None, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``quality`` (posterior, 0 to 1) and ``kept``. Texts are read once; the model sees every document."""
    tmp = Scratch(documents.sparkSession, "quality")
    stats = tmp.save(statistics(documents))
    model = fit(stats, rules)
    return stats.withColumn("base_failed", base_failed()).withColumn("quality", model.posterior()).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


by_value(__name__)
