"""Extra columns with the operators' own names, and long conversations."""

import hashlib

from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import chat_format, mixing, ngram_jaccard, prefix_trie, quality_rules, substring_dedup

CLASH = ("_key", "node", "n", "h", "hi", "lo", "size", "taken", "target", "bucket", "block", "marks", "component_id", "n_words", "text_", "kept", "quality", "words", "key", "seq", "class", "part", "line", "th", "pos")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in CLASH if c not in df.columns})


def docs(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "en", "s", 1), (2, a + " tail", "en", "t", 1), (3, b, "en", None, 1), (4, None, None, "s", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_operators_do_not_read_other_columns(spark):
    d = docs(spark)
    for run in (
        lambda x: ngram_jaccard.jaccard_components(x), lambda x: substring_dedup.remove_repeats(x).select("doc_id", "n_words", "n_removed", "kept_text"), lambda x: mixing.mix_counts(x),
        lambda x: quality_rules.judge(x), lambda x: corpus_pipeline.dedup_lines(spark, x, ""), lambda x: corpus_pipeline.dedup_documents(spark, x, ""),
    ):
        assert sorted(map(str, run(clashing(d)).collect())) == sorted(map(str, run(d).collect()))


def test_conversations_of_thousands_of_turns(spark):
    rows = [(1, t, "user" if t % 500 else "assistant", f"turn {t}") for t in range(3_000)] + [(2, 0, "assistant", "hello")]
    d = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat_format.read_back(chat_format.expand(d)).collect()}
    said = "".join(f"{r}\n{x}\n" for c, _, r, x in rows if c == 1)
    assert hashlib.sha256("".join(f"{t['role']}\n{t['text']}\n" for t in back[1]["turns"]).encode()).digest() == hashlib.sha256(said.encode()).digest()
    assert back[1]["loss"] == "".join(f"turn {t}" for t in range(0, 3_000, 500)) and back[2]["loss"] == "hello"
    assert prefix_trie.trie(prefix_trie.sequences(d)).count() == 3_002
