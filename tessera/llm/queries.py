"""Registered queries of the training-data operators and, where SQL can express them, their SQL."""

from tessera.llm import chat_format, decontaminate, embedding_dedup, langid, line_dedup, mixing, ngram_jaccard, prefix_trie, quality_rules, substring_dedup, toxicity, warc, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_ngram_jaccard": ngram_jaccard.op2_ngram_jaccard,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_mixing": mixing.op5_mixing,
    "op6_embedding_dedup": embedding_dedup.op6_embedding_dedup,
    "op7_warc": warc.op7_warc,
    "op8_langid": langid.op8_langid,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_whitening": whitening.op11_whitening,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_quality_rules": quality_rules.op13_quality_rules,
}
SQL = {
    "op2_ngram_jaccard": ngram_jaccard.OP2_SQL,
    "op4_substring_dedup": substring_dedup.OP4_SQL,
    "op5_mixing": mixing.OP5_SQL,
    "op6_embedding_dedup": embedding_dedup.OP6_SQL,
    "op7_warc": warc.OP7_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op10_chat_format": chat_format.OP10_SQL,
    "op12_prefix_trie": prefix_trie.OP12_SQL,
}
