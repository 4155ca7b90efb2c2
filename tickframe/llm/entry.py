"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from tickframe.llm import chat, debruijn, decontam, importance, jaccard, mixing, pii, prefix_trie, quality, simhash, suffix_dedup, token_counts, warc

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_warc": warc.op2_warc,
    "op3_ngram_jaccard": jaccard.op3_ngram_jaccard,
    "op4_decontaminate": decontam.op4_decontaminate,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_quality": quality.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_simhash": simhash.op9_simhash,
    "op10_chat_format": chat.op10_chat_format,
    "op11_importance_resampling": importance.op11_importance_resampling,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_debruijn_dedup": debruijn.op13_debruijn_dedup,
}

SQL = {
    "op1_mix_sources": mixing.SQL,
    "op2_warc": warc.SQL,
    "op3_ngram_jaccard": jaccard.SQL,
    "op4_decontaminate": decontam.SQL,
    "op10_chat_format": chat.SQL,
    "op11_importance_resampling": importance.SQL,
    "op12_prefix_trie": prefix_trie.SQL,
    "op13_debruijn_dedup": debruijn.SQL,
}
