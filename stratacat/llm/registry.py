"""The opN queries and their oracle SQL."""

from __future__ import annotations

from . import bpe_transducer, decontaminate, minhash, pii, prefix_trie, quality_rules, substrings, token_counts, toxicity, url_reputation, warc, weak_quality, whitening

QUERIES = {
    "op1_pii_bootstrap": pii.query,
    "op2_decontaminate_spaced_seeds": decontaminate.query,
    "op3_token_counts": token_counts.query,
    "op4_minhash_oph": minhash.query,
    "op5_quality_rules": quality_rules.query,
    "op6_bpe_transducer": bpe_transducer.query,
    "op7_warc_zstd": warc.query,
    "op8_toxicity_string_kernel": toxicity.query,
    "op9_quality_weak_labels": weak_quality.query,
    "op10_url_reputation": url_reputation.query,
    "op11_whitening_qdwh": whitening.query,
    "op12_substring_superkmers": substrings.query,
    "op13_prefix_trie_blocks": prefix_trie.query,
}
ORACLE: dict[str, str] = {
    "op4_minhash_oph": minhash.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op7_warc_zstd": warc.ORACLE,
    "op10_url_reputation": url_reputation.ORACLE,
    "op12_substring_superkmers": substrings.ORACLE,
    "op13_prefix_trie_blocks": prefix_trie.ORACLE,
}
