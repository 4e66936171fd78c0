"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, decontaminate, divergence, jaccard_join, langid, line_dedup, minhash_dedup, ngram_lm, shard_tree, token_counts, token_files, topk, whitening

QUERIES = {
    "op1_shard_tree": shard_tree.op1_shard_tree,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_ngram_lm": ngram_lm.op3_ngram_lm,
    "op4_top_k": topk.op4_top_k,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_token_files": token_files.op7_token_files,
    "op8_language_id": langid.op8_language_id,
    "op9_byte_bpe": bpe.op9_byte_bpe,
    "op10_decontamination": decontaminate.op10_decontamination,
    "op11_minhash_dedup": minhash_dedup.op11_minhash_dedup,
    "op12_whitening": whitening.op12_whitening,
    "op13_source_divergence": divergence.op13_source_divergence,
}
SQL: dict[str, str] = {**topk.SQL, "op5_jaccard_join": jaccard_join.SQL, "op10_decontamination": decontaminate.SQL, "op11_minhash_dedup": minhash_dedup.SQL, "op13_source_divergence": divergence.SQL}
