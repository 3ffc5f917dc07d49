"""The registered queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlight.llm import ann, bytepairs, langid, lexical, media, mixing, packing, pii, simhash, substring, tokenfile, toxicity, trie

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nonnegative_pu": toxicity.op1_nonnegative_pu,
    "op2_disclosure": pii.op2_disclosure,
    "op3_progressive_jpeg": media.op3_progressive_jpeg,
    "op4_simhash_balls": simhash.op4_simhash_balls,
    "op5_de_bruijn": substring.op5_de_bruijn,
    "op6_permutation_index": ann.op6_permutation_index,
    "op7_raking": mixing.op7_raking,
    "op8_dictionary_files": tokenfile.op8_dictionary_files,
    "op9_byte_gru": langid.op9_byte_gru,
    "op10_best_fit": packing.op10_best_fit,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_backtracking_bpe": bytepairs.op12_backtracking_bpe,
    "op13_block_max": lexical.op13_block_max,
}

ORACLE_SQL: dict[str, str] = {
    "op5_de_bruijn": substring.OP5_SQL,
    "op7_raking": mixing.OP7_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op13_block_max": lexical.OP13_SQL,
}
