"""Training-data operators: queries and oracle SQL, registered by import."""
from tessera.llm import bpe_reuse, exact_dedup, hard_negatives, importance, language_id, mixing, multiprobe, role_repair, simhash_cover, suffix_tree, token_counts, toxicity, wrapper_html  # noqa: F401
from tessera.llm.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
