"""Query plans: one registered function per operator/query, with its DuckDB oracle."""
from tessera.plans import q_core, q_io, q_kmeans, q_layout, q_match, q_prep, q_vectors  # noqa: F401
from tessera.plans.registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
