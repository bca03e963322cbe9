"""An analytics engine on PySpark for histories of tool calls: exact and hybrid retrieval of earlier observations."""

from recallspark.operators.exact import normalize_exact
from recallspark.operators.match import match_exact, match_semantic
from recallspark.operators.semantic import normalize_semantic, normalize_semantic_records
from recallspark.plans.api import ingest_exact_records, ingest_semantic_records
from recallspark.sources.embedders import create_embedder

__all__ = ["create_embedder", "ingest_exact_records", "ingest_semantic_records", "match_exact", "match_semantic", "normalize_exact", "normalize_semantic", "normalize_semantic_records"]
