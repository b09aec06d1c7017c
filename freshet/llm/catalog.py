"""All queries of this subpackage, gathered from its query modules."""

from freshet.llm import (  # noqa: F401
    decontaminate_query,
    hilbert_query,
    jaccard_query,
    language_model_query,
    lexical_search_query,
    licenses_query,
    line_dedup_query,
    packing_query,
    pii_query,
    prefix_trie_query,
    quality_query,
    toxicity_query,
    url_query,
)
from freshet.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
