"""The queries of this subpackage and their SQL."""

from lodegraph.llm import decontaminate, html_extract, licenses, near_dedup, packing, permutation_index, pii, quality, secrets, token_counts

_MODULES = (permutation_index, decontaminate, secrets, packing, quality, licenses, pii, token_counts, html_extract, near_dedup)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: f for m in _MODULES for k, f in m.ORACLES.items()}
