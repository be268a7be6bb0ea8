"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from sentrel.llm import decontaminate, line_dedup, pieces, quality, sharding, simhash, sketches, suffixes, toxicity, url_templates

_MODULES = (simhash, line_dedup, decontaminate, url_templates, sharding, sketches, quality, pieces, suffixes, toxicity)

QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: q for m in _MODULES for k, q in m.ORACLES.items()}
