"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from sentrel.plans import measures, records, text, trees, walks
from sentrel.streaming import events

_PLANS = (text, records, walks, measures, trees, events)

QUERIES = {k: q for p in _PLANS for k, q in p.QUERIES.items()}
ORACLES = {k: q for p in _PLANS for k, q in p.ORACLES.items()}
