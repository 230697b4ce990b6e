"""All queries of the core, by name, and the SQL they are checked against."""

from __future__ import annotations

from braidlog.plans import general, reference

FLAGSHIP = "hybrid_search"
MODULES = [reference, general]
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
