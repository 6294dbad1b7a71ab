"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from quillspan.plans import classification, documents, graph, imports, inventory, operations, probes, protos, soap, web

_MODULES = (classification, inventory, operations, documents, probes, imports, soap, protos, web, graph)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
