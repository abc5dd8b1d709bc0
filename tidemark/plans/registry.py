"""All registered queries of the library: name -> (function of (spark, sf_dir), DuckDB SQL or None)."""

from __future__ import annotations

import importlib

AREAS = ("audit", "health", "ingest", "ledger", "market", "outcomes", "research", "scoring", "wallets")

ALL: dict = {}
for _area in AREAS:
    ALL |= importlib.import_module(f"tidemark.plans.{_area}").QUERIES
