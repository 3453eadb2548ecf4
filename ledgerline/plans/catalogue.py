"""QUERIES: name -> (spark, sf_dir) -> DataFrame. ORACLES: name -> DuckDB SQL with the same columns."""

from __future__ import annotations

from ledgerline.plans import diffs, parsers, reports, surface

QUERIES = {**diffs.QUERIES, **reports.QUERIES, **parsers.QUERIES, **surface.QUERIES}
ORACLES = {**diffs.ORACLES, **reports.ORACLES, **parsers.ORACLES, **surface.ORACLES}
