"""Queries over the driver tables, with the SQL that must give the same rows."""

from __future__ import annotations

from . import checked, contamination, dual, scored

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _name, _sql in scored.SQL.items():
    QUERIES[_name], ORACLES[_name] = dual.query(_sql), dual.for_oracle(_sql)
QUERIES |= contamination.QUERIES | checked.QUERIES
ORACLES |= contamination.ORACLES | checked.ORACLES
