"""Registered queries of the scanning engine, and their DuckDB SQL."""

from __future__ import annotations

from . import base, extras, more, scanning, tools  # noqa: F401

QUERIES = base.QUERIES
SQL = base.SQL
FLAGSHIP = "scan_by_source"
