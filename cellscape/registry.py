"""Registered queries of the hazard-screening operators and their SQL."""

from __future__ import annotations

from cellscape.plans.queries import ORACLE_SQL as ORACLE_SQL
from cellscape.plans.queries import QUERIES as QUERIES
