"""All queries by name and the SQL that checks them."""

from __future__ import annotations

from tidemark.plans import audits, forecasts, marts, pages, quality, regional, seasons, segments, series, staging


def queries():
    return marts.queries() | segments.queries() | quality.queries() | staging.queries() | series.queries() | seasons.queries() | regional.queries() | forecasts.queries() | pages.queries() | audits.queries()


def oracle_sql():
    return marts.oracle_sql() | segments.oracle_sql() | quality.oracle_sql() | staging.oracle_sql() | series.oracle_sql() | seasons.oracle_sql() | regional.oracle_sql() | forecasts.oracle_sql() | pages.oracle_sql() | audits.oracle_sql()
