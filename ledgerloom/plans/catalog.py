"""All registered core queries: importing the modules below registers theirs."""

from __future__ import annotations

from ledgerloom.plans import checked, exchange, more, moves, period_queries, recurring, registry, score_sql, settled, statements, streams

QUERIES, SQL = registry.QUERIES, registry.SQL
__all__ = ["QUERIES", "SQL", "checked", "exchange", "more", "moves", "period_queries", "recurring", "score_sql", "settled", "statements", "streams"]
