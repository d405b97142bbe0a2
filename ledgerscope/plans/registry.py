"""How queries over the ledger are registered with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerscope.sources import adapter
from ledgerscope.sources.ledger import Ledger


class Registry:
    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def ledger(self, sql: str | None = None) -> Callable:
        """Register a function of a ledger; ``sql`` follows the common table expressions of the ledger."""

        def register(f: Callable[[Ledger], DataFrame]) -> Callable:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                return f(adapter.load(spark, sf_dir))

            self.queries[f.__name__] = run
            if sql:
                body = sql.strip()
                self.sql[f.__name__] = adapter.LEDGER_SQL.rstrip() + ("\n" if body.lower().startswith("select") else ", ") + body
            return f

        return register
