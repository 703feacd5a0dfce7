"""Where queries and their SQL checks are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.sources.tables import Tables

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, in the order of their registration."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.makers: dict[str, Callable[[Tables], DataFrame]] = {}

    def query(self, name: str, sql: str | None = None, dates: tuple[str, ...] = ()) -> Callable:
        """Register a function of Tables as query `name`; sql: the same result in DuckDB's SQL. dates: columns given out as ISO text, which engines agree on."""

        def register(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
            if name in self.queries:
                raise ValueError(f"query {name} is registered twice")
            self.makers[name] = build
            self.queries[name] = lambda spark, folder: build(Tables(spark, folder)).withColumns({d: F.col(d).cast("string") for d in dates})
            if sql is not None:
                self.sql[name] = f"SELECT * REPLACE ({', '.join(f'CAST({d} AS VARCHAR) AS {d}' for d in dates)}) FROM ({sql})" if dates else sql
            return build

        return register
