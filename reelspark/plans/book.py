"""Registered queries: portable SQL, a pair of dialects, or a DataFrame function with its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from reelspark.sources.adapters import ADAPTERS, Views, spark_text, with_views


def duck_text(sql: str) -> str:
    return sql.replace("@sha(", "sha256(").replace("WITH v_sessions", "WITH RECURSIVE v_sessions", 1)


class Book:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracles: dict[str, str] = {}

    def both(self, **texts: str) -> None:
        """SQL that both engines read; it begins with SELECT or with further common table
        expressions after a comma. ``@sha(x)`` is the SHA-256 in hexadecimal."""
        for name, sql in texts.items():
            self.pair(name, sql, sql)

    def pair(self, name: str, spark_sql: str, duck_sql: str) -> None:
        def run(spark: SparkSession, sf_dir: str, text: str = spark_text(with_views(spark_sql))) -> DataFrame:
            Views(spark, sf_dir).register()
            return spark.sql(text)

        self.queries[name] = run
        self.oracles[name] = duck_text(ADAPTERS + duck_sql)

    def frame(self, name: str, duck_sql: str | None = None) -> Callable:
        """A function of :class:`Views`; without SQL only its rows can be compared."""

        def add(function: Callable[[Views], DataFrame]) -> Callable:
            self.queries[name] = lambda spark, sf_dir: function(Views(spark, sf_dir))
            if duck_sql:
                self.oracles[name] = duck_text(ADAPTERS + duck_sql)
            return function

        return add
