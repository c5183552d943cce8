"""Registry of queries, each with the SQL that states the expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """Attribute access to the tables of a folder; reads only what is used."""

    def __init__(self, spark, directory):
        self.spark, self._directory = spark, directory

    def __getattr__(self, name):
        return table(self.spark, self._directory, name)


def query(name: str, oracle: str | None = None):
    def register(fn):
        def run(spark, directory):
            return fn(Tables(spark, directory))

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register
