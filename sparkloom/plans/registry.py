"""The queries that the driver runs, each with the SQL that DuckDB answers it by where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.session import scratch, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The tables of a folder, read on demand: `t.documents`."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = ship(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


_built: dict[tuple[str, str, str], str] = {}


def once(t: Tables, name: str, write: Callable[[str], None], *, anew: bool = False) -> DataFrame:
    """A table that `write` makes at a path, once a session and folder, or anew: what later questions read."""
    key = (t.spark.sparkContext.applicationId, t.folder, name)
    if anew or key not in _built:
        path = scratch(t.spark, name)
        write(path)
        _built[key] = path
    return t.spark.read.parquet(_built[key])


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a function of `Tables` under its own name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        key = name or f.__name__
        assert key not in QUERIES, key
        QUERIES[key] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[key] = sql
        return f

    return add
