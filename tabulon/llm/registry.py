"""Queries of this folder and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession, record: object) -> Broadcast:
    """Broadcast the fields of a dataclass as a plain tuple, so executors need no copy of this package."""
    return spark.sparkContext.broadcast(tuple(getattr(record, f.name) for f in fields(record)))


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column is called so."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name
