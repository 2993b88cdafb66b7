"""Collects the queries of the library's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from linenet.plans import catalogue, network, registers  # the latter two register their queries with the first

__all__ = ["network", "registers"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(catalogue.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(catalogue.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.QUERIES[catalogue.FLAGSHIP](spark, sf_dir)
