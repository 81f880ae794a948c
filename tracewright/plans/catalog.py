"""Every registered query of the trajectory engine, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import files, learning, network


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**network.QUERIES, **learning.QUERIES, **files.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**network.ORACLES, **learning.ORACLES, **files.ORACLES}
