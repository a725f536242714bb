"""The registered queries over the driver tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexengine.plans import corpora, registered, retrieval
from lexengine.plans.queries import QUERIES
from lexengine.plans.sql import SQL

#: Modules whose queries stand beside their SQL; they register when they are imported.
BESIDE_SQL = (corpora, retrieval)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | registered.QUERIES


def oracle_sql() -> dict[str, str]:
    return SQL | registered.SQL
