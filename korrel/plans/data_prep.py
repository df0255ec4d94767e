"""Queries of the general data-preparation operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from korrel.operators import packed
from korrel.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every packed field that holds two values or more."""
    return packed.unpack(table(spark, sf_dir, "indexed_files"))


QUERIES = {"p2_found": p2_found}
ORACLES: dict[str, str] = {}
