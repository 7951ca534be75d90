"""All queries of the alignment library and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinmap.plans import alignments, graphs, metrics, samples, transports  # noqa: F401
from kinmap.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["align_flagship"](spark, sf_dir)
