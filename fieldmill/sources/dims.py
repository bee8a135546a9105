"""Dimension files: postcode list and payer list, read as text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldmill.operators.lookups import payer_dim_from_lines, postcode_dim_from_lines
from fieldmill.sources.delimited import read_lines


def read_postcode_dim(spark: SparkSession, path: str, width: int = 5) -> DataFrame:
    """``country postcode city ...`` lines -> (line, postcode, city)."""
    return postcode_dim_from_lines(read_lines(spark, path), width)


def read_payer_dim(spark: SparkSession, path: str) -> DataFrame:
    """``id name... postcode city street`` lines -> (line, ik, name)."""
    return payer_dim_from_lines(read_lines(spark, path))
