"""Dimension joins with a checked broadcast and a salted fallback.

A dimension is broadcast only after measuring it (one aggregate of rows and
bytes, cheap next to the fact table) and only below ``max_rows`` and
``BROADCAST_MAX_BYTES``.  Beyond that the join shuffles: the fact's keys are
counted once, keys above a task's fair share are split over as many salts as
shares they hold, and only the dimension rows of those keys are replicated.
Rows without key, which match nothing, are spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions.text import qcol
from fieldmill.session import stable

BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 256 << 20
STREAM_SALTS = 32
HOT_ROWS = 10_000  # fewer rows of a key than this are never split


def is_broadcastable(dim: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Rows and text size (as JSON, so arrays and long texts count) are within bounds."""
    rows, size = dim.agg(F.count(F.lit(1)), F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()
    return rows <= max_rows and (size or 0) <= BROADCAST_MAX_BYTES


def hot_keys(fact: DataFrame, key: str, least: int = HOT_ROWS) -> DataFrame:
    """(_hk, _ways): keys with more than half a task's share of the rows, and
    how many such shares they hold.  Fewer than two rows per shuffle task, so
    the result may be broadcast at any data size."""
    parts = int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = stable(fact.where(qcol(key).isNotNull()).groupBy(qcol(key).alias("_hk")).agg(F.count(F.lit(1)).alias("_n")))
    total = counts.agg(F.sum("_n")).first()[0] or 0
    share = max(least, total // (2 * parts), 1)
    return counts.where(F.col("_n") > share).select("_hk", F.ceil(F.col("_n") / share).cast("int").alias("_ways"))


def lookup_join(fact: DataFrame, dim: DataFrame, fact_key: Column, dim_key: str,
                how: str = "left", max_rows: int = BROADCAST_MAX_ROWS,
                salts: int = STREAM_SALTS, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``fact`` joined to a dimension that is unique on ``dim_key``.

    The dimension's non-key columns are appended; ``fact`` keeps its rows
    (left join) whatever the key distribution.  A stream cannot be counted
    beforehand: there every key is split over ``salts``.
    """
    fact = fact.withColumn("_lk", fact_key)
    if is_broadcastable(dim, max_rows):
        out = fact.join(F.broadcast(dim), fact["_lk"] == dim[dim_key], how)
        return out.drop("_lk").drop(dim[dim_key])
    # the unique row key spreads a hot join key evenly; without one, the whole row and the input
    # partition it comes from (the same again when a task is retried), which spreads repeated rows too
    if fact.isStreaming:
        spread = F.xxhash64(*[qcol(c) for c in fact.columns])
        fact_ways, dim = F.lit(salts), dim.withColumn("_ways", F.lit(salts))
    else:
        spread = F.xxhash64(qcol("_row")) if "_row" in fact.columns else \
            F.xxhash64(F.spark_partition_id(), *[qcol(c) for c in fact.columns])
        hot = F.broadcast(hot_keys(fact, "_lk", hot_rows))
        fact = fact.withColumn("_spread", spread).join(hot, F.col("_lk") == F.col("_hk"), "left").drop("_hk")
        spread, fact_ways = F.col("_spread"), F.coalesce("_ways", F.lit(1))
        dim = dim.join(hot, qcol(dim_key) == F.col("_hk"), "left").drop("_hk") \
            .withColumn("_ways", F.coalesce("_ways", F.lit(1)))
    salted_fact = fact.withColumn("_salt", F.when(F.col("_lk").isNull(), spread).otherwise(F.pmod(spread, fact_ways))) \
        .drop("_ways", "_spread")
    salted_dim = (dim.withColumn("_dsalt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ways").cast("long") - 1)))
                  .drop("_ways").withColumnRenamed(dim_key, "_dk"))
    out = salted_fact.join(salted_dim, (F.col("_lk") == F.col("_dk")) & (F.col("_salt") == F.col("_dsalt")), how)
    return out.drop("_lk", "_dk", "_salt", "_dsalt")
