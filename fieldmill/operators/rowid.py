"""Contiguous 0-based row numbers in file (or sort) order, without a
single-partition window and without a list on the driver.

Pass 1 counts rows per partition, a distributed running sum turns the counts
into start offsets, and pass 2 adds the offset to the position inside the
partition.  The input is materialised in the shared checkpoint folder first so
both passes see the same partitioning, also after an executor loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.operators.prefix import FAN, held, with_start
from fieldmill.session import stable

_POS_BITS = 33


def with_row_index(df: DataFrame, order_by=None, name: str = "_row", fan: int = FAN) -> DataFrame:
    """Add ``name`` = 0..n-1.

    ``order_by``: columns giving the order (range-partitioned sort); without
    it the order is the input order (a single file read in split order).  The
    offsets (one narrow row per partition) are broadcast up to a counted bound
    and joined by shuffle beyond it.
    """
    if order_by:
        df = df.orderBy(*order_by)
    tagged = stable(df.withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), _POS_BITS)
    counts = stable(tagged.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n")))
    offsets = stable(with_start(counts, ["_pid"], "_n", "_off", fan).drop("_n"))
    pos = F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1))
    return (tagged.withColumn("_pid", part)
            .join(held(offsets, offsets.count()), "_pid")
            .withColumn(name, (F.col("_off") + pos).cast("long"))
            .drop("_pid", "_off", "_mid"))
