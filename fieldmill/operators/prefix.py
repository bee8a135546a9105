"""Running sums over ordered rows without a driver list and without one task
that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.session import stable

FAN = 20_000  # rows that one task sums in order
MOST_HELD = 1_000_000  # narrow rows of a table that may be broadcast


def with_start(df: DataFrame, order: list[str], value: str, name: str = "_start", fan: int = FAN) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows before this one in
    ``order`` (which must tell rows apart).

    Up to ``fan`` rows are summed by one window.  More are cut into ranges of
    about ``fan`` rows; the ranges' totals are summed the same way, and each
    row adds its range's start to the sum inside the range.  Levels grow with
    the logarithm of the rows.  Ranges are materialised in the shared
    checkpoint folder, so totals and rows see the same cut.
    """
    rows = df.count()
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum(value)
    if rows <= fan:
        return df.coalesce(1).withColumn(name, F.coalesce(total.over(before), F.lit(0)).cast("long"))
    parts = -(-rows // fan)
    part = f"_range_of_{order[0]}"  # a level's ranges are the next level's rows
    cut = stable(df.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id()))
    ranges = with_start(cut.groupBy(part).agg(total.alias("_sum")), [part], "_sum", f"_before{part}", fan)
    inside = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return cut.join(ranges.drop("_sum"), part) \
        .withColumn(name, (F.col(f"_before{part}") + F.coalesce(total.over(inside), F.lit(0))).cast("long")) \
        .drop(part, f"_before{part}")


def held(df: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` counted narrow rows, broadcast up to ``MOST_HELD``."""
    return F.broadcast(df) if rows <= MOST_HELD else df
