"""Records of delimited files: headers per file, and cells with line breaks in
a read that stays splittable.

Lines are read by splits.  Whether a line ends inside a quoted cell depends on
how it began, so every line that holds a quote is judged for both beginnings
(a fold over its cells).  Per split these judgements combine to one function of
the state at the split's start; combining the splits of a file in order gives
every split its state, and one pass over each split then puts its lines
together to records.  Pieces of a record that crosses splits, at most two per
split, are joined at the end.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.operators.prefix import MOST_HELD, held
from fieldmill.session import stable

SPLIT = ["_src_file", "_src_block"]


def _open_after(value: Column, sep: str, inside: bool, quote: str) -> Column:
    """Whether a line that begins inside (or outside) a quoted cell ends inside
    one.  A cell is quoted if it begins with a quote; quotes elsewhere in an
    unquoted cell are text."""
    odd = lambda piece: (F.length(piece) - F.length(F.replace(piece, F.lit(quote), F.lit("")))) % 2 == 1
    return F.aggregate(F.split(value, re.escape(sep)), F.lit(inside),
                       lambda state, piece: odd(piece) & ~state & piece.startswith(quote) | state & ~odd(piece))


def read_text(spark: SparkSession, path: str, charset: str) -> DataFrame:
    return spark.read.option("encoding", charset).text(path).select(
        F.col("_metadata.file_path").alias("_src_file"), F.col("_metadata.file_block_start").alias("_src_block"),
        F.monotonically_increasing_id().alias("_src_pos"), "value")


def survey(spark: SparkSession, path: str, sep: str, charset: str, quote: str = '"') -> DataFrame:
    """One row per file, from one pass over its lines: its header line (the
    first that is not blank) and whether any line ends inside a quoted cell."""
    lines = read_text(spark, path, charset).where(F.length(F.trim("value")) > 0)
    breaks = F.when(F.instr("value", quote) > 0, _open_after(F.col("value"), sep, False, quote)).otherwise(False)
    return lines.groupBy("_src_file").agg(
        F.min_by("value", F.struct("_src_block", "_src_pos")).alias("header"), F.max(breaks).alias("breaks"))


def _state_after(group: Window, *flags: str) -> tuple[Column, Column, Column]:
    """Of rows in a window's order, composed up to and with each row: whether
    the state is now fixed, the fixed state, and whether the state at the start
    is turned over (never both)."""
    fixed, value, turned = map(F.col, flags)
    turns = F.sum(turned.cast("int")).over(group)
    last = F.last(F.when(fixed, F.struct(value.alias("v"), turns.alias("t"))), ignorenulls=True).over(group)
    over = (turns - F.coalesce(last["t"], F.lit(0))) % 2 == 1
    return last.isNotNull(), last.isNotNull() & (last["v"] != over), last.isNull() & over


def split_states(lines: DataFrame, sep: str, quote: str) -> DataFrame:
    """(file, split) of the splits that begin inside a quoted cell."""
    quoted = lines.where(F.instr("value", quote) > 0).select(
        *SPLIT, "_src_pos", _open_after(F.col("value"), sep, False, quote).alias("o"), _open_after(F.col("value"), sep, True, quote).alias("i"))
    # (o, i): end state after a beginning outside, inside; (false, true) changes nothing
    quoted = quoted.where("o or not i").select(*SPLIT, "_src_pos", (F.col("o") == F.col("i")).alias("f"),
                                               F.col("o").alias("v"), (F.col("o") & ~F.col("i")).alias("t"))
    rows = Window.partitionBy(*SPLIT).orderBy("_src_pos").rowsBetween(Window.unboundedPreceding, 0)
    f, v, t = _state_after(rows, "f", "v", "t")
    last = quoted.select(*SPLIT, "_src_pos", f.alias("f"), v.alias("v"), t.alias("t")) \
        .groupBy(*SPLIT).agg(F.max_by(F.struct("f", "v", "t"), "_src_pos").alias("s")).select(*SPLIT, "s.f", "s.v", "s.t")
    every = lines.select(*SPLIT).distinct().join(last, SPLIT, "left").fillna(False, ["f", "v", "t"])
    files = Window.partitionBy("_src_file").orderBy("_src_block").rowsBetween(Window.unboundedPreceding, 0)
    f, v, t = _state_after(files, "f", "v", "t")
    after = every.select(*SPLIT, (v | t).alias("after"))
    begin = F.lag("after", 1, False).over(Window.partitionBy("_src_file").orderBy("_src_block"))
    return after.select(*SPLIT, begin.alias("inside")).where("inside")


_PIECES = "_src_file string, _src_block long, _src_pos long, kind string, value string"


def _assemble(batches):
    """Lines of whole splits, in order -> records: ``whole``, or the piece of
    one that the split begins in (``rest``), ends in (``begin``) or both
    (``rest`` again).  ``o`` and ``i`` are null for a line without quotes."""
    split, state, first, kept, kind = None, False, None, [], "whole"
    out: list[tuple] = []

    def close(to: str) -> None:
        nonlocal kept
        if kept:
            out.append((*split, first, to, "\n".join(kept)))
        kept = []

    for batch in batches:
        files, blocks, places, values, outer, inner, begins = (c.to_pylist() for c in batch.columns)
        for file, block, place, value, o, i, inside in zip(files, blocks, places, values, outer, inner, begins):
            if (file, block) != split:
                close("rest" if kind == "rest" else "begin")
                split, state = (file, block), bool(inside)
                kind = "rest" if state else "whole"
            if not kept:
                first = place
            kept.append(value)
            if o is not None:
                state = i if state else o
            if not state:
                close("end" if kind == "rest" else "whole")
                kind = "whole"
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            list(zip(*out)) or [()] * 5, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
            names=["_src_file", "_src_block", "_src_pos", "kind", "value"])
        out.clear()
    close("rest" if kind == "rest" else "begin")
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(("_src_file", "_src_block", "_src_pos", "kind", "value"), r)) for r in out],
                                         schema=pa.schema([("_src_file", pa.string()), ("_src_block", pa.int64()),
                                                           ("_src_pos", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))


def whole_records(spark: SparkSession, path: str, sep: str, charset: str, quote: str = '"') -> DataFrame:
    """(``_src_file``, ``_src_block``, ``_src_pos``, value): one row per record
    that is not blank, header records included; a line break inside a quoted
    cell is ``\\n``.  Lines are materialised once in the shared checkpoint
    folder, so that every pass sees the same splits; no task holds more than a
    split and the records at its edges.  A quote that is never closed makes
    the rest of its file one record.
    """
    lines = stable(read_text(spark, path, charset))
    inside = stable(split_states(lines, sep, quote))
    has = F.instr("value", quote) > 0
    n = inside.count()
    told = lines.join(held(inside, n), SPLIT, "left")
    if n > MOST_HELD:  # joined by shuffle: back to whole splits in order
        told = told.repartition(*SPLIT).sortWithinPartitions(*SPLIT, "_src_pos")
    told = told.select(
        *SPLIT, "_src_pos", "value", F.when(has, _open_after(F.col("value"), sep, False, quote)).alias("o"),
        F.when(has, _open_after(F.col("value"), sep, True, quote)).alias("i"), "inside")
    pieces = stable(told.mapInArrow(_assemble, _PIECES))
    cut = pieces.where("kind <> 'whole'")
    # pieces follow their ``begin``; there are at most two per split
    number = F.sum((F.col("kind") == "begin").cast("int")).over(
        Window.partitionBy("_src_file").orderBy("_src_block", "_src_pos").rowsBetween(Window.unboundedPreceding, 0))
    joined = cut.withColumn("n", number).groupBy("_src_file", "n").agg(
        F.array_sort(F.collect_list(F.struct("_src_block", "_src_pos", "value"))).alias("p")) \
        .select("_src_file", F.col("p")[0]["_src_block"].alias("_src_block"), F.col("p")[0]["_src_pos"].alias("_src_pos"),
                F.array_join(F.transform("p", lambda x: x["value"]), "\n").alias("value"))
    return pieces.where("kind = 'whole'").drop("kind").unionByName(joined).where(F.length(F.trim("value")) > 0)
