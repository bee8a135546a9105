"""The 6-digit sequence on a stream.

Every micro-batch is numbered on from the mark its predecessor committed.  A
batch that runs again after a failure begins at the same mark, holds the same
rows (the query's own log fixes them), sorts them the same way and overwrites
its own folder, so it writes the same numbers.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from fieldmill.functions import keys
from fieldmill.functions.text import qcol
from fieldmill.operators.rowid import with_row_index
from fieldmill.session import checkpoint_dir


def _folder(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _commit(spark: SparkSession, marks: str, batch_id: int, end: int) -> None:
    """The mark is the file's name, so it is there whole or not at all."""
    fs, path = _folder(spark, os.path.join(marks, f"{batch_id}-{end}"))
    fs.create(path, True).close()


def _start(spark: SparkSession, marks: str, batch_id: int) -> int:
    """Rows numbered before ``batch_id``."""
    for pattern in (f"{batch_id - 1}-*", "*-*"):
        fs, path = _folder(spark, os.path.join(marks, pattern))
        found = [s.getPath().getName().split("-") for s in fs.globStatus(path) or []]
        before = [(int(b), int(end)) for b, end in found if int(b) < batch_id]
        if before:
            return max(before)[1]
    return 0


def run_sequence(stream: DataFrame, out_path: str, name: str, order_by: list[str], existing: str | None = None,
                 target: str = "id") -> StreamingQuery:
    """Write ``stream`` to Parquet with ``_row`` (position over all batches)
    and ``target`` = ``auto_sequence_6`` of ``existing`` and that position.

    Batches follow each other as the source deals them; inside one, rows are
    sorted by ``order_by``, then by all other columns, so only wholly equal
    rows are exchangeable.  An existing id stays; empty cells get the
    position.  An empty stream writes nothing.  ``name`` names the
    checkpoint below the shared checkpoint folder: a query started again
    under it goes on where it stopped, with the same ``out_path``.
    """
    spark = stream.sparkSession
    home = os.path.join(checkpoint_dir(spark), "fieldmill-streams", name)
    marks = os.path.join(home, "marks")
    order = [*order_by, *sorted(c for c in stream.columns if c not in order_by)]

    def write(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        start = _start(session, marks, batch_id)
        rows = with_row_index(batch, order_by=[qcol(c) for c in order], name="_row")
        rows = rows.withColumn("_row", qcol("_row") + start)
        numbered = rows.withColumn(target, keys.auto_sequence_6(qcol(existing) if existing else None, qcol("_row")))
        part = os.path.join(out_path, f"batch={batch_id}")
        numbered.write.mode("overwrite").parquet(part)
        _commit(session, marks, batch_id, start + session.read.parquet(part).count())

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", os.path.join(home, "checkpoint"))
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return query
