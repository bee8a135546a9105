"""Stateless rules on a stream of delimited files.

The rule projection is made of pure Column expressions and stream-static
dimension joins, so the same plan runs on a streaming DataFrame.  Rules that
need the whole table's row order (``generate_uid``, ``auto_sequence_6``)
stay batch-only and are refused here.  ``availableNow`` processes what is
there in bounded micro-batches and stops; the checkpoint location (below the
shared checkpoint folder) makes a restarted query continue exactly once.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from fieldmill.functions.text import qcol
from fieldmill.operators import mapping
from fieldmill.plans.spec import MappingSpec
from fieldmill.session import checkpoint_dir
from fieldmill.sources.delimited import CORRUPT, charset_of, has_shape

ROW_ORDER_RULES = ("generate_uid", "auto_sequence_6")


def read_delimited_stream(spark: SparkSession, path: str, columns: list[str], sep: str = ";",
                          na_tokens: list[str] | None = None, max_files_per_trigger: int = 100,
                          encoding: str = "utf-8") -> DataFrame:
    """Streaming twin of ``read_delimited``: same shape rules, header skipped."""
    from fieldmill.functions.text import NA_TOKENS
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns] + [T.StructField(CORRUPT, T.StringType())])
    raw = (spark.readStream.schema(schema).option("sep", sep).option("header", True).option("encoding", charset_of(encoding))
           .option("quote", '"').option("escape", '"').option("mode", "PERMISSIVE")
           .option("columnNameOfCorruptRecord", CORRUPT).option("maxFilesPerTrigger", max_files_per_trigger)
           .csv(path))
    kept = raw.where(has_shape(columns, sep))
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    return kept.select(*[F.when(~qcol(c).isin(tokens), qcol(c)).alias(c) for c in columns])


def project_stream(stream: DataFrame, spec: MappingSpec, postcode_dim: DataFrame | None = None,
                   payer_dim: DataFrame | None = None, key_col: str | None = None) -> DataFrame:
    """Apply the stateless rules of ``spec`` to a streaming DataFrame;
    ``key_col`` travels along as ``_key``."""
    bad = [t for t in spec.layout if spec.rule(t).type in ROW_ORDER_RULES]
    if bad:
        raise ValueError(f"rules need the batch row order: {bad}")
    src = stream.withColumn("_row", F.lit(None).cast("long"))
    if key_col:
        src = src.withColumn("_key", qcol(key_col))
    out = mapping.project_to_schema(src, spec, postcode_dim, payer_dim, keep=["_key"] if key_col else None)
    return out.drop("_row")


def run_available_now(df: DataFrame, out_path: str, name: str) -> StreamingQuery:
    """Write to Parquet with a checkpoint below the shared checkpoint folder."""
    ckpt = os.path.join(checkpoint_dir(df.sparkSession), "fieldmill-streams", name)
    q = (df.writeStream.format("parquet").option("checkpointLocation", ckpt)
         .outputMode("append").trigger(availableNow=True).start(out_path))
    q.awaitTermination()
    return q
