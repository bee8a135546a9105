"""Writers for the mapped table, the findings and the extra-field tables.

Delimited output: ``;``, header, UTF-8, nulls written as the literal
``NULL``.  Each output is a folder of part files (one per task); Parquet is
the better default at scale and is available through ``fmt``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.functions.text import qcol

# Output names.
FLAGGED_NAME = "geflaggte_datensaetze_kontrolle.csv"
PROPERTY_NAME = "pat_property.csv"
PROPERTY_MAP_NAME = "pat_property_map.csv"
REST_PREFIX = "REST_UNMAPPED_"


def write_table(df: DataFrame, path: str, sep: str = ";", null_literal: str = "NULL",
                encoding: str = "UTF-8", fmt: str = "csv", mode: str = "overwrite",
                empty_literal: str | None = None) -> str:
    """``empty_literal``: what an empty text is written as (default: like a null)."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
        return path
    if encoding.lower() == "utf-8-sig":  # every part file begins with its header: put the mark there
        encoding, first = "UTF-8", df.columns[0]
        df = df.toDF("\ufeff" + first, *df.columns[1:])
    (df.write.mode(mode).option("sep", sep).option("header", True).option("encoding", encoding)
     .option("nullValue", null_literal).option("emptyValue", null_literal if empty_literal is None else empty_literal)
     .option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_mapped(df: DataFrame, path: str, target_layout: dict, **kw) -> str:
    """The target table, exactly the layout's columns in declared order."""
    return write_table(df.select(*[qcol(c) for c in target_layout]), path, **kw)


def write_flagged(flagged: DataFrame, out_dir: str, **kw) -> str:
    return write_table(flagged, os.path.join(out_dir, FLAGGED_NAME), **kw)


def write_extra_fields(definitions: DataFrame, values: DataFrame, out_dir: str, **kw) -> tuple[str, str]:
    """Both property tables beside the export; values ordered by field, then
    row (a range-partitioned sort, no single task)."""
    ordered = values.orderBy("field_idx", "_row").select("id", "property_id", "patienten_id", "content")
    return (write_table(definitions, os.path.join(out_dir, PROPERTY_NAME), **kw),
            write_table(ordered, os.path.join(out_dir, PROPERTY_MAP_NAME), **kw))


def write_rest(rest: DataFrame, out_dir: str, source_name: str, row_col: str = "_row", **kw) -> str:
    name = REST_PREFIX + os.path.splitext(os.path.basename(source_name))[0] + ".csv"
    cols = [c for c in rest.columns if c != row_col]
    return write_table(rest.select(*[qcol(c) for c in cols]), os.path.join(out_dir, name), **kw)
