"""Extra fields as entity-attribute-value tables (definitions + values).

Values come from one DataFrame that holds both the target ``id`` and the
extra source columns (same row), so no join is needed; the unpivot is a
narrow ``explode`` followed by a blank filter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.functions import keys, text
from fieldmill.functions.text import qcol

# The definition row's constant attributes.
PROPERTY_MAXWIDTH = 255
PROPERTY_SORT = 0
PROPERTY_SYSTEM = 202
PROPERTY_TYPES = ["TXT", "NUM", "DATE", "BOOL"]


def default_field_name(source_col: str) -> str:
    """lower, trim, space/'-' -> '_', keep letters, digits and '_'."""
    s = source_col.strip().lower()
    s = re.sub(r"[ \-]", "_", s)
    return re.sub(r"\W", "", s)


@dataclass(frozen=True)
class ExtraField:
    source_col: str
    field_name: str | None = None
    data_type: str = "TXT"

    def __post_init__(self):
        if self.data_type not in PROPERTY_TYPES:
            raise ValueError(f"data_type must be one of {PROPERTY_TYPES}")

    @property
    def property_id(self) -> str:
        return "#" + (self.field_name or default_field_name(self.source_col)).lstrip("#")


def property_values(df: DataFrame, fields: list[ExtraField], id_col: str = "id",
                    row_col: str = "_row", base_ms: int | None = None, prefix: str = "") -> DataFrame:
    """(id, property_id, patienten_id, content, field_idx, _row) for every
    non-blank extra cell; ``content`` trimmed; ids are deterministic uids of
    ``row * n_fields + field_idx``, counted downwards from the base so that
    none equals a row's uid of the same job.  ``prefix``: before the fields' column
    names in ``df`` (private copies that no target column can hide)."""
    if len({f.property_id for f in fields}) < len(fields):
        raise ValueError("two extra fields share a property id")
    n = len(fields)
    cells = F.array(*[F.struct(F.lit(i).alias("field_idx"), F.lit(f.property_id).alias("property_id"),
                               qcol(prefix + f.source_col).alias("raw")) for i, f in enumerate(fields)])
    pid = qcol(id_col) if id_col in df.columns else qcol(row_col).cast("string")
    long = df.select(qcol(row_col), pid.alias("patienten_id"), F.explode(cells).alias("c"))
    long = long.where(~text.is_blank(F.col("c.raw")))
    vrow = qcol(row_col) * n + F.col("c.field_idx")
    return long.select(keys.generate_uid(-vrow - 1, base_ms).alias("id"), F.col("c.property_id").alias("property_id"),
                       "patienten_id", text.utrim(F.col("c.raw")).alias("content"),
                       F.col("c.field_idx").alias("field_idx"), qcol(row_col))


def property_definitions(values: DataFrame, fields: list[ExtraField]) -> DataFrame:
    """One definition row per chosen field that has a value (label = source
    column).  ``values``: the value table, or the source table it is made of."""
    spark = values.sparkSession
    if "property_id" not in values.columns:
        values = property_values(values, fields)
    rows = [(i, f.property_id, f.source_col, f.data_type) for i, f in enumerate(fields)]
    chosen = spark.createDataFrame(rows, "field_idx int, id string, label string, proptyp string")
    chosen = chosen.join(values.select(F.col("property_id").alias("id")).distinct(), "id", "left_semi")
    return chosen.select(
        "id", "label", "proptyp", F.lit(None).cast("string").alias("options"),
        F.lit(PROPERTY_MAXWIDTH).alias("maxwidth"), F.lit(None).cast("string").alias("bereich"),
        F.lit(PROPERTY_SORT).alias("sortierung"), F.lit(PROPERTY_SYSTEM).alias("system"),
        F.lit(None).cast("string").alias("kartei_id"))
