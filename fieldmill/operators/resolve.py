"""Decisions about findings: bulk policies (no join) or per-cell decision
tables (few rows) joined back on the row key.

Decision tables are grouped to one row per ``row_idx`` holding a map
``column -> decision`` and equi-joined on that unique key (Spark picks the
join at run time; a unique key needs no salt), then every
affected column reads its decision with ``map_contains_key`` -- the big
table is never unpivoted for patching and a deliberate null survives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions import text
from fieldmill.functions.text import qcol


def _decision_maps(decisions: DataFrame, col_field: str, value: Column) -> DataFrame:
    """One map per row; of several decisions for one cell the greatest wins
    (by its fields in order), whatever the order of the table."""
    cells = (decisions.groupBy(F.col("row_idx").alias("_drow"), qcol(col_field).alias("_dcol"))
             .agg(F.max(value).alias("_dval")))
    return (cells.groupBy("_drow")
            .agg(F.map_from_entries(F.collect_list(F.struct("_dcol", "_dval"))).alias("_dmap")))


def _with_maps(df: DataFrame, maps: DataFrame, row_col: str) -> DataFrame:
    return df.join(maps, qcol(row_col) == F.col("_drow"), "left").drop("_drow")


def _has(col: str) -> Column:
    return F.coalesce(F.map_contains_key(F.col("_dmap"), F.lit(col)), F.lit(False))


def apply_cleanup(df: DataFrame, cols: list[str], rejected: DataFrame | None = None,
                  row_col: str = "_row") -> DataFrame:
    """Write strict-sanitized text into the source columns.

    Accept-all needs no join.  ``rejected`` (row_idx, col_name) lists the
    preview cells the user declined; those keep their raw text.
    """
    def cleaned(c: str) -> Column:
        raw = qcol(c)
        return F.when(text.is_blank(raw), raw).otherwise(text.sanitize_strict(raw))

    if rejected is None:
        return df.withColumns({c: cleaned(c) for c in cols})
    maps = _decision_maps(rejected, "col_name", F.lit(True))
    j = _with_maps(df, maps, row_col)
    return j.withColumns({c: F.when(_has(c), qcol(c)).otherwise(cleaned(c)) for c in cols}).drop("_dmap")


def apply_invalid_decisions(out: DataFrame, checked: list[tuple[str, str]], policy: str = "clear",
                            decisions: DataFrame | None = None, row_col: str = "_row") -> DataFrame:
    """Resolve invalid identifier cells.

    ``out`` holds the exported target column (valid value or null) next to
    its raw source column; ``checked`` = (target, source).  Bulk policy:
    ``keep`` (the raw text) or ``clear`` (null).  ``decisions`` (row_idx,
    target_col, action keep|clear|custom, custom_val) overrides per cell.
    """
    def bulk(t: str, s: str) -> Column:
        bad = qcol(t).isNull() & ~text.is_blank(qcol(s))
        return F.when(bad, qcol(s) if policy == "keep" else F.lit(None).cast("string")).otherwise(qcol(t))

    if decisions is None:
        return out.withColumns({t: bulk(t, s) for t, s in checked})
    maps = _decision_maps(decisions, "target_col", F.struct("action", "custom_val"))
    j = _with_maps(out, maps, row_col)

    def decided(t: str, s: str) -> Column:
        d = F.try_element_at(F.col("_dmap"), F.lit(t))
        custom = F.when(~text.is_blank(d["custom_val"]), d["custom_val"])
        return (F.when(_has(t) & (d["action"] == "keep"), qcol(s))
                .when(_has(t) & (d["action"] == "clear"), F.lit(None).cast("string"))
                .when(_has(t) & (d["action"] == "custom"), custom)
                .otherwise(bulk(t, s)))
    return j.withColumns({t: decided(t, s) for t, s in checked}).drop("_dmap")


def resolve_length(out: DataFrame, limits: dict[str, int], policy: str = "truncate",
                   decisions: DataFrame | None = None, row_col: str = "_row") -> DataFrame:
    """Over-long cells: ``truncate`` to the limit (default) or ``ignore``;
    ``decisions`` (row_idx, col_name, new_val) set single cells."""
    def bulk(c: str, n: int) -> Column:
        v = qcol(c)
        if policy == "ignore":
            return v
        return F.when(v.isNotNull() & (v != "NULL") & (F.length(v) > n), F.substring(v, 1, n)).otherwise(v)

    cols = {c: n for c, n in limits.items() if c in out.columns}
    if decisions is None:
        return out.withColumns({c: bulk(c, n) for c, n in cols.items()})
    maps = _decision_maps(decisions, "col_name", F.col("new_val"))
    j = _with_maps(out, maps, row_col)
    return j.withColumns({c: F.when(_has(c), F.try_element_at(F.col("_dmap"), F.lit(c))).otherwise(bulk(c, n))
                          for c, n in cols.items()}).drop("_dmap")
