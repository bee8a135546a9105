"""Table-level reports, all as ordinary DataFrames.

Per-row findings are built as an array of ``when(...)`` structs in one
projection, compacted and exploded: only the bad cells become rows, the big
table is never unpivoted, and nothing shuffles except ``issue_summary``
(a partial aggregate).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions import checks, datewords, text
from fieldmill.functions.dates import ISO, with_format_date
from fieldmill.functions.text import is_empty_token, qcol, utrim


@dataclass(frozen=True)
class Checked:
    """One mapped column as the pre-check sees it."""
    source: str
    target: str
    limit: int | None = None
    rule: str | None = None


def _extract(v: Column, rule: str, target: str, split_mode: str) -> Column:
    r, t = (rule or "").lower(), target.lower()
    is_hnr = any(k in r or k in t for k in ("hausnummer", "hnr"))
    is_street = any(k in r or k in t for k in ("strasse", "street"))
    if is_hnr:
        return text.precheck_number(v) if split_mode == "precheck" else F.coalesce(text.split_number(v), F.lit(""))
    if is_street:
        return text.precheck_street(v) if split_mode == "precheck" else F.coalesce(text.split_street(v), F.lit(""))
    return v


def _stage_checks(df: DataFrame, mapped: list[Checked], split_mode: str) -> tuple[DataFrame, list]:
    """Add the per-column intermediate values as columns, in dependency
    order, so each check reads plain column references (small expressions,
    no repeated evaluation of nested checks)."""
    live_maps = [(i, m) for i, m in enumerate(mapped) if m.source in df.columns]
    s1, s2, s3, s4, s5 = {}, {}, {}, {}, {}
    for i, m in live_maps:
        raw = qcol(m.source)
        s1[f"_v{i}"] = utrim(raw)
        s1[f"_skip{i}"] = is_empty_token(raw, ("nan", "none", "null", "<na>", ""))
        s2[f"_tv{i}"] = _extract(F.col(f"_v{i}"), m.rule, m.target, split_mode)
        tv = F.col(f"_tv{i}")
        rule, t = m.rule or "", m.target.lower()
        if rule not in ("validate_ik", "validate_kvnr"):
            s3[f"_cl{i}"] = text.sanitize_strict(tv)
        if rule == "validate_ik" or "ik" in t:
            s3[f"_ik{i}"] = checks.ik_check_ok(checks.ik_clean(tv))
        if rule == "validate_kvnr" or "kvnr" in t or "vnr" in t:
            s3[f"_kc{i}"] = F.upper(utrim(tv))
            s4[f"_kr{i}"] = checks.repair_kvnr(F.col(f"_kc{i}"))
            s5[f"_ko{i}"] = checks.kvnr_check_ok(F.col(f"_kr{i}.value"))
        if rule == "validate_email" or "mail" in t:
            s3[f"_em{i}"] = checks.validate_email(tv)
    for stage in (s1, s2, s3, s4, s5):
        if stage:
            df = df.withColumns(stage)
    return df, live_maps


def _msgs(i: int, m: Checked, check_email: bool) -> list[Column]:
    val, tv = F.col(f"_v{i}"), F.col(f"_tv{i}")
    live = ~F.col(f"_skip{i}") & (tv != "")
    out = []
    rule = m.rule or ""
    t = m.target.lower()
    if rule not in ("validate_ik", "validate_kvnr"):
        cleaned = F.col(f"_cl{i}")
        out.append(F.when(live & (cleaned != tv), F.format_string(
            "Sonderzeichen in '%s' -> '%s' (%s -> %s)", F.lit(m.source), F.lit(m.target), tv, cleaned)))
    if m.limit:
        out.append(F.when(live & (F.length(tv) > m.limit), F.format_string(
            "Überlänge in '%s' (aus '%s'): '%s' hat %d Zeichen (max. %d)",
            F.lit(m.target), F.lit(m.source), tv, F.length(tv), F.lit(m.limit))))
    if rule == "validate_ik" or "ik" in t:
        out.append(F.when(live & ~F.col(f"_ik{i}"), F.format_string(
            "Ungültige IK in '%s' (%s)", F.lit(m.source), val)))
    if rule == "validate_kvnr" or "kvnr" in t or "vnr" in t:
        ok, rep = F.col(f"_ko{i}"), f"_kr{i}"
        out.append(F.when(live & ok & F.col(f"{rep}.fixed"), F.format_string(
            "KVNR in '%s' korrigiert: (%s -> %s)", F.lit(m.source), F.col(f"_kc{i}"), F.col(f"{rep}.value"))))
        out.append(F.when(live & ~ok, F.format_string("Ungültige KVNR in '%s' (%s)", F.lit(m.source), val)))
    if check_email and (rule == "validate_email" or "mail" in t):
        out.append(F.when(live & ~F.col(f"_em{i}"), F.format_string(
            "Ungültige E-Mail in '%s' (%s)", F.lit(m.source), val)))
    return out


def flag_records(df: DataFrame, mapped: list[Checked], row_col: str = "_row",
                 split_mode: str = "export", check_email: bool = True) -> DataFrame:
    """Rows with at least one finding: ``__quell_zeile`` (source line =
    row + 2), ``__gefundene_fehler`` (findings joined by `` | ``), then all
    source columns."""
    src_cols = [c for c in df.columns if c != row_col]
    staged, live_maps = _stage_checks(df, mapped, split_mode)
    msgs = [x for i, m in live_maps for x in _msgs(i, m, check_email)]
    found = F.array_compact(F.array(*msgs)) if msgs else F.array().cast("array<string>")
    # A Generate keeps the findings array to one evaluation per row (a plain
    # filter on it would be pushed below the projection and evaluate it twice).
    row = F.struct((qcol(row_col) + 2).alias("__quell_zeile"), found.alias("_found"),
                   *[qcol(c) for c in src_cols])
    flagged = staged.select(F.explode(F.filter(F.array(row), lambda r: F.size(r["_found"]) > 0)).alias("_r"))
    return flagged.select(F.col("_r.__quell_zeile").alias("__quell_zeile"),
                          F.array_join("_r._found", " | ").alias("__gefundene_fehler"),
                          *[F.col("_r").getField(c).alias(c) for c in src_cols])


# --------------------------------------------------------- long findings


def _explode_cells(df: DataFrame, row_col: str, cells: list[Column], fields: str) -> DataFrame:
    """``fields``: the struct's fields, for tables without any column to check."""
    cells = cells or [F.lit(None).cast(f"struct<{fields}>")]
    arr = F.array_compact(F.array(*cells))
    return df.select(qcol(row_col).alias("row_idx"), F.explode(arr).alias("_c")).select("row_idx", "_c.*")


def invalid_cells(df: DataFrame, checked: list[tuple[str, str, str]], row_col: str = "_row") -> DataFrame:
    """Long table of bad identifier / e-mail cells.

    ``checked``: (target, source, rule) with rule validate_ik | validate_kvnr |
    validate_email.  A KVNR that the repair fixes is listed as ``repaired``
    (with its repaired value) rather than silently exported.
    """
    reps = {f"_kr{i}": checks.repair_kvnr(qcol(s)) for i, (_, s, r) in enumerate(checked) if r == "validate_kvnr"}
    if reps:
        df = df.withColumns(reps)
        df = df.withColumns({f"_ko{k[3:]}": checks.kvnr_check_ok(F.col(f"{k}.value")) for k in reps})
    cells = []
    for i, (target, source, rule) in enumerate(checked):
        raw = qcol(source)
        live = ~text.is_blank(raw)
        if rule == "validate_ik":
            bad, issue, fixed = ~checks.validate_ik(raw), F.lit("invalid"), F.lit(None).cast("string")
        elif rule == "validate_kvnr":
            ok = F.col(f"_ko{i}")
            bad = ~ok | F.col(f"_kr{i}.fixed")
            issue = F.when(ok, F.lit("repaired")).otherwise(F.lit("invalid"))
            fixed = F.when(ok, F.col(f"_kr{i}.value"))
        elif rule == "validate_email":
            bad, issue, fixed = ~checks.validate_email(raw), F.lit("invalid"), F.lit(None).cast("string")
        else:
            raise ValueError(f"not a validation rule: {rule}")
        cells.append(F.when(live & bad, F.struct(
            F.lit(target).alias("target_col"), F.lit(rule).alias("rule_type"),
            raw.alias("original_val"), issue.alias("issue"), fixed.alias("repaired_val"))))
    return _explode_cells(df, row_col, cells, "target_col: string, rule_type: string, original_val: string, "
                                              "issue: string, repaired_val: string")


def cleanup_preview(df: DataFrame, cols: list[str], row_col: str = "_row") -> DataFrame:
    """Cells whose strict-sanitized text differs from the raw text."""
    cells = []
    for c in cols:
        raw = qcol(c)
        cleaned = text.sanitize_strict(raw)
        cells.append(F.when(~text.is_blank(raw) & (cleaned != raw), F.struct(
            F.lit(c).alias("col_name"), raw.alias("original"), cleaned.alias("cleaned"))))
    return _explode_cells(df, row_col, cells, "col_name: string, original: string, cleaned: string")


def length_conflicts(df: DataFrame, limits: dict[str, int], row_col: str = "_row") -> DataFrame:
    """Cells longer than their column's VARCHAR limit (literal NULL exempt)."""
    cells = []
    for c, n in limits.items():
        if c not in df.columns:
            continue
        v = qcol(c)
        cells.append(F.when(v.isNotNull() & (v != "NULL") & (F.length(v) > n), F.struct(
            F.lit(c).alias("col_name"), F.lit(n).alias("limit"), v.alias("orig_val"))))
    return _explode_cells(df, row_col, cells, "col_name: string, limit: int, orig_val: string")


def date_unparsed(df: DataFrame, date_cols: list[str], row_col: str = "_row") -> DataFrame:
    """Cells of projected date columns that are no ISO date: the export writes
    their text unchanged.  ISO-shaped text that is no day of the calendar
    counts, too."""
    cells = []
    for c in date_cols:
        v = qcol(c)
        cells.append(F.when(~text.is_blank(v) & ~F.coalesce(
            v.rlike(ISO) & F.try_to_date(v, "yyyy-MM-dd").isNotNull(), F.lit(False)), F.struct(
            F.lit(c).alias("target_col"), v.alias("original_val"), F.lit("date_unparsed").alias("issue"))))
    return _explode_cells(df, row_col, cells, "target_col: string, original_val: string, issue: string")


def date_ambiguous(df: DataFrame, columns: list[tuple[str, str]], row_col: str = "_row",
                   day_first: bool = True) -> DataFrame:
    """Cells of (target, source) date columns whose day and month could change
    places: the text, how the projection reads it and the other reading.
    Nulls, blanks, year-first dates, month names and equal numbers are clear."""
    cells = []
    for t, s in columns:
        read = f"_da_{t}"
        df = with_format_date(df.withColumn(f"_dv_{t}", text.clean_by_kind(qcol(s), t)), qcol(f"_dv_{t}"), read,
                              day_first=day_first)
        iso = qcol(read)
        other = F.concat(F.substring(iso, 1, 5), F.substring(iso, 9, 2), F.lit("-"), F.substring(iso, 6, 2))
        cells.append(F.when(datewords.ambiguous(text.utrim(qcol(f"_dv_{t}"))) & iso.rlike(ISO), F.struct(
            F.lit(t).alias("target_col"), qcol(s).alias("original_val"), iso.alias("read_as"),
            other.alias("other_reading"), F.lit("date_ambiguous").alias("issue"))))
    return _explode_cells(df, row_col, cells, "target_col: string, original_val: string, read_as: string, "
                                              "other_reading: string, issue: string")


def issue_summary(findings: DataFrame, by: list[str]) -> DataFrame:
    """Counts per issue group (map-side partial aggregation, tiny output)."""
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
