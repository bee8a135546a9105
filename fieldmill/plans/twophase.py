"""The check-then-export flow as two Spark runs.

Phase A produces every findings table a user decides on (pre-check flags,
cleanup preview, invalid identifiers, over-long cells, their summary).
Phase B takes the decisions -- bulk policies or decision tables -- and
produces the mapped table, the leftover columns and the extra-field tables.
Order of effects (results depend on it): cleanup -> title split -> rules ->
invalid decisions -> copy rules -> length check on the final values.
"""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.functions.text import qcol
from fieldmill.operators import claims, extras, findings, mapping, resolve
from fieldmill.operators.findings import Checked
from fieldmill.plans.spec import MappingSpec
from fieldmill.schemas import limits, parse_limit
from fieldmill.sources import sinks

# rules whose mapped targets become dates by name (the others decide the value themselves)
DATE_RULES = ("format_date", "none", "default_value", "clean_plz", "gender", "split_street", "split_number", "merge_columns")
VALIDATORS = ("validate_ik", "validate_kvnr", "validate_email")


@dataclass
class Job:
    """One source table (with a contiguous ``_row``), its mapping and options."""
    source: DataFrame
    spec: MappingSpec
    postcode_dim: DataFrame | None = None
    payer_dim: DataFrame | None = None
    clean_strings: bool = True
    split_titles: bool = False
    clean_kvnr: bool = False
    infer_salutation: bool = False
    postcode_width: int = 5
    day_first: bool = True
    extra_fields: list = field(default_factory=list)
    row_col: str = "_row"
    # one clock reading for all uids of the job: exported rows and the extra
    # values that refer to them carry the same ids in every action
    base_ms: int = field(default_factory=lambda: int(time.time() * 1000))

    def active_columns(self) -> list[str]:
        cols = [c for c in self.source.columns if c in self.spec.used_columns()]
        return [c for c in cols if c != self.row_col]

    def mapped(self) -> list[Checked]:
        return [Checked(s, t, parse_limit(self.spec.layout.get(t)), self.spec.rule(t).type)
                for t, s in self.spec.sources.items() if s]

    def validated(self) -> list[tuple[str, str, str]]:
        out = []
        for t in self.spec.layout:
            r, s = self.spec.rule(t), self.spec.source(t)
            if r.type in VALIDATORS and s and s in self.source.columns:
                out.append((t, s, r.type))
        return out

    def date_columns(self) -> list[str]:
        """Target columns that the projection reads as dates."""
        return [t for t in self.spec.layout if self.spec.source(t) in self.source.columns
                and mapping.is_date_target(t, self.spec.rule(t)) and self.spec.rule(t).type in DATE_RULES]


def claimed(job: Job, folder: str | None = None) -> Job:
    """``job`` with uids that no other claimed job of the shared ``folder``
    writes: counts the source's rows once and claims the milliseconds of its
    row ids and of its extra fields' value ids."""
    rows = job.source.count()
    return replace(job, base_ms=claims.claim_base(job.source.sparkSession, rows, rows * len(job.extra_fields),
                                                  folder, job.base_ms))


RAW = "_raw_"


def _cleaned_columns(job: Job) -> list[str]:
    """Columns the cleanup may rewrite: not those of insurance numbers, whose
    stray characters tell the repair what to mend."""
    repaired = {s for _, s, rule in job.validated() if rule == "validate_kvnr"}
    return [c for c in job.active_columns() if c not in repaired]


def _prepared(job: Job, cleanup_rejected: DataFrame | None = None) -> DataFrame:
    """The source both phases work on: after the accepted cleanup, and with a
    private copy of every column that is needed beside the target columns."""
    src = job.source
    if job.clean_strings:
        src = resolve.apply_cleanup(src, _cleaned_columns(job), cleanup_rejected, job.row_col)
    beside = {s for _, s, _ in job.validated()} | {f.source_col for f in job.extra_fields}
    return src.withColumns({RAW + c: qcol(c) for c in sorted(beside) if c in src.columns})


def phase_a(job: Job, split_mode: str = "export",
            cleanup_rejected: DataFrame | None = None) -> dict[str, DataFrame]:
    """All findings tables, on the table that phase B exports; nothing is written."""
    src = _prepared(job, cleanup_rejected)
    invalid = findings.invalid_cells(src, job.validated(), job.row_col)
    projected = _project(job, src)
    length = findings.length_conflicts(projected, limits(job.spec.layout), job.row_col)
    out = {
        "flagged": findings.flag_records(src, job.mapped(), job.row_col, split_mode=split_mode),
        "invalid": invalid,
        "length": length,
        "dates": findings.date_unparsed(projected, job.date_columns(), job.row_col),
        "dates_ambiguous": findings.date_ambiguous(src, [(t, job.spec.source(t)) for t in job.date_columns()],
                                                   job.row_col, job.day_first),
        "invalid_summary": findings.issue_summary(invalid, ["target_col", "rule_type", "issue"]),
        "length_summary": findings.issue_summary(length, ["col_name"]),
    }
    if job.clean_strings and _cleaned_columns(job):
        out["cleanup"] = findings.cleanup_preview(job.source, _cleaned_columns(job), job.row_col)
    return out


def _project(job: Job, src: DataFrame, copies: bool = True) -> DataFrame:
    keep = [c for c in src.columns if c.startswith(RAW)]
    return mapping.project_to_schema(src, job.spec, job.postcode_dim, job.payer_dim, job.row_col,
                                     base_ms=job.base_ms, keep=keep, postcode_width=job.postcode_width,
                                     split_titles=job.split_titles, copies=copies,
                                     clean_kvnr=job.clean_kvnr, infer_salutation=job.infer_salutation, day_first=job.day_first)


def phase_b(job: Job, cleanup_rejected: DataFrame | None = None, invalid_policy: str = "clear",
            invalid_decisions: DataFrame | None = None, length_policy: str = "truncate",
            length_decisions: DataFrame | None = None) -> dict[str, DataFrame]:
    """The export tables after the user's decisions."""
    out = _project(job, _prepared(job, cleanup_rejected), copies=False)
    checked = [(t, RAW + s) for t, s, _ in job.validated()]
    if checked:
        out = resolve.apply_invalid_decisions(out, checked, invalid_policy, invalid_decisions, job.row_col)
    out = mapping.apply_copies(out, job.spec)
    out = resolve.resolve_length(out, limits(job.spec.layout), length_policy, length_decisions, job.row_col)
    result = {"mapped": out.select(qcol(job.row_col), *[qcol(t) for t in job.spec.layout]),
              "rest": mapping.rest_table(job.source, job.spec, job.row_col)}
    if job.extra_fields:
        values = extras.property_values(out, job.extra_fields, id_col="id", row_col=job.row_col,
                                        base_ms=job.base_ms, prefix=RAW)
        result["property_values"] = values
        result["property_definitions"] = extras.property_definitions(values, job.extra_fields)
    return result


def export(tables: dict[str, DataFrame], out_dir: str, source_name: str, **kw) -> dict[str, str]:
    """Write phase-B tables with the tool's file names.  The projection has
    made blank cells of the mapped table null; an empty text that is left is a
    constant or default and is written empty."""
    paths = {"mapped": sinks.write_mapped(tables["mapped"], os.path.join(out_dir, "export.csv"),
                                          {c: None for c in tables["mapped"].columns if c != "_row"},
                                          **{"empty_literal": "", **kw}),
             "rest": sinks.write_rest(tables["rest"], out_dir, source_name, **kw)}
    if "property_values" in tables:
        paths["property_definitions"], paths["property_values"] = sinks.write_extra_fields(
            tables["property_definitions"], tables["property_values"], out_dir, **kw)
    return paths


def write_findings(tables: dict[str, DataFrame], out_dir: str, **kw) -> dict[str, str]:
    """Write phase-A tables (the flagged rows under the tool's file name)."""
    paths = {"flagged": sinks.write_flagged(tables["flagged"], out_dir, **kw)}
    for name, df in tables.items():
        if name != "flagged":
            paths[name] = sinks.write_table(df, os.path.join(out_dir, f"{name}.csv"), **kw)
    return paths


def decisions_from_findings(invalid: DataFrame, action: str = "keep") -> DataFrame:
    """A starting decision table (every invalid cell with one action) that a
    user edits before phase B."""
    return invalid.where(F.col("issue") == "invalid").select(
        "row_idx", "target_col", F.lit(action).alias("action"), F.lit(None).cast("string").alias("custom_val"))


def auto_spec(source: DataFrame, layout_name_or_dict, table_name: str = "source",
              row_col: str = "_row") -> MappingSpec:
    """Auto-map one source table: its header as a one-table column catalogue
    through ``match_columns``, then the default rules.  Only column names
    (metadata) and one row per target column reach the driver."""
    from fieldmill.plans.spec import default_rules
    from fieldmill.schemas import layout as _layout
    spark = source.sparkSession
    cols = [c for c in source.columns if c != row_col]
    target = _layout(layout_name_or_dict)
    cat = spark.createDataFrame([(table_name, i, c) for i, c in enumerate(cols)],
                                "source_table string, position int, column_name string")
    sources = {r.target: r.source_column for r in mapping.match_columns(cat, target).collect()}
    rules, sources = default_rules(target, cols, sources)
    return MappingSpec(target, sources, rules)
