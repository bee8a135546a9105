"""Column matching, the rule projection onto a target layout, copies and
the table of leftover columns.

``project_to_schema`` compiles every target's rule into one Column and
evaluates the whole layout in a single ``select`` (lookups are joined in
first): a narrow plan, no shuffle unless a dimension is too big to
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions import checks, dates, keys, text
from fieldmill.functions.text import qcol
from fieldmill.operators import lookups
from fieldmill.plans.spec import ID_COLUMNS, LANR_COLUMNS, MappingSpec

# ------------------------------------------------------------ matching

# Auto-mapping vocabulary.
MOBILE_TARGETS = ["telefonmobil", "mobil", "p_handy"]
MOBILE_SOURCES = ["mobil", "handy", "mobile", "telefonmobil"]
PHONE_TARGETS = ["telefon", "p_tel", "tel"]
PHONE_SOURCES = ["telefon", "p_tel", "tel", "telefon1"]
SYNONYMS = [  # source spelling(s) -> target name fragments
    (["titel"], ["name1"]),
    (["vorname"], ["name2", "p_vname"]),
    (["nachname"], ["name3", "p_name"]),
    (["wohnort"], ["p_ort"]),
    (["geburtsdatum"], ["p_birth"]),
    (["geschlecht"], ["anrede", "p_anrede"]),
    (["telefon2"], ["p_telge"]),
    (["strasse", "straße"], ["p_street", "p_hausnummer", "strasse", "straße"]),
    (["kas_ik"], ["p_ik"]),
    (["status"], ["p_vs"]),
    (["versichertennummer"], ["p_vnr"]),
]
MATCH_KINDS = ["id", "lanr", "exact", "phone", "synonym", "substring"]


def _rank(s: Column, target: str) -> Column:
    t = target.lower()
    bare = t[2:] if t.startswith("p_") else t
    r = F.lit(None).cast("int")
    branches = []
    if t in ("p_nr", "ext_id"):
        branches.append((s.isin(ID_COLUMNS), 0))
    if t == "ext_id":
        branches.append((s.isin(LANR_COLUMNS), 1))
    branches.append(((s == t) | (s == bare), 2))
    if t in MOBILE_TARGETS:
        branches.append((s.isin(MOBILE_SOURCES), 3))
    else:
        if t in PHONE_TARGETS:
            branches.append((s.isin(PHONE_SOURCES), 3))
        syn = None
        for srcs, frags in SYNONYMS:
            if any(f in t for f in frags):
                cond = s.isin(srcs)
                syn = cond if syn is None else (syn | cond)
        if syn is not None:
            branches.append((syn, 4))
        branches.append((((F.instr(F.lit(t), s) > 0) | (F.instr(s, F.lit(t)) > 0)) & (F.length(s) > 3), 5))
    for cond, k in reversed(branches):
        r = F.when(cond, F.lit(k)).otherwise(r)
    return r


def match_columns(catalogue: DataFrame, target_layout: dict) -> DataFrame:
    """Best source column per (source_table, target) over a catalogue
    ``(source_table, position, column_name)`` of many files.

    Each catalogue row evaluates the (fixed, small) target list in one
    projection; one aggregation picks the best rank, then file order.
    """
    s = F.lower(F.col("column_name"))
    cands = F.array_compact(F.array(*[
        F.when(_rank(s, t).isNotNull(), F.struct(F.lit(t).alias("target"), _rank(s, t).alias("rank")))
        for t in target_layout]))
    hits = catalogue.select("source_table", "position", "column_name", F.explode(cands).alias("h"))
    best = (hits.groupBy("source_table", F.col("h.target").alias("target"))
            .agg(F.min_by(F.struct(F.col("column_name"), F.col("h.rank").alias("rank")),
                          F.struct(F.col("h.rank"), F.col("position"))).alias("b")))
    kinds = F.array(*[F.lit(k) for k in MATCH_KINDS])
    return best.select("source_table", "target", F.col("b.column_name").alias("source_column"),
                       F.element_at(kinds, F.col("b.rank") + 1).alias("match_kind"))


# ---------------------------------------------------------- projection


def _plain(src: Column, target: str, rule, df_cols: list[str], width: int = 5) -> tuple[Column, bool]:
    """The mapped-column branch without dates; returns (column, exempt from blank->null)."""
    v = text.clean_by_kind(src, target)
    kind = rule.type
    if kind == "default_value":
        return text.default_value(v, rule.param or ""), True
    if kind == "clean_plz":
        return text.clean_postcode(v, width), False
    if kind == "gender":
        return text.gender_salutation(v), False
    if kind == "split_street":
        return text.split_street(v), False
    if kind == "split_number":
        return text.split_number(v), False
    if kind == "merge_columns" and rule.param and rule.param in df_cols:
        strict = text.clean_kind(target) in ("name", "city")
        second = text.sanitize_strict(rule.param) if strict else text.sanitize_basic(rule.param)
        return text.utrim(F.concat(F.coalesce(v, F.lit("")), F.lit(" "), second)), False
    return v, False


def project_to_schema(df: DataFrame, spec: MappingSpec, postcode_dim: DataFrame | None = None,
                      payer_dim: DataFrame | None = None, row_col: str = "_row",
                      base_ms: int | None = None, keep: list[str] | None = None,
                      postcode_width: int = 5, split_titles: bool = False,
                      copies: bool = True, clean_kvnr: bool = False,
                      infer_salutation: bool = False, day_first: bool = True) -> DataFrame:
    """Evaluate every target column's rule; output ``row_col``, the target
    columns in declared order, then ``keep`` source columns.

    Options: ``split_titles`` strips a leading academic title from the
    sources of name targets (a ``titel`` target receives it);
    ``clean_kvnr`` reads letter O as zero after the first position in the
    sources of targets named like an insurance number (off by default, D6);
    ``infer_salutation`` fills an empty salutation target from the first
    name mapped to ``p_vname``/``name2`` (off by default; the original tool
    has the setting but never applies it); ``day_first=False`` reads dotted
    dates month first (D5).
    """
    cols = list(df.columns)
    src_of = {t: s for t, s in spec.sources.items() if s and s in cols}
    if clean_kvnr:
        for t, s in list(src_of.items()):
            if "kvnr" in t.lower() or "versichertennummer" in t.lower():
                df = df.withColumn(f"_ko0_{t}", text.clean_insurance_o(qcol(s)))
                src_of[t] = f"_ko0_{t}"
    titles = {}
    if split_titles:
        for t, s in src_of.items():
            if "name" in t.lower():
                df = df.withColumn(f"_st_{t}", text.split_title(qcol(s)))
                titles[t] = f"_st_{t}"
    exprs: dict[str, Column] = {}
    for t in spec.layout:
        rule = spec.rule(t)
        s = src_of.get(t)
        param_col = rule.param if rule.param in cols else None
        src = qcol(titles[t]).getField("name") if t in titles else (qcol(s) if s else None)
        k = rule.type
        if k == "lookup_plz_by_city":
            city = param_col or s
            if postcode_dim is not None and city:
                df = lookups.lookup_postcode_by_city(df, src, qcol(city), postcode_dim, f"_lk_{t}", postcode_width)
                exprs[t] = qcol(f"_lk_{t}")
            else:
                exprs[t] = text.pad_postcode(text.nullif_blank(text.utrim(src)), postcode_width) if src is not None else F.lit(None)
        elif k == "lookup_city_by_plz":
            plz = param_col or s
            if postcode_dim is not None and plz:
                df = lookups.lookup_city_by_postcode(df, src, qcol(plz), postcode_dim, f"_lk_{t}", postcode_width)
                exprs[t] = qcol(f"_lk_{t}")
            else:
                exprs[t] = text.nullif_blank(text.utrim(src)) if src is not None else F.lit(None)
        elif k == "lookup_ik_provider":
            ikc = param_col or s
            if payer_dim is not None and ikc:
                df = lookups.lookup_payer_by_id(df, qcol(ikc), payer_dim, f"_lk_{t}")
                exprs[t] = qcol(f"_lk_{t}")
            else:
                exprs[t] = F.lit(None)
        elif k == "auto_sequence_6":
            exprs[t] = keys.auto_sequence_6(src, qcol(row_col))
        elif k == "validate_ik":
            exprs[t] = F.when(checks.validate_ik(src), checks.ik_clean(src)) if src is not None else F.lit(None)
        elif k == "validate_kvnr":
            if src is not None:
                # staged: the repaired struct and its check become columns
                df = df.withColumn(f"_kr_{t}", checks.repair_kvnr(src))
                df = df.withColumn(f"_ko_{t}", checks.kvnr_check_ok(qcol(f"_kr_{t}").getField("value")))
                exprs[t] = F.when(~text.is_blank(src) & qcol(f"_ko_{t}"), qcol(f"_kr_{t}").getField("value"))
            else:
                exprs[t] = F.lit(None)
        elif k == "validate_email":
            exprs[t] = F.when(checks.validate_email(src), text.utrim(src)) if src is not None else F.lit(None)
        elif k == "static_value":
            exprs[t] = F.lit(rule.param or "")
        elif k == "generate_uid":
            exprs[t] = keys.generate_uid(qcol(row_col), base_ms)
        elif k == "copy_target":
            # before its copy: the cleaned mapped value, which a copy of this column sees
            exprs[t] = text.nullif_blank(text.clean_by_kind(src, t)) if src is not None else F.lit(None)
        elif src is not None and is_date_target(t, rule):
            # dates by rule or by name: the staged form (intermediates as columns)
            fallback = rule.param if k == "format_date" else None
            df = dates.with_format_date(df.withColumn(f"_dv_{t}", text.clean_by_kind(src, t)),
                                        qcol(f"_dv_{t}"), f"_fd_{t}", fallback, day_first)
            exprs[t] = qcol(f"_fd_{t}") if fallback else text.nullif_blank(qcol(f"_fd_{t}"))
        elif src is not None:
            c, exempt = _plain(src, t, rule, cols, postcode_width)
            exprs[t] = c if exempt else text.nullif_blank(c)
        elif k == "default_value" or (k == "format_date" and rule.param):
            exprs[t] = F.lit(rule.param or "")
        else:
            exprs[t] = F.lit(None)
        if t in titles and t == "titel":
            exprs[t] = qcol(titles[t]).getField("title")
    if "titel" in spec.layout and titles and spec.rule("titel").type == "none" and "titel" not in src_of:
        first = next(iter(titles.values()))
        exprs["titel"] = F.nullif(qcol(first).getField("title"), F.lit(""))
    if infer_salutation:
        first = next((src_of[t] for t in ("p_vname", "name2") if t in src_of), None)
        if first:
            guess = F.nullif(text.infer_salutation(qcol(first))["salutation"], F.lit(""))
            for t in spec.layout:
                if "anrede" in t.lower():
                    exprs[t] = F.coalesce(exprs[t], guess)
    out = df.select(qcol(row_col), *[exprs[t].cast("string").alias(t) for t in spec.layout],
                    *[qcol(c) for c in (keep or [])])
    return apply_copies(out, spec) if copies else out


def apply_copies(out: DataFrame, spec: MappingSpec) -> DataFrame:
    """``copy_target`` in schema order, after decisions; a missing column
    gives null.  A copy of a later copy column sees its pre-copy value."""
    for t in spec.layout:
        r = spec.rule(t)
        if r.type == "copy_target" and r.param:
            out = out.withColumn(t, qcol(r.param) if r.param in out.columns else F.lit(None).cast("string"))
    return out


def is_date_target(target: str, rule) -> bool:
    """Dates by rule or by name."""
    return rule.type == "format_date" or "birth" in target.lower() or "datum" in target.lower()


def rest_table(df: DataFrame, spec: MappingSpec, row_col: str = "_row") -> DataFrame:
    """All source columns neither mapped nor named by a rule parameter."""
    used = spec.used_columns()
    return df.select(qcol(row_col), *[qcol(c) for c in df.columns if c != row_col and c not in used])
