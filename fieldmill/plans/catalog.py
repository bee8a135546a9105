"""Driver queries: one per operator id, each over whole driver tables.

``QUERIES[id](spark, sf_dir) -> DataFrame`` runs fieldmill's operator on an
input derived from the tables; ``ORACLES[id]`` is DuckDB SQL computing the
same result independently (see ``oracle.py``).  Column names match exactly.
Round-trip queries for sources and sinks write to a new folder below the
shared checkpoint folder and read the result back with Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.functions import checks, dates, keys, mail, text
from fieldmill.operators import claims, extras, findings, lookups, mapping, resolve, upsert
from fieldmill.operators.findings import Checked
from fieldmill.operators import similar
from fieldmill.operators.rowid import with_row_index
from fieldmill.plans import inputs as I
from fieldmill.plans import oracle as O
from fieldmill.plans.spec import MappingSpec, Rule, default_rules
from fieldmill.schemas import LAYOUTS, limits
from fieldmill.session import scratch_path
from fieldmill.sources import delimited, dims, sinks
from fieldmill.streaming import sequence_stream

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _persons(spark, sf) -> DataFrame:
    return I.derived(spark, sf, I.PERSONS, ["customer"])


def _persons_rows(spark, sf) -> DataFrame:
    return with_row_index(_persons(spark, sf), order_by=["k"])


P = f"({I.PERSONS})"
PR = f"(SELECT *, row_number() OVER (ORDER BY k) - 1 AS _row FROM {P})"
b = O.blank

# =================================================================== cleaning


@query("sanitize_basic", f"SELECT doc_id, {O.basic('text')} AS cleaned FROM documents")
def q_sanitize_basic(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.sanitize_basic("text").alias("cleaned"))


@query("sanitize_strict", f"SELECT doc_id, {O.strict('text')} AS cleaned FROM documents")
def q_sanitize_strict(spark, sf):
    return _table(spark, sf, "documents").select("doc_id", text.sanitize_strict("text").alias("cleaned"))


@query("clean_by_kind", f"""
SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN role = 'user' THEN {O.strict('text')}
  WHEN role = 'assistant' THEN {O.basic('text')} ELSE {O.utrim('text')} END AS cleaned
FROM conversations""")
def q_clean_by_kind(spark, sf):
    c = _table(spark, sf, "conversations")
    out = (F.when(F.col("role") == "user", text.clean_by_kind("text", "p_name"))
           .when(F.col("role") == "assistant", text.clean_by_kind("text", "p_ort"))
           .otherwise(text.clean_by_kind("text", "p_email")))
    return c.select("conv_id", "turn", out.alias("cleaned"))


_DATE_IN_SPARK = """CASE o_orderkey % 7
  WHEN 0 THEN date_format(o_orderdate, 'd.M.yyyy') WHEN 1 THEN date_format(o_orderdate, 'yyyy/M/d')
  WHEN 2 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 3 THEN date_format(o_orderdate, 'd.M.yy')
  WHEN 4 THEN 'abc' || cast(o_orderkey as string) WHEN 5 THEN date_format(o_orderdate, 'M/d/yyyy')
  ELSE '31.02.' || date_format(o_orderdate, 'yyyy') END"""
_DATE_IN_DUCK = """CASE o_orderkey % 7
  WHEN 0 THEN strftime(o_orderdate, '%-d.%-m.%Y') WHEN 1 THEN strftime(o_orderdate, '%Y/%-m/%-d')
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%-d.%-m.%y')
  WHEN 4 THEN 'abc' || cast(o_orderkey as string) WHEN 5 THEN strftime(o_orderdate, '%-m/%-d/%Y')
  ELSE '31.02.' || strftime(o_orderdate, '%Y') END"""


@query("format_date", f"""
SELECT o_orderkey, date_in, {O.format_date('date_in')} AS date_out
FROM (SELECT o_orderkey, {_DATE_IN_DUCK} AS date_in FROM orders)""")
def q_format_date(spark, sf):
    o = I.derived(spark, sf, f"SELECT o_orderkey, {_DATE_IN_SPARK} AS date_in FROM orders", ["orders"])
    return dates.with_format_date(o, "date_in", "date_out").select("o_orderkey", "date_in", "date_out")


_SPELLED = """CASE o_orderkey % 8
  WHEN 0 THEN {day} || '. ' || {german} || ' ' || {year} WHEN 1 THEN {month} || ' ' || {day} || ', ' || {year}
  WHEN 2 THEN {day} || '-' || upper({short}) || '-' || {year} WHEN 3 THEN {weekday} || ', ' || {day} || ' ' || {month} || ' ' || {year}
  WHEN 4 THEN {day} || '-' || {number} || '-' || {year} WHEN 5 THEN {year} || '.' || {number} || '.' || {day}
  WHEN 6 THEN {day} || '. ' || {short} || ' ' || substr({year}, 3) || ' 10:30 Uhr'
  ELSE 'im ' || {german} || ' ' || {year} END"""
_GERMAN = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(
    ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November",
     "Dezember"], 1)) + " END"
_PARTS = {"day": "cast(day(o_orderdate) as varchar(2))", "number": "cast(month(o_orderdate) as varchar(2))",
          "year": "cast(year(o_orderdate) as varchar(4))", "german": f"({_GERMAN})"}
_SPELLED_SPARK = _SPELLED.format(month="date_format(o_orderdate, 'MMMM')", short="date_format(o_orderdate, 'MMM')",
                                 weekday="date_format(o_orderdate, 'EEEE')", **_PARTS)
_SPELLED_DUCK = _SPELLED.format(month="strftime(o_orderdate, '%B')", short="strftime(o_orderdate, '%b')",
                                weekday="strftime(o_orderdate, '%A')", **_PARTS)


@query("format_date_spelled", f"""
SELECT o_orderkey, date_in, {O.spelled_date('date_in')} AS date_out
FROM (SELECT o_orderkey, {_SPELLED_DUCK} AS date_in FROM orders)""")
def q_format_date_spelled(spark, sf):
    o = I.derived(spark, sf, f"SELECT o_orderkey, {_SPELLED_SPARK} AS date_in FROM orders", ["orders"])
    return dates.with_format_date(o, "date_in", "date_out").select("o_orderkey", "date_in", "date_out")


@query("ambiguous_dates", f"""
SELECT o_orderkey AS row_idx, date_in AS original_val,
  strftime(o_orderdate, '%Y-%m-%d') AS read_as, strftime(o_orderdate, '%Y-%d-%m') AS other_reading
FROM (SELECT o_orderkey, o_orderdate, {_DATE_IN_DUCK} AS date_in FROM orders)
WHERE o_orderkey % 7 IN (0, 3, 5) AND day(o_orderdate) <= 12 AND day(o_orderdate) <> month(o_orderdate)""")
def q_ambiguous_dates(spark, sf):
    o = I.derived(spark, sf, f"SELECT o_orderkey, {_DATE_IN_SPARK} AS date_in FROM orders", ["orders"])
    found = findings.date_ambiguous(o, [("p_birth", "date_in")], "o_orderkey")
    return found.select("row_idx", "original_val", "read_as", "other_reading")


@query("default_value", f"""
SELECT k, seg, CASE WHEN seg IS NULL OR {O.utrim('seg')} IN ('', 'nan', 'null', 'None') THEN 'Unbekannt'
  ELSE seg END AS seg_out FROM {P}""")
def q_default_value(spark, sf):
    return _persons(spark, sf).select("k", "seg", text.default_value("seg", "Unbekannt").alias("seg_out"))


@query("static_value", f"SELECT k, 'AKTIV' AS status FROM {P}")
def q_static_value(spark, sf):
    return _persons(spark, sf).select("k", text.static_value("AKTIV").alias("status"))


@query("fill_null", f"SELECT k, seg, CASE WHEN {b('seg')} THEN 'NULL' ELSE seg END AS seg_out FROM {P}")
def q_fill_null(spark, sf):
    return _persons(spark, sf).select("k", "seg", text.fill_null("seg", "NULL").alias("seg_out"))


@query("clean_postcode", f"SELECT k, plz_in, {O.clean_postcode('plz_in')} AS plz FROM {P}")
def q_clean_postcode(spark, sf):
    return _persons(spark, sf).select("k", "plz_in", text.clean_postcode("plz_in").alias("plz"))


@query("gender_salutation", f"SELECT k, sex, {O.gender('sex')} AS anrede FROM {P}")
def q_gender_salutation(spark, sf):
    return _persons(spark, sf).select("k", "sex", text.gender_salutation("sex").alias("anrede"))


@query("split_street", f"SELECT k, street, {O.split_street('street')} AS street_out FROM {P}")
def q_split_street(spark, sf):
    return _persons(spark, sf).select("k", "street", text.split_street("street").alias("street_out"))


@query("split_number", f"SELECT k, street, {O.split_number('street')} AS number_out FROM {P}")
def q_split_number(spark, sf):
    return _persons(spark, sf).select("k", "street", text.split_number("street").alias("number_out"))


@query("precheck_street", f"SELECT k, street, {O.precheck_street('street')} AS street_out FROM {P}")
def q_precheck_street(spark, sf):
    return _persons(spark, sf).select("k", "street", text.precheck_street("street").alias("street_out"))


@query("precheck_number", f"SELECT k, street, {O.precheck_number('street')} AS number_out FROM {P}")
def q_precheck_number(spark, sf):
    return _persons(spark, sf).select("k", "street", text.precheck_number("street").alias("number_out"))


_TITLED = ("CASE c_custkey % 13 " + " ".join(
    f"WHEN {i} THEN '{t} ' || c_name" for i, t in enumerate(text.TITLES))
    + " WHEN 10 THEN 'dr. med.' WHEN 11 THEN 'PROF.  ' || c_name ELSE c_name END")


@query("split_title", f"""
SELECT c_custkey, name_in, {O.title_of('name_in')} AS title, {O.title_rest('name_in')} AS rest
FROM (SELECT c_custkey, {_TITLED} AS name_in FROM customer)""")
def q_split_title(spark, sf):
    c = I.derived(spark, sf, f"SELECT c_custkey, {_TITLED} AS name_in FROM customer", ["customer"])
    s = text.split_title("name_in")
    return c.select("c_custkey", "name_in", s["title"].alias("title"), s["name"].alias("rest"))


_FIRST = text.MALE_FIRST_NAMES + text.FEMALE_FIRST_NAMES + ["Hans-Peter", " Maria ", "Kim", "x-y"]
_FIRST_SQL = "CASE c_custkey % 20 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_FIRST)) + " END"


@query("infer_salutation", f"""
SELECT c_custkey, fn,
  CASE WHEN {O.first_name_key('fn')} IN ({', '.join(map(O.q, O.MALE))}) THEN 'männlich'
       WHEN {O.first_name_key('fn')} IN ({', '.join(map(O.q, O.FEMALE))}) THEN 'weiblich' ELSE 'unbekannt' END AS gender,
  CASE WHEN {O.first_name_key('fn')} IN ({', '.join(map(O.q, O.MALE))}) THEN 'Herr'
       WHEN {O.first_name_key('fn')} IN ({', '.join(map(O.q, O.FEMALE))}) THEN 'Frau' ELSE '' END AS salutation
FROM (SELECT c_custkey, {_FIRST_SQL} AS fn FROM customer)""")
def q_infer_salutation(spark, sf):
    c = I.derived(spark, sf, f"SELECT c_custkey, {_FIRST_SQL} AS fn FROM customer", ["customer"])
    s = text.infer_salutation("fn")
    return c.select("c_custkey", "fn", s["gender"].alias("gender"), s["salutation"].alias("salutation"))


@query("clean_insurance_o", f"""
SELECT k, kv, substr(upper({O.utrim('kv')}), 1, 1) || replace(substr(upper({O.utrim('kv')}), 2), 'O', '0') AS kv_out
FROM {P}""")
def q_clean_insurance_o(spark, sf):
    return _persons(spark, sf).select("k", "kv", text.clean_insurance_o("kv").alias("kv_out"))


# ================================================================== checks


@query("validate_kvnr", f"""
SELECT k, kv, CAST({O.kvnr_ok(O.kvnr_clean('kv'))} AS INTEGER) AS kv_valid FROM {P}""")
def q_validate_kvnr(spark, sf):
    return _persons(spark, sf).select("k", "kv", checks.validate_kvnr("kv").cast("int").alias("kv_valid"))


@query("repair_kvnr", f"""
SELECT k, kv, CAST({O.kvnr_fixed(O.kvnr_clean('kv'))} AS INTEGER) AS fixed, {O.kvnr_value(O.kvnr_clean('kv'))} AS kv_value
FROM {P}""")
def q_repair_kvnr(spark, sf):
    p = _persons(spark, sf).withColumn("_r", checks.repair_kvnr("kv"))
    return p.select("k", "kv", F.col("_r.fixed").cast("int").alias("fixed"), F.col("_r.value").alias("kv_value"))


_IK_IN = """CASE o_orderkey % 5
    WHEN 0 THEN cast(260000000 + o_orderkey * 37 as string) || '.0'
    WHEN 1 THEN cast(o_orderkey % 1000 as string)
    WHEN 2 THEN ' ' || cast(100000000 + o_orderkey * 53 as string)
    WHEN 3 THEN cast(1000000000 + o_orderkey as string)
    ELSE cast(260000000 + o_orderkey * 37 as string) END"""


@query("validate_ik", f"""
SELECT o_orderkey, ik_in, CAST(CASE WHEN ik_in IS NULL THEN false ELSE {O.ik_ok(O.ik_clean('ik_in'))} END AS INTEGER) AS ik_valid,
  CASE WHEN {O.ik_ok(O.ik_clean('ik_in'))} THEN {O.ik_clean('ik_in')} END AS ik_out
FROM (SELECT o_orderkey, {_IK_IN} AS ik_in FROM orders)""")
def q_validate_ik(spark, sf):
    o = I.derived(spark, sf, f"SELECT o_orderkey, {_IK_IN} AS ik_in FROM orders", ["orders"])
    ok = checks.validate_ik("ik_in")
    return o.select("o_orderkey", "ik_in", ok.cast("int").alias("ik_valid"),
                    F.when(ok, checks.ik_clean("ik_in")).alias("ik_out"))


@query("validate_email", f"""
SELECT k, mail, CAST({O.email_ok('mail')} AS INTEGER) AS mail_valid FROM {P}""")
def q_validate_email(spark, sf):
    return _persons(spark, sf).select("k", "mail", checks.validate_email("mail").cast("int").alias("mail_valid"))


# label as written, its ASCII form (null: the address is not valid)
_WIRE = [("müller.de", "xn--mller-kva.de"), ("BÜCHER.example", "xn--bcher-kva.example"), ("straße.de", "xn--strae-oqa.de"),
         ("例え。テスト", "xn--r8jz45g.xn--zckzah"), ("Mail.Example.ORG", "mail.example.org"), ("ü..de", None), ("-ü.de", None),
         ("ü", None)]
_MAIL_IN = "replace(lower(c_name), '#', '.') || '@' || CASE c_custkey % 8 " + " ".join(
    f"WHEN {i} THEN '{w}'" for i, (w, _) in enumerate(_WIRE)) + " END"
_MAIL_OUT = "CASE c_custkey % 8 " + " ".join(
    f"WHEN {i} THEN replace(lower(c_name), '#', '.') || '@{a}'" for i, (_, a) in enumerate(_WIRE) if a) + " END"


@query("email_ascii", f"SELECT c_custkey AS k, {_MAIL_IN} AS mail, {_MAIL_OUT} AS mail_ascii FROM customer")
def q_email_ascii(spark, sf):
    c = I.derived(spark, sf, f"SELECT c_custkey AS k, {_MAIL_IN} AS mail FROM customer", ["customer"])
    return c.select("k", "mail", mail.email_ascii("mail").alias("mail_ascii"))


_CHECKED = [("p_vnr", "kv", "validate_kvnr"), ("p_ik", "ik", "validate_ik"), ("p_email", "mail", "validate_email")]
_KV_C = O.kvnr_clean("kv")
_KV_OK = O.kvnr_ok(O.kvnr_value(_KV_C))
INVALID_SQL = f"""
SELECT _row AS row_idx, 'p_vnr' AS target_col, 'validate_kvnr' AS rule_type, kv AS original_val,
  CASE WHEN {_KV_OK} THEN 'repaired' ELSE 'invalid' END AS issue,
  CASE WHEN {_KV_OK} THEN {O.kvnr_value(_KV_C)} END AS repaired_val
FROM {PR} WHERE NOT {b('kv')} AND (NOT {_KV_OK} OR {O.kvnr_fixed(_KV_C)})
UNION ALL
SELECT _row, 'p_ik', 'validate_ik', ik, 'invalid', NULL FROM {PR}
WHERE NOT {b('ik')} AND NOT {O.ik_ok(O.ik_clean('ik'))}
UNION ALL
SELECT _row, 'p_email', 'validate_email', mail, 'invalid', NULL FROM {PR}
WHERE NOT {b('mail')} AND NOT {O.email_ok('mail')}
"""


@query("invalid_cells", INVALID_SQL)
def q_invalid_cells(spark, sf):
    return findings.invalid_cells(_persons_rows(spark, sf), _CHECKED)


@query("issue_summary", f"""
SELECT target_col, rule_type, issue, count(*) AS n FROM ({INVALID_SQL}) GROUP BY target_col, rule_type, issue""")
def q_issue_summary(spark, sf):
    return findings.issue_summary(q_invalid_cells(spark, sf), ["target_col", "rule_type", "issue"])


def _exported(df: DataFrame) -> DataFrame:
    df = df.withColumn("_r", checks.repair_kvnr("kv"))
    df = df.withColumn("_ok", checks.kvnr_check_ok(F.col("_r.value")))
    return df.select(
        "_row", "kv", "ik", "mail",
        F.when(~text.is_blank("kv") & F.col("_ok"), F.col("_r.value")).alias("p_vnr"),
        F.when(checks.validate_ik("ik"), checks.ik_clean("ik")).alias("p_ik"),
        F.when(checks.validate_email("mail"), text.utrim("mail")).alias("p_email"))


def _decided(col: str, src: str, exp: str) -> str:
    return (f"CASE WHEN {exp} IS NULL AND NOT {b(src)} THEN (CASE _row % 3 WHEN 0 THEN {src} "
            f"WHEN 1 THEN (CASE WHEN _row % 6 = 1 THEN NULL ELSE 'FIX' || cast(_row as varchar) END) "
            f"ELSE NULL END) ELSE {exp} END AS {col}")


_EXP_VNR = f"(CASE WHEN NOT {b('kv')} AND {_KV_OK} THEN {O.kvnr_value(_KV_C)} END)"
_EXP_IK = f"(CASE WHEN {O.ik_ok(O.ik_clean('ik'))} THEN {O.ik_clean('ik')} END)"
_EXP_MAIL = f"(CASE WHEN {O.email_ok('mail')} THEN {O.utrim('mail')} END)"


@query("apply_invalid_decisions", f"""
SELECT _row, {_decided('p_vnr', 'kv', _EXP_VNR)}, {_decided('p_ik', 'ik', _EXP_IK)},
  {_decided('p_email', 'mail', _EXP_MAIL)} FROM {PR}""")
def q_apply_invalid_decisions(spark, sf):
    rows = _persons_rows(spark, sf)
    cells = findings.invalid_cells(rows, _CHECKED).where(F.col("issue") == "invalid")
    decisions = (cells.where(F.col("row_idx") % 3 != 2)
                 .select("row_idx", "target_col",
                         F.when(F.col("row_idx") % 3 == 0, F.lit("keep")).otherwise(F.lit("custom")).alias("action"),
                         F.when(F.col("row_idx") % 6 == 1, F.lit(" "))
                         .otherwise(F.concat(F.lit("FIX"), F.col("row_idx").cast("string"))).alias("custom_val")))
    out = resolve.apply_invalid_decisions(_exported(rows), [(t, s) for t, s, _ in _CHECKED],
                                          policy="clear", decisions=decisions)
    return out.select("_row", "p_vnr", "p_ik", "p_email")


# ==================================================================== keys

_EXISTING = """CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN ' ' || cast(o_custkey as string)
  WHEN 2 THEN 'None' ELSE 'NULL' END"""
_ORD = f"(SELECT o_orderkey, {_EXISTING} AS existing, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row FROM orders)"


def _orders_existing(spark, sf) -> DataFrame:
    o = I.derived(spark, sf, f"SELECT o_orderkey, {_EXISTING} AS existing FROM orders", ["orders"])
    return with_row_index(o, order_by=["o_orderkey"])


@query("auto_sequence_6", f"""
SELECT o_orderkey, existing, CASE WHEN existing IS NULL OR {O.utrim('existing')} IN ('', 'nan', 'None', 'NULL')
  THEN {O.seq6('_row')} ELSE {O.utrim('existing')} END AS p_nr FROM {_ORD}""")
def q_auto_sequence_6(spark, sf):
    o = _orders_existing(spark, sf)
    return o.select("o_orderkey", "existing", keys.auto_sequence_6("existing", "_row").alias("p_nr"))


@query("id_carry_over", f"""
SELECT o_orderkey, existing, CASE WHEN existing IS NULL OR {O.utrim('existing')} IN ('', 'nan', 'None')
  THEN {O.seq6('_row')} ELSE {O.utrim('existing')} END AS p_nr FROM {_ORD}""")
def q_id_carry_over(spark, sf):
    o = _orders_existing(spark, sf)
    return o.select("o_orderkey", "existing", keys.id_carry_over("existing", "_row").alias("p_nr"))


@query("generate_uid", "SELECT count(*) AS n, count(*) AS n_distinct, count(*) AS n_shape FROM orders")
def q_generate_uid(spark, sf):
    o = with_row_index(_table(spark, sf, "orders").select("o_orderkey"), order_by=["o_orderkey"])
    u = o.select(keys.generate_uid("_row").alias("uid"))
    return u.agg(F.count(F.lit(1)).cast("long").alias("n"), F.countDistinct("uid").cast("long").alias("n_distinct"),
                 F.sum(F.col("uid").rlike(keys.UID_SHAPE).cast("long")).cast("long").alias("n_shape"))


@query("generate_uid_claimed", "SELECT 2 * count(*) AS n, 2 * count(*) AS n_distinct FROM orders")
def q_generate_uid_claimed(spark, sf):
    """Two jobs of one clock reading over all orders: no id twice."""
    o = with_row_index(_table(spark, sf, "orders").select("o_orderkey"), order_by=["o_orderkey"])
    folder, n = scratch_path(spark, "uids"), o.count()
    first, second = (claims.claim_base(spark, n, folder=folder, now_ms=1_700_000_000_000) for _ in range(2))
    u = o.select(keys.generate_uid("_row", first).alias("uid")).union(o.select(keys.generate_uid("_row", second)))
    return u.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("uid").alias("n_distinct"))


@query("auto_sequence_stream", """
SELECT o_orderkey, CASE WHEN existing IS NULL THEN printf('%06d', rn) ELSE existing END AS id
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'K' || o_custkey END AS existing,
        row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders)""")
def q_auto_sequence_stream(spark, sf):
    # a pattern, since a stream takes no single file by its name
    o = spark.readStream.schema(_table(spark, sf, "orders").schema).parquet(f"{sf}/orders.parque[t]") \
        .selectExpr("o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN 'K' || o_custkey END AS existing")
    out = scratch_path(spark, "sequence")
    sequence_stream.run_sequence(o, out, out.rsplit("/", 1)[-1], ["o_orderkey"], "existing")
    return spark.read.parquet(out).select("o_orderkey", "id")


# ================================================================= lookups

_PL = f"({I.POSTCODE_LINES})"
_PC_PARTS = (f"(CASE WHEN instr({O.utrim('value')}, chr(9)) > 0 THEN string_split_regex({O.utrim('value')}, '\\t+') "
             f"ELSE string_split_regex({O.utrim('value')}, '{O.WS}+') END)")
POSTCODE_DIM = f"""(SELECT line, {O.pad('p[2]')} AS postcode, p[3] AS city FROM
  (SELECT line, {_PC_PARTS} AS p FROM {_PL}) WHERE {O.utrim('p[1]')} <> '' AND len(p) >= 3)"""
FIRST_CITY = f"(SELECT postcode, arg_min(city, line) AS city FROM {POSTCODE_DIM} GROUP BY postcode)"
FIRST_PLZ = f"(SELECT lower(city) AS city_key, arg_min(postcode, line) AS postcode FROM {POSTCODE_DIM} GROUP BY lower(city))"


def _postcode_dim(spark, sf) -> DataFrame:
    return lookups.postcode_dim_from_lines(I.derived(spark, sf, I.POSTCODE_LINES, ["nation", "region"]))


_PLZ_PROBE = """CASE c_custkey % 3 WHEN 0 THEN cast((c_custkey % 30) * 37 as string)
  WHEN 1 THEN lpad(cast((c_custkey % 30) * 37 as string), 5, '0') || ' ' ELSE '99999' END"""
_OWN_CITY = "CASE WHEN c_custkey % 4 = 0 THEN ' Berlin ' END"


@query("lookup_city_by_postcode", f"""
SELECT s.c_custkey, CASE WHEN {O.utrim('s.own')} <> '' THEN {O.utrim('s.own')} ELSE f.city END AS city
FROM (SELECT c_custkey, {_OWN_CITY} AS own, {_PLZ_PROBE} AS plz FROM customer) s
LEFT JOIN {FIRST_CITY} f ON f.postcode = CASE WHEN NOT {b('s.plz')} THEN {O.pad(O.utrim('s.plz'))} END""")
def q_lookup_city_by_postcode(spark, sf):
    c = I.derived(spark, sf, f"SELECT c_custkey, {_OWN_CITY} AS own, {_PLZ_PROBE} AS plz FROM customer", ["customer"])
    out = lookups.lookup_city_by_postcode(c, F.col("own"), F.col("plz"), _postcode_dim(spark, sf), "city")
    return out.select("c_custkey", "city")


_CITY_PROBE = """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '8033' END AS own,
  CASE c_custkey % 3 WHEN 0 THEN lower(n_name) WHEN 1 THEN ' ' || n_name || ' ' ELSE 'Nowhere' END AS city
FROM customer JOIN nation ON c_nationkey = n_nationkey"""


@query("lookup_postcode_by_city", f"""
SELECT s.c_custkey, CASE WHEN {O.utrim('s.own')} <> '' THEN {O.pad(O.utrim('s.own'))} ELSE f.postcode END AS plz
FROM ({_CITY_PROBE}) s LEFT JOIN {FIRST_PLZ} f
ON f.city_key = CASE WHEN NOT {b('s.city')} THEN lower({O.utrim('s.city')}) END""")
def q_lookup_postcode_by_city(spark, sf):
    c = I.derived(spark, sf, _CITY_PROBE, ["customer", "nation"])
    out = lookups.lookup_postcode_by_city(c, F.col("own"), F.col("city"), _postcode_dim(spark, sf), "plz")
    return out.select("c_custkey", "plz")


_CITY_LISTS = f"""(SELECT postcode, string_agg(city, '|' ORDER BY first) AS cities, count(*) AS n FROM
  (SELECT postcode, city, min(line) AS first FROM {POSTCODE_DIM} GROUP BY postcode, city) GROUP BY postcode)"""
_PLZ_LISTS = f"""(SELECT city_key, string_agg(postcode, '|' ORDER BY first) AS postcodes, count(*) AS n FROM
  (SELECT lower(city) AS city_key, postcode, min(line) AS first FROM {POSTCODE_DIM} GROUP BY lower(city), postcode)
  GROUP BY city_key)"""


@query("all_cities_by_postcode", f"""
SELECT s.c_custkey, coalesce(l.cities, '') AS cities, CAST(coalesce(l.n, 0) AS INTEGER) AS n_cities
FROM (SELECT c_custkey, {_PLZ_PROBE} AS plz FROM customer) s
LEFT JOIN {_CITY_LISTS} l ON l.postcode = {O.pad(O.utrim("coalesce(s.plz, '')"))}""")
def q_all_cities_by_postcode(spark, sf):
    c = I.derived(spark, sf, f"SELECT c_custkey, {_PLZ_PROBE} AS plz FROM customer", ["customer"])
    out = lookups.all_cities_by_postcode(c, F.col("plz"), _postcode_dim(spark, sf), "l")
    return out.select("c_custkey", F.array_join("l", "|").alias("cities"), F.size("l").alias("n_cities"))


@query("all_postcodes_by_city", f"""
SELECT s.c_custkey, coalesce(l.postcodes, '') AS postcodes, CAST(coalesce(l.n, 0) AS INTEGER) AS n_postcodes
FROM ({_CITY_PROBE}) s LEFT JOIN {_PLZ_LISTS} l ON l.city_key = lower({O.utrim("coalesce(s.city, '')")})""")
def q_all_postcodes_by_city(spark, sf):
    c = I.derived(spark, sf, _CITY_PROBE, ["customer", "nation"])
    out = lookups.all_postcodes_by_city(c, F.col("city"), _postcode_dim(spark, sf), "l")
    return out.select("c_custkey", F.array_join("l", "|").alias("postcodes"), F.size("l").alias("n_postcodes"))


_PAY_PARTS = f"string_split_regex({O.utrim('value')}, '{O.WS}+')"
_ZIP_POS = "list_position(list_transform(p[2:], lambda x: regexp_matches(x, '^[0-9]{5}$')), true)"
PAYER_DIM = f"""(SELECT line, ik, name FROM (SELECT line, p[1] AS ik,
    {O.utrim(f"CASE WHEN {_ZIP_POS} IS NOT NULL THEN array_to_string(p[2:{_ZIP_POS}], ' ') ELSE array_to_string(p[2:3], ' ') END")} AS name
  FROM (SELECT line, {_PAY_PARTS} AS p FROM ({I.PAYER_LINES}))
  WHERE len(p) >= 4 AND regexp_matches(p[1], '^[0-9]{{9}}$')) WHERE name <> '')"""
PAYER_BY_ID = f"(SELECT ik, arg_max(name, line) AS payer_name FROM {PAYER_DIM} GROUP BY ik)"
PAYER_BY_NAME = f"""(SELECT n.name_key, n.ik, i.payer_name FROM
  (SELECT lower(name) AS name_key, arg_max(ik, line) AS ik FROM {PAYER_DIM} GROUP BY lower(name)) n
  JOIN {PAYER_BY_ID} i ON i.ik = n.ik)"""


def _payer_dim(spark, sf) -> DataFrame:
    return lookups.payer_dim_from_lines(I.derived(spark, sf, I.PAYER_LINES, ["part"]))


_IK_PROBE = """CASE o_orderkey % 3 WHEN 0 THEN cast(100000000 + (o_orderkey % 600) * 7 as string)
  WHEN 1 THEN cast(100000000 + (o_orderkey % 600) * 7 as string) || '.0' ELSE ' ' || cast(o_orderkey as string) END"""


@query("lookup_payer_by_id", f"""
SELECT s.o_orderkey, i.payer_name FROM (SELECT o_orderkey, {_IK_PROBE} AS ik_in FROM orders) s
LEFT JOIN {PAYER_BY_ID} i ON i.ik = CASE WHEN NOT {b('s.ik_in')} THEN split_part({O.utrim('s.ik_in')}, '.', 1) END""")
def q_lookup_payer_by_id(spark, sf):
    o = I.derived(spark, sf, f"SELECT o_orderkey, {_IK_PROBE} AS ik_in FROM orders", ["orders"])
    return lookups.lookup_payer_by_id(o, F.col("ik_in"), _payer_dim(spark, sf), "payer_name") \
        .select("o_orderkey", "payer_name")


_NAME_PROBE = """CASE p_partkey % 3 WHEN 0 THEN lower(p_brand || ' ' || p_type)
  WHEN 1 THEN ' ' || upper(p_brand) || ' ' || p_type ELSE p_brand || 'x' END"""


@query("lookup_id_by_payer", f"""
SELECT s.p_partkey, n.ik AS match_ik, n.payer_name AS match_name,
  CAST(CASE WHEN n.ik IS NULL THEN 0 ELSE 1000 END AS BIGINT) AS score_pm
FROM (SELECT p_partkey, {_NAME_PROBE} AS name_in FROM part) s
LEFT JOIN {PAYER_BY_NAME} n ON n.name_key = CASE WHEN NOT {b('s.name_in')} THEN lower({O.utrim('s.name_in')}) END""")
def q_lookup_id_by_payer(spark, sf):
    p = I.derived(spark, sf, f"SELECT p_partkey, {_NAME_PROBE} AS name_in FROM part", ["part"])
    out = lookups.lookup_id_by_payer(p, F.col("name_in"), _payer_dim(spark, sf))
    return out.select("p_partkey", "match_ik", "match_name",
                      F.floor(F.col("match_score") * 1000).cast("long").alias("score_pm"))


_FUZZY_PROBE = """CASE p_partkey % 4 WHEN 0 THEN lower(p_brand || ' ' || p_type)
  WHEN 1 THEN p_type || ' ' || p_brand WHEN 2 THEN substr(p_brand || ' ' || p_type, 2)
  ELSE 'zz' || cast(p_partkey as string) END"""


def _sim(a: str, bb: str) -> str:
    m = f"greatest(length({a}), length({bb}))"
    return f"(CASE WHEN {m} = 0 THEN 1.0 ELSE 1.0 - levenshtein({a}, {bb}) / {m} END)"


def _tsort(x: str) -> str:
    return f"array_to_string(list_sort(string_split_regex(lower({O.utrim(x)}), '{O.WS}+')), ' ')"


_SCORE = f"greatest({_sim(f'lower({O.utrim("uq.q")})', 'lower(nm.name)')}, 0.95 * {_sim(_tsort('uq.q'), _tsort('nm.name'))})"


@query("match_payer_fuzzy", f"""
WITH s AS (SELECT p_partkey, {_FUZZY_PROBE} AS name_in FROM part),
ex AS (SELECT s.p_partkey, s.name_in, n.ik, n.payer_name FROM s LEFT JOIN {PAYER_BY_NAME} n
       ON n.name_key = CASE WHEN NOT {b('s.name_in')} THEN lower({O.utrim('s.name_in')}) END),
uq AS (SELECT DISTINCT lower({O.utrim('name_in')}) AS q FROM ex WHERE ik IS NULL AND NOT {b('name_in')}),
names AS (SELECT name, min(line) AS line FROM {PAYER_DIM} GROUP BY name),
sc AS (SELECT uq.q, nm.name, nm.line, {_SCORE} AS score FROM uq CROSS JOIN names nm),
best AS (SELECT q, name, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, line) AS rn
         FROM sc WHERE score >= 0.6) WHERE rn = 1),
bi AS (SELECT best.q, best.name, best.score, n.ik FROM best JOIN {PAYER_BY_NAME} n ON n.name_key = lower(best.name))
SELECT ex.p_partkey, coalesce(ex.ik, bi.ik) AS match_ik, coalesce(ex.payer_name, bi.name) AS match_name,
  CAST(floor(CASE WHEN ex.ik IS NOT NULL THEN 1.0 WHEN bi.score IS NOT NULL THEN bi.score ELSE 0.0 END * 1000) AS BIGINT) AS score_pm
FROM ex LEFT JOIN bi ON bi.q = lower({O.utrim('ex.name_in')})""")
def q_match_payer_fuzzy(spark, sf):
    p = I.derived(spark, sf, f"SELECT p_partkey, {_FUZZY_PROBE} AS name_in FROM part", ["part"])
    out = lookups.match_payer_fuzzy(p, F.col("name_in"), _payer_dim(spark, sf), cutoff=0.6)
    return out.select("p_partkey", "match_ik", "match_name",
                      F.floor(F.col("match_score") * 1000).cast("long").alias("score_pm"))


def q_match_payer_weighted(spark, sf):
    p = I.derived(spark, sf, f"SELECT p_partkey, {_FUZZY_PROBE} AS name_in FROM part", ["part"])
    out = similar.match_payer_similar(p, F.col("name_in"), _payer_dim(spark, sf), cutoff=0.6)
    return out.select("p_partkey", "match_ik", "match_name", F.floor(F.col("match_score") * 1000).cast("long").alias("score_pm"))


def q_match_payer_blocks(spark, sf):
    p = I.derived(spark, sf, f"SELECT p_partkey, {_FUZZY_PROBE} AS name_in FROM part", ["part"])
    out = similar.match_payer_similar(p, F.col("name_in"), _payer_dim(spark, sf), cutoff=0.6, scorer="blocks")
    return out.select("p_partkey", "match_ik", "match_name", F.floor(F.col("match_score") * 1000).cast("long").alias("score_pm"))


# beyond SQL: common subsequences and recursive blocks; tested against all pairs
QUERIES["match_payer_weighted"] = q_match_payer_weighted
QUERIES["match_payer_blocks"] = q_match_payer_blocks


# ============================================================ dimension files


def _write_lines(df: DataFrame, path: str) -> None:
    (df.repartitionByRange("line").sortWithinPartitions("line").select("value")
     .write.mode("overwrite").text(path))


@query("read_postcode_dim", f"""
SELECT CAST(line AS BIGINT) AS line, postcode, city FROM
  (SELECT row_number() OVER (ORDER BY line) - 1 AS line, {O.pad('p[2]')} AS postcode, p[3] AS city, p
   FROM (SELECT line, {_PC_PARTS} AS p FROM {_PL}))
WHERE {O.utrim('p[1]')} <> '' AND len(p) >= 3""")
def q_read_postcode_dim(spark, sf):
    path = scratch_path(spark, "postcodes")
    _write_lines(I.derived(spark, sf, I.POSTCODE_LINES, ["nation", "region"]), path)
    return dims.read_postcode_dim(spark, path).select("line", "postcode", "city")


@query("read_payer_dim", PAYER_DIM.replace(
    f"FROM ({I.PAYER_LINES})", f"FROM (SELECT row_number() OVER (ORDER BY line) - 1 AS line, value FROM ({I.PAYER_LINES}))")
    .strip()[1:-1])
def q_read_payer_dim(spark, sf):
    path = scratch_path(spark, "payers")
    _write_lines(I.derived(spark, sf, I.PAYER_LINES, ["part"]), path)
    return dims.read_payer_dim(spark, path).select("line", "ik", "name")


# ============================================================ reports


_FLAG_MAP = [Checked("kv", "p_vnr", 40, "validate_kvnr"), Checked("ik", "p_ik", 40, "validate_ik"),
             Checked("mail", "p_email", 60, "validate_email"), Checked("street", "p_street", 60, "split_street"),
             Checked("street", "p_hausnummer", 10, "split_number"), Checked("name", "p_name", 60, None),
             Checked("sex", "p_anrede", 60, "gender"), Checked("seg", "p_vs", 10, None)]
_PERSON_COLS = ["k", "kv", "ik", "mail", "street", "name", "sex", "seg", "plz_in"]


def _flag_sql_parts(i: int, m: Checked) -> tuple[str, list[str]]:
    """(column definitions, message expressions) for one mapped column."""
    src, tgt, rule = m.source, m.target, m.rule or ""
    val = O.utrim(src)
    skip = f"({src} IS NULL OR lower({val}) IN ('nan', 'none', 'null', '<na>', ''))"
    r, t = rule.lower(), tgt.lower()
    if any(k in r or k in t for k in ("hausnummer", "hnr")):
        tv = f"coalesce({O.split_number(val)}, '')"
    elif any(k in r or k in t for k in ("strasse", "street")):
        tv = f"coalesce({O.split_street(val)}, '')"
    else:
        tv = val
    cols = f"{val} AS v{i}, {tv} AS tv{i}, NOT {skip} AND {tv} <> '' AS live{i}"
    V, TV, L = f"v{i}", f"tv{i}", f"live{i}"
    msgs = []
    if rule not in ("validate_ik", "validate_kvnr"):
        msgs.append(f"CASE WHEN {L} AND {O.strict(TV)} <> {TV} THEN 'Sonderzeichen in ''{src}'' -> ''{tgt}'' (' "
                    f"|| {TV} || ' -> ' || {O.strict(TV)} || ')' END")
    if m.limit:
        msgs.append(f"CASE WHEN {L} AND length({TV}) > {m.limit} THEN 'Überlänge in ''{tgt}'' (aus ''{src}''): ''' "
                    f"|| {TV} || ''' hat ' || CAST(length({TV}) AS VARCHAR) || ' Zeichen (max. {m.limit})' END")
    if rule == "validate_ik" or "ik" in t:
        msgs.append(f"CASE WHEN {L} AND NOT {O.ik_ok(O.ik_clean(TV))} THEN 'Ungültige IK in ''{src}'' (' || {V} || ')' END")
    if rule == "validate_kvnr" or "kvnr" in t or "vnr" in t:
        clean = f"upper({O.utrim(TV)})"
        value = O.kvnr_value(clean)
        ok = O.kvnr_ok(value)
        msgs.append(f"CASE WHEN {L} AND {ok} AND {O.kvnr_fixed(clean)} THEN 'KVNR in ''{src}'' korrigiert: (' "
                    f"|| {clean} || ' -> ' || {value} || ')' END")
        msgs.append(f"CASE WHEN {L} AND NOT {ok} THEN 'Ungültige KVNR in ''{src}'' (' || {V} || ')' END")
    if rule == "validate_email" or "mail" in t:
        msgs.append(f"CASE WHEN {L} AND NOT {O.email_ok(TV)} THEN 'Ungültige E-Mail in ''{src}'' (' || {V} || ')' END")
    return cols, msgs


def _flag_sql() -> str:
    parts = [_flag_sql_parts(i, m) for i, m in enumerate(_FLAG_MAP)]
    cols = ", ".join(c for c, _ in parts)
    msgs = ", ".join(x for _, ms in parts for x in ms)
    return f"""
WITH t AS (SELECT r.*, {cols} FROM {PR} r),
m AS (SELECT *, concat_ws(' | ', {msgs}) AS f FROM t)
SELECT _row + 2 AS __quell_zeile, f AS __gefundene_fehler, {', '.join(_PERSON_COLS)} FROM m WHERE f <> ''"""


FLAG_SQL = _flag_sql()


@query("flag_records", FLAG_SQL)
def q_flag_records(spark, sf):
    return findings.flag_records(_persons_rows(spark, sf), _FLAG_MAP)


_NA_SQL = ", ".join(O.q(t) for t in text.NA_TOKENS)


def _na(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR {x} IN ({_NA_SQL}) THEN NULL ELSE {x} END AS {x}"


@query("write_flagged", f"""
SELECT CAST(__quell_zeile AS VARCHAR) AS __quell_zeile, __gefundene_fehler, {', '.join(_na(c) for c in _PERSON_COLS[1:])},
  CAST(k AS VARCHAR) AS k FROM ({FLAG_SQL})""")
def q_write_flagged(spark, sf):
    out_dir = scratch_path(spark, "flagged")
    sinks.write_flagged(q_flag_records(spark, sf), out_dir)
    import os
    return delimited.read_delimited(spark, os.path.join(out_dir, sinks.FLAGGED_NAME), sep=";")


_CONV = "(SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS _row FROM conversations)"


def _conv_rows(spark, sf) -> DataFrame:
    return with_row_index(_table(spark, sf, "conversations"), order_by=["conv_id", "turn"])


@query("cleanup_preview", " UNION ALL ".join(
    f"SELECT _row AS row_idx, '{c}' AS col_name, {c} AS original, {O.strict(c)} AS cleaned FROM {_CONV} "
    f"WHERE NOT {b(c)} AND {O.strict(c)} <> {c}" for c in ("role", "text")))
def q_cleanup_preview(spark, sf):
    return findings.cleanup_preview(_conv_rows(spark, sf), ["role", "text"])


@query("apply_cleanup", f"""
SELECT _row, conv_id, turn, {', '.join(f"CASE WHEN {b(c)} OR _row % 3 = 0 THEN {c} ELSE {O.strict(c)} END AS {c}" for c in ("role", "text"))}
FROM {_CONV}""")
def q_apply_cleanup(spark, sf):
    rows = _conv_rows(spark, sf)
    rejected = findings.cleanup_preview(rows, ["role", "text"]).where(F.col("row_idx") % 3 == 0) \
        .select("row_idx", "col_name")
    out = resolve.apply_cleanup(rows, ["role", "text"], rejected=rejected)
    return out.select("_row", "conv_id", "turn", "role", "text")


_DOC_LIMITS = {c: n for c, n in limits("adressen").items() if c in ("name1", "strasse", "kategorie")}
_DOCS = ("(SELECT row_number() OVER (ORDER BY doc_id) - 1 AS _row, split_part(text, chr(10), 1) AS name1, "
         "text AS strasse, lang || '-' || source AS kategorie FROM documents)")


def _doc_rows(spark, sf) -> DataFrame:
    d = _table(spark, sf, "documents").select(
        "doc_id", F.substring_index("text", "\n", 1).alias("name1"), F.col("text").alias("strasse"),
        F.concat_ws("-", "lang", "source").alias("kategorie"))
    return with_row_index(d, order_by=["doc_id"]).drop("doc_id")


@query("length_conflicts", " UNION ALL ".join(
    f"SELECT _row AS row_idx, '{c}' AS col_name, {n} AS limit, {c} AS orig_val FROM {_DOCS} "
    f"WHERE {c} IS NOT NULL AND {c} <> 'NULL' AND length({c}) > {n}" for c, n in _DOC_LIMITS.items()))
def q_length_conflicts(spark, sf):
    return findings.length_conflicts(_doc_rows(spark, sf), _DOC_LIMITS)


@query("resolve_length", f"""
SELECT _row, {', '.join(
    f"CASE WHEN {c} IS NOT NULL AND {c} <> 'NULL' AND length({c}) > {n} THEN "
    f"(CASE WHEN _row % 4 = 0 THEN 'KURZ' || CAST(_row AS VARCHAR) ELSE substr({c}, 1, {n}) END) ELSE {c} END AS {c}"
    for c, n in _DOC_LIMITS.items())} FROM {_DOCS}""")
def q_resolve_length(spark, sf):
    rows = _doc_rows(spark, sf)
    conflicts = findings.length_conflicts(rows, _DOC_LIMITS)
    decisions = conflicts.where(F.col("row_idx") % 4 == 0).select(
        "row_idx", "col_name", F.concat(F.lit("KURZ"), F.col("row_idx").cast("string")).alias("new_val"))
    out = resolve.resolve_length(rows, _DOC_LIMITS, policy="truncate", decisions=decisions)
    return out.select("_row", *_DOC_LIMITS)


# ============================================================ mapping


def _rank_sql(t: str) -> str:
    s = "lower(column_name)"
    bare = t[2:] if t.startswith("p_") else t
    arms = []
    if t in ("p_nr", "ext_id"):
        arms.append(f"WHEN {s} IN ('id', 'patient_id', 'patienten_id', 'pat_id') THEN 0")
    if t == "ext_id":
        arms.append(f"WHEN {s} IN ('lanr', 'la-nr', 'la_nr') THEN 1")
    arms.append(f"WHEN {s} = '{t}' OR {s} = '{bare}' THEN 2")
    if t in mapping.MOBILE_TARGETS:
        arms.append(f"WHEN {s} IN ('mobil', 'handy', 'mobile', 'telefonmobil') THEN 3")
    else:
        if t in mapping.PHONE_TARGETS:
            arms.append(f"WHEN {s} IN ('telefon', 'p_tel', 'tel', 'telefon1') THEN 3")
        syn = [f"{s} IN ({', '.join(map(O.q, srcs))})" for srcs, frags in mapping.SYNONYMS if any(f in t for f in frags)]
        if syn:
            arms.append(f"WHEN {' OR '.join(syn)} THEN 4")
        arms.append(f"WHEN (instr('{t}', {s}) > 0 OR instr({s}, '{t}') > 0) AND length({s}) > 3 THEN 5")
    return f"CASE {' '.join(arms)} END"


_KINDS = "['" + "', '".join(mapping.MATCH_KINDS) + "']"


@query("match_columns", f"""
WITH c AS ({I.CATALOGUE}),
h AS ({' UNION ALL '.join(f"SELECT source_table, position, column_name, '{t}' AS target, {_rank_sql(t)} AS rank FROM c"
                          for t in LAYOUTS['patienten'])}),
best AS (SELECT *, row_number() OVER (PARTITION BY source_table, target ORDER BY rank, position) AS rn
         FROM h WHERE rank IS NOT NULL)
SELECT source_table, target, column_name AS source_column, {_KINDS}[rank + 1] AS match_kind FROM best WHERE rn = 1""")
def q_match_columns(spark, sf):
    cat = I.derived(spark, sf, I.CATALOGUE, ["documents"])
    return mapping.match_columns(cat, LAYOUTS["patienten"])


_ADDR_SRC = f"""SELECT c_custkey AS k, cast(c_custkey as string) AS id,
  CASE c_custkey % 3 WHEN 0 THEN 'Dr.' WHEN 1 THEN ' Prof. ' ELSE NULL END AS titel,
  {_FIRST_SQL} AS vorname, c_name AS nachname,
  CASE c_custkey % 7 WHEN 0 THEN 'M' WHEN 1 THEN 'W' WHEN 2 THEN 'f' WHEN 3 THEN '1' WHEN 4 THEN '2'
    WHEN 5 THEN 'x' ELSE ' ' END AS geschlecht,
  'Strasse ' || c_mktsegment || ' ' || cast(c_custkey % 200 as string) AS strasse,
  CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN cast((c_custkey % 30) * 37 as string) WHEN 2 THEN ' '
    ELSE lpad(cast((c_custkey % 30) * 37 as string), 5, '0') END AS plz,
  CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN lower(n_name) WHEN 2 THEN ' ' || n_name ELSE 'Nowhere' END AS ort,
  CASE c_custkey % 3 WHEN 0 THEN lower(replace(c_name, '#', '.')) || '@mail.example.com'
    WHEN 1 THEN lower(c_name) ELSE ' ' || lower(replace(c_name, '#', '_')) || '@x.de ' END AS email,
  '0' || cast(c_custkey as string) AS telefon,
  CASE WHEN c_custkey % 2 = 0 THEN '0170' || cast(c_custkey as string) END AS mobil,
  c_mktsegment AS kategorie
FROM customer JOIN nation ON c_nationkey = n_nationkey"""
_ADDR_SOURCES = {"ext_id": "id", "anrede": "geschlecht", "name1": "titel", "name2": "vorname",
                 "name3": "nachname", "strasse": "strasse", "plz": "plz", "ort": "ort", "email": "email",
                 "telefon": "telefon", "kategorie": "kategorie", "telefonmobil": "mobil"}


def _addr_spec(extra_rules: dict | None = None) -> MappingSpec:
    cols = ["k", "id", "titel", "vorname", "nachname", "geschlecht", "strasse", "plz", "ort", "email",
            "telefon", "mobil", "kategorie"]
    rules, sources = default_rules(LAYOUTS["adressen"], cols, _ADDR_SOURCES)
    rules.update(extra_rules or {})
    return MappingSpec.for_layout("adressen", sources, rules)


def _addr_projected(spark, sf, spec: MappingSpec) -> DataFrame:
    src = with_row_index(I.derived(spark, sf, _ADDR_SRC, ["customer", "nation"]), order_by=["k"])
    return mapping.project_to_schema(src, spec, postcode_dim=_postcode_dim(spark, sf))


def _plain_sql(x: str, fn) -> str:
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {O.utrim(fn(x))} = '' THEN NULL ELSE {fn(x)} END)"


_ADDR_EXPR = {
    "ext_id": _plain_sql("id", O.basic),
    "anrede": f"(CASE WHEN geschlecht IS NULL THEN NULL ELSE NULLIF({O.gender(O.basic('geschlecht'))}, '') END)",
    "name1": _plain_sql("titel", O.strict),
    "name2": _plain_sql("vorname", O.strict),
    "name3": _plain_sql("nachname", O.strict),
    "strasse": _plain_sql("strasse", O.basic),
    "plz": f"(CASE WHEN {O.utrim('plz')} <> '' THEN {O.pad(O.utrim('plz'))} ELSE fp.postcode END)",
    "ort": f"(CASE WHEN {O.utrim('ort')} <> '' THEN {O.utrim('ort')} ELSE fc.city END)",
    "email": f"(CASE WHEN {O.email_ok('email')} THEN {O.utrim('email')} END)",
    "telefon": _plain_sql("telefon", O.basic),
    "kategorie": _plain_sql("kategorie", O.basic),
    "telefonmobil": _plain_sql("mobil", O.basic),
}
_ADDR_FROM = f"""(SELECT *, row_number() OVER (ORDER BY k) - 1 AS _row FROM ({_ADDR_SRC})) s
LEFT JOIN {FIRST_PLZ} fp ON fp.city_key = CASE WHEN NOT {b('s.ort')} THEN lower({O.utrim('s.ort')}) END
LEFT JOIN {FIRST_CITY} fc ON fc.postcode = CASE WHEN NOT {b('s.plz')} THEN {O.pad(O.utrim('s.plz'))} END"""
_ADDR_TARGETS = [t for t in LAYOUTS["adressen"] if t != "id"]


@query("project_to_schema", f"""
SELECT _row, {', '.join(f'{_ADDR_EXPR[t]} AS {t}' for t in _ADDR_TARGETS)}, 1 AS id_ok FROM {_ADDR_FROM}""")
def q_project_to_schema(spark, sf):
    out = _addr_projected(spark, sf, _addr_spec())
    return out.select("_row", *_ADDR_TARGETS, F.col("id").rlike(keys.UID_SHAPE).cast("int").alias("id_ok"))


_COPY_RULES = {"name3": Rule("copy_target", "name2"), "kategorie": Rule("copy_target", "ext_id"),
               "telefonmobil": Rule("copy_target", "telefon")}
_COPY_COLS = ["ext_id", "name2", "name3", "telefon", "kategorie", "telefonmobil"]


@query("copy_target", f"""
SELECT _row, {', '.join(f"{_ADDR_EXPR[_COPY_RULES[t].param if t in _COPY_RULES else t]} AS {t}" for t in _COPY_COLS)}
FROM {_ADDR_FROM}""")
def q_copy_target(spark, sf):
    out = _addr_projected(spark, sf, _addr_spec(_COPY_RULES))
    return out.select("_row", *_COPY_COLS)


_MERGE_SRC = f"""SELECT c_custkey AS k, 'Strasse ' || c_mktsegment AS street_name,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE cast(c_custkey % 200 as string) END AS hnr,
  {_FIRST_SQL} AS vn, c_name AS nn FROM customer"""


@query("merge_columns", f"""
SELECT _row,
  NULLIF({O.utrim(f"coalesce(CASE WHEN street_name IS NULL THEN NULL ELSE {O.basic('street_name')} END, '') || ' ' || {O.basic('hnr')}")}, '') AS strasse,
  NULLIF({O.utrim(f"coalesce(CASE WHEN nn IS NULL THEN NULL ELSE {O.strict('nn')} END, '') || ' ' || {O.strict('vn')}")}, '') AS name1
FROM (SELECT *, row_number() OVER (ORDER BY k) - 1 AS _row FROM ({_MERGE_SRC}))""")
def q_merge_columns(spark, sf):
    src = with_row_index(I.derived(spark, sf, _MERGE_SRC, ["customer"]), order_by=["k"])
    spec = MappingSpec.for_layout("adressen", {"strasse": "street_name", "name1": "nn"},
                                  {"strasse": Rule("merge_columns", "hnr"), "name1": Rule("merge_columns", "vn")})
    return mapping.project_to_schema(src, spec).select("_row", "strasse", "name1")


_REST_SRC = """SELECT o_orderkey, cast(o_orderkey as string) AS nr, o_orderstatus AS status,
  o_orderpriority AS prio, cast(o_custkey as string) AS kasse,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Notiz ' || cast(o_orderkey % 97 as string) END AS notiz
FROM orders"""
_REST_SPEC = MappingSpec.for_layout("patienten", {"p_nr": "nr", "p_vs": "status"},
                                    {"p_krankenkasse": Rule("lookup_ik_provider", "kasse")})
_REST_ROWS = f"(SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS _row FROM ({_REST_SRC}))"


def _rest_rows(spark, sf) -> DataFrame:
    return with_row_index(I.derived(spark, sf, _REST_SRC, ["orders"]), order_by=["o_orderkey"])


@query("rest_table", f"SELECT _row, o_orderkey, prio, notiz FROM {_REST_ROWS}")
def q_rest_table(spark, sf):
    return mapping.rest_table(_rest_rows(spark, sf), _REST_SPEC)


@query("write_rest", f"SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, prio, notiz FROM {_REST_ROWS}")
def q_write_rest(spark, sf):
    import os
    out_dir = scratch_path(spark, "rest")
    path = sinks.write_rest(mapping.rest_table(_rest_rows(spark, sf), _REST_SPEC), out_dir, "orders.csv")
    assert os.path.basename(path) == "REST_UNMAPPED_orders.csv"
    return delimited.read_delimited(spark, path, sep=";")


_FIELDS = [extras.ExtraField("prio"), extras.ExtraField("notiz", "Hinweis"), extras.ExtraField("status", "#Status")]
_VALUES_SQL = " UNION ALL ".join(
    f"SELECT '{f.property_id}' AS property_id, nr AS patienten_id, {O.utrim(f.source_col)} AS content "
    f"FROM {_REST_ROWS} WHERE NOT {b(f.source_col)}" for f in _FIELDS)


def _values(spark, sf) -> DataFrame:
    return extras.property_values(_rest_rows(spark, sf), _FIELDS, id_col="nr")


@query("property_values", f"SELECT property_id, patienten_id, content, 1 AS uid_ok FROM ({_VALUES_SQL})")
def q_property_values(spark, sf):
    v = _values(spark, sf)
    return v.select("property_id", "patienten_id", "content", F.col("id").rlike(keys.UID_SHAPE).cast("int").alias("uid_ok"))


_DEFS_SQL = f"""SELECT id, label, proptyp, CAST(NULL AS VARCHAR) AS options, 255 AS maxwidth,
  CAST(NULL AS VARCHAR) AS bereich, 0 AS sortierung, 202 AS system, CAST(NULL AS VARCHAR) AS kartei_id
FROM (VALUES {', '.join(f"('{f.property_id}', '{f.source_col}', '{f.data_type}')" for f in _FIELDS)}) d(id, label, proptyp)
WHERE id IN (SELECT property_id FROM ({_VALUES_SQL}))"""


@query("property_definitions", _DEFS_SQL)
def q_property_definitions(spark, sf):
    return extras.property_definitions(_values(spark, sf), _FIELDS)


@query("write_extra_fields", f"SELECT property_id, patienten_id, content FROM ({_VALUES_SQL})")
def q_write_extra_fields(spark, sf):
    import os
    v = _values(spark, sf)
    out_dir = scratch_path(spark, "extras")
    _, map_path = sinks.write_extra_fields(extras.property_definitions(v, _FIELDS), v, out_dir)
    defs_back = delimited.read_delimited(spark, os.path.join(out_dir, sinks.PROPERTY_NAME), sep=";")
    assert defs_back.columns[:3] == ["id", "label", "proptyp"]
    return delimited.read_delimited(spark, map_path, sep=";").select("property_id", "patienten_id", "content")


# ============================================================ sources / sinks

_RD_LINES = """SELECT c_custkey AS line, CASE c_custkey % 7
  WHEN 0 THEN cast(c_custkey as string) || ';' || c_name || ';' || c_mktsegment || ';extra'
  WHEN 1 THEN cast(c_custkey as string) || ';' || c_name
  WHEN 2 THEN cast(c_custkey as string) || ';"' || c_name || ';x";' || c_mktsegment
  WHEN 3 THEN cast(c_custkey as string) || ';NULL;' || c_mktsegment
  WHEN 4 THEN cast(c_custkey as string) || ';"";' || c_mktsegment
  ELSE cast(c_custkey as string) || ';' || c_name || ';' || c_mktsegment END AS value FROM customer"""


def write_raw_lines_with_header(lines: DataFrame, path: str, header: str) -> None:
    """Write pre-formatted lines as they are, each part file starting with
    ``header`` (the CSV writer with quoting switched off and one column)."""
    (lines.repartitionByRange("line").sortWithinPartitions("line")
     .select(F.col("value").alias(header))
     .write.mode("overwrite").option("header", True).option("quote", "").option("escape", "")
     .option("sep", "\u0001").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))


@query("read_delimited", """
SELECT cast(c_custkey as varchar) AS c_custkey,
  CASE c_custkey % 7 WHEN 2 THEN c_name || ';x' WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE c_name END AS c_name,
  CASE WHEN c_custkey % 7 = 1 THEN NULL ELSE c_mktsegment END AS c_mktsegment
FROM customer WHERE c_custkey % 7 <> 0""")
def q_read_delimited(spark, sf):
    path = scratch_path(spark, "delimited")
    write_raw_lines_with_header(I.derived(spark, sf, _RD_LINES, ["customer"]), path, "c_custkey;c_name;c_mktsegment")
    return delimited.read_delimited(spark, path, sep=";")


_RM_ODD = """SELECT c_custkey AS line, concat_ws(';', c_mktsegment, concat('"', replace(c_name, '#', concat(chr(10), 'no;')),
  CASE WHEN c_custkey % 4 = 1 THEN concat('""', chr(10), '""') ELSE '' END, '"'), cast(c_custkey as string),
  CASE WHEN c_custkey % 3 = 0 THEN concat('"', chr(10), '"') END) AS value FROM customer WHERE c_custkey % 2 = 1"""


@query("read_delimited_mixed", """
SELECT cast(c_custkey as varchar) AS c_custkey,
  CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE replace(c_name, '#', chr(10) || 'no;')
    || CASE WHEN c_custkey % 4 = 1 THEN '"' || chr(10) || '"' ELSE '' END END AS c_name,
  c_mktsegment, CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 0 THEN chr(10) END AS note FROM customer""")
def q_read_delimited_mixed(spark, sf):
    """Files of two column orders in one folder, one with line breaks in quoted cells."""
    path = scratch_path(spark, "mixed")
    even = I.derived(spark, sf, "SELECT c_custkey AS line, concat_ws(';', cast(c_custkey as string), c_name, c_mktsegment) "
                                "AS value FROM customer WHERE c_custkey % 2 = 0", ["customer"])
    write_raw_lines_with_header(even, path + "/even", "c_custkey;c_name;c_mktsegment")
    odd = I.derived(spark, sf, _RM_ODD, ["customer"]).repartition(4, "line") \
        .select("line", F.posexplode(F.split("value", "\n")).alias("at", "value"))  # the lines of a record stay together
    odd.sortWithinPartitions("line", "at").select(F.col("value").alias("c_mktsegment;c_name;c_custkey;note")) \
        .write.options(header=True, quote="", escape="", emptyValue="", sep="\u0001", ignoreLeadingWhiteSpace=False,
                       ignoreTrailingWhiteSpace=False).csv(path + "/odd")
    return delimited.read_delimited(spark, path + "/*", sep=";") \
        .select("c_custkey", "c_name", "c_mktsegment", "note")


@query("detect_dialect", "SELECT '|' AS delimiter, 'utf-8' AS encoding, count(*) AS n_lines FROM customer")
def q_detect_dialect(spark, sf):
    path = scratch_path(spark, "dialect")
    lines = I.derived(spark, sf, "SELECT c_custkey AS line, cast(c_custkey as string) || '|' || c_name || '|' || "
                                 "c_mktsegment AS value FROM customer", ["customer"])
    _write_lines(lines, path)
    d = delimited.detect_dialect(spark, path)
    return d.groupBy("delimiter", "encoding").agg(F.sum("n_lines").cast("long").alias("n_lines"))


_WM_SRC = """SELECT cast(c_custkey as string) AS ext_id,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE replace(c_name, '#', '-') END AS name1,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_mktsegment END AS ort FROM customer"""


@query("write_mapped", f"""
SELECT ext_id || ';' || coalesce(name1, 'NULL') || ';' || coalesce(ort, 'NULL') AS value FROM ({_WM_SRC})""")
def q_write_mapped(spark, sf):
    path = scratch_path(spark, "mapped")
    layout = {"ext_id": "VARCHAR(40)", "name1": "VARCHAR(60)", "ort": "VARCHAR(60)"}
    sinks.write_mapped(I.derived(spark, sf, _WM_SRC, ["customer"]), path, layout)
    return spark.read.text(path).where(F.col("value") != ";".join(layout))


# ===================================================================== upsert

_UP_TABLE = """SELECT CASE WHEN c_custkey % 50 = 0 THEN NULL ELSE c_custkey END AS k, c_name AS name,
  c_mktsegment AS segment, c_nationkey AS nation FROM customer"""
_UP_CHANGES = """SELECT CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN o_custkey + 1000000
  ELSE o_custkey END AS k, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS segment,
  o_orderstatus AS name, o_orderkey AS seq FROM orders"""


@query("upsert_fields", f"""
WITH t AS ({_UP_TABLE}), c AS ({_UP_CHANGES}),
d AS (SELECT k, segment, name FROM c WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY seq DESC) = 1)
SELECT t.k, t.name, coalesce(d.segment, t.segment) AS segment, t.nation FROM t LEFT JOIN d ON t.k = d.k
UNION ALL SELECT k, name, segment, NULL FROM d WHERE k NOT IN (SELECT k FROM t WHERE k IS NOT NULL)
UNION ALL SELECT k, name, segment, NULL FROM c WHERE k IS NULL""")
def q_upsert_fields(spark, sf):
    """The last order of each customer sets one field; orders of unknown customers are added."""
    path = scratch_path(spark, "upsert")
    upsert.create_table(I.derived(spark, sf, _UP_TABLE, ["customer"]), path, ["k"])
    upsert.upsert_table(I.derived(spark, sf, _UP_CHANGES, ["orders"]), path, fields=["segment"], order_by=("seq",),
                        keep_if_null=True)
    return upsert.read_table(spark, path)
