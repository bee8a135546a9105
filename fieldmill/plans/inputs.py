"""Derived inputs for the driver queries.

The driver tables hold no German address data, so each query derives its
input columns from them with plain SQL that both Spark and DuckDB run
unchanged (CASE, %, ||, lpad, lower, chr, substr, repeat, replace).  The
operator logic itself is never in these strings: Spark runs fieldmill's
functions, the oracle its own SQL.  No backslashes here (Spark's SQL parser
would read them as escapes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def register(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    for t in names:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def derived(spark: SparkSession, sf_dir: str, sql: str, tables: list[str]) -> DataFrame:
    register(spark, sf_dir, tables)
    return spark.sql(sql)


_K = "c_custkey"
_D9 = f"lpad(cast(({_K} * 7919 + 13) % 1000000000 as string), 9, '0')"
_LETTER = f"chr(cast(65 + {_K} % 26 as int))"

# A person-like source table from customer: insurance numbers (valid,
# repairable, broken), institution ids, e-mails, street lines, names, codes.
PERSONS = f"""
SELECT {_K} AS k,
  CASE {_K} % 4
    WHEN 0 THEN substr(')(=/01', cast({_K} % 6 as int) + 1, 1) || {_D9}
    WHEN 1 THEN lower({_LETTER}) || {_D9}
    WHEN 2 THEN ' ' || {_LETTER} || 'O' || lpad(cast(({_K} * 104729 + 7) % 100000000 as string), 8, '0') || ' '
    ELSE {_LETTER} || {_D9}
  END AS kv,
  CASE {_K} % 5
    WHEN 0 THEN cast(260000000 + {_K} * 37 as string) || '.0'
    WHEN 1 THEN cast({_K} % 1000 as string)
    WHEN 2 THEN ' ' || cast(100000000 + {_K} * 53 as string)
    ELSE cast(260000000 + {_K} * 37 as string)
  END AS ik,
  CASE {_K} % 6
    WHEN 0 THEN lower(replace(c_name, '#', '.')) || '@mail' || cast({_K} % 9 as string)
    WHEN 1 THEN lower(replace(c_name, '#', '@')) || '@mail.example.com'
    WHEN 2 THEN lower(replace(c_name, '#', '..')) || '@mail.example.com'
    WHEN 3 THEN ' '
    ELSE ' ' || lower(replace(c_name, '#', '.')) || '@mail' || cast({_K} % 9 as string) || '.example.com'
  END AS mail,
  'Strasse ' || c_mktsegment || CASE WHEN {_K} % 5 = 0 THEN '' ELSE ' ' || cast({_K} % 200 as string) ||
    CASE {_K} % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN '-14' ELSE ' b' END END AS street,
  CASE WHEN {_K} % 2 = 0 THEN replace(c_name, '#', ' ') ELSE c_name END ||
    CASE WHEN {_K} % 10 = 0 THEN repeat(' Extra', 10) ELSE '' END AS name,
  CASE {_K} % 7 WHEN 0 THEN 'M' WHEN 1 THEN 'W' WHEN 2 THEN 'f' WHEN 3 THEN '1' WHEN 4 THEN '2'
    WHEN 5 THEN 'x' ELSE ' ' END AS sex,
  CASE {_K} % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN 'None' WHEN 3 THEN 'nan' WHEN 4 THEN 'NULL'
    ELSE c_mktsegment END AS seg,
  CASE {_K} % 5 WHEN 0 THEN cast(({_K} % 30) * 37 as string) || '.0' WHEN 1 THEN cast({_K} * 37 as string)
    WHEN 2 THEN 'D-' || cast({_K} % 100 as string) WHEN 3 THEN ' ' || cast({_K} % 1000 as string) || ' '
    ELSE NULL END AS plz_in
FROM customer
"""

# Postcode dimension lines: every nation and region as a city; region codes
# collide with the first nations' codes, so some postcodes have two cities.
POSTCODE_LINES = """
SELECT cast(n_nationkey as bigint) AS line,
       'DE ' || lpad(cast(n_nationkey * 37 as string), 4, '0') || ' ' || n_name AS value FROM nation
UNION ALL
SELECT cast(100 + r_regionkey as bigint) AS line,
       'DE ' || cast(r_regionkey * 37 as string) || ' ' || r_name || ' Mitte' AS value FROM region
UNION ALL
SELECT cast(200 + r_regionkey as bigint) AS line,
       CASE WHEN r_regionkey % 2 = 0 THEN '' ELSE 'DE ' || cast(r_regionkey as string) END AS value FROM region
"""

# Payer dimension lines from part: 500 ids (so later lines overwrite earlier
# ones), multi-word names, some lines without a 5-digit postcode, some junk.
PAYER_LINES = """
SELECT cast(p_partkey as bigint) AS line,
  CASE WHEN p_partkey % 13 = 0 THEN 'x y'
  ELSE cast(100000000 + (p_partkey % 500) * 7 as string) || ' ' || p_brand || ' ' || p_type ||
       CASE WHEN p_partkey % 9 = 0 THEN '' ELSE ' ' || cast(10000 + p_partkey % 89999 as string) END ||
       ' Stadt' || cast(p_size as string) || ' Weg ' || cast(p_partkey as string)
  END AS value
FROM part
"""

# Fixed list of header spellings for the column-catalogue query.
HEADERS = ["id", "Vorname", "nachname", "PLZ", "Ort", "Strasse", "telefon1", "handy", "email",
           "kas_ik", "versichertennummer", "status", "geburtsdatum", "geschlecht", "titel",
           "wohnort", "notiz", "lanr", "patient_id", "telefon2", "mobil", "E-Mail", "Hausnummer",
           "name", "straße", "p_plz", "Krankenkasse", "vip"]


def headers_case(key: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{h}'" for i, h in enumerate(HEADERS))
    return f"CASE ({key}) % {len(HEADERS)} {arms} END"


CATALOGUE = f"""
SELECT 'file' || cast(doc_id % 37 as string) AS source_table, cast(doc_id as bigint) AS position,
       {headers_case('doc_id * 7 + n_chars')} AS column_name
FROM documents
"""
