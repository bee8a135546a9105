"""Spelled dates (golden table) and the report of ambiguous ones."""

import pytest
from pyspark.sql import functions as F

from fieldmill.functions import dates
from fieldmill.operators import findings
from fieldmill.plans import twophase
from fieldmill.plans.spec import MappingSpec

ISO = "1985-08-15"
GOLDEN = {
    # month names, German and English, every order
    "15. August 1985": ISO, "15 August 1985": ISO, "15.August 1985": ISO, "15. Aug. 1985": ISO, "15 AUG 1985": ISO,
    "15aug1985": ISO, "15-Aug-1985": ISO, "15/Aug/1985": ISO, "15-AUG-85": ISO, "15. Aug '85": ISO,
    "August 15, 1985": ISO, "Aug 15 1985": ISO, "Aug. 15, 1985": ISO, "august 15th, 1985": ISO, "Aug-15-1985": ISO,
    "15th August 1985": ISO, "15th of August 1985": ISO, "the 15th of August, 1985": ISO, "am 15. August 1985": ISO,
    "1985 Aug 15": ISO, "1985-Aug-15": ISO, "1985, August 15": ISO, "1985/aug/15": ISO,
    "1. März 2001": "2001-03-01", "1. MÄRZ 2001": "2001-03-01", "1. Maerz 2001": "2001-03-01",
    "3. Jänner 1999": "1999-01-03", "3 Mrz 1999": "1999-03-03", "24. Dezember 2010": "2010-12-24",
    "24 dec 2010": "2010-12-24", "1. Mai 2020": "2020-05-01", "May 1st, 2020": "2020-05-01",
    "2nd june 2020": "2020-06-02", "3rd Oct 2020": "2020-10-03", "5 Okt 2020": "2020-10-05",
    "29. Februar 2020": "2020-02-29", "7. Sept. 03": "2003-09-07",
    # weekdays, times, zones
    "Donnerstag, 15. August 1985": ISO, "Do. 15.08.1985": ISO, "Thu, 15 Aug 1985 10:30:00 GMT": ISO,
    "Thursday, August 15, 1985": ISO, "Do, den 15. August 1985": ISO, "15.08.1985 10:30 Uhr": ISO,
    "15. August 1985 um 10:30 Uhr": ISO, "Aug 15, 1985 10:30 PM": ISO, "1985-08-15T10:30:00Z": ISO,
    "1985-08-15T10:30:00+02:00": ISO, "1985-08-15 10:30:00.123 UTC": ISO, "19850815T103000": ISO,
    "1985-08-15T10:30:00,5 MESZ": ISO,
    # numbers with other separators
    "15-08-1985": ISO, "15 08 1985": ISO, "15. 08. 1985": ISO, "1985.08.15": ISO, "1985 8 15": ISO, "15-8-85": ISO,
    "8/15/85": ISO, "15/8/85": ISO, "08-15-1985": ISO, "2-1-2003": "2003-01-02", "2/1/03": "2003-02-01",
}
LEFT = ["August 1985", "15. August", "31. Februar 2020", "29. Februar 2021", "15. August Mai 1985", "im August 1985",
        "15 foo 1985", "15-08/1985", "1985-15-aug-1", "32. Mai 2020", "0. Mai 2020", "15.13.1985 10:30 Uhr", "heute",
        "augustus 15 1985", "15. August 198", "1 2 3 4", "985-08-15", "t1030", "10:30"]


@pytest.mark.parametrize("form", ["staged", "column"])
def test_golden_spellings(spark, form):
    assert len(GOLDEN) >= 60
    texts = [*GOLDEN, *LEFT, None, "", "null"]
    src = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    out = (dates.with_format_date(src, F.col("v"), "o") if form == "staged"
           else src.withColumn("o", dates.format_date("v"))).orderBy("i").collect()
    assert {r.v: r.o for r in out if r.v and r.o} == {**GOLDEN, **{t: t for t in LEFT}}
    assert [r.o for r in out[-3:]] == [None, None, None]


def test_month_first_numbers(spark):
    src = spark.createDataFrame([("2-1-2003",), ("15-1-2003",), ("2 1 2003",), ("2. Januar 2003",)], "v string")
    for out in (dates.with_format_date(src, F.col("v"), "o", day_first=False),
                src.withColumn("o", dates.format_date("v", day_first=False))):
        assert {r.v: r.o for r in out.collect()} == {"2-1-2003": "2003-02-01", "15-1-2003": "2003-01-15",
                                                     "2 1 2003": "2003-02-01", "2. Januar 2003": "2003-01-02"}


def test_staged_form_stays_in_generated_code(spark):
    df = dates.with_format_date(spark.range(3).select(F.col("id").cast("string").alias("v")), F.col("v"), "o")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert all(line.lstrip(" :+-").startswith("*") for line in plan.splitlines() if "Project" in line)


def test_ambiguous_dates(spark):
    rows = ["02.03.1985", "2/3/1985", "02-03-85", "2.2.1985", "02.2.1985", "13.02.1985", "1985-02-03", "3. Mai 1985", " ",
            None, "Do, 1.2.1985 10:30 Uhr", "0.3.1985", "abc"]
    src = spark.createDataFrame(list(enumerate(rows)), "_row long, d string")
    got = {r.row_idx: (r.read_as, r.other_reading) for r in findings.date_ambiguous(src, [("p_birth", "d")]).collect()}
    assert got == {0: ("1985-03-02", "1985-02-03"), 1: ("1985-02-03", "1985-03-02"), 2: ("1985-03-02", "1985-02-03"),
                   10: ("1985-02-01", "1985-01-02")}
    job = twophase.Job(src, MappingSpec.for_layout("patienten", {"p_birth": "d"}, {}), clean_strings=False)
    found = twophase.phase_a(job)
    assert found["dates_ambiguous"].count() == 4
    assert sorted(r.original_val for r in found["dates"].collect()) == ["0.3.1985", "abc"]
    assert findings.date_ambiguous(src.where("false"), [("p_birth", "d")]).count() == 0
