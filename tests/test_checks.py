"""Identifier checks: golden rows plus property tests."""

import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from fieldmill.functions import checks, dates, keys


def _kvnr_digit(letter: str, d8: str) -> int:
    code = f"{ord(letter) - 64:02d}"
    total = 0
    for ch, w in zip(code + d8, [1, 2] * 5):
        p = int(ch) * w
        total += p - 9 if p >= 10 else p
    return total % 10


def _ik_digit(d8: str) -> int:
    total = 0
    for ch, w in zip(d8[2:8], [2, 1, 2, 1, 2, 1]):
        p = int(ch) * w
        total += p - 9 if p >= 10 else p
    return total % 10


class TestKvnr:
    def test_golden(self, apply1):
        vals = ["A123456780", "a123456780", " A123456780 ", "O123456789", "X1", "ÄÖ23456789", None]
        assert apply1(checks.validate_kvnr, vals) == [True, True, True, False, False, False, False]

    def test_repair_golden(self, apply1):
        vals = ["JO12345677", "0123456780", "1200006980", ")823672518", "(823672515", "=823672510", "/823672510"]
        want = ["J012345677", "O123456780", "I200006980", "O823672518", "I823672515", "P823672510", "U823672510"]
        out = apply1(checks.repair_kvnr, vals)
        assert [r.fixed for r in out] == [True] * 7
        assert [r.value for r in out] == want

    def test_d7_readme_example_not_repaired(self, apply1):
        out = apply1(checks.repair_kvnr, ["0123456789"])
        assert (out[0].fixed, out[0].value) == (False, "0123456789")

    def test_d16_non_ascii_letter_invalid(self, apply1):
        assert apply1(checks.validate_kvnr, ["Ä123456789"]) == [False]

    @settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(st.tuples(st.sampled_from("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
                              st.text("0123456789", min_size=8, max_size=8)), min_size=5, max_size=30))
    def test_property_generated_valid_and_one_digit_changes(self, apply1, items):
        valid = [f"{ltr}{d8}{_kvnr_digit(ltr, d8)}" for ltr, d8 in items]
        assert all(apply1(checks.validate_kvnr, valid))
        broken = [v[:9] + str((int(v[9]) + 1 + random.Random(i).randrange(9)) % 10) for i, v in enumerate(valid)]
        assert not any(apply1(checks.validate_kvnr, broken))


class TestIk:
    def test_golden(self, apply1):
        vals = ["109519005", "109519005.0", "101575519", "104212505", "260326822", "99", "123456789", "1234567890"]
        assert apply1(checks.validate_ik, vals) == [True, True, True, True, True, True, False, False]

    def test_d15_zero_fill_makes_short_valid(self, apply1):
        assert apply1(checks.ik_clean, ["99", "1.5"]) == ["000000099", "000000001"]

    @settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
    @given(st.lists(st.text("0123456789", min_size=8, max_size=8), min_size=5, max_size=30))
    def test_property_check_digit(self, apply1, items):
        valid = [f"{d8}{_ik_digit(d8)}" for d8 in items]
        assert all(apply1(checks.validate_ik, valid))
        broken = [v[:8] + str((int(v[8]) + 3) % 10) for v in valid]
        assert not any(apply1(checks.validate_ik, broken))


class TestEmail:
    def test_golden(self, apply1):
        vals = ["user@domain", "a.b@mail.example.com", " x@y.de ", "a..b@x.de", "a@b@c.de", "a@b.123",
                "müller@bücher.de", "-@x.de", "a@-x.de", None, ""]
        assert apply1(checks.validate_email, vals) == [False, True, True, False, False, False,
                                                       True, True, False, False, False]


class TestDates:
    def test_golden(self, apply1):
        vals = ["15.08.1985", "1985/08/15", "15.8.85", "abc", "31.02.2020", "19850815", "2020-01-05",
                "15.08.1985 10:30", None, "nan"]
        assert apply1(dates.format_date, vals) == ["1985-08-15", "1985-08-15", "1985-08-15", "abc",
                                                   "31.02.2020", "1985-08-15", "2020-01-05", "1985-08-15",
                                                   None, None]

    def test_d5_dotted_is_day_first(self, apply1):
        assert apply1(dates.format_date, ["01.02.1985"]) == ["1985-02-01"]

    def test_slashed_month_first_unless_day_over_12(self, apply1):
        assert apply1(dates.format_date, ["02/03/2020", "13/02/2020"]) == ["2020-02-03", "2020-02-13"]

    def test_iso_shape_passes_unchecked(self, apply1):
        assert apply1(dates.format_date, ["2020-13-45"]) == ["2020-13-45"]

    def test_fallback(self, apply1):
        assert apply1(lambda c: dates.format_date(c, "01.01.1900"), ["", "2.3.2001"]) == ["1900-01-01", "2001-03-02"]


class TestKeys:
    def test_uid_shape_and_unique(self, spark):
        from pyspark.sql import functions as F
        df = spark.range(0, 200_000, 1, 8).select(keys.generate_uid("id").alias("u"))
        r = df.agg(F.countDistinct("u").alias("d"), F.min(F.col("u").rlike(keys.UID_SHAPE).cast("int")).alias("s")).first()
        assert r.d == 200_000 and r.s == 1

    def test_uid_unique_beyond_suffix_space(self, spark):
        from pyspark.sql import functions as F
        ids = spark.createDataFrame([(0,), (keys.SUFFIX_SPACE,), (2 * keys.SUFFIX_SPACE,)], "id long")
        us = [r.u for r in ids.select(keys.generate_uid("id", base_ms=1_700_000_000_000).alias("u")).collect()]
        assert len(set(us)) == 3

    def test_auto_sequence(self, spark):
        from pyspark.sql import functions as F
        df = spark.createDataFrame([(0, "A"), (1, ""), (2, None), (3, "NULL"), (999999, None)], "r long, e string")
        out = [r.o for r in df.select(keys.auto_sequence_6("e", "r").alias("o")).orderBy("r").collect()]
        assert out == ["A", "000002", "000003", "000004", "1000000"]
        unmapped = [r.o for r in df.select(keys.auto_sequence_6(None, F.col("r")).alias("o")).orderBy("r").collect()]
        assert unmapped[:3] == ["000001", "000002", "000003"]

    def test_id_carry_over(self, spark):
        df = spark.createDataFrame([(0, " 7 "), (1, "None"), (2, "NULL")], "r long, e string")
        out = [r.o for r in df.select(keys.id_carry_over("e", "r").alias("o")).orderBy("r").collect()]
        assert out == ["7", "000002", "NULL"]


def test_staged_and_column_dates_agree(spark):
    from pyspark.sql import functions as F
    vals = ["15.08.1985", "1985/08/15", "15.8.85", "abc", "31.02.2020", "19850815", "2020-01-05", "15.08.1985 10:30",
            None, "nan", "01.02.1985", "02/03/2020", "13/02/2020", "2020-13-45", "1.1.70", "1.1.68", "1985-8-5",
            " 7/4/2021 ", "1/2/3/4", "2021/2/30"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, v string")
    out = dates.with_format_date(df, F.col("v"), "staged").select("i", "staged", dates.format_date("v").alias("col"))
    rows = out.orderBy("i").collect()
    assert [r.staged for r in rows] == [r.col for r in rows]
    assert rows[14].staged == "1970-01-01" and rows[15].staged == "2068-01-01" and rows[17].staged == "2021-07-04"
