"""Answers that must not depend on when, how often or on how many cores an
action runs, and cells that must survive equal names."""

import os

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import extras, mapping, resolve
from fieldmill.operators.rowid import with_row_index
from fieldmill.plans import twophase
from fieldmill.plans.spec import MappingSpec, Rule, default_rules
from fieldmill.sources import delimited, sinks
from fieldmill.streaming import rules_stream


def _source(spark, rows, cols):
    return with_row_index(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in cols)))


def _job(spark, rows, cols, layout, sources, rules, fields=(), **kw):
    spec = MappingSpec({t: "VARCHAR(60)" for t in layout}, sources, rules)
    return twophase.Job(_source(spark, rows, cols), spec, extra_fields=list(fields), **kw)


def test_exported_extra_values_have_their_row(spark, tmpdir_new):
    job = _job(spark, [(f"n{i}", f"x{i}") for i in range(20)], ["name", "notiz"], ["id", "p_name"],
               {"p_name": "name"}, {"id": Rule("generate_uid")}, [extras.ExtraField("notiz")])
    twophase.export(twophase.phase_b(job), tmpdir_new, "patienten.csv")
    rows = delimited.read_delimited(spark, os.path.join(tmpdir_new, "export.csv"))
    values = delimited.read_delimited(spark, os.path.join(tmpdir_new, sinks.PROPERTY_MAP_NAME))
    assert values.count() == 20
    assert values.join(rows, values.patienten_id == rows.id, "left_anti").count() == 0


def test_row_numbers_survive_another_split_size(spark, tmpdir_new):
    for f in range(3):
        with open(os.path.join(tmpdir_new, f"f{f}.csv"), "w") as out:
            out.write("a;b\n" + "".join(f"{f};{i}\n" for i in range(4000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = delimited.with_file_row_index(delimited.read_delimited(spark, tmpdir_new, file_order=True))
        first = sorted((r._row, r.a, r.b) for r in df.collect())
        spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
        second = sorted((r._row, r.a, r.b) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert first == second == [(f * 4000 + i, str(f), str(i)) for f in range(3) for i in range(4000)]


def test_long_quoted_cells(spark, tmpdir_new):
    long = "x;" * 50_000
    with open(os.path.join(tmpdir_new, "f.csv"), "w") as out:
        out.write(f'a;b;c\n1;"{long}"\n2;"{long}";z;too many\n')
    rows = delimited.read_delimited(spark, tmpdir_new).collect()
    assert [(r.a, r.b, r.c) for r in rows] == [("1", long, None)]
    assert delimited.detect_dialect(spark, tmpdir_new).first().delimiter == ";"


def test_line_break_in_a_cell_is_never_garbled(spark, tmpdir_new):
    with open(os.path.join(tmpdir_new, "f.csv"), "w") as out:
        out.write('a;b;c\n1;"x\ny";z\n')
    assert [tuple(r) for r in delimited.read_delimited(spark, tmpdir_new).collect()] == [("1", "x\ny", "z")]
    got = delimited.read_delimited(spark, tmpdir_new, multiline=True).collect()
    assert [tuple(r) for r in got] == [("1", "x\ny", "z")]


def test_keep_and_extra_fields_with_equal_names(spark):
    job = _job(spark, [("bad", "raw"), ("a@b.de", " ")], ["email", "p_vs"], ["email", "p_vs"],
               {"email": "email"}, {"email": Rule("validate_email")}, [extras.ExtraField("p_vs")])
    tables = twophase.phase_b(job, invalid_policy="keep")
    assert [r.email for r in tables["mapped"].orderBy("_row").collect()] == ["bad", "a@b.de"]
    assert [r.content for r in tables["property_values"].collect()] == ["raw"]


def test_both_phases_see_the_repaired_number(spark):
    job = _job(spark, [("=823672510",)], ["kv"], ["p_vnr"], {"p_vnr": "kv"}, {"p_vnr": Rule("validate_kvnr")})
    found = [(r.issue, r.target_col) for r in twophase.phase_a(job)["invalid"].collect()]
    mapped = twophase.phase_b(job)["mapped"].first().p_vnr
    assert found == [("repaired", "p_vnr")] and mapped == "P823672510"


def test_duplicate_decisions_have_a_winner(spark):
    df = spark.createDataFrame([(0, "toolong"), (1, "x")], "_row long, c string")
    d = spark.createDataFrame([(0, "c", "a"), (0, "c", "b")], "row_idx long, col_name string, new_val string")
    got = resolve.resolve_length(df, {"c": 3}, decisions=d)
    assert sorted((r._row, r.c) for r in got.collect()) == [(0, "b"), (1, "x")]


def test_chained_copy_and_postcode_width(spark):
    spec = MappingSpec({"a": "TEXT", "b": "TEXT", "plz": "TEXT"}, {"b": "src", "plz": "plz"},
                       {"a": Rule("copy_target", "b"), "b": Rule("copy_target", "plz"), "plz": Rule("clean_plz")})
    df = spark.createDataFrame([(0, "own", "8033")], "_row long, src string, plz string")
    r = mapping.project_to_schema(df, spec, postcode_width=8).first()
    assert (r.a, r.b, r.plz) == ("own", "00008033", "00008033")


def test_field_names_keep_letters_and_definitions_need_values(spark):
    assert extras.default_field_name(" Größe (cm)") == "größe_cm"
    df = spark.createDataFrame([(0, "k", "v", " ")], "_row long, id string, a string, b string")
    fields = [extras.ExtraField("a"), extras.ExtraField("b")]
    values = extras.property_values(df, fields)
    assert [r.id for r in extras.property_definitions(values, fields).collect()] == ["#a"]
    with pytest.raises(ValueError):
        extras.property_values(df, [extras.ExtraField("a"), extras.ExtraField("b", "a")])


def test_presets_by_ending_and_part():
    rules, _ = default_rules({"p_zuzahlungsbefreit_bis": "DATE", "datum_neu": "TEXT", "mail2": "TEXT", "x": "TEXT"}, [], {})
    assert {t: r.type for t, r in rules.items()} == {
        "p_zuzahlungsbefreit_bis": "format_date", "datum_neu": "format_date", "mail2": "validate_email"}


def test_byte_order_mark_output(spark, tmpdir_new):
    path = sinks.write_table(spark.createDataFrame([("ü",)], "a string").coalesce(1), tmpdir_new + "/o",
                             encoding="utf-8-sig")
    part = next(f for f in os.listdir(path) if f.startswith("part-"))
    with open(os.path.join(path, part), "rb") as f:
        assert f.read() == "\ufeffa\nü\n".encode()


def test_stream_drops_overlong_rows_under_a_narrow_mapping(spark, tmpdir_new):
    src = os.path.join(tmpdir_new, "in")
    os.makedirs(src)
    with open(os.path.join(src, "f.csv"), "w") as out:
        out.write("a;b\n1;x\n2;y;z\n")
    stream = rules_stream.read_delimited_stream(spark, src, ["a", "b"])
    out = rules_stream.project_stream(stream, MappingSpec({"t": "TEXT"}, {"t": "a"}, {}))
    rules_stream.run_available_now(out, os.path.join(tmpdir_new, "out"), os.path.basename(tmpdir_new))
    assert [r.t for r in spark.read.parquet(os.path.join(tmpdir_new, "out")).collect()] == ["1"]
