"""Sources and sinks: delimited shapes (FIXTURES.md §5), encodings, dialect,
writers; plus the DuckDB oracle on the driver tables at sf0.001."""

import io
import os

import duckdb
import pytest

from fieldmill.plans import catalog
from fieldmill.sources import delimited, dims, sinks

SHAPES = ["id;x;y", "1;a;b", "2;s", "3;t;m;c", "4;e;m;", "5;x;y;;z", "6;x;y;w;z", "8;;;;", "9;a;;z",
          '7;"a;b";', "", '10;"";q', '11;"p;q;r;s"', "12;NULL;NA", "13;None;null", "14;N/A;-"]


def _write(path, lines, encoding="utf-8"):
    with open(path, "w", encoding=encoding, newline="\n") as f:
        f.write("\n".join(lines) + "\n")


class TestReadDelimited:
    def test_shapes(self, spark, tmpdir_new):
        p = os.path.join(tmpdir_new, "a.csv")
        _write(p, SHAPES)
        rows = {r.id: (r.x, r.y) for r in delimited.read_delimited(spark, p).collect()}
        assert rows == {"1": ("a", "b"), "2": ("s", None), "7": ("a;b", None), "10": (None, "q"),
                        "11": ("p;q;r;s", None), "12": (None, None), "13": (None, None), "14": (None, "-")}

    def test_pruned_projection_keeps_drop_rule(self, spark, tmpdir_new):
        p = os.path.join(tmpdir_new, "a.csv")
        _write(p, SHAPES)
        df = delimited.read_delimited(spark, p)
        assert df.select("id").count() == 8 and df.count() == 8

    def test_na_tokens_argument(self, spark, tmpdir_new):
        p = os.path.join(tmpdir_new, "a.csv")
        _write(p, ["name;x", "Null;1", "NA;2"])
        keep = [r.name for r in delimited.read_delimited(spark, p, na_tokens=[]).collect()]
        assert sorted(keep) == ["NA", "Null"]

    @pytest.mark.parametrize("enc", ["utf-8-sig", "utf-8", "cp1252", "latin1"])
    def test_encodings(self, spark, tmpdir_new, enc):
        p = os.path.join(tmpdir_new, "e.csv")
        _write(p, ["id;name", "1;Müller", "2;Straße"], encoding=enc)
        got = [r.name for r in delimited.read_delimited(spark, p, encoding=enc).orderBy("id").collect()]
        assert got == ["Müller", "Straße"]

    def test_separators(self, spark, tmpdir_new):
        for sep in [",", "\t", ";"]:
            p = os.path.join(tmpdir_new, f"s{ord(sep)}.csv")
            _write(p, [sep.join(["id", "v"]), sep.join(["1", "a"])])
            assert [tuple(r) for r in delimited.read_delimited(spark, p, sep=sep).collect()] == [("1", "a")]


class TestDialect:
    def test_detect(self, spark, tmpdir_new):
        _write(os.path.join(tmpdir_new, "semi.csv"), ["a;b;c", "1;2;3", '4;"x,y";6'])
        _write(os.path.join(tmpdir_new, "comma.csv"), ["a,b", "1,2"])
        _write(os.path.join(tmpdir_new, "tab.csv"), ["a\tb\tc", "1\t2\t3"])
        _write(os.path.join(tmpdir_new, "w.csv"), ["a;b", "1;Müller"], encoding="cp1252")
        got = {os.path.basename(r.file_path): (r.delimiter, r.encoding)
               for r in delimited.detect_dialect(spark, tmpdir_new).collect()}
        assert got["semi.csv"] == (";", "utf-8")
        assert got["comma.csv"] == (",", "utf-8")
        assert got["tab.csv"] == ("\t", "utf-8")
        assert got["w.csv"] == (";", "cp1252")


class TestDims:
    def test_file_order_over_many_files(self, spark, tmpdir_new):
        lines = spark.createDataFrame([(i, f"DE {i:05d} Ort{i}") for i in range(300)], "line long, value string")
        path = os.path.join(tmpdir_new, "plz")
        lines.repartitionByRange(5, "line").sortWithinPartitions("line").select("value").write.text(path)
        d = dims.read_postcode_dim(spark, path).orderBy("line").collect()
        assert [r.line for r in d] == list(range(300)) and d[17].postcode == "00017"

    def test_payer_file(self, spark, tmpdir_new):
        p = os.path.join(tmpdir_new, "gkv.txt")
        _write(p, ["109519005 AOK Nordost 14467 Potsdam", "", "x", "109519005 AOK Neu 14467 Potsdam"])
        got = [(r.line, r.ik, r.name) for r in dims.read_payer_dim(spark, p).orderBy("line").collect()]
        assert got == [(0, "109519005", "AOK Nordost"), (3, "109519005", "AOK Neu")]


class TestSinks:
    def test_null_literal_and_layout_order(self, spark, tmpdir_new):
        df = spark.createDataFrame([("1", None, "x"), ("2", "", " y ")], "b string, a string, c string")
        path = os.path.join(tmpdir_new, "out")
        sinks.write_mapped(df, path, {"a": "VARCHAR(1)", "b": "VARCHAR(1)", "c": "TEXT"})
        lines = sorted(r.value for r in spark.read.text(path).collect() if r.value != "a;b;c")
        assert lines == ["NULL;1;x", "NULL;2; y "]  # one header per part file

    def test_flagged_and_extras_names(self, spark, tmpdir_new):
        df = spark.createDataFrame([(2, "f")], "__quell_zeile long, __gefundene_fehler string")
        p = sinks.write_flagged(df, tmpdir_new)
        assert p.endswith("geflaggte_datensaetze_kontrolle.csv") and os.path.isdir(p)
        rest = spark.createDataFrame([(0, "n")], "_row long, notiz string")
        p2 = sinks.write_rest(rest, tmpdir_new, "/x/patienten.csv")
        assert os.path.basename(p2) == "REST_UNMAPPED_patienten.csv"
        assert [tuple(r) for r in delimited.read_delimited(spark, p2).collect()] == [("n",)]


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def test_oracle_all_queries_sf0001(spark):
    """Every registered query equals its DuckDB oracle on sf0.001."""
    import math

    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "<null>"
        return repr(round(v, 9)) if isinstance(v, float) else str(v)

    def rows(cols, data):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(tuple(norm(r[i]) for i in order) for r in data)

    qs, sqls = catalog.QUERIES, catalog.ORACLES
    assert len(qs) >= 54 and set(sqls) <= set(qs) and qs.items() <= E.queries().items()
    for name in sqls:
        df = qs[name](spark, sf)
        got = rows(df.columns, [tuple(r) for r in df.collect()])
        cur = con.execute(sqls[name])
        want = rows([d[0] for d in cur.description], cur.fetchall())
        assert sorted(df.columns) == sorted(d[0] for d in cur.description), name
        assert got == want, name
    assert E.entry(spark).count() >= 0


def test_file_order_over_many_files(spark, tmpdir_new):
    # file sizes differ, so Spark packs splits out of file order
    for i, n in enumerate([5, 400, 40, 2000]):
        _write(os.path.join(tmpdir_new, f"part{i}.csv"), ["f;k"] + [f"{i};{j}" for j in range(n)])
    df = delimited.with_file_row_index(delimited.read_delimited(spark, tmpdir_new, file_order=True))
    rows = sorted((r._row, int(r.f), int(r.k)) for r in df.collect())
    assert [r[0] for r in rows] == list(range(2445))
    assert [(f, k) for _, f, k in rows] == sorted((f, k) for _, f, k in rows)
    assert df.columns == ["f", "k", "_row"]


def test_file_order_with_dropped_rows_and_many_splits(spark, tmpdir_new):
    # long rows are dropped before numbering; a small split size forces many splits per file
    lines = ["a;b"] + [f"{j};x" if j % 10 else f"{j};x;extra" for j in range(30000)]
    _write(os.path.join(tmpdir_new, "big.csv"), lines)
    _write(os.path.join(tmpdir_new, "small.csv"), ["a;b", "s1;y", "s2;y"])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = delimited.with_file_row_index(delimited.read_delimited(spark, tmpdir_new, file_order=True))
        rows = sorted((r._row, r.a) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    want = [str(j) for j in range(30000) if j % 10] + ["s1", "s2"]
    assert [a for _, a in rows] == want and [i for i, _ in rows] == list(range(len(want)))


def test_dialect_reads_whole_files(spark, tmpdir_new):
    rows = ["a|b|c"] + ["1|2|3"] * 20000
    _write(os.path.join(tmpdir_new, "big.csv"), rows)
    with open(os.path.join(tmpdir_new, "late.csv"), "wb") as f:
        f.write("\n".join([*rows, "M\u00fcller|1|2", ""]).encode("cp1252"))
    with open(os.path.join(tmpdir_new, "odd.csv"), "wb") as f:
        f.write("\n".join([*rows, ""]).encode() + b"\x81|1|2\n")
    answers = []
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("8192", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            answers.append({os.path.basename(r.file_path): (r.delimiter, r.encoding, r.n_lines)
                            for r in delimited.detect_dialect(spark, tmpdir_new).collect()})
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert answers[0] == answers[1] == {"big.csv": ("|", "utf-8", 20001), "late.csv": ("|", "cp1252", 20002),
                                        "odd.csv": ("|", "latin1", 20002)}


def _split_size(spark, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    return old


class TestHeadersPerFile:
    def test_order_differs(self, spark, tmpdir_new):
        _write(os.path.join(tmpdir_new, "a.csv"), ["id;name", "1;A", "3;C;x", "4"])
        _write(os.path.join(tmpdir_new, "b.csv"), ["name;id", "B;2"])
        df = delimited.read_delimited(spark, tmpdir_new)
        assert df.columns == ["id", "name"]
        assert sorted(map(tuple, df.collect())) == [("1", "A"), ("2", "B"), ("4", None)]

    def test_missing_and_more_columns(self, spark, tmpdir_new):
        _write(os.path.join(tmpdir_new, "a.csv"), ["id;name", "1;A", "2;B;long"])
        _write(os.path.join(tmpdir_new, "b.csv"), ["zip;id;name;id", "9;3;C;7", "8;4"])
        df = delimited.read_delimited(spark, tmpdir_new)
        assert df.columns == ["id", "name", "zip", "id1", "id3"]
        assert sorted(tuple(x or "" for x in r) for r in df.collect()) == [
            ("", "", "8", "4", ""), ("", "C", "9", "3", "7"), ("1", "A", "", "", "")]
        only = delimited.read_delimited(spark, tmpdir_new, columns=["name", "zip"])
        assert sorted(tuple(x or "" for x in r) for r in only.collect()) == [("", "8"), ("A", ""), ("C", "9")]
        with pytest.raises(ValueError, match="lacks a column"):
            delimited.read_delimited(spark, tmpdir_new, unknown="error")

    def test_numbered_in_file_order(self, spark, tmpdir_new):
        _write(os.path.join(tmpdir_new, "a.csv"), ["f;k"] + [f"0;{j}" for j in range(50)])
        _write(os.path.join(tmpdir_new, "b.csv"), ["k;f"] + [f"{j};1" + (";x" if j % 7 == 0 else "") for j in range(90)])
        rows = sorted((r._row, r.f, int(r.k)) for r in delimited.with_file_row_index(
            delimited.read_delimited(spark, tmpdir_new, file_order=True)).collect())
        want = [("0", j) for j in range(50)] + [("1", j) for j in range(90) if j % 7]
        assert rows == [(i, *w) for i, w in enumerate(want)]


class TestLineBreaks:
    CELLS = ["a", "", "x\ny", "\n", 'say "hi"', '"', '"\n"', 'b"c', ";\n;", "\n\n", "\u00fc\n\u00df", "NULL"]

    def _file(self, path, seed, n):
        import csv as csvlib
        import random
        rnd = random.Random(seed)
        rows = [[str(i), rnd.choice(self.CELLS), rnd.choice(self.CELLS) + str(i % 7)] for i in range(n)]
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write("id;x;y\n")
            for i, r in enumerate(rows):
                out = io.StringIO()
                csvlib.writer(out, delimiter=";", lineterminator="\n").writerow(r)
                f.write(out.getvalue() if i % 5 else f'{r[0]};5" pipe;y{i % 7}\n')
        return [[r[0], '5" pipe', f"y{i % 7}"] if i % 5 == 0 else r for i, r in enumerate(rows)]

    @pytest.mark.parametrize("size", ["64", "1000", "128m"])
    def test_any_split_size(self, spark, tmpdir_new, size):
        want = self._file(os.path.join(tmpdir_new, "a.csv"), 1, 300) + self._file(os.path.join(tmpdir_new, "b.csv"), 2, 40)
        old = _split_size(spark, size)
        try:
            df = delimited.with_file_row_index(
                delimited.read_delimited(spark, tmpdir_new, file_order=True, na_tokens=[""]))
            got = [(r.id, r.x or "", r.y or "") for r in df.orderBy("_row").collect()]
            numbers = sorted(r._row for r in df.collect())
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got == [tuple(r) for r in want] and numbers == list(range(340))

    def test_as_multiline(self, spark, tmpdir_new):
        _write(os.path.join(tmpdir_new, "a.csv"), ["id;name", '1;"x', 'y"', '2;"a;', ';"";b"', "3;z", '4;"', "", '"'])
        plain = sorted(map(tuple, delimited.read_delimited(spark, tmpdir_new, multiline=True).collect()))
        assert sorted(map(tuple, delimited.read_delimited(spark, tmpdir_new).collect())) == plain
        assert plain == [("1", "x\ny"), ("2", 'a;\n;";b'), ("3", "z"), ("4", "\n\n")]

    def test_cell_over_many_splits(self, spark, tmpdir_new):
        cell = "\n".join(f"line {i}" for i in range(200))
        _write(os.path.join(tmpdir_new, "a.csv"), ["id;name", "0;a", f'1;"{cell}"', "2;b", '3;"never', "closed;x"])
        old = _split_size(spark, "50")
        try:
            got = sorted(map(tuple, delimited.read_delimited(spark, tmpdir_new).collect()))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        assert got[:3] == [("0", "a"), ("1", cell), ("2", "b")] and got[3][0] == "3"


class TestDialectOfFlawedFiles:
    def _of(self, spark, folder, name, lines, encoding="utf-8"):
        _write(os.path.join(folder, name), lines, encoding)
        r = delimited.detect_dialect(spark, os.path.join(folder, name)).first()
        return r.delimiter, r.quote, r.encoding, r.n_lines

    def test_golden(self, spark, tmpdir_new):
        of = lambda *a: self._of(spark, tmpdir_new, *a)
        body = [f"{i};Name, {i};x" for i in range(40)]
        assert of("title.csv", ["Export of 1 May, 2020", "", "id;name;x", *body]) == (";", '"', "utf-8", 42)
        assert of("broken.csv", ["id;name;x", *body, "1;2;3;4;5", "cut off"]) == (";", '"', "utf-8", 43)
        assert of("single.csv", ["id,name,x", *[f"{i},'a, b{i % 3 * ', c'}',y" for i in range(30)]]) == (",", "'", "utf-8", 31)
        assert of("apostrophe.csv", ["id;name", *[f"{i};O'Neill;{i}" for i in range(20)]])[:2] == (";", '"')
        assert of("quoted.csv", ["id\tname", *[f'{i}\t"a\t{"b" * (i % 4)}{chr(9) * (i % 3)}"' for i in range(20)]])[:2] == ("\t", '"')
        assert of("one.csv", ["name", "a", "b"]) == (";", '"', "utf-8", 3)
        assert of("umlaut.csv", ["a|b", *["M\u00fc|1"] * 9], "cp1252") == ("|", '"', "cp1252", 10)

    def test_a_broken_line_among_many(self, spark, tmpdir_new):
        assert self._of(spark, tmpdir_new, "big.csv", ["a|b|c"] + ["1,5|2|3"] * 20000 + ["|"])[0] == "|"

    def test_read_with_the_quote_found(self, spark, tmpdir_new):
        path = os.path.join(tmpdir_new, "s.csv")
        _write(path, ["id;name", "1;'a;b'", "2;'x", "y'", "3;\"z\"", "4;'it''s'", "5;'q';long"])
        d = delimited.detect_dialect(spark, path).first()
        rows = delimited.read_delimited(spark, path, sep=d.delimiter, quote="'").collect()
        assert sorted(map(tuple, rows)) == [("1", "a;b"), ("2", "x\ny"), ("3", '"z"'), ("4", "it's")]
