"""Table-level operators: row index, lookups, findings, decisions, mapping."""

import itertools

import pytest
from pyspark.sql import functions as F

from fieldmill.operators import extras, findings, lookups, mapping, resolve
from fieldmill.operators.findings import Checked
from fieldmill.operators.rowid import with_row_index
from fieldmill.plans.spec import MappingSpec, Rule, default_rules
from fieldmill.schemas import LAYOUTS, limits, parse_limit, target_struct


class TestRowIndex:
    @pytest.mark.parametrize("parts", [1, 3, 7])
    def test_contiguous_any_partitioning(self, spark, parts):
        df = spark.range(0, 1000, 1, parts).select((F.col("id") * 7 % 1000).alias("k"))
        out = with_row_index(df.repartition(parts), order_by=["k"])
        rows = out.select("k", "_row").collect()
        assert sorted(r._row for r in rows) == list(range(1000))
        assert all(r._row == r.k for r in rows)

    def test_file_order_without_sort(self, spark):
        df = spark.range(0, 500, 1, 5)
        rows = with_row_index(df).collect()
        assert all(r._row == r.id for r in rows)


def _lines(spark, lines):
    return spark.createDataFrame(list(enumerate(lines)), "line long, value string")


class TestLookups:
    POSTCODES = ["DE 1945 Ruhland", "DE 01945 Guteborn", "DE 01945 Ruhland", "", "DE 12",
                 "DE 10115 Berlin", "DE 10117 berlin", "DE\t20095\tHamburg Altstadt"]

    def test_postcode_dim_lists_and_firsts(self, spark):
        dim = lookups.postcode_dim_from_lines(_lines(spark, self.POSTCODES))
        firsts = {r.postcode: r.city for r in lookups.first_city_by_postcode(dim).collect()}
        assert firsts["01945"] == "Ruhland" and firsts["20095"] == "Hamburg Altstadt"  # D14: tab lines keep spaces
        lists = {r.postcode: r.cities for r in lookups.cities_by_postcode(dim).collect()}
        assert lists["01945"] == ["Ruhland", "Guteborn"]
        plz = {r.city_key: r.postcodes for r in lookups.postcodes_by_city(dim).collect()}
        assert plz["berlin"] == ["10115", "10117"]

    def test_lookup_city_and_postcode(self, spark):
        dim = lookups.postcode_dim_from_lines(_lines(spark, self.POSTCODES))
        src = spark.createDataFrame([(0, None, "1945"), (1, " Cottbus ", "1945"), (2, None, "99999"), (3, None, None)],
                                    "r int, own string, plz string")
        out = lookups.lookup_city_by_postcode(src, F.col("own"), F.col("plz"), dim, "city").orderBy("r")
        assert [r.city for r in out.collect()] == ["Ruhland", "Cottbus", None, None]
        src2 = spark.createDataFrame([(0, None, " BERLIN "), (1, "8033", "Berlin"), (2, None, "Nowhere")],
                                     "r int, own string, city string")
        out2 = lookups.lookup_postcode_by_city(src2, F.col("own"), F.col("city"), dim, "plz").orderBy("r")
        assert [r.plz for r in out2.collect()] == ["10115", "08033", None]
        out3 = lookups.all_cities_by_postcode(src, F.col("plz"), dim, "c").orderBy("r")
        assert [r.c for r in out3.collect()] == [["Ruhland", "Guteborn"], ["Ruhland", "Guteborn"], [], []]

    PAYERS = ["109519005 AOK Nordost 14467 Potsdam Weg", "101575519 Techniker Krankenkasse 22305 Hamburg X",
              "104212505 BARMER 42285 Wuppertal Y", "109519005 AOK Nordost Neu 14467 Potsdam Weg",
              "12345 too short", "260326822 IKK classic Dresden Z"]

    def test_payer_dim_last_line_wins(self, spark):
        dim = lookups.payer_dim_from_lines(_lines(spark, self.PAYERS))
        by_id = {r.ik: r.payer_name for r in lookups.payer_by_id(dim).collect()}
        assert by_id["109519005"] == "AOK Nordost Neu"
        assert by_id["260326822"] == "IKK classic"  # no 5-digit part: parts two and three
        src = spark.createDataFrame([(0, "109519005.0"), (1, " 104212505 "), (2, "999")], "r int, ik string")
        out = lookups.lookup_payer_by_id(src, F.col("ik"), dim, "kasse").orderBy("r")
        assert [r.kasse for r in out.collect()] == ["AOK Nordost Neu", "BARMER", None]

    def test_fuzzy_matches_brute_force(self, spark):
        dim = lookups.payer_dim_from_lines(_lines(spark, self.PAYERS))
        probes = ["aok nordost", "Techniker Krankenkase", "Krankenkasse Techniker", "BARMR", "zzz", "", "IKK clasic"]
        src = spark.createDataFrame(list(enumerate(probes)), "r int, name string")
        got = {r.r: (r.match_ik, r.match_name, r.match_score)
               for r in lookups.match_payer_fuzzy(src, F.col("name"), dim).collect()}
        # brute force in plain Python over the distinct names, same scoring
        names = []
        for ln in self.PAYERS:
            parts = ln.split()
            if len(parts) >= 4 and parts[0].isdigit() and len(parts[0]) == 9:
                z = next((i for i in range(1, len(parts)) if parts[i].isdigit() and len(parts[i]) == 5), None)
                nm = " ".join(parts[1:z] if z else parts[1:3])
                if nm not in names:
                    names.append(nm)

        def lev(a, b):
            prev = list(range(len(b) + 1))
            for i, ca in enumerate(a, 1):
                cur = [i]
                for j, cb in enumerate(b, 1):
                    cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
                prev = cur
            return prev[-1]

        def sim(a, b):
            m = max(len(a), len(b))
            return 1.0 if m == 0 else 1.0 - lev(a, b) / m

        def ts(s):
            return " ".join(sorted(s.lower().strip().split()))

        for r, p in enumerate(probes):
            q = p.strip().lower()
            exact = [n for n in names if n.lower() == q]
            if not q:
                assert got[r][0] is None
                continue
            if exact:
                assert got[r][2] == 1.0
                continue
            scores = [(max(sim(q, n.lower()), 0.95 * sim(ts(q), ts(n))), -i, n) for i, n in enumerate(names)]
            best = max(scores)
            if best[0] >= 0.6:
                assert got[r][1] == best[2] and abs(got[r][2] - best[0]) < 1e-9
            else:
                assert got[r][1] is None


def _src(spark):
    rows = [("1", "Dr. med. Anna Beispiel", "A123456780", "109519005", "a@b.de", "Hauptstr. 12-14", "M"),
            ("2", "Hans Müller!", "JO12345677", "123456789", "user@domain", "Weg 2a", "x"),
            ("3", "", "O123456789", "99", " ", "Auf den Hüllen", None),
            ("4", "X" * 70, None, None, None, None, "2")]
    df = spark.createDataFrame(rows, "id string, name string, kvnr string, ik string, mail string, street string, sex string")
    return with_row_index(df, order_by=["id"])


class TestFindings:
    MAP = [Checked("name", "p_name", 60, None), Checked("kvnr", "p_vnr", 40, "validate_kvnr"),
           Checked("ik", "p_ik", 40, "validate_ik"), Checked("mail", "p_email", 60, "validate_email"),
           Checked("street", "p_hausnummer", 10, "split_number")]

    def test_flag_records_messages(self, spark):
        out = {r["__quell_zeile"]: r["__gefundene_fehler"] for r in findings.flag_records(_src(spark), self.MAP).collect()}
        assert "KVNR in 'kvnr' korrigiert: (JO12345677 -> J012345677)" in out[3]
        assert "Ungültige IK in 'ik' (123456789)" in out[3]
        assert "Sonderzeichen in 'name' -> 'p_name' (Hans Müller! -> Hans Müller)" in out[3]
        assert "Ungültige E-Mail in 'mail' (user@domain)" in out[3]
        assert "Ungültige KVNR in 'kvnr' (O123456789)" in out[4]
        assert out[5] == f"Überlänge in 'p_name' (aus 'name'): '{'X' * 70}' hat 70 Zeichen (max. 60)"
        assert 2 not in out  # row 1 is clean (export split: '12-14' fits)

    def test_flag_precheck_split_mode(self, spark):
        m = [Checked("street", "p_hausnummer", 2, "split_number")]
        exp = {r["__quell_zeile"] for r in findings.flag_records(_src(spark), m).collect()}
        pre = {r["__quell_zeile"] for r in findings.flag_records(_src(spark), m, split_mode="precheck").collect()}
        assert 2 in exp and 2 not in pre  # '12-14' vs '14' (D11)

    def test_d18_email_flag_optional(self, spark):
        m = [Checked("mail", "p_email", 60, "validate_email")]
        assert findings.flag_records(_src(spark), m, check_email=False).count() == 0

    def test_invalid_cells_and_summary(self, spark):
        cells = findings.invalid_cells(_src(spark), [("p_vnr", "kvnr", "validate_kvnr"), ("p_ik", "ik", "validate_ik"),
                                                     ("p_email", "mail", "validate_email")])
        got = sorted((r.row_idx, r.target_col, r.issue) for r in cells.collect())
        assert got == [(1, "p_email", "invalid"), (1, "p_ik", "invalid"), (1, "p_vnr", "repaired"), (2, "p_vnr", "invalid")]
        summ = {(r.target_col, r.issue): r.n for r in findings.issue_summary(cells, ["target_col", "issue"]).collect()}
        assert summ[("p_vnr", "repaired")] == 1

    def test_length_conflicts_and_resolve(self, spark):
        df = spark.createDataFrame([(0, "abcdef", "NULL"), (1, "ab", "toolong")], "_row long, a string, b string")
        lim = {"a": 3, "b": 4}
        conf = sorted((r.row_idx, r.col_name) for r in findings.length_conflicts(df, lim).collect())
        assert conf == [(0, "a"), (1, "b")]
        out = resolve.resolve_length(df, lim).orderBy("_row").collect()
        assert [(r.a, r.b) for r in out] == [("abc", "NULL"), ("ab", "tool")]
        dec = spark.createDataFrame([(1, "b", "kurz")], "row_idx long, col_name string, new_val string")
        out = resolve.resolve_length(df, lim, decisions=dec).orderBy("_row").collect()
        assert [(r.a, r.b) for r in out] == [("abc", "NULL"), ("ab", "kurz")]

    def test_cleanup_preview_and_apply(self, spark):
        df = spark.createDataFrame([(0, "a%b", "ok"), (1, "x!", " ")], "_row long, c1 string, c2 string")
        prev = sorted((r.row_idx, r.col_name, r.cleaned) for r in findings.cleanup_preview(df, ["c1", "c2"]).collect())
        assert prev == [(0, "c1", "ab"), (1, "c1", "x")]
        rej = spark.createDataFrame([(1, "c1")], "row_idx long, col_name string")
        out = resolve.apply_cleanup(df, ["c1", "c2"], rejected=rej).orderBy("_row").collect()
        assert [(r.c1, r.c2) for r in out] == [("ab", "ok"), ("x!", " ")]

    def test_d3_invalid_decisions(self, spark):
        df = spark.createDataFrame([(0, None, "bad1"), (1, None, "bad2"), (2, None, "bad3"), (3, "ok", "ok")],
                                   "_row long, t string, s string")
        assert [r.t for r in resolve.apply_invalid_decisions(df, [("t", "s")], policy="keep").orderBy("_row").collect()] \
            == ["bad1", "bad2", "bad3", "ok"]
        dec = spark.createDataFrame([(0, "t", "keep", None), (1, "t", "custom", "FIX"), (2, "t", "custom", " ")],
                                    "row_idx long, target_col string, action string, custom_val string")
        out = resolve.apply_invalid_decisions(df, [("t", "s")], policy="clear", decisions=dec).orderBy("_row")
        assert [r.t for r in out.collect()] == ["bad1", "FIX", None, "ok"]


class TestMapping:
    def test_layouts(self):
        assert list(LAYOUTS["patienten"])[:3] == ["id", "p_nr", "p_anrede"] and len(LAYOUTS["patienten"]) == 24
        assert len(LAYOUTS["adressen"]) == 13
        assert parse_limit("varchar(40)") == 40 and parse_limit("TEXT") is None
        assert limits("adressen")["plz"] == 10
        assert target_struct("patienten")["p_plz"].metadata["max_len"] == 10

    def test_match_columns_ranked(self, spark):
        cols = ["notiz", "vorname", "nachname", "plz", "ort", "handy", "telefon1", "id", "kas_ik", "p_ik"]
        cat = spark.createDataFrame([("f", i, c) for i, c in enumerate(cols)], "source_table string, position int, column_name string")
        got = {r.target: (r.source_column, r.match_kind) for r in mapping.match_columns(cat, LAYOUTS["patienten"]).collect()}
        assert got["p_vname"] == ("vorname", "synonym")
        assert got["p_plz"] == ("plz", "exact")          # D21
        assert got["p_ik"] == ("p_ik", "exact")          # D13: exact beats an earlier synonym
        assert got["p_handy"] == ("handy", "exact")        # D21: p_ prefix stripped
        assert got["p_tel"] == ("telefon1", "phone")
        assert got["p_nr"] == ("id", "id")

    def test_default_rules(self):
        rules, sources = default_rules(LAYOUTS["patienten"], ["id", "ort", "plz", "kas_ik"], {})
        assert rules["id"].type == "generate_uid" and rules["p_nr"].type == "none" and sources["p_nr"] == "id"
        assert rules["p_plz"] == Rule("lookup_plz_by_city", "ort")
        assert rules["p_ort"] == Rule("lookup_city_by_plz", "plz")
        assert rules["p_krankenkasse"] == Rule("lookup_ik_provider", "kas_ik")
        assert rules["p_vnr"].type == "validate_kvnr" and rules["p_email"].type == "validate_email"

    def test_project_copy_rest_and_extras(self, spark):
        src = _src(spark)
        spec = MappingSpec.for_layout("patienten",
                                      {"p_name": "name", "p_vnr": "kvnr", "p_ik": "ik", "p_email": "mail",
                                       "p_hausnummer": "street", "p_street": "street", "p_anrede": "sex"},
                                      {"id": Rule("generate_uid"), "p_nr": Rule("auto_sequence_6"),
                                       "p_vnr": Rule("validate_kvnr"), "p_ik": Rule("validate_ik"),
                                       "p_email": Rule("validate_email"), "p_hausnummer": Rule("split_number"),
                                       "p_street": Rule("split_street"), "p_anrede": Rule("gender"),
                                       "p_vs": Rule("static_value", "AKTIV"), "p_wlc": Rule("copy_target", "p_vs"),
                                       "p_vip": Rule("default_value", "0")})
        out = mapping.project_to_schema(src, spec, keep=["id"], split_titles=True).orderBy("_row").collect()
        r0, r1, r2 = out[0], out[1], out[2]
        assert r0.p_name == "Anna Beispiel" and r0.p_nr == "000001" and r0.p_vs == "AKTIV" and r0.p_wlc == "AKTIV"
        assert r0.p_hausnummer == "12-14" and r0.p_street == "Hauptstr." and r0.p_anrede == "Herr"
        assert r1.p_vnr == "J012345677"   # D2: repaired value exported
        assert r1.p_ik is None and r1.p_email is None and r1.p_anrede == "x"
        assert r2.p_ik == "000000099" and r2.p_vnr is None and r2.p_name is None  # D4: empty stays null
        assert r0.p_vip == "0" and r0.p_plz is None
        rest = mapping.rest_table(src, spec)
        assert rest.columns == ["_row", "id"]
        fields = [extras.ExtraField("id", "Alt ID")]
        vals = extras.property_values(src, fields, id_col="id").collect()
        assert {(v.property_id, v.content) for v in vals} == {("#Alt ID", s) for s in "1234"}
        assert extras.default_field_name(" Alte Nr-2! ") == "alte_nr_2"
        defs = extras.property_definitions(src, fields).first()
        assert (defs.id, defs.label, defs.maxwidth, defs.system) == ("#Alt ID", "id", 255, 202)

    def test_d17_constant_everywhere(self, spark):
        src = _src(spark)
        spec = MappingSpec.for_layout("adressen", {}, {"id": Rule("static_value", "K")})
        assert {r.id for r in mapping.project_to_schema(src, spec).collect()} == {"K"}

    def test_merge_rule(self, spark):
        df = spark.createDataFrame([(0, "Musterstr.", "4"), (1, None, "5"), (2, "Weg", None)], "_row long, s string, n string")
        spec = MappingSpec.for_layout("adressen", {"strasse": "s"}, {"strasse": Rule("merge_columns", "n")})
        out = [r.strasse for r in mapping.project_to_schema(df, spec).orderBy("_row").collect()]
        assert out == ["Musterstr. 4", "5", "Weg"]

    def test_repartition_independent(self, spark):
        src = _src(spark)
        spec = MappingSpec.for_layout("patienten", {"p_name": "name"}, {"p_nr": Rule("auto_sequence_6")})
        a = sorted(tuple(r) for r in mapping.project_to_schema(src, spec).drop("id").collect())
        b = sorted(tuple(r) for r in mapping.project_to_schema(src.repartition(3), spec).drop("id").collect())
        assert a == b


def test_no_python_udfs_in_plans(spark):
    """Every operator plan stays JVM-side: no Python UDF evaluation nodes."""
    src = _src(spark)
    plans = [findings.flag_records(src, TestFindings.MAP),
             mapping.project_to_schema(src, MappingSpec.for_layout("patienten", {"p_name": "name"}, {}))]
    for df in plans:
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text


def test_product_of_check_outputs_is_whole(spark):
    # every source row shows up exactly once in the projection (no drop, no dup)
    src = _src(spark)
    out = mapping.project_to_schema(src, MappingSpec.for_layout("adressen", {}, {}))
    assert sorted(r._row for r in out.collect()) == list(itertools.islice(itertools.count(), 4))


class TestSaltedJoin:
    """The non-broadcast path: a hot key with a third of all rows, salted."""

    def test_salted_equals_broadcast(self, spark):
        from fieldmill.operators.joins import lookup_join
        fact = spark.range(0, 3000, 1, 6).select(
            "id", F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise((F.col("id") % 50).cast("string")).alias("k"))
        dim = spark.createDataFrame([("HOT", "h")] + [(str(i), f"v{i}") for i in range(40)], "key string, val string")
        a = sorted(tuple(r) for r in lookup_join(fact, dim, F.col("k"), "key").collect())
        b = sorted(tuple(r) for r in lookup_join(fact, dim, F.col("k"), "key", max_rows=0, salts=8).collect())
        assert a == b and len(a) == 3000
        assert sum(1 for r in b if r[2] == "h") == 1000

    def test_lookups_without_broadcast(self, spark):
        dim = lookups.postcode_dim_from_lines(_lines(spark, TestLookups.POSTCODES))
        src = spark.createDataFrame([(i, None, "1945" if i % 3 else "10115") for i in range(300)],
                                    "r int, own string, plz string")
        a = lookups.lookup_city_by_postcode(src, F.col("own"), F.col("plz"), dim, "city")
        b = lookups.lookup_city_by_postcode(src, F.col("own"), F.col("plz"), dim, "city", max_rows=0)
        assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())

    def test_fuzzy_without_broadcast(self, spark):
        dim = lookups.payer_dim_from_lines(_lines(spark, TestLookups.PAYERS))
        src = spark.createDataFrame(list(enumerate(["aok nordost", "BARMR", "zzz", "Techniker Krankenkase"])),
                                    "r int, name string")
        a = lookups.match_payer_fuzzy(src, F.col("name"), dim)
        b = lookups.match_payer_fuzzy(src, F.col("name"), dim, max_rows=0)
        assert sorted(tuple(r) for r in a.collect()) == sorted(tuple(r) for r in b.collect())


def test_d6_clean_kvnr_option(spark):
    df = spark.createDataFrame([(0, "AO23456789")], "_row long, v string")
    layout = {"kvnr": "VARCHAR(40)"}
    spec = MappingSpec(layout, {"kvnr": "v"}, {})
    assert mapping.project_to_schema(df, spec).first().kvnr == "AO23456789"
    assert mapping.project_to_schema(df, spec, clean_kvnr=True).first().kvnr == "A023456789"


def test_infer_salutation_option(spark):
    df = spark.createDataFrame([(0, "Maria", None), (1, "Kim", None), (2, "Hans", "W")], "_row long, vn string, g string")
    spec = MappingSpec.for_layout("adressen", {"name2": "vn", "anrede": "g"}, {"anrede": Rule("gender")})
    got = [r.anrede for r in mapping.project_to_schema(df, spec, infer_salutation=True).orderBy("_row").collect()]
    assert got == ["Frau", None, "Frau"]
    assert [r.anrede for r in mapping.project_to_schema(df, spec).orderBy("_row").collect()] == [None, None, "Frau"]


@pytest.mark.parametrize("max_rows", [1_000_000, 0])
def test_lookups_with_colliding_column_names(spark, max_rows):
    pdim = lookups.postcode_dim_from_lines(_lines(spark, TestLookups.POSTCODES))
    kdim = lookups.payer_dim_from_lines(_lines(spark, TestLookups.PAYERS))
    src = spark.createDataFrame([(0, "1945", "berlin", "109519005", "x")],
                                "r int, postcode string, city_key string, ik string, name_key string")
    a = lookups.lookup_city_by_postcode(src, None, F.col("postcode"), pdim, "city", max_rows=max_rows)
    a = lookups.lookup_postcode_by_city(a, None, F.col("city_key"), pdim, "plz", max_rows=max_rows)
    a = lookups.lookup_payer_by_id(a, F.col("ik"), kdim, "kasse", max_rows=max_rows)
    a = lookups.lookup_id_by_payer(a, F.col("name_key"), kdim, max_rows=max_rows)
    r = a.first()
    assert a.columns[:5] == ["r", "postcode", "city_key", "ik", "name_key"]
    assert (r.postcode, r.city, r.plz, r.ik, r.kasse, r.match_ik) == ("1945", "Ruhland", "10115", "109519005",
                                                                      "AOK Nordost Neu", None)


def test_user_layout_with_dotted_targets(spark):
    df = spark.createDataFrame([(0, "15.8.85", "A123456780", "Dr. X")], "_row long, d string, k string, n string")
    layout = {"geb.datum": "VARCHAR(10)", "kv.nr": "VARCHAR(10)", "voll.name": "TEXT", "titel": "TEXT"}
    spec = MappingSpec(layout, {"geb.datum": "d", "kv.nr": "k", "voll.name": "n"},
                       {"kv.nr": Rule("validate_kvnr"), "geb.datum": Rule("format_date")})
    r = mapping.project_to_schema(df, spec, split_titles=True).first()
    assert (r["geb.datum"], r["kv.nr"], r["voll.name"], r["titel"]) == ("1985-08-15", "A123456780", "X", "Dr.")


def test_salted_join_by_row_key(spark):
    from fieldmill.operators.joins import lookup_join
    fact = spark.range(0, 3000, 1, 6).select(F.col("id").alias("_row"),
                                             F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.lit("c")).alias("k"))
    dim = spark.createDataFrame([("HOT", "h"), ("c", "v")], "key string, val string")
    a = sorted(tuple(r) for r in lookup_join(fact, dim, F.col("k"), "key").collect())
    b = sorted(tuple(r) for r in lookup_join(fact, dim, F.col("k"), "key", max_rows=0, salts=8).collect())
    assert a == b and len(b) == 3000


def _lev(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


@pytest.mark.parametrize("cutoff,fuzzy", [(0.0, True), (0.3, True), (0.6, False), (0.75, True), (0.97, True)])
def test_fuzzy_any_cutoff_equals_all_pairs(spark, cutoff, fuzzy):
    import random
    rnd = random.Random(5)

    def text():
        return " ".join("".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 3)))

    def sim(a, b):
        return 1.0 - _lev(a, b) / max(len(a), len(b))

    names = sorted({text() for _ in range(40)})
    probes = sorted({text() for _ in range(60)} - set(names))
    dim = spark.createDataFrame([(i, str(100000000 + i), n) for i, n in enumerate(names)],
                                "line long, ik string, name string")
    src = spark.createDataFrame([(p,) for p in probes], "n string")
    got = {r.n: (r.match_name, round(r.match_score, 9))
           for r in lookups.match_payer_fuzzy(src, F.col("n"), dim, cutoff=cutoff, fuzzy=fuzzy).collect()}
    for p in probes:
        best = (0.0, None)
        for n in names:
            score = sim(p, n)
            if fuzzy:
                score = max(score, 0.95 * sim(" ".join(sorted(p.split())), " ".join(sorted(n.split()))))
            if score >= cutoff and (best[1] is None or score > best[0]):
                best = (score, n)
        assert got[p] == (best[1], round(best[0] if fuzzy or best[1] is None else cutoff, 9))


def test_fuzzy_candidates_below_all_pairs(spark):
    """Names that share most bigrams: no more rows than pairs of fitting length and form."""
    names = spark.createDataFrame([(f"Brand#{i:02d} STANDARD TIN", i) for i in range(90)], "name string, line long")
    queries = spark.createDataFrame([(f"brand#{i:02d} standard tinx",) for i in range(50)], "_q string")
    assert 0 < lookups.fuzzy_candidates(queries, names, 0.9).count() <= 2 * 50 * 90


def test_hot_and_missing_keys_without_broadcast(spark):
    """A hot key, repeated rows and a third of rows without key: same rows as
    the broadcast join, and only the hot key is split."""
    from fieldmill.operators.joins import hot_keys, lookup_join
    n = F.col("id") % 3
    for keep in (["_row", "k"], ["k"]):
        fact = spark.range(0, 3000, 1, 6).select(F.col("id").alias("_row"), F.when(n == 0, F.lit("HOT")).when(
            n == 1, (F.col("id") % 50).cast("string")).alias("k")).select(*keep)
        dim = spark.createDataFrame([("HOT", "h")] + [(str(i), f"v{i}") for i in range(40)], "key string, val string")
        a = [tuple(r) for r in lookup_join(fact, dim, F.col("k"), "key").collect()]
        b = [tuple(r) for r in lookup_join(fact, dim, F.col("k"), "key", max_rows=0, hot_rows=100).collect()]
        assert sorted(a, key=str) == sorted(b, key=str) and len(b) == 3000
        assert [r["_hk"] for r in hot_keys(fact, "k", 100).collect()] == ["HOT"]


class TestDates:
    """D5 (month-first option) and the report of dates that stay as they are."""

    TEXTS = ["01.02.1985", "15.08.1985", "1.2.85", "3/4/1999", "1985-02-31", "abc", "20.13.2020", " ", None, "1999/3/4",
             "00.01.2000", "12.12.69 10:30"]

    def _rows(self, spark):
        return spark.createDataFrame([(i, t) for i, t in enumerate(self.TEXTS)], "_row long, d string")

    @pytest.mark.parametrize("day_first", [True, False])
    def test_both_forms_agree(self, spark, day_first):
        from fieldmill.functions import dates
        src = self._rows(spark)
        out = dates.with_format_date(src, F.col("d"), "a", day_first=day_first) \
            .withColumn("b", dates.format_date("d", day_first=day_first)).orderBy("_row").collect()
        assert [r.a for r in out] == [r.b for r in out]
        want = ["1985-02-01", "1985-08-15", "1985-02-01"] if day_first else ["1985-01-02", "1985-08-15", "1985-01-02"]
        assert [r.a for r in out][:3] == want

    def test_report_and_export(self, spark):
        from fieldmill.plans import twophase
        src = self._rows(spark)
        job = twophase.Job(src, MappingSpec.for_layout("patienten", {"p_birth": "d"}, {}), clean_strings=False)
        a = twophase.phase_a(job)
        assert sorted(r.original_val for r in a["dates"].collect()) == ["00.01.2000", "1985-02-31", "20.13.2020", "abc"]
        assert a["invalid"].count() == 0 and a["invalid"].columns[0] == "row_idx"  # nothing to check: an empty table
        first = twophase.phase_b(twophase.Job(src, job.spec, clean_strings=False, day_first=False))["mapped"]
        assert first.where("_row = 0").first().p_birth == "1985-01-02"


def test_value_ids_apart_from_row_ids(spark):
    from fieldmill.functions import keys
    from fieldmill.operators.extras import ExtraField, property_values
    src = spark.range(50).select(F.col("id").alias("_row"), F.lit("x").alias("a"), F.lit("y").alias("b"))
    rows = {r[0] for r in src.select(keys.generate_uid("_row", 1_700_000_000_000)).collect()}
    values = [r.id for r in property_values(src, [ExtraField("a"), ExtraField("b")], base_ms=1_700_000_000_000).collect()]
    assert len(set(values)) == 100 and not rows & set(values)


def test_empty_default_is_written_empty(spark, tmpdir_new):
    """The export leaves an empty constant empty; nulls are written as NULL."""
    from fieldmill.plans import twophase
    df = spark.createDataFrame([(0, "1", "", None, "z")], "_row long, a string, b string, c string, rest string").coalesce(1)
    paths = twophase.export({"mapped": df.select("_row", "a", "b", "c"), "rest": df.select("_row", "rest")},
                            tmpdir_new, "x.csv")
    assert [r.value for r in spark.read.text(paths["mapped"]).collect()] == ["a;b;c", "1;;NULL"]


def test_running_sum_over_levels(spark):
    """with_start in three levels (fan 7) equals a plain running sum."""
    from fieldmill.operators.prefix import with_start
    rows = [(f"f{i % 5}", i, (i * 37) % 11) for i in range(400)]
    df = spark.createDataFrame(rows, "f string, k long, n long").repartition(6)
    got = {(r.f, r.k): r._start for r in with_start(df, ["f", "k"], "n", fan=7).collect()}
    want, running = {}, 0
    for f, k, n in sorted(rows):
        want[f, k] = running
        running += n
    assert got == want
    assert with_start(df.where("false"), ["f", "k"], "n").count() == 0


def test_row_index_over_many_partitions(spark):
    df = spark.range(0, 5000, numPartitions=60).selectExpr("id * 7919 % 5000 AS k")
    out = with_row_index(df, order_by=["k"], fan=8).collect()
    assert sorted((r.k, r._row) for r in out) == [(i, i) for i in range(5000)]


def _similar_names(seed, n):
    import random
    rnd = random.Random(seed)
    words = ["AOK", "BKK", "Die", "Plus", "Gesundheit", "Kasse", "Nord", "Süd-West", "Ersatz", "der", "Ärzte", "KK", "x"]
    out = []
    for _ in range(n):
        w = [rnd.choice(words) for _ in range(rnd.choice([1, 1, 2, 3, 6, 14]))]
        text = rnd.choice([" ", "  "]).join(w)
        for _ in range(rnd.choice([0, 0, 1, 3])):
            at = rnd.randrange(len(text))
            text = text[:at] + rnd.choice("aäKz ") + text[at + rnd.randint(0, 2):]
        out.append(text.strip() or "AOK")
    return out


@pytest.mark.parametrize("scorer", ["weighted", "blocks"])
@pytest.mark.parametrize("cutoff", [0.0, 0.4, 0.6, 0.8, 0.97])
def test_similar_names_equal_all_pairs(spark, scorer, cutoff):
    """Both scorers give what scoring all pairs gives; blocks also what the
    standard library's close matches are."""
    import difflib

    from fieldmill.operators import similar
    names, asked = list(dict.fromkeys(_similar_names(1, 60))), _similar_names(2, 40) + [None, " ", " die kasse ", "zzz", "A"]
    dim = spark.createDataFrame([(i, f"{i:09d}", x) for i, x in enumerate(names)], "line long, ik string, name string")
    src = spark.createDataFrame(list(enumerate(asked)), "p long, n string")
    got = {r.p: (r.match_name, round(r.match_score, 9)) for r in
           similar.match_payer_similar(src, F.col("n"), dim, cutoff=cutoff, scorer=scorer).collect()}
    exact = {x.lower(): x for x in names}
    for p, text in enumerate(asked):
        text = (text or "").strip()
        if not text:
            want = (None, 0.0)
        elif text.lower() in exact:
            want = (exact[text.lower()], 1.0)
        elif scorer == "blocks":
            best = difflib.get_close_matches(text, names, n=1, cutoff=cutoff)
            want = (best[0], cutoff) if best else (None, 0.0)
        else:
            best = max((similar.weighted(text, x), -i, x) for i, x in enumerate(names))
            want = (best[2], round(best[0], 9)) if best[0] >= cutoff else (None, 0.0)
        assert got[p] == want, text
    queries = src.where("trim(n) <> ''").selectExpr("trim(n) AS _q").distinct()
    pairs = similar.close_pairs(queries, dim.select("line", "name"), cutoff, scorer).count()
    assert pairs < queries.count() * len(names) or cutoff < 0.5
    wide = similar.match_payer_similar(src, F.col("n"), dim, cutoff=cutoff, scorer=scorer, max_rows=0) if cutoff == 0.6 else None
    assert wide is None or {r.p: (r.match_name, round(r.match_score, 9)) for r in wide.collect()} == got


def test_characters_in_common_are_bounded_on_bits(spark):
    """The join that meets every pair compares bits alone: its count is never
    below the characters in common, and is that count for plain short names."""
    from collections import Counter

    from fieldmill.operators import similar
    names = ["Nord AOK", "süd-west krankenkasse", "a" * 9, "Ärzte \U0001f600 Kasse", "zz1234567", "x", *_similar_names(7, 30)]
    asked = ["zz7654321", "aaaa aaaa aaa", "kasse ärzte \u2028 \U0001f600", "0 " * 30 + "9", *_similar_names(8, 30)]
    dim = spark.createDataFrame(list(enumerate(dict.fromkeys(names))), "line long, name string")
    queries = spark.createDataFrame([(x,) for x in dict.fromkeys(asked)], "_q string")
    for scorer in ("weighted", "blocks"):
        form = (lambda x: " ".join(x.lower().split())) if scorer == "weighted" else (lambda x: x)
        frame = similar.close_pairs(queries, dim, 0.0, scorer)
        rows = frame.collect()
        pairs = [(r._q, r.name) for r in rows]
        assert len(set(pairs)) == len(pairs) == len(set(names)) * len(set(asked))
        for r in rows:
            a, b = Counter(form(r._q)), Counter(form(r.name))
            exact = sum((a & b).values())
            assert exact <= r._o <= min(r._lq, r._ln)
            if all(c.isascii() and k <= similar.REPEATS for x in (a, b) for c, k in x.items()):
                assert r._o == exact, (r._q, r.name)
    plan = similar.close_pairs(queries, dim, 0.6, "blocks")._jdf.queryExecution().toString()
    assert "bit_count" in plan and "array_intersect" not in plan


def test_stretches_that_cannot_reach_are_not_searched(monkeypatch):
    """The whole texts' common subsequence bounds every stretch."""
    from fieldmill.operators import similar
    called = []
    monkeypatch.setattr(similar, "_stretch", lambda *x, f=similar._stretch: called.append(x) or f(*x))
    assert similar.weighted("zz654321", "brand#12 large stadt34 weg", 0.6) < 0.6 and not called
    assert similar.weighted("zz123456", "weg 12 brand 3456 stadt", 0.6) >= 0.6 - 1e-9 and called


def test_common_subsequence_and_views():
    """The bit-parallel length equals the table's; the views by hand."""
    import random

    from fieldmill.operators.similar import _common, _stretch, weighted
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randrange(12))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [max(row[j + 1], 0) if x != y else row[j] + 1 for j, y in enumerate(b)]
            for j in range(len(b)):
                row[j + 1] = max(row[j + 1], row[j])
        assert _common(a, b) == row[-1]
    assert _stretch("bcd", "abcde") == 1.0 and _stretch("xyz", "abcde") == 0.0
    assert weighted("Nord AOK", "aok  nord") == 0.95  # sorted words
    def plainly(a, b):  # every view, by its definition
        from fieldmill.operators.similar import _ratio
        wa, wb = a.lower().split(), b.lower().split()
        a, b, sa, sb, both = " ".join(wa), " ".join(wb), " ".join(sorted(wa)), " ".join(sorted(wb)), sorted(set(wa) & set(wb))
        if not a or not b:
            return float(a == b)
        longer = max(len(a), len(b)) / min(len(a), len(b))
        if longer < 1.5:
            views = [" ".join(x) for x in (both, *([*both, *sorted(set(w) - set(both))] for w in (wa, wb)))] if both else []
            return max([_ratio(a, b), 0.95 * _ratio(sa, sb), *(0.95 * _ratio(x, y) for x, y in itertools.combinations(views, 2))])
        scale = 0.9 if longer < 8 else 0.6
        return max(_ratio(a, b), scale * _stretch(a, b), 0.95 * scale * (1.0 if both else _stretch(sa, sb)))

    some = _similar_names(5, 80)
    for a, b in itertools.product(some, some[:40]):
        value = plainly(a, b)
        assert weighted(a, b) == pytest.approx(value, abs=1e-12)
        assert weighted(a, b, value) == pytest.approx(value, abs=1e-12) and weighted(a, b, 0.7) >= value - 1e-9 or value < 0.7
    assert weighted("AOK", "aok") == 1.0 and weighted("", "a") == 0.0
    assert weighted("AOK", "AOK Plus Gesundheit") == pytest.approx(0.9)  # a stretch
    assert weighted("AOK Nord", "die ganz andere Kasse im hohen Nord") == pytest.approx(0.95 * 0.9)  # a shared word
