"""End to end: small CSV -> findings -> decisions -> export, field by field;
and the stateless rules on a stream equal the batch result."""

import os


from fieldmill.operators import lookups
from fieldmill.operators.extras import ExtraField
from fieldmill.operators.rowid import with_row_index
from fieldmill.plans import twophase
from fieldmill.plans.spec import MappingSpec, Rule
from fieldmill.sources import delimited
from fieldmill.streaming import rules_stream

HEADER = "id;titel;vorname;nachname;geschlecht;geburtsdatum;strasse;plz;wohnort;telefon1;handy;email;kas_ik;versichertennummer;status;notiz"
ROWS = [
    "1;;Hans;Dr. med. Müller;M;15.08.1985;Hauptstr. 12-14;8033.0;;0301;0170;h@x.de;109519005;A123456780;1;n1",
    "2;;maria;Schmidt!;w;1985/08/15;Im Tiergarten 19;;Berlin;;;user@domain;123456789;JO12345677;2;",
    "3;;Kim;Lee;x;abc;Auf den Hüllen;10115;;;;;99;O123456789;3;n3",
]


def _csv(tmp):
    p = os.path.join(tmp, "patienten.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write("\n".join([HEADER] + ROWS) + "\n")
    return p


def _job(spark, tmp):
    src = with_row_index(delimited.read_delimited(spark, _csv(tmp)))
    spec = twophase.auto_spec(src, "patienten")
    lines = spark.createDataFrame([(0, "DE 10115 Berlin"), (1, "DE 08033 Zwickau")], "line long, value string")
    payers = spark.createDataFrame([(0, "109519005 AOK Nordost 14467 Potsdam")], "line long, value string")
    return twophase.Job(src, spec, lookups.postcode_dim_from_lines(lines), lookups.payer_dim_from_lines(payers),
                        split_titles=True, extra_fields=[ExtraField("notiz", "Notiz")]), spec


def test_auto_mapping(spark, tmpdir_new):
    _, spec = _job(spark, tmpdir_new)
    s = spec.sources
    assert s["p_vname"] == "vorname" and s["p_name"] == "nachname" and s["p_ort"] == "wohnort"
    assert s["p_birth"] == "geburtsdatum" and s["p_anrede"] == "geschlecht" and s["p_ik"] == "kas_ik"
    assert s["p_vnr"] == "versichertennummer" and s["p_nr"] == "id" and s["p_handy"] == "handy"
    assert s["p_tel"] == "telefon1" and s["p_street"] == "strasse" and s["p_vs"] == "status"
    assert spec.rule("p_plz") == Rule("lookup_plz_by_city", "wohnort")
    assert spec.rule("p_krankenkasse") == Rule("lookup_ik_provider", "kas_ik")


def test_phase_a_then_b(spark, tmpdir_new):
    job, _ = _job(spark, tmpdir_new)
    a = twophase.phase_a(job)
    flagged = {r["__quell_zeile"]: r["__gefundene_fehler"] for r in a["flagged"].collect()}
    assert "Ungültige IK in 'kas_ik' (123456789)" in flagged[3]
    assert "KVNR in 'versichertennummer' korrigiert: (JO12345677 -> J012345677)" in flagged[3]
    invalid = sorted((r.row_idx, r.target_col, r.issue) for r in a["invalid"].collect())
    assert invalid == [(1, "p_email", "invalid"), (1, "p_ik", "invalid"), (1, "p_vnr", "repaired"),
                       (2, "p_vnr", "invalid")]
    assert {r.col_name for r in a["cleanup"].collect()} >= {"nachname"}
    decisions = twophase.decisions_from_findings(a["invalid"], "keep")
    b = twophase.phase_b(job, invalid_decisions=decisions)
    m = {r._row: r for r in b["mapped"].collect()}
    r0, r1, r2 = m[0], m[1], m[2]
    assert r0.p_name == "Müller" and r0.p_vname == "Hans" and r0.p_anrede == "Herr"
    # own postcode wins unstripped on the lookup path (D1), so the city lookup misses
    assert r0.p_birth == "1985-08-15" and r0.p_plz == "8033.0" and r0.p_ort is None
    assert r0.p_street == "Hauptstr." and r0.p_hausnummer == "12-14" and r0.p_krankenkasse == "AOK Nordost"
    assert r0.p_nr == "1" and r0.p_tel == "0301" and r0.p_handy == "0170" and r0.p_ik == "109519005"
    assert r1.p_name == "Schmidt" and r1.p_anrede == "Frau" and r1.p_plz == "10115" and r1.p_ort == "Berlin"
    assert r1.p_ik == "123456789" and r1.p_email == "user@domain"     # kept by decision (D3)
    assert r1.p_vnr == "J012345677"                                    # repaired (D2)
    assert r2.p_birth == "abc" and r2.p_ik == "000000099" and r2.p_vnr == "O123456789"
    assert [c for c in b["mapped"].columns if c != "_row"] == list(job.spec.layout)
    assert b["rest"].columns == ["_row", "titel", "notiz"]
    vals = {(r.property_id, r.content) for r in b["property_values"].collect()}
    assert vals == {("#Notiz", "n1"), ("#Notiz", "n3")}
    paths = twophase.export(b, os.path.join(tmpdir_new, "out"), "patienten.csv")
    back = delimited.read_delimited(spark, paths["mapped"]).collect()
    assert len(back) == 3 and {r.p_nr for r in back} == {"1", "2", "3"}
    fpaths = twophase.write_findings(a, os.path.join(tmpdir_new, "findings"))
    assert os.path.basename(fpaths["flagged"]) == "geflaggte_datensaetze_kontrolle.csv"


def test_stream_equals_batch(spark, tmpdir_new):
    src_dir = os.path.join(tmpdir_new, "in")
    os.makedirs(src_dir)
    _csv(src_dir)
    cols = HEADER.split(";")
    spec = MappingSpec.for_layout("patienten",
                                  {"p_name": "nachname", "p_vnr": "versichertennummer", "p_birth": "geburtsdatum",
                                   "p_plz": "plz", "p_ik": "kas_ik", "p_nr": "id"},
                                  {"p_vnr": Rule("validate_kvnr"), "p_plz": Rule("clean_plz"),
                                   "p_ik": Rule("validate_ik"), "p_vs": Rule("static_value", "A")})
    spec.sources["p_ort"] = "wohnort"
    spec.rules["p_ort"] = Rule("lookup_city_by_plz", "plz")   # a stream-static dimension join
    dim = lookups.postcode_dim_from_lines(spark.createDataFrame([(0, "DE 08033 Zwickau"), (1, "DE 10115 Berlin")],
                                                                "line long, value string"))
    stream = rules_stream.read_delimited_stream(spark, src_dir, cols)
    out = os.path.join(tmpdir_new, "out")
    rules_stream.run_available_now(rules_stream.project_stream(stream, spec, postcode_dim=dim, key_col="id"), out, "t1")
    got = sorted(tuple(r) for r in spark.read.parquet(out).drop("_key").collect())
    batch = with_row_index(delimited.read_delimited(spark, src_dir))
    from fieldmill.operators import mapping
    want = sorted(tuple(r) for r in mapping.project_to_schema(batch, spec, postcode_dim=dim).drop("_row").collect())
    assert got == want and len(got) == 3
    assert sorted(str(r.p_ort) for r in spark.read.parquet(out).collect()) == ["Berlin", "Berlin", "None"]


def test_dotted_and_spaced_headers(spark, tmpdir_new):
    """Real headers such as 'Geb.Datum' or 'Str. Nr' are literal names, not paths."""
    from fieldmill.operators import findings, mapping
    from fieldmill.operators.findings import Checked
    from fieldmill.sources import sinks
    p = os.path.join(tmpdir_new, "dots.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("Pat.Nr;Geb.Datum;Str. Nr;Notiz `x`\n7;15.8.85;Weg 2a;a\n8;abc;Hof;b\n")
    src = with_row_index(delimited.read_delimited(spark, p))
    spec = MappingSpec.for_layout("patienten", {"p_nr": "Pat.Nr", "p_birth": "Geb.Datum", "p_hausnummer": "Str. Nr"},
                                  {"p_hausnummer": Rule("split_number")})
    out = mapping.project_to_schema(src, spec).orderBy("_row").collect()
    assert [(r.p_nr, r.p_birth, r.p_hausnummer) for r in out] == [("7", "1985-08-15", "2a"), ("8", "abc", None)]
    flags = findings.flag_records(src, [Checked("Str. Nr", "p_hausnummer", 1, "split_number")]).collect()
    assert flags[0]["Geb.Datum"] == "15.8.85"
    rest = mapping.rest_table(src, spec)
    assert rest.columns == ["_row", "Notiz `x`"]
    path = sinks.write_rest(rest, tmpdir_new, "dots.csv")
    assert [tuple(r) for r in delimited.read_delimited(spark, path).collect()] != []
