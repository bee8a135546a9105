"""Golden rows for the cleaning and derivation functions (FIXTURES.md §4)."""

from pyspark.sql import functions as F

from fieldmill.functions import text


class TestSanitize:
    def test_basic(self, apply1):
        assert apply1(text.sanitize_basic, [" a\tb\nc ", None, ""]) == ["abc", "", ""]

    def test_strict(self, apply1):
        out = apply1(text.sanitize_strict, [" Müller, Hans ", "100%", "²½", "O'Neil (jr.) a/b@c.d+e-f_g"])
        assert out == ["Müller Hans", "100", "²½", "O'Neil (jr.) a/b@c.d+e-f_g"]

    def test_d20_not_idempotent(self, apply1):
        # D20: trimming happens before deletions, so '! a' keeps its space
        assert apply1(text.sanitize_strict, ["! a"]) == [" a"]

    def test_unicode_trim(self, apply1):
        assert apply1(text.utrim, [" 　 x  ", "\x1ca\x1f"]) == ["x", "a"]


class TestStreetNumber:
    def test_split_street(self, apply1):
        vals = ["Auf den Hüllen", "Im Tiergarten 19", "Hauptstr.5", "12 Hof", None, "nan"]
        assert apply1(text.split_street, vals) == ["Auf den Hüllen", "Im Tiergarten", "Hauptstr.", "", None, None]

    def test_split_number(self, apply1):
        vals = ["Im Tiergarten 19", "Weg 2a", "Hauptstr. 12-14", "Auf den Hüllen"]
        assert apply1(text.split_number, vals) == ["19", "2a", "12-14", ""]

    def test_d11_precheck_differs_from_export(self, apply1):
        assert apply1(text.precheck_street, ["Hauptstr.5", "Straße des 17. Juni 135"]) == ["Hauptstr.5", "Straße des"]
        assert apply1(text.precheck_number, ["Hauptstr. 12-14", "Straße des 17. Juni 135"]) == ["14", "135"]
        assert apply1(text.split_number, ["Straße des 17. Juni 135"]) == ["17. Juni 135"]

    def test_d16_ascii_digits_only(self, apply1):
        assert apply1(text.split_number, ["Weg ٣"]) == [""]


class TestPostcode:
    def test_clean_postcode(self, apply1):
        assert apply1(text.clean_postcode, ["8033.0", "12345", "abc", None, "123456", " 37 "]) == \
            ["08033", "12345", "abc", None, "123456", "00037"]

    def test_d1_width_parameter(self, apply1):
        assert apply1(lambda c: text.clean_postcode(c, 8), ["8033.0"]) == ["00008033"]


class TestSalutation:
    def test_gender(self, apply1):
        assert apply1(text.gender_salutation, ["M", "W", "F", "x", " m ", "", "männlich", "2"]) == \
            ["Herr", "Frau", "Frau", "x", "Herr", None, "Herr", "Frau"]

    def test_infer(self, apply1):
        out = apply1(text.infer_salutation, ["Hans-Peter", "maria", "Kim", None])
        assert [(r.gender, r.salutation) for r in out] == [
            ("männlich", "Herr"), ("weiblich", "Frau"), ("unbekannt", ""), ("unbekannt", "")]


class TestTitles:
    def test_split_title(self, apply1):
        out = apply1(text.split_title, ["Dr. med. Anna Beispiel", "Prof. Dr. X", "dr.  Hans", "Anna"])
        assert [(r.title, r.name) for r in out] == [
            ("Dr. med.", "Anna Beispiel"), ("Prof. Dr.", "X"), ("Dr.", "Hans"), ("", "Anna")]

    def test_d10_title_only_untouched(self, apply1):
        out = apply1(text.split_title, ["Dr. med.", "PD"])
        assert [(r.title, r.name) for r in out] == [("", "Dr. med."), ("", "PD")]


class TestValues:
    def test_default_and_static(self, apply1):
        assert apply1(lambda c: text.default_value(c, "Unbekannt"), ["", None, "None", "nan", "x", "NULL"]) == \
            ["Unbekannt", "Unbekannt", "Unbekannt", "Unbekannt", "x", "NULL"]
        assert apply1(lambda c: text.static_value("AKTIV"), ["a", None]) == ["AKTIV", "AKTIV"]

    def test_fill_null(self, apply1):
        assert apply1(text.fill_null, [" ", None, "a"]) == [None, None, "a"]
        assert apply1(lambda c: text.fill_null(c, "NULL"), [" ", "a"]) == ["NULL", "a"]

    def test_d6_clean_insurance_o_keeps_first_letter(self, apply1):
        assert apply1(text.clean_insurance_o, ["o1O2O", " OO "]) == ["O1020", "O0"]

    def test_merge(self, apply1):
        out = apply1(lambda c: text.merge_columns(c, F.lit("4")), ["Musterstr.", None])
        assert out == ["Musterstr. 4", "4"]

    def test_clean_by_kind(self):
        assert text.clean_kind("p_email") == "email"
        assert text.clean_kind("p_ort") == "city"
        assert text.clean_kind("name1") == "name"
        assert text.clean_kind("telefon") == "general"
