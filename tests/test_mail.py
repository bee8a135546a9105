"""Internationalised domains against the standard library's coding; quoted local parts."""

import random

from fieldmill.functions import checks, mail


def _wire(domain):
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in domain.lower().split("."))


def test_ascii_domain_equals_the_standard_library(apply1):
    rnd = random.Random(5)
    alphabets = ["aäb", "abcdeföüß-09", "日本語ドメイン名", "αβγδ", "абвгд", "aé日𐍈😀ж", "ไทยa", "ü"]
    labels = ["".join(rnd.choice(a) for _ in range(rnd.choice([1, 2, 5, 12, 30, 62, 63]))) for a in alphabets for _ in range(25)]
    domains = [f"{x}.{rnd.choice(labels)}.de" for x in labels]
    assert apply1(mail.ascii_domain, domains) == [_wire(d) for d in domains]


def test_golden_domains(apply1):
    got = apply1(mail.ascii_domain, ["müller.de", "BÜCHER.example", "straße.de", "例え。テスト", "plain.org", "", None, "ü" * 64])
    assert got == ["xn--mller-kva.de", "xn--bcher-kva.example", "xn--strae-oqa.de", "xn--r8jz45g.xn--zckzah", "plain.org",
                   "", None, "ü" * 64]


def test_email_ascii(apply1):
    valid = {"a@müller.de": "a@xn--mller-kva.de", " a.b+c@x.de ": "a.b+c@x.de", "jörg@bücher.de": "jörg@xn--bcher-kva.de",
             "A@B.DE": "A@b.de", "x@例え。テスト": "x@xn--r8jz45g.xn--zckzah", "u@" + "ü" * 50 + ".de": "u@" + _wire("ü" * 50) + ".de"}
    wide = "".join(chr(0x4E00 + 97 * i) for i in range(40))
    invalid = [None, "", "a@b", "a@-ü.de", "a@ü-.de", "a@ü..de", "a@b@ü.de", "ä" * 33 + "@x.de", "@ü.de", "a@ü.1",
               f"a@{wide}.de", "a@" + "ü" * 64 + ".de", '"a b"@x.de', "a b@x.de", "a@ü .de", ".a@ü.de",
               "a@" + ".".join(["bücher"] * 40)]
    assert len(_wire(wide)) > 63
    assert apply1(mail.email_ascii, [*valid, *invalid]) == [*valid.values(), *[None] * len(invalid)]


def test_quoted_local_parts(apply1):
    vals = ['"a b"@x.de', '"a@b"@ü.de', r'"a\"b"@x.de', '"a"b"@x.de', '"a\\"@x.de', '"ä"@x.de', 'a"b"@x.de', '"' + "a" * 63 + '"@x.de']
    assert apply1(lambda c: mail.email_ascii(c, quoted=True), vals) == \
        ['"a b"@x.de', '"a@b"@xn--tda.de', r'"a\"b"@x.de', None, None, None, None, None]


def test_plain_addresses_as_the_default_rule(apply1):
    vals = ["a@b.de", "a@b", "user@domain", "a..b@x.de", "a@x.d-e", "a@x.123", "o'neil@x.co.uk", "a@b.de.", "a@@b.de"]
    assert [x is not None for x in apply1(mail.email_ascii, vals)] == apply1(checks.validate_email, vals)
