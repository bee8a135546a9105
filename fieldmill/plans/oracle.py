"""DuckDB SQL fragments used by the correctness oracles.

Each function returns SQL text for one rule, written independently of the
Spark expressions (RE2 regex, DuckDB functions), so the driver's
side-by-side check compares two implementations of the same semantics.
SQL string literals keep backslashes as they are, so the regex escapes
below reach RE2 unchanged.
"""

from __future__ import annotations

import re

WS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
CONTROL = r"[\x00-\x1F\x7F-\x9F]"
STRICT_DROP = r"[^\p{L}\p{N}_\t\n\x0B\f\r\p{Z}&''`´’()/@.+\-]"   # quote doubled for SQL


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def utrim(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def blank(x: str) -> str:
    return f"({x} IS NULL OR {utrim(x)} = '')"


def empty_token(x: str, tokens=("nan", "null", "none", ""), trim=True, lower=True) -> str:
    v = utrim(x) if trim else x
    v = f"lower({v})" if lower else v
    return f"({x} IS NULL OR {v} IN ({', '.join(q(t) for t in tokens)}))"


def basic(x: str) -> str:
    return f"regexp_replace({utrim(f'coalesce({x}, {q("")})')}, '{CONTROL}', '', 'g')"


def strict(x: str) -> str:
    return f"regexp_replace({basic(x)}, '{STRICT_DROP}', '', 'g')"


def pad(x: str, w: int = 5) -> str:
    return f"(CASE WHEN length({x}) < {w} THEN lpad({x}, {w}, '0') ELSE {x} END)"


def clean_postcode(x: str, w: int = 5) -> str:
    v = f"regexp_replace({utrim(x)}, '\\.0$', '')"
    return (f"(CASE WHEN {empty_token(x)} THEN NULL WHEN regexp_matches({v}, '^[0-9]{{1,{w}}}$') "
            f"THEN lpad({v}, {w}, '0') ELSE {v} END)")


def digit(s: str, pos: int) -> str:
    return f"(ascii(substr({s}, {pos}, 1)) - 48)"


def cross(d: str, w: int) -> str:
    return f"(CASE WHEN {d} * {w} >= 10 THEN {d} * {w} - 9 ELSE {d} * {w} END)"


def ik_clean(x: str) -> str:
    s = f"split_part({utrim(x)}, '.', 1)"
    return pad(s, 9)


def ik_ok(s: str) -> str:
    total = " + ".join(cross(digit(s, 3 + i), w) for i, w in enumerate([2, 1, 2, 1, 2, 1]))
    return f"coalesce(regexp_matches({s}, '^[0-9]{{9}}$') AND (({total}) % 10 = {digit(s, 9)}), false)"


def kvnr_ok(s: str) -> str:
    code = f"(ascii(substr({s}, 1, 1)) - 64)"
    ds = [f"({code} // 10)", f"({code} % 10)"] + [digit(s, p) for p in range(2, 10)]
    total = " + ".join(cross(d, w) for d, w in zip(ds, [1, 2] * 5))
    return f"coalesce(regexp_matches({s}, '^[A-Z][0-9]{{9}}$') AND (({total}) % 10 = {digit(s, 10)}), false)"


def kvnr_clean(x: str) -> str:
    return f"upper({utrim(x)})"


def kvnr_candidate(v: str) -> str:
    return (f"(CASE WHEN length({v}) = 10 AND regexp_matches({v}, '^[A-Z]O') "
            f"THEN substr({v}, 1, 1) || '0' || substr({v}, 3, 8) "
            f"WHEN length({v}) = 10 AND regexp_matches({v}, '^[01)(=/][0-9]{{9}}$') "
            f"THEN translate(substr({v}, 1, 1), '01)(=/', 'OIOIPU') || substr({v}, 2, 9) END)")


def kvnr_fixed(v: str) -> str:
    c = kvnr_candidate(v)
    return f"coalesce({c} IS NOT NULL AND {kvnr_ok(c)}, false)"


def kvnr_value(v: str) -> str:
    return f"(CASE WHEN {kvnr_fixed(v)} THEN {kvnr_candidate(v)} ELSE {v} END)"


_ATOM = r"[\p{L}\p{N}!#$%&''*+/=?^_`{|}~\-]+"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
EMAIL = rf"^{_ATOM}(?:\.{_ATOM})*@{_LABEL}(?:\.{_LABEL})+$"


def email_ok(x: str) -> str:
    s = utrim(x)
    dom = f"split_part({s}, '@', -1)"
    return (f"coalesce(regexp_matches({s}, '{EMAIL}') AND length({s}) <= 254 "
            f"AND length(split_part({s}, '@', 1)) <= 64 AND NOT regexp_matches({dom}, '\\.[0-9]+$') "
            f"AND NOT regexp_matches({dom}, '[^.]{{64,}}'), false)")


def split_street(x: str) -> str:
    return (f"(CASE WHEN {empty_token(x, trim=False)} THEN NULL ELSE "
            f"{utrim(f'regexp_replace({x}, {q(f"(?s){WS}*[0-9]+.*$")}, {q("")})')} END)")


def split_number(x: str) -> str:
    return (f"(CASE WHEN {empty_token(x, trim=False)} THEN NULL ELSE "
            f"{utrim(f'regexp_extract({x}, {q("(?s)[0-9].*$")}, 0)')} END)")


def precheck_street(x: str) -> str:
    v = utrim(x)
    pat = q(f"(?s)^(.*?){WS}+[0-9]")
    return f"(CASE WHEN regexp_matches({v}, {pat}) THEN {utrim(f'regexp_extract({v}, {pat}, 1)')} ELSE {v} END)"


def precheck_number(x: str) -> str:
    v = utrim(x)
    return utrim(f"regexp_extract({v}, {q(f'([0-9]+{WS}*[a-zA-Z/\\-]*)$')}, 1)")


TITLES = ["Prof. Dr. med. dent.", "Prof. Dr. med.", "PD Dr. med.", "Prof. Dr.",
          "Dr. med. dent.", "Dr. med.", "Dr. rer. nat.", "Dr.", "Prof.", "PD"]


def _title_pat(t: str) -> str:
    return q("(?i)^" + re.escape(t) + WS + "+")


def title_of(x: str) -> str:
    v = utrim(x)
    only = f"lower({v}) IN ({', '.join(q(t.lower()) for t in TITLES)})"
    arms = " ".join(f"WHEN regexp_matches({v}, {_title_pat(t)}) THEN {q(t)}" for t in TITLES)
    return f"(CASE WHEN {only} THEN '' {arms} ELSE '' END)"


def title_rest(x: str) -> str:
    v = utrim(x)
    only = f"lower({v}) IN ({', '.join(q(t.lower()) for t in TITLES)})"
    arms = " ".join(
        f"WHEN regexp_matches({v}, {_title_pat(t)}) THEN {utrim(f'regexp_replace({v}, {_title_pat(t)}, {q('')})')}"
        for t in TITLES)
    return f"(CASE WHEN {only} THEN {v} {arms} ELSE {v} END)"


def gender(x: str) -> str:
    v = utrim(x)
    herr = ["M", "m", "HERR", "Herr", "männlich", "1"]
    frau = ["W", "w", "FRAU", "Frau", "weiblich", "F", "f", "2"]
    return (f"(CASE WHEN {v} IS NULL OR {v} = '' THEN NULL WHEN {v} IN ({', '.join(map(q, herr))}) THEN 'Herr' "
            f"WHEN {v} IN ({', '.join(map(q, frau))}) THEN 'Frau' ELSE {v} END)")


MALE = ["hans", "peter", "christian", "thomas", "sebastian", "stefan", "alexander", "michael"]
FEMALE = ["sabine", "amira", "sarah", "elena", "maria", "lisa", "monika", "julia"]


def first_name_key(x: str) -> str:
    return f"split_part(lower({utrim(f'coalesce({x}, {q("")})')}), '-', 1)"


_TIME = r"(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?"
DOT4 = rf"^([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}}){_TIME}$"
DOT2 = rf"^([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{2}}){_TIME}$"
YSLASH = rf"^([0-9]{{4}})/([0-9]{{1,2}})/([0-9]{{1,2}}){_TIME}$"
YDASH = rf"^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}}){_TIME}$"
COMPACT = rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}}){_TIME}$"
USLASH = rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}){_TIME}$"


def _n(v, pat, i):
    return f"try_cast(regexp_extract({v}, {q(pat)}, {i}) AS INTEGER)"


def format_date(x: str) -> str:
    v = utrim(x)
    m = lambda p: f"regexp_matches({v}, {q(p)})"
    y = (f"(CASE WHEN {m(DOT4)} THEN {_n(v, DOT4, 3)} "
         f"WHEN {m(DOT2)} THEN (CASE WHEN {_n(v, DOT2, 3)} >= 69 THEN {_n(v, DOT2, 3)} + 1900 ELSE {_n(v, DOT2, 3)} + 2000 END) "
         f"WHEN {m(YSLASH)} THEN {_n(v, YSLASH, 1)} WHEN {m(YDASH)} THEN {_n(v, YDASH, 1)} "
         f"WHEN {m(COMPACT)} THEN {_n(v, COMPACT, 1)} WHEN {m(USLASH)} THEN {_n(v, USLASH, 3)} END)")
    a, b = _n(v, USLASH, 1), _n(v, USLASH, 2)
    mo = (f"(CASE WHEN {m(DOT4)} THEN {_n(v, DOT4, 2)} WHEN {m(DOT2)} THEN {_n(v, DOT2, 2)} "
          f"WHEN {m(YSLASH)} THEN {_n(v, YSLASH, 2)} WHEN {m(YDASH)} THEN {_n(v, YDASH, 2)} "
          f"WHEN {m(COMPACT)} THEN {_n(v, COMPACT, 2)} WHEN {m(USLASH)} THEN (CASE WHEN {a} > 12 THEN {b} ELSE {a} END) END)")
    d = (f"(CASE WHEN {m(DOT4)} THEN {_n(v, DOT4, 1)} WHEN {m(DOT2)} THEN {_n(v, DOT2, 1)} "
         f"WHEN {m(YSLASH)} THEN {_n(v, YSLASH, 3)} WHEN {m(YDASH)} THEN {_n(v, YDASH, 3)} "
         f"WHEN {m(COMPACT)} THEN {_n(v, COMPACT, 3)} WHEN {m(USLASH)} THEN (CASE WHEN {a} > 12 THEN {a} ELSE {b} END) END)")
    iso = f"(lpad(CAST({y} AS VARCHAR), 4, '0') || '-' || lpad(CAST({mo} AS VARCHAR), 2, '0') || '-' || lpad(CAST({d} AS VARCHAR), 2, '0'))"
    return (f"(CASE WHEN {empty_token(x)} THEN NULL WHEN regexp_matches({v}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN {v} "
            f"WHEN {y} IS NOT NULL AND try_strptime({iso}, '%Y-%m-%d') IS NOT NULL THEN {iso} ELSE {v} END)")


def spelled_date(x: str) -> str:
    """Spelled dates by list: German month names become English ones and the
    day's name is cut, then the first of these formats that fits decides."""
    words = [("Januar", "January"), ("Februar", "February"), ("März", "March"), ("Mai", "May"), ("Juni", "June"),
             ("Juli", "July"), ("Oktober", "October"), ("Dezember", "December")]
    v = f"regexp_replace({utrim(x)}, '^[A-Za-z]+day, ', '')"
    for german, english in words:
        v = f"regexp_replace({v}, '\\b{german}\\b', '{english}')"
    v = f"regexp_replace({v}, ' [0-9]+:[0-9]+ Uhr$', '')"
    # two-digit years first: %Y would read 95 as the year 95
    formats = ["%d. %b %y", "%d. %B %Y", "%B %d, %Y", "%d-%b-%Y", "%d %B %Y", "%d-%m-%Y", "%Y.%m.%d"]
    tries = ", ".join(f"try_strptime({v}, '{f}')" for f in formats)
    return f"coalesce(strftime(coalesce({tries}), '%Y-%m-%d'), {utrim(x)})"


def seq6(row: str) -> str:
    return f"printf('%06d', ({row}) + 1)"
