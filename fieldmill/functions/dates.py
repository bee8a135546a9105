"""Date text -> ISO ``YYYY-MM-DD`` with native expressions.

Accepted shapes (optional ``[ T]hh:mm[:ss[.f]]`` suffix is cut first):
``d.M.yyyy`` and ``d.M.yy`` (day first), ``yyyy/M/d``, ``yyyy-M-d``,
``yyyyMMdd`` and ``M/d/yyyy`` (month first unless the first number exceeds
12).  Other text goes through the grammar of ``datewords.py`` (month names,
weekdays, zones, other separators).  Two-digit years pivot at 69: 69-99 ->
19xx, 00-68 -> 20xx.  Text that is already ``dddd-dd-dd`` is returned unchanged; unparsable text is returned
trimmed; empties become null (or the fallback).  ``day_first=False`` reads
dotted dates month first unless the first number exceeds 12.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.functions import datewords
from fieldmill.functions.text import col_of, is_empty_token, qcol, utrim

_T = r"(?:[ T][0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]+)?)?)?"
ISO = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"
# Shape codes by the text's digit signature (every digit written as 9).
DOT4_C, DOT2_C, YSLASH_C, YDASH_C, COMPACT_C, USLASH_C = 1, 2, 3, 4, 5, 6
_DATE_SIG = r"^([9./\-]+)(?:[ T]9{1,2}:99(?::99(?:\.9+)?)?)?$"


def _signatures() -> dict[str, int]:
    out = {}
    for a in ("9", "99"):
        for b in ("9", "99"):
            out[f"{a}.{b}.9999"] = DOT4_C
            out[f"{a}.{b}.99"] = DOT2_C
            out[f"9999/{a}/{b}"] = YSLASH_C
            out[f"9999-{a}-{b}"] = YDASH_C
            out[f"{a}/{b}/9999"] = USLASH_C
    out["99999999"] = COMPACT_C
    return out


def _sig_map() -> Column:
    return F.create_map(*[x for k, v in _signatures().items() for x in (F.lit(k), F.lit(v))])


def _stages(src: Column, p: str, fallback: str | None, day_first: bool = True) -> list[dict[str, Column]]:
    """Ordered projections computing the ISO date of ``src`` into ``{p}out``.

    Each intermediate value is its own column, so it is computed once per
    row and every later expression reads a plain column reference (small
    generated code, no repeated regex evaluation)."""
    c = lambda n: qcol(p + n)
    v = utrim(src)
    empty = is_empty_token(src)
    if fallback:
        v = F.when(empty, F.lit(fallback)).otherwise(v)
        empty = F.lit(False)
    year_first = c("code").isin(YSLASH_C, YDASH_C, COMPACT_C)
    month_first = c("code") == USLASH_C if day_first else c("code").isin(USLASH_C, DOT4_C, DOT2_C)
    return [
        {p + "v": v, p + "empty": empty},
        {p + "sig": F.translate(c("v"), "0123456789", "9999999999")},
        {p + "dsig": F.regexp_extract(c("sig"), _DATE_SIG, 1)},
        {p + "code": F.try_element_at(_sig_map(), c("dsig")), p + "txt": F.substr(c("v"), F.lit(1), F.length(c("dsig")))},
        {p + "parts": F.split(F.when(c("code") == COMPACT_C, F.concat_ws(
            "-", F.substr(c("txt"), F.lit(1), F.lit(4)), F.substr(c("txt"), F.lit(5), F.lit(2)),
            F.substr(c("txt"), F.lit(7), F.lit(2)))).otherwise(c("txt")), r"[./\-]")},
        {p + "a": F.get(c("parts"), 0).try_cast("int"), p + "b": F.get(c("parts"), 1).try_cast("int"),
         p + "c": F.get(c("parts"), 2).try_cast("int")},
        {p + "y": F.when(c("code") == DOT2_C, F.when(c("c") >= 69, c("c") + 1900).otherwise(c("c") + 2000))
            .when(year_first, c("a")).otherwise(c("c")),
         p + "m": F.when(year_first, c("b")).when(month_first & (c("a") <= 12), c("a")).otherwise(c("b")),
         p + "d": F.when(year_first, c("c")).when(month_first & (c("a") > 12), c("a"))
            .when(month_first, c("b")).otherwise(c("a"))},
        {p + "iso": F.when(c("code").isNotNull(), F.concat_ws(
            "-", F.lpad(c("y").cast("string"), 4, "0"), F.lpad(c("m").cast("string"), 2, "0"),
            F.lpad(c("d").cast("string"), 2, "0")))},
        # what is of no plain shape; null text passes the grammar's stages unread
        {p + "w_text": F.when(c("code").isNull() & ~c("empty") & (c("sig") != "9999-99-99"), c("v"))},
        *[{p + "w_" + k: f(lambda n: c("w_" + n)) for k, f in stage.items()} for stage in datewords.stages(day_first)],
        {p + "out": F.when(~c("empty"), F.when(c("sig") == "9999-99-99", c("v"))
                           .when(F.try_to_date(c("iso"), "yyyy-MM-dd").isNotNull(), c("iso"))
                           .otherwise(F.coalesce(c("w_spelled"), c("v"))))},
    ]


def with_format_date(df: DataFrame, src, out: str, fallback: str | None = None,
                     day_first: bool = True) -> DataFrame:
    """``df`` plus ``out`` = ISO text of ``src`` (see module doc); the
    staged form for tables."""
    p = f"_fd_{out}_"
    for stage in _stages(col_of(src), p, fallback, day_first):
        df = df.withColumns(stage)
    tmp = [c for c in df.columns if c.startswith(p) and c != p + "out"]
    return df.drop(*tmp).withColumnRenamed(p + "out", out)


def format_date(c, fallback: str | None = None, day_first: bool = True) -> Column:
    """Date text -> ISO text as one Column (a rewrite chain, one regex per
    shape).  For whole tables ``with_format_date`` is faster: it computes each
    intermediate value once per row."""
    raw = col_of(c)
    v = utrim(raw)
    empty = is_empty_token(raw)
    if fallback:
        v = F.when(empty, F.lit(fallback)).otherwise(v)
        empty = F.lit(False)
    r = v
    for pat, rep in (_CHAIN if day_first else _MONTH_FIRST + _CHAIN):
        r = F.regexp_replace(r, pat, rep)
    iso = F.when(r.startswith("D:"), F.substring(r, 3, 10))
    plain = r.startswith("D:") | v.rlike(ISO)
    pick = F.when(v.rlike(ISO), F.lit(1)).when(F.try_to_date(iso, "yyyy-MM-dd").isNotNull(), F.lit(2)).otherwise(F.lit(1))
    spelled = datewords.spelled(F.when(~plain & ~empty, v), day_first)
    return F.when(~empty, F.coalesce(spelled, F.element_at(F.array(v, iso), pick)))


# Each accepted shape rewritten to ``D:yyyy-M-d``; rewritten text matches no
# later pattern, so the chain is one regex per shape.
_CHAIN = [
    (rf"^([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{4}}){_T}$", "D:$3-$2-$1"),
    (rf"^([0-9]{{1,2}})\.([0-9]{{1,2}})\.(69|[7-9][0-9]){_T}$", "D:19$3-$2-$1"),
    (rf"^([0-9]{{1,2}})\.([0-9]{{1,2}})\.([0-9]{{2}}){_T}$", "D:20$3-$2-$1"),
    (rf"^([0-9]{{4}})/([0-9]{{1,2}})/([0-9]{{1,2}}){_T}$", "D:$1-$2-$3"),
    (rf"^([0-9]{{4}})-([0-9]{{1,2}})-([0-9]{{1,2}}){_T}$", "D:$1-$2-$3"),
    (rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}}){_T}$", "D:$1-$2-$3"),
    (rf"^(1[3-9]|[2-9][0-9])/([0-9]{{1,2}})/([0-9]{{4}}){_T}$", "D:$3-$2-$1"),  # first > 12: day first
    (rf"^([0-9]{{1,2}})/([0-9]{{1,2}})/([0-9]{{4}}){_T}$", "D:$3-$1-$2"),      # else month first
    (r"-([0-9])(?=-|$)", "-0$1"),                                                # zero-fill month, day
]

# Dotted dates month first; a first number over 12 is left to the chain above.
_MONTH_FIRST = [
    (rf"^(0?[0-9]|1[0-2])\.([0-9]{{1,2}})\.([0-9]{{4}}){_T}$", "D:$3-$1-$2"),
    (rf"^(0?[0-9]|1[0-2])\.([0-9]{{1,2}})\.(69|[7-9][0-9]){_T}$", "D:19$3-$1-$2"),
    (rf"^(0?[0-9]|1[0-2])\.([0-9]{{1,2}})\.([0-9]{{2}}){_T}$", "D:20$3-$1-$2"),
]
