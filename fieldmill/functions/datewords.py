"""Spelled and free-form dates as a staged token grammar.

Read after the plain shapes of ``dates.py`` have failed.  A trailing time and
zone and a leading weekday are cut; what is left is either a date with a
month name (German or English, long or short) in the orders ``d month y``,
``month d y`` and ``y month d``, with any separators, ordinals and filler
words, or three numbers with one separator.  Numbers with ``/`` are month
first, the others follow ``day_first``; a first or second number over 12
can only be the day (but a dotted date never swaps its order).  Two-digit
years pivot at 69.  A date without a day or a year, with two month names or
with words of no meaning is not read.

Each stage maps new names to functions of the values so far, so the same
grammar runs as table columns and as one nested expression.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Month names and short forms, German and English; weekdays; time zones.
MONTHS = {
    1: ["januar", "january", "jänner", "jan"],
    2: ["februar", "february", "feber", "feb"],
    3: ["märz", "maerz", "march", "mrz", "mär", "mar"],
    4: ["april", "apr"],
    5: ["mai", "may"],
    6: ["juni", "june", "jun"],
    7: ["juli", "july", "jul"],
    8: ["august", "aug"],
    9: ["september", "sept", "sep"],
    10: ["oktober", "october", "okt", "oct"],
    11: ["november", "nov"],
    12: ["dezember", "december", "dez", "dec"],
}
WEEKDAYS = ["montag", "dienstag", "mittwoch", "donnerstag", "freitag", "samstag", "sonnabend", "sonntag",
            "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
            "mon", "tues", "tue", "wed", "thurs", "thur", "thu", "fri", "sat", "sun",
            "mo", "di", "mi", "do", "fr", "sa", "so"]
ZONES = ["z", "utc", "gmt", "mez", "mesz", "cet", "cest"]

_LETTER = "a-zäöüß"
_NAMES = "|".join(sorted((n for names in MONTHS.values() for n in names), key=len, reverse=True))
_MONTH = rf"(?<![{_LETTER}])({_NAMES})(?![{_LETTER}])"
_ZONE = rf"(?:\s*(?:{'|'.join(ZONES)}|[+\-][0-9]{{2}}:?[0-9]{{2}}))?"
_TIME = (r"(?:(?:\s*t|,?\s+(?:um |at )?)\s*[0-9]{1,2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?:\s*(?:am|pm|uhr))?"
         rf"|t[0-9]{{4}}(?:[0-9]{{2}})?){_ZONE}$")
_WEEKDAY = rf"^(?:{'|'.join(WEEKDAYS)})(?:\.,|[.,])?\s+"
_FILLER = r"(?:^|(?<=\s))(?:of|the|der|den|dem|am|on)\s+"
_ORDINAL = rf"(?<=[0-9])(?:st|nd|rd|th)(?![{_LETTER}])"
_NUMBERS = r"^([0-9]{1,4})(\s*[./\-]\s*|\s+)([0-9]{1,2})\2([0-9]{1,4})$"
_COMPACT = r"^([0-9]{4})([0-9]{2})([0-9]{2})$"

# signature of the skeleton (digits as 9, month name as m) -> where the year stands
_DAY_FIRST = {f"{d}-m-{y}" for d in ("9", "99") for y in ("99", "9999")} | \
             {f"m-{d}-{y}" for d in ("9", "99") for y in ("99", "9999")}
_YEAR_FIRST = {f"9999-m-{d}" for d in ("9", "99")}

Get = Callable[[str], Column]
Stages = list[dict[str, Callable[[Get], Column]]]


def _month_map() -> Column:
    return F.create_map(*[F.lit(x) for m, names in MONTHS.items() for n in names for x in (n, m)])


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _pick(values: dict[str, Callable[[Get], Column]], name: str) -> Callable[[Get], Column]:
    """The value of a named date, else that of three numbers."""
    return lambda g: F.when(g("mon").isNotNull(), values["named"](g)).otherwise(values[name](g))


def stages(day_first: bool = True) -> Stages:
    """Stages from ``text`` (null: nothing to read) to ``spelled``: the ISO
    date, or null where the grammar does not fit or no such day exists."""
    def skeleton(g: Get) -> Column:
        plain = F.regexp_replace(F.regexp_replace(g("low"), _FILLER, ""), _ORDINAL, "")
        marked = F.regexp_replace(F.regexp_replace(plain, _MONTH, "-m-"), r"[\s.,/'\-]+", "-")
        return F.regexp_replace(marked, "^-(?=m)|-$", "")

    def numeric(name: str) -> Callable[[Get], Column]:
        def value(g: Get) -> Column:
            a, b, c = g("a"), g("b"), g("c")
            slash = g("sep") == "/"
            month_first = slash if day_first else F.lit(True)
            swaps = F.when(g("sep") == ".", F.lit(False)).otherwise((b > 12) & (a <= 12))
            first_is_month = F.when(month_first, a <= 12).otherwise(swaps)
            if name == "m":
                return F.when(g("wide"), b).when(first_is_month, a).otherwise(b)
            return F.when(g("wide"), c).when(first_is_month, b).otherwise(a)
        return value

    return [
        {"low": lambda g: F.regexp_replace(F.regexp_replace(F.lower(g("text")), _TIME, ""), _WEEKDAY, "")},
        {"low": lambda g: F.regexp_replace(g("low"), _COMPACT, "$1-$2-$3")},
        {"skel": skeleton, "mon": lambda g: F.try_element_at(_month_map(), F.regexp_extract(g("low"), _MONTH, 1)),
         "sep": lambda g: F.btrim(F.regexp_extract(g("low"), _NUMBERS, 2)),
         "three": lambda g: F.when(g("low").rlike(_NUMBERS), F.array(*[F.regexp_extract(g("low"), _NUMBERS, i)
                                                                       for i in (1, 3, 4)]))},
        {"sig": lambda g: F.translate(g("skel"), "0123456789", "9999999999"),
         "nums": lambda g: F.when(g("mon").isNotNull(), F.regexp_extract_all(g("skel"), F.lit("[0-9]+"), F.lit(0)))
            .otherwise(g("three"))},
        {"a": lambda g: _int(F.get(g("nums"), 0)), "b": lambda g: _int(F.get(g("nums"), 1)),
         "c": lambda g: _int(F.get(g("nums"), 2)),
         "wide": lambda g: F.length(F.get(g("nums"), 0)) == 4,
         "ytext": lambda g: F.when(g("mon").isNull(), F.when(F.length(F.get(g("nums"), 0)) == 4, F.get(g("nums"), 0))
                                   .when(F.length(F.get(g("nums"), 0)) <= 2, F.get(g("nums"), 2)))
            .when(g("sig").isin(*sorted(_DAY_FIRST)), F.get(g("nums"), 1))
            .when(g("sig").isin(*sorted(_YEAR_FIRST)), F.get(g("nums"), 0))},
        {"y": lambda g: F.when(F.length(g("ytext")) == 4, _int(g("ytext")))
            .when(F.length(g("ytext")) == 2, F.when(_int(g("ytext")) >= 69, _int(g("ytext")) + 1900)
                  .otherwise(_int(g("ytext")) + 2000)),
         "m": _pick({"named": lambda g: g("mon"), "m": numeric("m")}, "m"),
         "d": _pick({"named": lambda g: F.when(g("sig").isin(*sorted(_YEAR_FIRST)), g("b")).otherwise(g("a")),
                     "d": numeric("d")}, "d")},
        {"joined": lambda g: F.when(g("y").isNotNull() & g("m").isNotNull() & g("d").isNotNull(), F.concat_ws(
            "-", F.lpad(g("y").cast("string"), 4, "0"), F.lpad(g("m").cast("string"), 2, "0"),
            F.lpad(g("d").cast("string"), 2, "0")))},
        {"spelled": lambda g: F.when(F.try_to_date(g("joined"), "yyyy-MM-dd").isNotNull(), g("joined"))},
    ]


def spelled(text: Column, day_first: bool = True) -> Column:
    """The grammar as one expression: every stage binds its values once."""
    steps = stages(day_first)

    def run(i: int, known: dict[str, Column]) -> Column:
        values = {k: f(known.__getitem__) for k, f in steps[i].items()}
        if i == len(steps) - 1:
            return values["spelled"]
        bound = F.array(F.struct(*[v.alias(k) for k, v in values.items()]))
        return F.get(F.transform(bound, lambda s: run(i + 1, {**known, **{k: s[k] for k in values}})), 0)

    return run(0, {"text": text})


def ambiguous(text: Column) -> Column:
    """Whether ``text`` holds three numbers, the year last, whose first two
    are different and could each be the month."""
    low = F.regexp_replace(F.regexp_replace(F.lower(text), _TIME, ""), _WEEKDAY, "")
    return F.coalesce(low.rlike(r"^(0?[1-9]|1[0-2])(\s*[./\-]\s*|\s+)(0?[1-9]|1[0-2])\2([0-9]{2}|[0-9]{4})$")
                      & (_int(F.regexp_extract(low, _NUMBERS, 1)) != _int(F.regexp_extract(low, _NUMBERS, 3))), F.lit(False))
