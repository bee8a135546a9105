"""Column cleaning and derivation: every function maps Column -> Column.

All of these are native Spark expressions (regex, string and map functions),
so a projection of many of them stays inside one whole-stage-codegen span.
Java regex differs from Python's: ``\\s``/``\\w`` are ASCII there, so the
Unicode classes are spelled out.  Digits are ASCII ``[0-9]`` on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode whitespace (what Python's str.strip removes): ASCII controls
# \t..\r, the separators \x1c-\x1f, NEL and every Unicode space separator.
WS = r"[\t\n\x0B\f\r\x1C-\x1F\x85\p{Z}]"
CONTROL = r"[\x00-\x1F\x7F-\x9F]"
# Strict sanitizing keeps letters, digits, underscore, whitespace and
# & ' ` ´ ’ ( ) / @ . _ + -   -- everything else is deleted.
STRICT_DROP = r"[^\p{L}\p{N}_\t\n\x0B\f\r\p{Z}&'`´’()/@.+\-]"

# Tokens a delimited-file reader treats as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]


def qcol(name: str) -> Column:
    """A column by its literal name: headers such as ``Geb.Datum`` must not
    be read as struct-field paths."""
    return F.col("`" + name.replace("`", "``") + "`")


def col_of(c) -> Column:
    return qcol(c) if isinstance(c, str) else c


# The same set as WS, spelled out for btrim (no regex, generated code).
WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85 \xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
            + "\u2028\u2029\u202f\u205f\u3000")


def utrim(c) -> Column:
    """Strip Unicode whitespace at both ends (Spark's trim() strips spaces only)."""
    return F.btrim(col_of(c), F.lit(WS_CHARS))


def is_blank(c) -> Column:
    """Null, or nothing but whitespace."""
    c = col_of(c)
    return c.isNull() | (utrim(c) == "")


def is_empty_token(c, tokens=("nan", "null", "none", ""), trim: bool = True,
                   lower: bool = True) -> Column:
    """Null, or (optionally trimmed / lower-cased) equal to one of ``tokens``."""
    c = col_of(c)
    v = utrim(c) if trim else c
    v = F.lower(v) if lower else v
    return c.isNull() | v.isin(list(tokens))


def nullif_blank(c) -> Column:
    """Blank -> null, otherwise the value unchanged (the ``fill_null`` core)."""
    c = col_of(c)
    return F.when(~is_blank(c), c)


def fill_null(c, literal: str | None = None) -> Column:
    """Blank or null cells become ``literal`` (None keeps a real SQL null;
    the sink then writes its ``nullValue`` such as ``NULL``)."""
    c = col_of(c)
    return F.when(is_blank(c), F.lit(literal)).otherwise(c)


def sanitize_basic(c) -> Column:
    """null -> ''; trim; delete control characters (no space put in)."""
    return F.regexp_replace(utrim(F.coalesce(col_of(c), F.lit(""))), CONTROL, "")


def sanitize_strict(c) -> Column:
    """``sanitize_basic`` then delete everything but the allowed characters.

    Not idempotent by design: trimming happens before the deletions.
    """
    return F.regexp_replace(sanitize_basic(c), STRICT_DROP, "")


def clean_kind(target: str) -> str:
    """Which default cleaner a target column gets, chosen by its name."""
    t = target.lower()
    if "mail" in t:
        return "email"
    if any(k in t for k in ("ort", "city", "stadt")):
        return "city"
    if "name" in t:
        return "name"
    return "general"


def clean_by_kind(c, target: str) -> Column:
    """Default clean by target name; null stays null."""
    c = col_of(c)
    kind = clean_kind(target)
    if kind == "email":
        out = utrim(c)
    elif kind == "name":
        out = sanitize_strict(c)
    else:
        out = sanitize_basic(c)
    return F.when(c.isNotNull(), out)


def default_value(c, value: str) -> Column:
    """Empty (null, or trimmed '', nan, null, None) -> ``value``."""
    c = col_of(c)
    return F.when(is_empty_token(c, ("", "nan", "null", "None"), lower=False), F.lit(value)).otherwise(c)


def static_value(value: str) -> Column:
    """The same constant for every row, whatever the mapping."""
    return F.lit(value)


def clean_postcode(c, width: int = 5) -> Column:
    """Trim, strip a trailing ``.0``, zero-fill an all-digit code of at most
    ``width`` digits; other text unchanged; empty tokens -> null."""
    c = col_of(c)
    v = F.regexp_replace(utrim(c), r"\.0$", "")
    fill = F.when(v.rlike(rf"^[0-9]{{1,{width}}}$"), F.lpad(v, width, "0")).otherwise(v)
    return F.when(~is_empty_token(c), fill)


def pad_postcode(c, width: int = 5) -> Column:
    """Zero-fill to ``width`` without truncating longer text (str.zfill)."""
    c = col_of(c)
    return F.when(F.length(c) < width, F.lpad(c, width, "0")).otherwise(c)


# Gender codes -> salutation (exact, after trimming).
GENDER_CODES = {
    "M": "Herr", "m": "Herr", "HERR": "Herr", "Herr": "Herr", "männlich": "Herr", "1": "Herr",
    "W": "Frau", "w": "Frau", "FRAU": "Frau", "Frau": "Frau", "weiblich": "Frau",
    "F": "Frau", "f": "Frau", "2": "Frau",
}


def _literal_map(d: dict) -> Column:
    items = []
    for k, v in d.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def gender_salutation(c) -> Column:
    """Exact trimmed code -> Herr/Frau; other text unchanged; blank -> null."""
    v = utrim(col_of(c))
    return F.when(v != "", F.coalesce(F.try_element_at(_literal_map(GENDER_CODES), v), v))


def split_street(c) -> Column:
    """Street part: delete from the first digit on (with the whitespace before it)."""
    c = col_of(c)
    out = utrim(F.regexp_replace(c, rf"(?s){WS}*[0-9]+.*$", ""))
    return F.when(~is_empty_token(c, trim=False), out)


def split_number(c) -> Column:
    """House number part: the text from the first digit on; none -> ''."""
    c = col_of(c)
    out = utrim(F.regexp_extract(c, r"(?s)[0-9].*$", 0))
    return F.when(~is_empty_token(c, trim=False), out)


def precheck_street(c) -> Column:
    """Pre-check variant: text before the first whitespace+digit, else all."""
    v = utrim(col_of(c))
    pat = rf"(?s)^(.*?){WS}+[0-9]"
    return F.when(v.rlike(pat), utrim(F.regexp_extract(v, pat, 1))).otherwise(v)


def precheck_number(c) -> Column:
    """Pre-check variant: trailing ``digits [ws] [letters / -]``, else ''."""
    v = utrim(col_of(c))
    return utrim(F.regexp_extract(v, rf"([0-9]+{WS}*[a-zA-Z/\-]*)$", 1))


# Academic titles, tried in this order (longest forms first).
TITLES = ["Prof. Dr. med. dent.", "Prof. Dr. med.", "PD Dr. med.", "Prof. Dr.",
          "Dr. med. dent.", "Dr. med.", "Dr. rer. nat.", "Dr.", "Prof.", "PD"]


def split_title(c) -> Column:
    """struct(title, name): one leading title (list spelling) and the rest.

    The title must be followed by whitespace; a value that is nothing but a
    title is left alone.
    """
    return _split_title(utrim(col_of(c)))


def _split_title(v: Column) -> Column:
    lv = F.lower(v)
    only_title = lv.isin([t.lower() for t in TITLES])
    title = F.lit("")
    rest = v
    for t in reversed(TITLES):
        pat = "(?i)^" + re.escape(t) + WS + "+"
        title = F.when(v.rlike(pat), F.lit(t)).otherwise(title)
        rest = F.when(v.rlike(pat), utrim(F.regexp_replace(v, pat, ""))).otherwise(rest)
    return F.when(only_title, F.struct(F.lit("").alias("title"), v.alias("name"))) \
        .otherwise(F.struct(title.alias("title"), rest.alias("name")))


# First names that imply a salutation.
MALE_FIRST_NAMES = ["hans", "peter", "christian", "thomas", "sebastian", "stefan", "alexander", "michael"]
FEMALE_FIRST_NAMES = ["sabine", "amira", "sarah", "elena", "maria", "lisa", "monika", "julia"]


def infer_salutation(c) -> Column:
    """struct(gender, salutation) from the first part of a first name."""
    key = F.substring_index(F.lower(utrim(F.coalesce(col_of(c), F.lit("")))), "-", 1)
    gender = (F.when(key.isin(MALE_FIRST_NAMES), F.lit("männlich"))
              .when(key.isin(FEMALE_FIRST_NAMES), F.lit("weiblich"))
              .otherwise(F.lit("unbekannt")))
    salutation = (F.when(key.isin(MALE_FIRST_NAMES), F.lit("Herr"))
                  .when(key.isin(FEMALE_FIRST_NAMES), F.lit("Frau"))
                  .otherwise(F.lit("")))
    return F.struct(gender.alias("gender"), salutation.alias("salutation"))


def clean_insurance_o(c) -> Column:
    """Upper-case and read every letter O after the first position as zero."""
    v = F.upper(utrim(col_of(c)))
    return F.when(v.isNotNull(), F.concat(F.substring(v, 1, 1), F.replace(F.substring(v, 2, 1 << 30), F.lit("O"), F.lit("0"))))


def merge_columns(a, b, strict_second: bool = False) -> Column:
    """``clean(a) + ' ' + clean(b)``, trimmed; blank parts are skipped."""
    left = sanitize_basic(a)
    right = sanitize_strict(b) if strict_second else sanitize_basic(b)
    return utrim(F.concat_ws(" ", left, right))
