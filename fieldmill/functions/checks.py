"""Check-digit identifiers and e-mail syntax as native expressions.

Digits are read with ``ascii(ch) - 48`` under a shape guard, so no cast can
fail under ANSI mode and everything stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions.text import col_of, utrim

# Check-digit weights.
IK_WEIGHTS = [2, 1, 2, 1, 2, 1]             # institution id, digits 3..8
KVNR_WEIGHTS = [1, 2, 1, 2, 1, 2, 1, 2, 1, 2]  # insurance number, 10 digits


def _digit(s: Column, pos: int) -> Column:
    return F.ascii(F.substring(s, pos, 1)) - 48


def _cross(d: Column, w: int) -> Column:
    p = d * w
    return F.when(p >= 10, p - 9).otherwise(p)


def ik_clean(c) -> Column:
    """Trim, cut at the first '.', zero-fill to 9 (longer text untouched)."""
    s = F.substring_index(utrim(col_of(c)), ".", 1)
    return F.when(F.length(s) < 9, F.lpad(s, 9, "0")).otherwise(s)


def ik_check_ok(s: Column) -> Column:
    """``s`` is 9 ASCII digits and digit 9 equals the weighted sum mod 10.

    Reads ``s`` several times: pass a column (or a small expression); the
    operators stage nested checks as columns so expressions stay small, and
    generated code computes the repeated input once.
    """
    total = None
    for i, w in enumerate(IK_WEIGHTS):
        term = _cross(_digit(s, 3 + i), w)
        total = term if total is None else total + term
    # arithmetic first: the left operand is always evaluated, so generated
    # code can compute the shared input once for all digit reads
    return F.coalesce((F.pmod(total, F.lit(10)) == _digit(s, 9)) & s.rlike("^[0-9]{9}$"), F.lit(False))


def validate_ik(c) -> Column:
    """True if the (cleaned) value is a valid 9-digit institution id."""
    # null input gives null arithmetic, which ik_check_ok maps to False
    return ik_check_ok(ik_clean(c))


def kvnr_check_ok(s: Column) -> Column:
    """``s`` is letter + 9 digits with a valid check digit (letter A=01..Z=26).
    Reads ``s`` a dozen times: pass a column (see ``ik_check_ok``)."""
    code = F.ascii(F.substring(s, 1, 1)) - 64
    digits = [F.floor(code / 10).cast("int"), F.pmod(code, F.lit(10))] + [_digit(s, p) for p in range(2, 10)]
    total = None
    for d, w in zip(digits, KVNR_WEIGHTS):
        term = _cross(d, w)
        total = term if total is None else total + term
    return F.coalesce((F.pmod(total, F.lit(10)) == _digit(s, 10)) & s.rlike("^[A-Z][0-9]{9}$"), F.lit(False))


def kvnr_clean(c) -> Column:
    return F.upper(utrim(col_of(c)))


def validate_kvnr(c) -> Column:
    return kvnr_check_ok(kvnr_clean(c))


def repair_kvnr(c) -> Column:
    """struct(fixed, value): one confusion fix, accepted only if the check
    digit then holds.  Fixes: letter+'O'... -> letter+'0'...; a leading
    ``0 1 ) ( = /`` before 9 digits -> ``O I O I P U``."""
    v = kvnr_clean(c)
    cand = (F.when((F.length(v) == 10) & v.rlike("^[A-Z]O"),
                   F.concat(F.substring(v, 1, 1), F.lit("0"), F.substring(v, 3, 8)))
            .when((F.length(v) == 10) & v.rlike(r"^[01)(=/][0-9]{9}$"),
                  F.concat(F.translate(F.substring(v, 1, 1), "01)(=/", "OIOIPU"), F.substring(v, 2, 9))))
    fixed = F.coalesce(cand.isNotNull() & kvnr_check_ok(cand), F.lit(False))
    return F.struct(fixed.alias("fixed"), F.when(fixed, cand).otherwise(v).alias("value"))


# E-mail: a documented syntax subset (no DNS).  Local part: dot-separated
# atoms; domain: at least two dot-separated labels of letters/digits/hyphens,
# no label starting or ending with '-', top label not all digits.
_ATOM = r"[\p{L}\p{N}!#$%&'*+/=?^_`{|}~\-]+"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
EMAIL_RE = rf"^{_ATOM}(?:\.{_ATOM})*@{_LABEL}(?:\.{_LABEL})+$"


def validate_email(c) -> Column:
    s = utrim(col_of(c))
    local = F.substring_index(s, "@", 1)
    domain = F.substring_index(s, "@", -1)
    ok = (s.rlike(EMAIL_RE) & (F.length(s) <= 254) & (F.length(local) <= 64)
          & ~domain.rlike(r"\.[0-9]+$") & ~domain.rlike(r"[^.]{64,}"))
    return F.coalesce(ok, F.lit(False))
