"""Internationalised e-mail addresses: domains in their ASCII form and quoted
local parts, as native expressions.

``validate_email`` of ``checks.py`` accepts letters of any script but measures
labels as they are written; here every label is measured as it goes over the
wire.  The bootstring coding of a label is a fold over its non-ASCII
characters in (code point, place) order.  The folds are higher-order
functions, which run outside generated code; they are reached by non-ASCII
labels of at most 63 characters only, and this module is an option, not the
default rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions.checks import _ATOM
from fieldmill.functions.text import col_of, utrim

# Parameters of the bootstring coding for host names.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_POINT = 36, 1, 26, 38, 700, 72, 128
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"

_QUOTED = r'"(?:[\x20\x21\x23-\x5B\x5D-\x7E]|\\[\x20-\x7E])*"'
_ADDRESS = rf"^({_QUOTED}|[^@\"]+)@([^@]+)$"
_WORD = r"[\p{L}\p{N}](?:[\p{L}\p{M}\p{N}\-]*[\p{L}\p{M}\p{N}])?"
_STOPS = "。．｡"  # fixed values: other full stops between labels


def _let(values: dict[str, Column], then) -> Column:
    """``then`` of the struct of ``values``, each computed once."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), then), 0)


def _div(a: Column, b) -> Column:
    return F.floor(a / b).cast("long")


def _varint(delta: Column, bias: Column) -> Column:
    """``delta`` as digits of growing weight; the last is below its threshold.
    A label of 63 characters has deltas below 2^27: at most 12 digits."""
    def step(state: Column, k: Column) -> Column:
        t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), k * BASE - bias)).cast("long")
        q = state.q
        last = q < t
        digit = F.when(last, q).otherwise(t + F.pmod(q - t, F.lit(BASE) - t))
        return F.when(state.done, state).otherwise(F.struct(
            F.concat(state.out, F.substring(F.lit(_DIGITS), digit.cast("int") + 1, F.lit(1))).alias("out"),
            _div(q - t, F.lit(BASE) - t).alias("q"), last.alias("done")))

    start = F.struct(F.lit("").alias("out"), delta.cast("long").alias("q"), F.lit(False).alias("done"))
    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(12).cast("long")), start, step, lambda s: s.out)


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The bias after ``delta``, with ``points`` characters in place."""
    limit = (BASE - T_MIN) * T_MAX // 2

    def shrink(state: Column, _k: Column) -> Column:
        return F.when(state.d > limit, F.struct(_div(state.d, BASE - T_MIN).alias("d"), (state.k + BASE).alias("k"))) \
            .otherwise(state)

    def start(s: Column) -> Column:
        whole = F.struct((s.d + _div(s.d, points)).alias("d"), F.lit(0).cast("long").alias("k"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), whole, shrink,
                           lambda e: e.k + _div((BASE - T_MIN + 1) * e.d, e.d + SKEW))

    return _let({"d": F.when(first, _div(delta, DAMP)).otherwise(_div(delta, 2))}, start)


def _bootstring(label: Column) -> Column:
    """The coding of a non-ASCII ``label``, without its prefix."""
    def coded(s: Column) -> Column:
        points = s.points
        plain = F.filter(s.chars, lambda x: F.ascii(x) < FIRST_POINT)
        extra = F.array_sort(F.filter(
            F.transform(points, lambda c, i: F.struct(c.alias("c"), F.size(F.filter(
                F.slice(points, F.lit(1), i), lambda x: x <= c)).cast("long").alias("at"))),
            lambda x: x.c >= FIRST_POINT))

        def insert(state: Column, x: Column) -> Column:
            delta = (x.c - state.n) * (state.h + 1) + x.at - state.i
            return _let({"delta": delta}, lambda v: F.struct(
                F.concat(state.out, _varint(v.delta, state.bias)).alias("out"), x.c.alias("n"),
                (x.at + 1).alias("i"), (state.h + 1).alias("h"),
                _adapted(v.delta, state.h + 1, state.first).alias("bias"), F.lit(False).alias("first")))

        head = F.concat(F.array_join(plain, ""), F.when(F.size(plain) > 0, F.lit("-")).otherwise(F.lit("")))
        start = F.struct(head.alias("out"), F.lit(FIRST_POINT).cast("long").alias("n"),
                         F.lit(0).cast("long").alias("i"), F.size(plain).cast("long").alias("h"),
                         F.lit(FIRST_BIAS).cast("long").alias("bias"), F.lit(True).alias("first"))
        return F.aggregate(extra, start, insert, lambda e: e.out)

    chars = F.split(label, "")
    return _let({"chars": chars, "points": F.transform(chars, lambda x: F.ascii(x).cast("long"))}, coded)


def ascii_domain(c) -> Column:
    """The domain with every non-ASCII label as ``xn--`` and its coding,
    lower-cased; other full stops become dots.  Null stays null; a non-ASCII
    label of over 63 characters is left as it is (it has no valid form)."""
    lower = F.lower(F.translate(col_of(c), _STOPS, "..."))
    wire = F.transform(F.split(lower, r"\."), lambda x: F.when(
        x.rlike(r"[^\x00-\x7F]") & (F.char_length(x) <= 63), F.concat(F.lit("xn--"), _bootstring(x))).otherwise(x))
    return F.when(lower.rlike(r"[^\x00-\x7F]"), F.array_join(wire, ".")).otherwise(lower)


def email_ascii(c, quoted: bool = False) -> Column:
    """The trimmed address with its domain in ASCII form; null where it is
    not valid.  ``quoted`` admits ``"any text"@domain``.

    Limits: 64 bytes before the ``@``, 63 characters a label, 253 the domain
    and 254 the whole in ASCII form; at least two labels, the last not all
    digits.  A label starts with a letter or digit and does not end with a
    hyphen.  Letters are lower-cased but not otherwise normalised."""
    s = utrim(col_of(c))
    local, domain = F.regexp_extract(s, _ADDRESS, 1), F.regexp_extract(s, _ADDRESS, 2)
    shape = rf"^{_ATOM}(?:\.{_ATOM})*$" + (rf"|^{_QUOTED}$" if quoted else "")

    def judged(v: Column) -> Column:
        ok = (v.local.rlike(shape) & v.wide.rlike(rf"^{_WORD}(?:\.{_WORD})+$") & ~v.wide.rlike(r"\.[0-9]+$")
              & (F.octet_length(v.local) <= 64) & ~v.wire.rlike(r"[^.]{64,}|[^\x00-\x7F]")
              & (F.char_length(v.wire) <= 253) & (F.octet_length(v.local) + 1 + F.char_length(v.wire) <= 254))
        return F.when(ok, F.concat(v.local, F.lit("@"), v.wire))

    return F.when(s.isNotNull(), _let({"local": local, "wide": F.translate(domain, _STOPS, "..."),
                                       "wire": ascii_domain(domain)}, judged))
