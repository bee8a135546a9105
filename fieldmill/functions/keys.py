"""Key generation: time-based uids and the 6-digit row sequence."""

from __future__ import annotations

import time

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmill.functions.text import col_of, utrim

SUFFIX_SPACE = 36 ** 5          # five base-36 characters
SUFFIX_MULT = 48271             # coprime to 36: a bijection of 0..36^5-1


def generate_uid(row, base_ms=None) -> Column:
    """``BASE36(ms)-XXXXX`` (upper case), unique per row of one run.

    The five-character suffix is a bijection of the row number mod 36^5 and
    the millisecond part moves on by ``row div 36^5``: (base, row) -> uid is
    injective and deterministic, so a retried task writes the same ids.
    Without ``base_ms`` the driver's clock is read once, when the expression is
    built: every action on the same DataFrame sees the same ids.  Tables that
    refer to each other must be built with one ``base_ms`` (see ``Job``).
    """
    r = col_of(row).cast("long")
    base = F.lit(int(time.time() * 1000) if base_ms is None else int(base_ms)).cast("long")
    head = F.conv((base + F.floor(r / SUFFIX_SPACE).cast("long")).cast("string"), 10, 36)
    tail = F.lpad(F.conv(F.pmod(r * SUFFIX_MULT, F.lit(SUFFIX_SPACE)).cast("string"), 10, 36), 5, "0")
    return F.upper(F.concat(head, F.lit("-"), tail))


UID_SHAPE = r"^[0-9A-Z]+-[0-9A-Z]{5}$"


def sequence6(row) -> Column:
    """1-based position as at least six digits: row 0 -> '000001'."""
    return F.format_string("%06d", col_of(row).cast("long") + 1)


def auto_sequence_6(existing, row) -> Column:
    """Keep an existing trimmed id; empty cells get the row's own position."""
    if existing is None:
        return sequence6(row)
    e = col_of(existing)
    t = utrim(e)
    empty = e.isNull() | t.isin("", "nan", "None", "NULL")
    return F.when(empty, sequence6(row)).otherwise(t)


def id_carry_over(existing, row=None) -> Column:
    """Carry a source id over (trimmed, empties -> null); with ``row`` given,
    fill the gaps with the row's 6-digit position."""
    e = col_of(existing)
    t = utrim(e)
    kept = F.when(e.isNotNull() & ~t.isin("", "nan", "None"), t)
    return kept if row is None else F.coalesce(kept, sequence6(row))
