"""Target layouts: ordered column -> SQL type text, and helpers around them."""

from __future__ import annotations

import re

from pyspark.sql import types as T

# The two built-in target layouts, columns in declared order,
# with their SQL type text (these must equal the original tool's layouts).
LAYOUTS: dict[str, dict[str, str]] = {
    "patienten": {
        "id": "VARCHAR(40)",
        "p_nr": "VARCHAR(40)",
        "p_anrede": "VARCHAR(60)",
        "p_name": "VARCHAR(60)",
        "p_vname": "VARCHAR(60)",
        "p_plz": "VARCHAR(10)",
        "p_ort": "VARCHAR(60)",
        "p_street": "VARCHAR(60)",
        "p_birth": "VARCHAR(40)",
        "p_vip": "VARCHAR(10)",
        "p_tel": "VARCHAR(40)",
        "p_telge": "VARCHAR(40)",
        "p_handy": "VARCHAR(40)",
        "p_email": "VARCHAR(60)",
        "p_hausnummer": "VARCHAR(10)",
        "p_wlc": "VARCHAR(3)",
        "p_zuzahlungsbefreit": "BOOLEAN",
        "p_krankenkasse": "VARCHAR(60)",
        "p_privatversichert": "BOOLEAN",
        "p_ik": "VARCHAR(40)",
        "p_vnr": "VARCHAR(40)",
        "p_vs": "VARCHAR(10)",
        "p_zuzahlungsbefreit_bis": "DATE",
        "rechnungsempfaenger": "TEXT",
    },
    "adressen": {
        "id": "VARCHAR(40)",
        "ext_id": "VARCHAR(40)",
        "anrede": "VARCHAR(60)",
        "name1": "VARCHAR(60)",
        "name2": "VARCHAR(60)",
        "name3": "VARCHAR(60)",
        "strasse": "VARCHAR(60)",
        "plz": "VARCHAR(10)",
        "ort": "VARCHAR(60)",
        "email": "VARCHAR(60)",
        "telefon": "VARCHAR(60)",
        "kategorie": "VARCHAR(60)",
        "telefonmobil": "VARCHAR(60)",
    },
}

_VARCHAR = re.compile(r"VARCHAR\((\d+)\)", re.IGNORECASE)


def parse_limit(type_text: str | None) -> int | None:
    """``VARCHAR(40)`` -> 40; anything else (TEXT, BOOLEAN, DATE) -> None."""
    m = _VARCHAR.search(str(type_text or ""))
    return int(m.group(1)) if m else None


def layout(name_or_layout) -> dict[str, str]:
    """Accept a built-in layout name or a user layout ``{column: type}``."""
    if isinstance(name_or_layout, dict):
        return dict(name_or_layout)
    return dict(LAYOUTS[name_or_layout])


def limits(name_or_layout) -> dict[str, int]:
    """Length limits of the VARCHAR columns of a layout."""
    out = {}
    for col, typ in layout(name_or_layout).items():
        n = parse_limit(typ)
        if n is not None:
            out[col] = n
    return out


def target_struct(name_or_layout) -> T.StructType:
    """All target columns are strings; the declared type travels as metadata.

    Spark's VarcharType would fail the write on over-long values; the tool
    instead reports them (``length_conflicts``) and lets a policy decide.
    """
    fields = []
    for col, typ in layout(name_or_layout).items():
        meta = {"sql_type": typ}
        n = parse_limit(typ)
        if n is not None:
            meta["max_len"] = n
        fields.append(T.StructField(col, T.StringType(), True, metadata=meta))
    return T.StructType(fields)
