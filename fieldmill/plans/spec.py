"""Driver-side mapping metadata: which source column feeds which target
column and with which rule.  Tiny; never holds rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from fieldmill.schemas import layout

# Rule names.
RULES = ["generate_uid", "copy_target", "format_date", "default_value", "static_value",
         "clean_plz", "gender", "split_street", "split_number", "merge_columns",
         "lookup_ik_provider", "lookup_plz_by_city", "lookup_city_by_plz", "validate_ik",
         "validate_kvnr", "validate_email", "auto_sequence_6", "none"]

# Source-column spellings that identify ids and doctor numbers.
ID_COLUMNS = ["id", "patient_id", "patienten_id", "pat_id"]
LANR_COLUMNS = ["lanr", "la-nr", "la_nr"]
CITY_COLUMNS = ["ort", "wohnort", "stadt"]


@dataclass(frozen=True)
class Rule:
    type: str = "none"
    param: str | None = None

    def __post_init__(self):
        if self.type not in RULES:
            raise ValueError(f"unknown rule {self.type!r}")


@dataclass
class MappingSpec:
    """target -> source column (or None) and target -> Rule, for one layout."""
    layout: dict
    sources: dict = field(default_factory=dict)
    rules: dict = field(default_factory=dict)

    @classmethod
    def for_layout(cls, name_or_layout, sources=None, rules=None) -> "MappingSpec":
        return cls(layout(name_or_layout), dict(sources or {}), dict(rules or {}))

    def rule(self, target: str) -> Rule:
        return self.rules.get(target) or Rule()

    def source(self, target: str) -> str | None:
        return self.sources.get(target)

    def used_columns(self) -> set[str]:
        """Mapped source columns plus rule params that name a column."""
        used = {s for s in self.sources.values() if s}
        used |= {r.param for r in self.rules.values() if r and r.param}
        return used


@dataclass(frozen=True)
class Preset:
    """One line of the default rules: the targets it speaks for (exact names
    or name parts), the source column it needs as parameter (by exact names or
    by a name part), and the rules with and without that column."""
    rule: str | None
    names: tuple = ()
    parts: tuple = ()
    endings: tuple = ()
    needs: tuple = ()
    needs_part: str | None = None
    fallback: str | None = None
    takes_source: bool = False

    def speaks_for(self, target: str) -> bool:
        return (target in self.names or any(p in target for p in self.parts)
                or any(target.endswith(e) for e in self.endings))

    def column(self, lower: dict[str, str]) -> str | None:
        """The first source column that a name in ``needs`` (in their order of
        groups) or the part in ``needs_part`` identifies."""
        for group in self.needs:
            for c, low in lower.items():
                if low in group:
                    return c
        if self.needs_part:
            return next((c for c, low in lower.items() if self.needs_part in low), None)
        return None

    def rule_for(self, column: str | None) -> Rule | None:
        if not (self.needs or self.needs_part):
            return Rule(self.rule)
        if column is None:
            return Rule(self.fallback) if self.fallback else None
        return Rule(self.rule, None if self.takes_source else column)


# Default rules, the first line that speaks for a target decides.
PRESETS = (
    Preset("generate_uid", names=("id",)),
    Preset("none", names=("p_nr",), needs=(ID_COLUMNS,), fallback="auto_sequence_6", takes_source=True),
    Preset("none", names=("ext_id",), needs=(ID_COLUMNS, LANR_COLUMNS), fallback="auto_sequence_6", takes_source=True),
    Preset("format_date", parts=("birth", "datum"), endings=("_bis",)),
    Preset("gender", parts=("anrede",)),
    Preset("lookup_plz_by_city", parts=("plz",), needs=(CITY_COLUMNS,), fallback="clean_plz"),
    Preset("lookup_city_by_plz", names=("p_ort", "ort"), needs_part="plz"),
    Preset("split_street", parts=("street",)),
    Preset("split_number", parts=("hausnummer",)),
    Preset("lookup_ik_provider", names=("p_krankenkasse",), needs_part="ik"),
    Preset("validate_ik", names=("p_ik", "ik"), parts=("ik_nummer",)),
    Preset("validate_kvnr", names=("p_vnr", "vnr", "kvnr"), parts=("versichertennummer",)),
    Preset("validate_email", parts=("mail",)),
)


def default_rules(target_layout: dict, source_columns: list[str], sources: dict) -> tuple[dict, dict]:
    """(rules, sources): the preset of every target that has one; a preset that
    takes its column as the source replaces the mapped one."""
    lower = {c: c.lower() for c in source_columns}
    rules, sources = {}, dict(sources)
    for target in target_layout:
        preset = next((p for p in PRESETS if p.speaks_for(target)), None)
        if preset is None:
            continue
        column = preset.column(lower)
        rule = preset.rule_for(column)
        if rule is not None:
            rules[target] = rule
        if preset.takes_source and column is not None:
            sources[target] = column
    return rules, sources
