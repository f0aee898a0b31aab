"""Address text in DuckDB's SQL, written independently of the column expressions."""

from __future__ import annotations

from ..functions.text import ABBREVIATIONS, FLOOR_FLAT, UNIT

_UNIT_ALONE = UNIT.replace("([", "(?:[")


def clean(x: str) -> str:
    return f"nullif(regexp_replace({x}, '^\\s+|\\s+$', '', 'g'), '')"


def normalize(x: str) -> str:
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in ABBREVIATIONS.items())
    plain = f"trim(regexp_replace(replace(upper({clean(x)}), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'))"
    return f"nullif(array_to_string(list_transform(string_split({plain}, ' '), lambda t: CASE t {cases} ELSE t END), ' '), '')"


def unit_of_normalized(n: str) -> str:
    return f"coalesce(nullif(regexp_extract({n}, '{FLOOR_FLAT}', 0), ''), 'FLAT ' || nullif(regexp_extract({n}, '{UNIT}', 1), ''))"


def strip_normalized(n: str) -> str:
    first = f"trim(regexp_replace({n}, '{FLOOR_FLAT}', ''))"
    return f"nullif(trim(regexp_replace(trim(regexp_replace({first}, '{_UNIT_ALONE}', '')), '\\s+', ' ', 'g')), '')"


def house_of_normalized(n: str) -> str:
    return f"list_filter(string_split(coalesce({strip_normalized(n)}, {n}), ' '), lambda t: regexp_matches(t, '[0-9]'))[1]"


def last_part(x: str) -> str:
    return f"list_filter(list_transform(string_split({clean(x)}, ','), lambda t: trim(t)), lambda t: t <> '')[-1]"


def sector(x: str) -> str:
    t = f"upper({clean(x)})"
    spaced = f"CASE WHEN contains({t}, ' ') OR length({t}) <= 3 THEN {t} ELSE left({t}, length({t}) - 3) || ' ' || right({t}, 3) END"
    parts = f"string_split_regex({spaced}, '\\s+')"
    return f"CASE WHEN len({parts}) = 2 THEN {parts}[1] || ' ' || left({parts}[2], 1) END"
