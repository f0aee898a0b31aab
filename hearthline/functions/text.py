"""Address text as column expressions. Null and blank count as missing everywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abbreviations that normalising writes out.
ABBREVIATIONS = {
    "APARTMENT": "FLAT",
    "APT": "FLAT",
    "RD": "ROAD",
    "ST": "STREET",
    "AVE": "AVENUE",
    "AV": "AVENUE",
    "LN": "LANE",
    "CL": "CLOSE",
    "CT": "COURT",
    "PL": "PLACE",
    "SQ": "SQUARE",
    "GDNS": "GARDENS",
    "TCE": "TERRACE",
    "DRV": "DRIVE",
}
#: Units named by a word and a number, and flats named by their floor.
UNIT = r"\b(?:FLAT|APARTMENT|APT|UNIT|ROOM|STUDIO|MAISONETTE)\s+([A-Z0-9-]+)\b"
FLOOR_FLAT = r"\b(?:BASEMENT|GROUND|FIRST|SECOND|THIRD|FOURTH|FIFTH|SIXTH|SEVENTH|EIGHTH|NINTH|TENTH|LOWER GROUND|UPPER GROUND|LOWER|UPPER|MIDDLE|TOP)\s+(?:FLOOR\s+)?FLAT\b"


def or_null(c: Column) -> Column:
    """Null for the empty string."""
    return F.nullif(c, F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*map(or_null, columns))


def strip_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    return or_null(strip_space(c.cast("string")))


def clean_postcode(c: Column) -> Column:
    return F.upper(F.replace(clean_text(c), F.lit(" "), F.lit("")))


def normalize_text(c: Column) -> Column:
    """Upper case, letters and digits in single-spaced tokens, abbreviations written out."""
    plain = F.trim(F.regexp_replace(F.replace(F.upper(clean_text(c)), F.lit("&"), F.lit(" AND ")), "[^A-Z0-9]+", " "))
    names = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return or_null(F.array_join(F.transform(F.split(plain, " "), lambda t: F.coalesce(names[t], t)), " "))


def normalize_house_number(c: Column) -> Column:
    return F.replace(normalize_text(c), F.lit(" "), F.lit(""))


def unit_of_normalized(n: Column) -> Column:
    number = or_null(F.regexp_extract(n, UNIT, 1))
    return F.coalesce(or_null(F.regexp_extract(n, FLOOR_FLAT, 0)), F.concat(F.lit("FLAT "), number))


def extract_unit(c: Column) -> Column:
    return unit_of_normalized(normalize_text(c))


def _without_first(c: Column, pattern: str) -> Column:
    return F.trim(F.regexp_replace(c, f"^(.*?){pattern}", "$1"))


def strip_normalized(n: Column) -> Column:
    return or_null(F.trim(F.regexp_replace(_without_first(_without_first(n, FLOOR_FLAT), UNIT.replace("([", "(?:[")), r"\s+", " ")))


def strip_unit(c: Column) -> Column:
    """Normalised text without its first floor flat and first unit, wherever they stand."""
    return strip_normalized(normalize_text(c))


def house_number_of_address(c: Column) -> Column:
    """The first token with a digit, the unit left out where anything else remains."""
    n = normalize_text(c)
    return or_null(F.regexp_extract(F.coalesce(strip_normalized(n), n), r"(?:^|\s)(\S*[0-9]\S*)", 1))


def last_address_part(c: Column) -> Column:
    parts = F.filter(F.transform(F.split(clean_text(c), ","), strip_space), lambda x: x != "")
    return F.get(F.reverse(parts), F.lit(0))


def building_name(c: Column) -> Column:
    """The first part without its unit; missing where a digit remains."""
    rest = strip_unit(F.get(F.split(clean_text(c), ","), F.lit(0)))
    return F.when(~rest.rlike("[0-9]"), normalize_text(rest))


def certificate_core(address: Column, address1: Column) -> Column:
    return normalize_text(first_filled(address, address1))


def sale_core(unit: Column, house: Column, building: Column, street: Column) -> Column:
    """Unit, building, house number (unless the building's name holds it) and street."""
    house_text = normalize_text(house)
    named = F.array_contains(F.split(F.coalesce(normalize_text(building), F.lit("")), " "), house_text)
    number = F.when(or_null(building).isNull() | (house_text.isNotNull() & ~F.coalesce(named, F.lit(False))), clean_text(house))
    return normalize_text(F.concat_ws(" ", clean_text(unit), clean_text(building), number, clean_text(street)))


def house_number_of_primary_name(c: Column) -> Column:
    """The first token of a primary name, commas at its ends off, if it has a digit."""
    token = F.regexp_replace(F.get(F.split(clean_text(c), r"\s+"), F.lit(0)), "^,+|,+$", "")
    return F.when(token.rlike(r"\d"), token)


def building_of_primary_name(c: Column) -> Column:
    name = clean_text(c)
    return F.when(~house_number_of_primary_name(c).eqNullSafe(name), name)


def full_address(*parts: Column) -> Column:
    return F.concat_ws(", ", *map(clean_text, parts))


def postcode_sector(c: Column) -> Column:
    """Outward part, a space, and the inward part's first sign; missing where there aren't two parts."""
    t = F.upper(clean_text(c))
    spaced = F.when(~t.contains(" ") & (F.length(t) > 3), F.regexp_replace(t, "^(.*)(...)$", "$1 $2")).otherwise(t)
    return F.when(spaced.rlike(r"^\S+\s+\S+$"), F.regexp_replace(spaced, r"^(\S+)\s+(\S)\S*$", "$1 $2"))


def format_distance(km: Column) -> Column:
    metres = F.concat(F.bround(km * 1000.0, 0).cast("long").cast("string"), F.lit(" m"))
    return F.when(km < 1.0, metres).when(km.isNotNull(), F.format_string("%.2f km", km))


def client_postcode(c: Column) -> Column:
    """Text as typed, formatted; missing where it can't be a postcode."""
    t = clean_postcode(c)
    good = (F.length(t) >= 5) & t.rlike(r"[A-Z]{1,2}\d")
    return F.when(good, F.regexp_replace(t, "^(.*)(...)$", "$1 $2"))


def index_type(subtype: Column) -> Column:
    """FLAT or HOUSE, as the price index tells dwellings apart."""
    return F.when(F.upper(subtype).rlike("FLAT|MAISONETTE|APARTMENT"), "FLAT").otherwise("HOUSE")


def school_type(phase: Column) -> Column:
    p = F.upper(phase)
    return F.when(p.contains("PRIMARY"), "PRIMARY").when(p.contains("SECONDARY"), "SECONDARY").otherwise("OTHER")


def any_prefix(postcode: Column, prefixes) -> Column:
    """Whether a postcode starts with any prefix; false for missing ones; true where there are no prefixes."""
    present = F.length(F.coalesce(postcode, F.lit(""))) > 0
    return present & (reduce(lambda a, b: a | b, [postcode.startswith(p) for p in prefixes]) if prefixes else F.lit(True))


def contains_text(c: Column, text: str) -> Column:
    """Case-insensitive; % and _ in the text are wildcards."""
    return c.ilike(f"%{text}%")


def starts_with_text(c: Column, text: str) -> Column:
    return c.ilike(f"{text}%")


def stratum(subtype: Column, sector: Column, band: Column) -> Column:
    t = F.upper(first_filled(subtype, F.lit("UNKNOWN")))
    group = F.when(t.contains("FLAT"), "FLAT").when(t.contains("MAISONETTE"), "MAISONETTE").when(t.contains("HOUSE"), "HOUSE").otherwise("OTHER")
    return F.concat_ws("|", group, first_filled(sector, F.lit("UNKNOWN")), band.cast("string"))
