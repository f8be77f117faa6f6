"""Numbers and quantities in text: strict numbers, thresholds, units, media."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factor of each unit to the base unit of its dimension (volume mL, mass mg).
UNITS = {"ul": ("volume", 0.001), "μl": ("volume", 0.001), "ml": ("volume", 1.0), "l": ("volume", 1000.0), "ug": ("mass", 0.001), "μg": ("mass", 0.001), "mg": ("mass", 1.0), "g": ("mass", 1000.0)}


def strict_number(text: Column) -> Column:
    """A number without sign or exponent; anything else is null."""
    return F.when(F.trim(text).rlike(r"^[0-9]+(\.[0-9]+)?$"), F.trim(text).try_cast("double"))


def exact_integer(text: Column) -> Column:
    """An unsigned integer that a double can hold exactly; anything else is null."""
    value = F.when(F.trim(text).rlike("^[0-9]{1,16}$"), F.trim(text).try_cast("long"))
    return F.when(value <= 9007199254740991, value)


def quantity(text: Column, to: str) -> Column:
    """A value with a unit, in unit ``to``; null if the text is no quantity or its unit is of another dimension."""
    dimension, base = UNITS[to.lower()]
    value = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-zμ]+)$", 1).try_cast("double")
    unit = F.lower(F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)\s*([A-Za-zμ]+)$", 2))
    factor = F.lit(None).cast("double")
    for name, (kind, scale) in UNITS.items():
        if kind == dimension:
            factor = F.when(unit == name, scale / base).otherwise(factor)
    return value * factor


def threshold(text: Column) -> Column:
    """struct(type, value, status) of a threshold text: author (year) type value unit.

    The type is a lone d or r after the year.  The value is reliable only if it is one
    positive number; ranges, comparators and whole numbers that could be years are not.
    """
    pattern = r"^.*?\([0-9]{4}[a-z]?\)\s*(?:([dr])(?:\s+|$))?\s*(.*?)\s*$"
    # each step once a row, however often it is used
    cut = F.struct(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).alias("kind"), F.regexp_extract(text, pattern, 2).alias("rest"))

    def read(x: Column) -> Column:
        value = F.regexp_extract(x["rest"], r"^([0-9]+(?:\.[0-9]+)?)(?:\s+[^0-9<>~–-].*)?$", 1)
        unit = F.nullif(F.regexp_extract(x["rest"], r"^[0-9.]+\s+([A-Za-zμ]+/[A-Za-z0-9]+)", 1), F.lit(""))
        return F.struct(x["kind"].alias("kind"), x["rest"].alias("rest"), value.alias("value"), value.try_cast("double").alias("number"), unit.alias("unit"))

    def judged(x: Column) -> Column:
        ok = F.coalesce((x["number"] > 0) & ~x["value"].rlike("^(1[89]|20)[0-9]{2}$"), F.lit(False))
        return F.struct(F.when(ok | (x["rest"] != "0.00"), x["kind"]).alias("type"), F.when(ok, x["number"]).alias("value"), F.when(ok, x["unit"]).alias("unit"), F.when(ok, "parsed").otherwise("unparsed").alias("status"))

    return F.transform(F.transform(F.array(cut), read), judged)[0]


def latest_year(text: Column) -> Column:
    """The largest number that could be a year, 0 if none."""
    years = F.transform(F.regexp_extract_all(text, F.lit(r"(?<![0-9])((?:1[89]|20)[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))
    return F.coalesce(F.array_max(years), F.lit(0))


def medium_category(medium: Column) -> Column:
    low = F.lower(F.coalesce(medium, F.lit("")))
    return F.when(low.contains("air"), "air").when(low.contains("water"), "water").when(low.rlike("alcohol|ethanol|beer|wine"), "alcohol").otherwise("other")


def inferred_unit(medium: Column) -> Column:
    return F.when(medium_category(medium) == "air", "mg/m3").when(F.lower(medium).rlike("water|oil|alcohol|other"), "mg/kg")


def identity_rank(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """struct(type, rank, verified) of how surely two records are the same compound: full key 5, its first block 4, registry number 3, structure 2, name 1."""
    full = r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"
    same = lambda k: F.coalesce(F.upper(F.trim(a[k])) == F.upper(F.trim(b[k])), F.lit(False)) & (F.trim(a[k]) != "")
    block = F.coalesce(F.left(a["key"], F.lit(14)) == F.left(b["key"], F.lit(14)), F.lit(False)) & a["key"].rlike(full) & b["key"].rlike(full)
    name = lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " "))
    named = F.coalesce(name(a["name"]) == name(b["name"]), F.lit(False)) & (name(a["name"]) != "")
    structure = F.coalesce(F.trim(a["structure"]) == F.trim(b["structure"]), F.lit(False)) & (F.trim(a["structure"]) != "")
    make = lambda t, r, v: F.struct(F.lit(t).alias("type"), F.lit(r).alias("rank"), F.lit(v).alias("verified"))
    return F.when(same("key") & a["key"].rlike(full), make("key", 5, True)).when(block, make("connectivity", 4, True)).when(same("number"), make("number", 3, True)).when(structure, make("structure", 2, True)).when(named, make("name", 1, False)).otherwise(make("none", 0, False))
