"""Explicit single values with units in property texts; anything ambiguous gives no value."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The spellings of units and what they are written as.
UNITS = {
    "mm hg": "mmHg",
    "mmhg": "mmHg",
    "atm": "atm",
    "atm-cu m/mole": "atm·m³/mol",
    "mg/l": "mg/L",
    "g/cm3": "g/cm³",
    "g/cm³": "g/cm³",
    "°c": "°C",
}
# The units that a property's own value may have.
PRIMARY = {
    "boiling_point": ["°C"],
    "vapor_pressure": ["mmHg", "atm"],
    "henrys_law_constant": ["atm·m³/mol"],
    "water_solubility": ["mg/L"],
    "density": ["g/cm³"],
    "melting_point": ["°C"],
}
# What a number, a value with its unit, and a mention of water look like.
_NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+|\s*[x×X]\s*10[+-]?[0-9]+)?"
_UNIT = "|".join(re.sub(r"([^\w°³])", r"\\\1", u) for u in sorted(UNITS, key=len, reverse=True))
_VALUE = rf"(?i)(?<![\w.+-])({_NUMBER})\s*({_UNIT})(?![A-Za-z0-9])"
_WATER = r"(?i)\b(?:water|aqueous|aqua|aquatic)\b"


def _plain(number: Column) -> Column:
    """A number with its power of ten written as an exponent."""
    return F.regexp_replace(number, r"\s*[x×X]\s*10", "e").try_cast("double")


def property_value(text: Column, key: str) -> Column:
    """struct(value, state, unit, temperature, pressure, medium) of one property text.

    A value counts only if exactly one number has a unit of the property; ranges,
    broken exponents, and several temperatures or pressures give none.  ``state`` is
    filled for ``physical_state`` alone, with the one state that is named and not denied.
    """
    none = F.lit(None).cast("string")
    if key == "physical_state":
        states = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\b(liquid|solid|gas)\b"), F.lit(1)), F.lower))
        denied = text.rlike(r"(?i)\b(?:not|no|without)\s+(?:an?\s+)?(?:liquid|solid|gas)\b|\bnon[- ](?:liquid|solid|gas)\b")
        state = F.when((F.size(states) == 1) & ~denied, F.get(states, 0))
        return F.struct(F.lit(None).cast("double").alias("value"), state.alias("state"), none.alias("unit"), none.alias("temperature"), none.alias("pressure"), none.alias("medium"))
    broken = text.rlike(r"[0-9](?:\.[0-9]+)?[eE](?:[+-](?![0-9])|(?![+\-0-9]))") | text.rlike(r"(?<![x×X])\b[0-9]+(?:\.[0-9]+)?\s*[-–—]\s*[0-9]+(?:\.[0-9]+)?\b")
    if key == "experimental_logp":
        found = F.regexp_extract_all(text, F.lit(rf"(?i)\bLog\s+(?:Kow|P)\s*=\s*({_NUMBER})(?![\w.+-])"), F.lit(1))
        good = (F.size(found) == 1) & ~broken
        return F.struct(F.when(good, _plain(F.get(found, 0))).alias("value"), none.alias("state"), none.alias("unit"), none.alias("temperature"), none.alias("pressure"), F.when(good & text.rlike(_WATER), "water").alias("medium"))
    names = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    numbers, units = (F.regexp_extract_all(text, F.lit(_VALUE), F.lit(i)) for i in (1, 2))
    listed = F.transform(F.arrays_zip(numbers.alias("n"), units.alias("u")), lambda x: F.struct(x["n"].alias("n"), F.try_element_at(names, F.lower(x["u"])).alias("u")))

    def decide(all_: Column) -> Column:
        degrees = F.filter(all_, lambda x: x["u"] == "°C")
        pressures = F.filter(all_, lambda x: x["u"].isin("mmHg", "atm"))
        if key in PRIMARY:
            own = F.filter(all_, lambda x: x["u"].isin(PRIMARY[key]))
        else:
            others = F.filter(all_, lambda x: x["u"] != "°C")
            own = F.when(F.size(others) > 0, others).otherwise(all_)
        one = F.get(own, 0)
        # a property that is a pressure itself has its own value among the pressures
        own_pressures = F.when(one["u"].isin("mmHg", "atm"), 1).otherwise(0)
        good = (F.size(own) == 1) & (F.size(degrees) <= 1) & (F.size(pressures) - own_pressures <= 1) & ~broken & _plain(one["n"]).isNotNull()
        if key != "vapor_pressure":
            good = good & (F.size(pressures) <= 1)
        write = lambda x: F.concat_ws(" ", x["n"], x["u"])
        return F.struct(
            F.when(good, _plain(one["n"])).alias("value"),
            none.alias("state"),
            F.when(good, one["u"]).alias("unit"),
            F.when(good & (one["u"] != "°C") & (F.size(degrees) == 1), write(F.get(degrees, 0))).alias("temperature"),
            F.when(good & (F.size(pressures) > own_pressures), write(F.get(F.filter(pressures, lambda x: (own_pressures == 0) | ~((x["n"] == one["n"]) & (x["u"] == one["u"]))), 0))).alias("pressure"),
            F.when(good & text.rlike(_WATER), "water").alias("medium"),
        )

    return F.transform(F.array(listed), decide)[0]


def canonical_id(value: Column) -> Column:
    """Digits without leading zeros; null for anything else and for 0."""
    return F.when(F.trim(value).rlike("^[0-9]+$"), F.nullif(F.regexp_replace(F.trim(value), "^0+", ""), F.lit("")))
