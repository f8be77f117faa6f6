"""Sorting with custom ranks, top-k with positions, and set differences on normalised terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_of(value: Column, order: list[str], unknown: int = 99) -> Column:
    """Place of a value in a fixed list, from 0."""
    at = F.array_position(F.array(*map(F.lit, order)), value)
    return F.when(at > 0, at - 1).otherwise(unknown).cast("int")


def top(df: DataFrame, order: list[Column], k: int, name: str = "pos") -> DataFrame:
    """The first k rows in order, with their place; only k rows meet in one task."""
    return df.orderBy(*order).limit(k).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def rank_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def natural_key(text: Column) -> Column:
    """A key that sorts digit runs by value, however long, and other text by its lower case: each run stands behind its number of digits, leading zeros left out."""
    parts = F.regexp_extract_all(F.lower(text), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))

    def key(part: Column) -> Column:
        digits = F.regexp_replace(part, "^0+(?=[0-9])", "")
        return F.when(part.rlike("^[0-9]"), F.concat(F.lpad(F.length(digits).cast("string"), 6, "0"), digits)).otherwise(part)

    return F.array_join(F.transform(parts, key), "")


def except_normalised(a: Column, b: Column) -> Column:
    """Terms of ``a`` that ``b`` has not, compared trimmed and lower-cased; originals in order, the first of equals."""
    key = lambda x: F.lower(F.trim(x))
    other = F.transform(b, key)
    keys = F.transform(a, key)
    return F.filter(a, lambda x, i: (key(x) != "") & ~F.array_contains(other, key(x)) & (F.array_position(keys, key(x)) == i + 1))


#: Fixed values of the score of a chunk: characters of its lead, and what a term in it, a further occurrence (three at
#: most), a registry number, a named entity, and a sign of a threshold or a drink add.
LEAD_CHARS, LEAD, MORE, NUMBER, ENTITY, THRESHOLD_SIGN, DRINK_SIGN = 180, 18.0, 4.0, 20.0, 145.0, 6.0, 4.0
_THRESHOLD_SIGN = r"(?i)阈\s*值|嗅阈|觉察阈|识别阈|threshold|(?:m|n|μ|u)g/"
_DRINK_SIGN = r"(?i)白酒|葡萄酒|啤酒|黄酒|果酒|酒精|乙醇"
_REGISTRY_NUMBER = r"^[0-9]{2,7}-[0-9]{2}-[0-9]$"


def _one_term(low: Column, term: Column, weight: Column) -> Column:
    count = ((F.length(low) - F.length(F.replace(low, term, F.lit("")))) / F.length(term)).cast("int")
    lead = F.when(F.contains(F.left(low, F.lit(LEAD_CHARS)), term), LEAD).otherwise(0.0)
    number = F.when(term.rlike(_REGISTRY_NUMBER), NUMBER).otherwise(0.0)
    return F.when(count > 0, weight + MORE * F.least(count - 1, F.lit(3)) + lead + number).otherwise(0.0)


def score_terms(text: Column, terms: list[tuple[str, float]]) -> Column:
    """Sum over the terms that occur: weight, more for up to three further occurrences, for the lead of the text, and for a registry number."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((_one_term(low, F.lit(t.lower()), F.lit(float(w))) for t, w in terms), F.lit(0.0))


def score_listed(text: Column, terms: Column) -> Column:
    """``score_terms`` for an array column of (term, weight), for lists too long to be written out in a plan."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.aggregate(terms, F.lit(0.0), lambda total, x: total + _one_term(low, x["term"], x["weight"]))


def with_signs(score: Column, text: Column, entities: Column | None = None, named: list[str] | None = None) -> Column:
    """A chunk's whole score: more if it belongs to a named entity, and, if it has any score, for the signs in its text."""
    own = score
    if entities is not None and named:
        own = own + F.when(F.arrays_overlap(entities, F.array(*map(F.lit, named))), ENTITY).otherwise(0.0)
    sign = F.when(F.coalesce(text, F.lit("")).rlike(_THRESHOLD_SIGN), THRESHOLD_SIGN).otherwise(0.0) + F.when(F.coalesce(text, F.lit("")).rlike(_DRINK_SIGN), DRINK_SIGN).otherwise(0.0)
    return F.when(own > 0, own + sign).otherwise(0.0)
