"""Descriptions of arbitrary values for audit trails, and the names and headings of scanned books."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that JSON can't hold, as cells give them.
_ODD = ("NaN", "Infinity", "-Infinity")


def described(value: Column) -> Column:
    """struct(type, display) of a VARIANT: number, string, boolean, null, array, object, or undefined where there is no value at all.

    Numbers show without needless zeros, texts as they are, lists and objects as JSON.
    """
    kind = F.schema_of_variant(value)
    name = (
        F.when(value.isNull(), "undefined")
        .when(F.is_variant_null(value), "null")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .otherwise("number")
    )
    shown = F.when(name.isin("undefined", "null"), name).when(name.isin("array", "object"), F.to_json(value)).otherwise(F.try_variant_get(value, "$", "string"))
    return F.struct(name.alias("type"), shown.alias("display"))


def described_cell(text: Column) -> Column:
    """The same for a cell's text: JSON as what it says, the three numbers that JSON lacks as numbers, anything else as a string, null as undefined."""
    parsed = described(F.try_parse_json(text))
    odd = F.struct(F.lit("number").alias("type"), text.alias("display"))
    plain = F.struct(F.lit("string").alias("type"), text.alias("display"))
    none = F.struct(F.lit("undefined").alias("type"), F.lit("undefined").alias("display"))
    return F.when(text.isNull(), none).when(text.isin(*_ODD), odd).when(F.try_parse_json(text).isNull(), plain).otherwise(parsed)


def valid_amount(value: Column, *, zero: bool = True) -> Column:
    """Whether a VARIANT is a finite number that is not negative (nor, without ``zero``, 0); texts of digits are not."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    right = (number >= 0) if zero else (number > 0)
    return F.coalesce(~kind.isin("STRING", "BOOLEAN", "VOID") & ~kind.startswith("ARRAY") & ~kind.startswith("OBJECT") & ~F.isnan(number) & (number < float("inf")) & right, F.lit(False))


def period(text: Column) -> Column:
    """The length of the shortest run of characters whose repetition the whole text is; its own length if there is none shorter.

    A text of n characters has the period p if it equals itself moved by p; of these p
    those that divide n are tried, so the work is n times the number of its divisors.
    """
    size = F.length(text)
    divisors = F.filter(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda p: F.pmod(size, p) == 0)
    moved = lambda p: F.substr(text, p + 1, F.greatest(size - p, F.lit(0))) == F.substr(text, F.lit(1), F.greatest(size - p, F.lit(0)))
    return F.when(size == 0, 0).otherwise(F.array_min(F.filter(divisors, moved)))


def halved(text: Column) -> Column:
    """A name that was scanned twice, once; a name whose two halves differ as it is."""
    size = F.length(text)
    half = F.floor(size / 2).cast("int")
    first, second = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    return F.when((size > 0) & (F.pmod(size, F.lit(2)) == 0) & (first == second), first).otherwise(text)


def clean_heading(text: Column, mark: str, titles: dict[str, str]) -> Column:
    """A heading on one line without its page number; one that ``mark`` recognises by a number in ``titles`` as that title."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    number = F.regexp_extract(flat, mark, 1)
    listed = F.create_map(*(F.lit(x) for pair in titles.items() for x in pair))
    plain = F.trim(F.regexp_replace(flat, r"\s*[0-9]{3}\s*$", ""))
    return F.coalesce(F.try_element_at(listed, number), plain) if titles else plain


def is_heading(text: Column, mark: str, *, start: int = 3, longest: int = 100) -> Column:
    """Whether ``mark`` stands at the text's beginning, at most ``start`` characters in, and the text is short: prose that names a chapter is none."""
    flat = F.coalesce(text, F.lit(""))
    return flat.rlike(f"(?s)^.{{0,{start}}}?(?:{mark.removeprefix('^')})") & (F.length(F.trim(flat)) <= longest)


def is_running_header(text: Column, mark: str) -> Column:
    """Whether a line names a chapter and ends with a page number."""
    flat = F.coalesce(text, F.lit(""))
    return flat.rlike(mark.removeprefix("^")) & flat.rlike(r"[0-9]{2,3}\s*$")
