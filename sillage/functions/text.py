"""String functions: normalisation, tags, identifiers, descriptors."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: what a registry number looks like.
REGISTRY_NUMBER = r"[0-9]{2,7}-[0-9]{2}-[0-9]"


def collapse(text: Column) -> Column:
    """White space of any kind to single spaces, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def _unaccented(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)))


@F.pandas_udf(T.StringType())
def _entities(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else html.unescape(t))


def _where_needed(text: Column, needed: str, slow: Column) -> Column:
    return F.when(text.rlike(needed), slow).otherwise(text)


def normalise_term(text: Column) -> Column:
    """NFKC, soft hyphens out, spaces collapsed, lower case.  There is no builtin for NFKC; ASCII text does not need it."""
    return F.lower(collapse(F.replace(_where_needed(text, r"[^\x00-\x7F]", _nfkc(text)), F.lit("­"), F.lit(""))))


def unaccent(text: Column) -> Column:
    """Lower case without combining marks."""
    return F.lower(_where_needed(text, r"[^\x00-\x7F]", _unaccented(text)))


def normalise_name(text: Column) -> Column:
    return F.lower(collapse(text))


def strip_tags(markup: Column) -> Column:
    """Text of a piece of markup: breaks and paragraph ends as line feeds, other tags as spaces, the five basic entities decoded."""
    text = F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(text, r"(?i)<br\s*/?>|</p\s*>", "\n")
    text = F.regexp_replace(text, r"<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.regexp_replace(text, r"[ \t]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n\s*", "\n"), r"^\s+|\s+$", "")


def unescape(text: Column) -> Column:
    """All HTML entities decoded; there is no builtin, and text without ``&`` does not need it."""
    return _where_needed(text, "&", _entities(text))


def checksum_ok(number: Column) -> Column:
    """Whether a registry number's last digit is the weighted sum of the others modulo 10."""
    shaped = number.rlike(f"^{REGISTRY_NUMBER}$")
    digits = F.reverse(F.regexp_replace(number, "[^0-9]", ""))
    weighted = F.transform(F.sequence(F.lit(2), F.greatest(F.length(digits), F.lit(2))), lambda i: F.try_to_number(F.substr(digits, i, F.lit(1)), F.lit("9")).cast("int") * (i - 1))
    total = F.aggregate(weighted, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.coalesce(F.when(shaped, F.pmod(total, F.lit(10)).cast("string") == F.substr(digits, F.lit(1), F.lit(1))), F.lit(False))


def registry_numbers(text: Column) -> Column:
    """Distinct registry numbers in a text, in order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![0-9-]){REGISTRY_NUMBER}(?![0-9-])"), F.lit(0)))


def split_terms(text: Column, separators: str = r"[,;|]") -> Column:
    return F.filter(F.transform(F.split(text, separators), lambda t: F.trim(t)), lambda t: t != "")


def useful_term(term: Column) -> Column:
    """Registry numbers always; ASCII terms of three characters, others of two."""
    return term.rlike(f"^{REGISTRY_NUMBER}$") | F.when(term.rlike(r"^[\x00-\x7F]*$"), F.length(term) >= 3).otherwise(F.length(term) >= 2)


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(name), r"[^A-Za-z0-9._-]+", "_"), r"^_+|_+$", "")


def csv_cell(value: Column) -> Column:
    """A quoted cell, quotes doubled; null is empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def spreadsheet_safe(number: Column) -> Column:
    """A registry number as a formula that spreadsheets keep as text; others as they are."""
    return F.when(number.rlike(f"^{REGISTRY_NUMBER}$"), F.concat(F.lit('="'), number, F.lit('"'))).otherwise(number)


# Fixed value: what a hashed structure key looks like.
_STRUCTURE_KEY = r"^[A-Z]{14}-[A-Z]{10}-[A-Z]$"


def structure_key(value: Column) -> Column:
    """A structure key in capitals without blanks around it; anything else is null."""
    plain = F.upper(F.trim(value))
    return F.when(plain.rlike(_STRUCTURE_KEY), plain)


def connectivity(value: Column) -> Column:
    """A structure key's first block, which stands for how the atoms are connected."""
    return F.left(structure_key(value), F.lit(14))


def sentences(text: Column) -> Column:
    """Sentences in order, without the marks that end them; blank ones are left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[.!?。！？]"), lambda s: F.trim(s)), lambda s: s.rlike(r"\S"))


def batch_lines(text: Column) -> Column:
    """The lines of a batch input as they were typed; blank ones are left out."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda x: x.rlike(r"\S"))


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(v) != "", v) for v in values))
