"""Descriptors by vocabulary: categories, translation, labels.  Vocabularies are parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def categories(terms: Column, rules: dict[str, list[str]]) -> Column:
    """Sorted categories of which a keyword stands in any of the terms."""
    low = F.transform(terms, lambda t: F.lower(t))
    hit = lambda words: F.exists(low, lambda t: F.array_contains(F.array(*(F.contains(t, F.lit(w)) for w in words)), True))
    return F.array_sort(F.array_compact(F.array(*(F.when(hit([w.lower() for w in words]), name) for name, words in rules.items()))))


def translate_terms(terms: Column, dictionary: dict[str, str]) -> Column:
    """Each term by its lower-case entry; terms without one stay."""
    if not dictionary:
        return terms
    entries = F.create_map(*(F.lit(x) for pair in dictionary.items() for x in (pair[0].lower(), pair[1])))
    return F.transform(terms, lambda t: F.coalesce(F.try_element_at(entries, F.lower(F.trim(t))), t))


def replace_words(text: Column, pairs: list[tuple[str, str]], only_if: Column | None = None) -> Column:
    """Literal replacements in order, where the condition holds."""
    out = text
    for old, new in pairs:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out if only_if is None else F.when(only_if, out).otherwise(text)


def labels(text: Column, rules: list[tuple[str, str]]) -> Column:
    """All labels whose pattern is found, in the order of the rules."""
    return F.array_compact(F.array(*(F.when(text.rlike(pattern), name) for name, pattern in rules)))


def conflict(book_local: Column, book_names: Column, local: Column, name: Column, confusions: list[tuple[str, str]]) -> Column:
    """Why a scanned entity's names differ from the master's.

    likely_scan_error: equal after a known confusion of characters; insufficient: no
    name was read; name_variant: names agree without stereo marks and locants (six
    letters or more), or one local name holds the other without its position prefix;
    else identity_conflict.
    """
    key = lambda x: F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9㐀-鿿]", "")
    bare = lambda x: F.regexp_replace(key(x), "^(?:正|仲|异|邻|间|对|[0-9]+)", "")
    stem = lambda x: F.regexp_replace(key(x), "^(?:(?:cis|trans|[ezrs])|[0-9])+", "")
    confused = F.lit(False)
    for wrong, right in confusions:
        confused = confused | (F.contains(key(book_local), F.lit(wrong)) & F.contains(key(local), F.replace(key(book_local), F.lit(wrong), F.lit(right))))
    stems = lambda xs: F.filter(F.transform(xs, stem), lambda s: F.length(s) >= 6)
    variant = F.arrays_overlap(stems(book_names), stems(F.split(name, "[(),;/]")))
    a, b = bare(book_local), bare(local)
    held = (F.length(a) >= 2) & (F.contains(b, a) | (F.contains(a, b) & (b != "")))
    return F.when(confused, "likely_scan_error").when(F.size(book_names) == 0, "insufficient").when(F.coalesce(variant, F.lit(False)) | held, "name_variant").otherwise("identity_conflict")
