"""Records out of HTML: anchored fields, lists of links, tables, and the presence of links."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.functions.text import strip_tags

_ANCHOR = r'(?is)<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'


def field(markup: Column, *patterns: str, text: Callable[[Column], Column] = strip_tags) -> Column:
    """The first group of the first pattern that matches, as ``text`` makes it (by default without tags); null if none does or nothing is left."""
    tries = [F.nullif(text(F.regexp_extract(markup, p, 1)), F.lit("")) for p in patterns]
    return F.coalesce(*tries)


def links(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, pos, href, label) of every link, in order."""
    hrefs, labels = (F.regexp_extract_all(F.col(markup), F.lit(_ANCHOR), F.lit(i)) for i in (1, 2))
    rows = pages.select(key, F.posexplode(F.arrays_zip(hrefs.alias("h"), labels.alias("l"))).alias("pos", "x"))
    return rows.select(key, "pos", F.col("x.h").alias("href"), strip_tags(F.col("x.l")).alias("label"))


def distinct_links(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """The first link to each target of a page."""
    rows = links(pages, key, markup).groupBy(key, "href").agg(F.min_by("label", "pos").alias("label"), F.min("pos").alias("pos"))
    return rows.select(key, "pos", "href", "label")


def link_presence(pages: DataFrame, key: str, markup: str, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """For each rule the first link whose label contains one of its needles: (key, rule, place, href), rules that find none left out."""
    listed = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(name).alias("rule"), F.array(*map(F.lit, needles)).alias("needles")) for i, (name, needles) in enumerate(rules)))
    rows = links(pages, key, markup).withColumn("r", F.explode(listed))
    hit = F.exists("r.needles", lambda n: F.lower(F.col("label")).contains(F.lower(n)))
    return rows.filter(hit).groupBy(key, F.col("r.rule").alias("rule"), F.col("r.place").alias("place")).agg(F.min_by("href", "pos").alias("href"))


def table_rows(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """(key, pos, cells) of every table row."""
    rows = F.regexp_extract_all(F.col(markup), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), strip_tags)
    return pages.select(key, F.posexplode(rows).alias("pos", "r")).select(key, "pos", cells(F.col("r")).alias("cells"))
