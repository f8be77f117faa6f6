"""Names of samples, compounds and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.functions.text import unaccent


def replicate_of(name: Column) -> Column:
    """struct(group, replicate) of a sample named with a last digit 1 to 3 behind an optional hyphen or underscore; null if it is not."""
    group = F.regexp_extract(F.trim(name), r"^(.*?)[-_]*([123])$", 1)
    digit = F.regexp_extract(F.trim(name), r"^(.*?)[-_]*([123])$", 2)
    return F.when((group != "") & (digit != ""), F.struct(group.alias("group"), digit.cast("int").alias("replicate")))


def display_name(name: Column) -> Column:
    """Without parentheses, lower case but for the first letter."""
    plain = F.trim(F.lower(F.regexp_replace(F.regexp_replace(name, r"\([^()]*\)", " "), r"\s+", " ")))
    return F.concat(F.upper(F.left(plain, F.lit(1))), F.substr(plain, F.lit(2)))


def entity_key(number: Column, cid: Column, name: Column) -> Column:
    """``cas:``, else ``cid:``, else ``name:`` and the value."""
    given = lambda c: F.nullif(F.trim(c.cast("string")), F.lit(""))
    return F.coalesce(F.concat(F.lit("cas:"), given(number)), F.concat(F.lit("cid:"), given(cid)), F.concat(F.lit("name:"), F.lower(given(name))))


def _stems(name: Column) -> Column:
    """A name without stereo marks, locants and punctuation, spelling made even."""
    bare = F.regexp_replace(F.lower(name), r"\b(?:cis|trans|[ezrs])\b|[0-9]+", "")
    return F.replace(F.regexp_replace(bare, "[^a-z]", ""), F.lit("sulph"), F.lit("sulf"))


def compatible(canonical: Column, aliases: Column) -> Column:
    """Whether a part of a canonical name is one of the aliases, or their stems of seven letters or more agree."""
    parts = F.filter(F.split(canonical, "[(),;/]"), lambda p: F.trim(p) != "")
    key = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    same = F.arrays_overlap(F.filter(F.transform(parts, key), lambda k: k != ""), F.transform(aliases, key))
    stems = F.filter(F.transform(parts, _stems), lambda s: F.length(s) >= 7)
    return F.coalesce(same | F.arrays_overlap(stems, F.transform(F.concat(aliases, F.array(F.array_join(aliases, " "))), _stems)), F.lit(False))


def short_citation(text: Column) -> Column:
    """A citation up to the end of its year in parentheses; the whole text without one."""
    return F.coalesce(F.nullif(F.trim(F.regexp_extract(text, r"^(.+?\([0-9]{4}[^)]*\))", 1)), F.lit("")), F.trim(text))


def citation_keys(references: DataFrame, key: str) -> DataFrame:
    """(key, variant): the ways in which a reference ``SURNAME, A. & B. SECOND (1986a)`` may be cited, lower case without accents.

    First author with year, and without the year's letter; with ``et al.``; with the
    second author; each with and without a prefix such as ``van``.
    """
    k = F.col(key)
    year, base = F.regexp_extract(k, r"\(([0-9]{4}[a-z]?)\)", 1), F.regexp_extract(k, r"\(([0-9]{4})[a-z]?\)", 1)
    authors = F.regexp_extract(k, r"^(.*?)\s*\([0-9]{4}[a-z]?\)", 1)
    first = unaccent(F.regexp_extract(authors, r"^([\p{Lu}][\p{L}\-']+)", 1))
    prefix = F.lower(F.regexp_extract(authors, r"(?i)^[\p{L}\-']+,.*?\b(van|de|von|le|la|du|di)\b", 1))
    last = F.element_at(F.split(authors, r"\s*&\s*"), -1)
    second = F.when(authors.contains("&"), unaccent(F.regexp_extract(last, r"(\p{Lu}[\p{L}\-']{1,})", 1)))
    rows = references.select(k.alias("key"), first.alias("f"), prefix.alias("p"), second.alias("s"), F.array_distinct(F.array(year, base)).alias("y")).filter("f <> '' and y[0] <> ''")
    heads = F.array_compact(F.array(F.col("f"), F.when(F.col("p") != "", F.concat_ws(" ", "p", "f"))))
    tails = F.array_compact(F.array(F.lit(""), F.lit(" et al."), F.when(F.coalesce("s", F.lit("")) != "", F.concat(F.lit(" & "), "s"))))
    made = F.flatten(F.transform(heads, lambda h: F.flatten(F.transform(tails, lambda t: F.transform("y", lambda y: F.concat(h, t, F.lit(" ("), y, F.lit(")")))))))
    return rows.select("key", F.explode(F.array_distinct(made)).alias("variant"))


def cite(citations: DataFrame, references: DataFrame, *, citation: str, key: str, least: int = 15) -> DataFrame:
    """Each citation with the reference that it means: an exact variant, else the best scored one, else the only one of its author.

    Scores: 10 if the reference begins with the author or 5 if it contains it, 10 for
    the year (which must be there if the citation has one), 5 for the second author, 3
    for the year's letter.  Citations and references meet on the author's name, not all
    with all.
    """
    plain = unaccent(F.trim(F.regexp_replace(F.col(citation), r"\s+", " ")))
    asked = citations.select(citation).distinct().withColumn("_q", plain)
    exact = citation_keys(references, key).groupBy("variant").agg(F.max("key").alias("_exact"))
    asked = asked.join(exact, F.col("_q") == F.col("variant"), "left").drop("variant")
    word = r"[\p{L}\-']+"
    main = F.regexp_extract(F.regexp_replace("_q", r"^(?:van|de|von|le|la|du|di)\s+", ""), f"^({word})", 1)
    rest = asked.filter("_exact is null").withColumn("_author", main).withColumn("_second", F.regexp_extract("_q", rf"&\s*({word})", 1)).withColumn("_year", F.regexp_extract("_q", r"\(([0-9]{4}[a-z]?)", 1))
    known = references.select(F.col(key).alias("_key"), unaccent(F.col(key)).alias("_n")).withColumn("_author", F.explode(F.array_distinct(F.regexp_extract_all("_n", F.lit(f"({word})"), F.lit(1)))))
    pairs = rest.filter("_author <> ''").join(known, "_author")
    has_year = (F.col("_year") == "") | F.contains("_n", F.left("_year", F.lit(4)))
    score = F.when(F.startswith("_n", F.col("_author")), 10).otherwise(5) + F.when((F.col("_year") != "") & has_year, 10).otherwise(0)
    score = score + F.when((F.col("_second") != "") & F.contains("_n", F.col("_second")), 5).otherwise(0) + F.when((F.length("_year") == 5) & F.contains("_n", F.col("_year")), 3).otherwise(0)
    best = pairs.groupBy(citation).agg(F.max(F.when(has_year, F.struct(score.alias("s"), F.col("_key").alias("k")))).alias("b"), F.countDistinct("_key").alias("n"), F.min("_key").alias("only"))
    out = asked.join(best, citation, "left")
    found = F.coalesce("_exact", F.when(F.col("b.s") >= least, F.col("b.k")), F.when(F.col("n") == 1, F.col("only")))
    how = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("b.s") >= least, "scored").when(F.col("n") == 1, "only_author").otherwise("none")
    return out.select(citation, found.alias("reference"), how.alias("how"))
