"""URL filters: host rules and pattern rules, each indexed by its rarest literal token.

A rule can only match a URL that has all of its literal tokens.  So each rule is filed
under the one of them that fewest URLs have, a URL's tokens fetch the rules filed under
them, and only these run their regular expressions.  Rules without a token are tried on
every URL.  All of it is DataFrame operations; distinct URLs are judged once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.llm.scratch import Scratch, private

#: Index entries up to which the rules are broadcast (some tens of MB); more are joined by a shuffle.
BROADCAST_RULES = 100_000


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains, where the path starts with ``path``; the longest fitting rule wins."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def pattern(self) -> str:
        return rf"^(?:[^/]*\.)?{_quote(self.host)}{_quote(self.path)}" if self.host else rf"^[^/]*{_quote(self.path)}"

    def tokens(self) -> list[str]:
        # a path's last run may go on in the URL, so it only counts if a delimiter ends it
        return _tokens(self.host) + _tokens(re.sub(r"[0-9A-Za-z]+$", "", self.path))


@dataclass(frozen=True)
class PatternRule:
    """A regular expression on host + path, with literal tokens that any match has as whole tokens."""

    verdict: str
    pattern: str
    literals: tuple[str, ...] = ()

    @property
    def name(self) -> str:
        return self.pattern

    def tokens(self) -> list[str]:
        return list(self.literals)


def _tokens(text: str) -> list[str]:
    return re.findall(r"[0-9A-Za-z]+", text)


def _quote(text: str) -> str:
    return re.sub(r"([^0-9A-Za-z_])", r"\\\1", text) if text.isascii() else "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in text)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    at = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(at, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(host: Column, path: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.concat(host, F.lit("/"), path), "[^0-9A-Za-z]+"), lambda t: t != ""))


def judge_urls(urls: DataFrame, rules: list[HostRule | PatternRule], *, url: str = "url", default: str = "allow") -> DataFrame:
    """url, host, path, rule, verdict of every distinct non-null URL.

    ``rule`` is the longest fitting host rule (among equals the first by name); without
    one it is null and the verdict is ``block`` if a blocking pattern rule matches and no
    allowing one does, else ``default``.
    """
    spark = urls.sparkSession
    scratch = Scratch(spark, "urls")
    parsed = urls.select(F.col(f"`{url}`").cast("string").alias("url")).filter("url is not null").distinct()
    parsed = parsed.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not rules:
        return parsed.select("url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    tokens = parsed.select("url", "host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))

    # how many URLs have each of the rules' tokens
    wanted = sorted({t for r in rules for t in r.tokens()})
    vocabulary = spark.createDataFrame([(t,) for t in wanted], "token string")
    near = F.broadcast(vocabulary) if len(wanted) <= BROADCAST_RULES else vocabulary
    counts = {r["token"]: r["n"] for r in tokens.join(near, "token").groupBy("token").agg(F.count("*").alias("n")).toLocalIterator()}
    entries, rest = [], []
    for rule in rules:
        row = (rule.name, rule.verdict, rule.pattern, isinstance(rule, HostRule), len(rule.name))
        if found := rule.tokens():
            entries.append((min(found, key=lambda t: (counts.get(t, 0), t)), *row))
        else:
            rest.append(row)
    kinds = "rule string, kind string, pattern string, by_host boolean, size int"
    index = spark.createDataFrame(entries, f"token string, {kinds}")
    near = F.broadcast(index) if len(entries) <= BROADCAST_RULES else index
    fits = F.expr("regexp_like(concat(host, path), pattern)")
    hits = tokens.join(near, "token").filter(fits).select("url", "rule", "kind", "by_host", "size")
    if rest:
        everywhere = F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(v).alias("kind"), F.lit(p).alias("pattern"), F.lit(h).alias("by_host"), F.lit(s).alias("size")) for n, v, p, h, s in rest))
        tried = parsed.select("url", "host", "path", F.inline(everywhere))
        hits = hits.unionByName(tried.filter(fits).select("url", "rule", "kind", "by_host", "size"))
    best = F.when(F.col("by_host"), F.struct((-F.col("size")).alias("minus"), F.col("rule").alias("rule"), F.col("kind").alias("kind")))
    decided = scratch.save(
        hits.groupBy("url").agg(
            F.min(best).alias("best"),
            F.bool_or(~F.col("by_host") & (F.col("kind") == "block")).alias("blocked"),
            F.bool_or(~F.col("by_host") & (F.col("kind") == "allow")).alias("allowed"),
        )
    )
    verdict = F.coalesce(F.col("best.kind"), F.when(F.col("blocked") & ~F.col("allowed"), "block"), F.lit(default))
    return parsed.join(decided, "url", "left").select("url", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))


def filter_urls(pages: DataFrame, rules: list[HostRule | PatternRule], *, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict of each row's URL; columns of these names are replaced.

    A null URL, or one without ``://``, has an empty host and path, no rule and the
    default verdict.  Repeated URLs are judged once; every row comes back once; an empty
    table gives an empty result.
    """
    key, other = private("key"), private("url")
    judged = judge_urls(pages, rules, url=url, default=default).select(F.col("url").alias(other), "host", "path", "rule", "verdict")
    kept = pages.select(F.col(f"`{url}`").cast("string").alias(key), *(F.col(f"`{c}`") for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")))
    joined = kept.join(judged, F.col(key) == F.col(other), "left").drop(key, other)
    return joined.withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")), "verdict": F.coalesce("verdict", F.lit(default))})


#: Pattern rules for kinds of site that a text corpus leaves out.
UNWANTED = [
    PatternRule("block", r"(?:^|[.\-])casino(?:[.\-]|/)", ("casino",)),
    PatternRule("block", r"(?:^|[.\-])adult(?:[.\-]|/)", ("adult",)),
    PatternRule("block", r"(?:^|[.\-])bets(?:[.\-]|/)", ("bets",)),
    PatternRule("block", r"(?:^|[.\-])pills(?:[.\-]|/)", ("pills",)),
    PatternRule("block", r"(?:^|\.)ad(?:[.\-]|/)", ("ad",)),
    PatternRule("block", r"(?:^|\.)ads(?:[.\-]|/)", ("ads",)),
    PatternRule("block", r"[.\-/]track(?:[.\-/]|$)", ("track",)),
    PatternRule("block", r"[.\-/]tracker(?:[.\-/]|$)", ("tracker",)),
    PatternRule("block", r"[.\-/]pixel(?:[.\-/]|$)", ("pixel",)),
]
