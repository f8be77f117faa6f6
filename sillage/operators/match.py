"""Lookups and joins: exact, fuzzy and bulk lookup, tiered and tolerance joins, overlays, differences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sillage.operators.ordered import first_per_key


def _clean(text: Column) -> Column:
    return F.lower(F.trim(text))


def exact_lookup(df: DataFrame, q: str, fields: list[str]) -> DataFrame:
    """Rows of which a field equals the query, but for case and outer spaces of the query."""
    cond = F.lit(False)
    for f in fields:
        cond = cond | (F.lower(F.col(f)) == q.strip().lower())
    return df.filter(F.coalesce(cond, F.lit(False)))


def fuzzy_lookup(df: DataFrame, q: str, fields: list[str]) -> DataFrame:
    """Rows of which a field contains the query literally."""
    cond = F.lit(False)
    for f in fields:
        cond = cond | F.coalesce(F.lower(F.col(f)).contains(q.strip().lower()), F.lit(False))
    return df.filter(cond)


def bulk_lookup(df: DataFrame, lines: list[str], fields: list[str], *, dedupe: list[str], order: list[str], exact: bool = True) -> DataFrame:
    """Rows that any non-blank line finds, the first by (line, order) of each ``dedupe`` key, with its line.

    Exact lines are joined by key, one exploded row a field; fuzzy ones are a small
    literal list tried beside each row.
    """
    asked = [(i, x.strip().lower()) for i, x in enumerate(lines) if x.strip()]
    if exact:
        queries = F.broadcast(df.sparkSession.createDataFrame(asked, "line int, q string"))
        found = df.withColumn("q", F.explode(F.array_distinct(F.array_compact(F.array(*(F.lower(F.col(f).cast("string")) for f in fields)))))).join(queries, "q").drop("q")
    else:
        hit = lambda q: F.array_contains(F.array(*(F.coalesce(F.lower(F.col(f).cast("string")).contains(q), F.lit(False)) for f in fields)), True)
        lines_hit = F.array_compact(F.array(*(F.when(hit(q), i) for i, q in asked)))
        found = df.withColumn("line", F.explode(lines_hit))
    return first_per_key(found, dedupe, ["line", *order])


def tiered_match(queries: DataFrame, records: DataFrame, *, q: str, key: str, names: list[str]) -> DataFrame:
    """For each query its best tier (1 exact key, 2 exact name, 3 name contains), candidates and status.

    status: exact (one key in tier 1 or 2), conflict (several), candidate (tier 3), unmatched.
    """
    asked = queries.withColumn("_q", _clean(F.col(q)))
    query = asked.select("_q").distinct()
    text = records.select(F.col(key).alias("_key"), F.explode(F.array(*(F.struct(F.lit(t).alias("tier"), F.lower(F.col(f).cast("string")).alias("name")) for t, f in [(1, key), *((2, n) for n in names)]))).alias("n")).select("_key", "n.tier", "n.name")
    equal = query.join(text, F.col("_q") == F.col("name")).select("_q", "_key", "tier")
    # candidates matter only where no key or name is equal
    rest = query.join(equal, "_q", "left_anti")
    named = text.filter("tier = 2").select("name", "_key")
    part = containing(rest, named.select("name").distinct(), "_q", "name").join(named, "name").select("_q", "_key", F.lit(3).alias("tier"))
    best = equal.unionByName(part).groupBy("_q", "tier").agg(F.countDistinct("_key").alias("n"), F.min("_key").alias("k"))
    top = best.groupBy("_q").agg(F.min_by(F.struct("tier", "n", "k"), "tier").alias("b"))
    status = F.when(F.col("b").isNull(), "unmatched").when(F.col("b.tier") == 3, "candidate").when(F.col("b.n") > 1, "conflict").otherwise("exact")
    return asked.join(top, "_q", "left").select(*queries.columns, F.col("b.tier").alias("tier"), F.coalesce("b.n", F.lit(0)).alias("n_candidates"), F.when(status == "exact", F.col("b.k")).alias("match"), status.alias("status"))


def _grams(text: Column, size: int) -> Column:
    """Distinct substrings of ``size`` characters; none of a shorter or null text."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame, needle: str, text: str) -> DataFrame:
    """(needle, text) of the distinct texts that contain a distinct non-empty needle literally.

    A needle fetches its candidates by an equi-join on that of its trigrams which the
    fewest texts have (a shorter needle by itself), with the exact test behind.
    """
    n = F.col(needle)
    wanted = needles.select(n, F.explode(F.when(F.length(n) < 3, F.array(n)).otherwise(_grams(n, 3))).alias("_gram")).filter("_gram != ''")
    held = texts.select(text, F.explode(F.concat(*(_grams(F.col(text), size) for size in (1, 2, 3)))).alias("_gram"))
    held = held.join(wanted.select("_gram").distinct(), "_gram", "left_semi")
    counts = held.groupBy("_gram").agg(F.count("*").alias("_n"))
    # a gram that no text has counts as zero and then fetches nothing
    rarest = wanted.join(counts, "_gram", "left").groupBy(needle).agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram"))
    return rarest.join(held, "_gram").filter(F.contains(F.col(text), n)).select(needle, text)


def first_hit(left: DataFrame, hits: DataFrame, on: list[str], order: list[str]) -> DataFrame:
    """``left`` with the first of its hits; unmatched rows stay with nulls and matched false."""
    best = first_per_key(hits, on, order).withColumn("_hit", F.lit(True))
    return left.join(best, on, "left").withColumn("matched", F.col("_hit").isNotNull()).drop("_hit")


def unambiguous(names: DataFrame, name: str, owner: str) -> DataFrame:
    """(name, owner) of the names that a single owner has."""
    return names.groupBy(name).agg(F.countDistinct(owner).alias("_n"), F.min(owner).alias(owner)).filter("_n = 1").drop("_n")


def tolerance_join(a: DataFrame, b: DataFrame, *, on: list[str], left: str, right: str, tolerance: float, ppm: bool = False) -> DataFrame:
    """Pairs of equal ``on`` whose values differ by at most the tolerance (absolute, or in millionths of their mean).

    Both sides are put in buckets as wide as the tolerance, so it is an equi-join on
    neighbouring buckets with the exact test applied again.
    """
    # a shade wider than the largest gap that passes, so a pair is never two buckets apart
    half = tolerance * 5e-7
    width = F.lit(math.log((1 + half) / (1 - half)) * (1 + 1e-9) + 1e-12 if ppm else tolerance * (1 + 1e-9) + 1e-9)
    at = lambda c: F.floor((F.ln(F.col(c)) if ppm else F.col(c)) / width)
    near = a.withColumn("_b", F.explode(F.array(*(at(left) + d for d in (-1, 0, 1)))))
    joined = near.join(b.withColumn("_b", at(right)), [*on, "_b"])
    gap = F.abs(F.col(left) - F.col(right))
    limit = F.lit(tolerance) if not ppm else (F.col(left) + F.col(right)) / 2 * tolerance * 1e-6
    return joined.filter(gap <= limit + 1e-12).drop("_b")


#: Rules up to which an overlay is written out in the plan; beyond, it is a join.
_LITERAL_RULES = 200


def range_overlay(df: DataFrame, rules: DataFrame, *, at: str, low: str, high: str, position: str) -> DataFrame:
    """``df`` with the first rule (by ``position``) whose range, of numbers, holds ``at``.

    A short list of rules is part of the plan.  A longer one is cut into steps as wide as
    its ranges are on average, which makes at most two rows a rule on average, and
    joined by step: a row meets the list of rules of its step.
    """
    fields = [c for c in rules.columns if c not in (low, high)]
    kept = [f for f in fields if f != position]
    if rules.limit(_LITERAL_RULES + 1).count() <= _LITERAL_RULES:
        held = [tuple(r) for r in rules.select(low, high, *fields).orderBy(position).collect()]
        kind = rules.select(*fields).schema.simpleString()
        out = F.lit(None).cast(kind)
        for lo, hi, *values in reversed(held):
            rule = F.struct(*(F.lit(v).alias(f) for v, f in zip(values, fields, strict=True))).cast(kind)
            out = F.when(F.col(at).between(lo, hi), rule).otherwise(out)
        return df.withColumn("_rule", out).select(*df.columns, *(F.col(f"_rule.{f}").alias(f) for f in kept))
    good = rules.filter(F.col(low) <= F.col(high))
    width = max(1, int(good.agg(F.avg(F.col(high) - F.col(low) + 1)).first()[0] or 1))
    step = lambda c: F.floor(F.col(c) / width)
    cut = good.withColumn("_step", F.explode(F.sequence(step(low), step(high))))
    listed = cut.groupBy("_step").agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("_p"), F.col(low).alias("_lo"), F.col(high).alias("_hi"), F.struct(*kept).alias("_v")))).alias("_rules"))
    joined = df.withColumn("_step", step(at)).join(listed, "_step", "left")
    first = F.get(F.filter("_rules", lambda r: F.col(at).between(r["_lo"], r["_hi"])), 0)
    return joined.withColumn("_rule", first["_v"]).select(*df.columns, *(F.col(f"_rule.{f}").alias(f) for f in kept))


def mismatches(expected: DataFrame, actual: DataFrame, key: str, checks: list[tuple[str, Column]]) -> DataFrame:
    """key and issues of every expected row that is missing or fails a check (columns of both sides are in scope)."""
    joined = expected.join(actual.withColumn("_there", F.lit(True)), key, "left")
    there = F.col("_there").isNotNull()
    issues = F.array_compact(F.array(F.when(~there, "missing"), *(F.when(there & bad, label) for label, bad in checks)))
    return joined.select(key, F.array_join(issues, ";").alias("issues")).filter("issues <> ''")


def expand(seeds: DataFrame, edges: list[tuple[DataFrame, str, str]], verified: Column) -> DataFrame:
    """Nodes reached from verified seeds over edge tables in turn, one hop each: (seed, depth, node).  Seeds not verified reach nothing."""
    step = seeds.filter(verified).select("seed", F.col("seed").alias("node"))
    out = None
    for depth, (table, source, target) in enumerate(edges, 1):
        step = step.join(table.select(F.col(source).alias("node"), F.col(target).alias("_next")).distinct(), "node").select("seed", F.col("_next").alias("node")).distinct()
        level = step.withColumn("depth", F.lit(depth))
        out = level if out is None else out.unionByName(level)
    return out


def matched_greedily(pairs: DataFrame, keys: list[str], *, a: str, b: str, order: list[str]) -> DataFrame:
    """One-to-one matches of each key: pairs are taken in ``order`` if neither side is taken yet.

    Each key's candidate pairs are folded in one row, which suits lists of up to some
    thousands of candidates, such as the peaks of two spectra.
    """
    listed = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(a).alias("_a"), F.col(b).alias("_b")))).alias("_all"))
    kind = "array<struct<a:bigint,b:bigint>>"

    def take(state: Column, p: Column) -> Column:
        free = ~F.exists(state, lambda m: (m["a"] == p["_a"]) | (m["b"] == p["_b"]))
        return F.when(free, F.concat(state, F.array(F.struct(p["_a"].cast("bigint").alias("a"), p["_b"].cast("bigint").alias("b"))))).otherwise(state)

    out = listed.select(*keys, F.explode(F.aggregate("_all", F.array().cast(kind), take)).alias("m"))
    return out.select(*keys, F.col("m.a").alias(a), F.col("m.b").alias(b))


def page(df: DataFrame, order: list[Column], number: int, size: int = 25) -> DataFrame:
    """One page of a sorted table with each row's ``pos``; the page number is held within what there is."""
    total = df.count()
    number = max(1, min(number, -(-total // size) or 1))
    top = df.orderBy(*order).limit(number * size)
    ranked = top.withColumn("pos", F.row_number().over(Window.orderBy(*order)))
    return ranked.filter(F.col("pos") > (number - 1) * size)
