"""Mass spectra: normalisation, filters, licences, compatibility and comparison of two peak lists in one row."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sillage.operators.rollup import cosine

PEAKS = "array<struct<mz:double,intensity:double>>"


def peak_filter(value: Column, asked: str) -> Column:
    """``a-b`` (either order) is an inclusive range; anything else is looked for in the number's text."""
    found = re.fullmatch(r"\s*([0-9.]+)\s*-\s*([0-9.]+)\s*", asked)
    if found:
        low, high = sorted(map(float, found.groups()))
        return value.cast("double").between(low, high)
    return value.cast("string").contains(asked.strip())


def ion_mode(mode: Column) -> Column:
    low = F.lower(F.trim(mode))
    return F.when(low.startswith("pos") | (low == "+"), "positive").when(low.startswith("neg") | (low == "-"), "negative")


def adduct(name: Column, mode: Column) -> Column:
    """An adduct in brackets with its charge's sign."""
    bare = F.trim(name)
    closed = F.when(bare.startswith("["), bare).otherwise(F.concat(F.lit("["), bare, F.lit("]")))
    return F.when(closed.rlike(r"[+-]$"), closed).otherwise(F.concat(closed, F.when(ion_mode(mode) == "negative", "-").otherwise("+")))


def normalise(peaks: Column) -> Column:
    """Valid peaks, equal m/z added up, in percent of the base peak (half-even, six places), sorted by m/z."""
    good = F.filter(peaks, lambda p: (p["mz"] > 0) & (p["intensity"] > 0) & ~F.isnan(p["mz"]) & ~F.isnan(p["intensity"]) & (p["mz"] < float("inf")) & (p["intensity"] < float("inf")))

    def merged(g: Column) -> Column:
        places = F.array_sort(F.array_distinct(F.transform(g, lambda p: p["mz"])))
        total = lambda mz: F.aggregate(F.filter(g, lambda p: p["mz"] == mz), F.lit(0.0), lambda s, p: s + p["intensity"])
        return F.transform(places, lambda mz: F.struct(mz.alias("mz"), total(mz).alias("intensity")))

    def scaled(g: Column) -> Column:
        top = F.array_max(F.transform(g, lambda p: p["intensity"]))
        return F.transform(F.array(top), lambda t: F.transform(g, lambda p: F.struct(p["mz"].alias("mz"), F.bround(p["intensity"] / t * 100, 6).alias("intensity"))))[0]

    return F.transform(F.transform(F.array(good), merged), scaled)[0]


def candidates(a: Column, b: Column, tolerance: float, ppm: bool = False) -> Column:
    """All index pairs within the tolerance: structs of gap, minus the smaller intensity, a, b, in greedy order."""

    def pair(p: Column, i: Column) -> Column:
        def other(q: Column, j: Column) -> Column:
            gap = F.abs(p["mz"] - q["mz"])
            limit = (p["mz"] + q["mz"]) / 2 * tolerance * 1e-6 if ppm else F.lit(tolerance)
            return F.when(gap <= limit + 1e-12, F.struct(gap.alias("gap"), (-F.least(p["intensity"], q["intensity"])).alias("minus"), i.alias("a"), j.alias("b"), p["intensity"].alias("ia"), q["intensity"].alias("ib")))

        return F.array_compact(F.transform(b, other))

    return F.array_sort(F.flatten(F.transform(a, pair)))


def greedy(pairs: Column) -> Column:
    """One-to-one matches: pairs in order, each taken if both its peaks are free."""
    kind = "array<struct<gap:double,minus:double,a:int,b:int,ia:double,ib:double>>"
    free = lambda s, p: ~F.exists(s, lambda m: (m["a"] == p["a"]) | (m["b"] == p["b"]))
    return F.aggregate(pairs, F.array().cast(kind), lambda s, p: F.when(free(s, p), F.concat(s, F.array(p))).otherwise(s))


def compare(a: Column, b: Column, *, tolerance: float, ppm: bool = False, kind_a: Column | None = None, kind_b: Column | None = None) -> Column:
    """struct(similarity, matched, coverage_a, coverage_b, matches) of two normalised peak lists.

    Spectra of different kinds (such as EI and MS2) are not compared: similarity null, no matches.
    """
    alike = F.lit(True) if kind_a is None or kind_b is None else F.coalesce(kind_a == kind_b, F.lit(False))
    matches = F.when(alike, greedy(candidates(a, b, tolerance, ppm))).otherwise(F.array().cast("array<struct<gap:double,minus:double,a:int,b:int,ia:double,ib:double>>"))

    def result(m: Column) -> Column:
        products = F.transform(m, lambda x: F.struct(x["ia"].alias("a"), x["ib"].alias("b")))
        level = lambda peaks: F.transform(peaks, lambda p: p["intensity"])
        return F.struct(
            F.when(alike, cosine(products, level(a), level(b))).alias("similarity"),
            F.size(m).alias("matched"),
            F.try_divide(F.size(m).cast("double"), F.size(a)).alias("coverage_a"),
            F.try_divide(F.size(m).cast("double"), F.size(b)).alias("coverage_b"),
            F.transform(m, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["gap"].alias("delta"))).alias("matches"),
        )

    return F.transform(F.array(matches), result)[0]


def compatibility(a: dict[str, Column], b: dict[str, Column], fields: tuple[str, ...] = ("ion_mode", "adduct", "ionization", "collision_energy")) -> Column:
    """struct(blocked, warnings): spectra of different kinds can't be compared; other differences are warned of."""
    blocked = F.when(~F.coalesce(a["kind"] == b["kind"], F.lit(False)), F.lit("different_kind"))
    warned = F.array_compact(F.array(*(F.when(F.coalesce(a[f] != b[f], F.lit(False)), f) for f in fields if f in a and f in b)))
    return F.struct(blocked.alias("blocked"), warned.alias("warnings"))


def licence(name: Column, status: Column, blocked: tuple[str, ...] = ("needs_review", "restricted", "unknown")) -> Column:
    """struct(download, attribution): whether a record may be downloaded, and whether its source must be named."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    free = low.startswith("cc0") | low.contains("public domain") | low.startswith("pddl")
    allowed = ~F.coalesce(status.isin(*blocked), F.lit(False)) & (free | low.startswith("cc "))
    return F.struct(allowed.alias("download"), (allowed & ~(low.startswith("cc0") | low.contains("public domain"))).alias("attribution"))


def as_msp(name: Column, fields: dict[str, Column], peaks: Column) -> Column:
    """A spectrum as MSP text."""
    lines = [F.concat(F.lit("Name: "), name), *(F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items())]
    rows = F.array_join(F.transform(peaks, lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))), "\n")
    return F.concat_ws("\n", *lines, F.concat(F.lit("Num Peaks: "), F.size(peaks).cast("string")), rows)


def as_mgf(title: Column, precursor: Column, peaks: Column) -> Column:
    """A spectrum as an MGF block."""
    rows = F.array_join(F.transform(peaks, lambda p: F.concat_ws(" ", p["mz"].cast("string"), p["intensity"].cast("string"))), "\n")
    return F.concat_ws("\n", F.lit("BEGIN IONS"), F.concat(F.lit("TITLE="), title), F.concat(F.lit("PEPMASS="), precursor.cast("string")), rows, F.lit("END IONS"))


def as_csv(peaks: Column) -> Column:
    """Peaks as CSV with a header."""
    rows = F.transform(peaks, lambda p: F.concat_ws(",", p["mz"].cast("string"), p["intensity"].cast("string")))
    return F.concat_ws("\n", F.lit("mz,intensity"), F.array_join(rows, "\n"))


def exported(licensed: Column, text: Column) -> Column:
    """The text if the licence allows a download; asking for another is an error."""
    return F.when(licensed["download"], text).otherwise(F.raise_error(F.lit("the licence does not allow a download")).cast("string"))


def comparison_json(compared: Column, tolerance: float, ppm: bool, a: Column, b: Column) -> Column:
    """A comparison as JSON: metrics, matches, tolerance, and where both spectra came from."""
    return F.to_json(F.struct(F.struct(F.lit(tolerance).alias("value"), F.lit("ppm" if ppm else "Da").alias("mode")).alias("tolerance"), compared.alias("result"), a.alias("a"), b.alias("b")))
