"""Bottom-k sketches of shingle hashes as SQL expressions.

A sketch is the sorted list of the k smallest distinct 64-bit hashes of a text's word
shingles.  Sketches merge by taking the k smallest of their union, so parts of a corpus
can be sketched apart.  They estimate the distinct shingles of a text, and the
resemblance and containment of two.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, WIDTH = 128, 5
_SPACE = r"[\x20\x09-\x0D]+"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)``, with the value worked out once and not again for every element."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, A-Z lower-cased; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(plain, _SPACE), lambda w: w != "")


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The k smallest hashes of the text's shingles, sorted; empty for a text without words.

    A text with fewer words than ``width`` has its whole sequence as one shingle.
    """
    return _let(words(text), lambda w: _of_words(w, k, width))


def _of_words(w: Column, k: int, width: int) -> Column:
    count = F.size(w)

    def at(i: Column) -> Column:
        return F.xxhash64(*(F.get(w, i + j) for j in range(width)))

    hashes = F.transform(F.sequence(F.lit(0), F.greatest(count - width, F.lit(0))), at)
    return F.when(count > 0, F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)).otherwise(F.array().cast("array<bigint>"))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of both texts' shingles together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all of both, 0 to 1; two empty sketches are alike, one is unlike."""
    def share(low: Column) -> Column:
        return F.when(F.size(low) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(low, a), b)) / F.size(low))

    return _let(merge(a, b, k), share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1; 1 for an empty a."""
    both = resemblance(a, b, k) * distinct(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct(a, k), F.lit(1.0))))


def distinct(a: Column, k: int = K) -> Column:
    """Estimated distinct shingles: exact below k, else from how far the k-th hash lies up the range."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def as_text(a: Column) -> Column:
    """The sketch as a string of 16 hex digits a hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def _bounds(docs: DataFrame, doc_id: str, parts: int) -> list[int]:
    """Up to ``parts`` doc_ids that cut the table into runs of about equal length."""
    shares = [i / parts for i in range(1, parts)]
    found = docs.select(F.percentile_approx(F.col(doc_id).cast("long"), F.array(*map(F.lit, shares)), F.lit(20 * parts)).alias("b"), F.min(F.col(doc_id).cast("long")).alias("low")).first()
    return sorted({b for b in found["b"] or [] if b > found["low"]})


def with_next(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", extra: dict[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """Every row with the next document's values: doc_id, text, ``extra``, next_text and next_ of each extra.

    The next document is that with the next greater doc_id, and after the last the
    first; a null id comes before all, and rows with equal ids follow in the order of
    their texts' hashes.  Runs of ids are sorted apart: the first document of each run
    is sent to the end of the run before as well, so no global order is needed.
    """
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, doc_id, parts)
    extra = extra or {}
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"), *(c.alias(n) for n, c in extra.items()))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    low = docs.agg(F.min(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63))))).first()[0]
    cuts = F.array(*map(F.lit, bounds)).cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    run = F.size(F.filter(cuts, lambda b: b <= order))
    first = F.when(F.array_contains(cuts, order), F.struct((run - 1).alias("run"), F.lit(1).alias("sent")))
    wrap = F.when(order == F.lit(low), F.struct(F.lit(len(bounds)).alias("run"), F.lit(2).alias("sent")))
    places = F.array_compact(F.array(F.struct(run.alias("run"), F.lit(0).alias("sent")), first, wrap))
    placed = rows.withColumn("_place", F.explode(places)).withColumn("_order", order)
    window = Window.partitionBy("_place.run").orderBy("_place.sent", "_order", F.xxhash64("text"))
    following = placed.select("doc_id", "text", *extra, F.lead("text").over(window).alias("next_text"), *(F.lead(n).over(window).alias(f"next_{n}") for n in extra), F.col("_place.sent").alias("_sent"))
    return following.filter("_sent = 0").drop("_sent")


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = K, width: int = WIDTH) -> DataFrame:
    """doc_id, sketch and estimated distinct shingles (n_distinct) of every row's whole text.

    Null and empty texts have an empty sketch.  Rows are independent; other columns are
    not read.
    """
    out = docs.select(F.col(doc_id).cast("long").alias("doc_id"), sketch(F.col(text).cast("string"), k, width).alias("sketch"))
    return out.withColumn("n_distinct", distinct(F.col("sketch"), k))
