"""Near-duplicate groups by SuperMinHash, banding, exact verification and union-find.

1.  Every whole text gets its shingle set's signature and band keys; documents with
    equal sets are one class, represented by the smallest doc_id.
2.  Representatives that share a band key are one bucket.  In each bucket the member
    that meets the most others (over all buckets) is the hub, and every other member is
    compared with it on full sets: as many comparisons as members, never all pairs.
3.  Buckets that still hold several components could hide a link between two members
    neither of which is the hub.  Their members go through an exact prefix filter: with
    shingles ordered from the rarest, two sets that similar must share one among their
    first ``n - ceil(t n) + 1``.  Positions and sizes bound the overlap: classes of
    equal size and position are matched before any pair is listed, and pairs already in
    one component are left out.  What remains is verified on full sets.
4.  Components of the verified links give the groups.

With 32 bands of 4 values a pair at similarity 0.75 shares no band with probability
under 6e-6; step 3 adds no further miss.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sillage.llm.arrow import small_batches, tidy
from sillage.llm.components import connected_components
from sillage.llm.scratch import Scratch, private, small
from sillage.llm.shingles import WordHashes, band_keys, shingle_set, superminhash

#: Texts hashed together, by count and by characters.
_CHUNK_ROWS, _CHUNK_CHARS = 128, 200_000


def _chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of whole texts of a batch, bounded in rows and (but for one long text) characters."""
    column, start, held, chars = batch.column(text), 0, [], 0
    for i in range(len(column)):
        value = column[i].as_py()
        held.append(value)
        chars += len(value or "")
        if len(held) >= _CHUNK_ROWS or chars >= _CHUNK_CHARS:
            yield start, held
            start, held, chars = i + 1, [], 0
    if held:
        yield start, held


def signatures(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5, bands: int = 32, rows: int = 4) -> DataFrame:
    """doc_id, n_shingles, set_key (null for an empty set) and band keys of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for start, texts in _chunks(batch, 1):
                sets = [shingle_set(t, memo, width) for t in texts]
                keys = band_keys(superminhash(sets, bands * rows), rows)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = sizes > 0
                offsets = np.concatenate([[0], np.cumsum(np.where(full, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        pa.array(sizes),
                        pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel())),
                    ],
                    ["doc_id", "n_shingles", "set_key", "bands"],
                )

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(tidy(sign), "doc_id long, n_shingles long, set_key binary, bands array<long>")


def verified(pairs: DataFrame, texts: DataFrame, *, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach ``percent`` similarity.

    ``texts`` has one row (doc_id, text) for each document that occurs in a pair.
    """

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            pa.default_memory_pool().release_unused()
            a_ids, b_ids, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, a in enumerate(a_ids):
                if last[0] != a:
                    last = (a, shingle_set(batch.column(2)[i].as_py(), memo, width))
                left, right = last[1], shingle_set(batch.column(3)[i].as_py(), memo, width)
                shared = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(shared > 0 and 100 * shared >= percent * (len(left) + len(right) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(tidy(check), "a long, b long")


def _texts_of(docs: DataFrame, ids: DataFrame, text: str, doc_id: str, classes: DataFrame | None = None) -> DataFrame:
    """(doc_id, text) of the documents in ``ids``; of repeated rows with one doc_id, the greatest text."""
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.join(small(ids), "doc_id", "left_semi")


#: A shingle is hot beyond this count and beyond this share of all shingle rows, so there can't be over 100,000 hot ones.
_HOT_ROWS, _HOT_SHARE = 200, 1e-5


def _with_counts(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """``sets`` (rep, n, shingle) with df, how many sets have the shingle; those that one set alone has are left out.

    Counts are added up before the shuffle.  Hot shingles get theirs by broadcast, so
    that no task meets all rows of one; the rest are joined by a shuffle.
    """
    counted = scratch.save(sets.groupBy("shingle").agg(F.count("*").alias("df")).filter("df > 1"))
    limit = max(_HOT_ROWS, int(_HOT_SHARE * (counted.agg(F.sum("df")).first()[0] or 0)))
    hot, rest = counted.filter(F.col("df") > limit), counted.filter(F.col("df") <= limit)
    hot_rows = sets.join(F.broadcast(hot), "shingle")
    rest_rows = sets.join(F.broadcast(hot.select("shingle")), "shingle", "left_anti").join(rest, "shingle")
    return hot_rows.unionByName(rest_rows)


def _prefix_postings(members: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """(rep, n, shingle, rank, component) of each set's first ``n - ceil(t n) + 1`` elements, from the rarest.

    ``sets`` needs no rows for elements that only one set has: they come first in the
    order, so a set's rank goes up by as many as it lacks.
    """
    shared = scratch.save(_with_counts(scratch.save(sets), scratch))
    order = Window.partitionBy("rep").orderBy("df", "shingle")
    own = Window.partitionBy("rep")
    ranked = shared.withColumn("rank", F.row_number().over(order) + F.col("n") - F.count("*").over(own)).filter(f"rank <= n - ceil({percent} * n / 100) + 1")
    return scratch.save(ranked.join(members, "rep").select("rep", "n", "shingle", "rank", "component"))


def _prefix_pairs(members: DataFrame, sets: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Pairs (a, b) across components whose sets can reach ``percent`` similarity; none that can is missing.

    ``members``: (rep, component); ``sets``: (rep, n, shingle), a row for each element.

    Whether two postings of a shingle can belong to a similar pair follows from their
    sets' sizes and ranks alone: before the first shared element the smaller set may
    have at most so many, and the overlap that is left must do.  So postings are first
    counted by (shingle, n, rank), these classes are matched, and only members of
    matching classes are listed as pairs: a passage that thousands of otherwise unlike
    sets share comes to a few rows a class and no pairs.
    """
    postings = _prefix_postings(members, sets, scratch, percent)
    classes = postings.groupBy("shingle", "n", "rank").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    # of the smaller set, an element must leave enough for a partner of the same size
    small_side = classes.filter(f"{100 + percent} * (1 + n - rank) >= {2 * percent} * n")
    # sizes that can be similar lie in the same or in neighbouring steps of a scale of that ratio
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / percent)) + 1e-9).cast("int")
    x = small_side.withColumn("step", F.explode(F.array(step, step + 1))).select("shingle", "step", *(F.col(c).alias(f"x_{c}") for c in ("n", "rank", "lo", "hi")))
    y = classes.withColumn("step", step).select("shingle", "step", *(F.col(c).alias(f"y_{c}") for c in ("n", "rank", "lo", "hi")))
    fits = f"""x_n <= y_n and 100 * x_n >= {percent} * y_n and {100 + percent} * (1 + least(x_n - x_rank, y_n - y_rank)) >= {percent} * (x_n + y_n)
        and not (x_lo = x_hi and y_lo = y_hi and x_lo = y_lo)"""
    matched = scratch.save(x.join(y, ["shingle", "step"]).filter(fits).select("shingle", "x_n", "x_rank", "y_n", "y_rank"))
    if matched.isEmpty():
        return matched.select(F.col("shingle").alias("a"), F.col("shingle").alias("b"))
    left = postings.select("shingle", F.col("n").alias("x_n"), F.col("rank").alias("x_rank"), F.col("rep").alias("x_rep"), F.col("component").alias("x_component"))
    right = postings.select("shingle", F.col("n").alias("y_n"), F.col("rank").alias("y_rank"), F.col("rep").alias("y_rep"), F.col("component").alias("y_component"))
    joined = matched.join(left, ["shingle", "x_n", "x_rank"]).join(right, ["shingle", "y_n", "y_rank"]).filter("x_component <> y_component")
    return joined.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def _shingle_rows(texts: DataFrame, width: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in batches:
            for start, held in _chunks(batch, 1):
                sets = [shingle_set(t, memo, width) for t in held]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32))
                flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(held)), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["rep", "shingles"])

    sets = texts.mapInArrow(tidy(split), "rep long, shingles array<long>")
    # a row for each element
    return sets.select("rep", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("shingle"))


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", width: int = 5, percent: int = 75, bands: int = 32, rows: int = 4) -> DataFrame:
    """Near-duplicate groups of whole texts: doc_id, n_shingles, component_id, kept.

    Two documents are linked if ``100 * |A & B| >= percent * |A | B|`` of their shingle
    sets; ``component_id`` is the smallest doc_id reachable over links, ``kept`` says
    that this is the document's own.  One row comes back for every row of ``docs``;
    other columns are not read.

    Null, empty or word-less texts have no shingles, are linked with nothing and kept.
    Rows with a null doc_id take no part: component_id null, kept true.  Repeated rows
    are equal sets; rows that share a doc_id share its group.  An empty table gives an
    empty result.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, text, doc_id, width, percent, bands, rows)


def _near_duplicates(docs: DataFrame, text: str, doc_id: str, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    scratch = Scratch(docs.sparkSession, "minhash")
    signed = scratch.save(signatures(docs, text=text, doc_id=doc_id, width=width, bands=bands, rows=rows))
    classes = scratch.save(signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")))
    keys = classes.select("rep", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    members = scratch.save(keys.join(buckets, "key"))
    degrees = members.groupBy("rep").agg(F.sum("size").alias("degree"))
    hubs = members.join(degrees, "rep").groupBy("key").agg(F.max(F.struct("degree", (-F.col("rep")).alias("minus"))).alias("hub"))
    stars = members.join(hubs, "key").select((-F.col("hub.minus")).alias("a"), F.col("rep").alias("b")).filter("a <> b").distinct()
    stars = scratch.save(stars)
    touched = scratch.save(stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct())

    def texts_of(ids: DataFrame) -> DataFrame:
        return _texts_of(docs, ids, text, doc_id).groupBy("doc_id").agg(F.max("text").alias("text")) if repeated else _texts_of(docs, ids, text, doc_id)

    repeated = signed.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count() > 0
    links = scratch.save(verified(stars, texts_of(touched), width=width, percent=percent))
    found = connected_components(links, scratch)

    placed = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("size").alias("size")).filter("lo <> hi and size > 2").select("key")
    unsure = scratch.save(placed.join(mixed, "key", "left_semi").select("rep", "component").distinct())
    if not unsure.isEmpty():
        there = texts_of(unsure.select(F.col("rep").alias("doc_id")))
        pairs = scratch.save(_prefix_pairs(unsure, _shingle_rows(there, width), scratch, percent))
        if not pairs.isEmpty():
            ends = scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
            more = verified(pairs, texts_of(ends), width=width, percent=percent)
            stars_so_far = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
            found = connected_components(stars_so_far.union(more), scratch)

    groups = classes.select("set_key", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    groups = groups.select("set_key", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key")).join(groups, "set_key", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return scratch.only(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows of documents whose group keeps another document; all columns stay.

    Options and edge cases are those of ``near_duplicates``.
    """
    name, gone = options.get("doc_id", "doc_id"), private("gone")
    scratch = Scratch(docs.sparkSession, "dedup")
    judged = near_duplicates(docs, **options)
    dropped = scratch.save(judged.filter("not kept").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(small(dropped), F.col(f"`{name}`").cast("long") == F.col(gone), "left_anti")
