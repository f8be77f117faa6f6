"""Ranked lexical search over a tiered index.

Documents lie in blocks, each with its own term lists, as in the shards of a search
engine.  A block's postings lie in tiers by impact, a posting's exact share of a score, and
within a tier in buckets by term.  A query item first reads its terms' upper tiers only: a
document's score is then at least what was found and at most that plus, for each of the
item's terms not yet met in it, the term's residual, the largest impact that it can have
below.  If by these bounds no document but a few can be among the best, the item is proven
and its scores are completed in the blocks of those few alone; an item that lacks the proof
falls through to the next tier, and in the end to all postings of all blocks.  A tier is read
once: what a pass takes from it is kept for the steps below.  Results are exact either way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sillage.llm.arrow import pack, release, tidy, unpack
from sillage.llm.scratch import Scratch, small

#: A block ends with so many documents or words; bytes of a text that are split at a time (cut between terms).
BLOCK_DOCS, BLOCK_WORDS, SLICE_BYTES = 8_192, 2_000_000, 4_000_000
#: Tiers begin at these shares of the greatest impact that a posting can have; the last takes the rest.
TIERS = (0.25, 0.0625)
#: Buckets of terms within a tier, and bytes of text whose terms are counted in one part, about.
BUCKETS, PART_BYTES = 32, 16_000_000
#: Query items of a pass, whose terms are held by every task; documents that a block reports for an item before it is proven.
ITEMS_A_PASS, REPORTED = 500, 16
#: Cells that a task reads, about.  They lie in many small files, of which a scan gives few to a task; its start then costs more than its work.
CELLS_A_TASK = 64
#: Weight of a document's length in per cent, and the pace at which repeats stop counting, in thousandths.
LENGTH_SHARE, SATURATION = 75, 8
#: No posting has a larger share of its term's weight than this.
LARGEST = 1_000_000

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_BREAKS = bytes(0x20 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


def _terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a whole text, A-Z lower-cased."""
    data, start = text.lower().translate(_BREAKS), 0
    while start < len(data):
        end = data.find(b" ", start + SLICE_BYTES)
        end = len(data) if end < 0 else end
        yield data[start:end].split()
        start = end


class _Codes(dict):
    def __missing__(self, term: bytes) -> int:
        code = self[term] = len(self)
        return code


def _place(term: bytes, parts: int) -> int:
    return xxhash.xxh3_64_intdigest(term) % parts


#: A block's terms that fall to one part with their postings, or (part null) its documents' ids and lengths as docs and times.
_MADE = "block string, part int, terms array<string>, counts binary, docs binary, times binary"
#: A part's terms and in how many documents each is (block null), or these numbers for a block's terms in the part.
_NAMED = "block string, part int, terms array<string>, df array<bigint>"
_CELL = "block string, terms array<string>, weights binary, counts binary, docs binary, shares binary, bucket int, tier int"


def _blocks_in(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("block", pa.string()), ("part", pa.int32()), ("terms", pa.list_(pa.string())), *((c, pa.binary()) for c in ("counts", "docs", "times"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        known, keys, runs, sizes, words = _Codes(), [], [], [], 0

        def flush() -> pa.RecordBatch:
            name, key, size = f"{task}-{made}", np.array(keys, np.int64), np.array(sizes, np.int64)
            order = np.argsort(key, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            # terms stand by part; a term's postings by document
            part = np.fromiter((_place(t, parts) for t in known), np.int64, len(known))
            by_part = np.argsort(part, kind="stable")
            rank = np.empty(len(part), np.int64)
            rank[by_part] = np.arange(len(part))
            postings, times = np.unique(rank[np.concatenate(runs)] * len(key) + np.repeat(place, size), return_counts=True)
            code, doc = postings // len(key), postings % len(key)
            counts = np.bincount(code, minlength=len(part))
            filled, starts = np.unique(part[by_part], return_index=True)
            starts = np.append(starts, len(part))
            ends = np.concatenate([[0], np.cumsum(counts)])[starts]
            cuts = list(zip(starts[:-1], starts[1:], ends[:-1], ends[1:], strict=True))
            terms = pa.array(list(known), pa.binary()).cast(pa.string()).take(pa.array(by_part))
            columns = [
                pa.array([name] * (len(filled) + 1)),
                pa.array([None, *filled.tolist()], pa.int32()),
                pa.ListArray.from_arrays(pa.array([0, *starts], pa.int32()), terms),
                pa.array([None, *(pack(counts[a:b]) for a, b, _, _ in cuts)], pa.binary()),
                pa.array([pack(key[order]), *(pack(doc[a:b]) for _, _, a, b in cuts)], pa.binary()),
                pa.array([pack(size[order]), *(pack(times[a:b]) for _, _, a, b in cuts)], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        for batch in batches:
            pa.default_memory_pool().release_unused()
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [np.fromiter(map(known.__getitem__, run), np.int64, len(run)) for run in _terms(text.as_py() or b"")]
                keys.append(key)
                runs += found
                sizes.append(sum(map(len, found)))
                words += sizes[-1]
                if len(keys) >= BLOCK_DOCS or words >= BLOCK_WORDS:
                    if words:
                        yield flush()
                        made += 1
                    known, keys, runs, sizes, words = _Codes(), [], [], [], 0
        if words:
            yield flush()

    return run


def _counted(group: pa.Table) -> pa.Table:
    """All blocks' terms of a part -> in how many documents each is, for the part and for each block."""
    listed = group.column("terms").combine_chunks()
    coded = listed.flatten().dictionary_encode()
    codes, counts = coded.indices.to_numpy(), np.concatenate([unpack(x) for x in group.column("counts").to_pylist()])
    total = np.bincount(codes, weights=counts, minlength=len(coded.dictionary)).astype(np.int64)
    ends = np.cumsum(listed.value_lengths().to_numpy())
    rows = group.num_rows + 1
    columns = {
        "block": pa.array([None, *group.column("block").to_pylist()], pa.string()),
        "part": pa.array([group.column("part")[0].as_py()] * rows, pa.int32()),
        "terms": pa.ListArray.from_arrays(pa.array([0] + [len(total)] * rows, pa.int32()), coded.dictionary),
        "df": pa.ListArray.from_arrays(pa.array([0, *(len(total) + np.array([0, *ends]))], pa.int32()), pa.array(np.concatenate([total, total[codes]]))),
    }
    release()
    return pa.table(columns)


def weight_of(df: np.ndarray, documents: int) -> np.ndarray:
    """A term's weight by the number of documents that hold it."""
    return np.floor(1000 * np.log((2 * documents + 2) / (2 * df + 1))).astype(np.int64)


def _tiered(documents: int, words: int, edges: list[int]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block's postings and its terms' counts of documents -> its cells by tier and bucket."""

    def run(block: pa.Table, named: pa.Table) -> pa.Table:
        own = block.filter(pc.is_valid(block.column("part"))).sort_by("part")
        name = block.column("block")[0].as_py()
        size = unpack(block.filter(pc.is_null(block.column("part"))).column("times")[0].as_py())
        listed = own.column("terms").combine_chunks()
        terms = listed.flatten()
        counts, docs, times = (np.concatenate([unpack(x) for x in own.column(c).to_pylist()]) for c in ("counts", "docs", "times"))
        weights = weight_of(named.sort_by("part").column("df").combine_chunks().flatten().to_numpy(), documents)
        m = 100 - LENGTH_SHARE + (LENGTH_SHARE * size * documents) // words
        shares = (1_000_000_000 * times) // (1000 * times + SATURATION * m[docs])
        term = np.repeat(np.arange(len(counts)), counts)
        impact = weights[term] * shares
        tier = np.zeros(len(impact), np.uint16)
        for edge in edges:
            tier += impact < edge
        # parts are a multiple of the buckets
        bucket = np.repeat(own.column("part").to_numpy() % BUCKETS, listed.value_lengths().to_numpy()).astype(np.uint16)
        cell = tier * np.uint16(BUCKETS) + bucket[term]
        order = np.argsort(cell, kind="stable")  # terms and documents keep their order
        cells, starts = np.unique(cell[order], return_index=True)
        taken, packed = [], []
        for at in np.split(order, starts[1:]):
            here = term[at]
            first = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            taken.append(here[first])
            packed.append(tuple(map(pack, (weights[here[first]], np.diff(np.append(first, len(at))), docs[at], shares[at]))))
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in taken])])
        release()
        return pa.table({
            "block": pa.array([name] * len(cells)),
            "terms": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), terms.take(pa.array(np.concatenate(taken)))),
            **{c: pa.array(x, pa.binary()) for c, x in zip(("weights", "counts", "docs", "shares"), zip(*packed, strict=True), strict=True)},
            "bucket": pa.array(cells % BUCKETS, pa.int32()),
            "tier": pa.array(cells // BUCKETS + 1, pa.int32()),
        })

    return run


@dataclass
class Index:
    """cells (block, terms, weights, counts, docs, shares; in folders by bucket and tier), blocks (block, ids), terms (term, df).

    ``edges`` are the impacts at which tiers begin; the postings of tier t have less than
    edge t - 2 and at least edge t - 1.
    """

    cells: DataFrame
    blocks: DataFrame
    terms: DataFrame
    documents: int
    edges: list[int]
    scratch: Scratch


def build_index(docs: DataFrame, *, key: str = "doc_id", text: str = "text", tiers: tuple[float, ...] = TIERS) -> Index:
    """The tiered index of all documents, written.

    Rows with a null key can't be named in a result and are left out, also of the
    statistics; rows that repeat a key are documents of their own.  Null and empty texts
    have no terms and don't count.
    """
    spark, scratch, steps = docs.sparkSession, Scratch(docs.sparkSession, "search-index"), Scratch(docs.sparkSession, "search-blocks")
    source = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").cast("binary").alias("text")).filter("key is not null")
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = BUCKETS * max(1, -(-max(size, PART_BYTES * spark.sparkContext.defaultParallelism) // (BUCKETS * PART_BYTES)))
    made = steps.save(source.mapInArrow(tidy(_blocks_in(parts)), _MADE))
    spans = steps.save(made.filter("part is null").select("block", F.col("docs").alias("ids"), F.col("times").alias("sizes")).mapInArrow(tidy(_opened), "block string, ids array<bigint>, documents bigint, words bigint"))
    documents, words = spans.agg(F.coalesce(F.sum("documents"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    named = steps.save(made.filter("part is not null").select("block", "part", "terms", "counts").groupBy("part").applyInArrow(_counted, _NAMED))
    greatest = LARGEST * float(np.log(2 * documents + 2)) * 1000
    edges = [int(greatest * t) for t in tiers]
    mine = named.filter("block is not null").select("block", "part", "df")
    cells = scratch.save(made.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(_tiered(documents, max(words, 1), edges), _CELL), by=["bucket", "tier"])
    listed = named.filter("block is null").select(F.explode(F.arrays_zip("terms", "df")).alias("x"))
    terms = scratch.save(listed.select(F.col("x.terms").alias("term"), F.col("x.df").alias("df")))
    blocks = scratch.save(spans.select("block", "ids"))
    steps.drop()
    return Index(cells, blocks, terms, documents, edges, scratch)


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks' ids as lists, with their documents that have a term and all their words."""
    for batch in batches:
        ids, sizes = ([unpack(x) for x in batch.column(c).to_pylist()] for c in (1, 2))
        columns = [pa.array(ids, pa.list_(pa.int64())), pa.array([int((x > 0).sum()) for x in sizes], pa.int64()), pa.array([int(x.sum()) for x in sizes], pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["block", "ids", "documents", "words"])


def item_terms(items: DataFrame, *, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, term, times) of query items; of rows with one id the greatest text counts, null ids are left out."""
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    one = items.filter(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`").alias("item")).agg(F.max(F.col(f"`{text}`").cast("string")).alias("text"))
    found = one.select("item", F.explode(F.regexp_extract_all(F.translate("text", capitals, capitals.lower()), F.lit(TERM), F.lit(0))).alias("term"))
    return found.groupBy("item", "term").agg(F.count("*").alias("times"))


#: What a block reports: an item's place in the pass, a document with its bounds, or (null doc) the greatest bound of all others.
_REPORT = "item int, block string, doc_id long, low long, high long"


#: A cell's postings of a pass's terms.
_PICKED = "block string, numbers binary, counts binary, docs binary, impacts binary"


def _picked(wanted: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Cells -> the postings of the terms ``wanted``: their places in it, how many each has, documents and impacts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(wanted, pa.string())
        for batch in batches:
            pa.default_memory_pool().release_unused()
            ends = np.cumsum(batch.column(1).value_lengths().to_numpy())
            places = pc.fill_null(pc.index_in(batch.column(1).flatten(), known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            rows = []
            for i, number in enumerate(np.split(places, ends[:-1])):
                if (number < 0).all():
                    continue
                weights, counts, docs, shares = (unpack(batch.column(c)[i].as_py()) for c in range(2, 6))
                here = np.repeat(number >= 0, counts)
                impacts = np.repeat(weights, counts)[here] * shares[here]
                rows.append((batch.column(0)[i].as_py(), *map(pack, (number[number >= 0], counts[number >= 0], docs[here], impacts))))
            if rows:
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), *[pa.binary()] * 4), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["block", "numbers", "counts", "docs", "impacts"])

    return run


def _scorer(queries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], residual: np.ndarray, k: int, last: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Scores the items asked for in one block: ``queries`` has each term's items, its times there and its residual in them."""

    def run(entries: pa.Table, block: pa.Table) -> pa.Table:
        out: dict[str, list] = {"item": [], "doc_id": [], "low": [], "high": []}
        # a block without entries counts too: its documents may have all of the residual
        name = block.column("block")[0].as_py() if block.num_rows else None
        if block.num_rows:
            ids, todo = (block.column(c).combine_chunks()[0].values.to_numpy() for c in ("ids", "items"))
            line = dict(zip(todo.tolist(), range(len(todo)), strict=True))
            low = np.zeros((len(todo), len(ids)), np.int64)
            met = None if last else np.zeros_like(low)
            for row in zip(*(entries.column(c).to_pylist() for c in ("numbers", "counts", "docs", "impacts")), strict=True):
                numbers, counts, docs, impacts = map(unpack, row)
                ends = np.cumsum(counts)
                for term, start, end in zip(numbers.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    # a term's documents differ; an item's line lies together in memory
                    at, shares = docs[start:end], impacts[start:end]
                    for item, times, left in zip(*map(np.ndarray.tolist, queries[term]), strict=True):
                        if item not in line:
                            continue
                        low[line[item]][at] += shares * times
                        if met is not None:
                            met[line[item]][at] += left
            high = low if met is None else low + residual[todo][:, None] - met
            keep = k if last else max(REPORTED, k)
            for j, item in enumerate(todo.tolist()):
                bound = high[j]
                edge = np.partition(bound, -keep)[-keep] if len(bound) > keep else 0
                some = np.flatnonzero((bound >= edge) & (bound > 0))
                # documents stand in the order of their ids, so a stable sort keeps it among equals
                ranked = some[np.argsort(-bound[some], kind="stable")]
                some = ranked[:keep]
                out["item"] += [item] * len(some)
                out["doc_id"] += ids[some].tolist()
                out["low"] += low[j, some].tolist()
                out["high"] += bound[some].tolist()
                if not last:
                    out["item"].append(item)
                    out["doc_id"].append(None)
                    out["low"].append(0)
                    out["high"].append(int(np.partition(bound, -keep - 1)[-keep - 1]) if len(bound) > keep else 0)
        release()
        return pa.table({"item": pa.array(out["item"], pa.int32()), "block": pa.array([name] * len(out["item"]), pa.string()), **{c: pa.array(out[c], pa.int64()) for c in ("doc_id", "low", "high")}})

    return run


def _search_pass(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """The best documents of a pass's items: item_id, rank, doc_id, score."""
    spark, scratch, depths = asked.sparkSession, Scratch(asked.sparkSession, "search"), len(index.edges) + 1
    held = asked.join(index.terms, "term").select("item", "term", "times", "df").toPandas()
    names = sorted(held["item"].unique().tolist())
    number = {x: i for i, x in enumerate(names)}
    place, times = held["item"].map(number).to_numpy(np.int64), held["times"].to_numpy(np.int64)
    weights = weight_of(held["df"].to_numpy(np.int64), index.documents)
    by_term = held.groupby("term").indices
    buckets = sorted({_place(t.encode(), BUCKETS) for t in by_term})
    wanted, blocks_made = index.cells.filter(F.col("bucket").isin(buckets)), index.blocks.count()

    def picked(reached: int, depth: int, among: DataFrame | None = None) -> DataFrame:
        """The pass's postings in the tiers below ``reached``, down to ``depth``, of all blocks or those ``among`` them."""
        tasks = max(spark.sparkContext.defaultParallelism, -(-blocks_made * len(buckets) * (depth - reached) // CELLS_A_TASK))
        cells = wanted.filter((F.col("tier") > reached) & (F.col("tier") <= depth)).coalesce(tasks)
        cells = cells if among is None else cells.join(among, "block", "left_semi")
        return cells.select("block", "terms", "weights", "counts", "docs", "shares").mapInArrow(tidy(_picked(list(by_term))), _PICKED)

    def scored(depth: int, entries: DataFrame, blocks: DataFrame) -> DataFrame:
        """Bounds of the items that ``blocks`` lists, by the postings of the tiers down to ``depth``."""
        # what a posting further down can have: less than the edge, and no more than its term's weight allows
        below = np.zeros_like(weights) if depth == depths else np.minimum(weights * LARGEST, index.edges[depth - 1]) * times
        residual = np.zeros(len(names), np.int64)
        np.add.at(residual, place, below)
        queries = [(place[at], times[at], below[at]) for at in by_term.values()]
        run = _scorer(queries, residual, k, depth == depths)
        return entries.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(run, _REPORT)

    unproven, candidates = list(range(len(names))), None
    entries, reached = None, 0
    for depth in range(1, depths):
        if not unproven:
            break
        blocks = index.blocks.withColumn("items", F.array(*map(F.lit, unproven)).cast("array<int>"))
        tier, reached = scratch.save(picked(reached, depth)), depth
        entries = tier if entries is None else entries.unionByName(tier)
        found = scratch.save(scored(depth, entries, blocks))
        order = Window.partitionBy("item").orderBy(F.col("low").desc(), "doc_id")
        tenth = found.filter("doc_id is not null and low > 0").withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k).groupBy("item").agg(F.min("low").alias("least"), F.count("*").alias("n"))
        others = found.filter("doc_id is null").groupBy("item").agg(F.max("high").alias("others"))
        proven = {r["item"]: r["least"] for r in tenth.join(others, "item").filter((F.col("n") == k) & (F.col("others") < F.col("least"))).collect()}
        if proven:
            unproven = [i for i in unproven if i not in proven]
            least = spark.createDataFrame(list(proven.items()), "item int, least long")
            pairs = found.filter("doc_id is not null").join(F.broadcast(least), "item").filter("high >= least").select("item", "block").distinct()
            candidates = pairs if candidates is None else candidates.unionByName(pairs)
    blocks = index.blocks.withColumn("items", F.array(*map(F.lit, unproven)).cast("array<int>"))
    if candidates is not None:
        listed = scratch.save(candidates.groupBy("block").agg(F.collect_set("item").alias("more")))
        blocks = blocks.join(listed, "block", "left").withColumn("items", F.concat("items", F.coalesce("more", F.array().cast("array<int>")))).drop("more")
    few = None if unproven or candidates is None else small(listed.select("block"))
    rest = picked(reached, depths, few)
    if entries is not None:
        rest = rest.unionByName(entries if few is None else entries.join(few, "block", "left_semi"))
    blocks = blocks.filter(F.size("items") > 0)
    exact = scored(depths, rest, blocks)
    order = Window.partitionBy("item").orderBy(F.col("low").desc(), "doc_id")
    best = exact.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    back = spark.createDataFrame(list(enumerate(names)), f"item int, item_id {dict(asked.dtypes)['item']}")
    out = best.join(F.broadcast(back), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", F.col("low").alias("score"))
    return scratch.only(out)


def search(index: Index, items: DataFrame, *, key: str = "item_id", text: str = "text", k: int = 10, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0.

    The result is written; the index stays, for other items, until its ``scratch`` is
    dropped.  Equal scores stand by ascending id.  Items without a known term give no row.  Items
    are taken in passes of about ``items_a_pass``, whose terms the driver and every task
    hold; results don't depend on it.
    """
    terms = Scratch(items.sparkSession, "search-items")
    asked = terms.save(item_terms(items, key=key, text=text))
    count = asked.select("item").distinct().count()
    passes = -(-count // items_a_pass)
    out = None
    for i in range(passes):
        part = _search_pass(index, asked.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == i), k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = dict(asked.dtypes)["item"]
        out = items.sparkSession.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    terms.drop()
    return out
