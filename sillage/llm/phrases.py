"""Phrase collocation mining by hierarchical pair naming.

Frequent words get ids; two frequent (k-1)-grams that stand one word apart make a k-gram,
which is the pair of their ids.  Pairs are counted over all documents, the frequent ones
get ids of their own by one global join, and these replace them in the texts for the next
length.  A k-gram's pair is also its pair of parents: the counts of all its prefixes and
suffixes, which cuts need, are inherited through it, and so is the knowledge whether a
longer phrase holds it.

Texts are kept as blocks of many documents, in which words and pairs have local codes.  A
block's distinct words or pairs are dealt to parts by their hash, as packed lists; a part
counts what it gets from all blocks, names the frequent ones, and tells each block the names
of its own.  So neither positions nor pairs are ever rows, and a pair that stands in every
block is one entry a block in its part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sillage.llm.arrow import pack, release, tidy, unpack
from sillage.llm.scratch import Scratch

#: Words of a block, words that a task holds for the blocks of all languages, and bytes of a text that are split at a time (cut only where a piece ends).
BLOCK_WORDS, HELD_WORDS, SLICE_BYTES = 1_000_000, 4_000_000, 1_000_000
_END = b"\xff"  # no byte of UTF-8
_ENDS = bytes(0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


class _Codes(dict):
    """Word -> code in order of appearance; the end of a piece is -1."""

    def __init__(self):
        super().__init__({_END: -1})

    def __missing__(self, word: bytes) -> int:
        code = self[word] = len(self) - 1
        return code


def _slices(text: bytes) -> Iterator[list[bytes]]:
    """Words of a whole text with ends of pieces between them, in runs that end with a piece."""
    data, start = text.lower().translate(_ENDS), 0
    while start < len(data):
        end = data.find(_END, start + SLICE_BYTES)
        end = len(data) if end < 0 else end + 1
        yield data[start:end].replace(_END, b" \xff ").split() + [_END]
        start = end


#: Bytes of text whose words are counted in one part, pairs of a later part, about, and the distance between the first ids of two parts.
PART_BYTES, PART_PAIRS, PART_IDS = 8_000_000, 1_200_000, 1 << 32
#: A block's codes (part null; the starts of its parts in ``lefts``, the codes in the order of the parts in ``rights``, its words in ``n``), or its words or pairs that fall to one part.
_MADE = "block string, lang string, part int, codes binary, lefts binary, rights binary, times binary, n bigint"
#: A part's grams (block null; words with their language), or the names of a block's words or pairs in it (packed: the steps between their places in the block's list, and their ids without the part's first).
_NAMED = "block string, part int, at binary, named binary, ids array<bigint>, lefts array<bigint>, rights array<bigint>, times array<bigint>, lang string, words array<string>"


def _packed_codes(codes: np.ndarray) -> bytes:
    """Codes by position, -1 where there is none; if codes count up in order of appearance, each new one costs next to nothing."""
    highest = np.maximum.accumulate(np.concatenate([[-1], codes]))[:-1]
    new = codes > highest
    if not np.array_equal(codes[new], np.arange(int(new.sum()))):
        new = np.zeros(len(codes), bool)
    return pack(np.where(new, 0, np.where(codes == -1, 1, codes + 2)))


def _unpacked_codes(packed: bytes) -> np.ndarray:
    found = unpack(packed)
    return np.where(found == 0, np.cumsum(found == 0) - 1, found - 2)


def _packed_names(at: np.ndarray, ids: np.ndarray, part: int) -> dict[str, bytes]:
    return {"at": pack(np.diff(at, prepend=0)), "named": pack(ids - part * PART_IDS)}


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(name, kinds[kind]) for name, kind in (field.split() for field in ddl.split(", "))])


def _rows(rows: list[dict], ddl: str) -> pa.Table:
    return pa.Table.from_pylist(rows, schema=_arrow(ddl))


def _word_blocks(parts: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents -> blocks of one language, and their words by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        held: dict[str, tuple[_Codes, list[np.ndarray]]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal count
            known, runs = held.pop(lang)
            del size[lang]
            codes, words = np.concatenate(runs), list(known)[1:]
            if words:
                name, times = f"{task}-{count}", np.bincount(codes[codes >= 0], minlength=len(words))
                count += 1
                part = np.fromiter((xxhash.xxh3_64_intdigest(w) % parts for w in words), np.int64, len(words))
                order = np.lexsort((-times, part))  # common words get small codes within their part
                rank = np.full(len(words) + 1, -1, np.int64)
                rank[order] = np.arange(len(words))
                part = part[order]
                starts = np.searchsorted(part, np.arange(parts + 1))
                rows = [{"block": name, "lang": lang, "codes": _packed_codes(rank[codes]), "lefts": pack(starts), "rights": pack(np.diff(np.arange(len(words)), prepend=0)), "n": int(times.sum())}]
                for p in np.unique(part).tolist():
                    own = order[starts[p] : starts[p + 1]]
                    rows.append({"block": name, "lang": lang, "part": p, "lefts": zstandard.compress(_END.join([words[i] for i in own.tolist()])), "times": pack(times[own])})
                yield from _rows(rows, _MADE).to_batches()
            release()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for words in _slices(text.as_py()):
                    if lang not in held:
                        held[lang], size[lang] = (_Codes(), []), 0
                    known, runs = held[lang]
                    runs.append(np.fromiter(map(known.__getitem__, words), np.int32, len(words)))
                    size[lang] += len(words)
                    if size[lang] >= BLOCK_WORDS:
                        yield from flush(lang)
                    elif sum(size.values()) >= HELD_WORDS:
                        yield from flush(max(size, key=size.__getitem__))
        for lang in list(held):
            yield from flush(lang)

    return run


def _word_namer(least: int) -> Callable[[pa.Table], pa.Table]:
    """All blocks' words of a part -> its frequent words with ids, and each block's names."""

    def run(group: pa.Table) -> pa.Table:
        part, langs = group.column("part")[0].as_py(), group.column("lang").to_pylist()
        known: dict[str, dict[bytes, int]] = {lang: {} for lang in langs}
        lists, total = [], 0
        for lang, packed in zip(langs, group.column("lefts").to_pylist(), strict=True):
            mine, words = known[lang], zstandard.decompress(packed).split(_END)
            lists.append(np.empty(len(words), np.int64))
            for i, word in enumerate(words):
                code = mine.get(word)
                if code is None:
                    code = mine[word] = total
                    total += 1
                lists[-1][i] = code
        count = np.zeros(total, np.int64)
        for codes, times in zip(lists, group.column("times").to_pylist(), strict=True):
            count[codes] += unpack(times)
        frequent = count >= least
        ids = np.where(frequent, np.cumsum(frequent) - 1 + part * PART_IDS, -1)
        rows = []
        for lang, mine in known.items():
            chosen = [(word, code) for word, code in mine.items() if frequent[code]]
            if chosen:
                codes = np.array([code for _, code in chosen])
                rows.append({"part": part, "ids": ids[codes], "times": count[codes], "lang": lang, "words": [word.decode() for word, _ in chosen]})
        for name, codes in zip(group.column("block").to_pylist(), lists, strict=True):
            at = np.flatnonzero(frequent[codes])
            if len(at):
                rows.append({"block": name, "part": part, **_packed_names(at, ids[codes[at]], part)})
        out = _rows(rows, _NAMED)
        rows.clear()
        release()
        return out

    return run


def _hashed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit hash of pairs of ids."""
    mixed = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    mixed = (mixed ^ mixed >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ mixed >> np.uint64(29)


def _by_pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """An order in which equal pairs stand together."""
    hashed = _hashed(left, right)
    order = np.argsort(hashed)
    sorted_, left, right = hashed[order], left[order], right[order]
    same = sorted_[1:] == sorted_[:-1]
    if (same & ((left[1:] != left[:-1]) | (right[1:] != right[:-1]))).any():  # two pairs with one hash
        return order[np.lexsort((right, left))]
    return order


def _pairs_of(parts: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """A block and the names of its frequent grams -> the pairs of neighbouring ones."""

    def run(block: pa.Table, names: pa.Table) -> pa.Table:
        made: list[dict] = []
        if block.num_rows and names.num_rows:
            of = {"block": block.column("block")[0].as_py(), "lang": block.column("lang")[0].as_py()}
            codes, starts = _unpacked_codes(block.column("codes")[0].as_py()), unpack(block.column("lefts")[0].as_py())
            own = np.cumsum(unpack(block.column("rights")[0].as_py()))
            packed = list(zip(*(names.column(c).to_pylist() for c in ("part", "at", "named")), strict=True))
            place = own[np.concatenate([starts[part] + np.cumsum(unpack(at)) for part, at, _ in packed])]
            ids = np.concatenate([unpack(ids) + part * PART_IDS for part, _, ids in packed])
            # a frequent code gets its place among the block's names, others -1; the end of a piece, -1, reads the last entry
            among = np.full(max(int(codes.max()), int(place.max())) + 2, -1, np.int64)
            among[place] = np.arange(len(place))
            at = among[codes]
            a, b = at[:-1], at[1:]
            both = np.flatnonzero((a >= 0) & (b >= 0))
            pairs, first, code, times = np.unique(a[both] * len(place) + b[both], return_index=True, return_inverse=True, return_counts=True)
            if len(pairs):
                # codes in the order of first appearance; in a part's list they ascend
                by_first = np.argsort(first)
                rank = np.empty(len(pairs), np.int64)
                rank[by_first] = np.arange(len(pairs))
                pairs, times = pairs[by_first], times[by_first]
                left, right = ids[pairs // len(place)], ids[pairs % len(place)]
                part = (_hashed(left, right) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
                order = np.argsort(part, kind="stable")
                after = np.full(len(a), -1, np.int64)
                after[both] = rank[code]
                left, right, times, part = left[order], right[order], times[order], part[order]
                starts = np.searchsorted(part, np.arange(parts + 1))
                made.append({**of, "codes": _packed_codes(after), "lefts": pack(starts), "rights": pack(np.diff(order, prepend=0))})
                for p in np.unique(part).tolist():
                    own = slice(starts[p], starts[p + 1])
                    made.append({**of, "part": p, **{c: pack(x[own]) for c, x in (("lefts", left), ("rights", right), ("times", times))}})
        out = _rows(made, _MADE)
        made.clear()
        release()
        return out

    return run


def _pair_namer(least: int) -> Callable[[pa.Table], pa.Table]:
    """All blocks' pairs of a part -> its frequent pairs with ids, and each block's names."""

    def run(group: pa.Table) -> pa.Table:
        lists = [[unpack(x) for x in group.column(c).to_pylist()] for c in ("lefts", "rights", "times")]
        sizes = np.array([len(x) for x in lists[0]])
        left, right, times = (np.concatenate(x) for x in lists)
        del lists
        order = _by_pair(left, right)
        left, right = left[order], right[order]
        new = np.concatenate([[True], (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
        count = np.add.reduceat(times[order], np.flatnonzero(new))
        frequent, part = count >= least, group.column("part")[0].as_py()
        number = np.where(frequent, np.cumsum(frequent) - 1 + part * PART_IDS, -1)
        ids = np.empty(len(order), np.int64)
        ids[order] = number[np.cumsum(new) - 1]
        first = np.flatnonzero(new)[frequent]
        rows = [{"part": part, "ids": number[frequent], "lefts": left[first], "rights": right[first], "times": count[frequent]}] if len(first) else []
        ends = np.cumsum(sizes)
        for name, start, end in zip(group.column("block").to_pylist(), ends - sizes, ends, strict=True):
            at = np.flatnonzero(ids[start:end] >= 0)
            if len(at):
                rows.append({"block": name, "part": part, **_packed_names(at, ids[start:end][at], part)})
        out = _rows(rows, _NAMED)
        rows.clear()
        release()
        return out

    return run


def _grams(docs: DataFrame, least: int, longest: int, text: str, lang: str, scratch: Scratch) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) and the frequent grams of each length from 1: id, lang, f, left, right, phrase, last, heads and tails.

    ``heads`` are the counts of the gram's prefixes by length, the whole last; ``tails``
    those of its suffixes.
    """
    spark, steps = scratch.spark, Scratch(scratch.spark, "phrases-blocks")
    source = docs.select(F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text}`").cast("string").cast("binary").alias("text")).filter("octet_length(text) > 0")
    bytes_ = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parallel = spark.sparkContext.defaultParallelism
    made = steps.save(source.mapInArrow(tidy(_word_blocks(max(parallel, -(-bytes_ // PART_BYTES)))), _MADE))
    named = steps.save(made.filter("part is not null").groupBy("part").applyInArrow(_word_namer(least), _NAMED))
    totals = scratch.save(made.filter("part is null").groupBy("lang").agg(F.sum("n").alias("n")))
    none, x = F.lit(None).cast("long"), F.col("x")
    words = named.filter("block is null").select("lang", F.explode(F.arrays_zip("ids", "words", "times")).alias("x"))
    levels = [scratch.save(words.select(x["ids"].alias("id"), "lang", none.alias("left"), none.alias("right"), x["times"].alias("f"), x["words"].alias("phrase"), x["words"].alias("last"), F.array(x["times"]).alias("heads"), F.array(x["times"]).alias("tails")))]
    parts = max(parallel, -(-levels[0].agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0] // PART_PAIRS))
    names = named.filter("block is not null").select("block", "part", "at", "named")
    blocks = made.filter("part is null").select("block", "lang", "codes", "lefts", "rights")
    for size in range(2, longest + 1):
        last, steps = steps, Scratch(spark, "phrases-blocks")
        made = steps.save(blocks.groupBy("block").cogroup(names.groupBy("block")).applyInArrow(_pairs_of(parts), _MADE))
        last.drop()
        named = steps.save(made.filter("part is not null").groupBy("part").applyInArrow(_pair_namer(least), _NAMED))
        pairs = named.filter("block is null").select(F.explode(F.arrays_zip("ids", "lefts", "rights", "times")).alias("x")).select(F.col("x.ids").alias("id"), F.col("x.lefts").alias("left"), F.col("x.rights").alias("right"), F.col("x.times").alias("f"))
        left = levels[-1].select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.col("heads").alias("up"))
        right = levels[-1].select(F.col("id").alias("right"), "last", F.col("tails").alias("down"))
        full = pairs.join(left, "left").join(right, "right")
        levels.append(scratch.save(full.select("id", "lang", "left", "right", "f", F.concat_ws(" ", "head", "last").alias("phrase"), "last", F.concat("up", F.array("f")).alias("heads"), F.concat("down", F.array("f")).alias("tails"))))
        names = named.filter("block is not null").select("block", "part", "at", "named")
        blocks = made.filter("part is null").select("block", "lang", "codes", "lefts", "rights")
    steps.drop()
    return totals, levels


def _lowest_cut(a: Column, n: Column, size: int) -> Column:
    """struct(score, cut, l, r) of the cut with the lowest score, the first of equals; in exact decimals."""
    top = (a * 1000).cast("decimal(19,0)") * n.cast("decimal(18,0)")

    def cut(k: int) -> Column:
        l, r = F.col("heads")[k - 1], F.col("tails")[size - k - 1]  # noqa: E741
        score = F.call_function("div", top, l.cast("decimal(19,0)") * r.cast("decimal(18,0)"))
        return F.struct(score.cast("long").alias("score"), F.lit(k).alias("cut"), l.alias("l"), r.alias("r"))

    return F.array_min(F.array(*map(cut, range(1, size))))


def phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 100, longest: int = 5, share: int = 100) -> DataFrame:
    """lang, phrase, words, a, l, r, n and score of every phrase of 2 to ``longest`` words that occurs ``least`` times.

    ``a`` counts occurrences within pieces between marks and line ends, A-Z lower-cased;
    ``l`` and ``r`` are the counts of the two parts of the lowest-scoring cut, ``n`` all
    words of the language (null: ``und``), ``score`` is floor(1000 a n / (l r)).  A
    phrase inside a longer one with at least ``share`` per cent of its count is left out.
    It is enough to look at phrases one word longer: none beyond is more frequent.

    Null and empty texts have no words; repeated rows count each time; an empty table
    gives an empty result; other columns are not read.  A piece without a mark or line
    end has to fit in a task's memory, nothing else does.
    """
    scratch = Scratch(docs.sparkSession, "phrases")
    totals, levels = _grams(docs, least, longest, text, lang, scratch)
    out = None
    for size, grams in enumerate(levels[1:], 2):
        if size < longest:
            above = levels[size].select(F.explode(F.array("left", "right")).alias("id"), "f").groupBy("id").agg(F.max("f").alias("above"))
            grams = grams.join(above, "id", "left").filter(F.col("above").isNull() | (F.col("above") * 100 < F.col("f") * share))
        scored = grams.join(F.broadcast(totals) if totals.count() <= 10_000 else totals, "lang").withColumn("best", _lowest_cut(F.col("f"), F.col("n"), size))
        rows = scored.select("lang", "phrase", F.lit(size).alias("words"), F.col("f").alias("a"), "best.l", "best.r", "n", "best.score")
        out = rows if out is None else out.unionByName(rows)
    return scratch.only(out)


def top_phrases(found: DataFrame, limit: int = 2_000, spread: int = 64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``limit`` phrases by score, then count, then text.

    Ranked within ``spread`` parts of a language first, so that no task sorts a whole one.
    """
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(spread)).alias("part")
    first = found.select("*", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= limit)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= limit)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
