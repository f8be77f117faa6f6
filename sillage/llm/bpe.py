"""Byte-level BPE encoding and decoding with the exact merges of a rank file, in linear time.

A piece's bytes are mapped to Latin-1 characters and run through an Aho-Corasick
automaton of all tokens, which gives the longest token at every position.  The encoder
takes longest tokens from the left; if a token cannot stand beside the one before it
(their merges would have come out otherwise) it falls back to the next shorter prefix
token, and when none is left it steps back over the last token and marks the position
as dead.  Every position dies at most once, so the work is linear.  Whether two tokens
can stand together is found by undoing their merges in reverse order, and remembered.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm.arrow import map_rows, tidy

#: Pieces and token pairs that a worker remembers before it starts anew.
PIECES, PAIRS = 250_000, 200_000
#: Characters of a text that are split into pieces at a time.
BLOCK = 65_536


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a file of base64 tokens and ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts whose merge completes ``token``; None if merging its bytes does not lead to it."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best, at = None, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1])
            if rank is not None and (best is None or rank < best):
                best, at = rank, i
        if best is None:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


class Vocabulary:
    """Tables of a rank file, small and of fixed size; made once on the driver and shipped with the task."""

    def __init__(self, ranks: dict[bytes, int]):
        if any(bytes([b]) not in ranks for b in range(256)):
            raise ValueError("the rank file lacks single bytes")
        size = max(ranks.values()) + 1
        self.ranks = ranks
        self.left, self.right = list(range(size)), list(range(size))
        self.whole_only: set[int] = set()
        for token, rank in ranks.items():
            if len(token) > 1:
                if parts := _last_merge(token, ranks):
                    self.left[rank], self.right[rank] = ranks[parts[0]], ranks[parts[1]]
                else:
                    self.whole_only.add(rank)


class Encoder:
    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.ranks, self.left, self.right = vocabulary.ranks, vocabulary.left, vocabulary.right
        self.split = regex.compile(pattern).findall
        self.edge = regex.compile(r"\S\s")
        self.table: list[bytes] = [b""] * len(self.left)
        self.automaton = ahocorasick.Automaton()
        usable = {t for t, r in self.ranks.items() if r not in vocabulary.whole_only}
        self.shorter: dict[int, int] = {}
        for token, rank in self.ranks.items():
            self.table[rank] = token
            if token in usable:
                self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
                for n in range(len(token) - 1, 0, -1):
                    if token[:n] in usable:
                        self.shorter[rank] = self.ranks[token[:n]]
                        break
        self.automaton.make_automaton()
        self.sizes = [len(t) for t in self.table]
        self.pairs: dict[int, bool] = {}
        self.pieces: dict[str, bytes] = {}

    def fit(self, a: int, b: int) -> bool:
        """Whether token ``b`` can follow token ``a``."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._fit(a, b)
        return known

    def _fit(self, a: int, b: int) -> bool:
        limit, table, get, left, right = len(self.table) + 1, self.table, self.ranks.get, self.left, self.right
        while True:
            if get(table[a] + table[b], limit) < limit:
                return False  # this merge across the border would have come first
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def encode_bytes(self, data: bytes) -> list[int]:
        """Ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size = len(data)
        longest = [0] * size
        for end, (rank, length) in self.automaton.iter(data.decode("latin-1")):
            longest[end - length + 1] = rank
        alive, ids, at, token = bytearray(b"\x01") * (size + 1), [], 0, longest[0]
        sizes, shorter, fit, known = self.sizes, self.shorter, self.fit, self.pairs.get
        while at < size:
            end = at + sizes[token]
            if alive[end] and (not ids or (fit(ids[-1], token) if (stands := known(ids[-1] << 32 | token)) is None else stands)):
                ids.append(token)
                at = end
                if at < size:
                    token = longest[at]
            elif token in shorter:
                token = shorter[token]
            else:
                alive[at] = 0
                token = ids.pop()
                at -= sizes[token]
        return ids

    def _piece(self, piece: str) -> bytes:
        found = self.encode_bytes(piece.encode())
        ids = struct.pack(f"<{len(found)}I", *found)
        if len(piece) <= 64:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def blocks(self, text: str) -> Iterator[str]:
        """The text in runs that end where a piece ends in any case: before white space that follows other text."""
        start = 0
        while len(text) - start > BLOCK:
            found = self.edge.search(text, start + BLOCK)
            if found is None:
                break
            yield text[start : found.start() + 1]
            start = found.start() + 1
        yield text[start:] if start else text

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        get, piece, out = self.pieces.get, self._piece, []
        for block in self.blocks(text):
            out.append(b"".join([get(p) or piece(p) for p in self.split(block)]))
        return b"".join(out) if len(out) > 1 else out[0]

    def decode(self, ids: bytes | None) -> bytes:
        """Bytes of a whole text's ids; undoes ``encode`` and takes any list of known ids."""
        if not ids:
            return b""
        array, table = np.frombuffer(ids, "<u4"), self.table
        return b"".join([b"".join([table[i] for i in array[k : k + BLOCK].tolist()]) for k in range(0, len(array), BLOCK)])


def encode(df: DataFrame, vocabulary: Vocabulary, pattern: str, *, key: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """(key, ids) of every row: the ids of the whole text, packed as little-endian unsigned 32-bit integers.

    With ``decoded`` a third column holds the bytes that decoding those ids gives, in
    the same pass.  Each match of ``pattern`` is encoded separately; text between
    matches is left out, and there are no special tokens.  A null or empty text has no
    ids.  Rows are not related, so ties, repeated rows and empty tables need no rule;
    other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)

        def row(k, t):
            ids = encoder.encode(t)
            return (k, ids, encoder.decode(ids)) if decoded else (k, ids)

        names, types = ["key", "ids", "decoded"], [kind, pa.binary(), pa.binary()]
        width = 3 if decoded else 2
        yield from map_rows(names[:width], types[:width], row, lambda out: sum(map(len, out[1:])))(batches)

    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[source.dtypes[0][1]]
    schema = f"key {source.dtypes[0][1]}, ids binary" + ", decoded binary" * decoded
    return source.mapInArrow(tidy(run), schema).withColumnRenamed("key", key)


def decode(df: DataFrame, vocabulary: Vocabulary, pattern: str, *, key: str, ids: str = "ids") -> DataFrame:
    """(key, decoded): the bytes of each row's packed ids; null or no ids give no bytes."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, pattern)
        yield from map_rows(["key", "decoded"], [kind, pa.binary()], lambda k, x: (k, encoder.decode(x)), lambda out: len(out[1]))(batches)

    source = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[source.dtypes[0][1]]
    return source.mapInArrow(tidy(run), f"key {source.dtypes[0][1]}, decoded binary").withColumnRenamed("key", key)


def unpack(ids) -> F.Column:
    """Packed ids as an array of longs, for callers who want them so."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    word = lambda i: F.substring(F.hex(ids), i * 8 + 1, F.lit(8))
    turn = lambda h: F.concat(*(F.substring(h, p, F.lit(2)) for p in map(F.lit, (7, 5, 3, 1))))
    count = (F.octet_length(ids) / 4).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.conv(turn(word(i)), 16, 10).cast("long"))).otherwise(F.array().cast("array<long>"))
