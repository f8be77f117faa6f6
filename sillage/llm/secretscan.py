"""Secrets in whole texts: known forms, and random strings by their token efficiency.

Three known forms (an assignment to a telling name, an access key, a long hex run) are
found by pattern.  What else is random is found by how badly a byte-pair vocabulary
compresses it: words and names are made of long tokens, random strings are not, so a run
with few characters a token is reported.  Digests of known lengths, UUIDs and other
registered identifiers are random-looking by design and excluded before the test.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sillage.llm.arrow import tidy

#: Kinds in the order in which spans with one start are listed.
BASE, RANDOM = ("assign", "access", "hex"), "random"
# fixed patterns
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A text without any of these has no assignment; telling this is much cheaper than the pattern.
_NAMES = ("passw", "secret", "token", "apikey", "api_key")
#: Characters of a key or digest: hexadecimal, base64 and its URL form, with padding behind.
_RUN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512 in hexadecimal.
DIGEST_CHARS = frozenset((32, 40, 56, 64, 96, 128))
_IDENTIFIERS = re.compile(
    r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"  # UUID
    r"|[0-7][0-9A-HJKMNP-TV-Z]{25}"  # ULID
    r"|[A-Z]{14}-[A-Z]{10}-[A-Z]"  # key of a chemical structure
    r"|sha(?:256|384|512)-[A-Za-z0-9+/]+={0,2}"  # integrity attribute
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_-][0-9Z+_-]+"  # time stamp
)
_SPACE = re.compile(r"\s")
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}")


def _base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the known forms, leftmost and non-overlapping within each kind."""
    found = []
    lower = text.lower()
    if any(name in lower for name in _NAMES):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return found


def _mixed(run: str) -> bool:
    """Letters and digits, or capitals behind the first letter beside small ones: plain words and numbers are neither."""
    letter = any(c.isalpha() for c in run)
    if letter and any(c.isdigit() for c in run):
        return True
    return not run.isupper() and any(c.isupper() for c in run[1:]) and any(c.islower() for c in run)


def is_identifier(run: str) -> bool:
    """A digest of a known length, or a registered identifier: random-looking, but no secret."""
    if len(run) in DIGEST_CHARS and all(c in "0123456789abcdefABCDEF" for c in run):
        return True
    if _IDENTIFIERS.fullmatch(run):
        return True
    # an account number proves itself by its check digits
    return bool(_ACCOUNT.fullmatch(run)) and int("".join(str(int(c, 36)) for c in run[4:] + run[:4])) % 97 == 1


def _addresses(text: str) -> list[tuple[int, int]]:
    """Where addresses run, from their ``://`` to the next white space: they are identifiers as a whole."""
    found, at = [], text.find("://")
    while at >= 0:
        space = _SPACE.search(text, at)
        found.append((at, space.start() if space else len(text)))
        at = text.find("://", found[-1][1])
    return found


class _Spans:
    """Spans merged where they overlap, for lookups in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for start, end in sorted(spans):
            if self.ends and start < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def meets(self, start: int, end: int) -> bool:
        at = bisect.bisect_left(self.starts, end)
        return at > 0 and self.ends[at - 1] > start


class Scanner:
    """Finds the spans of one text; ``ranks`` and ``pattern`` are a tiktoken vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, min_chars: int, max_ratio: float):
        self.tokens = tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.runs = re.compile(_RUN.pattern.replace("+={", f"{{{min_chars},}}={{"))
        self.max_ratio = max_ratio

    def ratio(self, run: str) -> float:
        """Characters a token."""
        return len(run) / len(self.tokens(run))

    def random(self, text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
        """Runs with a low ratio that are no part of a span in ``taken``, no identifier, and no part of an address."""
        closed, addresses = _Spans([(s, e) for s, e, _ in taken]), _Spans(_addresses(text))
        for m in self.runs.finditer(text):
            run = m.group()
            if not _mixed(run) or is_identifier(run):
                continue
            start, end = m.span()
            if closed.meets(start, end) or addresses.meets(start, start + 1):
                continue
            if self.ratio(run) <= self.max_ratio:
                yield start, end, RANDOM

    def spans(self, text: str | None) -> list[dict]:
        """All spans in order of start, then kind."""
        if not text:
            return []
        found = _base(text)
        found += list(self.random(text, found))
        order = (*BASE, RANDOM)
        found.sort(key=lambda x: (x[0], order.index(x[2])))
        return [{"kind": k, "start": s, "end": e} for s, e, k in found]


def find_secrets(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, key: str = "doc_id", text: str = "text", min_chars: int = 16, max_ratio: float = 2.0) -> DataFrame:
    """(key, spans) of every row; spans are (kind, start, end) in code points, end exclusive.

    A span of kind ``random`` has at least ``min_chars`` characters and at most
    ``max_ratio`` characters a token.  Null and empty texts have no spans; rows are not
    related, so ties, repeated rows, null keys and empty tables need no rule; other
    columns are not read.
    """
    source = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value, pattern, min_chars, max_ratio)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([scanner.spans(t.as_py()) for t in batch.column(1)], kind)], ["key", "spans"])

    span = T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType())
    schema = T.StructType().add("key", source.schema["key"].dataType).add("spans", T.ArrayType(span))
    return source.mapInArrow(tidy(run), schema).withColumnRenamed("key", key)


def listed(spans: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    """Spans as text: ``kind:start:end``, joined by commas."""
    chosen = spans if keep is None else F.filter(spans, lambda s: keep(s["kind"]))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
