"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; their runs of 1, 2 and 3 code points are hashed into a fixed
number of buckets.  Log-probabilities are one broadcast matrix (languages x buckets);
a batch of texts is scored at once from its flat list of buckets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.llm.arrow import tidy
from sillage.llm.samples import bounded
from sillage.llm.scratch import Scratch

#: Learning documents that the model is fitted on at most, and buckets of n-grams.
SAMPLE_ROWS, BUCKETS = 20_000, 1 << 16
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_CHUNK = 500_000


def _buckets(codes: np.ndarray, sizes: tuple[int, ...], buckets: int) -> Iterator[np.ndarray]:
    """Bucket of the n-gram that starts at each code point, for each n."""
    state = np.zeros(len(codes), np.uint32)
    for n in range(1, max(sizes) + 1):
        if n > len(codes):
            break
        state = (state[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint32(0x01000193)
        if n in sizes:
            mixed = (state ^ np.uint32(n * 0x9E37)) * np.uint32(0x85EBCA6B)
            yield ((mixed ^ (mixed >> np.uint32(15))) & np.uint32(buckets - 1)).astype(np.intp)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le"), "<u4")


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    sizes: tuple[int, ...] = (1, 2, 3)

    @classmethod
    def fit(cls, counts: np.ndarray, languages: list[str], sizes: tuple[int, ...], smoothing: float = 0.5) -> Model:
        """From n-gram counts (languages x buckets); priors are left even."""
        weights = np.log(counts + smoothing)
        return cls(languages, weights - np.log((counts + smoothing).sum(axis=1, keepdims=True)), sizes)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its posterior probability of each whole text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.languages:
            return names, scores
        start = 0
        while start < len(texts):
            end, chars = start, 0
            while end < len(texts) and (end == start or chars + len(texts[end] or "") <= _CHUNK):
                chars += len(texts[end] or "")
                end += 1
            rows, total = [], np.zeros((end - start, len(self.languages)))
            for i in range(start, end):
                text = texts[i]
                if text and _LETTER.search(text):
                    rows.append((i - start, _codes(text)))
            for part in range(0, max((len(c) for _, c in rows), default=0), _CHUNK):  # more than one only for a very long text
                self._add(total, [(i, c[part : part + _CHUNK + max(self.sizes) - 1]) for i, c in rows if part < len(c)])
            share = np.exp(total - total.max(axis=1, keepdims=True))
            best, posterior = total.argmax(axis=1), 1 / share.sum(axis=1)
            for i, _ in rows:
                names[start + i], scores[start + i] = self.languages[best[i]], posterior[i]
            start = end
        return names, scores

    def _add(self, total: np.ndarray, rows: list[tuple[int, np.ndarray]]) -> None:
        """Add the log-probabilities of the rows' n-grams; the batch's buckets are one list, cut by row."""
        parts = [(i, b[:_CHUNK]) for i, codes in rows for b in _buckets(codes, self.sizes, self.weights.shape[1])]
        flat = np.concatenate([b for _, b in parts])
        cuts = np.cumsum([0, *(len(b) for _, b in parts[:-1])])
        where = [i for i, _ in parts]
        for k, weights in enumerate(self.weights):
            np.add.at(total[:, k], where, np.add.reduceat(weights.take(flat), cuts))



def held_out(doc_id: str | Column = "doc_id", folds: int = 5) -> Column:
    """Whether a document is in the fold that nothing is learned from; a null id counts as empty text."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % folds == 0


def fit_language_model(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample_rows: int = SAMPLE_ROWS, buckets: int = BUCKETS, sizes: tuple[int, ...] = (1, 2, 3)) -> Model:
    """A model from at most ``sample_rows`` documents outside the held-out fold that have text and a language.

    Rows that repeat an id count once, with their greatest language and text.  Counts
    are added up by Spark; a row for each language and n-gram bucket found comes back,
    which the parameters bound whatever the input.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null and doc_id is not null").filter(~held_out())
    rows = rows.select(F.col("doc_id").cast("long").alias("key"), "lang", "text")
    chosen = bounded(rows.groupBy("key").agg(F.max("lang").alias("lang")), "key", sample_rows).toPandas()
    if chosen.empty:
        return Model([], np.zeros((0, buckets)), sizes)
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "languages")
    languages = sorted(chosen["lang"].unique())
    ids = spark.createDataFrame([(int(k), languages.index(x)) for k, x in zip(chosen["key"], chosen["lang"], strict=True)], "key long, place int")
    named = spark.createDataFrame(list(enumerate(languages)), "place int, lang string")
    known = ids.join(named, "place").select("key", "lang", "place")
    sample = scratch.save(rows.join(F.broadcast(known), ["key", "lang"]).groupBy("key", "place").agg(F.max("text").alias("text")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((len(languages), buckets), np.int64)
        for batch in batches:
            for place, text_ in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for b in _buckets(_codes(text_.as_py()), sizes, buckets):
                    totals[place] += np.bincount(b, minlength=buckets)
        at = np.nonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), pa.array(totals[at])], ["place", "bucket", "n"])

    counted = sample.select("place", "text").mapInArrow(tidy(count), "place long, bucket long, n long")
    found = counted.groupBy("place", "bucket").agg(F.sum("n").alias("n")).toPandas()
    scratch.drop()
    totals = np.zeros((len(languages), buckets))
    totals[found["place"], found["bucket"]] = found["n"]
    return Model.fit(totals, languages, sizes)


def identify(docs: DataFrame, model: Model, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every row's whole text.

    A null text, one without a letter, and any text under a model without languages is
    ``und`` with score 0.  Only the text is looked at; ties go to the language first in
    order; one row for each input row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                names, scores = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")
