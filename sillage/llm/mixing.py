"""Soft-membership mixing: document rates whose expected domain tokens match target weights.

A classifier fitted on a labelled table gives every document a posterior over domains.
With ``t`` tokens and posterior ``p``, document i contributes ``w_i t_i p_ik`` expected
tokens to domain k at rate ``w_i >= 0``.  The rates are the least-squares fit of these
totals to the targets that changes the rates least: the squares of the totals' misses, as
shares of the targets, and, with a very small weight, those of the rates' distances from 1,
by token.  The fit is by projected gradient, in the form where the gradient's steps add up
to one number a domain, a price, and the rates are ``1 - p * price`` projected onto what is
not negative.  A step is the gradient scaled by the inverse of ``sum t p p'`` over the
documents whose rate is above 0, at the best of four lengths.

A document's rate depends on its posterior and the prices alone, so a step is one
distributed sum for all four lengths, and rates are worked out where they are needed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sillage.llm.arrow import tidy
from sillage.llm.samples import bounded
from sillage.llm.scratch import Scratch

#: Labelled documents that the classifier is fitted on at most, its hashed words and the words it keeps.
SAMPLE_ROWS, BUCKETS, KEPT = 8_000, 1 << 16, 512
_MARKS = b"#*$%&|<>"
_TRIM = b".,;:!?\"'()[]{}" + _MARKS


def _word_bucket(word: bytes) -> int:
    """Bucket of a raw word: 0 if it carries symbols, 1 if it is all capitals, else by its trimmed lower-case form."""
    if any(m in word for m in _MARKS):
        return 0
    if len(word) > 2 and word.isupper():
        return 1
    return 2 + xxhash.xxh32_intdigest(word.strip(_TRIM).lower()) % (BUCKETS - 2)


class _Features(dict):
    """Raw word -> feature, remembered for up to 250,000 words; words without a feature share the last one."""

    def __init__(self, chosen: np.ndarray | None):
        super().__init__()
        self.place = None if chosen is None else {int(b): i for i, b in enumerate(chosen)}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 250_000:
            self.clear()
        bucket = _word_bucket(word)
        value = self[word] = bucket if self.place is None else self.place.get(bucket, len(self.place))
        return value

    def counts(self, text: str | None) -> tuple[int, np.ndarray]:
        """Words of a whole text, and how often each feature occurs."""
        words = text.encode().split() if text else []
        size = BUCKETS if self.place is None else len(self.place) + 1
        return len(words), np.bincount(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), minlength=size)


@dataclass
class Classifier:
    """Softmax regression on the logarithms of feature counts."""

    domains: list[str]
    chosen: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, domains: list[str], chosen: np.ndarray, steps: int = 600, ridge: float = 1e-3) -> Classifier:
        scale = x.std(axis=0, dtype=np.float64).astype(np.float32) + np.float32(1e-3)
        x = x.astype(np.float32) / scale
        goal = np.eye(len(domains), dtype=np.float32)[y]
        weights, bias = np.zeros((x.shape[1], len(domains)), np.float32), np.log(goal.mean(axis=0) + 1e-9)
        rate = 4.0 / max(1.0, float((x**2).sum(axis=1).mean()))
        speed_w, speed_b = np.zeros_like(weights), np.zeros_like(bias)
        for _ in range(steps):
            error = _softmax(x @ (weights + 0.9 * speed_w) + bias + 0.9 * speed_b) - goal
            speed_w = 0.9 * speed_w - rate * (x.T @ error / len(x) + ridge * weights)
            speed_b = 0.9 * speed_b - rate * error.mean(axis=0)
            weights, bias = weights + speed_w, bias + speed_b
        return cls(domains, chosen, weights / scale[:, None], bias)

    def posteriors(self, counts: np.ndarray) -> np.ndarray:
        return _softmax(np.log1p(counts[:, :-1].astype(np.float32)) @ self.weights + self.bias).astype(np.float64)


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def default_domain() -> Column:
    """The domain of a label row: low (quality 0), toxic or clean; null if that can't be told."""
    return F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")


def fit_classifier(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", domain: Column | None = None, sample_rows: int = SAMPLE_ROWS) -> Classifier | None:
    """A domain classifier from at most ``sample_rows`` labelled documents.

    Label rows with a null id or domain are ignored; of a document with several domains
    the first in order counts, of rows with one id the greatest text.  None if no
    labelled document is left.  The driver gets the sample's feature vectors and the
    words that tell domains apart best by chi-square, both bounded by the parameters.
    """
    named = labels.select(F.col(f"`{doc_id}`").cast("long").alias("key"), (default_domain() if domain is None else domain).alias("domain")).filter("key is not null and domain is not null")
    held = bounded(named.groupBy("key").agg(F.min("domain").alias("domain")), "key", sample_rows).toPandas()
    if held.empty:
        return None
    domains = sorted(held["domain"].unique())
    ids = docs.sparkSession.createDataFrame([(int(k), domains.index(d)) for k, d in zip(held["key"], held["domain"], strict=True)], "key long, domain int")
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("key"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(ids), "key")
    scratch = Scratch(docs.sparkSession, "mixing-sample")
    sample = scratch.save(source.groupBy("key", "domain").agg(F.max("text").alias("text")))
    seen = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    if not seen:
        return None
    # a domain that no document of the table shows can't be told, and has no tokens to match
    held_domains = sorted(seen)
    place = {d: i for i, d in enumerate(held_domains)}
    domains = [domains[d] for d in held_domains]
    sample = sample.withColumn("domain", F.create_map(*(F.lit(x) for pair in place.items() for x in pair))[F.col("domain")])
    seen = {place[d]: n for d, n in seen.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = _Features(None), np.zeros((len(domains), BUCKETS), np.int64)
        for batch in batches:
            for t, d in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                total[d] += memo.counts(t.as_py())[1] > 0
        d, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(d), pa.array(total[d, b])], ["bucket", "domain", "n"])

    counted = sample.select("text", "domain").mapInArrow(tidy(count), "bucket long, domain long, n long")
    every = sum(seen.values())
    n = [F.coalesce(F.sum(F.when(F.col("domain") == d, F.col("n"))), F.lit(0)).cast("double") for d in range(len(domains))]
    wide = counted.groupBy("bucket").agg(*(c.alias(f"n{d}") for d, c in enumerate(n)))
    total = sum((F.col(f"n{d}") for d in range(1, len(domains))), F.col("n0"))
    apart = sum((((F.col(f"n{d}") - total * (seen.get(d, 0) / every)) ** 2 / F.greatest(total * (seen.get(d, 0) / every), F.lit(1e-9))) for d in range(len(domains))), F.lit(0.0))
    chi2 = apart / F.greatest(1 - total / (every + 1), F.lit(1e-3))
    best = wide.orderBy(chi2.desc(), "bucket").limit(KEPT).select("bucket").collect()
    chosen = np.sort(np.array([r["bucket"] for r in best], np.int64))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Features(chosen)
        for batch in batches:
            rows = []
            for t in batch.column(2):
                counts = memo.counts(t.as_py())[1][:-1]
                at = np.flatnonzero(counts)
                rows.append(np.stack([at, counts[at]]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["key", "y", "x"])

    found = sample.select("key", "domain", "text").mapInArrow(tidy(vectors), "key long, y int, x binary").toPandas().sort_values("key")
    scratch.drop()
    data = np.zeros((len(found), len(chosen)), np.float32)
    for i, packed in enumerate(found["x"]):
        at, counts = np.frombuffer(packed, "<u4").reshape(2, -1)
        data[i, at] = np.log1p(counts.astype(np.float32))
    return Classifier.fit(data, found["y"].to_numpy(), domains, chosen)


def _posterior_batches(batches: Iterator[pa.RecordBatch], text: int, model: Classifier) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    memo = _Features(model.chosen)
    for batch in batches:
        pa.default_memory_pool().release_unused()
        for start in range(0, batch.num_rows, 256):
            part = batch.slice(start, 256)
            counted = [memo.counts(t.as_py()) for t in part.column(text)]
            yield part, np.array([n for n, _ in counted], np.int64), model.posteriors(np.stack([c for _, c in counted]))


def domain_posteriors(docs: DataFrame, model: Classifier, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens (words of the whole text) and posterior (array in the order of ``model.domains``) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, tokens, p in _posterior_batches(batches, 1, shared.value):
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tokens), pa.ListArray.from_arrays(offsets, pa.array(p.ravel()))], ["doc_id", "n_tokens", "posterior"])

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(tidy(run), "doc_id long, n_tokens long, posterior array<double>")


@dataclass
class Rates:
    """The prices of the domains, from which any document's rate follows, and the totals they lead to."""

    prices: np.ndarray
    totals: np.ndarray
    targets: np.ndarray
    tokens: np.ndarray
    passes: int

    def of(self, p: np.ndarray) -> np.ndarray:
        """Rates of documents by their posteriors."""
        return np.maximum(0, 1 - p @ self.prices)


#: Lengths of a step that one pass tries, and passes after which a fit that still moves is given up as a fault.
_LENGTHS, _PASSES = (1.0, 0.25, 0.0625, 0.015625), 500


def rate_at(prices: np.ndarray) -> Column:
    """The rate of a row by its posterior."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col("posterior")[i] * float(x) for i, x in enumerate(prices)), F.lit(0.0)))


def fit_rates(table: DataFrame, domains: list[str], weights: dict[str, float], *, budget: float | None = None, tolerance: float = 1e-6, stiffness: float = 1e-8) -> Rates:
    """Rates for a written table (n_tokens, posterior), whose expected domain tokens match ``weights``.

    The token budget is ``budget``, or else the present total.  A domain without any
    tokens is left alone.  Targets that can be met are met within a share of themselves
    that falls with ``stiffness``, the weight of the rates' distances from 1 (1e-8: to
    some 1e-6 where rates stay under 100); others come to the least-squares compromise.
    The fit ends when its gradient is within ``tolerance`` of each target, or when no
    length of step lowers the squares.  Sums are made by Spark; a row of a few numbers
    comes back.
    """
    k = len(domains)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    p = [F.col("posterior")[i] for i in range(k)]

    def sums(tried: list[np.ndarray]) -> list[tuple[np.ndarray, float, np.ndarray]]:
        """For each prices: domain totals, half the squares of the rates, and the sum of t p p' over documents with a rate above 0."""
        wanted = []
        for n, prices in enumerate(tried):
            rate = F.col(f"rate{n}")
            wanted += [F.sum(rate * F.col("n_tokens") * x) for x in p]
            wanted.append(F.sum(rate * rate * F.col("n_tokens")) / 2)
            wanted += [F.sum(F.when(rate > 0, F.col("n_tokens") * p[i] * p[j])) for i, j in pairs]
        rated = table.select("n_tokens", "posterior", *(rate_at(prices).alias(f"rate{n}") for n, prices in enumerate(tried)))
        row = np.array([x or 0.0 for x in rated.agg(*(c.alias(str(n)) for n, c in enumerate(wanted))).first()])
        out = []
        for part in row.reshape(len(tried), -1):
            square = np.zeros((k, k))
            for (i, j), x in zip(pairs, part[k + 1 :], strict=True):
                square[i, j] = square[j, i] = x
            out.append((part[:k], float(part[k]), square))
        return out

    prices, passes = np.zeros(k), 1
    mass, half, square = sums([prices])[0]
    whole, live = float(mass.sum()), mass > 0
    share = np.array([weights.get(d, 0.0) for d in domains])
    share = share / share.sum() if share.sum() else np.full(k, 1.0 / max(k, 1))
    targets = share * (whole if budget is None else budget)
    if not live.any():
        return Rates(prices, mass, targets, mass, passes)
    # all in shares of the present tokens; each miss counts as a share of its target, or of the present tokens if that is 0
    scale = np.where(targets > 0, targets, mass) / whole
    soft = stiffness * np.where(live, scale, 1.0) ** 2

    def value(prices: np.ndarray, half: float) -> float:
        return half / whole + float((prices * targets)[live].sum()) / whole + float((soft * prices**2)[live].sum()) / 2

    def slope(prices: np.ndarray, totals: np.ndarray) -> np.ndarray:
        return np.where(live, (targets - totals) / whole + soft * prices, 0.0)

    totals, at = mass, value(prices, half)
    shrink = 1.0
    while (np.abs(down := slope(prices, totals)) > tolerance * scale).any() and shrink > 1e-9:
        if passes >= _PASSES:
            raise RuntimeError("the rates don't settle; targets or posteriors are degenerate")
        metric = square[np.ix_(live, live)] / whole + np.diag(soft[live])
        step = np.zeros(k)
        step[live] = -np.linalg.lstsq(metric, down[live], rcond=None)[0]
        tried = [prices + length * shrink * step for length in _LENGTHS]
        found = sums(tried)
        passes += 1
        best = min(range(len(tried)), key=lambda n: value(tried[n], found[n][1]))
        if (there := value(tried[best], found[best][1])) < at:
            prices, at, shrink = tried[best], there, 1.0
            totals, _, square = found[best]
        else:
            shrink *= _LENGTHS[-1] / 4
    return Rates(prices, totals, targets, mass, passes)


def copies(rate: Column, doc_id: Column, seed: int) -> Column:
    """A whole number of copies with the rate as expectation; the same for the same doc_id, rate and seed."""
    draw = F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return F.floor(rate + draw).cast("long")


def _fitted(docs: DataFrame, labels: DataFrame, weights: dict[str, float], text: str, doc_id: str, domain: Column | None, sample_rows: int, options: dict) -> tuple[Classifier, Rates, DataFrame, Scratch] | None:
    model = fit_classifier(docs, labels, text=text, doc_id=doc_id, domain=domain, sample_rows=sample_rows)
    if model is None:
        return None
    scratch = Scratch(docs.sparkSession, "mixing")
    table = scratch.save(domain_posteriors(docs, model, text=text, doc_id=doc_id))
    return model, fit_rates(table, model.domains, weights, **options), table, scratch


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *, text: str = "text", doc_id: str = "doc_id", domain: Column | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 11, **options) -> DataFrame:
    """doc_id, n_tokens, domains, posterior, rate and copies of every row.

    ``weights`` are the target shares of the domains' tokens.  Without labelled
    documents every rate is 1.  Null and empty texts have no tokens and the posterior of
    a text without words; a null doc_id draws like any other value; one row for each
    input row; an empty table gives an empty result.
    """
    fitted = _fitted(docs, labels, weights, text, doc_id, domain, sample_rows, options)
    if fitted is None:
        none = F.array().cast("array<double>")
        words = F.size(F.filter(F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")
        return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), words.alias("n_tokens"), none.cast("array<string>").alias("domains"), none.alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies"))
    model, rates, table, _ = fitted
    out = table.withColumn("rate", rate_at(rates.prices))
    names = F.array(*map(F.lit, model.domains))
    return out.select("doc_id", "n_tokens", names.alias("domains"), "posterior", "rate", copies(F.col("rate"), F.col("doc_id"), seed).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], *, text: str = "text", doc_id: str = "doc_id", domain: Column | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 11, **options) -> DataFrame:
    """The mixture: every row of ``docs`` as often as its copies say, all columns kept.

    Posteriors are worked out again beside the rows, so the documents are not shuffled.
    Without labelled documents the rows come back as they are; the other edge cases are
    those of ``mixing_rates``, and columns may have any names.
    """
    fitted = _fitted(docs, labels, weights, text, doc_id, domain, sample_rows, options)
    if fitted is None:
        return docs
    model, rates, _, scratch = fitted
    scratch.drop()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # under plain names: the caller's may clash with any of ours
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    names, at, key = plain.columns, docs.columns.index(text), f"c{docs.columns.index(doc_id)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, p in _posterior_batches(batches, at, shared.value):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rates.of(p))], [*names, "rate"])

    rated = plain.mapInArrow(tidy(run), T.StructType([*plain.schema.fields, T.StructField("rate", T.DoubleType())]))
    counted = rated.withColumn("copies", copies(F.col("rate"), F.col(key).cast("long"), seed)).filter("copies > 0")
    return counted.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*names).toDF(*docs.columns)
