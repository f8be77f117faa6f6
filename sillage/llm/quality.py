"""Quality rules: statistics of whole texts, judged by an isolation forest.

The forest is grown on the raw rule statistics of a bounded sample of labelled rows.  A
document's score is ``2 ** (-mean path length / expected path length)``: rows that few
random splits set apart score high.  Two things are calibrated from the labels: how
often a split draws a statistic (by the square of the Kolmogorov-Smirnov distance between
its rejected and accepted rows, so that a statistic that says nothing about quality
does not make a document anomalous), and the threshold, which is the score that best
tells rejected from accepted rows, with a wrong rejection counting ``caution`` times.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sillage.llm.arrow import tidy
from sillage.llm.samples import bounded
from sillage.llm.scratch import Scratch, private, small

SYMBOLS = "#*$%&|<>"
#: Labelled rows that a forest is fitted on at most.
SAMPLE_ROWS = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_MORE = ["n_lines", "n_upper"]
_STRIP_SYMBOLS = str.maketrans("", "", SYMBOLS)
_SPACES = str.maketrans("", "", " \t\n\x0b\x0c\r")


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """Words that lie in a 3-word window found at least twice."""
    if len(ids) < 3:
        return 0
    pairs = ids[:-1] * kinds + ids[1:]
    if kinds > 2_000_000:
        pairs, kinds = np.unique(pairs, return_inverse=True)[1].astype(np.int64), len(ids)
        windows = pairs[:-1] * kinds + np.unique(ids[2:], return_inverse=True)[1]
    else:
        windows = pairs[:-1] * kinds + ids[2:]
    _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[place] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift : len(ids) - 2 + shift] |= twice
    return int(covered.sum())


def statistics(text: str | None) -> tuple[int, ...]:
    """COUNTS and the lines with a word and upper-case letters of a whole text; null counts as empty."""
    if not text:
        return (0,) * (len(COUNTS) + len(_MORE))
    known: dict[bytes, int] = {}
    seen: set[bytes] = set()
    ids: list[int] = []
    lines = repeats = 0
    for line in text.encode().split(b"\n"):
        words = line.split()
        if words:
            lines += 1
            if line in seen:
                repeats += 1
            else:
                seen.add(line)
            ids += [known.setdefault(w, len(known)) for w in words]
    lower = text.lower()
    upper = 0
    if lower != text and len(lower) == len(text):
        upper = int(np.count_nonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") != np.frombuffer(lower.encode("utf-32-le"), "<u4")))
    return (len(ids), len(text.translate(_SPACES)), len(text) - len(text.translate(_STRIP_SYMBOLS)), repeats, _repeated(np.array(ids, np.int64), len(known)), lines, upper)


def features(counts: np.ndarray) -> np.ndarray:
    """The rule statistics of rows of counts.

    Characters a word, symbols a word, repeated lines of all lines, repeated words of
    all words, capitals of all characters, and the logarithms of words and lines a word.
    """
    c = counts.astype(np.float64)
    words, chars, lines = (np.maximum(c[:, i], 1) for i in (0, 1, 5))
    return np.column_stack([chars / words, c[:, 2] / words, c[:, 3] / lines, c[:, 4] / words, c[:, 6] / chars, np.log(words), np.log(lines / words)])


def separation(x: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Kolmogorov-Smirnov distance between the bad and the other rows in each column; even without both kinds."""
    if not bad.any() or bad.all():
        return np.ones(x.shape[1])
    out = np.empty(x.shape[1])
    for k, column in enumerate(x.T):
        a, b = np.sort(column[bad]), np.sort(column[~bad])
        out[k] = np.abs(np.searchsorted(a, column, "right") / len(a) - np.searchsorted(b, column, "right") / len(b)).max()
    return out


def base_fails(counts: np.ndarray, min_words: int, max_repeat_percent: int) -> np.ndarray:
    return (counts[:, 0] < min_words) | (100 * counts[:, 4] > max_repeat_percent * counts[:, 0])


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays: split column (-1 for a leaf), split value, children, and a leaf's path length."""

    column: np.ndarray
    value: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    rows: int
    threshold: float = 2.0

    @classmethod
    def fit(cls, x: np.ndarray, trees: int = 100, rows: int = 256, seed: int = 7, weights: np.ndarray | None = None) -> Forest:
        """Random trees on samples of ``rows`` rows; ``weights`` say how often a split draws each column."""
        random = np.random.default_rng(seed)
        weights = np.ones(x.shape[1]) if weights is None else weights
        rows = min(rows, len(x))
        limit = int(np.ceil(np.log2(max(rows, 2))))
        size = 2 ** (limit + 1)
        column, value = np.full((trees, size), -1, np.int8), np.zeros((trees, size))
        child, depth = np.zeros((trees, size), np.int32), np.zeros((trees, size))
        for t in range(trees):
            stack, used = [(0, x[random.choice(len(x), rows, replace=False)], 0)], 1
            while stack:
                node, part, level = stack.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                open_columns = np.flatnonzero((high > low) & (weights > 0))
                if level >= limit or len(part) <= 1 or not len(open_columns):
                    depth[t, node] = level + _expected(len(part))
                    continue
                k = random.choice(open_columns, p=weights[open_columns] / weights[open_columns].sum())
                cut = random.uniform(low[k], high[k])
                column[t, node], value[t, node], child[t, node] = k, cut, used
                stack += [(used, part[part[:, k] < cut], level + 1), (used + 1, part[part[:, k] >= cut], level + 1)]
                used += 2
        return cls(column, value, child, depth, rows)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly of each row, 0 to 1."""
        total = np.zeros(len(x))
        for column, value, child, depth in zip(self.column, self.value, self.child, self.depth, strict=True):
            node, going = np.zeros(len(x), np.int32), np.arange(len(x))
            while len(going):
                k = column[node[going]]
                going, k = going[k >= 0], k[k >= 0]
                node[going] = child[node[going]] + (x[going, k] >= value[node[going]])
            total += depth[node]
        return 2.0 ** (-total / len(self.column) / max(float(_expected(self.rows)), 1e-9))

    def calibrate(self, x: np.ndarray, bad: np.ndarray, caution: float) -> None:
        """Set the threshold from rows labelled bad or not; without both kinds nothing is anomalous."""
        if not bad.any() or bad.all():
            self.threshold = 2.0
            return
        scores = self.score(x)
        order = np.argsort(-scores, kind="stable")
        hits, wrong = np.cumsum(bad[order]) / bad.sum(), np.cumsum(~bad[order]) / (~bad).sum()
        s = scores[order]
        last = np.r_[s[1:] < s[:-1], True]
        gain = np.where(last, hits - caution * wrong, -np.inf)
        best = int(np.argmax(gain))
        if gain[best] <= 0:
            self.threshold = 2.0
        else:
            self.threshold = float((s[best] + s[best + 1]) / 2) if best + 1 < len(s) else float(s[best])


_TYPES = ", ".join(f"{c} long" for c in COUNTS + _MORE)


def rule_statistics(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", forest: Forest | None = None) -> DataFrame:
    """doc_id and statistics of every row's whole text; with a forest, also its score (``anomaly``).

    Null and empty texts have zero counts.  Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = np.array([statistics(t.as_py()) for t in batch.column(1)], np.int64).reshape(-1, len(COUNTS) + len(_MORE))
            columns = [batch.column(0), *(pa.array(c) for c in counts.T)]
            if forest is not None:
                columns.append(pa.array(forest.score(features(counts))))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, *_MORE, "anomaly"][: len(columns)])

    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return source.mapInArrow(tidy(run), f"doc_id long, {_TYPES}" + ", anomaly double" * (forest is not None))


def fit_forest(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", min_words: int = 50, max_repeat_percent: int = 50, sample_rows: int = SAMPLE_ROWS, trees: int = 100, rows: int = 256, seed: int = 7, caution: float = 20.0) -> Forest | None:
    """A forest and threshold from at most ``sample_rows`` labelled rows (quality 1 accepted, 0 rejected).

    Label rows with a null id or quality are ignored; of a document labelled twice the
    lower quality counts, of rows that repeat a doc_id the greatest statistics.
    Documents that fail the base rules are left out, as the forest does not decide on
    them.  None without labelled documents.
    """
    known = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{quality}`").cast("int").alias("quality")).filter("doc_id is not null and quality is not null")
    held = bounded(known.groupBy("doc_id").agg(F.min("quality").alias("quality")), "doc_id", sample_rows).toPandas()
    if held.empty:
        return None
    ids = docs.sparkSession.createDataFrame([(int(i),) for i in held["doc_id"]], "doc_id long")
    chosen = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(ids), "doc_id", "left_semi")
    names = COUNTS + _MORE
    counted = rule_statistics(chosen).groupBy("doc_id").agg(F.max(F.struct(*names)).alias("s")).select("doc_id", "s.*").toPandas()
    found = counted.merge(held, on="doc_id").sort_values("doc_id")
    found = found[~base_fails(found[COUNTS].to_numpy().reshape(-1, len(COUNTS)), min_words, max_repeat_percent)]
    if found.empty:
        return None
    x, bad = features(found[names].to_numpy()), (found["quality"] == 0).to_numpy()
    forest = Forest.fit(x, trees, rows, seed, separation(x, bad) ** 2)
    forest.calibrate(x, bad, caution)
    return forest


def judge(docs: DataFrame, labels: DataFrame, *, min_words: int = 50, max_repeat_percent: int = 50, **options) -> DataFrame:
    """Verdict on every row: doc_id, COUNTS, anomaly, base_failed, kept.

    ``base_failed``: under ``min_words`` words, or more than ``max_repeat_percent`` of
    the words in repeated 3-word windows.  ``kept``: not base_failed and the forest's
    score under its threshold.  Without usable labels only the base rules decide.  One
    row for each input row; an empty table gives an empty result.
    """
    forest = fit_forest(docs, labels, min_words=min_words, max_repeat_percent=max_repeat_percent, **options)
    names = {k: v for k, v in options.items() if k in ("text", "doc_id")}
    counted = rule_statistics(docs, forest=forest, **names)
    if forest is None:
        counted = counted.withColumn("anomaly", F.lit(0.0))
    limit = 2.0 if forest is None else forest.threshold
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    out = counted.select("doc_id", *COUNTS, "anomaly", failed.alias("base_failed"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < limit))


def keep_good(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows of documents that ``judge`` rejects; all columns stay.

    A rejection holds for the doc_id; rows with a null doc_id stay.
    """
    judged = judge(docs, labels, text=text, doc_id=doc_id, **options)
    gone = private("gone")
    rejected = Scratch(docs.sparkSession, "quality").save(judged.filter("not kept and doc_id is not null").select(F.col("doc_id").alias(gone)).distinct())
    return docs.join(small(rejected), F.col(f"`{doc_id}`").cast("long") == F.col(gone), "left_anti")
