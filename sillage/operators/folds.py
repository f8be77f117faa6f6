"""Lines, blocks and references from the geometry and order of scanned characters and lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _anchors(tops: np.ndarray, reach: float) -> np.ndarray:
    """The line of each character, for characters in reading order: a line reaches as far as its first character's top allows."""
    line = np.zeros(len(tops), np.int64)
    start = 0
    while True:
        beyond = np.flatnonzero(np.abs(tops[start:] - tops[start]) > reach)
        if not len(beyond):
            return line
        start += int(beyond[0])
        line[start:] += 1


def lines_of_characters(chars: DataFrame, *, same_line: float = 4.0, space: float = 1.5, paragraph: float = 3.0) -> DataFrame:
    """(doc, page, block, line, text) of characters (doc, page, top, left, right, bottom, char).

    Characters are read by rounded top, then left.  A line holds those whose top lies
    within ``same_line`` of its first one's; a gap wider than ``space`` is a blank; a
    block starts where the gap above a line is larger than ``paragraph``.  A page is one
    Python call on Arrow data; pages are spread over tasks.
    """

    def page_lines(page: pd.DataFrame) -> pd.DataFrame:
        page = page.assign(at=page["top"].round()).sort_values(["at", "left"], kind="stable")
        page["line"] = _anchors(page["top"].to_numpy(), same_line)
        page = page.sort_values(["line", "left"], kind="stable")
        gap = page["left"] - page.groupby("line")["right"].shift()
        page["piece"] = np.where(gap > space, " " + page["char"], page["char"])
        lines = page.groupby("line").agg(text=("piece", "".join), top=("top", "min"), bottom=("bottom", "max")).reset_index()
        lines["block"] = (lines["top"] - lines["bottom"].shift() > paragraph).cumsum()
        return lines.assign(doc=page["doc"].iloc[0], page=page["page"].iloc[0])[["doc", "page", "block", "line", "text"]]

    return chars.groupBy("doc", "page").applyInPandas(page_lines, "doc string, page int, block int, line int, text string")


# How a reference may start, what its year looks like, and lines that are no part of one.
_STARTS = [
    r"^(VAN|DE|VON|LE|LA|DU|DI)\s+[A-ZÀ-Ž]{2,}",
    r"^[A-ZÀ-Ž][A-ZÀ-Ž\-']++\s*(,|\(\d{4}|(?i:et\s*al)|\([A-Z]|&|[A-Z]\.)",
    r"^[A-ZÀ-Ž],\s*[A-ZÀ-Ž]\.",
]
_YEAR = r"\(\d{4}[a-z]?\)"
_FURNITURE = [r"(?i)^(?=.{0,29}$).*REFERENCES", r"^\d+$", r"(?i)COMPILATIONS OF ODOUR", r"^[A-Z]$"]


def references_of_lines(lines: DataFrame) -> DataFrame:
    """(doc, number, reference) of lines (doc, pos, text): a reference starts where a line may start one and the one before has its year.

    Page furniture and empty lines are left out.  Lines that may start one cut the
    document in stretches.  Such a line starts one just if the stretch before it has a
    year: a year further back belongs to this reference only if the stretches between
    were not started on their own, and then it would have started them.
    """
    text = F.trim(F.coalesce("text", F.lit("")))
    rows = lines.select("doc", "pos", text.alias("text")).filter("text <> ''")
    for pattern in _FURNITURE:
        rows = rows.filter(~F.col("text").rlike(pattern))
    may = F.lit(False)
    for pattern in _STARTS:
        may = may | F.col("text").rlike(pattern)
    order = Window.partitionBy("doc").orderBy("pos")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    cut = rows.withColumn("_may", may).withColumn("_stretch", F.sum(F.when(F.col("_may"), 1).otherwise(0)).over(so_far))
    dated = cut.withColumn("_dated", F.max(F.col("text").rlike(_YEAR)).over(Window.partitionBy("doc", "_stretch")))
    starts = F.col("_may") & F.coalesce(F.lag("_dated").over(order), F.lit(False))
    numbered = dated.withColumn("number", F.sum(F.when(starts, 1).otherwise(0)).over(so_far))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ")
    found = numbered.groupBy("doc", "number").agg(F.regexp_replace(joined, r"\s+", " ").alias("reference"))
    return found.select("doc", (F.col("number") + 1).cast("int").alias("number"), "reference")
