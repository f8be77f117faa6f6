"""From scanned pages to blocks, entities and threshold records, with overlays and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sillage.functions import clauses, text
from sillage.operators.ordered import blocks, first_per_key


def page_blocks(lines: DataFrame, *, page: str = "page", pos: str = "pos", least: float = 0.45) -> DataFrame:
    """Blocks of lines (page, pos, text, confidence, box of left, top, right, bottom).

    Lines without text or under ``least`` confidence are left out.  A block starts at a
    heading, after a gap of more than 1.15 median line heights, or where a sentence has
    ended and the line is indented by more than one.  Boxes are united, confidences
    averaged, texts joined and cleaned.
    """
    height = F.greatest(F.lit(1.0), F.col("box")[3] - F.col("box")[1])
    good = lines.filter((F.col("text") != "") & (F.col("confidence") >= least)).withColumn("_h", height)
    good = good.withColumn("_median", F.median("_h").over(Window.partitionBy(page)))
    order = Window.partitionBy(page).orderBy(pos)
    before, above = F.lag("text").over(order), F.lag("box").over(order)
    heading = clauses.block_type(F.col("text")).isin("chapter_heading", "section_heading")
    gap = F.col("box")[1] - above[3] > F.col("_median") * 1.15
    indented = before.rlike("[。！？；]$") & (F.col("box")[0] > above[0] + F.col("_median"))
    flagged = good.withColumn("_starts", before.isNull() | heading | gap | indented)
    numbered = blocks(flagged, [page], [pos], F.col("_starts"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, "text"))), lambda x: x["text"]), " ")
    box = F.array(F.min(F.col("box")[0]), F.min(F.col("box")[1]), F.max(F.col("box")[2]), F.max(F.col("box")[3]))
    out = numbered.groupBy(page, "block").agg(joined.alias("text"), box.alias("box"), F.round(F.avg("confidence"), 4).alias("confidence"))
    return out.withColumn("text", clauses.clean(F.col("text"))).withColumn("block_type", clauses.block_type(F.col("text")))


def correct(records: DataFrame, fixes: DataFrame, *, on: str = "page") -> DataFrame:
    """Records with their fixes (page, position, source, corrected) applied one after the other, each to the first place that its source stands.

    Fixes are grouped by page and joined, so a page's list is short however many there are.
    """
    listed = fixes.groupBy(on).agg(F.array_sort(F.collect_list(F.struct("position", "source", "corrected"))).alias("_fixes"))
    joined = records.join(listed, on, "left")

    def apply(t, fix):
        at = F.instr(t, fix["source"])
        cut = F.concat(F.substr(t, F.lit(1), at - 1), fix["corrected"], F.substr(t, at + F.length(fix["source"])))
        return F.when(at > 0, cut).otherwise(t)

    fixed = F.aggregate(F.coalesce("_fixes", F.array().cast("array<struct<position:int,source:string,corrected:string>>")), F.col("text"), apply)
    return joined.withColumn("corrected_text", fixed).select(*records.columns, "corrected_text", (F.col("text") != fixed).alias("is_corrected"))


def block_entities(found: DataFrame, *, page: str = "page", block: str = "block") -> DataFrame:
    """Each block with its entity: the one known registry number in it, or the last one before it since a heading.

    method and confidence: exact/high, inherited/medium, or none/low.  A heading or a
    profile without a number forgets what came before.
    """
    numbers = text.registry_numbers(F.col("text"))
    own = F.when(F.size(numbers) == 1, F.get(numbers, 0))
    marked = found.withColumn("_own", own)
    reset = F.col("block_type").isin("chapter_heading", "section_heading") | ((F.col("block_type") == "compound_profile") & (F.size(numbers) == 0))
    event = F.when(reset | F.col("_own").isNotNull(), F.struct(F.col("_own").alias("own")))
    carried = over_pages(marked, page, block, event, "_event", own_row=True).withColumn("_carried", F.col("_event.own"))
    method = F.when(F.col("_own").isNotNull(), "exact").when(F.col("_carried").isNotNull() & (F.size(numbers) == 0), "inherited").otherwise("none")
    entity = F.when(method == "exact", F.col("_own")).when(method == "inherited", F.col("_carried"))
    confidence = F.when(method == "exact", "high").when(method == "inherited", "medium").otherwise("low")
    return carried.select(*found.columns, entity.alias("entity"), method.alias("association_method"), confidence.alias("association_confidence"))


def over_pages(df: DataFrame, page: str, block: str, event: Column, name: str, *, own_row: bool) -> DataFrame:
    """The last non-null event so far in a book, with or without the row's own.

    Pages are reduced to their last events, which are carried over that table by runs of
    page numbers (all at once, if pages are no whole numbers); only the blocks of a page
    are sorted together.  Without a column ``book`` all pages
    are one book.
    """
    book = ["book"] if "book" in df.columns else []
    marked = df.withColumn("_value", event)
    last = marked.groupBy(*book, page).agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(block))).alias("_last"))
    carried = _carried(last, book, page)
    within = Window.partitionBy(*book, page).orderBy(block).rowsBetween(Window.unboundedPreceding, 0 if own_row else -1)
    joined = marked.join(carried, [*book, page], "left")
    return joined.withColumn(name, F.coalesce(F.last("_value", ignorenulls=True).over(within), "_before")).select(*df.columns, name)


def _carried(last: DataFrame, book: list[str], page: str, levels: int = 3) -> DataFrame:
    """(book, page, _before): the last ``_last`` of an earlier page.

    Whole numbers are cut in runs of 2**16, each sorted apart; what comes before a run is
    worked out alike from the runs, and from runs of runs, so no task sorts a whole book.
    """
    order = lambda *keys: Window.partitionBy(*keys).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last("_last", ignorenulls=True)
    if levels == 0 or not isinstance(last.schema[page].dataType, T.IntegralType):
        return last.select(*book, page, before.over(order(*book)).alias("_before"))
    part = f"_part_{levels}"
    rows = last.withColumn(part, F.shiftright(F.col(page).cast("long"), 16))
    parts = rows.groupBy(*book, part).agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col(page))).alias("_last"))
    ahead = _carried(parts, book, part, levels - 1).select(*(F.col(b).alias(f"_at_{b}") for b in book), F.col(part).alias("_at"), F.col("_before").alias("_ahead"))
    same = F.col(part).eqNullSafe(F.col("_at"))
    for b in book:
        same = same & F.col(b).eqNullSafe(F.col(f"_at_{b}"))
    found = rows.withColumn("_within", before.over(order(*book, part))).join(ahead, same, "left")
    return found.select(*book, page, F.coalesce("_within", "_ahead").alias("_before"))


def with_subjects(records: DataFrame, *, page: str = "page", block: str = "block") -> DataFrame:
    """Blocks with the subject of their statements: their own, or for blocks without an entity the one carried from the blocks before.

    A block without an entity hands on the name that it ends with, else its own subject.
    """
    free = F.coalesce(F.trim("entity"), F.lit("")) == ""
    own = records.withColumn("_own", clauses.subject(F.col("text")))
    handed = F.when(free, F.coalesce(clauses.trailing_subject(F.col("text")), F.col("_own")))
    carried = over_pages(own, page, block, handed, "_handed", own_row=False)
    return carried.withColumn("subject", F.coalesce("_own", F.when(free, F.col("_handed")))).drop("_own", "_handed")


def threshold_records(records: DataFrame) -> DataFrame:
    """A record for each clause with a value: medium, kind, route, values by role, subject and review flags.

    ``records`` may have a column ``subject`` (``with_subjects``); without one a block's
    own subject counts.
    """
    named = records if "subject" in records.columns else records.withColumn("subject", clauses.subject(F.col("text")))
    cut = named.filter(F.col("text").rlike(clauses.SIGNAL)).select("*", F.posexplode(clauses.clause_list(F.col("text"))).alias("clause_pos", "clause"))
    rows = cut.withColumn("values", clauses.values(F.col("clause"))).filter(F.size("values") > 0)
    rows = rows.withColumns({"medium": clauses.medium(F.col("clause")), "threshold_type": clauses.kind(F.col("text")), "route": clauses.route(F.col("text"))})
    own = F.filter("values", lambda v: v["role"] == "threshold")
    flags = clauses.review_flags(F.col("medium"), own, F.col("entity"), F.col("subject"), F.col("threshold_type"))
    return rows.withColumn("review_flags", flags).withColumn("review_status", F.when(F.size("review_flags") > 0, "review").otherwise("ok"))


def entities(found: DataFrame) -> DataFrame:
    """One row for each registry number: its first page and block."""
    rows = found.select("page", "block", F.explode(text.registry_numbers(F.col("text"))).alias("entity"))
    return first_per_key(rows, ["entity"], ["page", "block"])


def report(blocks_: DataFrame, thresholds: DataFrame, bad_patterns: dict[str, str]) -> DataFrame:
    """(metric, value): counts of blocks, entities and thresholds, of each block type, medium and doubt, and of each bad pattern in the texts."""
    count = lambda df, name: df.groupBy().agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
    by = lambda df, prefix, column: df.groupBy(F.concat(F.lit(prefix), column).alias("metric")).agg(F.count("*").alias("value"))
    out = count(blocks_, "blocks").unionAll(count(entities(blocks_), "entities")).unionAll(count(thresholds, "thresholds"))
    out = out.unionAll(by(blocks_, "block_type:", F.col("block_type"))).unionAll(by(thresholds, "medium:", F.col("medium")))
    out = out.unionAll(by(thresholds.select(F.explode("review_flags").alias("flag")), "flag:", F.col("flag")))
    if bad_patterns:
        found = blocks_.agg(*(F.coalesce(F.sum(F.regexp_count("text", F.lit(p))), F.lit(0)).cast("long").alias(n) for n, p in bad_patterns.items()))
        pairs = F.explode(F.array(*(F.struct(F.lit(f"bad:{n}").alias("metric"), F.col(n).alias("value")) for n in bad_patterns)))
        out = out.unionAll(found.select(pairs.alias("x")).select("x.metric", "x.value"))
    return out
