"""Weighted text retrieval over page chunks: term expansion, scoring, page collapse, grouping by entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sillage.functions.text import useful_term
from sillage.operators.ranking import score_listed, score_terms, top, with_signs
from sillage.operators.rollup import merge_overlap

#: Terms up to which their score is written out in the plan; beyond, they are a list beside each chunk.
LITERAL_TERMS = 50


def expand_terms(spark, query: str, entities: DataFrame, *, names: str = "names", key: str = "key", own: float = 40.0, named: float = 30.0, keyed: float = 36.0) -> list[tuple[str, float]]:
    """The query, its words, and all names of the entities that it names, each with its largest weight.

    An entity is named by equality, or for a non-ASCII query by containment.  The list
    is as long as the names of the entities that match; none is left out.
    """
    q = query.strip().lower()
    same = F.exists(names, lambda n: (F.lower(n) == q) | F.lower(n).startswith(q + " (") | F.lower(n).startswith(q + ",") | (F.lit(not q.isascii()) & F.contains(F.lower(n), F.lit(q))))
    hits = entities.filter(same | (F.lower(key) == q))
    parts = hits.select(F.explode(F.transform(names, F.lower)).alias("term"), F.lit(named).alias("weight")).unionAll(hits.select(F.lower(key).alias("term"), F.lit(keyed).alias("weight")))
    typed = [(q, own)] + [(w, own / 4) for w in q.split() if w != q]
    parts = parts.unionAll(spark.createDataFrame(typed, "term string, weight double"))
    best = parts.filter(useful_term(F.col("term"))).groupBy("term").agg(F.max("weight").alias("weight"))
    return [(r["term"], r["weight"]) for r in best.orderBy(F.desc("weight"), F.desc(F.length("term")), "term").collect()]


def search(chunks: DataFrame, terms: list[tuple[str, float]], *, text: str = "text", page: str = "page", chunk: str = "chunk", limit: int = 20, bonus: Column | None = None, entities: Column | None = None, named: list[str] | None = None) -> DataFrame:
    """The best pages with pos: chunks are scored, those without a term or named entity left out, chunks of a page collapsed, and the top taken.

    A page has its best chunk's score and 3 more for each further chunk, up to 9; its
    chunk numbers; and its chunks' texts merged at their overlaps.  Pages are ranked by
    scores alone; only the texts of those that are taken travel.
    """
    if len(terms) <= LITERAL_TERMS:
        scored = chunks.withColumn("_score", score_terms(F.col(text), terms))
    else:  # a single row, beside every chunk
        listed = chunks.sparkSession.createDataFrame([([(t.lower(), float(w)) for t, w in terms],)], "_terms array<struct<term:string,weight:double>>")
        scored = chunks.crossJoin(F.broadcast(listed)).withColumn("_score", score_listed(F.col(text), F.col("_terms"))).drop("_terms")
    scored = scored.withColumn("_score", with_signs(F.col("_score"), F.col(text), entities, named)).filter("_score > 0")
    if bonus is not None:
        scored = scored.withColumn("_score", F.col("_score") + bonus)
    pages = scored.groupBy(page).agg(F.max("_score").alias("_best"), F.count("*").alias("_n"))
    best = top(pages.select(page, (F.col("_best") + 3 * F.least(F.col("_n") - 1, F.lit(3))).alias("score")), [F.desc("score"), F.col(page)], limit)
    hits = scored.join(F.broadcast(best), page).groupBy("pos", page, "score").agg(F.array_sort(F.collect_list(F.struct(F.col(chunk).alias("chunk"), F.col(text).alias("text")))).alias("_hits"))
    return hits.select("pos", page, "score", F.transform("_hits", lambda h: h["chunk"]).alias("chunks"), merge_overlap(F.transform("_hits", lambda h: h["text"])).alias("merged"))


def by_entity(hits: DataFrame, entity: str, *, page: str = "page", text: str = "text", order: list[str] | None = None) -> DataFrame:
    """One row for each entity: its pages, best score and merged texts, in order."""
    order = order or [page]
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(page).alias("_p"), F.col(text).alias("_t"))))
    out = hits.groupBy(entity).agg(F.max("score").alias("score"), listed.alias("_l"))
    return out.select(entity, "score", F.array_distinct(F.transform("_l", lambda x: x["_p"])).alias("pages"), merge_overlap(F.transform("_l", lambda x: x["_t"])).alias("merged"))
