"""Five stages from raw documents to token ids.

Quality rules, near-duplicate removal, pseudonyms for personal data, mixing to target
weights, and byte-level BPE.  Each stage takes (spark, docs, sf_dir) and works on all
that the stage before kept; all but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm import bpe, minhash, mixing, pii, quality
from sillage.llm.arrow import whole_texts
from sillage.llm.queries import PII_KEY, TOKEN_PATTERN, TOKENIZER, table
from sillage.llm.scratch import Scratch, private


#: Target shares of tokens.  Low quality is gone by then, so the domains are those of toxicity; the posteriors of clean
#: documents alone hold some two per cent of toxic tokens, so a smaller target would have to be met at their cost.
DOMAIN_WEIGHTS = {"clean": 0.97, "toxic": 0.03}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go, by doc_id.

    Null and empty texts have no words and fail the base rules; rows with a null doc_id
    stay; repeated rows share their document's fate; columns may have any names.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Texts without words are nobody's duplicates; rows with a null doc_id stay; rows that
    repeat a kept doc_id all stay, as they are that document.
    """
    return minhash.deduplicate(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become pseudonyms, and n_chars the new length (null for a null text); every row stays."""
    masked = pii.mask(docs, PII_KEY, kinds=private("kinds")).withColumn("n_chars", F.length("text").cast("long"))
    return masked.select(*(F.col(f"`{c}`") for c in docs.columns))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as their rates say, for the target weights at the present number of tokens.

    Null and empty texts have no tokens and the posterior of a text without words; rows
    with a null doc_id draw like others; without labels every row comes back once.
    """
    toxic = F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean")
    return mixing.mix(docs, table(spark, sf_dir, "labels"), DOMAIN_WEIGHTS, domain=toxic)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (packed little-endian 32-bit) and the digest of the text decoded from them.

    A row for each row; a null or empty text has no ids.
    """
    whole_texts(spark)
    out = bpe.encode(docs, bpe.Vocabulary(bpe.load_ranks(TOKENIZER)), TOKEN_PATTERN, key="doc_id", decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("personal data", personal_data),
    ("mixing", mixture),
    ("token ids", token_ids),
]

#: Forest, classifier and pseudonyms can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again before the next.

    A stage's input is deleted when its output is written; what the last stage reads
    stays until the result is done with (``scratch.sweep``, or the end of the process).
    After a failure nothing of the run's own tables stays.
    """
    docs, held = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        scratch = Scratch(spark, "pipeline")
        try:
            docs = scratch.save(stage(spark, docs, sf_dir))
        finally:
            if held is not None:
                held.drop()
        held = scratch
    return STAGES[-1][1](spark, docs, sf_dir)
