"""The queries that apply the operators of this subpackage to their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.llm import bpe, chat, langid, minhash, mixing, phrases, pii, quality, search, secretscan, sketch, urls, warc
from sillage.llm.arrow import whole_texts
from sillage.llm.scratch import Scratch

#: Parameters of the production runs.
TOKENIZER = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TOKEN_PATTERN = public_tokenizers.PATTERN
SECRET_TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")
WEIGHTS = {"clean": 0.985, "toxic": 0.01, "low": 0.005}
PII_KEY = "change-me: read this from a secret store"
URL_RULES = [
    urls.HostRule("allow", "com"),
    urls.HostRule("block", "example.com", "/en/"),
    urls.HostRule("allow", "www.example.com", "/en/"),
    urls.HostRule("block", "net", "/es/"),
    urls.HostRule("block", "net", "/fr/"),
]
EXTRA_CONVERSATION = r"\### Assistant: </turn> ok"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus, in a session set up for whole texts."""
    return whole_texts(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates and copies of all documents for WEIGHTS."""
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), WEIGHTS)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.Vocabulary(bpe.load_ranks(TOKENIZER))
    out = bpe.encode(table(spark, sf_dir, "documents"), vocabulary, TOKEN_PATTERN, key="doc_id", decoded=True)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive(table(spark, sf_dir, "pages"), Scratch(spark, "warc").folder)
    return warc.read_archives(files).select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


#: Roles that every layout gives back as they are, and characters of a conversation up to which it becomes a record.
RECORD_ROLES, RECORD_CHARS = ("user", "assistant", "system"), 1_000_000


def _chat_turns(rows: DataFrame) -> DataFrame:
    """Half of the conversations as they stand, a turn a row; the others as JSON records in five layouts, as sources deliver them.

    A conversation stays rows if it is too long for a record or has other roles.
    """
    as_record = F.coalesce(F.pmod(F.xxhash64("conv_id"), F.lit(2)) == 0, F.lit(False))
    listed = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    whole = rows.filter(as_record).groupBy("conv_id").agg(listed.alias("t"), F.sum(F.length("text")).alias("chars"))
    turns = lambda role, text: F.transform("t", lambda t: F.struct(t["role"].alias(role), t["text"].alias(text)))
    pair = (F.size("t") == 2) & (F.get("t", 0)["role"] == "user") & (F.get("t", 1)["role"] == "assistant") & (F.get("t", 0)["text"] != "") & (F.get("t", 1)["text"] != "")
    first, second, kind = F.get("t", 0)["text"], F.get("t", 1)["text"], F.pmod(F.xxhash64("conv_id", F.lit("layout")), F.lit(3))
    record = (
        F.when(pair & (kind == 0), F.to_json(F.struct(first.alias("prompt"), second.alias("response"))))
        .when(pair & (kind == 1), F.to_json(F.struct(first.alias("instruction"), second.alias("output"), F.lit("x").alias("source"))))
        .when(kind == 0, F.to_json(F.struct(turns("role", "content").alias("messages"), F.lit(1).alias("n"))))
        .when(kind == 1, F.to_json(F.struct(turns("from", "value").alias("conversations"))))
        .otherwise(F.to_json(F.struct(turns("speaker", "text").alias("dialog"))))
    )
    fits = (F.coalesce("chars", F.lit(0)) <= RECORD_CHARS) & F.forall("t", lambda t: t["role"].isin(*RECORD_ROLES))
    made = whole.withColumn("record", F.when(fits, record))
    records = chat.turns_from_json(made.filter("record is not null"), payload="record", key="conv_id").drop("layout")
    others = made.filter("record is null").select("conv_id", F.explode("t").alias("x")).select("conv_id", "x.turn", "x.role", "x.text")
    plain = rows.filter(~as_record).unionByName(others)
    return chat.turns_from_table(plain, key="conv_id").unionByName(records)


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = [(-7, 0, "user", EXTRA_CONVERSATION), (-7, 1, "assistant", EXTRA_CONVERSATION)]
    rows = rows.unionByName(spark.createDataFrame(extra, "conv_id long, turn long, role string, text string"))
    read = chat.parse_chats(chat.format_chats(_chat_turns(rows)))
    read = read.withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_mask")))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("key").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pseudonymised documents and how many values of each kind were replaced."""
    out = pii.mask(table(spark, sf_dir, "documents"), PII_KEY)
    counts = [(F.size("pii_kinds") - F.size(F.array_remove("pii_kinds", k))).alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", "text", F.size("pii_kinds").alias("n_replaced"), *counts)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), [*URL_RULES, *urls.UNWANTED])
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    both = sketch.with_next(docs, extra={"own": sketch.sketch(F.col("text").cast("string"))})
    text, following = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    size = F.length(text)
    moved = F.floor(size / 4).cast("int")
    edited = F.concat(F.substr(text, F.lit(1), size - moved), F.substr(following, F.lit(1), moved))
    both = both.select("doc_id", size.cast("long").alias("n_chars"), edited.alias("edited"), "own", "next_own")
    both = both.withColumn("changed", sketch.sketch(F.col("edited")))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        sketch.as_text(F.col("own")).alias("fingerprint"),
        sketch.as_text(F.col("changed")).alias("edited_fingerprint"),
        sketch.resemblance(F.col("own"), F.col("changed")).alias("near_edited"),
        sketch.resemblance(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit_language_model(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find_secrets(table(spark, sf_dir, "documents"), bpe.load_ranks(SECRET_TOKENIZER), TOKEN_PATTERN)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = secretscan.listed(F.col("spans"), lambda kind: kind.isin(*secretscan.BASE))
    return found.select("doc_id", *(count(k).alias(f"n_{k}") for k in secretscan.BASE), F.sha2(base, 256).alias("base_sha256"), secretscan.listed(F.col("spans")).alias("spans"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_phrases(phrases.phrases(table(spark, sf_dir, "documents")))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = search.build_index(table(spark, sf_dir, "documents"))
    found = search.search(index, table(spark, sf_dir, "benchmark"))
    index.scratch.drop()  # the result is written
    return found


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_mixing, op2_bpe, op3_warc, op4_minhash, op5_chat, op6_pii, op7_quality, op8_urls, op9_sketch, op10_language, op11_secrets, op12_phrases, op13_search, pipeline)
}

_WARC_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
m AS (SELECT h, max(page_id) AS holder FROM d GROUP BY h),
b AS (SELECT *, unhex(d.h)::BIT::VARCHAR AS bits FROM d JOIN m USING (h))
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS INTEGER), 1) AS INTEGER) * (16 >> CAST(j AS INTEGER))))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = holder OR holder IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM b
"""

_MINHASH_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

_CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
p AS (SELECT *, '<turn role="' || role || '">' || regexp_replace(text, '<(\\*)(/?turn)', '<\\\1\2', 'g') || '</turn>' || chr(10) AS piece FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(piece))::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""

_URL_SQL = r"""
WITH p AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN regexp_matches(host || path, '(^|[.\-])(casino|adult|bets|pills)([.\-]|/)')
    OR regexp_matches(host || path, '(^|\.)ads?([.\-]|/)') OR regexp_matches(host || path, '[.\-/](track|tracker|pixel)([.\-/]|$)') THEN 'block'
  ELSE 'allow' END AS verdict FROM r
"""

_PHRASES_SQL = r"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM w GROUP BY lang),
g AS (
  SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])) AS g
  FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k),
f AS (SELECT lang, k, g, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
inside AS (
  SELECT DISTINCT s.lang, s.g FROM f s JOIN f b ON b.lang = s.lang AND b.k = s.k + 1 AND 100 * b.f >= 100 * s.f AND (b.g[1:s.k] = s.g OR b.g[2:s.k + 1] = s.g) WHERE s.k >= 2),
c AS (
  SELECT f.lang, f.g, f.f AS a, n.n, x.f AS l, y.f AS r, cut, 1000 * f.f * n.n // (x.f * y.f) AS score
  FROM f JOIN n ON n.lang = f.lang, (SELECT unnest([1, 2, 3, 4]) AS cut), f x, f y
  WHERE f.k >= 2 AND cut < f.k AND x.lang = f.lang AND x.k = cut AND x.g = f.g[1:cut] AND y.lang = f.lang AND y.k = f.k - cut AND y.g = f.g[cut + 1:f.k]
  AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.lang = f.lang AND i.g = f.g)),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) AS nth FROM c),
t AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM b WHERE nth = 1),
k AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM t)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM k WHERE rank <= 2000
"""

_SEARCH_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
g AS (SELECT count(*) FILTER (WHERE len(t) > 0)::BIGINT AS big_n, sum(len(t))::BIGINT AS big_l FROM d),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM f, g),
q AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
i AS (SELECT item_id, term, count(*)::BIGINT AS times FROM q GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * big_n) // big_l)))))::BIGINT AS score
  FROM i JOIN w USING (term) JOIN p USING (term), g GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op3_warc": _WARC_SQL, "op4_minhash": _MINHASH_SQL, "op5_chat": _CHAT_SQL, "op8_urls": _URL_SQL, "op12_phrases": _PHRASES_SQL, "op13_search": _SEARCH_SQL}
