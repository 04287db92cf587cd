"""The queries of this package, each over whole tables, and the SQL of those that SQL can state."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segue.llm.bit_sliced import top_products
from segue.llm.collision_search import nearest_vectors
from segue.llm.hard_negatives import mine_hard_negatives
from segue.llm.languages import predict_languages
from segue.llm.line_dedup import delete_repeated_lines
from segue.llm.mixing import mix
from segue.llm.packing import pack_documents
from segue.llm.shared import held_out, table
from segue.llm.sharding import shard_documents
from segue.llm.simhash import near_duplicates
from segue.llm.token_counts import count_tokens
from segue.llm.token_store import stored_documents, write_tokens
from segue.llm.toxicity import score_toxicity
from segue.llm.whitening import whiten
from segue.session import record_written, shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_collision_search")
def op1_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=1024, end_id=2)


OP3_SQL = """
WITH parts AS (
    SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
whole AS (SELECT vec_id, i, floor(64 * x::DOUBLE)::BIGINT AS x FROM parts),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
    FROM whole q JOIN whole c ON q.i = c.i AND q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0 GROUP BY ALL
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op3_bit_sliced_search", OP3_SQL)
def op3_bit_sliced_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20, scale=64.0)


# Target weights of the mix: domains, and their languages; sources share equally.
DOMAINS = ("web", "books", "forum")
WEIGHTS = {("web",): 5, ("books",): 3, ("forum",): 2} | {
    (d, lang): w for d in DOMAINS for lang, w in (("en", 5), ("de", 2), ("fr", 2), ("es", 1))
}


def source_path() -> dict:
    """The tree of a document: a domain by its source's number, its language, its source."""
    number = F.coalesce(F.expr("TRY_CAST(regexp_extract(source, '[0-9]+', 0) AS INT)"), F.lit(0)) % len(DOMAINS)
    domain = F.element_at(F.array(*map(F.lit, DOMAINS)), number + 1)
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def estimated_tokens():
    """Tokens by the usual four bytes each."""
    return F.ceil(F.octet_length("text") / 4)


def _divided_sql(level: str, above: str, keys: str, parent: str, name: str) -> str:
    """One level of the division of budgets: CTEs that end in ``{level}``."""
    by = f"PARTITION BY {parent}" if parent else ""
    join = f"JOIN {above} USING ({parent})" if parent else f"CROSS JOIN {above}"
    return f"""
{level}1 AS (SELECT {keys}, sum(have)::BIGINT * 3 AS capacity, coalesce(any_value(w{level}), 1) AS weight FROM leaves GROUP BY {keys}),
{level}2 AS (
    SELECT n.*, total, coalesce(sum(capacity) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after
    FROM {level}1 n {join} WHERE capacity > 0 AND weight > 0
    WINDOW o AS ({by} ORDER BY capacity / weight, {name})
),
{level}3 AS (SELECT *, capacity::HUGEINT * after <= weight::HUGEINT * (total - before) AS filled FROM {level}2),
{level}4 AS (
    SELECT *, total - coalesce(sum(capacity) FILTER (filled) OVER ({by}), 0) AS remaining,
        sum(weight) FILTER (NOT filled) OVER ({by}) AS weights FROM {level}3
),
{level}5 AS (SELECT *, CASE WHEN NOT filled THEN weight::HUGEINT * remaining // weights END AS part FROM {level}4),
{level} AS (
    SELECT {keys}, (CASE WHEN filled THEN capacity ELSE part
        + (row_number() OVER ({by} ORDER BY filled, {name}) <= remaining - sum(part) OVER ({by}))::INT END)::BIGINT AS total
    FROM {level}5
)"""


OP4_SQL = f"""
WITH docs AS (
    SELECT doc_id, ['web', 'books', 'forum'][coalesce(TRY_CAST(regexp_extract(source, '[0-9]+') AS INT), 0) % 3 + 1] AS domain,
        coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(ceil(strlen(text) / 4)::BIGINT, 0) AS tokens
    FROM documents
),
leaves AS (
    SELECT domain, lang, source, sum(tokens) AS have, CASE domain WHEN 'web' THEN 5 WHEN 'books' THEN 3 ELSE 2 END AS wa,
        CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 1 ELSE 1 END AS wb, 1 AS wc
    FROM docs GROUP BY ALL
),
root AS (SELECT sum(have)::BIGINT AS total FROM leaves),
{_divided_sql("a", "root", "domain", "", "domain")},
{_divided_sql("b", "a", "domain, lang", "domain", "lang")},
{_divided_sql("c", "b", "domain, lang, source", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, (total // have)::BIGINT AS full_epochs, (total % have)::BIGINT AS rest FROM c JOIN leaves USING (domain, lang, source)),
coded AS (SELECT *, md5('17:' || full_epochs || ':' || doc_id) AS code FROM docs JOIN plan USING (domain, lang, source)),
placed AS (
    SELECT *, coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY code, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar
    FROM coded
)
SELECT doc_id, domain, lang, source, unnest(range(full_epochs)) AS epoch, tokens, tokens AS taken FROM coded
UNION ALL
SELECT doc_id, domain, lang, source, full_epochs, tokens, least(tokens, rest - sofar)::BIGINT FROM placed
WHERE rest > 0 AND tokens > 0 AND sofar < rest
"""


@query("op4_source_mixing", OP4_SQL)
def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    mixed = mix(docs, source_path(), WEIGHTS, estimated_tokens(), share=1.0, max_epochs=3, seed=17)
    return mixed.select("doc_id", "domain", "lang", "source", "epoch", "tokens", "taken")


@query("op5_toxicity")
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


@query("op6_token_store")
def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = record_written(f"{shared_folder(spark).rstrip('/')}/segue/tokens-{uuid.uuid4().hex}")
    write_tokens(table(spark, sf_dir, "documents"), path, end_id=0)
    return stored_documents(spark, path, with_ids=False)


OP7_SQL = r"""
WITH texts AS (
    SELECT doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13))) AS lines FROM documents
),
exploded AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS no FROM texts),
numbered AS (
    SELECT doc_id, no, md5(line) AS line, greatest(1, len(regexp_extract_all(line, '[^\s\x0B\x{85}\p{Z}]+'))) AS words,
        row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS seq
    FROM exploded WHERE line <> ''
),
sums AS (
    SELECT a.doc_id, a.seq, b.seq AS other, sum(b.words) OVER (PARTITION BY a.doc_id, a.seq ORDER BY b.seq) AS ahead, NULL AS behind
    FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + 49
    UNION ALL
    SELECT a.doc_id, a.seq, b.seq, NULL, sum(b.words) OVER (PARTITION BY a.doc_id, a.seq ORDER BY b.seq DESC)
    FROM numbered a JOIN numbered b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq - 49 AND a.seq
),
runs AS (
    SELECT doc_id, seq AS lo, min(other) AS hi FROM sums WHERE ahead >= 50 GROUP BY ALL
    UNION
    SELECT doc_id, max(other), seq FROM sums WHERE behind >= 50 GROUP BY doc_id, seq
),
keyed AS (
    SELECT r.doc_id, lo, hi, string_agg(n.line, ',' ORDER BY n.seq) AS content
    FROM runs r JOIN numbered n ON r.doc_id = n.doc_id AND n.seq BETWEEN lo AND hi GROUP BY ALL
),
later AS (
    SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, lo) AS copy FROM keyed
),
gone AS (
    SELECT DISTINCT n.doc_id, n.no FROM later l JOIN numbered n ON l.doc_id = n.doc_id AND n.seq BETWEEN lo AND hi WHERE copy > 1
),
per_doc AS (SELECT doc_id, string_agg(no::VARCHAR, ',' ORDER BY no) AS removed, count(*) AS n_removed FROM gone GROUP BY doc_id),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS no FROM documents),
kept AS (
    SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.no) AS text
    FROM raw r WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = r.doc_id AND g.no = r.no) GROUP BY r.doc_id
)
SELECT d.doc_id, coalesce(removed, '') AS removed, coalesce(n_removed, 0)::INTEGER AS n_removed,
    CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.text, '')) END AS text_md5
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query("op7_line_dedup", OP7_SQL)
def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = delete_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50)
    return kept.select("doc_id", F.array_join("removed_lines", ",").alias("removed"), F.size("removed_lines").alias("n_removed"), F.md5("text").alias("text_md5"))


@query("op8_language_mixture")
def op8_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), limit=2048)


@query("op10_simhash")
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, max_bits=2)


@query("op11_sampled_splitters")
def op11_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24, law="bytes")


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    white = whiten(table(spark, sf_dir, "embeddings"), scale=256.0, components=4)
    return white.withColumn("deviation", F.col("deviation").cast("long"))


OP13_SQL = """
WITH usable AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
    SELECT vec_id, label, floor(256 * unnest(embedding)::DOUBLE)::BIGINT AS x, generate_subscripts(embedding, 1) AS i FROM usable
),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, sum(a.x * c.x)::BIGINT AS score
    FROM parts a JOIN parts c ON a.i = c.i AND a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
ranked AS (
    SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
        row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
    FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
        AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""


@query("op13_cover_tree_negatives", OP13_SQL)
def op13_cover_tree_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)
