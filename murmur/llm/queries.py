"""Queries of the operators in this package: ``opN_<name>`` over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm.ann import nearest_neighbours
from murmur.llm.chat import chat_digest, format_chats
from murmur.llm.chat_repair import damaged, repair_chats
from murmur.llm.embed_dedup import near_duplicate_vectors
from murmur.llm.html_text import extract_text
from murmur.llm.mixing import mix_sources
from murmur.llm.packing import best_fit_pack
from murmur.llm.pii import pii_spans, span_digest
from murmur.llm.prefix_trie import prefix_trie, rebuilt
from murmur.llm.simhash import simhash_groups
from murmur.llm.topk import exact_top_k
from murmur.llm.toxicity import fit_toxicity, held_out, score_toxicity
from murmur.llm.url_filters import filter_urls, filter_urls_sql, outcomes_of_labels

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_register
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))


@_register
def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@_register
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(pii_spans(table(spark, sf_dir, "documents")))


@_register
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_register
def op8_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return mix_sources(docs).select("doc_id", "source", "weight", "block", "slot", "position")


@_register
def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    outcomes = outcomes_of_labels(pages, table(spark, sf_dir, "labels"))
    return filter_urls(pages, outcomes).select(
        "page_id", "host", "path", "rule", "verdict", F.round("bad_rate", 6).alias("bad_rate"),
        F.round("bad_rate_low", 6).alias("bad_rate_low"))


ORACLE["op1_url_filters"] = filter_urls_sql()


#: A conversation whose texts hold control strings of common templates.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


@_register
def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    return chat_digest(format_chats(turns.unionByName(probe)))


@_register
def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


@_register
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0).withColumnRenamed(
        "id", "vec_id")


#: floor(64 x) as integers, every query against every row.
ORACLE["op3_exact_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 20"""


@_register
def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "covered_blocks")


@_register
def op11_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


#: All pairs by brute force, and the smallest id that is reachable.
ORACLE["op11_embed_dedup"] = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
u AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM u a JOIN u b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.dst FROM reach r JOIN l ON l.src = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.src = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c"""


@_register
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), arrange=rebuilt)


#: CRC-32 of a number's decimal form, bit by bit.
_CRC_SQL = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT),
  list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
    lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"""

#: Every prefix by its turns' digests; subtree sums over (node, ancestor) pairs.
ORACLE["op12_prefix_trie"] = f"""
WITH t AS (SELECT conv_id AS c, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS m,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
v AS (SELECT c, count(*) AS n, {_CRC_SQL} % 4 AS h, c - c % 20 AS lead FROM t GROUP BY c),
r AS (SELECT v.c, t.p AS pos, t.m, t.words FROM v JOIN t ON t.c = v.lead AND t.p <= v.h UNION ALL
  SELECT v.c, t.p - v.h + least(v.h, coalesce(l.n, 0)), t.m, t.words
  FROM v JOIN t ON t.c = v.c AND t.p > v.h LEFT JOIN v l ON l.c = v.lead),
pre AS (SELECT c, pos AS depth, string_agg(m, '') OVER (PARTITION BY c ORDER BY pos) AS k, words FROM r
  UNION ALL SELECT c, 0, '', 0 FROM v),
node AS (SELECT depth, k, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words FROM pre GROUP BY 1, 2),
kids AS (SELECT depth - 1 AS depth, left(k, len(k) - 64) AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1, 2),
full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (depth, k)),
sub AS (SELECT a.depth, a.k, count(*) FILTER (WHERE b.n_children = 0) AS n_leaves,
    CAST(sum((b.n_convs - 1) * b.words) AS BIGINT) AS saved_tokens
  FROM full_node b JOIN pre a ON a.c = b.conv_id AND a.depth <= b.depth GROUP BY 1, 2),
ends AS (SELECT depth, k, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids
  FROM (SELECT c, max(depth) AS depth FROM pre GROUP BY c) JOIN pre USING (c, depth) GROUP BY 1, 2)
SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens,
  sha256(coalesce(ids, '')) AS ends_sha256
FROM full_node f JOIN sub USING (depth, k) LEFT JOIN ends USING (depth, k)
LEFT JOIN node up ON up.depth = f.depth - 1 AND up.k = left(f.k, greatest(len(f.k) - 64, 0))"""


@_register
def op13_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_chats(table(spark, sf_dir, "conversations"), damage=damaged)[1].withColumnRenamed("conv", "conv_id")
