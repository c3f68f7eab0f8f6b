"""The registered queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickweir.llm import conversations, html, language, leaks, mixing, neighbours, oracle, phrases, ppm, shards, simhash, substrings, tokens, urls

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"),
         ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.documents_tokens(spark, _table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(spark, _table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, span: total + span["to"] - span["from"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    return (ppm.score(spark, _table(spark, sf_dir, "documents"))
            .select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))


def op4_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(spark, _table(spark, sf_dir, "embeddings"))


def op5_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_zstd_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    dictionaries = language.learn(docs.where(~language.held_out()))
    found = language.identify(spark, docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "accepted")


def op7_latent_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_fair_queueing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, _table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def op10_bloom_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark, _table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op11_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.assign(spark, _table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(spark, _table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(spark, conversations.damaged(_table(spark, sf_dir, "conversations")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, query in globals().items() if name.startswith("op") and name[2].isdigit()}


_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

OP10 = f"""
WITH rules(verdict, rhost, rpath) AS (VALUES {_RULES_SQL}),
cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
best AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(r.verdict, length(rhost || rpath)) AS verdict
  FROM split s JOIN rules r ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath) GROUP BY page_id)
SELECT s.page_id, s.host, s.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM split s LEFT JOIN best b USING (page_id)
"""


# Water filling in closed form: in ascending order of the share at which a source is full, it is full if the level of
# all sources from it on reaches that share.
OP8 = """
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5('mix' || coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS cap FROM sources),
filled AS (SELECT *, cap / weight <= (sum(source_size) OVER () - (sum(cap) OVER upto - cap))
    / (sum(weight) OVER () - (sum(weight) OVER upto - weight)) AS is_full
    FROM weighted WINDOW upto AS (ORDER BY cap / weight, place ROWS UNBOUNDED PRECEDING)),
targets AS (SELECT source, place, source_size, CASE WHEN is_full THEN cap ELSE
    (sum(source_size) OVER () - sum(CASE WHEN is_full THEN cap ELSE 0.0::DOUBLE END) OVER ()) * weight
    / sum(CASE WHEN is_full THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target FROM filled),
queue AS (SELECT s.*, place, source_size, target, sum(size) OVER (PARTITION BY place ORDER BY key, doc_id, size
    ROWS UNBOUNDED PRECEDING) AS done FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
served AS (SELECT doc_id, size, sum(size) OVER (ORDER BY (epoch * source_size + done) / target, place, epoch, key, doc_id, size
    ROWS UNBOUNDED PRECEDING) AS words FROM queue, (VALUES (0), (1), (2)) epochs(epoch) WHERE size > 0),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM served WHERE words <= (SELECT sum(size) FROM sized) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM queue q LEFT JOIN taken USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op8_fair_queueing": OP8, "op10_bloom_cascade": OP10, "op11_feistel_shards": oracle.OP11, "op12_collocations": oracle.OP12,
            "op13_conversation_repair": oracle.OP13}
