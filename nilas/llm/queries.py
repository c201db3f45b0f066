"""The queries of this subpackage: one thin function per operator, and their SQL where it can be said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nilas.llm import embedding_join, line_dedup, mixing, ngram_join, packing, sharding, suffix_index, token_count, topk, toxicity
from nilas.llm.common import read_table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    lexicon = toxicity.learn(docs, labels, train=~held_out())
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_index.remove_repeats(read_table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("kept"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), digest)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(read_table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near(read_table(spark, sf_dir, "embeddings"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(read_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_packing, op3_suffix_dedup, op4_sharding, op5_topk, op6_embedding_dedup, op7_line_dedup, op8_mixing,
        op9_token_count, op10_ngram_jaccard,
    )
}

LINE_KEY = r"""translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""

SQL = {
    "op4_sharding": f"""
WITH lookup AS (
  SELECT generate_subscripts(a, 1) - 1 AS slot, CAST(unnest(a) AS INTEGER) AS shard
  FROM (SELECT string_split('{",".join(map(str, sharding.fill_table([f"shard-{i}" for i in range(64)], 65_537)))}', ',') AS a)
), placed AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % 65537 AS slot FROM documents
)
SELECT doc_id, CAST(slot AS BIGINT) AS slot, shard FROM placed JOIN lookup USING (slot)""",
    "op5_topk": """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op6_embedding_dedup": """
WITH RECURSIVE fine AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM fine a JOIN fine b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9
), reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a
), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id""",
    "op7_line_dedup": f"""
WITH split AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), lines AS (
  SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM split
), keyed AS (SELECT r, doc_id, pos, line, {LINE_KEY} AS key FROM lines
), frequent AS (
  SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (SELECT k.*, f.key IS NOT NULL AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id""",
    "op8_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    coalesce(CAST(doc_id AS VARCHAR), '') || ':' || substr(md5(coalesce(text, '')), 1, 16) AS name FROM documents
), bysource AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), named AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM bysource
), weighed AS (
  SELECT *, CAST([5, 2, 1][CAST((source_no - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w, source_size * 3.0::DOUBLE AS cap FROM named
), levelled AS (
  SELECT *, row_number() OVER o AS nth, (sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0.0))
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0.0)) AS lam
  FROM weighed WINDOW o AS (ORDER BY cap / w, source_no), b AS (ORDER BY cap / w, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), aimed AS (
  SELECT source, source_no, source_size, least(cap, w * (SELECT arg_min(lam, nth) FROM levelled WHERE lam <= cap / w)) AS target FROM levelled
), total AS (SELECT sum(target) AS v, CAST(round(sum(source_size) / 8.0) AS BIGINT) AS n, count(*) AS k FROM aimed
), ranges AS (
  SELECT a.*, n, greatest(0, CAST(floor(target * n / v - 1 - k - target * k / v) AS BIGINT)) AS low,
    CAST(ceil(target * n / v + 1 + k + target * k / v) AS BIGINT) AS high FROM aimed a, total WHERE v > 0
), rivals AS (SELECT *, unnest(range(low, high + 1)) AS s FROM ranges
), won AS (
  SELECT *, row_number() OVER (ORDER BY target / (2 * s + 1) DESC, source_no, s) AS place,
    n - (SELECT sum(low) FROM ranges) AS open FROM rivals
), quotas AS (
  SELECT source_no, any_value(source) AS source, any_value(source_size) AS source_size, any_value(target) AS target,
    any_value(low) + count(*) FILTER (WHERE place <= open) AS blocks,
    greatest(1, CAST(ceil(any_value(source_size) / 1048576.0) AS BIGINT)) AS shards FROM won GROUP BY source_no
), rws AS (
  SELECT s.doc_id, s.size, s.name, q.*, CAST('0x' || substr(md5('11:shard:' || name), 1, 12) AS BIGINT) % shards AS shard
  FROM sized s JOIN quotas q ON s.source IS NOT DISTINCT FROM q.source
), sh AS (SELECT source_no, shard, CAST(sum(size) AS BIGINT) AS shard_size, any_value(blocks) AS blocks FROM rws GROUP BY ALL
), srange AS (
  SELECT *, sum(shard_size) OVER (PARTITION BY source_no) AS v, count(*) OVER (PARTITION BY source_no) AS k FROM sh
), slow AS (
  SELECT *, CASE WHEN v > 0 THEN greatest(0, CAST(floor(shard_size * blocks / v - 1 - k - shard_size * k / v) AS BIGINT)) ELSE 0 END AS low,
    CASE WHEN v > 0 THEN CAST(ceil(shard_size * blocks / v + 1 + k + shard_size * k / v) AS BIGINT) ELSE 0 END AS high FROM srange
), sopen AS (SELECT *, blocks - sum(low) OVER (PARTITION BY source_no) AS open FROM slow
), srivals AS (SELECT *, unnest(range(low, high + 1)) AS s FROM sopen
), swon AS (
  SELECT *, row_number() OVER (PARTITION BY source_no ORDER BY shard_size / (2.0 * s + 1) DESC, shard, s) AS place FROM srivals
), squotas AS (
  SELECT source_no, shard, any_value(shard_size) AS shard_size, any_value(low) + count(*) FILTER (WHERE place <= open AND v > 0) AS quota
  FROM swon GROUP BY ALL
), runs AS (
  SELECT *, least(quota * 8, shard_size * 3) // greatest(shard_size, 1) AS passes, least(quota * 8, shard_size * 3) % greatest(shard_size, 1) AS run,
    CAST('0x' || substr(md5('11:block:' || source_no || ':' || shard), 1, 12) AS BIGINT) % CAST(ceil(greatest(shard_size, 1) / 8.0) AS BIGINT) * 8 AS first
  FROM squotas
), placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source_no, shard ORDER BY md5('11:' || name), doc_id, size
    ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS a FROM rws
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(passes * size
    + greatest(0, least(a + size, first + run, r.shard_size) - greatest(a, first))
    + greatest(0, least(a + size, first + run - r.shard_size) - a) AS BIGINT) AS taken
FROM placed p JOIN runs r USING (source_no, shard)""",
}
