"""The registered queries of the ten operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow.llm import bpe, chat, langid, mixing, neardup, pii, quality, rules, topk, toxicity
from gaugeflow.llm.common import fold


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every text."""
    found = pii.annotate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one numbered -1 whose texts hold control strings."""
    own = spark.sql("SELECT -1L AS conv_id, t AS turn, r AS role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS x(t, r)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.format_conversations(turns))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every text; learned where the fold is not 2."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(langid.training_sample(docs, fold("doc_id", 4) != 2))
    found = langid.predict(docs, model)
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best of each hundredth vector."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0, k=10, scale=1024)


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's slot and place in the mix."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text; labels are learned where the fold is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.trained(docs, table(spark, sf_dir, "labels"), "toxic", fold("doc_id", 5) != 0)
    found = toxicity.score(docs, net)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every text; labels are learned where the fold is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(*quality.training_sample(docs, table(spark, sf_dir, "labels"), "quality", fold("doc_id", 5) != 0))
    found = quality.score(docs, model)
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of every document, and whether it is the one kept."""
    found = neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return rules.score(docs, rules.learn(docs))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), digests_only=True)


QUERIES = {f.__name__: f for f in (op1_pii, op2_chat_format, op3_language_id, op4_top_k, op5_mix_sources, op6_toxicity, op7_quality, op8_near_dup, op9_quality_rules, op10_bpe)}

ORACLES = {
    "op2_chat_format": r"""
WITH all_turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         replace(replace(replace(text, '\', '\0'), '<', '\1'), '[', '\2') AS etext,
         replace(replace(replace(replace(role, '\', '\0'), '<', '\1'), '[', '\2'), chr(10), '\n') AS erole
  FROM all_turns
), p AS (
  SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY i), '') AS before, i = count(*) OVER (PARTITION BY conv_id) AS ends FROM t
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|start|>' || erole || chr(10)) + length(etext) + length('<|end|>' || chr(10)))::BIGINT AS formatted_chars,
       bool_and((before || '>' || role) IN ('>system', '>user', 'system>user', 'user>assistant', 'assistant>user') AND (NOT ends OR role IN ('user', 'assistant'))) AS valid
FROM p GROUP BY conv_id""",
    "op4_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e, len(embedding) AS d
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND c.d = q.d WHERE q.vec_id % 100 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op5_mix_sources": """
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), o AS (
  SELECT source, sqrt(n::DOUBLE) AS r, row_number() OVER (ORDER BY source NULLS LAST) AS i, count(*) OVER () AS k, sum(sqrt(n::DOUBLE)) OVER () AS total FROM c
), e AS (
  SELECT *, greatest(1000, k) AS shares, (greatest(1000, k) - k) * r / total AS exact FROM o
), b AS (
  SELECT *, 1 + floor(exact)::BIGINT AS base, row_number() OVER (ORDER BY floor(exact) - exact, i) AS turn FROM e
), w0 AS (
  SELECT source, i, base + CASE WHEN turn <= shares - sum(base) OVER () THEN 1 ELSE 0 END AS w FROM b
), g AS (
  SELECT list_reduce(list(w ORDER BY i), lambda x, y: gcd(x, y)) AS d FROM w0
), w AS (
  SELECT source, i, w // d AS w FROM w0, g
), p AS (
  SELECT list(w ORDER BY i) AS ws, sum(w)::BIGINT AS total FROM w
), sim AS (
  -- a slot goes to the released block of the earliest deadline
  SELECT 0::BIGINT AS slot, list_transform(ws, lambda x: 0::BIGINT) AS done, NULL::BIGINT AS i, NULL::BIGINT AS j FROM p
  UNION ALL
  SELECT slot + 1, list_transform(done, lambda x, q: x + CASE WHEN q = best.i THEN 1 ELSE 0 END), best.i, done[best.i]
  FROM (
    SELECT slot, done, total, list_min(list_filter(list_transform(ws, lambda x, q: CASE WHEN done[q] < x AND done[q] * total // x <= slot
      THEN {'due': ((done[q] + 1) * total + x - 1) // x, 'i': q::BIGINT} END), lambda z: z IS NOT NULL)) AS best
    FROM sim, p WHERE slot < total
  )
), places AS (
  SELECT i, j, slot - 1 AS place FROM sim WHERE i IS NOT NULL
), d AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT, doc_id) - 1 AS r FROM documents
)
SELECT doc_id, d.source, (r // 16) // w.w * total + places.place AS mix_slot, r % 16 AS mix_place
FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source JOIN places ON places.i = w.i AND places.j = (r // 16) % w.w, p""",
}
