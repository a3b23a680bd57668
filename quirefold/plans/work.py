"""Queries on the work queue, caches and corpus bookkeeping, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import redact
from quirefold.functions.text import compact
from quirefold.operators import queue, quotes
from quirefold.sources.tables import read
from quirefold.streaming import stages


def queue_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.queue_items(stages.as_queue_events(read(spark, sf_dir, "events")))


def item_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.last_state(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")


def fail_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", ["user_id", "ts", "event_id", "event_type"])
    return queue.fail_streaks(events, "user_id", ["ts", "event_id"], F.col("event_type") == "error", least=3)


def cooldown_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", ["event_id", "user_id", "ts", "event_type"])
    return queue.cool_down(events, "user_id", "ts", F.col("event_type") == "error").select("event_id", "blocked")


def stale_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", ["user_id", "ts"])
    now = events.agg(F.max("ts").alias("now")).first()["now"]  # one value
    return queue.stale(events, "user_id", "ts", F.lit(now), 86_400)


def stage_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run_state_stream(spark, f"{sf_dir}/events.parquet")


def content_cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    labels = read(spark, sf_dir, "labels")
    units = docs.select("doc_id", queue.content_key(F.col("text"), "v1", "ko").alias("key"), F.sha2("text", 256).alias("src"))
    marked = units.join(labels, "doc_id")
    known = lambda df, key, tgt: df.groupBy(key).agg(F.lit(tgt).alias("tgt"))
    overrides = known(marked.where("toxic = 1"), "key", "by hand")
    cache = known(marked.where("quality = 1"), "key", "translated")
    legacy = known(units.join(docs.where("lang = 'fr'").select("doc_id"), "doc_id", "left_semi"), "src", "old")
    out = queue.reuse(units.select("key", "src"), overrides, cache, legacy)
    return out.groupBy("key", "tgt", "origin").agg(F.count("*").alias("n"))


def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", F.sha2(compact(F.col("text")), 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def annotation_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "source", "n_chars"])
    labels = read(spark, sf_dir, "labels", ["doc_id"]).distinct()
    done = docs.join(labels, "doc_id", "left_semi").withColumn("state", F.lit("done"))
    return done.unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("state", F.lit("pending"))).groupBy("source", "state").agg(
        F.count("*").alias("n"), F.min("n_chars").alias("smallest")
    )


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.sha2(redact.redacted(F.col("text")), 256).alias("redacted_sha256"), redact.found(F.col("text")).alias("n_found"))


def quote_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = read(spark, sf_dir, "benchmark", ["item_id", "text"])
    return quotes.verified(quoted, read(spark, sf_dir, "documents", ["doc_id", "text"]))


def quote_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.budgeted(read(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]), "conv_id", "turn", "text", target=3)


def length_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.length_params(read(spark, sf_dir, "documents", ["doc_id", "n_chars"]), "n_chars", 20)


_QUEUE_EVENTS = """qe AS (SELECT ts, event_id, 'stage' || (CAST(json_extract(props, '$.k') AS INT) % 4) AS stage, user_id AS item,
  CASE WHEN event_type = 'error' THEN 'remove' WHEN event_type = 'signup' AND value > 99 THEN 'clear' ELSE 'add' END AS op FROM events)"""
_UNITS = "u AS (SELECT doc_id, lang, sha256('v1' || chr(31) || 'ko' || chr(31) || text) AS key, sha256(text) AS src FROM documents)"

QUERIES = {
    "quote_verification": quote_verification,
    "queue_state": queue_state,
    "item_stage": item_stage,
    "fail_streaks": fail_streaks,
    "cooldown_flags": cooldown_flags,
    "stale_jobs": stale_jobs,
    "stage_stream": stage_stream,
    "content_cache_reuse": content_cache_reuse,
    "duplicate_groups": duplicate_groups,
    "annotation_gaps": annotation_gaps,
    "redact_documents": redact_documents,
    "quote_budget": quote_budget,
    "length_params": length_params,
}
_LAST = "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, count(*) AS n_events FROM events GROUP BY user_id"
_SPACES = r"'[ \t\n\x0B\f\r]+'"
ORACLES = {
    "quote_verification": f"""WITH q AS MATERIALIZED (SELECT item_id, regexp_replace(text, {_SPACES}, '', 'g') AS k FROM benchmark),
d AS MATERIALIZED (SELECT doc_id, regexp_replace(text, {_SPACES}, '', 'g') AS s FROM documents)
SELECT item_id, doc_id, CAST(strpos(s, k) - 1 AS INT) AS position, CAST(length(k) AS INT) AS n_chars FROM q JOIN d ON contains(s, k) WHERE length(k) >= 10""",
    "queue_state": f"""WITH {_QUEUE_EVENTS}
SELECT stage, item, min(ts) AS queued_at FROM qe a WHERE op = 'add'
  AND NOT EXISTS (SELECT 1 FROM qe b WHERE b.op = 'remove' AND b.stage = a.stage AND b.item = a.item AND (b.ts, b.event_id) >= (a.ts, a.event_id))
  AND NOT EXISTS (SELECT 1 FROM qe c WHERE c.op = 'clear' AND c.stage = a.stage AND (c.ts, c.event_id) >= (a.ts, a.event_id)) GROUP BY stage, item""",
    "item_stage": _LAST,
    "stage_stream": _LAST,
    "fail_streaks": """WITH e AS (SELECT user_id, ts, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)
  - row_number() OVER (PARTITION BY user_id, event_type = 'error' ORDER BY ts, event_id) AS island FROM events)
SELECT user_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS n_failed FROM e WHERE bad GROUP BY user_id, island HAVING count(*) >= 3""",
    "cooldown_flags": """SELECT event_id, EXISTS (SELECT 1 FROM events o WHERE o.user_id = e.user_id AND o.event_type = 'error' AND o.ts < e.ts AND o.ts > e.ts - INTERVAL 3600 SECOND) AS blocked FROM events e""",
    "stale_jobs": "SELECT user_id, max(ts) AS last_beat, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 86400 SECOND AS stale FROM events GROUP BY user_id",
    "content_cache_reuse": f"""WITH {_UNITS}, l AS (SELECT u.*, quality, toxic FROM u JOIN labels USING (doc_id)),
o AS (SELECT DISTINCT key FROM l WHERE toxic = 1), c AS (SELECT DISTINCT key FROM l WHERE quality = 1), g AS (SELECT DISTINCT src FROM u WHERE lang = 'fr'),
r AS (SELECT key, CASE WHEN key IN (SELECT key FROM o) THEN 'override' WHEN key IN (SELECT key FROM c) THEN 'cache' WHEN src IN (SELECT src FROM g) THEN 'legacy' ELSE 'miss' END AS origin FROM u)
SELECT key, CASE origin WHEN 'override' THEN 'by hand' WHEN 'cache' THEN 'translated' WHEN 'legacy' THEN 'old' END AS tgt, origin, count(*) AS n FROM r GROUP BY ALL""",
    "duplicate_groups": f"SELECT sha256(regexp_replace(text, {_SPACES}, '', 'g')) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1",
    "annotation_gaps": """SELECT source, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'done' ELSE 'pending' END AS state, count(*) AS n, min(n_chars) AS smallest
FROM documents GROUP BY ALL""",
    "redact_documents": f"SELECT doc_id, sha256({redact.sql('text')}) AS redacted_sha256, {redact.found_sql('text')} AS n_found FROM documents",
    "quote_budget": """WITH RECURSIVE t AS (SELECT conv_id, turn, text, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k,
  sum(length(text)) OVER (PARTITION BY conv_id) AS total FROM conversations),
f AS (SELECT conv_id, 0 AS k, 0 AS used, 0 AS kept, false AS take FROM t WHERE k = 1 UNION ALL
  SELECT f.conv_id, t.k, f.used + CASE WHEN ok THEN t.n ELSE 0 END, f.kept + CASE WHEN ok THEN 1 ELSE 0 END, ok FROM f JOIN (SELECT * FROM t) t ON t.conv_id = f.conv_id AND t.k = f.k + 1,
  LATERAL (SELECT f.kept < 3 AND t.n <= 200 AND f.used + t.n <= greatest(400, CAST(floor(t.total * 0.02) AS BIGINT)) AS ok))
SELECT conv_id, turn, n AS n_chars FROM f JOIN t USING (conv_id, k) WHERE take""",
    "length_params": """WITH a AS (SELECT doc_id, greatest(3000, CAST(floor(n_chars * 20 / 100.0) AS BIGINT)) AS target FROM documents),
b AS (SELECT *, CAST(greatest(3, least(24, round_even(target / 700.0, 0))) AS BIGINT) AS n_sub FROM a)
SELECT doc_id, target, n_sub, greatest(1, target // n_sub) AS per_sub, CAST(greatest(3, least(14, round_even(n_sub * 0.7, 0))) AS BIGINT) AS n_cite,
  CAST(least(64000, greatest(6000, floor(target * 2.6))) AS BIGINT) AS max_out FROM b""",
}
