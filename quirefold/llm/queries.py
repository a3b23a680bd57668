"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_postings, license_join, phrase_index, piece_agenda, risk_rules, rule_ensemble, sharding, token_sst, tool_links, warc_bundle
from .common import table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    keys = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    placed = sharding.shard_rows(keys, ["doc_id", "text_crc32", "size"], shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return phrase_index.contamination(docs, table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS l, array_to_string(w[o + 1 : o + least(13, len(w))], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(0, len(w) - least(13, len(w)) + 1)) AS o FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, o, l, array_to_string(w[o + 1 : o + l], ' ') AS win
  FROM (SELECT doc_id, w, l, unnest(range(0, len(w) - l + 1)) AS o FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
hits AS (SELECT dw.* FROM dw SEMI JOIN bw ON dw.win = bw.win AND dw.l = bw.l),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(o, o + l)) AS p FROM hits) GROUP BY doc_id),
found AS (
  SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256
  FROM (SELECT DISTINCT h.doc_id, CAST(bw.item_id AS VARCHAR) AS i FROM hits h JOIN bw ON h.win = bw.win AND h.l = bw.l) GROUP BY doc_id),
bp AS (SELECT item_id, len(w) AS n, unnest(range(0, len(w))) AS i, unnest(w) AS x FROM b),
dp AS (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS x FROM d),
aligned AS (SELECT DISTINCT doc_id, item_id, n, i, p - i + j AS c FROM dp JOIN bp USING (x), (VALUES (-1), (0), (1)) v(j)),
runs AS (
  SELECT doc_id, item_id, n, i, count(*) OVER (PARTITION BY doc_id, item_id, c) AS every,
         count(*) OVER (PARTITION BY doc_id, item_id, c ORDER BY i RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS n13,
         count(*) OVER (PARTITION BY doc_id, item_id, c ORDER BY i RANGE BETWEEN CURRENT ROW AND 11 FOLLOWING) AS n12
  FROM aligned),
near AS (SELECT doc_id, count(DISTINCT CAST(item_id AS VARCHAR)) AS n_near FROM runs
         WHERE CASE WHEN n < 13 THEN every = n ELSE (n13 >= 12 AND i <= n - 13) OR (n12 = 12 AND i BETWEEN 1 AND n - 12) END GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id) LEFT JOIN near USING (doc_id)
"""

def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = rule_ensemble.scored(docs, table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id",
        rule_ensemble.held_out(F.col("doc_id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )


def op4_token_sst(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = token_sst.write_shards(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_sst.read_digests(spark, manifest)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scanned(table(spark, sf_dir, "documents"))


#: Functions that calls in the conversations may use; a call of any other is reported as not valid.
TOOL_SCHEMAS = {
    "search": {"type": "object", "required": ["query"], "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}},
    "calculate": {"type": "object", "required": ["expression"], "properties": {"expression": {"type": "string"}}, "additionalProperties": False},
}


def op6_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_links.linked_messages(table(spark, sf_dir, "conversations"), TOOL_SCHEMAS)


def _calls(*calls: tuple) -> str:
    made = [{"id": i, "depends_on": needs, "function": {"name": name, "arguments": arguments}} for i, name, arguments, needs in calls]
    return json.dumps({"content": None, "tool_calls": made})


def _result(identifier: str) -> str:
    return json.dumps({"tool_call_id": identifier, "content": "done"})


def tool_conversations() -> list[tuple]:
    """(conv_id, turn, role, text): tool conversations, of which the given table has none."""
    ask = {"query": "mills"}
    return [
        (-1, 0, "user", "Find the mills."),
        (-1, 1, "tool", _result("a")),  # before its call
        (-1, 2, "assistant", _calls(("a", "search", ask, []), ("b", "search", {"limit": 0, "query": "x"}, []))),
        (-1, 3, "assistant", _calls(("c", "calculate", '{"expression": "1+1"}', ["b"]))),
        (-1, 4, "tool", _result("b")),
        (-1, 5, "tool", _result("none")),
        (-2, 0, "assistant", _calls(("call_0", "search", ask, []))),  # one identifier, two calls
        (-2, 1, "tool", _result("call_0")),
        (-2, 2, "assistant", _calls(("call_0", "unknown", {}, []))),
        (-2, 3, "tool", _result("call_0")),
        (-3, 0, "assistant", _calls(("p", "search", {"query": "$ref:q"}, []))),  # a cycle
        (-3, 1, "assistant", _calls(("q", "search", ask, ["p"]))),
        (-3, 2, "user", "Well?"),
    ]


def tool_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator on conversations with tool messages, whose result is known."""
    frame = spark.createDataFrame(tool_conversations(), "conv_id long, turn long, role string, text string")
    return tool_links.linked_messages(frame, TOOL_SCHEMAS).drop("message_json", "role")


TOOL_MESSAGES_SQL = """
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, CAST(position AS BIGINT) AS position, CAST(n_calls AS BIGINT) AS n_calls,
       CAST(n_linked AS BIGINT) AS n_linked, CAST(n_valid AS BIGINT) AS n_valid, call_id, linked, cyclic
FROM (VALUES
  (-1, 0, 0, 0, 0, 0, NULL, NULL, false), (-1, 2, 1, 2, 2, 1, NULL, NULL, false), (-1, 1, 2, 0, 0, 0, 'a', true, false),
  (-1, 4, 3, 0, 0, 0, 'b', true, false), (-1, 3, 4, 1, 0, 1, NULL, NULL, false), (-1, 5, 5, 0, 0, 0, 'none', false, false),
  (-2, 0, 0, 1, 1, 1, NULL, NULL, false), (-2, 1, 1, 0, 0, 0, 'call_0', true, false),
  (-2, 2, 2, 1, 1, 0, NULL, NULL, false), (-2, 3, 3, 0, 0, 0, 'call_0', true, false),
  (-3, 0, 0, 1, 0, 1, NULL, NULL, true), (-3, 1, 1, 1, 0, 1, NULL, NULL, true), (-3, 2, 2, 0, 0, 0, NULL, NULL, false)
) t(conv_id, turn, position, n_calls, n_linked, n_valid, call_id, linked, cyclic)
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_bundle.read_bundles(warc_bundle.write_bundles(table(spark, sf_dir, "pages")))


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
m AS (SELECT page_id, html, n, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM m
"""


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_agenda.encoded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = risk_rules.judged(docs, table(spark, sf_dir, "labels"), ["doc_id"])
    return found.select("doc_id", *[F.col("_m")[k].alias(k) for k in risk_rules.MEASURES], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = byte_postings.near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_token_sst": op4_token_sst,
    "op5_license_scan": op5_license_scan,
    "op6_tool_links": op6_tool_links,
    "tool_messages": tool_messages,
    "op7_warc": op7_warc,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_simhash": op10_simhash,
}
ORACLES = {
    "op2_decontamination": OP2_SQL,
    "op5_license_scan": license_join.oracle_sql(),
    "tool_messages": TOOL_MESSAGES_SQL,
    "op7_warc": OP7_SQL,
}
