"""Queries on look-ups, counters, page maps and layout statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators import bookkeeping as b
from quirefold.sources import fixtures
from quirefold.sources.fixtures import cte
from quirefold.sources.tables import read


def first_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest document of each source and language: a priority look-up."""
    return b.first_of(read(spark, sf_dir, "documents", ["source", "lang", "n_chars", "doc_id"]), ["source", "lang"], "n_chars", "doc_id")


def visible_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a conversation stand for translations of its questions: the language is the role."""
    turns = read(spark, sf_dir, "conversations", ["conv_id", "turn", "role"])
    chapters = turns.select(F.col("conv_id").alias("stem"), F.lit(0).alias("n")).distinct()
    status = F.when(F.col("turn") > 5, "partial").otherwise("complete")
    artifacts = turns.select(F.col("conv_id").alias("stem"), F.lit(0).alias("n"), F.col("role").alias("lang"), F.col("turn").alias("payload"), status.alias("status"))
    first = artifacts.groupBy("stem", "n", "lang", "status").agg(F.min("payload").alias("payload"))
    return b.visible_translation(chapters, first.where("status = 'complete'").unionByName(first.where("status = 'partial'")), "system")


def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.status_counts(read(spark, sf_dir, "events", ["user_id", "event_type"]), "user_id", "event_type", ["error", "purchase"])


def thinned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["source", "doc_id", "n_chars"]).withColumn("strong", F.col("n_chars") > 8000)
    return b.thinned(docs, "source", "doc_id", "strong", 20).select("source", "doc_id")


def keyword_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.sources.tables import lines

    return b.keyword_lines(lines(read(spark, sf_dir, "documents", ["doc_id", "text"]), ["doc_id"]), "line", "public License").select("doc_id", "line_no")


def fallback_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", ["user_id", "event_id", "event_type"])
    return b.fallback_segments(events, "user_id", "event_id", "event_type", "view")


def front_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.sha2(F.array_join(b.front_lines(F.replace("text", F.lit("\n"), F.lit("\n\n"))), "|"), 256).alias("front_sha256"))


def chapter_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is a book whose pages are its documents; its chapters are the same texts, cut at every second page."""
    docs = read(spark, sf_dir, "documents", ["source", "doc_id", "lang", "text"])
    chapters = docs.select("source", F.col("doc_id").alias("n"), F.col("text").alias("body"))
    return b.chapter_pages(chapters, docs.select("source", F.col("doc_id").alias("page"), "text"), "source")


def small_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.select("doc_id", b.small_document(F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("small"), b.leftover_words(F.col("text")).cast("long").alias("latin_words"))


def spread_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.spread(read(spark, sf_dir, "documents", ["source", "doc_id"]), "source", "doc_id", 6).select("source", F.array_join("rows", ",").alias("doc_ids"))


def note_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.note_area(fixtures.frame(spark, "text_rows"), 800.0)


def top_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.top_bookmarks(fixtures.frame(spark, "bookmarks"))


def term_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.term_pairs(fixtures.frame(spark, "translated"), "n", "text")


def catalogue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = fixtures.frame(spark, "catalogue_replies")
    work = replies.where("kind = 'work'").select("rid", b.work_record(F.col("reply")).alias("r")).select("rid", "r.title", "r.author", "r.published_date")
    feed = replies.where("kind = 'feed'").select("rid", b.feed_record(F.col("reply")).alias("r")).select("rid", "r.title", "r.author", "r.published_date")
    return work.unionByName(feed)


QUERIES = {
    "first_document": first_document,
    "visible_translation": visible_translation,
    "event_counts": event_counts,
    "thinned_lines": thinned_lines,
    "keyword_lines": keyword_lines,
    "fallback_segments": fallback_segments,
    "front_lines": front_lines,
    "chapter_pages": chapter_pages,
    "small_documents": small_documents,
    "spread_documents": spread_documents,
    "note_area": note_area,
    "top_bookmarks": top_bookmarks,
    "term_pairs": term_pairs,
    "catalogue_records": catalogue_records,
}
_BARE = r"regexp_replace({}, '[ \t\n\x0B\f\r]+', '', 'g')".format
ORACLES = {
    "first_document": "SELECT source, lang, arg_min(doc_id, (n_chars, doc_id)) AS doc_id FROM documents GROUP BY source, lang",
    "visible_translation": """WITH a AS (SELECT conv_id, role, min(turn) AS payload FROM conversations WHERE turn <= 5 GROUP BY conv_id, role),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY CASE role WHEN 'system' THEN 0 WHEN 'ko' THEN 1 ELSE 2 END, role) AS k FROM a)
SELECT c.conv_id AS stem, 0 AS n, r.role AS lang, r.payload FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r ON r.conv_id = c.conv_id AND k = 1""",
    "event_counts": "SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY user_id",
    "thinned_lines": """WITH d AS (SELECT source, doc_id, n_chars > 8000 AS strong, row_number() OVER (PARTITION BY source, n_chars > 8000 ORDER BY doc_id) - 1 AS place FROM documents),
c AS (SELECT source, count(*) FILTER (strong) AS s, count(*) FILTER (NOT strong) AS k FROM d GROUP BY source),
g AS (SELECT source, s, k, greatest(20 - s, 0) AS room FROM c), j AS (SELECT * FROM d JOIN g USING (source))
SELECT source, doc_id FROM j WHERE strong OR k <= room OR place IN (SELECT CAST(floor(i * (k / room)) AS BIGINT) FROM range(20) t(i) WHERE i < room)""",
    "keyword_lines": f"""WITH l AS (SELECT doc_id, unnest(range(len(x))) AS line_no, unnest(x) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents))
SELECT doc_id, CAST(line_no AS INT) AS line_no FROM l WHERE contains(lower({_BARE('line')}), 'publiclicense')""",
    "fallback_segments": """WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events)
SELECT user_id, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM e WHERE event_type <> 'view' GROUP BY user_id, event_type, g""",
    "front_lines": r"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda s: array_to_string(list_filter(regexp_split_to_array(s, '[ \t\n\x0B\f\r]+'), lambda w: w <> ''), ' ')), lambda s: s <> '') AS p FROM documents),
q AS (SELECT doc_id, p, list_position(list_transform(p, lambda s: length(s) > 200 OR regexp_matches(s, '^(초록|요약|Abstract|ABSTRACT)([^A-Za-z0-9가-힣]|$)')), true) AS f FROM p)
SELECT doc_id, sha256(array_to_string(p[1 : least(5, CASE WHEN coalesce(f, 0) > 0 THEN f - 1 ELSE len(p) END)], '|')) AS front_sha256 FROM q""",
    "chapter_pages": f"SELECT source, doc_id AS n, doc_id AS first_page, doc_id AS last_page FROM documents WHERE length({_BARE('text')}) > 0",
    "small_documents": f"""SELECT doc_id, length(replace(text, chr(10), chr(10) || chr(10))) <= 120000 AND len(list_filter(string_split(text, chr(10)), lambda s: {_BARE('s')} <> '')) <= 14 AS small,
  len(regexp_extract_all(regexp_replace(text, '\\([^()]*\\)', '', 'g'), '[A-Za-zÀ-ž]{{2,}}')) AS latin_words FROM documents""",
    "spread_documents": """WITH l AS (SELECT source, list(doc_id ORDER BY doc_id) AS a FROM documents GROUP BY source)
SELECT source, array_to_string(CASE WHEN len(a) > 6 THEN list_transform(range(6), lambda i: a[CAST(floor(i * len(a) / 6) AS BIGINT) + 1]) ELSE a END, ',') AS doc_ids FROM l""",
    "note_area": f"""WITH {cte('text_rows')}, g AS (SELECT page, y, lead(y) OVER w - y AS gap, lead(y) OVER w AS upper FROM text_rows WINDOW w AS (PARTITION BY page ORDER BY y)),
m AS (SELECT page, median(gap) AS med FROM g WHERE gap IS NOT NULL GROUP BY page HAVING count(*) >= 5),
n AS (SELECT g.*, gap < med * 0.8 AS near, row_number() OVER (PARTITION BY page ORDER BY y) - row_number() OVER (PARTITION BY page, gap < med * 0.8 ORDER BY y) AS i FROM g JOIN m USING (page) WHERE gap IS NOT NULL),
b AS (SELECT page, i, count(*) AS n, max(upper) AS top, min(y) AS bottom FROM n WHERE near GROUP BY page, i HAVING count(*) >= 2 AND max(upper) <= 440)
SELECT page, arg_min(top, bottom) AS note_top, arg_min(n + 1, bottom) AS note_lines FROM b GROUP BY page""",
    "top_bookmarks": f"WITH {cte('bookmarks')}, t AS (SELECT *, min(level) OVER (PARTITION BY stem) AS top FROM bookmarks), k AS (SELECT stem, title, page, count(*) OVER (PARTITION BY stem) AS n FROM t WHERE level = top) SELECT stem, title, page FROM k WHERE n >= 3",
    "term_pairs": f"""WITH {cte('translated')}, p AS (SELECT n, unnest(range(len(x))) AS place, unnest(x) AS p FROM (SELECT n, regexp_extract_all(text, '[가-힣]+(?: [가-힣]+)?\\([A-Za-z][A-Za-z .''’-]*\\)') AS x FROM translated)),
s AS (SELECT n, place, regexp_extract(p, '^([^(]+)\\(', 1) AS term, regexp_replace(regexp_extract(p, '\\(([^)]+)\\)', 1), '^[ .''’-]+|[ .''’-]+$', '', 'g') AS source FROM p)
SELECT source, arg_min(term, (n, place)) AS term FROM s WHERE length(source) >= 2 GROUP BY source""",
}
