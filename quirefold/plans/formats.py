"""Queries on notes, bilingual files, replies, contents pages and small notations, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.ext import providers
from quirefold.functions import names
from quirefold.operators import markup, structure
from quirefold.sources import fixtures
from quirefold.sources.fixtures import cte
from quirefold.sources.tables import read


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = fixtures.frame(spark, "vault_notes").withColumn("fm", markup.front_matter(F.col("text")))
    kept = markup.with_values(F.col("fm.lines"), {"published": F.lit("2021-03"), "publisher": F.lit("")})
    return notes.select(
        "note_id",
        F.coalesce(markup.value_of(F.col("fm.lines"), "source"), F.lit("")).alias("source"),
        F.sha2("fm.body", 256).alias("body_sha256"),
        F.array_join(kept, "|").alias("lines"),
    )


def bilingual_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.bilingual_blocks(fixtures.frame(spark, "bilingual_files"), "path", "text")


def _blocks(spark):
    files = fixtures.frame(spark, "bilingual_files")
    return markup.bilingual_blocks(files, "path", "text").join(files.select("path", "stem", "rank"), "path")


def bilingual_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.best_alternate(_blocks(spark), "stem", "path")


def bilingual_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.first_writer_cache(_blocks(spark), "rank")


def merged_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A book is sixteen documents in a row of one source: a text has to fit a row, and a source need not."""
    docs = read(spark, sf_dir, "documents", ["source", "doc_id", "text"]).withColumn("book", F.concat_ws(":", "source", F.floor(F.col("doc_id") / 320)))
    merged = markup.merged_text(docs.withColumnsRenamed({"doc_id": "n", "text": "body"}), "book")
    return merged.select("book", F.sha2("text", 256).alias("text_sha256"))


def page_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = fixtures.frame(spark, "page_replies").withColumn("wanted", F.sequence("first", "last"))
    return markup.reply_pages(replies, "call_id", "reply", "wanted")


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = markup.markdown_blocks(read(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")
    return made.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("n_chars"))


def chapter_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.navigation(fixtures.frame(spark, "chapters"), "book")


def epub_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.epub_packages(fixtures.frame(spark, "chapters")).select("book", F.octet_length("content").alias("n_bytes"))


def recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.recent_errors(fixtures.frame(spark, "log_lines"), "pos", "line", 3)


def notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return fixtures.frame(spark, "small_strings").select(
        "sid",
        names.plain_superscripts(t).alias("plain"),
        F.array_join(names.page_range(t), ",").alias("pages"),
        F.array_join(names.source_candidates(t), " ").alias("candidates"),
        names.pdf_date(t).alias("pdf_date"),
        names.first_json(t).alias("json"),
        names.escaped(t).alias("escaped"),
        names.author_from_stem(t).alias("author"),
        names.citation_key(t).alias("citation_key"),
        names.error_class(F.lit(None).cast("int"), t).alias("error"),
        names.file_name(t).alias("file_name"),
        names.override_key(t).alias("override_key"),
    )


def nfc_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.sha2(names.nfc("text"), 256).alias("nfc_sha256"))


def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.contents_pages(fixtures.frame(spark, "contents"), "book")


def scan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.scan_pages(fixtures.frame(spark, "contents"), "book")


def located_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document is a book, and its own short lines are the titles that are looked for in it."""
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    lines = docs.select(F.col("doc_id").cast("string").alias("book"), "text", F.filter(F.split("text", "\n"), lambda s: F.length(F.trim(s)).between(2, 80)).alias("titles"))
    return structure.located_titles(lines)


def known_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.known_boundaries(fixtures.frame(spark, "chapter_lines"))


def repeated_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.repeated_titles(fixtures.frame(spark, "header_lines"), fixtures.frame(spark, "header_titles"))


def skip_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "documents", ["source", "doc_id", "text"])
    made = structure.skip_sections(turns, "source", "doc_id", "text")
    return made.groupBy("source").agg(F.count("*").alias("n"), F.count_if("skipped").alias("n_skipped"))


def adopted_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.adopted_references(fixtures.frame(spark, "marked_bodies"), fixtures.frame(spark, "note_definitions"))


def stub_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The provider interface with its stand-in, over distinct conversation texts."""
    units = read(spark, sf_dir, "conversations", ["text"]).distinct().select(F.sha2("text", 256).alias("key"), F.col("text").alias("src"))
    made = providers.completed(units)
    return made.select("key", F.sha2("tgt", 256).alias("tgt_sha256"), "status")


_SP = r"[ \t\n\x0B\f\r]"
_STRIP = rf"regexp_replace({{}}, '^{_SP}+|{_SP}+$', '', 'g')".format
_BILINGUAL = f"""{cte('bilingual_files')},
raw AS (SELECT path, stem, rank, unnest(range(len(x))) AS pos, unnest(x) AS r FROM (SELECT *, string_split(text, chr(10) || chr(10) || '---' || chr(10) || chr(10)) AS x FROM bilingual_files)),
bl AS (SELECT *, {_STRIP('r')} AS b FROM raw),
kinds AS (SELECT *, strpos(b, chr(10) || chr(10) || '[KO]' || chr(10)) AS ko, strpos(b, chr(10) || chr(10)) AS para FROM bl WHERE b <> ''),
blocks AS (SELECT path, stem, rank, CAST(pos AS INT) AS pos,
  CASE WHEN ko > 0 THEN {_STRIP("regexp_replace(left(b, ko - 1), '^\\[EN\\]\\n', '')")} WHEN b NOT LIKE '[%' AND para > 0 THEN {_STRIP('left(b, para - 1)')} WHEN b LIKE '[EN]' || chr(10) || '%' THEN {_STRIP('substring(b, 6)')} END AS src,
  CASE WHEN ko > 0 THEN {_STRIP('substring(b, ko + 7)')} WHEN b NOT LIKE '[%' AND para > 0 THEN {_STRIP('substring(b, para + 2)')} ELSE '' END AS tgt FROM kinds)"""

QUERIES = {
    "front_matter": front_matter,
    "bilingual_blocks": bilingual_blocks,
    "bilingual_best": bilingual_best,
    "bilingual_cache": bilingual_cache,
    "merged_books": merged_books,
    "page_replies": page_replies,
    "markdown_blocks": markdown_blocks,
    "chapter_navigation": chapter_navigation,
    "epub_export": epub_export,
    "recent_errors": recent_errors,
    "notations": notations,
    "nfc_documents": nfc_documents,
    "contents_pages": contents_pages,
    "scan_pages": scan_pages,
    "located_titles": located_titles,
    "known_boundaries": known_boundaries,
    "repeated_titles": repeated_titles,
    "skip_sections": skip_sections,
    "adopted_references": adopted_references,
    "stub_translation": stub_translation,
}
ORACLES = {
    "bilingual_blocks": f"WITH {_BILINGUAL} SELECT path, pos, src, tgt FROM blocks WHERE src IS NOT NULL",
    "bilingual_best": f"WITH {_BILINGUAL}, c AS (SELECT stem, path, count(*) AS n FROM blocks WHERE src IS NOT NULL AND tgt <> '' GROUP BY ALL) SELECT stem, arg_max(path, (n, path)) AS path, max(n) AS n FROM c GROUP BY stem",
    "bilingual_cache": f"WITH {_BILINGUAL} SELECT src, arg_min(tgt, rank) AS tgt FROM blocks WHERE src IS NOT NULL AND tgt <> '' GROUP BY src",
    "merged_books": """SELECT source || ':' || doc_id // 320 AS book, sha256(string_agg(text, chr(10) || chr(10) ORDER BY doc_id)) AS text_sha256
FROM documents GROUP BY source, doc_id // 320""",
    "chapter_navigation": f"WITH {cte('chapters')} SELECT book, n, title, lag(title) OVER w AS previous, lead(title) OVER w AS next FROM chapters WINDOW w AS (PARTITION BY book ORDER BY n)",
    "recent_errors": f"""WITH {cte('log_lines')} SELECT pos, line FROM log_lines WHERE regexp_matches(line, '(?i)error|exception|traceback|failed|오류|실패')
 AND NOT regexp_matches(line, '(?i)retry|0 errors|no error') ORDER BY pos DESC LIMIT 3""",
    "nfc_documents": "SELECT doc_id, sha256(nfc_normalize(text)) AS nfc_sha256 FROM documents",
    "markdown_blocks": f"""WITH l AS (SELECT doc_id, {_STRIP('line')} AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)),
k AS (SELECT doc_id, s, CASE WHEN s = '' THEN 'blank' WHEN regexp_matches(s, '^#{{1,6}} ') THEN 'heading' WHEN regexp_matches(s, '^\\|?[ :|-]*-{{3,}}[ :|-]*$') AND contains(s, '|') THEN 'rule' WHEN s LIKE '|%' THEN 'table'
 WHEN s LIKE '>%' THEN 'quote' WHEN regexp_matches(s, '^([-*+]|[0-9]+\\.) ') THEN 'bullet' WHEN regexp_matches(s, '^(#[^\\s#]+\\s*)+$') THEN 'tags' ELSE 'text' END AS kind FROM l)
SELECT doc_id, kind, count(*) AS n, CAST(sum(length(CASE WHEN kind = 'heading' THEN {_STRIP("regexp_replace(s, '^#{1,6} ', '')")} WHEN kind IN ('quote', 'bullet') THEN {_STRIP("regexp_replace(s, '^(>|[-*+]|[0-9]+\\.)\\s*', '')")} ELSE s END)) AS BIGINT) AS n_chars
FROM k WHERE kind NOT IN ('blank', 'rule') GROUP BY doc_id, kind""",
    "repeated_titles": f"""WITH {cte('header_lines')}, {cte('header_titles')}, f AS (SELECT book, lower(regexp_replace(line, '[^\\p{{L}}]+', '', 'g')) AS key, array_to_string(regexp_extract_all(line, '[0-9]+'), ',') AS numbers FROM header_lines
  WHERE length(trim(line)) BETWEEN 4 AND 85 AND regexp_matches(trim(line), '^[0-9]') AND NOT regexp_matches(line, '(?i)https?://|doi|ibid|(^|[^a-z])pp?\\.|[.!?]$')),
t AS (SELECT DISTINCT book, lower(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS key FROM (SELECT book, unnest(string_split(title, '_')) AS t FROM header_titles))
SELECT book, key, count(*) AS n FROM f JOIN t USING (book, key) WHERE length(key) >= 4 GROUP BY book, key HAVING count(*) >= 3 AND count(DISTINCT numbers) >= 3""",
    "adopted_references": f"""WITH {cte('marked_bodies')}, {cte('note_definitions')}, m AS (SELECT book, unnest(regexp_extract_all(body, '\\[\\^([0-9]+)\\]', 1)) AS id FROM marked_bodies),
w AS (SELECT DISTINCT book, id FROM note_definitions d WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.book = d.book AND m.id = d.id)),
b AS (SELECT book, chapter, unnest(range(len(x))) AS nth, unnest(x) AS id FROM (SELECT *, regexp_extract_all(body || ' ', '[.,;:!?”’"'')\\]]([0-9]{{1,3}})[^0-9]', 1) AS x FROM marked_bodies))
SELECT book, id, arg_min(chapter, (chapter, nth)) AS chapter, CAST(arg_min(nth, (chapter, nth)) AS INT) AS "at" FROM b JOIN w USING (book, id) GROUP BY book, id""",
    "known_boundaries": f"""WITH {cte('chapter_lines')}, a AS (SELECT *, coalesce(trim(lag(line) OVER w) = '', true) AND coalesce(trim(lead(line) OVER w) = '', true) AND row_number() OVER w > 1 AS alone FROM chapter_lines WINDOW w AS (PARTITION BY book, chapter ORDER BY pos)),
h AS (SELECT book, chapter, pos, lower(line) AS word FROM a WHERE alone AND lower(line) IN ('introduction', 'conclusion', 'abstract', 'references')),
f AS (SELECT book, word, arg_min(chapter, (chapter, pos)) AS chapter, arg_min(pos, (chapter, pos)) AS pos, count(*) AS n FROM h GROUP BY book, word)
SELECT book, chapter, pos, word FROM f WHERE book NOT IN (SELECT book FROM f WHERE n >= 3)""",
    "skip_sections": """WITH p AS (SELECT source, doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY source) AS n FROM documents),
l AS (SELECT *, max(CASE WHEN length(s) >= 400 AND NOT regexp_matches(s, '(?i)https?://|arxiv|doi\\.org') AND NOT regexp_matches(s, '^\\[?[0-9]+\\*?\\]?[\\s.,):]') AND NOT regexp_matches(s, '^†\\s') AND k > floor(n * 0.6) THEN k END) OVER (PARTITION BY source) AS last FROM p)
SELECT source, count(*) AS n, CAST(count_if(n >= 50 AND last < n - 5 AND k > last) AS BIGINT) AS n_skipped FROM l GROUP BY source""",
    "stub_translation": "SELECT DISTINCT sha256(text) AS key, sha256('«' || text || '»') AS tgt_sha256, 'translated' AS status FROM conversations",
}
