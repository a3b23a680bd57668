"""Queries on workspace files, checks around models, and headings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import headings
from quirefold.operators import gates, quality, readings, workspace
from quirefold.sources import fixtures
from quirefold.sources.fixtures import cte
from quirefold.sources.tables import read


def chapter_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.chapter_files(fixtures.frame(spark, "workspace_files"))


def summary_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.summary_files(fixtures.frame(spark, "workspace_files"))


def processed_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = read(spark, sf_dir, "nation", ["n_name"]).select(F.concat(F.lit("log "), F.lower("n_name")).alias("stem"))
    return workspace.processed_stems(fixtures.frame(spark, "workspace_files"), log)


def note_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.note_candidates(fixtures.frame(spark, "workspace_files"))


def pending_smallest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without a label, the smallest first."""
    files = read(spark, sf_dir, "documents", ["doc_id", "text"]).select(F.concat("doc_id", F.lit(".txt")).alias("name"), F.length("text").alias("size"))
    done = read(spark, sf_dir, "labels", ["doc_id"]).select(F.col("doc_id").cast("string").alias("stem"))
    return workspace.pending(files, done)


def quality_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.quality_scan(quality.assessed(fixtures.frame(spark, "ko_quality"), "text"), "doc_id")


def chapter_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.chapter_writes(fixtures.frame(spark, "split_chapters").drop("source"), fixtures.frame(spark, "written_files"))


def coverage_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = fixtures.frame(spark, "split_chapters")
    return workspace.coverage_warnings(chapters, chapters.select("book", F.col("source").alias("text")).distinct()).withColumn("share", F.round("share", 6))


def summary_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    chapters = fixtures.frame(spark, "split_chapters")
    row = {"book": F.col("book"), "author": F.when(F.col("book") == "a", "Jane Miller"), "chapter": F.col("title"), "model": F.lit("m")}
    note = workspace.summary_markdown(row, F.concat(F.lit(" a\n summary of "), "title"), F.concat(F.lit("\n"), "body", F.lit("\n")), headings.SUMMARY_MARK["en"])
    return chapters.select("book", "n", note.alias("note"))


def side_cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.side_car(read(spark, sf_dir, "nation", ["n_nationkey", "n_name", "n_regionkey"]), "n_nationkey")


def noise_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.frame(spark, "skip_paragraphs").select("pid", gates.is_noise(F.col("text")).alias("noise"))


def translation_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = gates.accepted(fixtures.frame(spark, "unit_replies"), "src", "tgt", "ko", readings.plain_ratio)
    return made.select("uid", "accepted", F.coalesce(gates.already_in(F.coalesce("src", F.lit("")), "ko"), F.lit(False)).alias("already"))


def needs_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    samples = fixtures.frame(spark, "unit_replies").select((-F.col("uid")).cast("long").alias("doc_id"), F.col("tgt").alias("text"), F.lit("ko").alias("lang"))
    both = docs.unionByName(samples).withColumn("text", F.coalesce("text", F.lit("")))
    return both.select("doc_id", gates.needs_translation(F.col("text"), "ko", F.col("lang")).alias("into_ko"), gates.needs_translation(F.col("text"), "en", F.col("lang")).alias("into_en"))


def loss_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against their first three fifths, as an improved note, a page read again, a cleaned text and a summary input."""
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    cut = F.expr("substring(text, 1, CAST(ceil(length(text) * 0.61) AS INT))")
    new = F.concat(F.lit("## Head "), cut)
    spaced = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit(" "), F.lit("\n"))).otherwise(F.concat("text", F.lit(".")))
    summary = gates.summary_input(F.col("text"), 500)
    return docs.select(
        "doc_id", gates.note_kept(F.col("text"), new).alias("note"), gates.reading_replaces(F.col("text"), new, F.col("doc_id") % 3).alias("reading"),
        gates.clean_up_kept(F.col("text"), spaced).alias("clean_up"), F.length(summary).alias("summary_chars"),
    )


def retry_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = read(spark, sf_dir, "events", ["event_id", "event_type"])
    message = F.when(F.col("event_type") == "error", "429 rate_limit").otherwise("connection reset")
    return calls.select("event_id", gates.next_wait(message, F.col("event_id") % 6 + 1).alias("wait"))


def page_headers_by_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.frame(spark, "header_paragraphs").select("pid", headings.without_header(F.coalesce("text", F.lit("")), F.col("title")).alias("text"))


def header_strip_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a header put on every page: what is left is the document."""
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    paged = F.concat(F.lit("12 Chapter 3\n\n"), "text", F.lit("\f13 Chapter 3 "), F.lit("tail\n\nNotes 14"))
    return docs.select("doc_id", F.sha2(headings.stripped_pages(paged, F.lit("03_Mills")), 256).alias("text_sha256"))


def note_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = fixtures.frame(spark, "note_lines")
    line = F.col("line")
    return lines.select("lid", headings.section_of(line).alias("section"), headings.demoted(line).alias("demoted"), headings.without_number(line).alias("bare"))


def citation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = read(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    publisher = F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name"))
    year = F.when(F.col("n_nationkey") % 2 == 0, (F.col("n_nationkey") + 2000).cast("string"))
    return suppliers.select("n_nationkey", headings.citation(publisher, year).alias("citation"))


_STEM = r"regexp_replace({}, '\.[^./]*$', '')"
_ENDS = "regexp_matches({}, '(" + "|".join(workspace.DERIVED) + ")$')"
_SP = r"'[ \t\n\x0B\f\r]+'"
_BARE = f"regexp_replace({{}}, {_SP}, '', 'g')"
_SECTIONS = "(VALUES " + ", ".join(f"('{k}', '{n}')" for k, by in headings.SECTIONS.items() for n in sorted(set(by.values()))) + ") s(key, name)"
_TITLE_KEY = "regexp_replace(lower(regexp_replace(coalesce(title, ''), '^[0-9]+[_.\\s-]*', '')), '[^0-9a-z가-힣]+', '', 'g')"
_HEAD_KEY = "regexp_replace(lower({}), '[^0-9a-z가-힣]+', '', 'g')"

QUERIES = {
    "chapter_listing": chapter_listing,
    "summary_listing": summary_listing,
    "processed_stems": processed_stems,
    "note_candidates": note_candidates,
    "pending_smallest_first": pending_smallest_first,
    "quality_scan": quality_scan,
    "chapter_writes": chapter_writes,
    "coverage_warnings": coverage_warnings,
    "summary_notes": summary_notes,
    "side_cars": side_cars,
    "noise_paragraphs": noise_paragraphs,
    "translation_acceptance": translation_acceptance,
    "needs_translation": needs_translation,
    "loss_guards": loss_guards,
    "retry_waits": retry_waits,
    "page_headers_by_shape": page_headers_by_shape,
    "header_strip_pages": header_strip_pages,
    "note_sections": note_sections,
    "citation_lines": citation_lines,
}
ORACLES = {
    "chapter_listing": f"""WITH {cte('workspace_files')} SELECT folder, name, TRY_CAST(left(name, 2) AS INT) AS n FROM workspace_files
WHERE name LIKE '___%.txt' AND substr(name, 3, 1) = '_' AND NOT {_ENDS.format(_STEM.format('name'))}""",
    "summary_listing": f"""WITH {cte('workspace_files')}, f AS (SELECT folder, {_STEM.format('name')} AS stem, name FROM workspace_files WHERE name LIKE '%\\_wiki.%' ESCAPE '\\')
SELECT folder, stem, coalesce(max(name) FILTER (name LIKE '%.md'), max(name)) AS name FROM f GROUP BY folder, stem""",
    "processed_stems": f"WITH {cte('workspace_files')} SELECT {_STEM.format('name')} AS stem FROM workspace_files UNION SELECT 'log ' || lower(n_name) FROM nation",
    "note_candidates": f"""WITH {cte('workspace_files')} SELECT path FROM workspace_files f WHERE path LIKE '%.md' AND NOT regexp_matches(path, '(^|/)[._]')
AND NOT EXISTS (SELECT 1 FROM workspace_files v WHERE contains(v.path, '/.obsidian') AND starts_with(f.path, split_part(v.path, '/.obsidian', 1) || '/'))""",
    "pending_smallest_first": "SELECT doc_id || '.txt' AS name, CAST(length(text) AS INT) AS size FROM documents ANTI JOIN labels USING (doc_id)",
    "chapter_writes": f"""WITH {cte('split_chapters')}, {cte('written_files')},
w AS (SELECT book, lpad(CAST(n AS VARCHAR), 2, '0') || '_' || title || '.txt' AS name, body FROM split_chapters), t AS (SELECT * FROM written_files WHERE NOT {_ENDS.format(_STEM.format('name'))}),
m AS (SELECT coalesce(w.book, t.book) AS book, coalesce(w.name, t.name) AS name, CASE WHEN w.name IS NULL THEN 'purge' WHEN w.body = t.body THEN 'keep' ELSE 'write' END AS action
  FROM w FULL JOIN t ON w.book = t.book AND w.name = t.name)
SELECT * FROM m UNION ALL SELECT book, name, 'purge' FROM written_files d WHERE {_ENDS.format(_STEM.format('name'))}
AND NOT EXISTS (SELECT 1 FROM m WHERE m.book = d.book AND action = 'keep' AND starts_with({_STEM.format('d.name')}, {_STEM.format('m.name')} || '_'))""",
    "coverage_warnings": f"""WITH {cte('split_chapters')} SELECT book, round(sum(length({_BARE.format('body')})) / max(length({_BARE.format('source')})), 6) AS share
FROM split_chapters GROUP BY book HAVING sum(length({_BARE.format('body')})) < 0.6 * max(length({_BARE.format('source')}))""",
    "summary_notes": f"""WITH {cte('split_chapters')} SELECT book, n, '---' || chr(10) || 'book: ' || book || chr(10) || CASE WHEN book = 'a' THEN 'author: Jane Miller' || chr(10) ELSE '' END
|| 'chapter: ' || title || chr(10) || 'model: m' || chr(10) || '---' || chr(10) || '> **Summary:** a summary of ' || title || chr(10) || chr(10) || body || chr(10) AS note FROM split_chapters""",
    "side_cars": """SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation""",
    "noise_paragraphs": f"WITH {cte('skip_paragraphs')} SELECT pid, regexp_full_match(text, '[0-9\\s,.\\-–—%]*') AND length(trim(text)) <= 80 AS noise FROM skip_paragraphs",
    "needs_translation": f"""WITH {cte('unit_replies')}, d AS (SELECT doc_id, left(coalesce(text, ''), 3000) AS s, lang FROM documents UNION ALL SELECT -uid, left(coalesce(tgt, ''), 3000), 'ko' FROM unit_replies)
SELECT doc_id, length(regexp_replace(s, '[^가-힣]', '', 'g')) / greatest(length(s), 1) < 0.3 AS into_ko, lang <> 'en' AS into_en FROM d""",
    "loss_guards": f"""WITH d AS (SELECT doc_id, text, '## Head ' || left(text, CAST(ceil(length(text) * 0.61) AS INT)) AS new, {_BARE.format('text')} AS bare,
  regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS s FROM documents)
SELECT doc_id, length(regexp_replace(new, '[ \\t\\n\\x0B\\f\\r]+$', '')) >= greatest(600, floor(length(s) * 0.6)) AS note, doc_id % 3 > 0 AND length(new) >= length(text) * 0.9 AS reading,
  doc_id % 2 = 0 AS clean_up, CAST(CASE WHEN length(s) >= 200 THEN least(length(s), 500) END AS INT) AS summary_chars FROM d""",
    "retry_waits": "SELECT event_id, CAST(CASE WHEN event_id % 6 + 1 < 5 THEN CASE WHEN event_type = 'error' THEN 65 ELSE 4 END END AS INT) AS wait FROM events",
    "page_headers_by_shape": f"""WITH {cte('header_paragraphs')}, h AS (SELECT *, {_TITLE_KEY} AS own FROM header_paragraphs)
SELECT pid, CASE WHEN text = '' OR regexp_full_match(text, '(?i)[0-9]{{1,4}} chapter [0-9]{{1,4}}') THEN NULL
 WHEN own <> '' AND (regexp_matches(text, '^[0-9]{{1,4}} ') AND {_HEAD_KEY.format("regexp_replace(text, '^[0-9]{1,4} ', '')")} = own OR regexp_matches(text, ' [0-9]{{1,4}}$') AND {_HEAD_KEY.format("regexp_replace(text, ' [0-9]{1,4}$', '')")} = own) THEN NULL
 WHEN regexp_full_match(text, '(?i)([0-9]{{1,4}} (notes|references|index|bibliography|contents)|(notes|references|index|bibliography|contents) [0-9]{{1,4}})') THEN NULL
 ELSE regexp_replace(text, '(?i)^[0-9]{{1,4}} chapter [0-9]{{1,4}} ', '') END AS text FROM h""",
    "header_strip_pages": f"""SELECT doc_id, sha256(array_to_string(list_filter(list_transform(regexp_split_to_array(text, '\\n[ \\t]*\\n'), lambda p: regexp_replace(p, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')), lambda p: p <> ''), chr(10) || chr(10)) || chr(12) || 'tail') AS text_sha256 FROM documents""",
    "note_sections": f"""WITH {cte('note_lines')} SELECT lid, (SELECT arg_max(key, (length(name), name)) FROM {_SECTIONS} WHERE line LIKE '#%' AND starts_with(trim(ltrim(line, '#')), name)) AS section,
regexp_replace(line, '^(#{{2,5}})(\\s)', '#\\1\\2') AS demoted, trim(regexp_replace(line, '^\\s*[0-9]+[.)]\\s*', ''), ' :：') AS bare FROM note_lines""",
    "citation_lines": """SELECT n_nationkey, CASE WHEN n_nationkey % 3 <> 0 AND n_nationkey % 2 = 0 THEN n_name || ', ' || (n_nationkey + 2000) || '.' WHEN n_nationkey % 3 <> 0 THEN n_name
WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey + 2000 AS VARCHAR) ELSE '' END AS citation FROM nation""",
}
