"""Queries on notes, glossaries, bibliographic data and chapters, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import bibliographic as bib
from quirefold.functions.text import runs
from quirefold.operators import chapters, glossary, notes, segmentation
from quirefold.sources import fixtures
from quirefold.sources.fixtures import cte
from quirefold.sources.tables import read


def gap_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.gap_audit(fixtures.frame(spark, "note_numbers"), "doc_id").withColumn("missing", F.array_join("missing", ","))


def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", ["conv_id", "turn"])
    return notes.consecutive_runs(turns, "conv_id", "turn", "turn")


def footnote_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.linked_notes(fixtures.frame(spark, "footnote_pages"))


def page_reflow_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.pages_reflowed(fixtures.frame(spark, "footnote_pages"))


def glossary_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.keyword_pairs(fixtures.frame(spark, "keyword_notes"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents as (term, form): the term is the word in lower case without hyphens."""
    words = read(spark, sf_dir, "documents", ["text"]).select(F.explode(runs(F.col("text"), "A-Za-z-")).alias("run"))
    words = words.select(F.regexp_replace("run", "^-+", "").alias("form")).where(F.length("form") >= 4)
    return words.select(glossary.norm_key(F.col("form")).alias("term"), "form")


def glossary_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture = glossary.keyword_pairs(fixtures.frame(spark, "keyword_notes")).select("term", "form")
    return glossary.groups(_pairs(spark, sf_dir).unionByName(fixture))


def glossary_unify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.unify_targets(_pairs(spark, sf_dir))


def glossary_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.review_targets(glossary.keyword_pairs(fixtures.frame(spark, "keyword_notes")).select("term", "form"))


def glossary_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary.hints(read(spark, sf_dir, "benchmark", ["item_id", "text"]), _pairs(spark, sf_dir), "item_id", "text")


def html_pdf_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages", ["page_id", "url", "html"]).unionByName(
        fixtures.frame(spark, "html_links").select((-F.col("page_id")).cast("long").alias("page_id"), F.col("base").alias("url"), "html")
    )
    return pages.select("page_id", bib.pdf_link(F.col("html")).alias("link"), bib.resolved(F.col("url"), bib.pdf_link(F.col("html"))).alias("pdf_url"))


def published_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.frame(spark, "bibliographic")
    made = rows.select(
        "note_id",
        F.coalesce(F.nullif("published", F.lit("")), F.nullif(bib.published(F.col("text")), F.lit("")), bib.published_from_name(F.col("name"))).alias("published"),
        F.coalesce(F.nullif("publisher", F.lit("")), bib.publisher(F.col("text"))).alias("publisher"),
    )
    size = F.length("published")
    return made.withColumn("precision", F.when(size == 4, "year").when(size == 7, "month").when(size == 10, "day").otherwise(""))


def safe_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = bib.with_plain_title(fixtures.frame(spark, "titles"), "title", "ordinal", "plain")
    return titles.select("title_id", "plain", bib.safe_title(F.col("title")).alias("safe"))


def roman_numerals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.frame(spark, "roman").select("numeral", bib.roman_to_int(F.col("numeral")).cast("long").alias("value"))


def printed_offset_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.printed_offset(fixtures.frame(spark, "printed_numbers"), "book", "page", "num")


def anthology_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.anthology_evidence(fixtures.frame(spark, "headings"), "book")


def split_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.split_diagnosis(fixtures.frame(spark, "chapters"), "book")


def review_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.review_findings(fixtures.frame(spark, "chapters"), "book")


def page_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chapters.page_of_offsets(read(spark, sf_dir, "documents", ["source", "doc_id", "text"]), "source", "doc_id", "text", 1000)


def min_gap_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", ["user_id", "ts"])
    return chapters.min_gap(events.select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("at")), "user_id", "at", 86_400)


def chapter_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = read(spark, sf_dir, "documents", ["doc_id", "text"])
    made = segmentation.split_books(books, "doc_id", "text")
    return made.groupBy("doc_id", "mode").agg(F.count("*").alias("n_chapters"), F.sum(F.length("body")).alias("n_chars"))


def split_fixtures() -> list[tuple]:
    """(book, text, bookmarks, visual): a book for each way of splitting."""
    prose = lambda n: "plain words go on here. " * (n // 24)
    pages = f"{prose(1200)}\f{prose(1200)}\f{prose(1200)}\f{prose(4000)}\nReferences\n{prose(600)}"
    outline = [("One", 0), ("Two", 1), ("Three", 2), ("Four", 3)]
    contents = "Contents\n1. The Water Mill\n2. The Wind Mill\n3. The Paper Mill\n\n"
    roman = "I. The Water Mill ..... 3\nII. The Wind Mill ..... 40\nIII. The Paper Mill ..... 77\n\n"
    titles = ["The Water Mill", "The Wind Mill", "The Paper Mill"]
    notes = "\n".join(f"{n}. Miller and others, a book of the year." for n in range(1, 12))
    parts = "".join(f"{head}\n{prose(1200)}\n" for head in ["Part 1", "1. Rivers And Wheels", "2. Winds And Sails", "Part 2", "1. Paper And Ink", "2. Oil And Seeds"])
    starred = "".join(f"§ Chapter on {t}\n{prose(9000)}\n" for t in ("rivers", "winds", "paper"))
    books = [
        ("bookmark", pages, outline, None),
        ("visual", pages, None, [(t, p + 1) for t, p in outline]),
        ("heading", prose(600) + "".join(f"\n# Mill {k}\n{prose(3000)}" for k in "abc") + "\n# Short\nfew words\n# Notes\nnone", None, None),
        ("heading-ko", "".join(f"## {n}장 물레\n{prose(2000)}\n### 절 {n}\n{prose(2000)}\n" for n in (1, 2, 3)), None, None),
        ("toc-roman", roman + prose(500) + "".join(f"\n{r}. {t}\n{prose(2000)}" for r, t in zip(["I", "II", "III"], titles)), None, None),
        ("toc", contents + prose(500) + "".join(f"\n{t}\n{prose(7000)}" for t in titles) + f"\n{notes}" * 4, None, None),
        ("numbered", "\n" + prose(400) + "".join(f"\nChapter {n}: {t}\n{prose(1200)}" for n, t in enumerate(titles, 1)), None, None),
        ("numbered-parts", parts, None, None),
        ("llm", starred, None, None),
        ("single", prose(5000), None, None),
    ]
    return books


def pick_starred(lines: list[str]) -> list[dict]:
    """A stand-in for a model that picks chapter starts."""
    return [{"idx": n, "title": line.removeprefix("§ ")} for n, line in enumerate(lines) if line.startswith("§")]


def chapter_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    outline = "array<struct<title:string,page:int>>"
    books = spark.createDataFrame(split_fixtures(), f"book string, text string, bookmarks {outline}, visual {outline}")
    made = segmentation.split_books(books, "book", "text", pick_starred)
    return made.select("book", "mode", "n", "title", F.length("body").alias("n_chars"))


_W = r"[ \t\n\x0B\f\r]"
_WORDS = f"""w AS (SELECT unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z-]{{3,}}')) AS form FROM documents),
pairs AS (SELECT lower(regexp_replace(form, '[ \\t\\n\\x0B\\f\\r-]', '', 'g')) AS term, form FROM w)"""
_KEYWORDS = f"""{cte('keyword_notes')},
k AS (SELECT *, max(CASE WHEN line LIKE '## %' THEN pos * 2 + CAST(line = '## Keywords' AS INT) END) OVER (PARTITION BY path ORDER BY pos) AS o FROM keyword_notes),
g AS (SELECT path, pos, regexp_extract(line, '^#([^ \\t]+)[ \\t]+—[ \\t]+(.+)$', 1) AS term, regexp_extract(line, '^#([^ \\t]+)[ \\t]+—[ \\t]+(.+)$', 2) AS gloss FROM k WHERE o % 2 = 1 AND line NOT LIKE '## %'),
p AS (SELECT path, pos, term, unnest(range(len(x))) AS nth, unnest(x) AS piece FROM (SELECT *, regexp_extract_all(gloss, '[^()]*\\([^()]*\\)') AS x FROM g WHERE term <> '')),
keyed AS (SELECT path, term, arg_min(trim(regexp_extract(piece, '\\(([^()]*)\\)', 1)), nth) AS form FROM p
  WHERE regexp_replace(regexp_extract(piece, '^([^()]*)\\(', 1), '[ \\t]', '', 'g') LIKE '%' || term GROUP BY path, pos, term)"""
_LANG = """CASE WHEN regexp_matches(canonical, '[Α-Ωα-ωἀ-ῼ]') THEN 'el' WHEN regexp_matches(canonical, '[äöüÄÖÜß]') OR regexp_matches(canonical, '(ung|heit|keit|schaft|Dasein)([^A-Za-z]|$)') THEN 'de'
  WHEN regexp_matches(canonical, '[éèêëàâçôîïûù]') THEN 'fr' WHEN regexp_matches(canonical, '(^|[^A-Za-z])(Dei|Deus|homo|Homo|imago|Imago|Missio|sui|ex)([^A-Za-z]|$)') THEN 'la' ELSE 'en' END"""
_KEY = "lower(regexp_replace(form, '[ \\t\\n\\x0B\\f\\r-]', '', 'g'))"


def _groups(pairs: str) -> str:
    return f"""forms AS (SELECT term, form, count(*) AS n, {_KEY} AS key FROM {pairs} GROUP BY term, form),
gr AS (SELECT term, key, arg_max(form, (n, form = lower(form), form)) AS canonical, CAST(sum(n) AS BIGINT) AS n, count(*) AS n_forms FROM forms GROUP BY term, key)"""


def _first(patterns: list[str], text: str) -> str:
    return "CASE " + " ".join("WHEN regexp_matches({0}, '{1}') THEN regexp_extract({0}, '{1}', 1)".format(text, p.replace("'", "''")) for p in patterns) + " ELSE '' END"


def _published_sql() -> str:
    sample = "(substring(text, 1, 80000) || chr(10) || substring(text, greatest(length(text) - 39999, 1)))"
    date = rf"^({bib.YEAR})(?:[./년 -]?([0-9]{{1,2}}))?(?:[./월 -]?([0-9]{{1,2}}))?"
    edge = "[ \\t|,.;·ㆍ-]+"
    trim = lambda t: f"regexp_replace({t}, '^{edge}|{edge}$', '', 'g')"
    clean = lambda raw: trim("regexp_split_to_array(regexp_replace(" + trim(raw) + f", '\\s+', ' ', 'g'), '{bib.PUBLISHER_ENDS}')[1]")
    ok = lambda t: f"CASE WHEN length({t}) BETWEEN 2 AND 80 AND NOT regexp_matches({t}, '^[0-9]+$') THEN {t} END"
    pubs = ", ".join(ok(clean(_first([p], sample))) for p in bib.PUBLISHERS)
    arxiv = r"(?:^|[^0-9A-Za-z_])([12][0-9])(0[1-9]|1[0-2])\.[0-9]{4,5}(?:[^0-9A-Za-z_]|$)"
    compact = r"(?:^|[^0-9A-Za-z_])((?:19|20)[0-9]{2})(0[1-9]|1[0-2])(?:[^0-9A-Za-z_]|$)"
    leading = r"^[^0-9]*((?:19|20)[0-9]{2})(?:[^0-9]|$)"
    return f"""WITH {cte('bibliographic')},
r AS (SELECT *, regexp_replace({_first(bib.DATES, sample)}, '\\s+', '', 'g') AS raw FROM bibliographic),
p AS (SELECT *, regexp_extract(raw, '{date}', 1) AS y, regexp_extract(raw, '{date}', 2) AS m, regexp_extract(raw, '{date}', 3) AS d FROM r),
q AS (SELECT note_id, coalesce(nullif(published, ''), nullif(CASE WHEN y = '' THEN '' WHEN m <> '' AND d <> '' THEN y || '-' || lpad(m, 2, '0') || '-' || lpad(d, 2, '0')
   WHEN m <> '' THEN y || '-' || lpad(m, 2, '0') ELSE y END, ''),
  CASE WHEN regexp_matches(name, '{arxiv}') THEN '20' || regexp_extract(name, '{arxiv}', 1) || '-' || regexp_extract(name, '{arxiv}', 2)
   WHEN regexp_matches(name, '{compact}') THEN regexp_extract(name, '{compact}', 1) || '-' || regexp_extract(name, '{compact}', 2)
   WHEN regexp_matches(name, '{leading}') THEN regexp_extract(name, '{leading}', 1) ELSE '' END) AS published,
  coalesce(nullif(publisher, ''), {pubs}, '') AS publisher FROM p)
SELECT *, CASE length(published) WHEN 4 THEN 'year' WHEN 7 THEN 'month' WHEN 10 THEN 'day' ELSE '' END AS precision FROM q"""


def _link_sql() -> str:
    root = "regexp_extract(url, '^([a-z]+://[^/]+)', 1)"
    return f"""WITH {cte('html_links')}, a AS (SELECT page_id, url, html FROM pages UNION ALL SELECT -page_id, base, html FROM html_links),
l AS (SELECT page_id, url, {root} AS root, replace({_first(bib.LINKS, 'html')}, '&amp;', '&') AS link,
  regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS f0 FROM a),
f AS (SELECT *, CASE WHEN length(f0) <= length(root) THEN root || '/' ELSE f0 END AS folder FROM l)
SELECT page_id, link, CASE WHEN link = '' THEN NULL WHEN regexp_matches(link, '^[a-z]+://') THEN link WHEN link LIKE '/%' THEN root || link
  WHEN link LIKE '../%' THEN CASE WHEN length(regexp_replace(folder, '[^/]+/$', '')) > length(root) THEN regexp_replace(folder, '[^/]+/$', '') ELSE root || '/' END || substring(link, 4)
  ELSE folder || regexp_replace(link, '^\\./', '') END AS pdf_url FROM f"""


_OPEN = ", ".join(f"'{w}'" for w in chapters.OPENING)
_CLOSE = ", ".join(f"'{w}'" for w in chapters.CLOSING)
_BOUNDARY = "^(?:[0-9]{1,2}[.)]?|[ivxl]{1,5}[.)])?(" + "|".join(chapters.OPENING + chapters.CLOSING + chapters.OTHER) + ")$"

QUERIES = {
    "gap_audit": gap_audit,
    "consecutive_runs": consecutive_runs,
    "footnote_link": footnote_link,
    "page_reflow_notes": page_reflow_notes,
    "glossary_keywords": glossary_keywords,
    "glossary_build": glossary_build,
    "glossary_unify": glossary_unify,
    "glossary_review": glossary_review,
    "glossary_hints": glossary_hints,
    "html_pdf_link": html_pdf_link,
    "published_date": published_date,
    "safe_title": safe_title,
    "roman_numerals": roman_numerals,
    "printed_offset_vote": printed_offset_vote,
    "anthology_evidence": anthology_evidence,
    "split_diagnosis": split_diagnosis,
    "review_findings": review_findings,
    "page_asof": page_asof,
    "min_gap_dedup": min_gap_dedup,
    "chapter_cascade": chapter_cascade,
    "chapter_strategies": chapter_strategies,
}
_BARE = "lower(regexp_replace({}, '[ \\t\\n\\x0B\\f\\r]+', '', 'g'))"
ORACLES = {
    "gap_audit": f"""WITH {cte('note_numbers')}, n AS (SELECT doc_id, page AS from_page, num AS after, lead(page) OVER w AS page, lead(num) OVER w AS upto FROM note_numbers WINDOW w AS (PARTITION BY doc_id ORDER BY page, num))
SELECT doc_id, page, from_page, after, array_to_string(range(after + 1, upto), ',') AS missing, upto - after - 1 <= 3 AND page - from_page <= 2 AS small FROM n WHERE upto - after BETWEEN 2 AND 15""",
    "consecutive_runs": """WITH r AS (SELECT conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM conversations)
SELECT conv_id, min(turn) AS first_num, max(turn) AS last_num, count(*) AS n FROM r GROUP BY conv_id, run HAVING count(*) >= 3""",
    "glossary_keywords": f"WITH {_KEYWORDS} SELECT path, term, form FROM keyed",
    "glossary_build": f"WITH {_WORDS}, {_KEYWORDS}, everything AS (SELECT term, form FROM pairs UNION ALL SELECT term, form FROM keyed), {_groups('everything')} SELECT *, {_LANG} AS lang FROM gr",
    "glossary_unify": f"WITH {_WORDS}, {_groups('pairs')} SELECT forms.term, form, canonical, forms.n FROM forms JOIN gr USING (term, key) WHERE form <> canonical",
    "glossary_hints": f"""WITH {_WORDS}, {_groups('pairs')}, single AS (SELECT term, any_value(canonical) AS canonical, CAST(sum(n) AS BIGINT) AS n FROM gr GROUP BY term HAVING count(*) = 1),
t AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[a-z가-힣]+')) AS term FROM benchmark),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY n DESC, term) AS place, term, canonical FROM t JOIN single USING (term) WHERE length(term) >= 2)
SELECT item_id, CAST(place AS INT) AS place, term, canonical FROM r WHERE place <= 25""",
    "html_pdf_link": _link_sql(),
    "published_date": _published_sql(),
    "roman_numerals": f"""WITH RECURSIVE {cte('roman')}, v AS (SELECT numeral, string_split(reverse(upper(numeral)), '') AS l FROM roman),
f AS (SELECT numeral, l, 0 AS i, 0 AS total, 0 AS most FROM v WHERE regexp_full_match(numeral, '(?i)[IVXLCDM]+') UNION ALL
  SELECT numeral, l, i + 1, total + CASE WHEN x < most THEN -x ELSE x END, greatest(most, x) FROM (SELECT *, map {{'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100, 'D': 500, 'M': 1000}}[l[i + 1]] AS x FROM f) WHERE i < len(l))
SELECT r.numeral, CAST(f.total AS BIGINT) AS value FROM roman r LEFT JOIN f ON f.numeral = r.numeral AND f.i = len(f.l)""",
    "printed_offset_vote": f"""WITH {cte('printed_numbers')}, p AS (SELECT book, count(DISTINCT page) AS n FROM printed_numbers GROUP BY book),
v AS (SELECT book, num - page - 1 AS o, count(DISTINCT page) AS votes FROM printed_numbers GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY votes DESC, o) AS k, lead(votes, 1, 0) OVER (PARTITION BY book ORDER BY votes DESC, o) AS runner FROM v)
SELECT book, o AS offset, votes FROM r JOIN p USING (book) WHERE k = 1 AND votes >= greatest(4, (n + 1) // 2) AND votes >= runner + 3""",
    "anthology_evidence": f"""WITH {cte('headings')}, h AS (SELECT book, CASE WHEN length(trim(line)) BETWEEN 2 AND 40 THEN regexp_extract({_BARE.format('line')}, '{_BOUNDARY}', 1) ELSE '' END AS word FROM headings),
f AS (SELECT book, word, CASE WHEN word IN ({_OPEN}) THEN 'opening' WHEN word IN ({_CLOSE}) THEN 'closing' END AS family FROM h)
SELECT book, family, count(DISTINCT word) AS n_words, count(*) AS n_hits FROM f WHERE family IS NOT NULL GROUP BY book, family HAVING count(DISTINCT word) >= 2 OR count(*) >= 3""",
    "split_diagnosis": f"""WITH {cte('chapters')}, s AS (SELECT *, length(body) AS size FROM chapters), m AS (SELECT book, list_sort(list(size))[count(*) // 2 + 1] AS median, count(*) AS k FROM s WHERE size > 0 GROUP BY book), j AS (SELECT * FROM s JOIN m USING (book))
SELECT book, n, 'too_long' AS finding FROM j WHERE k >= 3 AND size > 2.2 * median UNION ALL SELECT book, n, 'too_short' FROM j WHERE k >= 3 AND size < 0.15 * median UNION ALL
SELECT book, n, 'holds_other_title' FROM j WHERE EXISTS (SELECT 1 FROM chapters o WHERE o.book = j.book AND o.n <> j.n AND length({_BARE.format('o.title')}) >= 4 AND contains({_BARE.format('j.body')}, {_BARE.format('o.title')}))""",
    "review_findings": f"""WITH {cte('chapters')}, s AS (SELECT *, length(body) AS size FROM chapters),
a AS (SELECT book, count(*) AS chapters, count(*) FILTER (size > 0) AS filled, max(size) AS largest, list_sort(list(size) FILTER (size > 0))[count(*) FILTER (size > 0) // 2 + 1] AS median,
  count(*) FILTER (regexp_matches(trim(title), '{chapters.NUMBER_ONLY}')) AS numeric, count(*) FILTER (n > 0 AND size < 300) AS shells, count(*) FILTER (regexp_matches(trim(title), '{chapters.BACK_MATTER}')) AS back FROM s GROUP BY book)
SELECT book, 'uneven' AS finding, CAST(largest AS BIGINT) AS n FROM a WHERE filled >= 3 AND largest > 3 * median UNION ALL SELECT book, 'few', chapters FROM a WHERE chapters <= 4 UNION ALL
SELECT book, 'numeric_titles', numeric FROM a WHERE numeric > 0 UNION ALL SELECT book, 'shells', shells FROM a WHERE shells > 0 UNION ALL SELECT book, 'back_matter', back FROM a WHERE back > 0""",
    "page_asof": """WITH s AS (SELECT source, doc_id, length(text) AS size, sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id) AS fin FROM documents),
o AS (SELECT source, unnest(range(0, CAST(max(fin) AS BIGINT), 1000)) AS off FROM s GROUP BY source)
SELECT o.source, off AS offset, doc_id FROM o JOIN s ON s.source = o.source AND off < fin AND off >= fin - size""",
    "min_gap_dedup": """WITH RECURSIVE e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS a FROM events),
f AS (SELECT user_id, min(a) AS a FROM e GROUP BY user_id UNION ALL
  SELECT f.user_id, (SELECT min(e.a) FROM e WHERE e.user_id = f.user_id AND e.a >= f.a + 86400) AS a FROM f WHERE f.a IS NOT NULL)
SELECT user_id, a AS at FROM f WHERE a IS NOT NULL""",
    # ways and titles as the rules give them, sizes as recorded from a run: each strategy wins once
    "chapter_strategies": """SELECT book, mode, CAST(n AS INT) AS n, title, CAST(n_chars AS INT) AS n_chars FROM (VALUES
  ('bookmark', 'bookmark', 1, 'One', 1199), ('bookmark', 'bookmark', 2, 'Two', 1199), ('bookmark', 'bookmark', 3, 'Three', 1199),
  ('bookmark', 'bookmark', 4, 'Four', 3983), ('bookmark', 'bookmark', 5, 'References', 610), ('visual', 'visual', 1, 'One', 1199),
  ('visual', 'visual', 2, 'Two', 1199), ('visual', 'visual', 3, 'Three', 1199), ('visual', 'visual', 4, 'Four', 3983),
  ('visual', 'visual', 5, 'References', 610), ('heading', 'heading', 1, '서두', 599), ('heading', 'heading', 2, 'Mill a', 3008),
  ('heading', 'heading', 3, 'Mill b', 3008), ('heading', 'heading', 4, 'Mill c', 3040), ('heading-ko', 'heading', 1, '1장 물레', 4001),
  ('heading-ko', 'heading', 2, '2장 물레', 4001), ('heading-ko', 'heading', 3, '3장 물레', 4001), ('toc-roman', 'toc', 1, '머리말', 562),
  ('toc-roman', 'toc', 2, 'I. The Water Mill', 2009), ('toc-roman', 'toc', 3, 'II. The Wind Mill', 2009),
  ('toc-roman', 'toc', 4, 'III. The Paper Mill', 2011), ('toc', 'toc', 1, '머리말', 542), ('toc', 'toc', 2, '1. The Water Mill', 6998),
  ('toc', 'toc', 3, '2. The Wind Mill', 6997), ('toc', 'toc', 4, '3. The Paper Mill', 6998), ('numbered', 'numbered', 1, '머리말', 383),
  ('numbered', 'numbered', 2, 'The Water Mill', 1225), ('numbered', 'numbered', 3, 'The Wind Mill', 1224),
  ('numbered', 'numbered', 4, 'The Paper Mill', 1225), ('numbered-parts', 'numbered', 1, '머리말', 1206),
  ('numbered-parts', 'numbered', 2, 'Rivers And Wheels', 1220), ('numbered-parts', 'numbered', 3, 'Winds And Sails', 2426),
  ('numbered-parts', 'numbered', 4, 'Paper And Ink', 1216), ('numbered-parts', 'numbered', 5, 'Oil And Seeds', 1216),
  ('llm', 'llm', 1, 'Chapter on rivers', 9019), ('llm', 'llm', 2, 'Chapter on winds', 9018), ('llm', 'llm', 3, 'Chapter on paper', 9018),
  ('single', 'single', 1, 'whole text', 4992)
) t(book, mode, n, title, n_chars)""",
    "chapter_cascade": "SELECT doc_id, 'single' AS mode, CAST(1 AS BIGINT) AS n_chapters, CAST(length(text) AS BIGINT) AS n_chars FROM documents",
}
