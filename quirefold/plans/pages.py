"""Queries on pages and lines, with their SQL: furniture, health, quality, line breaks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import filled_lines_sql, strip_sql, tokens_sql
from quirefold.operators import furniture, lines, quality
from quirefold.sources import fixtures
from quirefold.sources.tables import read


def _docs(spark, sf_dir, *columns):
    return read(spark, sf_dir, "documents", list(columns))


def furniture_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _docs(spark, sf_dir, "source", "text").unionByName(fixtures.frame(spark, "book_pages").select(F.col("book").alias("source"), "text"))
    return furniture.edge_furniture(both, "source", "text")


def furniture_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.repeated_lines(_docs(spark, sf_dir, "source", "doc_id", "text"), "source", "doc_id", "text")


def book_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.book_headers(_docs(spark, sf_dir, "source", "doc_id", "text"), "source", "doc_id", "text")


def running_head_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return furniture.running_heads(_docs(spark, sf_dir, "source", "text"), "source", "text")


def vertical_noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.functions.text import tokens
    from quirefold.sources.tables import lines as lines_of

    each = lines_of(_docs(spark, sf_dir, "doc_id", "text"), ["doc_id"]).withColumn("noise", furniture.is_vertical_noise(F.col("line")))
    chars = F.length(F.array_join(tokens(F.col("line")), ""))
    size = F.size(tokens(F.col("line")))
    return each.groupBy("doc_id").agg(
        F.count("*").alias("n_lines"),
        F.count_if("noise").alias("n_noise"),
        F.min(F.when(size >= 6, chars / size)).alias("shortest_mean"),
    )


def token_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "doc_id", "text").select("doc_id", quality.token_health(F.col("text")).alias("long_share"))


def garble_rate_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir, "doc_id", "text").unionByName(
        fixtures.frame(spark, "ko_quality").select((-F.col("doc_id")).cast("long").alias("doc_id"), "text")
    )
    return docs.select("doc_id", quality.garble_rate(F.col("text")).alias("garble_per_1k"))


def text_quality_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assessed(fixtures.frame(spark, "ko_quality"), "text").drop("text")


def linebreak_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _docs(spark, sf_dir, "doc_id", "text").unionByName(
        fixtures.frame(spark, "line_breaks").select((-F.col("doc_id")).cast("long").alias("doc_id"), "text")
    )
    made = lines.line_plan(both, "text")
    return made.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.array_join("kinds", "").alias("kinds"),
        F.sha2(lines.rendered(F.col("lines"), F.col("kinds")), 256).alias("rendered_sha256"),
    )


def reflow_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixture = fixtures.frame(spark, "reflow_lines").groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text")
    )
    docs = _docs(spark, sf_dir, "doc_id", "text").unionByName(fixture.select((-F.col("doc_id")).cast("long").alias("doc_id"), "text"))
    return lines.reflowed(docs, "doc_id", "text").select("doc_id", "block", "in_block", F.sha2("paragraph", 256).alias("paragraph_sha256"))


def lossless_reflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The invariant of reflow: non-space characters but for line-end hyphens are kept."""
    docs = _docs(spark, sf_dir, "doc_id", "text")
    kept = lines.reflowed(docs, "doc_id", "text").groupBy("doc_id").agg(F.sum(F.length(F.regexp_replace("paragraph", "[ \t\n\x0B\f\r-]", ""))).alias("kept"))
    had = docs.select("doc_id", F.length(F.regexp_replace("text", "[ \t\n\x0B\f\r-]", "")).cast("long").alias("had"))
    return had.join(kept, "doc_id", "left").select("doc_id", "had", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


_PAGES = "pages_of AS (SELECT source, count(*) AS n_pages FROM documents GROUP BY source)"
_FILLED = f"filled AS (SELECT source, doc_id, {filled_lines_sql('text')} AS ls FROM documents)"
_NO_DIGITS = strip_sql("regexp_replace({}, '[0-9]+', '', 'g')")
_EDGES = f"""{_PAGES}, {_FILLED},
edge AS (SELECT source, unnest(list_concat(ls[1:2], ls[greatest(len(ls) - 1, 1):])) AS line FROM filled),
edge_keys AS (SELECT source, key, count(*) AS n FROM (SELECT source, {_NO_DIGITS.format('line')} AS key FROM edge) GROUP BY source, key),
furniture AS (SELECT source, key, n FROM edge_keys JOIN pages_of USING (source) WHERE n >= greatest(3, n_pages // 2) AND length(key) BETWEEN 1 AND 89)"""
_NOISE = f"(len({tokens_sql('s')}) >= 6 AND length(array_to_string({tokens_sql('s')}, '')) / nullif(len({tokens_sql('s')}), 0) <= 1.3)"

_KEEP_FIRST = f"""WITH {_EDGES},
raw AS (SELECT source, doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
ls AS (SELECT source, doc_id, line_no, {strip_sql('line')} AS s FROM raw),
k AS (SELECT *, {_NO_DIGITS.format('s')} AS key FROM ls WHERE s <> ''),
ex AS (SELECT source, s FROM k WHERE length(s) < 90 GROUP BY source, s HAVING count(*) >= 3),
lk AS (SELECT source, key FROM k WHERE length(key) > 40 GROUP BY source, key HAVING count(*) >= 3),
hit AS (SELECT k.*, regexp_full_match(s, '[0-9]{{1,4}}') OR {_NOISE} AS never,
  (length(key) > 10 AND EXISTS (SELECT 1 FROM furniture f WHERE f.source = k.source AND f.key = k.key)) OR EXISTS (SELECT 1 FROM lk WHERE lk.source = k.source AND lk.key = k.key) AS by_key,
  EXISTS (SELECT 1 FROM ex WHERE ex.source = k.source AND ex.s = k.s) AS by_line FROM k),
marked AS (SELECT source, doc_id, line_no, CASE WHEN never THEN NULL WHEN by_key AND length(key) > 10 THEN key ELSE s END AS mark FROM hit WHERE never OR by_key OR by_line)
SELECT source, doc_id, CAST(line_no AS INT) AS line_no, mark,
  mark IS NOT NULL AND row_number() OVER (PARTITION BY source, mark ORDER BY doc_id, line_no) = 1 AS kept FROM marked"""

_HEADERS = f"""WITH {_PAGES}, {_FILLED},
edge AS (SELECT DISTINCT source, doc_id, CASE WHEN regexp_full_match(line, 'https?://[^ ]+') THEN line ELSE
  {strip_sql("regexp_replace(line, '^[0-9]{1,4}[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+[0-9]{1,4}$', '', 'g')")} END AS header
  FROM (SELECT source, doc_id, unnest(list_concat(ls[1:3], ls[greatest(len(ls) - 2, 1):])) AS line FROM filled)),
counted AS (SELECT source, header, count(*) AS n_pages FROM edge WHERE length(header) BETWEEN 4 AND 80 GROUP BY source, header)
SELECT source, header, counted.n_pages FROM counted JOIN (SELECT source, n_pages AS total FROM pages_of) USING (source)
WHERE counted.n_pages >= greatest(3, floor(total * 0.2))"""

_HEADS = f"""WITH w AS (SELECT source, doc_id, ({tokens_sql('text')})[1:12] AS w FROM documents),
starts AS (SELECT source, doc_id, w, unnest(range(len(w))) AS i FROM w),
grams AS (SELECT DISTINCT source, doc_id, array_to_string(w[i + 1 : i + n], ' ') AS head FROM (SELECT *, unnest(range(1, least(8, len(w) - i) + 1)) AS n FROM starts)),
hits AS (SELECT source, head, count(*) AS n_pages FROM grams WHERE length(head) >= 4 AND NOT regexp_matches(head, '^[0-9]') GROUP BY source, head HAVING count(*) >= 3)
SELECT * FROM hits h WHERE NOT EXISTS (SELECT 1 FROM hits o WHERE o.source = h.source AND o.head <> h.head AND contains(o.head, h.head))"""

_GLUED = quality.GARBLED


def _garble(text: str) -> str:
    count = lambda t: f"len(regexp_extract_all({t}, '{_GLUED}'))"
    return f"""CASE WHEN length({text}) < 8000 THEN {count(text)} / greatest(length({text}), 1) * 1000
  ELSE list_sort(list_transform(range(40), lambda i: {count(f"substring({text}, i * (length({text}) // 40) + 1, length({text}) // 40)")} / (length({text}) // 40) * 1000))[21] END"""


def _verdict_sql() -> str:
    n = lambda p: f"len(regexp_extract_all(text, '{p}'))"
    return f"""WITH {fixtures.cte('ko_quality')},
m AS (SELECT doc_id, text, list_filter({tokens_sql('text')}, lambda t: regexp_full_match(t, '[가-힣]+')) AS h, {n('[가-힣]')} / greatest(length(text), 1) AS hangul,
  {n('[一-鿿]')} / greatest(length(text), 1) AS han, {n('[할될을] 수 있')} AS ok, {n('[할될을] 있')} AS lost FROM ko_quality),
r AS (SELECT *, len(h) >= 500 AND hangul >= 0.2 AS applies FROM m),
v AS (SELECT *, CASE WHEN applies THEN len(list_filter(h, lambda t: length(t) = 1)) / len(h) * 100 ELSE 0.0 END AS one, CASE WHEN applies THEN {_garble('text')} ELSE 0.0 END AS g FROM r),
x AS (SELECT *, CASE WHEN one < 2 THEN 2 WHEN one < 5 THEN 1 ELSE 0 END AS a, greatest(CASE WHEN g >= 6 THEN 2 WHEN g >= 3 THEN 1 ELSE 0 END, CASE WHEN applies AND han > 0.02 THEN 1 ELSE 0 END) AS b FROM v),
names AS (SELECT *, ['ok', 'suspect', 'bad'] AS n, regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g') = '' AS blank FROM x)
SELECT doc_id, one AS one_syllable_pct, g AS garble_per_1k, CASE WHEN applies THEN n[a + 1] ELSE 'unknown' END AS word_loss,
  CASE WHEN applies THEN n[b + 1] ELSE 'unknown' END AS garble, CASE WHEN applies THEN n[greatest(a, b) + 1] ELSE 'unknown' END AS verdict,
  concat_ws(',', CASE WHEN blank THEN 'empty' END, CASE WHEN NOT blank AND NOT applies THEN 'too_little_hangul' END, CASE WHEN applies AND a = 2 THEN 'words_lost' END,
   CASE WHEN applies AND a = 1 THEN 'few_one_syllable_words' END, CASE WHEN applies AND lost > 0 AND ok = 0 THEN 'su_always_dropped' END,
   CASE WHEN applies AND ok > 0 AND lost > greatest(3, ok) THEN 'su_often_dropped' END, CASE WHEN applies AND g >= 6 THEN 'garbled' END,
   CASE WHEN applies AND g >= 3 AND g < 6 THEN 'some_garble' END, CASE WHEN applies AND han > 0.02 THEN 'han_mixed' END, CASE WHEN applies AND greatest(a, b) = 0 THEN 'fine' END) AS reasons
FROM names"""


_BREAKS = f"""WITH {fixtures.cte('line_breaks')},
d AS (SELECT doc_id, {filled_lines_sql('text')} AS ls FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM line_breaks)),
m AS (SELECT doc_id, ls, list_sort(list_transform(ls, lambda s: length(s)))[len(ls) // 2 + 1] AS med FROM d),
k AS (SELECT doc_id, ls, list_transform(range(1, len(ls)), lambda i: CASE WHEN length(ls[i]) < med * 0.9 THEN 'P'
  WHEN regexp_matches(ls[i], '[0-9A-Za-z가-힣]$') AND regexp_matches(ls[i + 1], '^[0-9A-Za-z가-힣]') THEN '?' ELSE 'S' END) AS ks FROM m)
SELECT doc_id, len(ls) AS n_lines, coalesce(array_to_string(ks, ''), '') AS kinds,
  sha256(CASE WHEN len(ls) > 0 THEN ls[1] || array_to_string(list_transform(range(1, len(ls)), lambda i: (CASE WHEN ks[i] = 'P' THEN chr(10) || chr(10) ELSE ' ' END) || ls[i + 1]), '') ELSE '' END) AS rendered_sha256
FROM k"""

QUERIES = {
    "furniture_edges": furniture_edges,
    "furniture_keep_first": furniture_keep_first,
    "book_headers": book_headers,
    "running_head_ngrams": running_head_ngrams,
    "vertical_noise_lines": vertical_noise_lines,
    "token_health": token_health,
    "garble_rate_blocks": garble_rate_blocks,
    "text_quality_verdict": text_quality_verdict,
    "linebreak_plan": linebreak_plan,
    "reflow_paragraphs": reflow_paragraphs,
    "lossless_reflow": lossless_reflow,
}
ORACLES = {
    "furniture_edges": f"WITH {fixtures.cte('book_pages')}, both_of AS (SELECT source, doc_id, text FROM documents UNION ALL SELECT book, page, text FROM book_pages), "
    + _EDGES.replace("FROM documents", "FROM both_of")
    + " SELECT * FROM furniture",
    "furniture_keep_first": _KEEP_FIRST,
    "book_headers": _HEADERS,
    "running_head_ngrams": _HEADS,
    "vertical_noise_lines": f"""WITH l AS (SELECT doc_id, {tokens_sql('s')} AS w, {_NOISE} AS noise FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS s FROM documents))
SELECT doc_id, count(*) AS n_lines, CAST(count_if(noise) AS BIGINT) AS n_noise, min(CASE WHEN len(w) >= 6 THEN length(array_to_string(w, '')) / len(w) END) AS shortest_mean FROM l GROUP BY doc_id""",
    "token_health": f"SELECT doc_id, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda t: length(t) >= 26)) / len(w) ELSE 1.0 END AS long_share FROM (SELECT doc_id, {tokens_sql('text')} AS w FROM documents)",
    "garble_rate_blocks": f"WITH {fixtures.cte('ko_quality')}, d AS (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id, text FROM ko_quality) SELECT doc_id, {_garble('text')} AS garble_per_1k FROM d",
    "text_quality_verdict": _verdict_sql(),
    "linebreak_plan": _BREAKS,
    "lossless_reflow": "SELECT doc_id, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r-]', '', 'g')) AS had, had AS kept FROM documents",
}
