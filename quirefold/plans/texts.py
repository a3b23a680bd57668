"""Queries on units, readings, layouts and file formats, with their SQL."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions.text import SPACE
from quirefold.operators import layout, readings, units
from quirefold.sources import fixtures, office
from quirefold.sources.fixtures import cte
from quirefold.sources.tables import read


def skip_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    paragraphs = turns.select(F.concat_ws(":", "conv_id", "turn").alias("pid"), "text").unionByName(
        fixtures.frame(spark, "skip_paragraphs").select(F.concat(F.lit("f"), F.col("pid")).alias("pid"), "text")
    )
    return paragraphs.select("pid", units.skip_reason(F.col("text")).alias("reason"))


def unit_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.frame(spark, "skip_paragraphs").select("pid", units.role(F.col("text")).alias("role"))


def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    kind = F.when(F.col("role") == "system", "heading").when(F.col("role") == "user", "body").otherwise("note")
    made = units.neighbour_context(turns.withColumn("kind", kind), "conv_id", "turn", "text", "kind")
    return made.select("conv_id", "turn", "before", "after")


def paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = units.paragraph_chunks(read(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text")
    return made.select("doc_id", "n", F.sha2("chunk", 256).alias("chunk_sha256"), F.length("chunk").alias("n_chars"))


def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.coverage(read(spark, sf_dir, "documents", ["doc_id", "text"]), "doc_id", "text").select("doc_id", "source_chars", "retained_chars")


def translation_plan_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    plan = units.translation_plan(docs)
    bare = lambda c: F.length(F.regexp_replace(c, SPACE, ""))
    kept = plan.where("kind != 'page'").groupBy("doc_id").agg(F.sum(bare("unit")).alias("retained_chars"))
    had = docs.select("doc_id", bare("text").cast("long").alias("source_chars"))
    return had.join(kept, "doc_id", "left").select("doc_id", "source_chars", F.coalesce("retained_chars", F.lit(0)).cast("long").alias("retained_chars"))


def plan_fixtures() -> list[tuple]:
    """(doc, text, titles, notes, bodies): what a plan has to tell apart."""
    headers = "".join(f"{n} The Old Mill\nThe wheel turned on page {n}.\n\n" for n in (4, 6, 8))
    return [
        ("pages", "The sentence goes on\n\n12 A note below the text.\f\nhere and ends. More text.", [], [], []),
        ("headers", headers + "The end of it.", ["The Old Mill"], [], []),
        ("same-number", headers.replace("6 The", "4 The").replace("8 The", "4 The") + "The end.", ["The Old Mill"], [], []),
        ("headings", "Unfinished before\n\n# Head\n\nText after it.\n\n1.2 Section\n\nMore.", [], [], []),
        ("regions", "See the town book of that year.\n\nBody text of a page.", [], ["See the town book of that year."], ["Body text of a page."]),
        ("long", "words without an end " * 1200, [], [], []),
        ("empty", "", [], [], []),
        ("mark", "One.[[PAGEBREAK]]Two.", [], [], []),
    ]


def plan_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "doc string, text string, titles array<string>, notes array<string>, bodies array<string>"
    made = units.translation_plan(spark.createDataFrame(plan_fixtures(), kinds), key="doc")
    shown = lambda c: F.left(F.replace(c, F.lit("\n"), F.lit("|")), F.lit(40))
    return made.select(
        "doc", "n", "start", "end", "page", "kind", shown(F.col("unit")).alias("unit"), F.col("warning").isNotNull().alias("warned"),
        shown(F.col("before")).alias("before"), shown(F.col("after")).alias("after"), F.size("excluded").alias("n_excluded"),
    )


def paragraph_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three ways of cutting paragraphs, what stands alone, and sentences over notes."""
    texts = [
        ("blocks", "Short.\n\nAlso short, but this block has more than fifty characters in all.\n\n3 Psalm 8:4.\n\nLast."),
        ("over-notes", "A sentence that is cut in the middle of the page and goes\n\n7 A note in between.\n\n[[PAGEBREAK]]\n\non behind the page mark, which is a long way."),
        ("lines", "\n".join(f"Line {n} of a text without empty lines {'and more ' * 60}" for n in range(12))),
        ("sentences", "One sentence that is rather long for its kind, as they are. " * 80),
        ("one", "Only this."),
        ("empty", ""),
    ]
    made = spark.createDataFrame(texts, "doc string, text string").select("doc", F.posexplode(units.chunks("text")).alias("n", "chunk"))
    return made.select("doc", "n", F.length("chunk").alias("n_chars"), F.left(F.replace("chunk", F.lit("\n"), F.lit("|")), F.lit(60)).alias("chunk"))


def reading_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = fixtures.frame(spark, "page_readings").withColumn("r", readings.reconcile("read_a", "read_b", "judge"))
    made = readings.verdicts(pages.withColumn("text", F.col("r.text")), "text", "base", "judge", least_base=20)
    return made.select("page", "text", F.size("r.differences").alias("n_open"), "status", "note")


def reading_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How like each other the two readings of a page are, and the first one and the text layer."""
    pages = fixtures.frame(spark, "page_readings")
    ratio = lambda a, b: F.round(readings.similarity(F.col(a), F.col(b)), 6)
    return pages.select("page", ratio("read_a", "read_b").alias("readings"), ratio("read_a", "base").alias("layer"))


def fuzzy_source_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    stems = fixtures.frame(spark, "stems")
    return readings.fuzzy_sources(stems.where("source = 'note'"), stems.where("source = 'file'"))


def glyph_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pages_in_reading_order(fixtures.frame(spark, "glyphs"))


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def sample_files() -> list[tuple[str, bytearray]]:
    """A DOCX with a table, a text box in two forms and a footnote; an HWPX with sections 2 and 10; a damaged file."""

    def package(parts: dict[str, str]) -> bytearray:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(zipfile.ZipInfo(name), text)
        return bytearray(out.getvalue())

    body = (
        f'<w:document xmlns:w="{W}" xmlns:mc="m"><w:body><w:p><w:r><w:t>The mill</w:t></w:r><w:r><w:footnoteReference w:id="2"/></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
        "<mc:AlternateContent><mc:Choice><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></mc:Choice>"
        "<mc:Fallback><w:txbxContent><w:p><w:r><w:t>boxed</w:t></w:r></w:p></w:txbxContent></mc:Fallback></mc:AlternateContent>"
        "<w:p><w:del><w:r><w:delText>gone</w:delText></w:r></w:del><w:r><w:t>End</w:t></w:r></w:p></w:body></w:document>"
    )
    notes = f'<w:footnotes xmlns:w="{W}"><w:footnote w:id="2"><w:p><w:r><w:t>A note.</w:t></w:r></w:p></w:footnote></w:footnotes>'
    section = '<s xmlns:hp="h"><hp:p><hp:run><hp:t>{}</hp:t></hp:run></hp:p></s>'
    return [
        ("a.docx", package({"word/document.xml": body, "word/footnotes.xml": notes})),
        ("b.hwpx", package({"Contents/section10.xml": section.format("ten"), "Contents/section2.xml": section.format("two")})),
        ("c.docx", bytearray(b"not a zip file")),
        ("d.docx", bytearray(office.OLE_MAGIC + b"....")),
    ]


def office_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame(sample_files(), "path string, content binary")
    return office.extracted(files).select("path", "method", "text", "paragraphs", "tables", "textboxes", F.col("error").isNotNull().alias("failed"))


_P = "trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_HAS = "regexp_matches(p, '{}')".format
_PROSE = ", ".join(f"'{w}'" for w in units.PROSE)
_SKIP = f"""WITH {cte('skip_paragraphs')},
a AS (SELECT conv_id || ':' || turn AS pid, text FROM conversations UNION ALL SELECT 'f' || pid, text FROM skip_paragraphs),
b AS (SELECT pid, {_P} AS p FROM a),
c AS (SELECT *, regexp_extract_all(lower(p), '[a-zà-ž]+') AS w, length(p) <= 80 AS short, length(p) - length(regexp_replace(p, '[0-9]', '', 'g')) AS digits FROM b)
SELECT pid, CASE WHEN p = '' OR p = '[[PAGEBREAK]]' THEN 'blank' WHEN short AND {_HAS('^[0-9\\s,.–—%-]+$')} THEN 'numbers' WHEN short AND NOT {_HAS('\\p{L}')} THEN 'numbers'
 WHEN ({_HAS('^[0-9]+(\\.[0-9]+){1,3}\\s+\\S')} AND len(regexp_extract_all(p, '[0-9]+(?:\\.[0-9]+){{1,3}}')) <= 2) OR p LIKE '#%' THEN NULL
 WHEN {_HAS('(?i)^(https?://\\S+|doi:\\s*10\\.\\S+)$')} THEN 'address'
 WHEN length(p) > 180 OR len(list_filter(w, lambda x: x IN ({_PROSE}))) >= 2 OR {_HAS(units.SPEAKS)} OR {_HAS(units.KOREAN_PROSE)} THEN NULL
 WHEN short AND {_HAS('(?i)^arXiv[:.\\s]*[0-9]{4}\\.[0-9]{4,5}(v[0-9]+)?\\.?$')} THEN 'record'
 WHEN short AND {_HAS('^[0-9A-Za-z_./()-]+$')} AND digits >= greatest(6.0, length(p) * 0.5) THEN 'address'
 WHEN short AND {_HAS('(?i)^pp?\\.\\s*[0-9]+\\s*[–—-]\\s*[0-9]+')} THEN 'record'
 WHEN short AND {_HAS('(^|[^0-9A-Za-z])(1[5-9]|20)[0-9]{2}([^0-9A-Za-z]|$)')} AND len(w) <= 8 AND len(regexp_extract_all(p, '(?:^|[^A-Za-z])[A-Z][a-z]{{1,12}}\\.(?:\\s|,|$)')) >= 2 THEN 'record'
 WHEN {_HAS('(?i)(^|[^A-Za-z])journal([^A-Za-z]|$)')} AND {_HAS('(?i),\\s*no\\.\\s*[0-9]+,\\s*[0-9]+\\s*[–—-]\\s*[0-9]+\\.')} AND {_HAS('(?i)https?://')} THEN 'record'
 WHEN ({_HAS('^\\s*\\[?[0-9]+\\*?\\]?\\s+[A-Z][^.]*,\\s+[A-Z]')} OR {_HAS('^\\s*-\\s+[0-9]+\\*?\\s+[A-Z]')} OR {_HAS(units.CITED)} OR {_HAS(units.AUTHOR)})
  AND ({_HAS(units.NUMBERED)} OR {_HAS('^\\s*†\\s')}) THEN 'record' END AS reason FROM c"""
_LENGTH = r"CAST(length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) AS BIGINT)"

QUERIES = {
    "skip_reason": skip_reason,
    "unit_roles": unit_roles,
    "neighbour_context": neighbour_context,
    "paragraph_chunks": paragraph_chunks,
    "chunk_coverage": chunk_coverage,
    "translation_plan_coverage": translation_plan_coverage,
    "plan_units": plan_units,
    "paragraph_splits": paragraph_splits,
    "reading_reconcile": reading_reconcile,
    "reading_similarity": reading_similarity,
    "fuzzy_source_match": fuzzy_source_match,
    "glyph_reading_order": glyph_reading_order,
    "office_extract": office_extract,
}
ORACLES = {
    "skip_reason": _SKIP,
    "unit_roles": f"""WITH {cte('skip_paragraphs')} SELECT pid, CASE WHEN text = '[[PAGEBREAK]]' THEN 'page'
 WHEN regexp_matches(text, '^[ \\t\\n\\x0B\\f\\r]*(#{{1,6}}[ \\t\\n\\x0B\\f\\r]|[0-9]+(\\.[0-9]+){{1,3}}[ \\t\\n\\x0B\\f\\r])') THEN 'heading'
 WHEN regexp_matches(text, '^[ \\t\\n\\x0B\\f\\r]*(\\[?[0-9]{{1,3}}\\]?[ \\t\\n.,):]|†[ \\t\\n\\x0B\\f\\r]|\\[\\^[^\\]]+\\]:)') THEN 'note_candidate' ELSE 'body' END AS role FROM skip_paragraphs""",
    "neighbour_context": """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
b AS (SELECT a.conv_id, a.k, max(o.k) AS at FROM n a JOIN n o ON o.conv_id = a.conv_id AND o.k BETWEEN a.k - 8 AND a.k - 1 AND o.role = 'user'
  WHERE NOT EXISTS (SELECT 1 FROM n h WHERE h.conv_id = a.conv_id AND h.role = 'system' AND h.k > o.k AND h.k < a.k) GROUP BY ALL),
f AS (SELECT a.conv_id, a.k, min(o.k) AS at FROM n a JOIN n o ON o.conv_id = a.conv_id AND o.k BETWEEN a.k + 1 AND a.k + 8 AND o.role = 'user'
  WHERE NOT EXISTS (SELECT 1 FROM n h WHERE h.conv_id = a.conv_id AND h.role = 'system' AND h.k < o.k AND h.k > a.k) GROUP BY ALL)
SELECT n.conv_id, n.turn, right(p.text, 600) AS before, left(q.text, 600) AS after FROM n
LEFT JOIN b ON b.conv_id = n.conv_id AND b.k = n.k LEFT JOIN n p ON p.conv_id = b.conv_id AND p.k = b.at LEFT JOIN f ON f.conv_id = n.conv_id AND f.k = n.k LEFT JOIN n q ON q.conv_id = f.conv_id AND q.k = f.at""",
    "chunk_coverage": f"SELECT doc_id, {_LENGTH} AS source_chars, source_chars AS retained_chars FROM documents",
    "translation_plan_coverage": f"SELECT doc_id, {_LENGTH} AS source_chars, source_chars AS retained_chars FROM documents",
}
