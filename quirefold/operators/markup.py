"""Notes, bilingual files, front matter, exports: text formats to rows and back."""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.names import escaped
from quirefold.functions.text import compact, strip

SEPARATOR = "\n\n---\n\n"
PAGE_MARK = r"<<<PAGE ([0-9]+)>>>"

# ---- front matter ---------------------------------------------------------------------------------------------------


def front_matter(text: Column) -> Column:
    """struct<lines, body>: the lines between the opening and closing dashes, null without such a block."""
    found = text.rlike(r"(?s)^---\n.*?\n---(\n|$)")
    inner = F.regexp_extract(text, r"(?s)^---\n(.*?)\n---(?:\n|$)", 1)
    body = F.regexp_replace(F.regexp_replace(text, r"(?s)\A---\n.*?\n---(?:\n|$)", ""), r"\A\n+", "")
    return F.struct(F.when(found, F.split(inner, "\n")).alias("lines"), F.when(found, body).otherwise(text).alias("body"))


def value_of(lines: Column, key: str) -> Column:
    """The value of the first line ``key: value``; '' without one."""
    mine = F.filter(lines, lambda x: x.startswith(f"{key}:"))
    raw = strip(F.regexp_replace(F.get(mine, F.lit(0)), f"^{re.escape(key)}:", ""))
    return F.coalesce(F.regexp_replace(raw, '^"|"$', ""), F.lit(""))


def with_values(lines: Column, values: dict[str, Column], before: tuple[str, ...] = ("model", "generated", "mode", "author", "refined")) -> Column:
    """``lines`` with the given values: a line of that key is replaced, a new one stands before the first of ``before``.

    Empty values change nothing.
    """
    out = lines
    for key, value in values.items():
        filled = F.coalesce(value, F.lit("")) != ""
        line = F.concat(F.lit(f'{key}: "'), value, F.lit('"'))
        replaced = F.transform(out, _replacer(key, line))
        has = F.exists(out, _starts(key))
        anchors = F.transform(out, _any_of(before))
        at = F.array_position(anchors, True)
        place = F.when(at > 0, at).otherwise(F.size(out) + 1).cast("int")
        inserted = F.concat(F.slice(out, F.lit(1), place - 1), F.array(line), F.slice(out, place, F.greatest(F.size(out) - place + 1, F.lit(0))))
        out = F.when(~filled, out).when(has, replaced).otherwise(inserted)
    return out


def _starts(key: str):
    return lambda x: x.startswith(f"{key}:")


def _replacer(key: str, line: Column):
    return lambda x: F.when(x.startswith(f"{key}:"), line).otherwise(x)


def _any_of(keys: tuple[str, ...]):
    return lambda x: x.rlike("^(" + "|".join(keys) + "):")


# ---- bilingual files ------------------------------------------------------------------------------------------------


def bilingual_blocks(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, src, tgt): blocks in the tagged form, the plain form (source, blank line, target) and source alone."""
    blocks = files.select(key, F.posexplode(F.split(F.col(text), SEPARATOR, -1)).alias("pos", "raw")).withColumn("b", strip(F.col("raw"))).where("b != ''")
    tagged = F.contains(F.col("b"), F.lit("\n\n[KO]\n"))
    plain = ~F.col("b").startswith("[") & F.contains(F.col("b"), F.lit("\n\n"))
    head = lambda mark: strip(F.regexp_replace(F.split_part("b", F.lit(mark), F.lit(1)), r"^\[EN\]\n", ""))
    rest = lambda mark: strip(F.substring(F.col("b"), F.position(F.lit(mark), F.col("b")) + len(mark), F.length("b")))
    src = F.when(tagged, head("\n\n[KO]\n")).when(plain, head("\n\n")).when(F.col("b").startswith("[EN]\n"), strip(F.regexp_replace("b", r"^\[EN\]\n", "")))
    tgt = F.when(tagged, rest("\n\n[KO]\n")).when(plain, rest("\n\n")).otherwise("")
    return blocks.select(key, "pos", src.alias("src"), tgt.alias("tgt")).where(F.col("src").isNotNull())


def best_alternate(blocks: DataFrame, stem: str, path: str) -> DataFrame:
    """(stem, path, n): the file of a stem with the most translated blocks, if it has any."""
    counted = blocks.where("tgt != ''").groupBy(stem, path).agg(F.count("*").alias("n"))
    return counted.groupBy(stem).agg(F.max_by(path, F.struct("n", path)).alias(path), F.max("n").alias("n"))


def first_writer_cache(blocks: DataFrame, rank: str) -> DataFrame:
    """(src, tgt): over several places, the first one that translates a source wins."""
    return blocks.where("tgt != ''").groupBy("src").agg(F.min_by("tgt", rank).alias("tgt"))


def merged_text(chapters: DataFrame, book: str, prefer: str | None = None) -> DataFrame:
    """(book, text): chapter bodies in order, translations where there are any. A book is one text by definition."""
    body = F.coalesce(F.nullif(F.col(prefer), F.lit("")), F.col("body")) if prefer else F.col("body")
    parts = chapters.groupBy(book).agg(F.array_sort(F.collect_list(F.struct("n", body.alias("b")))).alias("p"))
    return parts.select(book, F.array_join(F.transform("p", lambda x: x["b"]), "\n\n").alias("text"))


# ---- replies of page readers ----------------------------------------------------------------------------------------


def reply_pages(replies: DataFrame, key: str, reply: str, wanted: str) -> DataFrame:
    """(key, page, text) for every wanted page: what stands behind its mark. A page that is missing is empty, never shifted."""
    marked = replies.select(key, F.explode(wanted).alias("page"), F.concat(F.lit("\n"), F.col(reply)).alias("r"))
    pieces = F.split("r", r"\n(?=<<<PAGE [0-9]+>>>)")
    mine = F.filter(pieces, lambda x: F.regexp_extract(x, f"^{PAGE_MARK}", 1) == F.col("page").cast("string"))
    return marked.select(key, "page", F.coalesce(strip(F.regexp_replace(F.get(mine, F.lit(0)), f"^{PAGE_MARK}", "")), F.lit("")).alias("text"))


# ---- Markdown to blocks and to packages -------------------------------------------------------------------------------


def line_kind(line: Column) -> Column:
    """heading, table, rule, quote, bullet, tags, blank or text."""
    s = strip(line)
    return (
        F.when(s == "", "blank")
        .when(s.rlike("^#{1,6} "), "heading")
        .when(s.rlike(r"^\|?[ :|-]*-{3,}[ :|-]*$") & s.contains("|"), "rule")
        .when(s.startswith("|"), "table")
        .when(s.startswith(">"), "quote")
        .when(s.rlike(r"^([-*+]|[0-9]+\.) "), "bullet")
        .when(s.rlike(r"^(#[^\s#]+\s*)+$"), "tags")
        .otherwise("text")
    )


def markdown_blocks(notes: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, level, content): the lines of a note, typed; input of any document writer."""
    lines = notes.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("pos", "line")).withColumn("kind", line_kind(F.col("line")))
    level = F.length(F.regexp_extract("line", r"^\s*(#{1,6}) ", 1))
    content = F.when(F.col("kind") == "heading", strip(F.regexp_replace("line", r"^\s*#{1,6} ", ""))).when(
        F.col("kind").isin("quote", "bullet"), strip(F.regexp_replace("line", r"^\s*(>|[-*+]|[0-9]+\.)\s*", ""))
    ).otherwise(strip(F.col("line")))
    return lines.where("kind not in ('blank', 'rule')").select(key, "pos", "kind", level.alias("level"), content.alias("content"))


def xhtml_body(text: Column) -> Column:
    """Paragraphs at blank lines as <p>, escaped, with links from note marks to their asides."""
    paragraphs = F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: compact(p) != "")
    made = F.transform(paragraphs, lambda p: F.concat(F.lit("<p>"), F.replace(escaped(strip(p)), F.lit("\n"), F.lit("<br/>")), F.lit("</p>")))
    joined = F.array_join(made, "\n")
    return F.regexp_replace(joined, r"\[\^([0-9A-Za-z-]+)\]", '<a epub:type="noteref" href="#fn$1" id="ref$1">$1</a>')


def note_aside(identifier: Column, body: Column) -> Column:
    return F.concat(F.lit('<aside epub:type="footnote" id="fn'), identifier, F.lit('"><p>'), escaped(body), F.lit("</p></aside>"))


def navigation(chapters: DataFrame, book: str) -> DataFrame:
    """(book, n, title, previous, next): neighbours of each chapter for its links."""
    w = Window.partitionBy(book).orderBy("n")
    return chapters.select(book, "n", "title", F.lag("title").over(w).alias("previous"), F.lead("title").over(w).alias("next"))


def chapter_note(title: Column, summary: Column, previous: Column, following: Column) -> Column:
    """Markdown of one chapter note: heading, summary, and a links line of what there is."""
    link = lambda label, t: F.when(t.isNotNull(), F.concat(F.lit(f"{label}: [["), t, F.lit("]]")))
    links = F.concat_ws(" · ", link("Previous", previous), link("Next", following))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), summary, F.nullif(links, F.lit("")))


_CONTAINER = """<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles>
<rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>"""


def epub_bytes(book: str, chapters: list[tuple[int, str, str]]) -> bytes:
    """A small EPUB 3 package of (n, title, XHTML body); equal input gives equal bytes."""
    identifier = uuid.uuid5(uuid.NAMESPACE_URL, f"urn:book:{book}")
    plain = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    names = [f"c{n:03d}.xhtml" for n, _, _ in chapters]
    page = '<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{0}</title></head><body>{1}</body></html>'
    items = "".join(f'<item id="{n[:-6]}" href="{n}" media-type="application/xhtml+xml"/>' for n in names)
    spine = "".join(f'<itemref idref="{n[:-6]}"/>' for n in names)
    opf = (
        '<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
        f'<dc:identifier id="id">urn:uuid:{identifier}</dc:identifier><dc:title>{plain(book)}</dc:title><dc:language>und</dc:language></metadata>'
        f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>'
    )
    nav = page.format("Contents", '<nav epub:type="toc"><ol>' + "".join(f'<li><a href="{n}">{plain(t)}</a></li>' for n, (_, t, _) in zip(names, chapters)) + "</ol></nav>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        put = lambda name, data, how=zipfile.ZIP_DEFLATED: z.writestr(zipfile.ZipInfo(name), data, how)
        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", _CONTAINER)
        put("OEBPS/content.opf", opf)
        put("OEBPS/nav.xhtml", nav)
        for name, (_, title, body) in zip(names, chapters):
            put(f"OEBPS/{name}", page.format(plain(title), f"<h1>{plain(title)}</h1>{body}"))
    return out.getvalue()


def epub_packages(chapters: DataFrame) -> DataFrame:
    """(book, content): one package per book; chapters: (book, n, title, body). A package is one file, so a group is a book."""
    bodies = chapters.select("book", "n", "title", xhtml_body(F.col("body")).alias("body"))

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("n")[["n", "title", "body"]].itertuples(index=False, name=None)
        return pd.DataFrame({"book": [key[0]], "content": [epub_bytes(key[0], list(rows))]})

    return bodies.groupBy("book").applyInPandas(run, "book string, content binary")


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx_bytes(blocks: list[tuple[str, int, str]]) -> bytes:
    """A DOCX package of (kind, level, content) blocks."""
    plain = lambda t: t.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def paragraph(kind: str, level: int, content: str) -> str:
        style = f"Heading{level}" if kind == "heading" else {"quote": "Quote", "bullet": "ListBullet"}.get(kind)
        mark = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        return f'<w:p>{mark}<w:r><w:t xml:space="preserve">{plain(content)}</w:t></w:r></w:p>'

    body = "".join(paragraph(*b) for b in blocks)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        put = lambda name, data: z.writestr(zipfile.ZipInfo(name), data)
        put("[Content_Types].xml", '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        put("_rels/.rels", '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        put("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def docx_packages(blocks: DataFrame, key: str) -> DataFrame:
    """(key, content) from markdown_blocks; a group is one note."""

    def run(k: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("pos")[["kind", "level", "content"]].itertuples(index=False, name=None)
        return pd.DataFrame({key: [k[0]], "content": [docx_bytes(list(rows))]})

    kind = blocks.schema[key].dataType.simpleString()
    return blocks.groupBy(key).applyInPandas(run, f"{key} {kind}, content binary")


# ---- logs -----------------------------------------------------------------------------------------------------------


def recent_errors(log: DataFrame, order: str, line: str, most: int = 5) -> DataFrame:
    """The last ``most`` lines that tell of an error, newest first; retries and notices that quote one don't count."""
    bad = F.col(line).rlike(r"(?i)error|exception|traceback|failed|오류|실패") & ~F.col(line).rlike(r"(?i)retry|0 errors|no error")
    return log.where(bad).orderBy(F.col(order).desc()).limit(most)


def lines_of_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Split whole files into lines inside a task; CRLF line ends are kept as they are."""
    for batch in batches:
        rows = [(p, i, x) for p, t in zip(batch["path"], batch["text"]) for i, x in enumerate(re.split(r"(?<=\n)", t or "")) if x]
        yield pd.DataFrame(rows, columns=["path", "pos", "line"])
