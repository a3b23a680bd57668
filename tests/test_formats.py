"""Notes, packages, notations, structure and images: small cases with known answers."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.ext import providers
from quirefold.functions import names
from quirefold.operators import images, markup, structure, units
from quirefold.sources import fixtures, office


def test_front_matter_values(spark):
    notes = fixtures.frame(spark, "vault_notes").withColumn("fm", markup.front_matter(F.col("text")))
    made = notes.select("note_id", "fm.body", "fm.lines", markup.with_values(F.col("fm.lines"), {"published": F.lit("2021"), "publisher": F.lit("")}).alias("out"))
    got = {r["note_id"]: r for r in made.collect()}
    assert got[1]["body"] == "Body one" and got[1]["out"] == ['title: "River"', "source: a.pdf", 'published: "2021"', "model: x"]
    assert got[2]["out"] == ["book: b", 'published: "2021"']
    assert got[3]["lines"] is None and got[3]["body"] == "No front matter" and got[4]["lines"] is None
    assert got[5]["out"] == ["source: c", 'published: "2021"']


def test_replies_never_shift(spark):
    replies = fixtures.frame(spark, "page_replies").withColumn("wanted", F.sequence("first", "last"))
    got = {(r["call_id"], r["page"]): r["text"] for r in markup.reply_pages(replies, "call_id", "reply", "wanted").collect()}
    assert got == {(1, 3): "three", (1, 4): "", (1, 5): "five\nmore", (1, 6): "", (2, 7): "", (2, 8): "", (3, 9): "nine"}


def test_notations(spark):
    t = F.col("text")
    rows = {r["sid"]: r for r in fixtures.frame(spark, "small_strings").select(
        "sid", names.plain_superscripts(t).alias("plain"), names.page_range(t).alias("pages"), names.source_candidates(t).alias("c"), names.pdf_date(t).alias("d"),
        names.first_json(t).alias("j"), names.escaped(t).alias("e"), names.author_from_stem(t).alias("a"), names.citation_key(t).alias("k"), names.error_class(F.lit(None).cast("int"), t).alias("x"),
    ).collect()}
    assert rows[1]["plain"] == "word.39 and 10² m"
    assert rows[2]["pages"] == [5, 6, 7, 200, 201, 202, 203, 250]
    assert rows[3]["c"] == ["https://arxiv.org/pdf/2101.01234v2"] and rows[4]["c"] == ["https://doi.org/10.1234/abc"] and rows[5]["c"] == ["https://example.org/p.pdf"]
    assert rows[6]["d"] == "2021-03-09" and rows[7]["d"] == "2021-03-09" and rows[8]["d"] == "1998" and rows[13]["d"] == ""
    assert rows[9]["j"] == '{"a": 1}' and rows[8]["j"] is None
    assert rows[10]["e"] == "a&lt;b &amp; &quot;c&quot;" and rows[11]["a"] == "Jane Miller" and rows[12]["k"] == "quotedtext"
    assert [rows[i]["x"] for i in (14, 15, 16)] == ["limit", "configuration", "other"]


def test_sniffing(spark):
    files = [(1, bytearray(b"%PDF-1.7 x")), (2, bytearray(b"PK\x03\x04..")), (3, bytearray(b"\xd0\xcf\x11\xe0")), (4, bytearray(b"  <!DOCTYPE html><p>")), (5, bytearray(b"plain"))]
    got = {r["i"]: r["k"] for r in spark.createDataFrame(files, "i int, c binary").select("i", names.sniffed(F.col("c")).alias("k")).collect()}
    assert got == {1: "pdf", 2: "zip", 3: "office", 4: "html", 5: "text"}


def test_packages_open_again(spark):
    books = {r["book"]: bytes(r["content"]) for r in markup.epub_packages(fixtures.frame(spark, "chapters")).collect()}
    again = {r["book"]: bytes(r["content"]) for r in markup.epub_packages(fixtures.frame(spark, "chapters")).collect()}
    assert books == again
    with zipfile.ZipFile(io.BytesIO(books["a"])) as z:
        assert z.namelist()[0] == "mimetype" and z.read("mimetype") == b"application/epub+zip"
        assert b"The Bridge" in z.read("OEBPS/nav.xhtml") and b"<p>rrr" in z.read("OEBPS/c001.xhtml")
    note = spark.createDataFrame([(1, "# Head\n\nA line & more\n- item\n> said\n| a | b |\n|---|---|\n#tag #two")], "id int, text string")
    blocks = markup.markdown_blocks(note, "id", "text")
    assert [r["kind"] for r in blocks.orderBy("pos").collect()] == ["heading", "text", "bullet", "quote", "table", "tags"]
    content = bytes(markup.docx_packages(blocks, "id").first()["content"])
    assert office.extract("a.docx", content)[2] == "Head\nA line & more\nitem\nsaid\n| a | b |\n#tag #two"


def test_contents_and_scan_pages(spark):
    got = {}
    for r in structure.contents_pages(fixtures.frame(spark, "contents"), "book").collect():
        got.setdefault(r["book"], []).append(r["page"])
    assert sorted(got["a"]) == [1, 2, 3] and sorted(got["b"]) == [1, 3] and "c" not in got
    scan = {}
    for r in structure.scan_pages(fixtures.frame(spark, "contents"), "book").collect():
        scan.setdefault(r["book"], []).append(r["page"])
    assert sorted(scan["c"]) == [*range(18), 18, 19, 24, 25]


def test_titles_are_found_behind_each_other():
    body = "Contents\nThe Mill\nThe River\n" + "x" * 2000 + "\nThe Mil1\n" + "y" * 2000 + "\nThe Rivcr\nend"
    found = structure.locate_titles(body, ["The Mill", "The River", "Never there"])
    assert [t for _, t in found] == ["The Mill", "The River"]
    assert body[found[0][0] :].startswith("The Mil1") and body[found[1][0] :].startswith("The Rivcr")


def test_inline_notes_keep_characters():
    line = "The text goes on. 8 A note on it. 9 Another note.10 A third one."
    parts = structure.inline_notes(line)
    assert parts == ["The text goes on.", "8 A note on it.", "9 Another note.", "10 A third one."]
    for other in ("Built in 1999 and 2000, it said.11 More text.", "numbers 3 and 4 without an end", "plain."):
        assert structure.inline_notes(other) == [other]


def test_chains_and_headers(spark):
    row = spark.createDataFrame([([1, 2, 9, 3, 1, 2],), ([3, 4],), ([2, 3, 4],)], "n array<int>").select(structure.rising_chain(F.col("n")).alias("c")).collect()
    assert [r["c"] for r in row] == [[0, 1, 3, 4, 5], [], [0, 1, 2]]
    lines = ["12 The Old Mill by the River", "Body line", "more", "13"]
    assert structure.without_headers(lines, ["The Old Mill by the River"]) == ["Body line", "more"]
    assert structure.without_headers(["The 0ld Mill by the River", "x"], ["The Old Mill by the River"]) == ["x"]
    assert structure.without_headers(["The Old Mill and then text"], ["The Old Mill"]) == ["and then text"]
    pages = spark.createDataFrame([("a", 0, "Head Line Here\nbody"), ("b", 0, "Head Line Here\nbody")], "book string, page long, text string")
    got = {r["book"]: r["text"] for r in structure.strip_headers(pages, spark.createDataFrame([("a", "Head Line Here")], "book string, header string")).collect()}
    assert got == {"a": "body", "b": "Head Line Here\nbody"}


def test_regions_and_layouts(spark):
    df = spark.createDataFrame([("a note of some words", ["x a note of  some words y"], ["body"]), ("a note of some words", ["a note of some words"], ["a note of some words"]), ("short", ["short"], [])], "t string, n array<string>, b array<string>")
    assert [r[0] for r in df.select(structure.region_role(F.col("t"), F.col("n"), F.col("b"))).collect()] == ["footnote", None, None]
    texts = spark.createDataFrame([("a", "text")], "stem string, text string")
    layouts = texts.select("stem", F.sha2("text", 256).alias("text_sha256"), F.lit(1).alias("v")).unionByName(texts.select("stem", F.lit("old").alias("text_sha256"), F.lit(2).alias("v")))
    assert [r["v"] for r in structure.fresh_layouts(texts, layouts).collect()] == [1]


def test_deferred_notes_follow_the_sentence():
    assert units.joined_over_notes(["Half a", "1. A note.", "sentence.", "Next."]) == ["Half a sentence.", "1. A note.", "Next."]
    parts = ["One.", "Two", "three.", "2) note", "four"]
    assert units.joined_over_notes(parts) == ["One.", "Two three. four", "2) note"]  # a small letter goes on


def test_underlines_go_and_letters_stay(spark):
    page = np.full((120, 200), 240, np.uint8)
    page[0, 0] = 30  # a third grey level, so that the threshold lies above the ink
    for row in range(3):
        for col in range(8):
            page[10 + 36 * row : 24 + 36 * row, 10 + 20 * col : 20 + 20 * col] = 20
    clean, erased, height = images.without_underlines(page)
    assert erased == 0 and height == 14 and (clean == page).all()
    marked = page.copy()
    marked[30:32, 10:180] = 20
    clean, erased, _ = images.without_underlines(marked)
    assert erased == 2 * 170 and (clean[10:24] == page[10:24]).all()
    row = images.cleaned(spark.createDataFrame([(1, 200, bytearray(marked.tobytes()))], "page long, width int, content binary")).first()
    assert row["erased"] == 340


def test_failover_rests_only_on_limits():
    now = [0.0]
    calls = []

    def limited(system, prompt):
        calls.append("a")
        raise RuntimeError("429 rate limit")

    both = providers.Failover({"a": limited, "b": providers.echo}, clock=lambda: now[0])
    assert both("", "x") == ("b", "«x»") and both("", "y") == ("b", "«y»") and calls == ["a"]
    now[0] = 3601
    both("", "z")
    assert calls == ["a", "a"]

    def broken(system, prompt):
        raise RuntimeError("bad model")

    with pytest.raises(RuntimeError, match="bad model"):
        providers.Failover({"a": broken, "b": providers.echo})("", "x")


def test_providers_over_frames(spark):
    units = spark.createDataFrame([("k1", "text"), ("k2", "")], "key string, src string")
    got = {r["key"]: (r["tgt"], r["status"]) for r in providers.completed(units, valid=lambda s, r: len(r) > 2).collect()}
    assert got == {"k1": ("«text»", "translated"), "k2": ("", "failed")}
    pages = spark.createDataFrame([(i, bytearray(b"x")) for i in range(10)], "page long, content binary").coalesce(1)
    assert sorted(len(r["pages"]) for r in providers.read_pages(pages, lambda c: str(len(c)), 4).collect()) == [2, 4, 4]
    files = spark.createDataFrame([("a.pdf", bytearray(b"x"))], "path string, content binary")
    glyph = lambda ch: lambda: [(ch, 0.0, 1.0, 5.0)]
    got = providers.decoded(files, lambda c: [glyph("r"), lambda: None, glyph("s"), lambda: 1 / 0]).collect()
    assert [(r["page"], r["ch"], r["skipped"]) for r in got] == [(0, "r", None), (2, "s", None), (3, None, "division by zero")]
    (bad,) = providers.decoded(files, lambda c: 1 / 0).collect()
    assert (bad["page"], bad["skipped"]) == (-1, "division by zero")
