"""Small inline tables for operators whose subject the shared tables do not hold. All texts are invented."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_KO = "우리는 그 길을 걸을 수 있다고 말한 뒤 한 권의 책을 다시 읽고 또 긴 글을 쓴다 "
_KO_LOST = "우리는 그길을 걸을 있다고 말하고 오래된 책을 다시 읽으며 조용히 글을 쓴다 "

TABLES: dict[str, tuple[str, list[tuple]]] = {
    "workspace_files": (
        "folder STRING, path STRING, name STRING, size INT",
        [
            ("a", "a/01_Mill.txt", "01_Mill.txt", 90), ("a", "a/01_Mill_ko.txt", "01_Mill_ko.txt", 80), ("a", "a/02_River_wiki.md", "02_River_wiki.md", 5),
            ("a", "a/02_River_wiki.json", "02_River_wiki.json", 7), ("a", "a/10_Old.txt", "10_Old.txt", 10), ("a", "a/notes.txt", "notes.txt", 30),
            ("b", "b/01_One_wiki.json", "01_One_wiki.json", 4), ("b", "b/01_One.txt", "01_One.txt", 60), ("b", "b/xx_One.txt", "xx_One.txt", 61),
            ("v", "v/deep/.obsidian/app.json", "app.json", 1), ("v", "v/deep/copy.md", "copy.md", 2), ("v", "v/deep/more/copy.md", "copy.md", 2),
            ("v", "v/note.md", "note.md", 3), ("v", "v/_log/x.md", "x.md", 3), ("v", "top.md", "top.md", 3), ("v", "v/.trash/y.md", "y.md", 3),
        ],
    ),
    "written_files": (
        "book STRING, name STRING, body STRING",
        [
            ("a", "01_Mill.txt", "the mill"), ("a", "01_Mill_ko.txt", "물레"), ("a", "01_Mill_ko_wiki.md", "note"), ("a", "02_River.txt", "old river"),
            ("a", "02_River_bilingual.md", "both"), ("a", "09_Gone.txt", "gone"), ("b", "01_Mill.txt", "kept"), ("b", "01_Mill_clean.txt", "kept"),
        ],
    ),
    "split_chapters": (
        "book STRING, n INT, title STRING, body STRING, source STRING",
        [("a", 1, "Mill", "the mill", "the mill new river"), ("a", 2, "River", "new river", "the mill new river"), ("b", 1, "Mill", "kept", "kept and very much more text")],
    ),
    "unit_replies": (
        "uid INT, src STRING, tgt STRING",
        [
            (1, "The mill stands by the river.", "물레방앗간이 강가에 서 있다."), (2, "The mill stands by the river.", "The mill stands by the river."),
            (3, "The mill.", ""), (4, "The mill.", "Please provide the text to translate."), (5, "See https://example.org/a/very/long/address now", "지금 https://example.org/a/very/long/address 보라"),
            (6, "7.3.1 Maya.", "7.3.1 마야(Maya)."), (7, "12, 3.", "12, 3."), (8, "", "없음 그 자체"), (9, "Old river", "원문을 제공해 주세요"), (10, "강가의 물레", None),
        ],
    ),
    "header_paragraphs": (
        "pid INT, title STRING, text STRING",
        [
            (1, "06_Legal Reasoning", "134 Chapter 6"), (2, "06_Legal Reasoning", "134 Chapter 6 reasoning goes on here"), (3, "06_Legal Reasoning", "135 Legal Reasoning"),
            (4, "06_Legal Reasoning", "Legal/Reasoning 136"), (5, "06_Legal Reasoning", "1 Introduction 1"), (6, "06_Legal Reasoning", "Chapter 1"), (7, "x", "Notes 185"),
            (8, "x", "Notes 185 References 199 Index 225"), (9, "x", "Figure 4"), (10, "x", ""), (11, "", "7 words of the text and no title"), (12, None, "210 Index"),
        ],
    ),
    "note_lines": (
        "lid INT, line STRING",
        [
            (1, "## 핵심 인용"), (2, "### Key Quotes and more"), (3, "Key Quotes"), (4, "# 主要内容"), (5, "#### Schlüsselbegriffe"), (6, "##### deep"), (7, "2) The Mill :"), (8, "## Other"),
        ],
    ),
    "lang_samples": (
        "sample_id INT, text STRING",
        [
            (1, "The river that runs by the old mill is not as wide as it was, and the people of the town have not been at the bridge for a year."),
            (2, "Der Fluss, der an der alten Mühle vorbei fließt, ist nicht so breit wie früher, und die Leute aus dem Dorf sind auch nicht mehr auf der Brücke."),
            (3, "La rivière qui passe près du moulin n'est pas aussi large, et les gens du village ne sont plus sur le pont avec des paniers dans la brume."),
            (4, "El río que pasa por el molino no es tan ancho como antes, y la gente del pueblo no se ve en el puente con los niños por la mañana."),
            (5, "Il fiume che passa per il mulino non è più come una volta, e la gente del paese non si vede con gli amici sul ponte di pietra."),
            (6, "De rivier die langs de oude molen loopt is niet meer zo breed, en de mensen van het dorp zijn ook niet met een mand op de brug."),
            (7, "강을 따라 걷던 사람들은 오래된 다리를 건너 마을로 돌아왔다 (vgl. Brücke und Mühle, S. 12)."),
            (8, "川のそばの古い水車はもうまわっていません。村の人たちは橋のうえであさのひかりを見ています。"),
            (9, "河边的旧磨坊已经不再转动，村里的人们在桥上看着早晨的光。"),
            (10, "Река течёт мимо старой мельницы, и люди из деревни стоят на мосту."),
            (11, "Ο ποταμός περνά δίπλα από τον παλιό μύλο."),
            (12, "short words only"),
            (13, ""),
            (14, "  \n "),
            (15, "12 + 30 = 42 !!"),
            (16, "Et flumen non est latum ut erat, sed ad pontem sunt homines qui cum sole in aqua ambulant, et hoc est quod per annos erat."),
            (17, "O rio que passa por um moinho não é mais largo como era, e os homens da aldeia não se veem na ponte com uma cesta."),
        ],
    ),
    "ko_quality": (
        "doc_id INT, text STRING",
        [
            (1, _KO * 60),
            (2, _KO_LOST * 90),
            (3, (_KO + "기合 디지!털 ■ ") * 60),
            (4, "A plain English page with no Hangul in it at all."),
            (5, ""),
            (6, (_KO + "學問 道理 ") * 60),
            (7, (_KO * 6 + "기合 ") * 20),
        ],
    ),
    "line_breaks": (
        "doc_id INT, text STRING",
        [
            (1, "the first printed line of a page that is cut at a fixed wi\ndth so that words break, and the second line goes on a bit\nlonger than one would think.\nA short end.\nThen a new paragraph starts here and it fills the whole li\nne again, as printed lines do, until it comes to an end so"),
            (2, "only one line"),
            (3, ""),
            (4, "same length line a\nsame length line b\n\nsame length line, \nsame length line d"),
        ],
    ),
    "note_numbers": (
        "doc_id INT, page INT, num INT",
        [(1, 0, 1), (1, 0, 2), (1, 1, 3), (1, 1, 4), (1, 2, 6), (1, 3, 7), (1, 3, 11), (2, 0, 1), (2, 1, 2), (2, 2, 1), (2, 2, 2), (2, 3, 30), (2, 6, 33), (3, 0, 5)],
    ),
    "skip_paragraphs": (
        "pid INT, text STRING",
        [
            (1, ""),
            (2, "  [[PAGEBREAK]] "),
            (3, "3,000 4,000 5,000"),
            (4, "7 20 < 1 11 4 17"),
            (5, "3.4.2 The River and the Mill"),
            (6, "# A heading line"),
            (7, "https://example.org/a/b?c=1"),
            (8, "doi: 10.1234/abc.5678"),
            (9, "This is the sentence that one reads because it is prose."),
            (10, "arXiv:2301.01234v2"),
            (11, "0012345X.2024.1234567"),
            (12, "pp. 12-19, Mill Press"),
            (13, "River. Stud. 2021, 12"),
            (14, "River Journal, vol. 3, no. 2, 11-19. https://example.org/x"),
            (15, "[12] Miller, A. The Old Bridge (1999), p. 44"),
            (16, "12. See above for the reason given there"),
            (17, "A few words"),
            (18, "† Miller, B. ibid"),
            (19, "1.1 One 2 1.2 Two 5 1.3 Three 9"),
            (20, "그러나 강은 넓다"),
            (21, "x " * 100),
        ],
    ),
    "headings": (
        "book STRING, chapter INT, pos INT, line STRING",
        [
            ("a", 1, 0, "Introduction"), ("a", 1, 1, "text"), ("a", 1, 9, "References"), ("a", 2, 0, "1. Introduction"), ("a", 2, 5, "Conclusion"),
            ("a", 3, 0, "INTRODUCTION"), ("a", 3, 7, "Bibliography"), ("b", 1, 0, "Preface"), ("b", 1, 4, "A long line that is no heading at all"), ("b", 2, 3, "Index"),
            ("c", 1, 0, "Abstract"), ("c", 2, 0, "Introduction"), ("c", 3, 2, "notes"),
        ],
    ),
    "chapters": (
        "book STRING, n INT, title STRING, body STRING",
        [
            ("a", 1, "The River", "r" * 900), ("a", 2, "The Mill", "m" * 1000), ("a", 3, "3", "b" * 1100), ("a", 4, "The Bridge", "x" * 3600), ("a", 5, "End", "e" * 120),
            ("b", 1, "One", "o" * 500), ("b", 2, "Two", "t" * 500 + " The River " + "t" * 100), ("b", 3, "The River", "z" * 520), ("c", 1, "Whole", "w" * 8000),
        ],
    ),
    "titles": (
        "title_id INT, title STRING, ordinal INT",
        [
            (1, "Rivers: a \"short\" history", 1), (2, "1. 1. The Mill", 1), (3, "IV. The Bridge", 4), (4, "7. Study five", 4), (5, "3", 3), (6, "2 Two roads", 2),
            (7, "a/b\\c|d?e", 9), (8, "강과 다리 " * 40, 2), (9, "", 1), (10, "XII) Last", 12), (11, "co-evolution", 1), (12, "  ..  ", 1),
        ],
    ),
    "roman": ("numeral STRING", [("I",), ("IV",), ("ix",), ("XIV",), ("MCMXCIV",), ("xl",), ("",), ("IZ",)]),
    "bibliographic": (
        "note_id INT, name STRING, published STRING, publisher STRING, text STRING",
        [
            (1, "2101.01234 rivers", "", "", "Abstract\nPublished: 2021-3-9\nPublisher: Mill Press ISBN 1"),
            (2, "202004 bridge", "", "", "no date in the text"),
            (3, "The 1987 flood", "1990", "", "Copyright 1988 by the town\nPublished by: 12345"),
            (4, "untitled", "", "", "(c) 2003 Someone\nPublisher: The River Society"),
            (5, "2015 notes", "", "Old House", "발행일: 2014년 5월 2일\n출판사: 물레방아"),
            (6, "none", "", "", ""),
            (7, "12101.01234", "", "", "Publication date 1999/12"),
        ],
    ),
    "html_links": (
        "page_id INT, base STRING, html STRING",
        [
            (1, "http://example.org/a/", '<head><meta name="citation_pdf_url" content="http://example.org/x.pdf?a=1&amp;b=2"></head>'),
            (2, "http://example.org/a/", "<meta content='/files/y.pdf' name='citation_pdf_url'>"),
            (3, "http://example.org/a/b.html", '<a class="q" href="../z.PDF">get</a>'),
            (4, "http://example.org/", "<p>nothing here</p>"),
            (5, "http://example.org/p", '<a href="one.html">x</a><a href="paper.pdf?dl=1&amp;k=2">y</a>'),
        ],
    ),
    "printed_numbers": (
        "book STRING, page INT, num INT",
        [("a", p, n) for p, ns in [(0, [1900]), (9, [3, 7]), (10, [4]), (11, [5, 12]), (12, [6]), (13, [7]), (14, [8])] for n in ns] + [("b", 1, 1), ("b", 2, 9), ("b", 3, 4)],
    ),
    "footnote_pages": (
        "doc_id INT, page INT, text STRING",
        [
            (1, 0, "The mill stood by the river.39 Nobody knew why.\nIt was old.\n39 See the town book of that year."),
            (1, 1, "In chapter 3 we saw the bridge.40 And so on.\n40 Built of stone and wood."),
            (1, 2, "A page without notes.\n110 Running Head"),
            (1, 3, "Words of a page.41\nmore words"),
            (1, 4, "41 The note stands on the next page."),
            (2, 0, "No reference here.\n7 A lone line that ends in a stop."),
            (3, 0, "물레는 물가에 섰다.58 방앗\n58 마을의 책에 적힌 이야기, 71-73."),
            (3, 1, "간은 오래 되었다.\n59 같은 책, 같은 저자, 80."),
            (3, 2, "끝이다."),
            (4, 0, "One wheel.1 Two wheels.1\n1 The first of two notes."),
            (4, 1, "More words.\n1 The second of two notes."),
            (4, 2, "Far.9\n30 Mill, 3, 7, 9, 12, 14, 20-22, 31, 40, 41, 44, 50."),
        ],
    ),
    "keyword_notes": (
        "path STRING, pos INT, line STRING",
        [
            ("n1.md", 0, "## Keywords"), ("n1.md", 1, "#river — a stream of water, river(Flumen) and banks"), ("n1.md", 2, "#mill — the mill(Mola) grinds"), ("n1.md", 3, "## Text"), ("n1.md", 4, "#river — not here (Nothing)"),
            ("n2.md", 0, "intro"), ("n2.md", 1, "## Keywords"), ("n2.md", 2, "#river — old river(flumen)"), ("n2.md", 3, "#mill — a mill(mola)"), ("n2.md", 4, "#bridge — the bridge(Pons)"), ("n2.md", 5, "no keyword line"),
            ("n3.md", 0, "## Keywords"), ("n3.md", 1, "#river — wide river(flu-men)"), ("n3.md", 2, "#mill — wind mill(Artificial Mill)"), ("n3.md", 3, "#bridge — long bridge(AM)"), ("n3.md", 4, "#bridge — other bridge(Artificial Mill)"), ("n3.md", 5, "#road — path(Via)"),
        ],
    ),
    "page_readings": (
        "page INT, base STRING, read_a STRING, read_b STRING, judge STRING",
        [
            (1, "the mill by the river is old and grey and nobody lives in it any more today", "the mill by the river is old and grey and nobody lives in it any more today", "the mill by the river is old and grey and nobody lives in it any more today", ""),
            (2, "the bridge was built of stone and wood by the people of the town in one summer", "the bridge was built of stone and wood by the people of the town in one winter", "the bridge was built of stone and wood by the people of the town in one summer", "town in one summer"),
            (3, "a road leads up the hill from the bridge and ends at a small chapel with a bell", "", "a road leads up the hill", ""),
            (4, "the fields behind the chapel are sown with wheat and oats in the month of april", "something else entirely, words that stand on no page of this book whatsoever, none", "x", ""),
            (5, "tiny", "tiny page", "tiny page", ""),
            (6, "", "", "", ""),
            (7, "a long page about weirs and locks and how boats are led through them day by day, with all names", "a long page about weirs", "a long page", ""),
        ],
    ),
    "glyphs": (
        "page INT, idx INT, ch STRING, x0 DOUBLE, y DOUBLE, x1 DOUBLE",
        [(0, i, ch, x, y, x + 5.0) for i, (ch, x, y) in enumerate([(c, 10.0 + 6 * k, 10.0 + (0.4 if k == 2 else 0)) for k, c in enumerate("river")] + [(c, 50.0 + 6 * k, 10.0) for k, c in enumerate("bank")] + [(c, 10.0 + 6 * k, 24.0) for k, c in enumerate("mill")])],
    ),
    "stems": (
        "stem STRING, source STRING",
        [("01_The old mill", "note"), ("the old mill.txt", "file"), ("river and bridges", "note"), ("river and bridge.pdf", "file"), ("unknown thing", "note"), ("chapel bells.txt", "file")],
    ),
    "text_rows": (
        "page INT, y DOUBLE",
        [(1, y) for y in [20.0, 80.0, 92.0, 104.0, 116.0, 180.0, 205.0, 230.0, 255.0, 280.0, 305.0]] + [(2, 50.0 + 25.0 * i) for i in range(12)] + [(3, y) for y in [500.0, 510.0, 520.0, 560.0, 600.0, 640.0, 680.0]],
    ),
    "bookmarks": (
        "stem STRING, level INT, title STRING, page INT",
        [("a", 1, "One", 3), ("a", 2, "Sub", 4), ("a", 1, "Two", 9), ("a", 1, "Three", 15), ("b", 1, "Only", 1), ("b", 2, "X", 2), ("c", 2, "P", 1), ("c", 2, "Q", 5), ("c", 3, "R", 6), ("c", 2, "S", 9)],
    ),
    "translated": (
        "n INT, text STRING",
        [(1, "그는 방앗간(mill)에서 큰 강(the river)을 보았다. 다리(Pons )"), (2, "물방아(mill)와 다리(bridge)"), (3, "no pair here (alone)")],
    ),
    "catalogue_replies": (
        "rid INT, kind STRING, reply STRING",
        [
            (1, "work", '{"message": {"title": ["The  Old Mill"], "author": [{"given": "Jane", "family": "Miller"}, {"family": "Bridge"}], "issued": {"date-parts": [[2021, 3]]}, "publisher": " Mill Press "}}'),
            (2, "work", '{"message": {}}'),
            (3, "work", "not json"),
            (4, "feed", '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A\n  River</title><author><name>J. Miller</name></author><author><name>B. Ridge</name></author><published>2021-03-09T00:00:00Z</published></entry></feed>'),
        ],
    ),
    "vault_notes": (
        "note_id INT, text STRING",
        [
            (1, '---\ntitle: "River"\nsource: a.pdf\nmodel: x\n---\n\nBody one'),
            (2, "---\nbook: b\npublished: 1999\n---\nBody two"),
            (3, "No front matter"),
            (4, "---\nopen: 1\nnever closed"),
            (5, "---\nsource: c\n---\n"),
        ],
    ),
    "bilingual_files": (
        "stem STRING, path STRING, rank INT, text STRING",
        [
            ("a", "x/a.txt", 1, "[EN]\nThe mill\n\n[KO]\n물레방아\n\n---\n\nThe river\n\n강\n\n---\n\n[EN]\nAlone"),
            ("a", "y/a.txt", 2, "The river\n\n큰 강\n\n---\n\nThe bridge\n\n다리\n\n---\n\nThe road\n\n길"),
            ("b", "x/b.txt", 1, "just one part"),
        ],
    ),
    "page_replies": (
        "call_id INT, first INT, last INT, reply STRING",
        [(1, 3, 6, "<<<PAGE 3>>>\nthree\n<<<PAGE 5>>>\nfive\nmore\n<<<PAGE 6>>>\n"), (2, 7, 8, "no marks at all"), (3, 9, 9, "<<<PAGE 9>>> nine")],
    ),
    "log_lines": (
        "pos INT, line STRING",
        [(1, "start"), (2, "Error: disk full"), (3, "retry after error"), (4, "done, 0 errors"), (5, "Traceback (most recent call last)"), (6, "오류 발생"), (7, "failed to open")],
    ),
    "small_strings": (
        "sid INT, text STRING",
        [
            (1, "word.³⁹ and 10² m"), (2, "200-203, 250, x, 7-5"), (3, "arXiv:2101.01234v2"), (4, "doi:10.1234/abc"), (5, "https://example.org/p.pdf"), (6, "D:20210309120000Z"),
            (7, "Tue Mar  9 12:00:00 2021"), (8, "made in 1998"), (9, 'reply: ```{"a": 1}```'), (10, "a<b & \"c\""), (11, "The_Old Mill_Jane Miller"), (12, "“quoted (p. 3) text”"), (13, ""),
            (14, "429 Too many requests"), (15, "invalid API key"), (16, "connection reset"),
        ],
    ),
    "contents": (
        "book STRING, page INT, text STRING",
        [("a", 0, "Title"), ("a", 1, "CONTENTS\nOne .... 3\nTwo .... 9"), ("a", 2, "Three ... 12\nFour ... 15\nFive ... 18\nSix ... 22"), ("a", 3, "Seven ... 30\nEight ... 31\nNine ... 32\nTen ... 33"), ("a", 4, "Text of the book"), ("a", 5, "A ... 1\nB ... 2\nC ... 3\nD ... 4")]
        + [("b", p, t) for p, t in enumerate(["Head", "A ... 1\nB ... 2\nC ... 3\nD ... 4", "text 12", "E ... 1\nF ... 2\nG ... 3\nH ... 4"])]
        + [("c", p, ("words " * 80) if p % 6 else "part") for p in range(30)],
    ),
    "chapter_lines": (
        "book STRING, chapter INT, pos INT, line STRING",
        [
            ("a", 1, 0, "Introduction"), ("a", 1, 1, ""), ("a", 1, 2, "text"), ("a", 1, 3, ""), ("a", 1, 4, "Conclusion"), ("a", 1, 5, ""), ("a", 1, 6, "text"),
            ("a", 2, 0, "x"), ("a", 2, 1, ""), ("a", 2, 2, "Conclusion"), ("a", 2, 3, ""), ("a", 2, 4, "References"), ("a", 2, 5, "no blank line around"),
            ("b", 1, 0, "x"), ("b", 1, 1, ""), ("b", 1, 2, "Abstract"), ("b", 1, 3, ""), ("b", 2, 0, ""), ("b", 2, 1, "Abstract"), ("b", 2, 2, ""), ("b", 3, 0, ""), ("b", 3, 1, "Abstract"), ("b", 3, 2, ""),
        ],
    ),
    "header_lines": (
        "book STRING, line STRING",
        [("a", f"{n} The Old Mill") for n in (12, 14, 16)] + [("a", "12 The River"), ("a", "14 The River"), ("b", "3 The Bridge"), ("b", "3 The Bridge"), ("b", "3 The Bridge"), ("a", "18 The Old Mill, pp. 3")],
    ),
    "header_titles": ("book STRING, title STRING", [("a", "The Old Mill_The River"), ("b", "The Bridge")]),
    "marked_bodies": (
        "book STRING, chapter INT, body STRING",
        [("a", 1, "One.3 Two[^4] three,5 four.3"), ("a", 2, "Five.5 six.33"), ("b", 1, "no numbers")],
    ),
    "note_definitions": ("book STRING, id STRING", [("a", "3"), ("a", "4"), ("a", "5"), ("a", "6"), ("b", "1")]),
    "book_pages": (
        "book STRING, page INT, text STRING",
        [("mill", p, f"The Old Mill by the River {10 + p}\nline {chr(97 + p)} of the page\n\nmore words {chr(107 + p)}\n{'Printed in the valley' if p % 2 else 'Mill Press'} {p}") for p in range(7)]
        + [("road", p, f"Road {p}") for p in range(2)],
    ),
    "reflow_lines": (
        "doc_id INT, pos INT, line STRING",
        [
            (1, 0, "The mill stands by the river and its wheel has been turning for a hund-"), (1, 1, "red years, as everybody in the valley likes to tell the people who come."),
            (1, 2, "The bridge"), (1, 3, "Stone by stone the bridge was put over the water in a single long summer"), (1, 4, "by people of the town."), (1, 5, ""), (1, 6, "After it came the road, which leads up to the chapel and further into the"), (1, 7, "hills."),
        ],
    ),
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    ddl, rows = TABLES[name]
    return spark.createDataFrame(rows, ddl)


def _literal(value) -> str:
    return "NULL" if value is None else str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def cte(name: str) -> str:
    """The table as a common table expression for the SQL twin."""
    ddl, rows = TABLES[name]
    columns = [c.strip().split(" ") for c in ddl.split(",")]
    values = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    casts = ", ".join(f"CAST({c} AS {k.replace('STRING', 'VARCHAR')}) AS {c}" for c, k in columns)
    return f"{name} AS (SELECT {casts} FROM (VALUES {values}) v({', '.join(c for c, _ in columns)}))"
