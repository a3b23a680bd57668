"""What must never change: characters, order, counts; and small cases with known answers."""

import gc
import random
import re
import string
import struct
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quirefold.functions import arrow, bibliographic, redact, scripts
from quirefold.operators import chapters, glossary, layout, lines, notes, quality, queue, quotes, readings, segmentation, units
from quirefold.plans import books as book_plans
from quirefold.sources import fixtures, office
from quirefold.streaming import stages

SPACE = re.compile(r"\s")
bare = lambda t: SPACE.sub("", t)


def test_any_decisions_keep_all_characters(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab ,.\n") for _ in range(200)) for _ in range(50)]
    df = lines.line_plan(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), "text")
    kinds = F.transform("kinds", lambda k: F.when(k == "P", k).otherwise(F.element_at(F.array(F.lit("J"), F.lit("S"), F.lit("?")), (F.pmod(F.xxhash64("id", k), F.lit(3)) + 1).cast("int"))))
    for r in df.select("text", lines.rendered(F.col("lines"), kinds).alias("out")).collect():
        assert bare(r["out"]) == bare(r["text"])


def test_line_kinds_of_a_page(spark):
    df = lines.line_plan(fixtures.frame(spark, "line_breaks"), "text")
    got = {r["doc_id"]: list(r["kinds"]) for r in df.collect()}
    assert got[1] == ["?", "?", "P", "P", "?"]
    assert got[2] == [] and got[3] == []
    assert got[4] == ["?", "?", "S"]


def test_reflow_keeps_headings_apart_and_joins_hyphens(spark):
    text = "\n".join(line for _, _, line in fixtures.TABLES["reflow_lines"][1])
    df = lines.reflowed(spark.createDataFrame([(1, text)], "id int, text string"), "id", "text")
    got = [r["paragraph"] for r in df.orderBy("block", "in_block").collect()]
    assert got[1] == "The bridge" and "hundred years" in got[0] and got[-1].endswith("into the hills.")


def test_chunks_lose_nothing_and_stay_small(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    long = "A sentence without end " * 1500
    extra = spark.createDataFrame([(-1, long), (-2, None), (-3, ""), (-4, "One. Two? Dr. Who went. " * 400)], "doc_id long, text string")
    made = units.paragraph_chunks(docs.unionByName(extra), "doc_id", "text").collect()
    by = {}
    for r in sorted(made, key=lambda r: (r["doc_id"], r["n"])):
        by.setdefault(r["doc_id"], []).append(r["chunk"])
    for r in docs.unionByName(extra).collect():
        assert bare("".join(by.get(r["doc_id"], []))) == bare(r["text"] or "")
    assert all(len(c) <= units.LIMIT for cs in by.values() for c in cs)
    assert all(c.rstrip().endswith((".", "?")) for c in by[-4])


def test_plan_offsets_reproduce_the_text(spark):
    text = "First part. " * 400 + "\f\n# Head\n\n1. A note\n\n" + "x" * 25000
    rows = units.translation_plan(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("n").collect()
    assert all(bare(text[r["start"] : r["end"]]) == bare(r["unit"]) for r in rows if r["kind"] != "page")
    assert "".join(bare(r["unit"]) for r in rows if r["kind"] != "page") == bare(text)
    assert {r["kind"] for r in rows} >= {"page", "body", "note_candidate"}
    assert [r["page"] for r in rows] == sorted(r["page"] for r in rows)


def test_a_plan_holds_few_units_at_a_time(spark):
    def counted(text):
        held = sum("excluded" in o for o in gc.get_objects() if type(o) is dict)
        assert held < 2000, f"{held} units are held at once"
        return units.paragraphs(text)

    text = "\n\n".join(f"# Head {n}\n\nThe text under it." for n in range(50))
    docs = spark.createDataFrame([(n, text) for n in range(60)] + [(60, None), (None, "One.\fTwo.")], "doc_id long, text string").coalesce(1)
    rows = units.translation_plan(docs, splitter=counted).collect()
    assert [(r["doc_id"], r["n"]) for r in rows] == [(d, n) for d in range(60) for n in range(100)] + [(None, n) for n in range(3)]
    assert [r["unit"] for r in rows if r["doc_id"] == 59] == text.split("\n\n") and [r["unit"] for r in rows[-3:]] == ["One.", units.PAGE_TOKEN, "Two."]


def test_results_of_few_texts_are_python_objects_at_a_time():
    class Held(list):
        pass

    def made(text):
        assert sum(isinstance(o, Held) for o in gc.get_objects()) <= 10
        return Held([text, text])

    texts = pa.array([*("abcdefghij" for _ in range(95)), None, ""])
    got = arrow.mapped(texts, made, pa.list_(pa.string()), most=100)
    assert got.to_pylist() == [[t or "", t or ""] for t in texts.to_pylist()]
    assert arrow.mapped(pa.array([], pa.string()), made, pa.list_(pa.string())).to_pylist() == []


def test_sentence_ends_pass_over_abbreviations():
    text = "Dr. A. B. Miller came, cf. p. 3. He left.[12] Why? Yes!”"
    assert [text[:e].split()[-1] for e in units.sentence_ends(text)] == ["3.", "left.[12]", "Why?", "Yes!”"]
    assert not units.closed("ends with Mr.") and units.closed("a whole one. ") and not units.closed("")


def test_splits_hold_the_text():
    won = set()
    for book, text, bookmarks, visual in book_plans.split_fixtures():
        mode, parts = segmentation.split_text(text, bookmarks or [], visual or [], book_plans.pick_starred)
        assert mode == book.split("-")[0]
        won.add(mode)
        joined = bare("".join(b for _, b in parts))
        whole = bare(segmentation.without_noise(text))
        assert joined in whole and (mode == "toc" or joined == whole)  # contents and a notes list are left out, nothing else
    assert won == {"bookmark", "visual", "heading", "toc", "numbered", "llm", "single"}
    assert segmentation.split_text("i. one\nii. two\niii. three")[0] == "single"
    assert segmentation.split_text("") == ("single", [("whole text", "")])


def test_chosen_chapters_are_validated():
    text = "".join(f"Line {n}\n{'plain words. ' * 700}\n" for n in range(6))
    lines = segmentation.choosable_lines(text)
    assert [line for _, line in lines] == [f"Line {n}" for n in range(6)]
    pick = lambda *idx: segmentation.chosen(text, [{"idx": i} for i in idx])
    assert [t for t, _ in pick(4, 0, 2)] == ["Line 0", "Line 2", "Line 4"]
    assert pick(0, 1) is None and pick(0, 1, 6) is None and pick(0, 1, "2") is None and segmentation.chosen(text, None) is None
    assert segmentation.chosen(text[:15_000], [{"idx": 0}] * 3) is None


def test_many_small_sections_join_their_smallest():
    text = "".join(f"# T{n}\n{'words go on. ' * (220 + n)}\n" for n in range(40))
    mode, parts = segmentation.split_text(text)
    assert mode == "heading" and len(parts) == segmentation.MOST_CHAPTERS


def test_titles_are_found_without_their_spaces():
    pattern = segmentation.title_pattern("TheWater MillOfOld")
    assert pattern.search("x THE water-mill of 1 old") and segmentation.title_pattern("A of") is None


def test_a_chapter_is_cut_at_an_offset(spark):
    before = fixtures.frame(spark, "chapters").where("book = 'a'")
    after = {r["n"]: r for r in chapters.split_chapter(before, "book", 2, 5, "second half").collect()}
    old = {r["n"]: r for r in before.collect()}
    assert after[2]["body"] + after[3]["body"] == old[2]["body"] and len(after[2]["body"]) == 5 and after[3]["title"] == "second half"
    assert len(after) == len(old) + 1 and after[4]["body"] == old[3]["body"]


def test_merging_and_renumbering_chapters(spark):
    before = fixtures.frame(spark, "chapters").where("book = 'a'")
    after = chapters.merged_up(before, "book", 3)
    rows = after.orderBy("n").collect()
    assert [r["n"] for r in rows] == [1, 2, 3, 4] and rows[1]["body"] == "m" * 1000 + "\n" + "b" * 1100
    assert {r["n"] for r in chapters.changed_bodies(before, after, "book").collect()} == {2, 3, 4}


def test_notes_and_references(spark):
    got = {(r["doc_id"], r["num"]): r for r in notes.linked_notes(fixtures.frame(spark, "footnote_pages")).collect()}
    assert got[1, 39]["linked"] and got[1, 40]["linked"]
    assert got[1, 41]["page"] == 4 and got[1, 41]["ref_page"] == 3
    assert not got[2, 7]["is_note"] and not got[1, 110]["is_note"]
    rows = sorted((r["page"], r["num"], r["ref_page"]) for r in notes.linked_notes(fixtures.frame(spark, "footnote_pages")).where("doc_id = 4").collect())
    assert rows == [(0, 1, 0), (1, 1, 0)]  # each takes a reference of its own; the index entry is no note
    assert (got[3, 59]["linked"], got[3, 59]["is_note"]) == (False, True)  # next to 58


def test_pages_flagged_off_are_not_searched(spark):
    pages = fixtures.frame(spark, "footnote_pages").withColumn("has_notes", F.col("page") != 0)
    assert {r["page"] for r in notes.linked_notes(pages).where("doc_id = 1 and is_note").collect()} == {1, 4}


def test_chains_of_headings_are_no_notes():
    prose = "\n\n" + "long words " * 50
    assert notes.split_notes("Text.\n1 First section" + prose + "\n2 Second section" + prose)[1] == []
    assert notes.split_notes("Text.\n1 ibid., 3.\n2 A note that is\nlong enough.") == ("Text.", [(1, "ibid., 3."), (2, "A note that is long enough.")])
    assert notes.split_notes("Text.\n4 ibid.") == ("Text.\n4 ibid.", [])  # short and alone
    assert notes.recovery_hint(["a.58 방앗\n58 A note of a book.", "간은"], 0, [59], "방앗간은") == "notes 59; the page ends in '방앗' of '방앗간은'"
    assert notes.recovery_hint(["whole."], 0, [3, 4]) == "notes 3, 4"


def test_definitions_move_to_their_markers(spark):
    markers = spark.createDataFrame([("b", 1, "x"), ("b", 3, "x")], "book string, chapter int, id string")
    definitions = spark.createDataFrame([("b", 2, "x", "first"), ("b", 3, "x", "second"), ("b", 2, "y", "alone")], "book string, chapter int, id string, body string")
    got = {r["id"]: tuple(r)[2:] for r in notes.moved_definitions(markers, definitions).collect()}
    assert got == {"x": (1, "first", True), "y": (2, "alone", False)}


def test_pages_join_sentences_and_keep_notes(spark):
    pages = ["It was a long-\n1 A note of the book.", "lived river\n2 A note of the next page.", "bank. The end.\n\nMore.\n3 The last of the notes.", "Cut here", "and on."]
    got = notes.reflowed(pages)
    assert got == [
        "It was a longlived river bank. The end.\n\n1 A note of the book.\n2 A note of the next page.", "",
        "More.\n\n3 The last of the notes.", "Cut here", "and on.",
    ]
    frame = spark.createDataFrame([(1, n, p) for n, p in enumerate(pages)], "doc_id int, page int, text string")
    assert [r["text"] for r in notes.pages_reflowed(frame).orderBy("page").collect()] == got
    assert notes.joined("방앗", "간은", "물레방앗간은") == "방앗간은" and notes.joined("방앗", "간은") == "방앗 간은"


def test_quotes_by_anchors_equal_those_by_automaton(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcde \n") for _ in range(n))
    sources = [(i, text(rng.choice([0, 20, 300, 2000]))) for i in range(60)] + [(100, None), (101, "é日😀" * 40)]
    quoted = [(i, s[a : a + n]) for i, (_, s) in enumerate(sources) if s for a in (0, 7, 100) for n in (12, 30, 40, 200) if len(s) >= a + n]
    quoted += [(900, "nowhere in any of the sources at all"), (901, None), (902, "short"), (903, "é日😀" * 9)]
    q = spark.createDataFrame(quoted, "item_id long, text string")
    s = spark.createDataFrame(sources, "doc_id long, text string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(quotes.verified(q, s))
    assert want and rows(quotes.verified(q, s, block=3)) == want
    plain = sorted((i, d, bare(t).find(bare(x)), len(bare(x))) for i, x in quoted if x and len(bare(x)) >= 10 for d, t in sources if t and bare(x) in bare(t))
    assert want == plain


def test_searches_for_quotes_hold_few_objects_at_a_time(monkeypatch):
    rng = random.Random(11)
    keys = ["".join(rng.choices(string.ascii_lowercase, k=10)) for _ in range(400)]
    texts = pa.array(["".join(rng.sample(keys, 20)) for _ in range(20_000)])
    for search in (quotes._first_places(keys).func, quotes.anchors.func):
        search(texts[:10])
        tracemalloc.start()
        got = search(texts)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(got) == 20_000 and len(got.values) >= 100_000 and peak < 40e6, peak
    monkeypatch.setattr(quotes, "STRETCH", 7)
    assert quotes.anchors.func(texts[:200]).to_pylist() == got[:200].to_pylist()


def test_a_stretch_of_windows_selects_what_all_do(monkeypatch):
    codes = np.frombuffer("the wheel of the old mill turned by the river, day and night ".encode("utf-32-le") * 9, np.uint32).astype(np.uint64)
    at, grams = quotes._selected(codes)
    monkeypatch.setattr(quotes, "STRETCH", 3)
    assert [x.tolist() for x in quotes._selected(codes)] == [at.tolist(), grams.tolist()] and len(at) > 20


def test_automata_of_a_worker_are_small_and_one_at_a_time(monkeypatch):
    rng = random.Random(12)
    keys = ["".join(rng.choices(string.ascii_lowercase, k=400)) for _ in range(500)]
    size = quotes._automaton(keys).get_stats()["total_size"]
    assert size / 200_000 * quotes.BLOCK_CHARS * 4 < 1e9  # four workers of an executor

    def new(make=quotes.ahocorasick.Automaton):
        assert not quotes._AUTOMATA
        return make()

    monkeypatch.setattr(quotes.ahocorasick, "Automaton", new)
    assert quotes._automaton(keys[:9]).exists(keys[0]) and not quotes._automaton(keys[9:]).exists(keys[0])


def test_glossary_forms(spark):
    got = {(r["term"], r["key"]): r["canonical"] for r in glossary.groups(glossary.keyword_pairs(fixtures.frame(spark, "keyword_notes"))).collect()}
    assert got["river", "flumen"] == "flumen" or got["river", "flumen"] == "flu-men"
    review = {r["term"]: r["benign"] for r in glossary.review_targets(glossary.keyword_pairs(fixtures.frame(spark, "keyword_notes"))).collect()}
    assert set(review) == {"mill", "bridge"}


def test_titles(spark):
    rows = bibliographic.with_plain_title(fixtures.frame(spark, "titles"), "title", "ordinal", "plain")
    got = {r["title_id"]: (r["plain"], r["safe"]) for r in rows.select("title_id", "plain", bibliographic.safe_title(F.col("title")).alias("safe")).collect()}
    assert got[1][1] == "Rivers - a “short” history" and got[2][0] == "The Mill" and got[3][0] == "The Bridge" and got[4][0] == "7. Study five"
    assert got[5][0] == "3" and got[10][0] == "Last" and got[11][1] == "co-evolution" and got[12][1] == "untitled"
    assert len(got[8][1].encode()) <= 180 and got[8][1].endswith(("강과", "다리"))


def test_quotes_are_found_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(quotes, "BLOCK", 2)
    source = spark.createDataFrame([(1, "The old mill\nstands by the river."), (2, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, t) for i, t in enumerate(["old mill stands", "by the river.", "not in there at all", "mill", "the  old\tmillstands"])], "item_id long, text string")
    got = {r["item_id"]: r["position"] for r in quotes.verified(asked, source).collect()}
    assert got == {0: 3, 1: 16}


def test_reading_verdicts(spark):
    text, open_ = readings.reconciled("the cat sat", "the dog sat", "a dog")
    assert text == "the dog sat" and open_ == []
    text, open_ = readings.reconciled("the cat, sat", "the cat sat!", "")
    assert text == "the cat, sat" and open_ == []
    assert readings.reconciled("the cat sat", "the dog sat")[1][0]["b"] == "dog"
    assert readings.reconciled("", "only b") == ("only b", []) and readings.reconciled("", "") == ("", [])
    pages = fixtures.frame(spark, "page_readings").withColumn("text", F.col("read_a"))
    got = {r["page"]: r["note"] for r in readings.verdicts(pages, "text", "base", "judge", least_base=20).collect()}
    assert got[1] == "" and got[3] == "empty reading" and got[4] == "unlike the page" and got[6] == "blank page"
    word = spark.createDataFrame([("the river bank", "river", "rover"), ("riverside", "rivers", "rivets"), ("x", "a", "b"), ("", "a", "b")], "c string, a string, b string")
    assert [r[0] for r in word.select(readings.lexicon_verdict(F.col("c"), F.col("a"), F.col("b"))).collect()] == ["A", "A", "?", "?"]


def test_reading_order_of_columns():
    glyphs = [(c, 10.0 + 6 * k, 5.0, 15.0 + 6 * k) for k, c in enumerate("aheadingoverbothcolumnsofthepage")]
    for row in range(5):
        y = 30.0 + 12 * row
        glyphs += [(c, 10.0 + 6 * k, y, 15.0 + 6 * k) for k, c in enumerate(f"left{row}")]
        glyphs += [(c, 120.0 + 6 * k, y, 125.0 + 6 * k) for k, c in enumerate(f"right{row}")]
    text = layout.reading_order(glyphs).split("\n")
    assert text == ["aheadingoverbothcolumnsofthepage", *[f"left{i}" for i in range(5)], *[f"right{i}" for i in range(5)]]
    assert layout.reading_order([]) == ""


def test_hwp_records():
    para = "강\t다리".encode("utf-16-le").replace("\t".encode("utf-16-le"), struct.pack("<H", 9) + b"\0" * 14)
    head = struct.pack("<I", 67 | len(para) << 20)
    assert office.hwp_body(head + para, compressed=False) == "강\t다리"
    long = ("a" * 3000).encode("utf-16-le")
    assert office.hwp_body(struct.pack("<II", 67 | 0xFFF << 20, len(long)) + long, compressed=False) == "a" * 3000
    with pytest.raises(ValueError):
        list(office.hwp_records(head + para[:-1]))


def test_layered_text_files(spark, tmp_path):
    for root, names in (("active", ["a"]), ("old", ["a", "b"])):
        (tmp_path / root).mkdir()
        for n in names:
            (tmp_path / root / f"{n}.txt").write_text(f"{root} {n}")
    got = {r["stem"]: r["text"] for r in office.read_layered(spark, [str(tmp_path / "active"), str(tmp_path / "old")]).collect()}
    assert got == {"a": "active a", "b": "old b"}


def test_scripts_own_share(spark):
    row = spark.createDataFrame([("강abc",)], "t string").select(
        scripts.own_share(scripts.script_counts(F.col("t")), "ko").alias("ko"), scripts.own_share(scripts.script_counts(F.col("t")), "en").alias("en")
    ).first()
    assert row["ko"] == 0.25 and row["en"] == 0.75


def test_redaction(spark):
    text = "mail a.b@example.org, call +1 (706) 555-3138, see /home/someone/x"
    got = spark.createDataFrame([(text,)], "t string").select(redact.redacted(F.col("t"))).first()[0]
    assert got == "mail <email>, call <phone>, see <home>/x"


def test_better_extraction(spark):
    rows = [(1, "ok words", "other"), (2, "", "fallback"), (3, "x" * 40, "short words"), (4, None, "f")]
    got = {r["id"]: r["used"] for r in quality.better_extraction(spark.createDataFrame(rows, "id int, a string, b string"), "id", "a", "b").collect()}
    assert got == {1: "text", 2: "fallback", 3: "fallback", 4: "fallback"}


def test_windowed_stream_equals_batch(spark, sf_dir):
    stream = stages.windowed_counts(stages.event_stream(spark, f"{sf_dir}/events.parquet"))
    got = {(r["window_start"], r["event_type"]): r["n"] for r in stages.run_to_end(spark, stream, "append").collect()}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch = {(r["s"], r["event_type"]): r["n"] for r in events.groupBy(F.window("ts", "1 day").start.alias("s"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got and all(batch[k] == n for k, n in got.items())
    closed = {k for k, _ in batch.items()} - set(got)
    assert all(k[0] >= max(s for s, _ in got) for k in closed)  # only windows that the watermark has not passed are open


def test_queue_operations(spark):
    events = [(1, 1, "s", "a", "add"), (2, 2, "s", "a", "add"), (3, 3, "s", "b", "add"), (4, 4, "s", "a", "remove"), (5, 5, "s", "c", "add"), (6, 6, "t", "a", "add"), (7, 7, "t", "x", "clear")]
    got = {(r["stage"], r["item"]) for r in queue.queue_items(spark.createDataFrame(events, "ts long, event_id long, stage string, item string, op string")).collect()}
    assert got == {("s", "b"), ("s", "c")}
