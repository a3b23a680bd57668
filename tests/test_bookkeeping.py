"""Look-ups, work lists and maps: small cases with known answers."""

from pyspark.sql import functions as F

from quirefold.operators import bookkeeping as b
from quirefold.sources import fixtures


def test_work_lists(spark):
    chapters = spark.createDataFrame([("a", 1, "강강강강 x"), ("a", 2, "강강강강"), ("a", 3, "강강강강"), ("a", 4, "latin only")], "stem string, n int, body string")
    done = lambda *n: spark.createDataFrame([("a", i) for i in n], "stem string, n int")
    assert [r["n"] for r in b.needs_cleaning(chapters, done(2), done(3)).collect()] == [1]
    queue = spark.createDataFrame([("x",), ("y",), ("z",)], "item string")
    renames = spark.createDataFrame([("x", "x2")], "item string, new_item string")
    present = spark.createDataFrame([("x2",), ("z",)], "item string")
    assert sorted(r["item"] for r in b.resynced(queue, renames, present).collect()) == ["x2", "z"]


def test_known_metadata_wins_field_by_field(spark):
    guess = spark.createDataFrame([("a", "T", "2001"), ("b", "U", "2002")], "stem string, title string, date string")
    known = spark.createDataFrame([("a", "", "1999")], "stem string, title string, date string")
    got = {r["stem"]: tuple(r)[1:] for r in b.overridden(guess, known, "stem", ["title", "date"]).collect()}
    assert got == {"a": ("T", "1999"), "b": ("U", "2002")}


def test_chapter_pages_meet_page_ranges(spark):
    pages = spark.createDataFrame([("a", 0, "ab cd"), ("a", 1, "ef"), ("a", 2, "ghij"), ("b", 0, "xyz")], "book string, page int, text string")
    chapters = spark.createDataFrame([("a", 1, "abc"), ("a", 2, "defg"), ("a", 3, "hij"), ("b", 1, "other length")], "book string, n int, body string")
    got = {(r["book"], r["n"]): (r["first_page"], r["last_page"]) for r in b.chapter_pages(chapters, pages, "book").collect()}
    assert got == {("a", 1): (0, 0), ("a", 2): (0, 2), ("a", 3): (2, 2)}
    long = spark.createDataFrame([("a", 0, "x" * 9000), ("a", 1, "y" * 9000)], "book string, page int, text string")
    whole = spark.createDataFrame([("a", 1, "z" * 17999), ("a", 2, "z")], "book string, n int, body string")
    assert {r["n"]: (r["first_page"], r["last_page"]) for r in b.chapter_pages(whole, long, "book").collect()} == {1: (0, 1), 2: (1, 1)}


def test_catalogue_records(spark):
    replies = fixtures.frame(spark, "catalogue_replies")
    row = replies.where("rid = 1").select(b.work_record(F.col("reply")).alias("r")).first()["r"]
    assert tuple(row) == ("The Old Mill", "Jane Miller, Bridge", "2021-03", "Mill Press")
    row = replies.where("rid = 4").select(b.feed_record(F.col("reply")).alias("r")).first()["r"]
    assert tuple(row) == ("A River", "J. Miller, B. Ridge", "2021-03-09")


def test_predicates(spark):
    body = "## Summary\n" + "words of a note " * 60
    rows = [("model: x", body, True, "s"), ("model: x\nrefined: y", body, True, "s"), ("none", body, True, "s"), ("model: x", "no section", True, "s"), ("model: x", "## Summary\nthin", True, "s"), ("model: x", body, True, "s_translated")]
    df = spark.createDataFrame(rows, "t string, b string, h boolean, s string")
    got = [r[0] for r in df.select(b.note_eligibility(F.col("t"), F.col("b"), F.col("h"), F.col("s"))).collect()]
    assert got == [None, "done before", "not made by the pipeline", "no summary section", "too thin", "holds the full text"]
    sentences = ["강을 따라 걷던 사람들은 오래된 다리를 건너 마을로 돌아왔다.", "too short", "강을 따라 걷던 사람들은 ㅁㄴ 오래된 다리를 건너 마을로 돌아왔다.", "강을 따라 걷던 學問道 사람들은 오래된 다리를 건너 마을로 돌아왔다."]
    df = spark.createDataFrame([(s,) for s in sentences], "s string")
    assert [r[0] for r in df.select(b.clean_sentence(F.col("s"))).collect()] == [True, False, False, False]


def test_authors_and_terms(spark):
    lines = spark.createDataFrame([("a", 0, "The Old Mill"), ("a", 1, "by Jane Miller, Ph.D."), ("b", 0, "x")], "book string, pos int, line string")
    authors = spark.createDataFrame([("a", "Jane Miller"), ("b", "Nobody")], "book string, author string")
    assert [tuple(r) for r in b.author_line(lines, authors).collect()] == [("a", "by Jane Miller, Ph.D.")]
    glossary = spark.createDataFrame([("t", "Flumen", 3), ("u", "pons", 9)], "term string, canonical string, n long")
    authority = spark.createDataFrame([("flu-men",)], "heading string")
    assert {r["canonical"]: r["heading"] for r in b.known_terms(glossary, authority).collect()} == {"Flumen": "flu-men", "pons": None}


def test_recent_unconfirmed(spark):
    maps = spark.sql("select * from values ('a', false, timestamp'2024-01-10'), ('b', true, timestamp'2024-01-10'), ('c', false, timestamp'2024-01-01') t(stem, confirmed, changed)")
    assert [r["stem"] for r in b.recent_unconfirmed(maps, F.to_timestamp(F.lit("2024-01-11"))).collect()] == ["a"]
