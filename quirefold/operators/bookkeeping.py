"""Look-ups by priority, work lists, counters, metadata merges, page maps and layout statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.text import compact, runs, strip, tokens
from quirefold.operators.glossary import norm_key
from quirefold.operators.language import even_places
from quirefold.operators.queue import islands

# ---- look-ups -------------------------------------------------------------------------------------------------------


def first_of(candidates: DataFrame, key: list[str], rank: str, value: str) -> DataFrame:
    """(key, value): of several candidates the one of the lowest rank, the smaller value on a tie."""
    return candidates.groupBy(*key).agg(F.min_by(value, F.struct(rank, value)).alias(value))


def visible_translation(chapters: DataFrame, artifacts: DataFrame, target: str) -> DataFrame:
    """(stem, n, lang, payload): the translation to show, the target language first, then Korean, then any other.

    artifacts: (stem, n, lang, payload, status); one that is running, partial or failed is not shown.
    """
    rank = F.when(F.col("lang") == target, 0).when(F.col("lang") == "ko", 1).otherwise(2)
    shown = artifacts.where(~F.coalesce(F.col("status").isin("running", "partial", "failed"), F.lit(False)))
    best = shown.groupBy("stem", "n").agg(F.min_by(F.struct("lang", "payload"), F.struct(rank, "lang")).alias("b"))
    return chapters.select("stem", "n").join(best, ["stem", "n"], "left").select("stem", "n", "b.lang", "b.payload")


def source_index(paths: DataFrame, path: str, key: Column) -> DataFrame:
    """(key, paths): files by their normal key, in order."""
    return paths.select(key.alias("key"), path).where("key != ''").groupBy("key").agg(F.array_sort(F.collect_set(path)).alias("paths"))


def needs_cleaning(chapters: DataFrame, translated: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Chapters (stem, n, body) with much Hangul that have no translation and no clean text yet."""
    hangul = F.length("body") - F.length(F.regexp_replace("body", "[가-힣]", ""))
    share = hangul / F.greatest(F.length(compact(F.col("body"))), F.lit(1))
    left = chapters.join(translated, ["stem", "n"], "left_anti").join(cleaned, ["stem", "n"], "left_anti")
    return left.where(share >= 0.30).select("stem", "n")


def resynced(queue: DataFrame, renames: DataFrame, present: DataFrame) -> DataFrame:
    """Queue items under their new names; items that exist no more drop out. queue: (item); renames: (item, new_item)."""
    named = queue.join(renames, "item", "left").select(F.coalesce("new_item", "item").alias("item"))
    return named.join(present, "item", "left_semi").distinct()


def overridden(guesses: DataFrame, known: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Known metadata over guessed metadata, field by field; empty strings are no knowledge."""
    other = known.select(key, *[F.nullif(F.col(f), F.lit("")).alias(f"_{f}") for f in fields])
    return guesses.join(other, key, "left").select(key, *[F.coalesce(f"_{f}", f).alias(f) for f in fields])


# ---- counters and lists -----------------------------------------------------------------------------------------------


def status_counts(rows: DataFrame, group: str, status: str, values: list[str]) -> DataFrame:
    """(group, total and one count for each value): one pass, as columns."""
    return rows.groupBy(group).agg(F.count("*").alias("total"), *[F.count_if(F.col(status) == v).alias(v) for v in values])


def thinned(lines: DataFrame, group: str, order: str, strong: str, most: int) -> DataFrame:
    """Candidates of a group, at most about ``most``: the strong ones all, the weak ones evenly spread over what is left."""
    w = Window.partitionBy(group, strong).orderBy(order)
    counts = lines.groupBy(group).agg(F.count_if(F.col(strong)).alias("s"), F.count_if(~F.col(strong)).alias("k"))
    placed = lines.withColumn("place", F.row_number().over(w).cast("long") - 1).join(counts, group)
    room = F.greatest(F.lit(most) - F.col("s"), F.lit(0))
    # a weak line stays if the even grid of ``room`` steps over k lines has its place
    step = F.col("k") / F.when(room > 0, room)
    at = F.ceil(F.col("place") / step)
    on_grid = F.coalesce((F.floor(at * step) == F.col("place")) & (at < room), F.lit(False))
    return placed.where(F.col(strong) | (F.col("k") <= room) | on_grid).drop("place", "s", "k")


def keyword_lines(lines: DataFrame, line: str, word: str) -> DataFrame:
    """Lines that hold a word, case and white space aside."""
    return lines.where(F.contains(F.lower(compact(F.col(line))), F.lit("".join(word.split()).lower())))


def recent_unconfirmed(maps: DataFrame, now: Column, days: int = 3, most: int = 5) -> DataFrame:
    """The latest chapter maps (stem, confirmed, changed) that nobody has confirmed."""
    fresh = maps.where(~F.col("confirmed") & (F.col("changed") >= now - F.expr(f"interval {days} days")))
    return fresh.orderBy(F.col("changed").desc(), "stem").limit(most)


def fallback_segments(units: DataFrame, group: str, order: str, provider: str, main: str) -> DataFrame:
    """(group, provider, first, last, n): neighbouring units that the same substitute served."""
    w = Window.partitionBy(group).orderBy(order)
    other = F.col(provider) != main
    runs = islands(units, [group], [order], other).where(F.col("island").isNotNull())
    change = F.when(F.col(provider) == F.lag(provider).over(Window.partitionBy(group, "island").orderBy(order)), 0).otherwise(1)
    runs = runs.withColumn("_c", change).withColumn("_s", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(group, "island", "_s").agg(F.first(provider).alias(provider), F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("island", "_s")


def term_pairs(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(source, term): ``term(source)`` pairs of translations; the first place in the order of ``key`` wins."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"[가-힣]+(?: [가-힣]+)?\([A-Za-z][A-Za-z .'’-]*\)"), F.lit(0))
    each = texts.select(key, F.posexplode(found).alias("place", "p"))
    pairs = each.select(key, "place", F.regexp_extract("p", r"^([^(]+)\(", 1).alias("term"), F.regexp_replace(F.regexp_extract("p", r"\(([^)]+)\)", 1), r"^[ .'’-]+|[ .'’-]+$", "").alias("source"))
    return pairs.where(F.length("source") >= 2).groupBy("source").agg(F.min_by("term", F.struct(key, "place")).alias("term"))


def leftover_words(text: Column) -> Column:
    """Latin words outside of parentheses."""
    return F.size(F.filter(runs(F.regexp_replace(text, r"\([^()]*\)", ""), "A-Za-zÀ-ž"), lambda w: F.length(w) >= 2))


def clean_sentence(s: Column) -> Column:
    """A Korean sentence fit to be shown: 25 to 180 characters, mostly Hangul, no broken letters."""
    t = strip(s)
    hangul = F.length(t) - F.length(F.regexp_replace(t, "[가-힣]", ""))
    odd = F.length(t) - F.length(F.regexp_replace(t, r"[^\p{L}\p{N}_()\.,'\"·\-—%:!?\s]", ""))
    return F.length(t).between(25, 180) & (hangul >= F.length(t) * 0.45) & ~t.rlike("[ᄀ-ᇿ㄰-㆏]") & ~t.rlike("[一-鿿]{2,}") & (odd <= 3)


def note_eligibility(text: Column, body: Column, has_front_matter: Column, stem: Column) -> Column:
    """Why a note is not to be improved, or null: the first reason that holds."""
    return (
        F.when(~has_front_matter | ~text.rlike(r"(?m)^model:"), "not made by the pipeline")
        .when(text.rlike(r"(?m)^refined:"), "done before")
        .when(~body.rlike(r"(?m)^## *(Summary|Main points|요약|핵심 내용)[ \t]*$"), "no summary section")
        .when(stem.contains("_translated") | (F.length(body) > 35_000), "holds the full text")
        .when(F.length(strip(body)) < 800, "too thin")
    )


def small_document(text: Column) -> Column:
    """Whether a document may be treated as one chapter: up to 120,000 characters and 14 paragraphs."""
    paragraphs = F.size(F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: compact(p) != ""))
    return (F.length(text) <= 120_000) & (paragraphs <= 14)


def front_lines(text: Column, most: int = 5) -> Column:
    """The short paragraphs before the abstract or the first long one."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), lambda p: F.array_join(tokens(p), " ")), lambda p: p != "")
    stops = F.transform(paragraphs, lambda p: (F.length(p) > 200) | p.rlike("^(초록|요약|Abstract|ABSTRACT)([^A-Za-z0-9가-힣]|$)"))
    first = F.array_position(stops, True)
    n = F.least(F.lit(most), F.when(first > 0, first - 1).otherwise(F.size(paragraphs))).cast("int")
    return F.slice(paragraphs, F.lit(1), n)


def author_line(lines: DataFrame, authors: DataFrame) -> DataFrame:
    """(book, line): the first front line that holds the known author or is held by it. lines: (book, pos, line)."""
    key = lambda c: F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    joined = lines.join(authors.select("book", key(F.col("author")).alias("a")), "book").withColumn("k", key(F.col("line")))
    hit = (F.length("a") >= 2) & (F.length("k") >= 2) & (F.contains(F.col("k"), F.col("a")) | F.contains(F.col("a"), F.col("k")))
    return joined.where(hit).groupBy("book").agg(F.min_by("line", "pos").alias("line"))


def known_terms(glossary: DataFrame, authority: DataFrame, most: int = 40) -> DataFrame:
    """(term, canonical, n, heading): the most frequent originals with their heading in an authority file.

    glossary: (term, canonical, n); authority: (heading). Compared by the glossary key.
    """
    top = glossary.groupBy("canonical").agg(F.max("n").alias("n"), F.min("term").alias("term")).orderBy(F.col("n").desc(), "canonical").limit(most)
    listed = authority.select(norm_key(F.col("heading")).alias("k"), "heading").groupBy("k").agg(F.min("heading").alias("heading"))
    return top.withColumn("k", norm_key(F.col("canonical"))).join(listed, "k", "left").drop("k")


# ---- maps and layout ---------------------------------------------------------------------------------------------------


def chapter_pages(chapters: DataFrame, pages: DataFrame, book: str) -> DataFrame:
    """(book, n, first_page, last_page) by the ordinal of non-space characters, where chapters and pages hold equally many.

    chapters: (book, n, body); pages: (book, page, text). A chapter is a range of ordinals and so is a page; ranges that
    meet are found on a common grid of cells, without comparing every chapter with every page.
    """
    size = lambda c: F.length(compact(F.col(c))).cast("long")

    def ranged(df: DataFrame, order: str, text: str) -> DataFrame:
        w = Window.partitionBy(book).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        out = df.select(book, order, size(text).alias("s")).withColumn("stop", F.sum("s").over(w))
        return out.withColumn("start", F.col("stop") - F.col("s"))

    cell = 4096
    cells = lambda df: df.where("s > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("stop") - 1) / cell))))
    c, p = ranged(chapters, "n", "body"), ranged(pages, "page", "text")
    same = c.groupBy(book).agg(F.sum("s").alias("a")).join(p.groupBy(book).agg(F.sum("s").alias("b")), book).where("a = b").select(book)
    left = cells(c).select(book, "n", "cell", F.col("start").alias("c0"), F.col("stop").alias("c1"))
    right = cells(p).select(book, "page", "cell", F.col("start").alias("p0"), F.col("stop").alias("p1"))
    met = left.join(right, [book, "cell"]).where((F.col("p0") < F.col("c1")) & (F.col("c0") < F.col("p1")))
    return met.join(same, book, "left_semi").groupBy(book, "n").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"))


def note_area(lines: DataFrame, height: float, narrow: float = 0.8, least: int = 2, top_share: float = 0.55) -> DataFrame:
    """(page, note_top, note_lines): the lowest block of closely set lines on a page, in the lower part of it.

    lines: (page, y), y from the bottom. A block is a run of gaps under ``narrow`` times the median gap of the page.
    """
    w = Window.partitionBy("page").orderBy("y")
    gaps = lines.withColumn("gap", F.lead("y").over(w) - F.col("y")).withColumn("upper", F.lead("y").over(w)).where("gap is not null")
    medians = gaps.groupBy("page").agg(F.median("gap").alias("median"), F.count("*").alias("k")).where("k >= 5 and median > 0")
    marked = islands(gaps.join(medians, "page"), ["page"], ["y"], F.col("gap") < F.col("median") * narrow).where("island is not null")
    blocks = marked.groupBy("page", "island").agg(F.count("*").alias("n"), F.max("upper").alias("note_top"), F.min("y").alias("bottom"))
    fit = blocks.where((F.col("n") >= least) & (F.col("note_top") <= height * top_share))
    return fit.groupBy("page").agg(F.min_by(F.struct("note_top", (F.col("n") + 1).alias("note_lines")), "bottom").alias("b")).select("page", "b.note_top", "b.note_lines")


def top_bookmarks(bookmarks: DataFrame) -> DataFrame:
    """(stem, title, page) of the outermost outline level, if it has three entries or more."""
    level = bookmarks.groupBy("stem").agg(F.min("level").alias("level"))
    top = bookmarks.join(level, ["stem", "level"])
    enough = top.groupBy("stem").agg(F.count("*").alias("k")).where("k >= 3")
    return top.join(enough, "stem", "left_semi").select("stem", "title", "page")


# ---- replies of catalogues -----------------------------------------------------------------------------------------------

_DATE = T.StructType([T.StructField("date-parts", T.ArrayType(T.ArrayType(T.IntegerType())))])
WORK = T.StructType(
    [
        T.StructField(
            "message",
            T.StructType(
                [
                    T.StructField("title", T.ArrayType(T.StringType())),
                    T.StructField("author", T.ArrayType(T.StructType([T.StructField("given", T.StringType()), T.StructField("family", T.StringType())]))),
                    T.StructField("published-print", _DATE),
                    T.StructField("published-online", _DATE),
                    T.StructField("issued", _DATE),
                    T.StructField("publisher", T.StringType()),
                ]
            ),
        )
    ]
)


def work_record(reply: Column) -> Column:
    """struct<title, author, published_date, publisher> of a registration agency's JSON reply."""
    m = F.from_json(reply, WORK)["message"]
    one_space = lambda c: F.array_join(tokens(c), " ")
    names = F.transform(m["author"], lambda a: F.concat_ws(" ", a["given"], a["family"]))
    parts = F.coalesce(m["published-print"]["date-parts"], m["published-online"]["date-parts"], m["issued"]["date-parts"])
    date = F.array_join(F.transform(F.get(parts, F.lit(0)), lambda p, i: F.when(i == 0, p.cast("string")).otherwise(F.lpad(p.cast("string"), 2, "0"))), "-")
    return F.struct(
        one_space(F.get(m["title"], F.lit(0))).alias("title"),
        F.coalesce(F.array_join(F.filter(names, lambda x: x != ""), ", "), F.lit("")).alias("author"),
        F.coalesce(date, F.lit("")).alias("published_date"),
        strip(F.coalesce(m["publisher"], F.lit(""))).alias("publisher"),
    )


def feed_record(reply: Column) -> Column:
    """The same from the first entry of an Atom feed of a preprint server."""
    bare = F.regexp_replace(reply, r' xmlns(:[a-z]+)?="[^"]*"', "")
    path = lambda p: F.xpath_string(bare, F.lit(p))
    return F.struct(
        F.array_join(tokens(path("/feed/entry[1]/title/text()")), " ").alias("title"),
        F.array_join(F.filter(F.transform(F.xpath(bare, F.lit("/feed/entry[1]/author/name/text()")), strip), lambda n: n != ""), ", ").alias("author"),
        F.substring(path("/feed/entry[1]/published/text()"), 1, 10).alias("published_date"),
    )


def spread(df: DataFrame, group: str, order: str, budget: int) -> DataFrame:
    """(group, rows): the order keys at even places, as one array of at most ``budget`` for each group.

    Places are row numbers, so a group is sorted but never gathered.
    """
    placed = df.select(group, order).withColumn("_at", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long") - 1)
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    chosen = placed.join(sizes, group).where(F.array_contains(even_places(F.col("_n"), budget), F.col("_at")))
    return chosen.groupBy(group).agg(F.array_sort(F.collect_list(order)).alias("rows"))
