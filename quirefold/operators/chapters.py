"""Chapters: boundaries, evidence, diagnosis, offsets and edits on a split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import compact, strip
from quirefold.operators.ordered import kept_in_order

#: Heading words that open or close a text, and those that begin its back matter.
OPENING = ["introduction", "preface", "prologue", "foreword", "서론", "머리말", "들어가는말", "들어가며"]
CLOSING = ["conclusion", "epilogue", "afterword", "결론", "맺음말", "나가는말", "나가며"]
OTHER = ["abstract", "references", "bibliography", "notes", "index", "appendix", "참고문헌", "찾아보기"]
BACK_MATTER = r"(?i)^(references?|bibliography|works\s+cited|further\s+reading|index|참고\s*문헌|찾아\s*보기)([^A-Za-z0-9]|$)"
NUMBER_ONLY = r"(?i)^(제?\s*[0-9]+\s*장|chapter\s*[0-9]+|[0-9]+)$"
SHELL, FEW, UNEVEN = 300, 4, 3


def boundary_word(line: Column) -> Column:
    """The word of a heading that always begins a chapter, an ordinal before it aside; '' for any other line."""
    bare = F.lower(compact(line))
    words = "|".join(OPENING + CLOSING + OTHER)
    found = F.regexp_extract(bare, rf"^(?:[0-9]{{1,2}}[.)]?|[ivxl]{{1,5}}[.)])?({words})$", 1)
    return F.when(F.length(strip(line)).between(2, 40), found).otherwise("")


def anthology_evidence(headings: DataFrame, book: str) -> DataFrame:
    """(book, family, n_words, n_hits) where a book opens or closes more than once, as collections of papers do."""
    hits = headings.select(book, boundary_word(F.col("line")).alias("word")).where("word != ''")
    family = F.when(F.col("word").isin(OPENING), "opening").when(F.col("word").isin(CLOSING), "closing")
    counted = hits.withColumn("family", family).where(F.col("family").isNotNull()).groupBy(book, "family", "word").agg(F.count("*").alias("n"))
    counted = counted.groupBy(book, "family").agg(F.count("*").alias("n_words"), F.sum("n").alias("n_hits"))
    return counted.where((F.col("n_words") >= 2) | (F.col("n_hits") >= 3))


def printed_offset(numbers: DataFrame, book: str, page: str, num: str) -> DataFrame:
    """(book, offset, votes): printed number less page number, if enough pages agree and no rival comes near.

    A page votes once for each difference; the winner needs max(4, half of the pages) votes, three more than the next.
    """
    pages = numbers.groupBy(book).agg(F.count_distinct(page).alias("n_pages"))
    votes = numbers.select(book, page, (F.col(num) - F.col(page) - 1).alias("offset")).distinct().groupBy(book, "offset").agg(F.count("*").alias("votes"))
    top = votes.groupBy(book).agg(F.sort_array(F.collect_list(F.struct("votes", (-F.col("offset")).alias("o"))), asc=False).alias("v"))
    best, runner = F.col("v")[0], F.coalesce(F.get(F.col("v"), 1)["votes"], F.lit(0))
    enough = (best["votes"] >= F.greatest(F.lit(4), F.floor((F.col("n_pages") + 1) / 2))) & (best["votes"] >= runner + 3)
    return top.join(pages, book).where(enough).select(book, (-best["o"]).alias("offset"), best["votes"].alias("votes"))


def upper_median_of(values: Column) -> Column:
    return F.array_sort(F.collect_list(values))[F.floor(F.count(values) / 2).cast("int")]


def review_findings(chapters: DataFrame, book: str) -> DataFrame:
    """(book, finding, n): what looks odd about a split. chapters: (book, n, title, body)."""
    sized = chapters.select(book, "n", "title", F.length("body").alias("size"))
    agg = sized.groupBy(book).agg(
        F.count("*").alias("chapters"),
        F.count_if(F.col("size") > 0).alias("filled"),
        F.max("size").alias("largest"),
        upper_median_of(F.when(F.col("size") > 0, F.col("size"))).alias("median"),
        F.count_if(strip(F.col("title")).rlike(NUMBER_ONLY)).alias("numeric"),
        F.count_if((F.col("n") > 0) & (F.col("size") < SHELL)).alias("shells"),
        F.count_if(strip(F.col("title")).rlike(BACK_MATTER)).alias("back"),
    )
    uneven = (F.col("filled") >= 3) & (F.col("largest") > UNEVEN * F.col("median"))
    told = lambda when, name, n: F.when(when, F.struct(F.lit(name).alias("finding"), F.col(n).cast("long").alias("n")))
    findings = F.array_compact(
        F.array(
            told(uneven, "uneven", "largest"),
            told(F.col("chapters") <= FEW, "few", "chapters"),
            told(F.col("numeric") > 0, "numeric_titles", "numeric"),
            told(F.col("shells") > 0, "shells", "shells"),
            told(F.col("back") > 0, "back_matter", "back"),
        )
    )
    return agg.select(book, F.explode(findings).alias("f")).select(book, "f.finding", "f.n")


def split_diagnosis(chapters: DataFrame, book: str) -> DataFrame:
    """(book, n, finding): sizes far from the median, and chapters in which another chapter's title stands.

    A chapter is one row, so the titles of a book (a bounded list) are joined to its chapters as one array.
    """
    sized = chapters.withColumn("size", F.length("body"))
    medians = sized.where("size > 0").groupBy(book).agg(upper_median_of(F.col("size")).alias("median"), F.count("*").alias("k"))
    titles = chapters.groupBy(book).agg(F.collect_list(F.struct("n", F.lower(compact(F.col("title"))).alias("t"))).alias("titles"))
    joined = sized.join(medians, book).join(titles, book)
    body = F.lower(compact(F.col("body")))
    foreign = F.filter("titles", lambda x: (x["n"] != F.col("n")) & (F.length(x["t"]) >= 4) & F.contains(body, x["t"]))
    found = F.array_compact(
        F.array(
            F.when((F.col("k") >= 3) & (F.col("size") > 2.2 * F.col("median")), "too_long"),
            F.when((F.col("k") >= 3) & (F.col("size") < 0.15 * F.col("median")), "too_short"),
            F.when(F.size(foreign) > 0, "holds_other_title"),
        )
    )
    return joined.select(book, "n", F.explode(found).alias("finding"))


def page_of_offsets(pages: DataFrame, book: str, page: str, text: str, step: int) -> DataFrame:
    """(book, offset, page): the page on which every ``step``-th character of a book stands.

    Each page lists the offsets that fall inside it, so the as-of lookup needs no join.
    """
    w = Window.partitionBy(book).orderBy(page)
    sized = pages.select(book, page, F.length(text).alias("size"))
    placed = sized.withColumn("end", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    first = (F.ceil(F.col("start") / step) * step).cast("long")
    offsets = F.when(first < F.col("end"), F.sequence(first, F.col("end") - 1, F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    return placed.select(book, F.explode(offsets).alias("offset"), page)


def min_gap(positions: DataFrame, group: str, position: str, gap: int) -> DataFrame:
    """(group, position) kept greedily: each at least ``gap`` after the last one kept. Repeated positions count once."""

    def start():
        last = None

        def keep(row: dict) -> bool:
            nonlocal last
            if last is not None and row[position] - last < gap:
                return False
            last = row[position]
            return True

        return keep

    return kept_in_order(positions.select(group, position).where(F.col(position).isNotNull()).distinct(), group, position, start)


# ---- edits on a split ---------------------------------------------------------------------------------------------


def renumbered(chapters: DataFrame, book: str) -> DataFrame:
    """Chapters with gapless numbers in their order; a lead chapter 0 stays 0."""
    w = Window.partitionBy(book).orderBy("n")
    number = F.row_number().over(w) - F.max(F.when(F.col("n") == 0, 1).otherwise(0)).over(Window.partitionBy(book))
    return chapters.withColumn("n", number.cast("int"))


def merged_up(chapters: DataFrame, book: str, at: int) -> DataFrame:
    """Chapter ``at`` of every book joined to the one before it, then renumbered."""
    target = F.when(F.col("n") == at, F.col("n") - 1).otherwise(F.col("n"))
    parts = chapters.withColumn("_to", target).groupBy(book, "_to").agg(
        F.array_sort(F.collect_list(F.struct("n", "title", "body"))).alias("p")
    )
    joined = parts.select(book, F.col("_to").alias("n"), F.col("p")[0]["title"].alias("title"), F.array_join(F.transform("p", lambda x: x["body"]), "\n").alias("body"))
    return renumbered(joined, book)


def split_chapter(chapters: DataFrame, book: str, at: int, offset: int, title: str) -> DataFrame:
    """Chapter ``at`` of every book cut at ``offset``, its second part under ``title``, then renumbered; bodies in a row stay as they are."""
    inside = (F.col("n") == at) & (F.length("body") > offset) & (F.lit(offset) > 0)
    here = F.struct(F.col("title"), F.when(inside, F.substring("body", 1, offset)).otherwise(F.col("body")).alias("body"), F.lit(0).alias("part"))
    rest = F.struct(F.lit(title).alias("title"), F.expr(f"substring(body, {offset + 1})").alias("body"), F.lit(1).alias("part"))
    cut = chapters.select(book, "n", F.explode(F.when(inside, F.array(here, rest)).otherwise(F.array(here))).alias("c"))
    w = Window.partitionBy(book).orderBy("n", "c.part")
    lead = F.max(F.when(F.col("n") == 0, 1).otherwise(0)).over(Window.partitionBy(book))
    return cut.select(book, (F.row_number().over(w) - lead).cast("int").alias("n"), "c.title", "c.body")


def changed_bodies(before: DataFrame, after: DataFrame, book: str) -> DataFrame:
    """(book, n) of chapters whose body is new or other than before: what is derived from them must be made again."""
    keyed = lambda df: df.select(book, "n", F.sha2("body", 256).alias("h"))
    return keyed(after).join(keyed(before), [book, "n", "h"], "left_anti").select(book, "n")
