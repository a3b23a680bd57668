"""Page furniture: lines that repeat over the pages of a book.

A book is a group of pages, a page a row with a text. Everything is counted with grouped sums over (book, key), so a
line that stands on most pages costs one partial sum in each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import SPACE, filled_lines, strip, tokens
from quirefold.session import stored

EDGE_SHARE, EDGE_LEAST = 2, 3
HEADER_SHARE, HEADER_LEAST, HEADER_EDGE, HEADER_MOST = 0.2, 3, 3, 80
#: So many repeated lines are broadcast, after they have been counted.
BROADCAST_ROWS = 200_000
HEAD_WORDS, GRAM_WORDS, HEAD_LEAST = 12, 8, 3


def no_digits(line: Column) -> Column:
    """A line without its digits, so that page numbers don't tell copies of it apart."""
    return strip(F.regexp_replace(line, "[0-9]+", ""))


def edges(lines: Column, most: int) -> Column:
    """The first and the last ``most`` lines; on a short page a line is in both."""
    size = F.size(lines)
    return F.concat(F.slice(lines, 1, most), F.slice(lines, F.greatest(size - most + 1, F.lit(1)), F.least(size, F.lit(most))))


def edge_furniture(pages: DataFrame, book: str, text: str) -> DataFrame:
    """(book, key, n): digit-free edge lines that stand on about half of the pages of a book."""
    sizes = pages.groupBy(book).agg(F.count("*").alias("n_pages"))
    counted = (
        pages.select(book, F.explode(edges(filled_lines(F.col(text)), 2)).alias("line"))
        .select(book, no_digits(F.col("line")).alias("key"))
        .groupBy(book, "key")
        .agg(F.count("*").alias("n"))
    )
    enough = F.col("n") >= F.greatest(F.lit(EDGE_LEAST), F.floor(F.col("n_pages") / EDGE_SHARE))
    return counted.join(sizes, book).where(enough & F.length("key").between(1, 89)).select(book, "key", "n")


def is_vertical_noise(line: Column) -> Column:
    """Rotated text: six or more tokens of hardly more than one character."""
    toks = tokens(line)
    size = F.size(toks)
    chars = F.aggregate(toks, F.lit(0), lambda a, t: a + F.length(t))
    return (size >= 6) & (chars / F.when(size > 0, size) <= 1.3)


def repeated_lines(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """(book, page, line_no, mark, kept) of the lines that count as furniture.

    Lone page numbers and rotated text are never kept. Of a repeated line the first in the book is kept, as it is
    the real title that later pages repeat.

    The texts are read three times: for counts by digit-free line, of which most stand once and go; for the lines
    behind the others; and for the answer.
    """
    filled = F.filter(F.transform(F.split(F.coalesce(F.col(text), F.lit("")), "\n"), lambda x, i: F.struct(i.alias("line_no"), strip(x).alias("s"))), lambda x: x["s"] != "")
    lines = pages.select(book, page, filled.alias("_l")).select(book, page, F.size("_l").alias("_n"), F.posexplode("_l").alias("_k", "_x"))
    at_edge = (F.col("_k") < 2).cast("int") + (F.col("_k") >= F.col("_n") - 2).cast("int")
    lines = lines.select(book, page, "_x.line_no", "_x.s", at_edge.alias("at_edge"))
    keyed = lines.withColumn("key", no_digits(F.col("s")))
    sizes = pages.groupBy(book).agg(F.count("*").alias("n_pages"))
    often = keyed.groupBy(book, "key").agg(F.count("*").alias("n"), F.sum("at_edge").alias("n_edge")).where("n >= 3 or n_edge >= 3")
    size = F.length("key")
    edge = F.col("n_edge") >= F.greatest(F.lit(EDGE_LEAST), F.floor(F.col("n_pages") / EDGE_SHARE))
    by_key = (edge & size.between(11, 89)) | ((size > 40) & (F.col("n") >= 3))
    often = stored(often.join(sizes, book).select(book, "key", by_key.alias("by_key")), "repeated-keys")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    exact = keyed.join(few(often), [book, "key"]).groupBy(book, "s", "key", "by_key").agg(F.count("*").alias("n"), F.min(F.struct(page, "line_no")).alias("first"))
    plain = lambda s: ~(s.rlike("^[0-9]{1,4}$") | is_vertical_noise(s))
    marks = exact.where((F.col("by_key") | ((F.length("s") < 90) & (F.col("n") >= 3))) & plain(F.col("s")))
    marks = stored(marks.select(book, "s", F.when(F.col("by_key"), F.col("key")).otherwise(F.col("s")).alias("mark"), "first"), "repeated-lines")
    first = marks.groupBy(book, "mark").agg(F.min("first").alias("first"))
    marks = stored(marks.drop("first").join(first, [book, "mark"]).select(book, "s", "mark", "first"), "marked-lines")
    found = lines.join(few(marks), [book, "s"], "left").where(F.col("mark").isNotNull() | ~plain(F.col("s")))
    kept = F.coalesce((F.col("first")[page] == F.col(page)) & (F.col("first")["line_no"] == F.col("line_no")), F.lit(False))
    return found.select(book, page, "line_no", "mark", kept.alias("kept"))


def bare_header(line: Column) -> Column:
    """A line without a page number that stands apart from it; addresses stay whole."""
    return F.when(line.rlike("^https?://[^ ]+$"), line).otherwise(strip(F.regexp_replace(line, f"^[0-9]{{1,4}}{SPACE}+|{SPACE}+[0-9]{{1,4}}$", "")))


def book_headers(pages: DataFrame, book: str, page: str, text: str) -> DataFrame:
    """(book, header, n_pages): whole edge lines on at least a fifth of the pages, counted once a page."""
    sizes = pages.groupBy(book).agg(F.count("*").alias("total"))
    bare = F.array_distinct(F.filter(F.transform(edges(filled_lines(F.col(text)), HEADER_EDGE), bare_header), lambda h: F.length(h).between(4, HEADER_MOST)))
    counted = pages.select(book, F.explode(bare).alias("header")).groupBy(book, "header").agg(F.count("*").alias("n_pages"))
    enough = F.col("n_pages") >= F.greatest(F.lit(HEADER_LEAST), F.floor(F.col("total") * HEADER_SHARE))
    return counted.join(sizes, book).where(enough).select(book, "header", "n_pages")


def running_heads(pages: DataFrame, book: str, text: str) -> DataFrame:
    """(book, head, n_pages): the longest word groups that begin at least three pages of a book.

    Of the frequent groups those inside a longer frequent one go. Each group lists its own inner strings, and the
    lists meet the groups in an equi-join, so groups are never compared pair by pair.
    """
    words = F.col("_w")
    begun = pages.select(book, F.slice(tokens(F.col(text)), 1, HEAD_WORDS).alias("_w"))

    def grams(i: Column) -> Column:
        lengths = F.sequence(F.lit(1), F.least(F.lit(GRAM_WORDS), F.size(words) - i))
        return F.transform(lengths, lambda n: F.array_join(F.slice(words, i + 1, n), " "))

    every = F.flatten(F.transform(F.sequence(F.lit(0), F.size(words) - 1), grams))
    usable = F.array_distinct(F.filter(every, lambda g: (F.length(g) >= 4) & ~g.rlike("^[0-9]")))
    hits = (
        begun.where(F.size(words) > 0)
        .select(book, F.explode(usable).alias("head"))
        .groupBy(book, "head")
        .agg(F.count("*").alias("n_pages"))
        .where(F.col("n_pages") >= HEAD_LEAST)
    )
    size = F.length("head")
    # substrings that are shorter than the group and long enough to be one
    starts = F.sequence(F.lit(1), size - 3)
    inner = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(4), size - s + 1), lambda n: F.substring(F.col("head"), s, n))))
    inside = hits.where(size > 4).select(book, "head", F.explode(F.array_distinct(inner)).alias("part")).where("part != head").select(book, F.col("part").alias("head")).distinct()
    return hits.join(inside, [book, "head"], "left_anti")
