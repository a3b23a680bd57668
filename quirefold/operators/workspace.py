"""Files of a workspace as rows: which are chapters, summaries and notes, what is still to do, and what to write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.bibliographic import safe_title

# Endings of files that are derived from a chapter.
LANGUAGES = ["ko", "en", "ja", "zh", "de", "fr", "es", "it", "pt", "nl", "ru"]
DERIVED = [*(f"_{code}" for code in LANGUAGES), "_wiki", "_bilingual", "_clean"]
#: Fields of a summary note, in their order.
SUMMARY_FIELDS = ["book", "author", "chapter", "model", "generated"]
VERDICT_ORDER = ["bad", "suspect", "ok", "unknown"]


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^./]*$", "")


def is_derived(stem: Column) -> Column:
    return F.coalesce(F.greatest(*[F.endswith(stem, F.lit(ending)) for ending in DERIVED]), F.lit(False))


def chapter_files(files: DataFrame) -> DataFrame:
    """(folder, name, n): the chapter texts among ``files`` (folder, name), by number; derived files are none."""
    number = F.regexp_extract("name", r"^([^/]{2})_[^/]*\.txt$", 1)
    return files.where((number != "") & ~is_derived(stem_of(F.col("name")))).select("folder", "name", F.expr("try_cast(substring(name, 1, 2) AS INT)").alias("n"))


def summary_files(files: DataFrame) -> DataFrame:
    """(folder, stem, name): one summary for each chapter; Markdown supersedes the older JSON form."""
    found = files.where(F.col("name").rlike(r"_wiki\.(md|json)$")).select("folder", stem_of(F.col("name")).alias("stem"), "name")
    return found.groupBy("folder", "stem").agg(F.max_by("name", F.endswith("name", F.lit(".md")).cast("int")).alias("name"))


def processed_stems(files: DataFrame, log: DataFrame) -> DataFrame:
    """(stem) of what is done: files of the output folders (name) and lines of the completion log (stem)."""
    return files.select(stem_of(F.col("name")).alias("stem")).unionByName(log.select("stem")).where("stem <> ''").distinct()


def note_candidates(files: DataFrame) -> DataFrame:
    """(path) of Markdown notes. Hidden parts and vaults inside the vault (folders that hold ``.obsidian``) are left out."""
    parts = F.split("path", "/")
    notes = files.where(F.col("path").endswith(".md") & ~F.exists(parts, lambda p: p.startswith(".") | p.startswith("_")))
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    folders = notes.where(F.size(parts) > 1).select("path", F.explode(above).alias("folder"))
    nested = files.select(F.regexp_extract("path", r"^(.+)/\.obsidian(/|$)", 1).alias("folder")).where("folder <> ''").distinct()
    return notes.select("path").join(folders.join(nested, "folder").select("path").distinct(), "path", "left_anti")


def pending(files: DataFrame, done: DataFrame, again: bool = False) -> DataFrame:
    """(name, size) of the files without a finished note, sorted with the smallest first; all of them if ``again``."""
    left = files if again else files.withColumn("stem", stem_of(F.col("name"))).join(done.select("stem").distinct(), "stem", "left_anti")
    return left.select("name", "size").orderBy("size", "name")


def quality_scan(assessed: DataFrame, key: str) -> DataFrame:
    """(key, verdict, one_syllable_pct, rank), sorted: the worst verdict first, of equal ones the texts that lost most words."""
    rank = F.array_position(F.array(*map(F.lit, VERDICT_ORDER)), F.col("verdict")).cast("int")
    return assessed.select(key, "verdict", "one_syllable_pct", rank.alias("rank")).orderBy("rank", "one_syllable_pct", key)


def chapter_writes(chapters: DataFrame, existing: DataFrame) -> DataFrame:
    """(book, name, action): what writing a split does to the files of a book.

    chapters: (book, n, title, body); existing: (book, name, body), with derived files. write: new or changed
    chapters; keep: the same text under the same name; purge: chapters that are gone, and derived files of chapters
    that are gone or have another text.
    """
    wanted = chapters.select("book", F.concat(F.lpad(F.col("n").cast("string"), 2, "0"), F.lit("_"), safe_title(F.col("title")), F.lit(".txt")).alias("name"), F.sha2("body", 256).alias("h"))
    have = existing.select("book", "name", F.sha2("body", 256).alias("old"), is_derived(stem_of(F.col("name"))).alias("derived"))
    texts = have.where("not derived").select("book", "name", "old")
    both = wanted.join(texts, ["book", "name"], "full")
    action = F.when(F.col("h").isNull(), "purge").when(F.col("h").eqNullSafe(F.col("old")), "keep").otherwise("write")
    made = both.select("book", "name", action.alias("action"))
    endings = "|".join(DERIVED)
    source = have.where("derived").select("book", "name", F.concat(F.regexp_replace(stem_of(F.col("name")), f"({endings})+$", ""), F.lit(".txt")).alias("source"))
    same = made.where("action = 'keep'").select("book", F.col("name").alias("source"))
    stale = source.join(same, ["book", "source"], "left_anti").select("book", "name", F.lit("purge").alias("action"))
    return made.unionByName(stale)


def coverage_warnings(chapters: DataFrame, sources: DataFrame, least: float = 0.6) -> DataFrame:
    """(book, share) of books whose chapters hold less than ``least`` of the characters of their source text."""
    bare = lambda c: F.length(F.regexp_replace(c, r"[ \t\n\x0B\f\r]+", ""))
    held = chapters.groupBy("book").agg(F.sum(bare("body")).alias("held"))
    share = F.coalesce("held", F.lit(0)) / F.greatest(bare("text"), F.lit(1))
    return sources.join(held, "book", "left").select("book", share.alias("share")).where(F.col("share") < least)


def summary_markdown(row: dict[str, Column], summary: Column, body: Column, prefix: str) -> Column:
    """A summary note: front matter of the fields that are not empty, the summary on one line, the body."""
    lines = F.array_compact(F.array(*[F.when(F.length(row[f]) > 0, F.concat(F.lit(f"{f}: "), row[f])) for f in SUMMARY_FIELDS if f in row]))
    one_line = F.trim(F.regexp_replace(F.coalesce(summary, F.lit("")), r"\s+", " "))
    return F.concat(
        F.lit("---\n"), F.array_join(lines, "\n"), F.lit(f"\n---\n> **{prefix}** "), one_line, F.lit("\n\n"),
        F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", "")), F.lit("\n"),
    )


def side_car(df: DataFrame, key: str) -> DataFrame:
    """(key, json): all other columns as one JSON object for each row; nulls are left out."""
    return df.select(key, F.to_json(F.struct(*[F.col(c) for c in df.columns if c != key])).alias("json"))
