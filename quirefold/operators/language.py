"""Language identification of documents and of books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions import scripts
from quirefold.functions.text import runs


def with_language(df: DataFrame, text: str, out: str = "language", confidence: str | None = None) -> DataFrame:
    """Append the language of the first characters of ``text``: '' for blank texts and texts without letters.

    The Latin scores go through columns of their own, so that words are split once.
    """
    sample = F.substring(F.coalesce(F.col(text), F.lit("")), 1, scripts.SAMPLE_CHARS)
    low = F.lower(F.col("_sample"))
    counts = {name: F.col("_counts")[name] for name in scripts.SCRIPTS}
    made = df.withColumn("_sample", sample)
    made = made.withColumn("_counts", F.struct(*[c.alias(n) for n, c in scripts.script_counts(F.col("_sample")).items()]))
    made = made.withColumn("_words", runs(low, "a-zà-ÿā-ž"))
    enough = F.size("_words") >= scripts.LEAST_WORDS
    made = made.withColumn("_ranked", F.when(enough, F.sort_array(scripts.latin_scores(low, F.col("_words")), asc=False)))
    best = F.col("_ranked")[0]
    top, second = best["score"], F.col("_ranked")[1]["score"]
    found = F.coalesce(top > 0, F.lit(False))
    made = made.withColumn(out, scripts.detected(counts, F.when(found, best["code"]).otherwise("en")))
    if confidence:
        latin_confidence = F.when(found, F.least(F.lit(1.0), (top - second) / top + F.least(top * 2, F.lit(0.5)))).otherwise(0.0)
        letters = sum(counts.values(), F.lit(0))
        cjk = (counts["kana"] + counts["han"]) / letters
        by = {"": F.lit(0.0), "ko": counts["hangul"] / letters, "ja": cjk, "zh": cjk} | {c: counts[s] / letters for s, c in scripts.ONE_SCRIPT}
        value = latin_confidence
        for code, share in by.items():
            value = F.when(F.col(out) == code, share).otherwise(value)
        made = made.withColumn(confidence, value)
    return made.drop("_sample", "_counts", "_words", "_ranked")


def even_places(n: Column, budget: int) -> Column:
    """0-based places of at most ``budget`` evenly spread rows of ``n``."""
    spread = F.transform(F.sequence(F.lit(0), F.lit(budget - 1)), lambda i: F.floor(i * n / budget).cast("long"))
    return F.when(n > budget, F.array_distinct(spread)).otherwise(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1))


def even_sample(df: DataFrame, group: str, order: str, budget: int) -> DataFrame:
    """The rows at even places of each group (at most ``budget``), with their place ``place`` and group size ``n_rows``.

    Group sizes are counted first; places come from one window over the narrow keys, which are joined back.
    """
    keys = df.select(group, order)
    placed = keys.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long") - 1)
    sizes = keys.groupBy(group).agg(F.count("*").alias("n_rows"))
    chosen = placed.join(sizes, group).where(F.array_contains(even_places(F.col("n_rows"), budget), F.col("place")))
    return df.join(chosen, [group, order])


def book_language(pages: DataFrame, book: str, order: str, text: str, most: int = 6) -> DataFrame:
    """(book, language) from up to ``most`` evenly spread pages of each book, read as one sample."""
    chosen = even_sample(pages.select(book, order, text), book, order, most)
    per = F.greatest(F.floor(scripts.SAMPLE_CHARS / F.least(F.col("n_rows"), F.lit(most))), F.lit(400)).cast("int")
    parts = chosen.select(book, F.struct("place", F.coalesce(F.substring(F.col(text), F.lit(1), per), F.lit("")).alias("t")).alias("p"))
    # at most ``most`` short parts for each book
    joined = parts.groupBy(book).agg(F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["t"]), "\n").alias("_text"))
    return with_language(joined, "_text").select(book, "language")
