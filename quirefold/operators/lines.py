"""Printed lines to paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import SPACE, filled_lines, strip

SHORT_LINE = 0.9
PARAGRAPH, SPACED, ASK = "P", "S", "?"
HEADING_SHARE = 0.55


def upper_median(values: Column) -> Column:
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def break_kinds(lines: Column) -> Column:
    """What to do at each break between the lines: P after a short line, ? between two word characters, else S."""
    median = upper_median(F.transform(lines, F.length))
    kind = lambda i: (
        F.when(F.length(F.get(lines, i)) < median * SHORT_LINE, PARAGRAPH)
        .when(F.get(lines, i).rlike("[0-9A-Za-z가-힣]$") & F.get(lines, i + 1).rlike("^[0-9A-Za-z가-힣]"), ASK)
        .otherwise(SPACED)
    )
    return F.when(F.size(lines) >= 2, F.transform(F.sequence(F.lit(0), F.size(lines) - 2), kind)).otherwise(F.array().cast("array<string>"))


def line_plan(docs: DataFrame, text: str) -> DataFrame:
    """Append ``lines`` and ``kinds``."""
    return docs.withColumn("lines", filled_lines(F.col(text))).withColumn("kinds", break_kinds(F.col("lines")))


def rendered(lines: Column, kinds: Column) -> Column:
    """The text of lines joined as ``kinds`` says: P a blank line, J nothing, anything else a space.

    No character but white space is added or lost, whatever the kinds are.
    """
    joint = lambda k: F.when(k == PARAGRAPH, "\n\n").when(k == "J", "").otherwise(" ")
    rest = F.transform(kinds, lambda k, i: F.concat(joint(k), F.get(lines, i + 1)))
    return F.when(F.size(lines) > 0, F.concat(lines[0], F.array_join(rest, ""))).otherwise("")


def reflowed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, paragraph_no, paragraph): lines joined to paragraphs at blank lines, with standing headings apart.

    A hyphen at a line end goes when a lower-case letter follows and stays otherwise. In texts with hardly any
    Hangul, a short capitalised line between a closed sentence and a capital or a digit is a paragraph of its own.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    out = docs.select(F.col(key), whole.alias("_t"))
    widths = F.transform(filled_lines(F.col("_t")), F.length)
    out = out.withColumn("_w", F.array_sort(widths))
    half = F.floor(F.size("_w") / 2).cast("int")
    median = F.when(F.size("_w") == 0, 0.0).when(F.size("_w") % 2 == 1, F.get("_w", half)).otherwise((F.get("_w", half - 1) + F.get("_w", half)) / 2)
    hangul = F.length("_t") - F.length(F.regexp_replace("_t", "[가-힣]", ""))
    out = out.withColumn("_median", F.when(hangul / F.greatest(F.length("_t"), F.lit(1)) > 0.15, 0.0).otherwise(median))
    blocks = out.select(key, "_median", F.posexplode(F.split("_t", "\n[ \t]*\n")).alias("block", "b"))
    blocks = blocks.withColumn("rows", filled_lines(F.col("b"))).where(F.size("rows") > 0)

    def heading(i: Column) -> Column:
        row, before, after = F.get("rows", i), F.get("rows", i - 1), F.get("rows", i + 1)
        closed = strip(F.regexp_replace(before, "([.?!”\"’'])[0-9]{1,3}[ ]*$", "$1")).rlike("[.?!”\"’':]$")
        return F.coalesce(
            (F.col("_median") > 0) & (i > 0) & (i < F.size("rows") - 1)
            & F.length(row).between(2, F.col("_median") * HEADING_SHARE)
            & ~row.rlike("[가-힣]") & ~row.rlike("[.,;:]$") & row.rlike("^\\p{Lu}") & after.rlike("^[\\p{Lu}0-9]")
            & ~row.rlike("(?i)^(keywords?|cover|doi|isbn|issn|copyright|editors?|translated)\\b")
            & ~row.rlike(f"\\([0-9]{{4}}\\)|[0-9]+{SPACE}*[–-]{SPACE}*[0-9]+|^[^ ]+\\.{SPACE}*[0-9]")
            & closed,
            F.lit(False),
        )

    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("buf"))

    def step(acc: Column, i: Column) -> Column:
        row, buf = F.get("rows", i), acc["buf"]
        flushed = F.when(buf == "", acc["done"]).otherwise(F.array_append(acc["done"], buf))
        hyphen = F.when(row.rlike("^\\p{Ll}"), F.concat(F.substring(buf, F.lit(1), F.length(buf) - 1), row)).otherwise(F.concat(buf, row))
        joined = F.when(buf == "", row).when(buf.endswith("-"), hyphen).otherwise(F.concat(buf, F.lit(" "), row))
        return F.when(heading(i), F.struct(F.array_append(flushed, row).alias("done"), F.lit("").alias("buf"))).otherwise(
            F.struct(acc["done"].alias("done"), joined.alias("buf"))
        )

    end = lambda acc: F.when(acc["buf"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["buf"]))
    paragraphs = F.aggregate(F.sequence(F.lit(0), F.size("rows") - 1), start, step, end)
    each = blocks.select(key, "block", F.posexplode(paragraphs).alias("in_block", "paragraph"))
    return each.select(key, "block", "in_block", "paragraph")
