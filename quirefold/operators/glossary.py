"""Glossary mining from keyword lines: canonical forms, forms to unify, terms to review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.functions.text import runs, strip

KEYWORD_LINE = r"^#([^ \t]+)[ \t]+—[ \t]+(.+)$"


def norm_key(form: Column) -> Column:
    """Case, white space and hyphens aside; forms with one key are one term."""
    return F.lower(F.regexp_replace(form, r"[ \t\n\x0B\f\r-]", ""))


def guess_language(form: Column) -> Column:
    """A hint by spelling."""
    return (
        F.when(form.rlike("[Α-Ωα-ωἀ-ῼ]"), "el")
        .when(form.rlike("[äöüÄÖÜß]") | form.rlike("(ung|heit|keit|schaft|Dasein)([^A-Za-z]|$)"), "de")
        .when(form.rlike("[éèêëàâçôîïûù]"), "fr")
        .when(form.rlike("(^|[^A-Za-z])(Dei|Deus|homo|Homo|imago|Imago|Missio|sui|ex)([^A-Za-z]|$)"), "la")
        .otherwise("en")
    )


def keyword_pairs(lines: DataFrame, heading: str = "## Keywords") -> DataFrame:
    """(path, term, form): keywords with the original in parentheses behind them.

    lines: (path, pos, line). Only lines of the keyword section count, which ends at the next heading; the words
    right before the parenthesis must end in the keyword.
    """
    w = Window.partitionBy("path").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = F.when(F.col("line").startswith("## "), F.col("line") == heading)
    inside = lines.withColumn("inside", F.last(opened, True).over(w)).where(F.col("inside") & ~F.col("line").startswith("## "))
    term = F.regexp_extract(strip(F.col("line")), KEYWORD_LINE, 1)
    gloss = F.regexp_extract(strip(F.col("line")), KEYWORD_LINE, 2)
    found = inside.select("path", "pos", term.alias("term"), gloss.alias("gloss")).where("term != ''")
    each = found.select("path", "pos", "term", F.posexplode(F.regexp_extract_all("gloss", F.lit(r"[^()]*\([^()]*\)"), F.lit(0))).alias("at", "piece"))
    head = F.regexp_replace(F.regexp_extract("piece", r"^([^()]*)\(", 1), r"[ \t]", "")
    form = strip(F.regexp_extract("piece", r"\(([^()]*)\)", 1))
    fits = each.select("path", "pos", "term", "at", head.alias("head"), form.alias("form")).where(F.col("head").endswith(F.col("term")))
    return fits.groupBy("path", "pos", "term").agg(F.min_by("form", "at").alias("form")).drop("pos")


def groups(pairs: DataFrame) -> DataFrame:
    """(term, key, canonical, lang, n, n_forms): per term and key the most frequent form, the lower-case one on a tie."""
    forms = pairs.groupBy("term", "form").agg(F.count("*").alias("n")).withColumn("key", norm_key(F.col("form")))
    rank = F.struct(F.col("n"), (F.col("form") == F.lower("form")).alias("is_lower"), F.col("form"))
    out = forms.groupBy("term", "key").agg(F.max_by("form", rank).alias("canonical"), F.sum("n").alias("n"), F.count("*").alias("n_forms"))
    return out.withColumn("lang", guess_language(F.col("canonical")))


def unify_targets(pairs: DataFrame) -> DataFrame:
    """(term, form, canonical, n): forms that differ from the canonical one in case, space or hyphens only."""
    forms = pairs.groupBy("term", "form").agg(F.count("*").alias("n")).withColumn("key", norm_key(F.col("form")))
    return forms.join(groups(pairs).select("term", "key", "canonical"), ["term", "key"]).where("form != canonical").select("term", "form", "canonical", "n")


def acronym(form: Column) -> Column:
    """First letters of a form of two or more words, else ''."""
    words = runs(form, "A-Za-zÀ-ÿ")
    return F.when(F.size(words) > 1, F.lower(F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), ""))).otherwise("")


def _faces(form: Column) -> Column:
    """(keys, acronyms) of the comma-separated parts of a form."""
    parts = F.filter(F.transform(F.split(form, ","), strip), lambda p: p != "")
    return F.struct(F.transform(parts, norm_key).alias("keys"), F.filter(F.transform(parts, acronym), lambda a: a != "").alias("short"))


def review_targets(pairs: DataFrame) -> DataFrame:
    """(term, n_groups, n, benign): terms with several originals; benign if all are short for the most frequent one."""
    g = groups(pairs).groupBy("term").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "canonical", "n"))).alias("g")).where(F.size("g") > 1)
    first = _faces(F.col("g")[0]["canonical"])
    g = g.withColumn("first", first)
    same = lambda x: (
        F.arrays_overlap(F.col("first.keys"), _faces(x["canonical"])["keys"])
        | F.arrays_overlap(F.col("first.keys"), _faces(x["canonical"])["short"])
        | F.arrays_overlap(F.col("first.short"), _faces(x["canonical"])["keys"])
    )
    benign = F.forall(F.slice("g", 2, F.size("g")), same)
    return g.select("term", F.size("g").cast("long").alias("n_groups"), F.aggregate("g", F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), benign.alias("benign"))


def hints(texts: DataFrame, pairs: DataFrame, key: str, text: str, most: int = 25) -> DataFrame:
    """(key, place, term, canonical): settled terms that stand in a text, the most frequent ``most`` of them."""
    g = groups(pairs)
    single = g.groupBy("term").agg(F.count("*").alias("k"), F.first("canonical").alias("canonical"), F.sum("n").alias("n")).where("k = 1")
    words = texts.select(key, F.explode(F.array_distinct(runs(F.lower(text), "a-z가-힣"))).alias("term"))
    found = words.join(single.where(F.length("term") >= 2), "term")
    w = Window.partitionBy(key).orderBy(F.col("n").desc(), "term")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(key, "place", "term", "canonical")
