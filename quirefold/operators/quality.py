"""Text health and the two-axis quality verdict of scanned Korean text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.text import SPACE, tokens

# Thresholds and patterns of the verdict.
BAD_ONE_SYLLABLE, SUSPECT_ONE_SYLLABLE = 2.0, 5.0
BAD_GARBLE, SUSPECT_GARBLE, BLOCKS, BLOCK_LEAST = 6.0, 3.0, 40, 200
LEAST_TOKENS, LEAST_HANGUL, HAN_SHARE = 500, 0.20, 0.02
GLUED = r"一-鿿a-z!@#$%^&*~`|\\/<>\[\]{}=+"
GARBLED = rf"[가-힣][{GLUED}]|[{GLUED}][가-힣]|[■□▪●◆◇♦※〓＊¤†‡]|[ㄱ-ㆎ]|[\x00-\x08\x0b\x0e-\x1f\x{{FFFD}}]"
LONG_TOKEN = 26


def token_health(text: Column) -> Column:
    """Share of tokens of 26 characters or more; 1 for a text without tokens."""
    toks = tokens(text)
    long = F.size(F.filter(toks, lambda t: F.length(t) >= LONG_TOKEN))
    return F.when(F.size(toks) > 0, long / F.size(toks)).otherwise(1.0)


def better_extraction(df: DataFrame, key: str, text: str, fallback: str) -> DataFrame:
    """(key, text, used): the fallback where the text is empty or its long-token share is over 0.03 and higher."""
    mine, other = token_health(F.col(text)), token_health(F.col(fallback))
    empty = F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE}", "")) == 0
    take = empty | ((mine > 0.03) & (other < mine))
    return df.select(key, F.when(take, F.col(fallback)).otherwise(F.col(text)).alias("text"), F.when(take, "fallback").otherwise("text").alias("used"))


def garble_rate(text: Column) -> Column:
    """Garbled places in 1,000 characters: for long texts the upper median over 40 equal blocks."""
    size = F.length(text)
    block = F.floor(size / BLOCKS).cast("int")
    count = lambda t: F.size(F.split(t, GARBLED, -1)) - 1
    rates = F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: count(F.substring(text, i * block + 1, block)) / block * 1000)
    whole = count(text) / F.greatest(size, F.lit(1)) * 1000
    return F.when(size < BLOCKS * BLOCK_LEAST, whole).otherwise(F.array_sort(rates)[BLOCKS // 2])


def assessed(df: DataFrame, text: str) -> DataFrame:
    """Append verdict, word_loss, garble, one_syllable_pct, garble_per_1k and reasons (codes, in order)."""
    count = lambda p: F.size(F.split(F.col(text), p, -1)) - 1
    out = df.withColumn(text, F.coalesce(F.col(text), F.lit("")))
    out = out.withColumn("_hangul", F.filter(tokens(F.col(text)), lambda t: t.rlike("^[가-힣]+$")))
    out = out.withColumn("_n", F.size("_hangul")).withColumn("_chars", F.length(text))
    out = out.withColumn("_applies", (F.col("_n") >= LEAST_TOKENS) & (count("[가-힣]") / F.greatest("_chars", F.lit(1)) >= LEAST_HANGUL))
    one = F.size(F.filter("_hangul", lambda t: F.length(t) == 1))
    out = out.withColumn("one_syllable_pct", F.when(F.col("_applies"), one / F.col("_n") * 100).otherwise(0.0))
    out = out.withColumn("garble_per_1k", F.when(F.col("_applies"), garble_rate(F.col(text))).otherwise(0.0))
    han = count("[一-鿿]") / F.greatest("_chars", F.lit(1))
    out = out.withColumn("_han", F.col("_applies") & (han > HAN_SHARE))
    ok, lost = count("[할될을] 수 있"), count("[할될을] 있")
    out = out.withColumn("_ok", ok).withColumn("_lost", lost)
    level = lambda value, bad, suspect, low: F.when(
        (value < bad) if low else (value >= bad), 2
    ).when((value < suspect) if low else (value >= suspect), 1).otherwise(0)
    out = out.withColumn("_a", level(F.col("one_syllable_pct"), BAD_ONE_SYLLABLE, SUSPECT_ONE_SYLLABLE, True))
    out = out.withColumn("_b", F.greatest(level(F.col("garble_per_1k"), BAD_GARBLE, SUSPECT_GARBLE, False), F.col("_han").cast("int")))
    named = lambda c: F.when(~F.col("_applies"), "unknown").when(c == 2, "bad").when(c == 1, "suspect").otherwise("ok")
    blank = F.length(F.regexp_replace(text, f"{SPACE}", "")) == 0
    worst = F.greatest("_a", "_b")
    reasons = F.array_compact(
        F.array(
            F.when(blank, "empty"),
            F.when(~blank & ~F.col("_applies"), "too_little_hangul"),
            F.when(F.col("_applies") & (F.col("_a") == 2), "words_lost"),
            F.when(F.col("_applies") & (F.col("_a") == 1), "few_one_syllable_words"),
            F.when(F.col("_applies") & (F.col("_lost") > 0) & (F.col("_ok") == 0), "su_always_dropped"),
            F.when(F.col("_applies") & (F.col("_ok") > 0) & (F.col("_lost") > F.greatest(F.lit(3), F.col("_ok"))), "su_often_dropped"),
            F.when(F.col("_applies") & (F.col("garble_per_1k") >= BAD_GARBLE), "garbled"),
            F.when(F.col("_applies") & F.col("garble_per_1k").between(SUSPECT_GARBLE, BAD_GARBLE) & (F.col("garble_per_1k") < BAD_GARBLE), "some_garble"),
            F.when(F.col("_han"), "han_mixed"),
            F.when(F.col("_applies") & (worst == 0), "fine"),
        )
    )
    return (
        out.withColumn("word_loss", named(F.col("_a")))
        .withColumn("garble", named(F.col("_b")))
        .withColumn("verdict", named(worst))
        .withColumn("reasons", F.array_join(reasons, ","))
        .drop("_hangul", "_n", "_chars", "_applies", "_han", "_ok", "_lost", "_a", "_b")
    )
