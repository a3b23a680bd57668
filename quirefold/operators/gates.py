"""Checks before and after a model or a page reader: what needs no call, what may be used, and what replaces what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions import scripts
from quirefold.functions.text import compact, strip

# Thresholds and phrases.
NOISE_MOST, OWN_LEAST, LIKE_MOST, COMPARED = 80, 0.08, 0.82, 2000
ALREADY, KOREAN_BELOW, SAMPLE = 0.60, 0.30, 3000
REFUSALS = ["번역할 학술 문단을 아직 받지 못했습니다", "번역하실 텍스트", "텍스트를 붙여넣어", "원문을 제공", "본문을 보내"]
ASKS = r"(?is)(please\s+provide|send|paste).{0,80}(text|paragraph|source)|(no|not|haven't|have\s+not).{0,80}(text|paragraph|source).{0,80}(translate|received)"
NOTE_LEAST, NOTE_SHARE, READING_SHARE, SUMMARY_LEAST = 600, 0.6, 0.9, 200
WAIT_LIMIT, WAIT_OTHER, ATTEMPTS = 65, 4, 5
LIMIT_ERRORS = r"(?i)429|resource_exhausted|rate_limit|overloaded"


def is_noise(paragraph: Column) -> Column:
    """A paragraph to leave out altogether: blank, or short and nothing but numbers and marks."""
    p = strip(F.coalesce(paragraph, F.lit("")))
    return (p == "") | ((F.length(p) <= NOISE_MOST) & p.rlike(r"^[0-9\s,.\-–—%]+$"))


def already_in(paragraph: Column, code: str) -> Column:
    """Whether a paragraph is in the language ``code`` already, by the share of its script; for scripts that tell a language."""
    return F.when(strip(paragraph) == "", False).otherwise(scripts.own_share(scripts.script_counts(paragraph), code) >= ALREADY)


def needs_translation(text: Column, code: str, language: Column) -> Column:
    """Whether a text has to be translated into ``code``: Korean by its Hangul share, others by the identified language."""
    if code != "ko":
        return language != code
    sample = F.substring(text, 1, SAMPLE)
    return scripts.count_of(sample, "가-힣") / F.greatest(F.length(sample), F.lit(1)) < KOREAN_BELOW


def is_refusal(reply: Column) -> Column:
    return F.greatest(*[F.contains(reply, F.lit(p)) for p in REFUSALS]) | reply.rlike(ASKS)


def compared(source: Column, target: Column) -> tuple[Column, Column]:
    """Source and target as they are compared: on one line, without addresses and without originals in brackets."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    bare = lambda c: F.trim(F.regexp_replace(flat(c), r"https?://\S+(\s+[?.=&/#]\S+)*", ""))
    src, out = bare(source), bare(target)
    echoed = F.filter(F.regexp_extract_all(out, F.lit(r"\(([^()]{1,80})\)"), F.lit(1)), lambda m: (F.trim(m) != "") & F.contains(F.lower(src), F.lower(F.trim(m))))
    shorn = F.trim(F.aggregate(echoed, out, lambda text, m: F.regexp_replace(F.replace(text, F.concat(F.lit("("), m, F.lit(")")), F.lit("")), " +", " ")))
    return F.substring(src, 1, COMPARED), F.substring(F.when(shorn != "", shorn).otherwise(out), 1, COMPARED)


def accepted(units: DataFrame, source: str, target: str, code: str, ratio) -> DataFrame:
    """``units`` with ``accepted``: a reply in the language ``code`` that is no refusal and not the source again.

    ratio: a function of two columns, the likeness of two texts.
    """
    src, out = compared(F.col(source), F.col(target))
    made = units.withColumn("_src", src).withColumn("_out", out).withColumn("_like", ratio(F.col("_src"), F.col("_out")))
    own = scripts.own_share(scripts.script_counts(F.col("_out")), code) >= OWN_LEAST if code in scripts.OWN_SCRIPTS else F.lit(True)
    fits = (F.col("_out") != "") & ~is_refusal(F.col(target)) & own & ((F.col("_src") == "") | (F.col("_like") <= LIKE_MOST))
    return made.withColumn("accepted", F.coalesce(fits, F.lit(False))).drop("_src", "_out", "_like")


def note_kept(old: Column, new: Column) -> Column:
    """Whether an improved note may replace the old one: not much shorter, and still with sections."""
    least = F.greatest(F.lit(NOTE_LEAST), F.floor(F.length(strip(old)) * NOTE_SHARE))
    return (F.length(strip(new)) >= least) & F.contains(new, F.lit("## "))


def reading_replaces(old: Column, new: Column, found: Column) -> Column:
    """Whether a page that was read again replaces its text: notes were found and hardly anything got lost."""
    return (found > 0) & (F.length(new) >= F.length(F.coalesce(old, F.lit(""))) * READING_SHARE)


def clean_up_kept(before: Column, after: Column) -> Column:
    """Whether a clean-up of line breaks may be used: it moves white space and nothing else."""
    return compact(before).eqNullSafe(compact(after))


def summary_input(text: Column, most: int) -> Column:
    """What a summary is made of: at most ``most`` characters, null for texts too short to summarise."""
    return F.when(F.length(strip(text)) >= SUMMARY_LEAST, F.substring(strip(text), 1, most))


def next_wait(message: Column, attempt: Column) -> Column:
    """Seconds to wait after failed attempt ``attempt`` (from 1), null when it was the last."""
    return F.when(attempt < ATTEMPTS, F.when(message.rlike(LIMIT_ERRORS), WAIT_LIMIT).otherwise(WAIT_OTHER))
