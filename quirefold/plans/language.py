"""Queries on scripts and languages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import scripts
from quirefold.operators import language
from quirefold.sources.tables import read


def script_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    counts = scripts.script_counts(F.col("text"))
    made = docs.select("doc_id", *[c.cast("long").alias(f"n_{n}") for n, c in counts.items()])
    letters = sum((F.col(f"n_{n}") for n in counts), F.lit(0))
    return made.withColumn("latin_share", F.when(letters > 0, F.col("n_latin") / letters).otherwise(0.0))


def lang_detect_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    return language.with_language(docs, "text").select("doc_id", "language")


def lang_detect_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quirefold.sources import fixtures

    return language.with_language(fixtures.frame(spark, "lang_samples"), "text", confidence="confidence").select(
        "sample_id", "language", (F.col("confidence") > 0).alias("sure")
    )


def lang_detect_book(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["source", "doc_id", "text"])
    return language.book_language(docs, "source", "doc_id", "text")


def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", ["source", "doc_id"])
    return language.even_sample(docs, "source", "doc_id", 8).select("source", "doc_id", "place", "n_rows")


def _count(text: str, chars: str) -> str:
    return f"(length({text}) - length(regexp_replace({text}, '[{chars}]', '', 'g')))"


def detect_sql(source: str, key: str, text: str) -> str:
    """CTEs ``scored`` and ``detected(key, language, top, second)`` over ``source``."""
    counts = ", ".join(f"{_count('s', c)} AS {n}" for n, c in scripts.SCRIPTS.items())
    letters = " + ".join(scripts.SCRIPTS)
    scores = []
    for at, (code, listed) in enumerate(scripts.FUNCTION_WORDS.items()):
        words = ", ".join(f"'{w}'" for w in listed.split())
        bonus = f"{_count('low', scripts.LETTER_HINTS[code])} / n" if code in scripts.LETTER_HINTS else "0.0"
        scores.append(f"{{'score': len(list_filter(w, lambda x: x IN ({words}))) / n + least({bonus}, {scripts.MOST_BONUS}), 'rank': {-at}, 'code': '{code}'}}")
    one = " ".join(f"WHEN {s} / letters >= 0.5 THEN '{c}'" for s, c in scripts.ONE_SCRIPT)
    return f"""
sampled AS (SELECT {key} AS k, substring(coalesce({text}, ''), 1, {scripts.SAMPLE_CHARS}) AS s FROM {source}),
worded AS (SELECT *, lower(s) AS low, regexp_extract_all(lower(s), '[a-zà-ÿā-ž]+') AS w, {counts} FROM sampled),
sized AS (SELECT *, len(w) AS n, {letters} AS letters FROM worded),
scored AS (SELECT *, CASE WHEN n >= {scripts.LEAST_WORDS} THEN list_sort([{', '.join(scores)}], 'DESC') END AS ranked FROM sized),
detected AS (SELECT k, letters, ranked[1].score AS top, CASE WHEN letters = 0 THEN '' WHEN hangul / letters >= {scripts.KOREAN_SHARE} THEN 'ko'
  WHEN (kana + han) / letters >= 0.3 AND kana >= greatest(8.0, (kana + han) * 0.05) THEN 'ja' WHEN (kana + han) / letters >= 0.3 THEN 'zh'
  {one} WHEN latin / letters >= 0.5 THEN CASE WHEN ranked[1].score > 0 THEN ranked[1].code ELSE 'en' END ELSE '' END AS language FROM scored)"""


def _profile_sql() -> str:
    counts = ", ".join(f"CAST({_count('text', c)} AS BIGINT) AS n_{n}" for n, c in scripts.SCRIPTS.items())
    letters = " + ".join(f"n_{n}" for n in scripts.SCRIPTS)
    return f"SELECT *, CASE WHEN {letters} > 0 THEN n_latin / ({letters}) ELSE 0.0 END AS latin_share FROM (SELECT doc_id, {counts} FROM documents)"


def _samples_sql() -> str:
    from quirefold.sources import fixtures

    return f"""WITH {fixtures.cte('lang_samples')}, {detect_sql('lang_samples', 'sample_id', 'text')}
SELECT k AS sample_id, language, CASE WHEN language = '' THEN false WHEN language IN ('ko', 'ja', 'zh', 'ru', 'el', 'he', 'ar') THEN true
  ELSE coalesce(top, 0) > 0 END AS sure FROM detected"""


_PLACES = """numbered AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS place,
  count(*) OVER (PARTITION BY source) AS n_rows FROM documents),
chosen AS (SELECT * FROM numbered WHERE n_rows <= {0} OR place IN (SELECT CAST(floor(i * n_rows / {0}) AS BIGINT) FROM range({0}) t(i)))"""

QUERIES = {
    "script_profile": script_profile,
    "lang_detect_documents": lang_detect_documents,
    "lang_detect_samples": lang_detect_samples,
    "lang_detect_book": lang_detect_book,
    "even_sample": even_sample,
}
ORACLES = {
    "script_profile": _profile_sql(),
    "lang_detect_documents": f"WITH {detect_sql('documents', 'doc_id', 'text')} SELECT k AS doc_id, language FROM detected",
    "lang_detect_samples": _samples_sql(),
    "lang_detect_book": f"""WITH {_PLACES.format(6)},
joined AS (SELECT source, string_agg(substring(text, 1, CAST(greatest(floor({scripts.SAMPLE_CHARS} / least(n_rows, 6)), 400) AS INT)), chr(10) ORDER BY place) AS text
  FROM chosen GROUP BY source), {detect_sql('joined', 'source', 'text')}
SELECT k AS source, language FROM detected""",
    "even_sample": f"WITH {_PLACES.format(8)} SELECT source, doc_id, CAST(place AS BIGINT) AS place, n_rows FROM chosen",
}
