"""All named queries of the document-analytics operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators import quality
from quirefold.operators.language import with_language
from quirefold.plans import bookkeeping, books, expected, formats, language, pages, texts, work, workspace
from quirefold.sources.tables import read

_PARTS = [language, pages, work, books, texts, formats, bookkeeping, workspace]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _part in _PARTS:
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
ORACLES |= {_name: expected.oracle(_name) for _name in expected.EXPECTED}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verified quotations with the language and the token health of the documents they stand in."""
    docs = read(spark, sf_dir, "documents", ["doc_id", "text"])
    told = with_language(docs, "text").select("doc_id", "language", quality.token_health(F.col("text")).alias("long_share"))
    return QUERIES["quote_verification"](spark, sf_dir).join(told, "doc_id").orderBy("item_id", "doc_id")
