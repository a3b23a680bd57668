"""Readers for the Parquet tables and for text, office and archive files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def lines(docs: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, line_no, line) for every line of every document."""
    return docs.select(*key, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("line_no", "line"))
