"""What the training-data operators share: the shared scratch folder, stored intermediate tables and row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.session import fresh_path, ship

#: Rows of a narrow table (ids, digests, counts) that one sort task takes.
ROWS_PER_SORT_TASK = 500_000
#: A table of at most so many narrow rows may be broadcast, after they have been counted.
BROADCAST_ROWS = 100_000
#: The same for rows that hold arrays: so many array elements (words or numbers) in all rows together.
BROADCAST_ELEMENTS = 2_000_000

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs nothing before it.

    The files go when the session ends.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(at)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns an operator needs, beside all columns of ``docs`` in ``_doc``, where their names can't clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    return docs.select(whole, *needed)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. Texts that are plain ASCII take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, ASCII_UPPER, ASCII_LOWER)
    )


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its counted rows stay under ``limit``; beyond it Spark shuffles both sides."""
    return F.broadcast(df) if rows <= limit else df


def maybe_broadcast_arrays(df: DataFrame, elements: Column) -> DataFrame:
    """Broadcast ``df``, whose rows vary in size, only when all its array elements together are few."""
    total = df.agg(F.sum(elements.cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(df) if total <= BROADCAST_ELEMENTS else df


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Prepare Python functions over whole texts: the package is on the executors, and batches of long texts fit a worker."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows:
        spark.conf.set(name, str(rows))


def numbered(df: DataFrame, order: list[str], rows: int, name: str = "row_no") -> tuple[DataFrame, int]:
    """Append a gapless 0-based row number in the order of ``order``, without a single-task window.

    Rows are range partitioned and sorted, the place inside a partition comes from monotonically_increasing_id,
    and the partitions' first numbers are sums over one count per partition. The sorted rows are stored between
    the two steps, so both see the same partition bounds even if tasks run again. ``df`` should be narrow.
    Equal rows may change places with each other; nothing else can.
    """
    parts = max(1, math.ceil(rows / ROWS_PER_SORT_TASK))
    ordered = stored(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    )
    counts = sorted(
        (r["part"], r["n"]) for r in ordered.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()
    )
    first, starts = 0, []
    for part, n in counts:
        starts.append((part, first))
        first += n
    spark = df.sparkSession
    firsts = spark.createDataFrame(starts or [(0, 0)], "_part long, _first long")  # one row per sort partition
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    out = (
        ordered.withColumn("_part", F.shiftright("_at", 33))
        .join(maybe_broadcast(firsts, len(starts)), "_part")
        .withColumn(name, F.col("_first") + inside)
        .drop("_part", "_first", "_at")
    )
    return out, first
