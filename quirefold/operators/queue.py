"""The staged work queue: event-sourced state, failure streaks, provider cool-down, content-addressed reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FAIL_STREAK = 5
COOL_DOWN_SECONDS = 3600
STALE_SECONDS = 900


def last_state(events: DataFrame, key: list[str], order: list[str], state: str) -> DataFrame:
    """(key, state, n_events): the last event of each item wins; one aggregate, no window."""
    last = F.max_by(F.col(state), F.struct(*order))
    return events.groupBy(*key).agg(last.alias("state"), F.count("*").alias("n_events"))


def queue_items(events: DataFrame) -> DataFrame:
    """(stage, item, queued_at): items whose last add is later than their last remove and the stage's last clear.

    events: (ts, event_id, stage, item, op) with op add, remove or clear; adding twice changes nothing but keeps the
    first place since the last removal.
    """
    at = F.struct("ts", "event_id")
    cleared = events.where("op = 'clear'").groupBy("stage").agg(F.max(at).alias("cleared"))
    gone = events.where("op = 'remove'").groupBy("stage", "item").agg(F.max(at).alias("gone"))
    added = events.where("op = 'add'").select("stage", "item", at.alias("at"))
    live = added.join(cleared, "stage", "left").join(gone, ["stage", "item"], "left")
    live = live.where((F.col("cleared").isNull() | (F.col("at") > F.col("cleared"))) & (F.col("gone").isNull() | (F.col("at") > F.col("gone"))))
    return live.groupBy("stage", "item").agg(F.min("at.ts").alias("queued_at"))


def islands(df: DataFrame, group: list[str], order: list[str], member: Column) -> DataFrame:
    """Number the maximal runs of rows with ``member`` in each group: column ``island``, null outside of runs."""
    w = Window.partitionBy(*group).orderBy(*order)
    breaks = F.sum(F.when(member, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("island", F.when(member, breaks))


def fail_streaks(events: DataFrame, worker: str, order: list[str], failed: Column, least: int = FAIL_STREAK) -> DataFrame:
    """(worker, first_at, last_at, n_failed) of each run of ``least`` or more failures in a row."""
    runs = islands(events, [worker], order, failed).where(F.col("island").isNotNull())
    return (
        runs.groupBy(worker, "island")
        .agg(F.min(order[0]).alias("first_at"), F.max(order[0]).alias("last_at"), F.count("*").alias("n_failed"))
        .where(F.col("n_failed") >= least)
        .drop("island")
    )


def cool_down(events: DataFrame, provider: str, ts: str, limit: Column, seconds: int = COOL_DOWN_SECONDS) -> DataFrame:
    """Append ``blocked``: a limit error of the same provider lies less than ``seconds`` before the event."""
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(provider).orderBy(micros).rangeBetween(-seconds * 1_000_000 + 1, -1)
    return events.withColumn("blocked", F.coalesce(F.max(limit).over(w), F.lit(False)))


def stale(beats: DataFrame, job: str, ts: str, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """(job, last_beat, stale) by the last heartbeat of each job."""
    last = beats.groupBy(job).agg(F.max(ts).alias("last_beat"))
    return last.withColumn("stale", F.col("last_beat") < now - F.expr(f"interval {seconds} seconds"))


def reuse(units: DataFrame, overrides: DataFrame, cache: DataFrame, legacy: DataFrame) -> DataFrame:
    """(key, src, tgt, origin): override, then cache by content key, then legacy by source text, else a miss.

    A hit counts only if its target is filled and differs from the source; the misses are the work list.
    """
    good = lambda c: F.when((F.length(F.trim(c)) > 0) & (c != F.col("src")), c)
    joined = (
        units.join(overrides.select("key", F.col("tgt").alias("_o")), "key", "left")
        .join(cache.select("key", F.col("tgt").alias("_c")), "key", "left")
        .join(legacy.select("src", F.col("tgt").alias("_l")), "src", "left")
    )
    origin = F.when(F.col("_o").isNotNull(), "override").when(good(F.col("_c")).isNotNull(), "cache").when(good(F.col("_l")).isNotNull(), "legacy").otherwise("miss")
    return joined.select("key", "src", F.coalesce("_o", good(F.col("_c")), good(F.col("_l"))).alias("tgt"), origin.alias("origin"))


def content_key(text: Column, *parts: str) -> Column:
    """SHA-256 over fixed parts and the text, in a canonical order."""
    return F.sha2(F.concat_ws("\x1f", *[F.lit(p) for p in parts], text), 256)
