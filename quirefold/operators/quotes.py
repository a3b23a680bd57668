"""Quotations: verification against sources, and the budget for how much may be quoted."""

from __future__ import annotations

import math

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quirefold.functions.arrow import mapped
from quirefold.functions.text import compact
from quirefold.operators.ordered import kept_in_order
from quirefold.session import stored

LEAST_KEY = 10
QUOTE_MOST, BUDGET_SHARE, BUDGET_LEAST = 200, 0.02, 400
#: Quotes that are searched for in one pass over the sources, and their characters together. Each worker process holds
#: the automaton, 46 bytes for a character (measured: 920 MB for 20,000,000, 184 MB for 4,000,000).
BLOCK, BLOCK_CHARS = 50_000, 4_000_000

_HITS = T.ArrayType(T.StructType([T.StructField("quote", T.IntegerType()), T.StructField("position", T.IntegerType())]))
_AUTOMATA: dict[int, tuple[list[str], ahocorasick.Automaton]] = {}


def _automaton(keys: list[str]) -> ahocorasick.Automaton:
    """Built once in a worker process for the same list of keys."""
    at = hash(tuple(keys))
    if at not in _AUTOMATA or _AUTOMATA[at][0] != keys:
        _AUTOMATA.clear()  # before the next one is built, so that there are never two
        made = ahocorasick.Automaton()
        for i, key in enumerate(keys):
            made.add_word(key, (i, len(key)))
        made.make_automaton()
        _AUTOMATA[at] = (keys, made)
    return _AUTOMATA[at][1]


def _first_places(keys: list[str]):
    kind = pa.list_(pa.struct([("quote", pa.int32()), ("position", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        if not keys:
            return pa.array([[]] * len(texts), kind)
        automaton = _automaton(keys)

        def places(text: str) -> list[tuple[int, int]]:
            first: dict[int, int] = {}
            for end, (i, size) in automaton.iter(text):
                first.setdefault(i, end - size + 1)
            return list(first.items())

        return mapped(texts, places, kind)

    return F.arrow_udf(run, _HITS)


def _selected(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the grams that are the least of some WINDOW of them in a row, the last one where several are."""
    grams = np.lib.stride_tricks.sliding_window_view(codes, LEAST_KEY) @ _WEIGHTS
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)[:, ::-1]
    # argmin copies the windows it is given, 128 bytes for each
    least = np.concatenate([windows[a : a + STRETCH].argmin(axis=1) for a in range(0, len(windows), STRETCH)])
    kept = np.unique(np.arange(len(windows)) + WINDOW - 1 - least)
    return kept.astype(np.int32), grams[kept].view(np.int64)


#: Grams in a window, of which each text keeps the least; the weights of the characters in a gram.
WINDOW = 16
_WEIGHTS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(LEAST_KEY)], np.uint64)
LEAST_ANCHORED = LEAST_KEY + WINDOW - 1
#: Windows that are compared at a time.
STRETCH = 1 << 16
_ANCHORS = T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("gram", T.LongType())]))


@F.arrow_udf(_ANCHORS)
def anchors(texts: pa.Array) -> pa.Array:
    """The anchors (place, gram) of each text. Texts that share LEAST_ANCHORED characters in a row share an anchor in them."""
    at, grams, ends = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [0]
    for scalar in texts:
        codes = np.frombuffer((scalar.as_py() or "").encode("utf-32-le"), np.uint32).astype(np.uint64)
        if len(codes) >= LEAST_ANCHORED:
            for arrays, found in zip((at, grams), _selected(codes)):
                arrays.append(found)
            ends.append(ends[-1] + len(at[-1]))
        else:
            ends.append(ends[-1])
    columns = [pa.array(np.concatenate(arrays)) for arrays in (at, grams)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, ["at", "gram"]))


def _by_automaton(keys: DataFrame, bare: DataFrame) -> DataFrame:
    """(doc_id, key, position) in one pass over the sources for all of at most BLOCK keys."""
    listed = [r["key"] for r in keys.orderBy("key").collect()]
    hits = bare.select("doc_id", F.explode(_first_places(listed)("s")).alias("h"))
    numbered = keys.sparkSession.createDataFrame(list(enumerate(listed)), "quote int, key string")
    return hits.select("doc_id", "h.quote", "h.position").join(numbered, "quote").select("doc_id", "key", "position")


def _by_anchors(keys: DataFrame, bare: DataFrame) -> DataFrame:
    """(doc_id, key, position) by an equi-join on anchors and a comparison; keys of LEAST_ANCHORED characters or more."""
    # the first window of a key has one least gram, and each source that holds the key keeps it too
    asked = keys.select("key", F.get(anchors(F.substring("key", 1, LEAST_ANCHORED)), F.lit(0)).alias("a")).select("key", F.col("a.at").alias("off"), F.col("a.gram").alias("gram"))
    kept = bare.select("doc_id", F.explode(anchors("s")).alias("a")).select("doc_id", F.col("a.at").alias("at"), F.col("a.gram").alias("gram"))
    met = kept.join(asked, "gram").select("doc_id", "key", (F.col("at") - F.col("off")).alias("position")).where("position >= 0")
    there = F.substring(F.col("s"), F.col("position") + 1, F.length("key")) == F.col("key")
    return met.join(bare, "doc_id").where(there).groupBy("doc_id", "key").agg(F.min("position").alias("position"))


def verified(quotes: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """(item_id, doc_id, position, n_chars): quotes that stand in a source, white space aside.

    quotes: (item_id, text); sources: (doc_id, text). position is the first place in the source without white space.
    Quotes under ten characters are not evidence. Up to ``block`` distinct quotes of BLOCK_CHARS characters together
    are looked for in one pass over each source text (Aho-Corasick). More meet the sources in one equi-join on
    anchors; only those too short for an anchor go on by passes, ``block`` at a time.
    """
    keyed = quotes.select("item_id", compact(F.col("text")).alias("key")).where(F.length("key") >= LEAST_KEY)
    distinct = stored(keyed.select("key").distinct(), "quotes")
    bare = sources.select("doc_id", compact(F.col("text")).alias("s"))
    size = distinct.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("key")), F.lit(0)).alias("chars")).first()
    if size["n"] <= block and size["chars"] <= BLOCK_CHARS:
        found = _by_automaton(distinct, bare)
    else:
        short = distinct.where(F.length("key") < LEAST_ANCHORED)
        found = _by_anchors(distinct.where(F.length("key") >= LEAST_ANCHORED), bare)
        parts = math.ceil(short.count() / block * 1.25)  # hashes fill parts unevenly
        for part in range(parts):
            found = found.unionByName(_by_automaton(short.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == part), bare))
    return keyed.join(found, "key").select("item_id", "doc_id", "position", F.length("key").alias("n_chars"))


def budgeted(rows: DataFrame, group: str, order: str, text: str, target: int) -> DataFrame:
    """(group, order, n_chars) of the quotes that fit: at most ``target``, none over QUOTE_MOST, and in sum within the budget.

    A quote that does not fit is passed over and uses nothing, so a running sum would be wrong: the rows of a group
    are folded in order, after their sizes have been summed.
    """
    sized = rows.select(group, F.col(order).cast("long").alias(order), F.length(text).cast("long").alias("n_chars"))
    totals = sized.groupBy(group).agg(F.sum("n_chars").alias("_total"))
    budget = F.greatest(F.lit(BUDGET_LEAST), F.floor(F.col("_total") * BUDGET_SHARE)).cast("long").alias("_budget")

    def start():
        kept = used = 0

        def keep(row: dict) -> bool:
            nonlocal kept, used
            n = row["n_chars"]
            fits = n is not None and kept < target and n <= QUOTE_MOST and used + n <= row["_budget"]
            kept, used = (kept + 1, used + n) if fits else (kept, used)
            return fits

        return keep

    asked = sized.join(totals, group).select(group, order, "n_chars", budget)
    return kept_in_order(asked, group, order, start).drop("_budget")


def length_params(df: DataFrame, chars: str, pct: int) -> DataFrame:
    """Length parameters of a note from the size of its source and the wanted share in per cent (5 to 40)."""
    pct = max(5, min(40, pct))
    out = df.withColumn("target", F.greatest(F.lit(1200 + pct * 90).cast("long"), F.floor(F.col(chars) * pct / 100)))
    out = out.withColumn("n_sub", F.greatest(F.lit(3), F.least(F.lit(24), F.bround(F.col("target") / 700))).cast("long"))
    out = out.withColumn("per_sub", F.greatest(F.lit(1).cast("long"), F.floor(F.col("target") / F.col("n_sub"))))
    out = out.withColumn("n_cite", F.greatest(F.lit(3), F.least(F.lit(14), F.bround(F.col("n_sub") * F.lit(0.7)))).cast("long"))
    out = out.withColumn("max_out", F.least(F.lit(64000), F.greatest(F.lit(6000), F.floor(F.col("target") * F.lit(2.6)))).cast("long"))
    return out.drop(chars)
