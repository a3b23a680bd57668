"""Benchmark decontamination on a positional inverted index of the training text.

``build_index`` stores one posting (term, document, position) for every word of every document. The index is
written in segments, one for each input task, sorted by term: building it needs no shuffle, so it grows with the
data alone and no frequent word gathers in one task. Terms are kept as their 64-bit hash; a hash that two words
share can only add candidates, since every match is verified against the words themselves.

Search goes from the rarest test terms: ``prepare_items`` takes the corpus frequency of each test word from the
index and picks the three rarest places of every window of an item. Their posting lists are shifted by the place
in the item, so that equal shifts are one alignment (document, item, diagonal), and are intersected there: at one
alignment for exact phrases, within a place of it for proximity matches (a word changed, put in or left out). What
remains is verified word by word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: Places of a window whose posting lists are intersected.
RAREST = 3
#: Places by which a word of a near match may be off its own.
SLOP = 1
#: Alignments that are gathered together, besides those within 2 * SLOP.
BAND = 16
#: Words of a document that windows are compared with at a time.
BLOCK = 1024


def words(text: Column) -> Column:
    """The runs of WORD in a lower-cased text. Splitting is ten times as fast as extracting, which copies the text for each match."""
    return F.array_remove(F.split(common.ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings ``(term, <key>, pos)`` of all words of all documents, stored in term-sorted segments."""
    postings = docs.select(F.col(key), F.posexplode(words(F.col(text))).alias("pos", "word")).select(
        F.xxhash64("word").alias("term"), key, "pos"
    )
    return common.stored(postings.sortWithinPartitions("term"), "postings")


def term_counts(index: DataFrame, terms: DataFrame) -> DataFrame:
    """Corpus frequency of the given distinct terms; only terms that occur are returned."""
    small = common.maybe_broadcast(terms, terms.count(), 1_000_000)
    return index.select("term").join(small, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))


def prepare_items(index: DataFrame, items: DataFrame, window: int = WINDOW, rarest: int = RAREST) -> DataFrame:
    """One row per item with words: its words and, for each window, the places of its rarest terms."""
    base = common.stored(
        items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), words(F.col("text")).alias("iw"))
        .distinct()
        .where(F.size("iw") > 0)
        .withColumn("item_key", F.xxhash64("item_id", "iw")),
        "items",
    )
    places = base.select("item_key", F.posexplode("iw").alias("ipos", "word")).select("item_key", "ipos", F.xxhash64("word").alias("term"))
    counts = common.stored(term_counts(index, places.select("term").distinct()), "term-counts")
    ranked = (
        places.join(counts, "term", "left")
        .groupBy("item_key")
        .agg(F.array_sort(F.collect_list(F.struct("ipos", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("toks"))
    )
    size = F.least(F.lit(window), F.size("toks"))

    def window_at(off: Column) -> Column:
        by_count = F.array_sort(F.transform(F.slice("toks", off + 1, size), lambda t: F.struct(t["n"].alias("n"), t["ipos"].alias("ipos"))))
        return F.struct(off.alias("off"), size.alias("len"), F.transform(F.slice(by_count, 1, rarest), lambda t: t["ipos"]).alias("seeds"))

    wins = F.transform(F.sequence(F.lit(0), F.size("toks") - size), window_at)
    return common.stored(base.join(ranked.select("item_key", "toks", wins.alias("wins")), "item_key"), "prepared")


def seed_alignments(index: DataFrame, prepared: DataFrame, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """Postings of the seed terms, shifted: (key, item_key, diag, ipos, least); least is the fewest seeds a match of a window has."""
    least = F.array_min(F.transform("wins", lambda w: F.size(w["seeds"]) - missing(w["len"], window)))
    seeds = prepared.select(
        "item_key", "toks", least.alias("least"), F.explode(F.array_distinct(F.flatten(F.transform("wins", lambda w: w["seeds"])))).alias("ipos")
    ).select("item_key", "ipos", "least", F.element_at("toks", F.col("ipos") + 1)["term"].alias("term"))
    seeds = common.stored(seeds, "seeds")
    small = common.maybe_broadcast(seeds, seeds.count())
    return index.join(small, "term").select(key, "item_key", (F.col("pos") - F.col("ipos")).alias("diag"), "ipos", "least")


def missing(size: Column, window: int) -> Column:
    """Words that a near match may lack: one of a whole window, none of an item that is shorter."""
    return F.when(size == window, 1).otherwise(0)


def candidates(index: DataFrame, prepared: DataFrame, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(key, item_key, start, off, len): the windows whose rarest terms, but for a missing one, meet within SLOP of an alignment.

    Alignments are gathered in bands of BAND + 2 * SLOP, which overlap by 2 * SLOP, so each alignment stands with all
    its neighbours in one band. A match that lacks one word lacks one rarest term at most, so no match is left out.
    """
    band, at = F.floor(F.col("diag") / BAND).cast("long"), F.pmod("diag", F.lit(BAND))
    both = F.when(at < 2 * SLOP, F.array(band, band - 1)).otherwise(F.array(band))
    met = (
        seed_alignments(index, prepared, key, window)
        .select(key, "item_key", "diag", "ipos", "least", F.explode(both).alias("band"))
        .groupBy(key, "item_key", "band")
        .agg(F.collect_set(F.struct("diag", "ipos")).alias("met"), F.max("least").alias("least"))
    )
    # most bands meet one seed; they go before the join
    met = met.where(F.size(F.array_distinct(F.col("met.ipos"))) >= F.col("least"))
    wins = prepared.select("item_key", "wins")
    small = common.maybe_broadcast_arrays(wins, 6 * F.size("wins"))
    around = F.flatten(F.transform("met", lambda m: F.sequence(m["diag"] - SLOP, m["diag"] + SLOP)))
    centre = F.explode(F.filter(F.array_distinct(around), lambda d: F.floor((d - SLOP) / BAND) == F.col("band"))).alias("diag")
    near = F.transform(F.filter("met", lambda m: F.abs(m["diag"] - F.col("diag")) <= SLOP), lambda m: m["ipos"])
    lacking = lambda w: F.size(F.array_except(w["seeds"], F.col("near")))
    found = met.select(key, "item_key", "met", "band", centre).select(key, "item_key", "diag", near.alias("near"))
    found = found.join(small, "item_key").select(
        key, "item_key", "diag",
        F.explode(F.filter("wins", lambda w: (F.col("diag") + w["off"] >= -SLOP) & (lacking(w) <= missing(w["len"], window)))).alias("w"),
    )
    return found.select(key, "item_key", (F.col("diag") + F.col("w.off")).alias("start"), "w.off", "w.len")


def _blocks(docs: DataFrame, found: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """(_key, _h, _b, _w): the words of the documents in ``found`` by blocks, each long enough for windows that begin in it."""
    keys = common.stored(found.select(F.col(key).alias("_key")).distinct(), "candidate-keys")
    rows = docs.select(F.col(key).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_t"))
    rows = rows.join(common.maybe_broadcast(keys, keys.count(), 1_000_000), F.col("_k").eqNullSafe(F.col("_key")), "left_semi")
    rows = common.stored(rows.distinct().select("_k", F.xxhash64("_t").alias("_h"), words(F.col("_t")).alias("_all")), "candidate-words")
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.size("_all") / BLOCK).cast("int")), lambda b: F.slice("_all", b * BLOCK + 1, BLOCK + window + 2 * SLOP))
    return rows.select(F.col("_k").alias("_key"), "_h", F.posexplode(cut).alias("_b", "_w"))


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(_key, _h, item_id, start, len, exact) of every window that stands in a document, exactly or nearly; stored.

    _h is the hash of the document's text and tells rows apart that share a key. A near match begins at ``start``
    when each of its words, but for a missing one, stands within SLOP places of its own place. Candidates stay rows
    of one window each; the words they are compared with come in blocks of bounded length, so neither a long document
    nor one that meets every item is gathered in one row.
    """
    index = build_index(docs.select(key, text), key, text)
    prepared = prepare_items(index, items, window)
    found = common.stored(candidates(index, prepared, key, window), "candidates")
    narrow = found.select(F.col(key).alias("_k"), "item_key", "start", "off", "len", F.floor(F.greatest(F.col("start") - SLOP, F.lit(0)) / BLOCK).cast("int").alias("_at"))
    small = common.maybe_broadcast(narrow, narrow.count(), 1_000_000)
    blocks = _blocks(docs, found, key, text, window)
    rows = blocks.join(small, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_at")))
    rows = rows.join(common.maybe_broadcast_arrays(prepared.select("item_key", "item_id", "iw"), F.size("iw")), "item_key")
    rel = (F.col("start") - F.col("_b") * BLOCK).cast("int")
    win = F.slice("iw", F.col("off") + 1, F.col("len"))
    here = lambda word, i: reduce(lambda a, b: a | b, [F.coalesce(F.get("_w", rel + i + j) == word, F.lit(False)) for j in range(-SLOP, SLOP + 1)])
    n_here = F.size(F.filter(F.transform(win, here), lambda x: x))
    exact = F.when(rel >= 0, F.slice("_w", rel + 1, F.col("len")) == win).otherwise(F.lit(False))
    judged = rows.select("_key", "_h", "item_id", "start", "len", exact.alias("exact"), (n_here >= F.col("len") - missing(F.col("len"), window)).alias("near"))
    # stored before the filter, which would be pushed into the join
    return common.stored(judged, "matches").where("exact or near").drop("near")


def verified(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(_key, _h, n_hit, ids, n_near) for each text with a match: words in exact windows, their items, and items that match nearly."""
    found = matches(docs, items, key, text, window)
    by_item = found.groupBy("_key", "_h", "item_id").agg(F.max("exact").alias("exact"))
    # as many ids as there are items, at most
    ids = by_item.groupBy("_key", "_h").agg(
        F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("item_id")))).alias("ids"), F.count("*").alias("n_near")
    )
    exact = found.where("exact").select("_key", "_h", "start", "len").distinct()
    places = exact.select("_key", "_h", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1)).alias("p")).distinct()
    hit = places.groupBy(F.col("_key").alias("_hk"), F.col("_h").alias("_hh")).agg(F.count("*").alias("n_hit"))
    rows = ids.join(hit, F.col("_key").eqNullSafe(F.col("_hk")) & (F.col("_h") == F.col("_hh")), "left")
    return common.stored(rows.select("_key", "_h", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), "ids", "n_near"), "hits")


def is_contaminated(n_words: Column, n_hit: Column) -> Column:
    return (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated, n_near) for each row of ``docs``.

    n_near counts the items of which a window stands in the text exactly or nearly (see ``matches``); it does not
    bear on ``contaminated``. Texts of null and texts without words have no words and are clean. Repeated rows and
    repeated keys are judged row by row on their own text. Items without words never match; items that are repeated
    count once; terms of equal frequency rank by their place. Texts of any length are searched whole. With an empty
    item table every document is clean, and an empty document table gives an empty one. Other columns of ``docs``
    are left out.
    """
    hits = verified(docs, items, key, text, window)
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key), F.xxhash64(whole).alias("_d"), F.size(words(whole)).cast("long").alias("n_words"))
    small = common.maybe_broadcast_arrays(hits, F.size("ids") + 4)
    rows = rows.join(small, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_d") == F.col("_h")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return rows.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.when(F.col("ids").isNull(), 0).otherwise(F.size("ids")).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")), 256).alias("items_sha256"),
        is_contaminated(F.col("n_words"), n_hit).alias("contaminated"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
    )


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any verified hit, with the columns of ``docs``; documents without candidates are clean.

    A stage goes further than ``contaminated`` does: a hit is a whole item window, so it is benchmark text however
    long the document around it is. Near matches alone remove nothing.
    """
    bad = common.stored(verified(docs.select("doc_id", "text"), items).where("n_hit > 0").select("_key", "_h"), "contaminated")
    rows = common.packed(docs, "doc_id", "text")
    same = F.col("doc_id").eqNullSafe(F.col("_key")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_h"))
    return rows.join(common.maybe_broadcast(bad, bad.count(), 1_000_000), same, "left_anti").select("_doc.*")
