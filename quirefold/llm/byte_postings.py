"""SimHash near-duplicates through an inverted index on the bytes of the fingerprint.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 3 of their 8 bytes, so they share at least
5 (position, byte) postings: that is the guaranteed number of matches. Reading the posting lists of single bytes
would meet a 256th of all fingerprints at a time, so lists are kept for sets of k positions that any 5 of the 8
positions must contain one of: for k = 3 the eight triples inside either half of the positions, for larger
corpora k = 4 or 5. A pair met in a list is tallied over all 8 positional bytes, kept with 5 or more, and then
verified on the bits. The tally is kept per pair while a list is read, not in a table of pairs: lists of single bytes
would write n * n / 64 pairs for n fingerprints (README has the figures).

Inside a list only the edges of a spanning forest are emitted, never all pairs. A list longer than ``LIST_CAP``
is dealt to several tasks as pairs of blocks, each block pair again giving a forest only; no list is cut.
Components come from large-star / small-star rounds on the edges between the smallest document ids of the
fingerprints.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

BITS = 3
SHINGLE = 3
#: Fingerprints of a list that one task compares at once; longer lists are split into block pairs.
LIST_CAP = 8_192
ROUNDS_MOST = 60

_LOWER = bytes.maketrans(common.ASCII_UPPER.encode(), common.ASCII_LOWER.encode())


def _hashes(text: bytes) -> list[int]:
    """XXH64 of all shingles. Words joined by one space are one buffer, so a shingle is a slice of it."""
    found = text.translate(_LOWER).split()  # bytes split at space and \t to \r and nowhere else
    n = len(found)
    if n == 0:
        return []
    line = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return [digest(line, 42)]
    lengths = np.fromiter(map(len, found), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    view = memoryview(line)
    return [digest(view[s:e], 42) for s, e in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist())]


def fingerprints_of(texts: list[bytes | None]) -> np.ndarray:
    """Signed 64-bit fingerprints; null texts and texts without words have fingerprint zero."""
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        hashes = _hashes(text) if text else []
        if not hashes:
            continue
        tally = np.zeros(64, np.int64)
        for at in range(0, len(hashes), 65_536):  # keeps the unpacked bits of a very long text small
            part = np.array(hashes[at : at + 65_536], dtype=">u8")
            tally += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        bits = (2 * tally > len(hashes)).astype(np.uint8)
        out[i] = np.packbits(bits).view(">u8")[0]
    return out.view(np.int64)


@F.arrow_udf(T.LongType())
def fingerprint(texts: pa.Array) -> pa.Array:
    return pa.array(fingerprints_of(texts.cast(pa.binary()).to_pylist()), pa.int64())


def position_sets(fingerprints: int) -> list[tuple[int, ...]]:
    """Sets of byte positions of which every 5 positions contain one whole. More fingerprints, longer sets."""
    if fingerprints <= 1 << 27:
        return [s for half in (range(4), range(4, 8)) for s in itertools.combinations(half, 3)]
    if fingerprints <= 1 << 35:
        return _covering_fours()
    return list(itertools.combinations(range(8), 5))


def _covering_fours() -> list[tuple[int, ...]]:
    """All sets of 4 positions with an even number in each half: any 5 positions hold 4 such, checked in the tests."""
    return [s for s in itertools.combinations(range(8), 4) if sum(x < 4 for x in s) % 2 == 0]


def _linked(diff: np.ndarray) -> np.ndarray:
    """Count filter, then verification: pairs whose XOR leaves 5 or more bytes zero and sets at most BITS bits."""
    spread = diff | (diff >> np.uint64(4))
    spread |= spread >> np.uint64(2)
    spread |= spread >> np.uint64(1)
    unequal = np.bitwise_count(spread & np.uint64(0x0101010101010101))
    kept = np.flatnonzero(unequal <= BITS)
    return kept[np.bitwise_count(diff[kept]) <= BITS]


def _forest(fps: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges of a spanning forest of the links among ``fps``.

    A breadth-first walk: each fingerprint is compared once with those that no tree has reached yet.
    """
    left = np.arange(len(fps))
    parents: list[int] = []
    children: list[int] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            at = queue.pop()
            hits = _linked(fps[left] ^ fps[at])
            if len(hits):
                reached = left[hits].tolist()
                parents += [at] * len(reached)
                children += reached
                queue += reached
                left = np.delete(left, hits)
    return parents, children


def _list_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of each posting list; rows come sorted by list."""
    held_list, held = None, []  # the list that may go on in the next batch
    found: list[tuple[np.ndarray, np.ndarray]] = []

    def take(fps: np.ndarray, reps: np.ndarray) -> None:
        parents, children = _forest(fps)
        if parents:
            found.append((reps[parents], reps[children]))

    for batch in batches:
        lists = np.asarray(batch.column("list"))
        fps = np.asarray(batch.column("fp")).view(np.uint64)
        reps = np.asarray(batch.column("rep"))
        if not len(lists):
            continue
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(lists)) + 1, [len(lists)]))
        if held and lists[0] != held_list:
            take(np.concatenate([f for f, _ in held]), np.concatenate([r for _, r in held]))
            held = []
        starts, ends = bounds[:-1], bounds[1:]
        if held and len(starts) > 1:
            take(np.concatenate([f for f, _ in held] + [fps[: ends[0]]]), np.concatenate([r for _, r in held] + [reps[: ends[0]]]))
            held, starts, ends = [], starts[1:], ends[1:]
        inner = np.flatnonzero((ends - starts)[:-1] > 1)  # a list of one has no pair
        for s, e in zip(starts[inner].tolist(), ends[inner].tolist()):
            take(fps[s:e], reps[s:e])
        held_list = lists[-1]
        held.append((fps[starts[-1] :], reps[starts[-1] :]))
        if sum(len(a) for a, _ in found) > 50_000:
            yield _edges(found)
            found.clear()
    if held:
        take(np.concatenate([f for f, _ in held]), np.concatenate([r for _, r in held]))
    if found:
        yield _edges(found)


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["u", "v"])


def near_edges(distinct: DataFrame, n: int, sets: list[tuple[int, ...]] | None = None) -> DataFrame:
    """Edges (u, v), u < v, that connect all fingerprints within BITS bits. ``distinct`` has (fp, rep), stored."""
    sets = sets or position_sets(n)

    def list_key(at: int, positions: tuple[int, ...]) -> Column:
        mask = sum(0xFF << (8 * p) for p in positions)
        signed = mask - (1 << 64) if mask >> 63 else mask
        return F.xxhash64(F.lit(at), F.col("fp").bitwiseAND(F.lit(signed)))

    posted = distinct.select("fp", "rep", F.explode(F.array(*[list_key(i, s) for i, s in enumerate(sets)])).alias("list"))
    long = common.stored(posted.groupBy("list").agg(F.count("*").alias("n")).where(F.col("n") > LIST_CAP), "long-lists")
    n_long = long.count()
    if n_long:
        blocks = F.ceil(F.col("n") / LIST_CAP).cast("int")
        here = F.pmod(F.xxhash64(F.lit("block"), F.col("fp")), F.col("blocks")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        marked = posted.join(common.maybe_broadcast(long.select("list", blocks.alias("blocks")), n_long), "list", "left")
        dealt = (
            marked.where(F.col("blocks").isNotNull())
            .withColumn("here", here)
            .withColumn("other", other)
            .select("fp", "rep", F.xxhash64("list", F.least("here", "other"), F.greatest("here", "other")).alias("list"))
        )
        posted = marked.where(F.col("blocks").isNull()).select("fp", "rep", "list").unionByName(dealt)
    parts = max(int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n * len(sets) / 2_000_000))
    return posted.repartition(parts, "list").sortWithinPartitions("list").mapInArrow(_list_edges, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): root is the smallest node of its component.

    Large-star and small-star rounds; each round's edges are stored in the shared folder. Stars need no node with
    all its neighbours in memory: the smallest neighbour is an aggregate, and the join on a node with very many
    neighbours is one that adaptive execution splits.
    """
    edges = common.stored(edges.distinct(), "edges")
    before = None
    for _ in range(ROUNDS_MOST):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = common.stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("m").alias("u"), "v").where("u != v").distinct()
        # edges (small, big) hang on the big end now; the small star joins each node's smaller neighbours
        large = common.stored(large, "stars")
        smaller = common.stored(large.groupBy("v").agg(F.min("u").alias("m")), "stars")
        small = (
            large.join(smaller, "v")
            .select(F.explode(F.array(F.struct(F.col("m").alias("u"), F.col("v")), F.struct(F.col("m").alias("u"), F.col("u").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        edges = common.stored(small, "edges")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return nodes


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component_id) for each row of ``docs``; component_id is the smallest key that links lead to.

    Null texts, empty texts and texts without words share fingerprint zero and are linked like any other. Nodes are
    the distinct fingerprints, whatever their keys, so rows with a null key pass links on; they get a null
    component_id only when no keyed row is in reach. The fingerprints of a repeated key are joined by the shared key.
    An empty table gives an empty table. Texts of any length are hashed whole; a bit that is set in exactly half the
    hashes is 0; equal keys and fingerprints are one. Other columns of ``docs`` are left out, whatever their names.
    Near copies are found as far as the fingerprint shows them: a short text with one word changed often differs in
    more than BITS bits, and then it is no link.
    """
    common.small_batches(docs.sparkSession)
    prints = common.stored(docs.select(F.col(key).cast("long").alias("key"), fingerprint(F.coalesce(F.col(text), F.lit(""))).alias("fp")), "prints")
    distinct = common.stored(prints.groupBy("fp").agg(F.min("key").alias("least")), "distinct-prints")
    edges = near_edges(distinct.select("fp", F.col("fp").alias("rep")), distinct.count())
    twice = prints.groupBy("key").agg(F.min("fp").alias("u"), F.max("fp").alias("_most")).where("u != _most").select("key", "u")
    shared_key = prints.join(twice, "key").select("u", F.col("fp").alias("v")).where("u != v")
    roots = components(edges.unionByName(shared_key))
    placed = common.stored(
        distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "placed"
    )
    # a root's own row is not linked to it, so its key comes in beside those of the linked ones
    linked = placed.where("fp != root").groupBy("root").agg(F.min("least").alias("_linked"))
    firsts = placed.where("fp = root").join(linked, "root", "left").select("root", F.least("least", "_linked").alias("component_id"))
    firsts = common.stored(firsts, "firsts")
    labelled = common.stored(
        placed.join(common.maybe_broadcast(firsts, firsts.count()), "root").select("fp", "component_id"), "labels"
    )
    return prints.join(labelled, "fp", "left").select(F.col("key").alias(key), "fp", "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the row whose key is its component_id. Of rows repeated under one key all but one go.

    Rows with a null key stay, as nothing identifies them. Columns of ``docs`` are returned unchanged.
    """
    found = common.stored(near_duplicates(docs.select(key, text), key, text), "found")
    gone = common.stored(found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("_gone")).distinct(), "gone")
    small = common.maybe_broadcast(gone, gone.count(), 1_000_000)
    kept = common.packed(docs, key).join(small, F.col(key) == F.col("_gone"), "left_anti")
    if found.groupBy(key).count().where(f"count > 1 and `{key}` is not null").limit(1).count():
        kept = kept.where(F.col(key).isNotNull()).dropDuplicates([key]).unionByName(kept.where(F.col(key).isNull()))
    return kept.select("_doc.*")
