import itertools
import random
import re

import numpy as np
import pytest
import xxhash

from quirefold.llm import byte_postings as B, queries

W = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _fingerprint(text):
    w = W.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _components(keyed):
    """keyed: (key, fingerprint); the smallest key in reach of each key, by comparing all pairs."""
    parent = {k: k for k, _ in keyed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, f), (b, g) in itertools.combinations(keyed, 2):
        if bin(f ^ g).count("1") <= 3:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k, _ in keyed}


def test_fingerprints_equal_the_plain_definition():
    rng = random.Random(1)
    texts = [None, "", " \t", "one", "One two", "a b c", "A  b\nc d", "é b c d É"] + [" ".join(rng.choice("abcdefg") for _ in range(n)) for n in range(40)]
    got = B.fingerprints_of([None if t is None else t.encode() for t in texts]).view(np.uint64)
    assert got.tolist() == [_fingerprint(t) for t in texts]


@pytest.mark.parametrize("n", [10, 1 << 30, 1 << 40])
def test_every_five_positions_hold_a_whole_list(n):
    sets = [set(s) for s in B.position_sets(n)]
    assert all(any(s <= set(five) for s in sets) for five in itertools.combinations(range(8), 5))


def test_the_count_filter_is_the_tally_of_bytes():
    rng = random.Random(6)
    diffs = [sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(3000)]
    want = [i for i, d in enumerate(diffs) if bin(d).count("1") <= 3]
    assert B._linked(np.array(diffs, np.uint64)).tolist() == want


@pytest.mark.parametrize("cap, n", [(8192, 1), (6, 1), (8192, 1 << 30), (6, 1 << 30), (8192, 1 << 40)])
def test_edges_connect_dense_groups_whatever_the_list_cap_and_sets(spark, monkeypatch, cap, n):
    monkeypatch.setattr(B, "LIST_CAP", cap)
    rng = random.Random(cap)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(20), rng.randrange(6))))
    fps |= {rng.getrandbits(64) for _ in range(60)}
    keyed = list(enumerate(sorted(fps)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    distinct = spark.createDataFrame([(signed(f), k) for k, f in keyed], "fp long, rep long")
    roots = {r["node"]: r["root"] for r in B.components(B.near_edges(distinct, len(keyed), B.position_sets(n))).collect()}
    assert {k: roots.get(k, k) for k, _ in keyed} == _components(keyed)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 105), (103, 105)]
    rng = random.Random(3)
    rng.shuffle(edges)
    roots = {r["node"]: r["root"] for r in B.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {**{i: 0 for i in range(1, 61)}, 101: 100, 105: 100, 103: 100}


def test_the_query_equals_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], _fingerprint(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = _components(docs)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op10_simhash(spark, sf_dir).collect()}
    assert got == {k: (format(f, "016x"), want[k]) for k, f in docs}


def test_nulls_repeats_empty_texts_and_clashing_columns(spark):
    rows = [(4, "a b c d e"), (4, "other words stand in this one row here"), (7, "A b c d e"), (9, None), (8, "  "), (None, "a b c d e"), (12, "quite a different text")]
    docs = spark.createDataFrame([(k, t, "f") for k, t in rows], "doc_id long, text string, fingerprint string")
    got = [(r["doc_id"], r["component_id"]) for r in B.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == sorted([(4, 4), (4, 4), (7, 4), (9, 8), (8, 8), (None, 4), (12, 12)], key=repr)
    kept = B.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted([4, 8, 12, None], key=repr)
    assert B.near_duplicates(docs.where("false")).collect() == []


def test_rows_with_null_keys_pass_links_on(spark, monkeypatch):
    # fingerprints 0 - 7 - 63 are linked in a chain; only a row without a key has the middle one
    monkeypatch.setattr(B, "fingerprint", lambda text: text.cast("long"))
    rows = [(5, "0"), (None, "7"), (3, "63"), (None, "56"), (None, str(2**40 - 1)), (8, str(2**50 - 2**20)), (8, "1")]
    got = [(r["doc_id"], r["fp"], r["component_id"]) for r in B.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(5, 0, 3), (None, 7, 3), (3, 63, 3), (None, 56, 3), (None, 2**40 - 1, None), (8, 2**50 - 2**20, 3), (8, 1, 3)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
