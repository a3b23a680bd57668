import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from quirefold.llm import queries, sharding


def _xx(*longs):
    """Spark's xxhash64 of longs, as a signed 64-bit number."""
    h = 42
    for x in longs:
        h = xxhash.xxh64_intdigest(struct.pack("<q", x), h)
    return h - (1 << 64) if h >> 63 else h


def _permuted(i, n, seed):
    a, b = sharding.sides(n)
    keys = sharding.round_keys(seed)
    left, right = divmod(i, b)
    while True:
        for r in range(sharding.ROUNDS):
            if r % 2 == 0:
                left = (left + _xx(keys[r], right) % a) % a
            else:
                right = (right + _xx(keys[r], left) % b) % b
        if left * b + right < n:
            return left * b + right


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 97, 1000, 1023])
def test_the_permutation_is_one_and_is_the_plain_one(spark, n):
    got = {r["id"]: r["p"] for r in spark.range(n).select("id", sharding.permuted(F.col("id"), n, 7).alias("p")).collect()}
    assert sorted(got.values()) == list(range(n))
    assert all(got[i] == _permuted(i, n, 7) for i in range(n))


def test_another_seed_is_another_permutation(spark):
    order = lambda seed: [r["p"] for r in spark.range(500).select("id", sharding.permuted(F.col("id"), 500, seed).alias("p")).orderBy("id").collect()]
    assert order(7) != order(8) and order(7) == order(7)


def test_the_query_keeps_the_law_of_rows(spark, sf_dir):
    rows = queries.op1_sharding(spark, sf_dir).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    by = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        by.setdefault(r["shard"], []).append(r["slot"])
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    place = {d: _permuted(i, len(texts), 7) for i, d in enumerate(sorted(texts))}
    assert all((r["shard"], r["slot"]) == (place[r["doc_id"]] % 16, place[r["doc_id"]] // 16) for r in rows)


def test_nulls_repeats_and_empty_tables(spark):
    keys = spark.createDataFrame([(None, 1), (3, 1), (3, 1), (2, None)], "doc_id long, row_size int")
    rows = sharding.shard_rows(keys, ["doc_id", "row_size"], 3).collect()
    assert sorted(r["row_no"] for r in rows) == [0, 1, 2, 3]
    assert next(r for r in rows if r["doc_id"] is None)["row_no"] == 0
    assert len({(r["shard"], r["slot"]) for r in rows}) == 4
    assert sharding.shard_rows(keys.where("false"), ["doc_id"], 3).collect() == []
