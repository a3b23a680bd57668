import io
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quirefold.llm import queries, token_sst as S

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "  A  b ", "İstanbul ẞ a\tb\n\n c²d ½ 日本語 😀 ß", "don't 'sabc !'s it's 'S x'Re ''s", "<|endoftext|> a<|startoftext|>b", "é ́a áb",
    "a\x1cb\x0bc d　e", "ÀÉ×÷ª µ", "\n\nx", "WORD.word,word!!a1b2", "naïve ÆSIR's", "tab\tonly\r\nend",
]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(FILE)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


def test_pieces_give_the_ids_of_whole_texts(plain):
    encoder = S.WordEncoder(FILE, 2)
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choice("abÉé .'!1\n t") for _ in range(60)) for _ in range(200)]
    for text, ids in zip(texts, encoder.encode(texts)):
        assert np.frombuffer(ids, encoder.kind).tolist() == plain(text), repr(text)


def test_a_shard_reads_back_and_looks_up():
    out = io.BytesIO()
    writer = S.Writer(out, 4)
    entries = {S.key_of(i * 3 - 500): np.arange(i % 50, dtype="<u4").tobytes() * 40 for i in range(2000)}
    for key, ids in entries.items():
        writer.add(key, ids)
    writer.close()
    shard = S.Shard(io.BytesIO(out.getvalue()))
    assert len(shard.index) > 3 and shard.entries == 2000
    assert {k: v for k, _, v in shard} == entries
    before = 0
    for key, at, ids in shard:
        assert at == before and shard.get(key) == (before, ids)
        before += len(ids) // 4
    missing = [S.key_of(i * 3 - 499) for i in range(2000)]
    assert all(shard.get(k) is None for k in missing)
    asked = sum(all(shard.bloom[p >> 3] >> (p & 7) & 1 for p in S._bloom_places(k, shard.bits)) for k in missing)
    assert asked < 60  # false positives of the filter
    with pytest.raises(ValueError):
        writer2 = S.Writer(io.BytesIO(), 4)
        writer2.add(S.key_of(2), b"")
        writer2.add(S.key_of(1), b"")


def test_the_query_equals_the_library(spark, sf_dir, plain):
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect())
    start, want = 0, []
    for doc_id, text in docs:
        ids = plain(text)
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in queries.op4_token_sst(spark, sf_dir).collect()) == want


def test_nulls_repeats_lookup_and_empty_tables(spark, plain):
    docs = spark.createDataFrame([(5, "b b"), (None, "n"), (5, "a"), (-3, None), (9, "x " * 5000)], "doc_id long, text string")
    manifest = S.write_shards(docs, FILE, 2)
    rows = sorted((tuple(r) for r in S.read_digests(spark, manifest).collect()), key=lambda r: r[1])
    assert [r[0] for r in rows] == [None, -3, 5, 5, 9]
    assert [r[2] for r in rows] == [len(plain(t)) for t in ("n", "", "a", "b b", "x " * 5000)]
    assert S.look_up(manifest, 9) == plain("x " * 5000) and S.look_up(manifest, 8) is None and S.look_up(manifest, -99) is None
    assert S.read_digests(spark, S.write_shards(docs.where("false"), FILE, 2)).collect() == []
