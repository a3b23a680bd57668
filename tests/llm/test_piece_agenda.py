import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from quirefold.llm import piece_agenda as A, queries

FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  a  b ", "▁x ▁", "a\tb\n\n c²d ½ 日本語 😀 ß", " lead", "trail ", "\n", "\n\nx", "it's don't 12345 ².", "Ünïcödé ÀÉ×÷", "x" * 500, "end   .  ", "\u0000\u007f\u0080", "<s> </s> <0x41>"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


def test_encoding_and_decoding_equal_the_library(library):
    rng = random.Random(8)
    texts = ODD + ["".join(rng.choice("abcdefgh  ▁éñ.,!?\n12日") for _ in range(rng.randrange(80))) for _ in range(400)]
    encoder = A.Encoder(A.Merger(FILE))
    assert encoder.merger.chunked
    for text, (n, ids, decoded, differ) in zip(texts, encoder.encode(texts)):
        want = library.encode(text, add_eos=True)
        assert (n, ids, decoded) == (len(want), " ".join(map(str, want)), library.decode(want)), repr(text)
        assert differ == 0
    assert not encoder.differing


@pytest.mark.parametrize("chunked", [True, False])
def test_the_agenda_alone_equals_the_library_on_whole_documents(spark, sf_dir, library, chunked):
    merger = A.Merger(FILE)
    merger.library = None  # nothing of it in the path
    merger.chunked = chunked
    docs = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    for text in ODD + docs:
        ids = [i for chunk in merger.chunks(text) for i in merger.merge(chunk)]
        want = library.encode(text)
        assert ids == want, repr(text[:80])
        assert merger.decode(ids) == library.decode(want)


def test_the_ids_are_the_agendas_and_differences_are_counted(library):
    merger = A.Merger(FILE)
    honest = merger.merge
    merger.merge = lambda chunk: [5] if chunk == "▁fox" else honest(chunk)
    (n, ids, _, differ), (_, _, _, none) = A.Encoder(merger).encode(["the fox", "the dog"])
    assert ids == " ".join(map(str, [*library.encode("the"), 5, 2])) and n == 3
    assert differ == 2 and none == 0  # the chunk, and the first text as a whole


def test_a_very_long_text_of_many_words(library):
    rng = random.Random(3)
    text = " ".join("".join(rng.choice("abcdeé日\n ") for _ in range(rng.randrange(1, 60))) for _ in range(40_000))
    ((n, ids, decoded, differ),) = A.Encoder(A.Merger(FILE)).encode([text])
    want = library.encode(text, add_eos=True)
    assert (n, ids, differ) == (len(want), " ".join(map(str, want)), 0) and decoded == library.decode(want)


def test_the_query_equals_the_library(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in queries.op8_sentencepiece(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d["text"], add_eos=True)
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        r = got[d["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["n_differ"]) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)), 0)


def test_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a b", 5), (2, "w " * 30000, 5)], "doc_id long, text string, n_tokens int")
    rows = A.encoded(docs, FILE).collect()
    assert sorted((r["n_tokens"] for r in rows))[:2] == [1, 1] and len(rows) == 4
    assert len({r["ids_sha256"] for r in rows if r["doc_id"] == 1}) == 1
    assert A.encoded(docs.where("false"), FILE).collect() == []
