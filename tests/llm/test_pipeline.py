"""The stages against a plain version of each, on a small table with every kind of document."""

import hashlib

import public_tokenizers
import sentencepiece

import corpus_pipeline
from quirefold.llm import common
from tests.llm.test_byte_postings import _components, _fingerprint
from tests.llm.test_phrase_index import _plain as contaminated
from tests.llm.test_risk_rules import _plain as measured


def test_stages_follow_the_order_and_keep_columns(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "simhash", "decontamination", "sentencepiece"]
    docs = common.table(spark, sf_dir, "documents")
    columns = docs.columns
    rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
    bench = [(r["item_id"], r["text"]) for r in common.table(spark, sf_dir, "benchmark").collect()]
    labels = {r["doc_id"]: r["quality"] for r in common.table(spark, sf_dir, "labels").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, sf_dir), name)
        got = {r["doc_id"]: r.asDict() for r in out.collect()}
        assert set(got) <= set(rows)
        if name != "sentencepiece":
            assert out.columns == columns and all(got[k] == rows[k] for k in got)
        gone = set(rows) - set(got)
        if name == "quality_rules":
            m = {k: measured(r["text"]) for k, r in rows.items()}
            assert {k for k, x in m.items() if x["n_words"] < 20 or 100 * x["n_repeat_words"] > 30 * x["n_words"]} <= gone
        elif name == "quality_classifier":
            assert sum(labels.get(k) == 1 for k in gone) <= 0.03 * sum(labels.get(k) == 1 for k in rows)
        elif name == "simhash":
            groups = _components([(k, _fingerprint(r["text"])) for k, r in rows.items()])
            assert set(got) == {k for k, root in groups.items() if k == root}
        elif name == "decontamination":
            hits = {r[0]: r[2] for r in contaminated([(k, x["text"]) for k, x in rows.items()], bench)}
            assert gone == {k for k, n_hit in hits.items() if n_hit > 0}
        else:
            for k, r in got.items():
                ids = library.encode(rows[k]["text"], add_eos=True)
                assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert set(got) == set(rows)
        docs, rows = out, got


def test_run_gives_the_last_stage(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_differ"] and out.count() > 0


def test_stages_take_an_empty_table(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), f"empty-{name}")
        assert docs.count() == 0


def test_stages_take_hard_rows_and_clashing_columns(spark, sf_dir):
    item = common.table(spark, sf_dir, "benchmark").first()["text"]
    words = lambda tag: " ".join(f"{tag}{k} goes on." for k in range(30))
    rows = [(1, words("a")), (1, words("a")), (2, words("a")), (None, words("b")), (3, None), (4, ""), (5, "w " * 200_000), (6, f"{words('c')} {item}"), (7, words("d"))]
    names = ["_key", "_h", "_gone", "_doc", "_m", "_score", "fp", "_words", "n_words", "_t", "_k"]
    docs = spark.createDataFrame([(*r, "en", *range(len(names))) for r in rows], "doc_id long, text string, lang string, " + ", ".join(f"{n} int" for n in names))
    left = {name: sorted((r["doc_id"] for r in common.stored(stage(spark, docs, sf_dir), name).collect()), key=repr) for name, stage in corpus_pipeline.STAGES}
    assert left["quality_rules"] == [1, 1, 2, 6, 7, None]
    assert left["simhash"] == [1, 3, 5, 6, 7, None]
    assert left["decontamination"] == [1, 1, 2, 3, 4, 5, 7, None]
    assert left["sentencepiece"] == [1, 1, 2, 3, 4, 5, 6, 7, None]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns
