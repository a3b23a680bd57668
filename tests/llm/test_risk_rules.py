import math
import random
import re
from collections import Counter

import pyarrow as pa

from quirefold.llm import queries, risk_rules as R

W = re.compile(r"[^\x20\x09-\x0D]+")


def _plain(text):
    text = text or ""
    w = W.findall(text)
    grams = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {i for k in range(len(w) - 7) if grams[tuple(w[k : k + 8])] > 1 for i in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if W.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(covered)}


def test_measures_equal_brute_force():
    rng = random.Random(9)
    texts = [None, "", " \n\t", "a b c d e f g h", "a b c d e f g h a b c d e f g h", "x\nx\n \n \nx y z\x0bq", "#|<>* a\r\nb"]
    texts += [" ".join(rng.choice(["a", "b", "é\n", "#c"]) for _ in range(rng.randrange(120))) for _ in range(150)]
    got = R.measure(pa.array(texts))
    for i, text in enumerate(texts):
        assert {k: int(got[k][i]) for k in R.MEASURES} == _plain(text), repr(text)


def test_slices_of_a_batch_give_the_same(monkeypatch):
    texts = pa.array([f"word {i} " * (i % 9) for i in range(50)] + [None])
    whole = R.measure(texts)
    monkeypatch.setattr(R, "SLICE_BYTES", 40)
    parts = [R.measure(x) for x in R._slices(texts)]
    assert len(parts) > 5
    assert [v for p in parts for v in p["n_words"].tolist()] == whole["n_words"].tolist()


def test_the_bound_is_exact():
    for rejected, good, error in [(0, 100, 0.05), (3, 50, 0.01), (10, 1000, 0.001)]:
        bound = R.upper_bound(rejected, good, error)
        direct = math.fsum(math.comb(good, k) * bound**k * (1 - bound) ** (good - k) for k in range(rejected + 1))
        assert abs(direct - error) < 1e-9
    assert R.upper_bound(0, 0, 0.05) == 1.0 and R.upper_bound(5, 5, 0.05) == 1.0
    assert abs(R.upper_bound(0, 300, 0.05) - (1 - 0.05 ** (1 / 300))) < 1e-9


def test_admitted_cutoffs_keep_their_promise():
    over = [max(0, 60 - 3 * i) for i in range(R.GRID)]
    chosen = R.admitted({("en", "r"): over, ("de", "r"): [0] * R.GRID}, {"en": 4000, "de": 20}, alpha=0.01, delta=0.05)
    cutoff = chosen["en", "r"]
    error = 0.05 / (2 * R.GRID)
    assert R.upper_bound(over[cutoff - 1], 4000, error) <= 0.01 < R.upper_bound(over[cutoff - 2], 4000, error)
    assert ("de", "r") not in chosen  # twenty good texts can't show so low a rate


def test_the_query_on_a_table(spark, sf_dir):
    got = {r["doc_id"]: r for r in queries.op9_quality_rules(spark, sf_dir).collect()}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        r, want = got[d["doc_id"]], _plain(d["text"])
        assert {k: r[k] for k in R.MEASURES} == want
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_learned_cutoffs_reject_junk_and_spare_good_texts(spark):
    good = [(i, f"line {i} " + " ".join(f"w{i}x{k}" for k in range(30)), "en") for i in range(3000)]
    junk = [(5000 + i, " ".join(f"#{i}x{k}$" for k in range(30)), "en") for i in range(40)]
    docs = spark.createDataFrame(good + junk + [(9000, None, "en"), (9001, "few", None), (9002, " ".join(f"q{k}#" for k in range(30)), "xx")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in junk] + [(1, 0)], "doc_id long, quality int")
    kept = {r["doc_id"] for r in R.keep_good(docs, labels).collect()}
    assert kept == {i for i, *_ in good} | {9002}  # no labels for that language: base rules only
    assert R.keep_good(docs, labels).columns == docs.columns
    assert R.keep_good(docs.where("false"), labels).collect() == []
    assert {r["doc_id"] for r in R.keep_good(docs, labels.where("false")).collect()} == kept | {i for i, *_ in junk}


def test_languages_with_few_labels_go_by_a_fallback_stratum(spark):
    none = [0] * R.GRID
    good = {"en": 2076, "de": 507, "fr": 505, "es": 321, "xx": 0}
    chosen = R.learned({(s, r): none for s in good for r in [*"abcde", R.ANY]}, good, lambda s, cutoffs: len(cutoffs))
    assert {s for s, _ in chosen} == {"en", "de", "fr", "es"} and set(chosen.values()) == {1}
    assert R.learned({("en", r): none for r in [*"abcde", R.ANY]}, {"en": 300}, lambda s, cutoffs: len(cutoffs)) == {}  # too few altogether
    assert R.last_passed([9] * 10 + [0] * 5 + [2] * 5, 500, 0.05) is None  # the sequence ends at its first failure
    assert R.last_passed([9] * 10 + [0] * 10, 500, 0.05) == 11
    fine = [(n, " ".join(f"w{n}x{k}" for k in range(30)), ("en", "de", "fr")[n % 3]) for n in range(720)]
    junk = [(1000 + n, " ".join(f"#{n}x{k}$" for k in range(30)), ("en", "de", "fr")[n % 3]) for n in range(9)]
    docs = spark.createDataFrame(fine + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i, *_ in fine] + [(i, 0) for i, *_ in junk], "doc_id long, quality int")
    assert {r["doc_id"] for r in R.keep_good(docs, labels).collect()} == {i for i, *_ in fine}


def test_all_rules_together_keep_the_promise():
    # 0.6 % of the good texts reach the highest cell of each rule, always others: 3 % for all five
    n, rules = 20_000, "abcde"
    over = {("en", r): [120] * R.GRID for r in rules}
    assert all(R.upper_bound(120, n, 0.05 / 5) <= R.ALPHA for _ in rules)
    assert R.learned(over | {("en", R.ANY): [600] * R.GRID}, {"en": n}, lambda s, cutoffs: len(cutoffs)) == {}
    # rules of different strictness: apart where that rejects more, and never more than ALPHA in sum
    over = {("en", r): [9] * R.GRID for r in "abcd"} | {("en", "e"): [2000] * 30 + [9] * 20}
    over["en", R.ANY] = [2036] * 30 + [45] * 20
    chosen = R.learned(over, {"en": n}, lambda s, cutoffs: -sum(cutoffs.values()))
    assert chosen == {("en", r): 1 for r in "abcd"} | {("en", "e"): 31}
    assert R.upper_bound(sum(over[at][c - 1] for at, c in chosen.items()), n, R.DELTA) <= R.ALPHA
