import hashlib
import random
import re

from quirefold.llm import phrase_index as P

WORD = re.compile(P.WORD)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(text):
    return WORD.findall((text or "").translate(LOWER))


def _near(w, window, slack):
    """Whether, at some place, every word of the window but ``slack`` stands within one place of its own."""
    return any(
        sum(any(0 <= s + i + j < len(w) and w[s + i + j] == x for j in (-1, 0, 1)) for i, x in enumerate(window)) >= len(window) - slack
        for s in range(-1, len(w))
    )


def _plain(docs, items):
    windows = {}
    for item_id, text in items:
        w = _words(text)
        size = min(13, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item_id))
    out = []
    for doc_id, text in docs:
        w, hit, ids = _words(text), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit.update(range(i, i + size))
                    ids |= found
        held, near = set(w), set()
        for window, found in windows.items():
            slack = int(len(window) == 13)
            if not found <= near and sum(x in held for x in window) >= len(window) - slack and _near(w, window, slack):
                near |= found
        sha = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), sha, bool(hit) and 20 * len(hit) >= len(w), len(near)))
    return sorted(out, key=repr)


def _got(spark, docs, items):
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near"]
    return sorted((tuple(r) for r in P.contamination(frame, bench).select(*columns).collect()), key=repr)


def test_equals_brute_force_on_random_texts(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "d", "the", "élan", "x1"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, line(rng.choice([0, 1, 3, 12, 13, 14, 30]))) for i in range(12)]
    docs = [(i, line(rng.choice([0, 5, 40, 120]))) for i in range(30)]
    docs += [(100 + i, f"{line(20)} {text.upper()}! {line(9)}") for i, (_, text) in enumerate(items)]
    for i, (_, text) in enumerate(items):
        w = text.split()
        if len(w) > 8:
            docs += [(200 + i, f"{line(4)} {' '.join(w[:7] + w[8:])}"), (300 + i, ' '.join([*w[:5], 'new', *w[5:], line(3)]))]
    assert _got(spark, docs, items) == _plain(docs, items)


def test_nulls_repeats_ties_and_long_texts(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    items = [(1, passage), (1, passage), (2, passage), (3, None), (4, "!!!"), (5, "Lone")]
    docs = [(1, None), (2, ""), (3, passage), (3, passage), (3, "other words"), (4, "lone " * 3000 + passage), (5, "wo w1 w2"), (6, f"x {passage} y {passage}")]
    assert _got(spark, docs, items) == _plain(docs, items)


def test_empty_tables(spark):
    assert _got(spark, [], [(1, "a b c")]) == []
    assert _got(spark, [(1, "a b c")], []) == _plain([(1, "a b c")], [])


def test_clashing_columns_are_kept_by_the_stage(spark):
    docs = spark.createDataFrame([(1, "a b c d", 9, "x"), (2, "q r s", 8, "y")], "doc_id long, text string, n_words int, contaminated string")
    items = spark.createDataFrame([(7, "b c")], "item_id long, text string")
    kept = P.keep_clean(docs, items)
    assert kept.columns == docs.columns and [tuple(r) for r in kept.collect()] == [(2, "q r s", 8, "y")]


def test_proximity_takes_one_word_changed_put_in_or_left_out(spark):
    passage = [f"w{i}" for i in range(13)]
    less, more, other = passage.copy(), passage.copy(), passage.copy()
    del less[6]
    more.insert(7, "extra")
    other[0] = "new"
    twice = other.copy()
    twice[9] = "new"
    far = " ".join(f"{x} z z" for x in passage)
    docs = [(1, " ".join(passage)), (2, " ".join(less)), (3, "a " * 2100 + " ".join(more)), (4, " ".join(other)), (5, " ".join(twice)), (6, far), (7, " ".join(passage[::-1]))]
    items = [(9, " ".join(passage)), (8, "short one"), (7, "w1 w2 w3")]
    got = {r[0]: (r[2], r[3], r[6]) for r in _got(spark, docs, items)}
    assert got == {1: (13, 2, 2), 2: (3, 1, 2), 3: (3, 1, 2), 4: (3, 1, 2), 5: (3, 1, 1), 6: (0, 0, 0), 7: (0, 0, 0)}
    assert _got(spark, docs, items) == _plain(docs, items)


def test_a_passage_repeated_thousands_of_times(spark):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = [(1, f"{passage} x " * 3000), (2, passage)]
    ((_, n_words, n_hit, *_, n_near), _) = _got(spark, docs, [(1, passage), (2, passage + " more")])
    assert (n_words, n_hit, n_near) == (48_000, 45_000, 2)
