"""Quality rules with risk-controlled thresholds.

Each rule is a measure of a text and a cutoff; a text over any cutoff is rejected. Cutoffs are not set by hand: for
each stratum (language), labelled documents give the number of good texts at or over each cutoff of a fixed grid, and
cutoffs may be used only if the exact (Clopper-Pearson) upper bound on the rate of good texts that all rules together
reject stays within ``ALPHA``. Two ways are tried, each with half of the stratum's error:

* together: the same cutoff for all rules, and the union of what they reject is bounded;
* apart: a cutoff for each rule, its rate bounded by ``ALPHA`` / rules, so the sum and with it the union is bounded.

Cutoffs are nested, so they are tested in a fixed sequence from lax to strict that ends at the first failure, and the
grid costs no error: ``DELTA`` is divided by strata, ways and, apart, rules. All promises hold at once with probability
``1 - DELTA``, so of the two ways the one that rejects more labelled texts that are not good may be taken (of equal
ones the first). Where neither gives a cutoff the rules are off.

A language with too few good labels for a test of its own, but some, goes by the fallback stratum: all such languages
together and, while those are still too few, the next larger ones. Its promise holds for that mixture. Which language
goes where depends on the numbers of labels alone, never on measures. Languages without labels have base rules only.

Measures are computed on whole texts in Arrow batches; repeated 8-word windows are found exactly, by numbering
distinct pairs, fours and eights of words instead of hashing them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Largest admitted share of good texts that all rules together reject in one stratum, and the joint error probability.
ALPHA = 0.01
DELTA = 0.05
WINDOW = 8
MIN_WORDS = 20
SYMBOLS = "#*$%&|<>"
#: Bytes of text that are measured at a time inside an Arrow batch.
SLICE_BYTES = 3_000_000
#: Cutoffs that are tested: 1/50, 2/50, ... 50/50 of each share, fixed beforehand.
GRID = 50

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_NAMES = [*MEASURES, "n_lines", "n_upper", "n_marks"]


def _numbered(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """A number for each distinct pair, equal pairs alike."""
    base = int(second.max()) + 1 if len(second) else 1
    return np.unique(first * base + second, return_inverse=True)[1].astype(np.int64)


def _repeat_words(words: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Per document, the words that lie in an 8-word window found twice or more in the same document."""
    out = np.zeros(n_docs, np.int64)
    if len(words) < WINDOW:
        return out
    level = words.astype(np.int64)
    for step in (1, 2, 4):  # numbers of 2-, 4- and 8-word runs, wherever they start
        level = _numbered(level[:-step], level[step:])
    whole = doc[: len(level)] == doc[WINDOW - 1 :]
    at = np.flatnonzero(whole)
    if not len(at):
        return out
    base = int(level.max()) + 1
    _, back, count = np.unique(doc[at] * base + level[at], return_inverse=True, return_counts=True)
    starts = at[count[back] > 1]
    if not len(starts):
        return out
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + WINDOW, -1)
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(doc[covered], minlength=n_docs)


def _per_doc(lists: pa.ListArray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one for each item of ``lists``) by list."""
    total = np.concatenate(([0], np.cumsum(values)))
    offsets = np.asarray(lists.offsets)
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """The measures of each text; null texts count as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    n = len(texts)
    split = pc.ascii_split_whitespace(texts)
    flat = split.values
    lengths = np.asarray(pc.utf8_length(flat)).astype(np.int64)
    real = lengths > 0  # a text that begins or ends with white space has empty pieces
    doc = np.repeat(np.arange(n), np.diff(np.asarray(split.offsets)))
    words = flat.filter(pa.array(real)).dictionary_encode()
    ids, doc_of_word = np.asarray(words.indices), doc[real]
    out = {
        "n_words": np.bincount(doc_of_word, minlength=n),
        "word_chars": _per_doc(split, lengths),
        "n_symbols": np.asarray(pc.count_substring_regex(texts, f"[{SYMBOLS}]")).astype(np.int64),
        "n_upper": np.asarray(pc.count_substring_regex(texts, r"\p{Lu}\p{Lu}")).astype(np.int64),
        "n_marks": np.asarray(pc.count_substring_regex(texts, r"[!?]{2}")).astype(np.int64),
        "n_repeat_words": _repeat_words(ids, doc_of_word, n),
    }
    lines = pc.split_pattern(texts, "\n")
    flat = lines.values
    full = np.asarray(pc.match_substring_regex(flat, r"[^\x20\x09-\x0D]"))
    doc = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets)))
    line = np.asarray(flat.dictionary_encode().indices).astype(np.int64)
    out["n_lines"] = np.bincount(doc[full], minlength=n)
    key = doc[full] * (int(line.max()) + 1 if len(line) else 1) + line[full]
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(doc[full][first], minlength=n)
    return out


def _slices(texts: pa.Array) -> list[pa.Array]:
    """Consecutive parts of about SLICE_BYTES; one long text may be a part of its own."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    part = np.cumsum(sizes) // SLICE_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
    return [texts.slice(a, b - a) for a, b in zip(cuts, cuts[1:])]


@F.arrow_udf(T.StructType([T.StructField(k, T.LongType()) for k in _NAMES]))
def measures(texts: pa.Array) -> pa.Array:
    parts = [measure(x) for x in _slices(texts)]
    return pa.StructArray.from_arrays(
        [pa.array(np.concatenate([p[k] for p in parts]).astype(np.int64)) for k in _NAMES], _NAMES
    )


#: The rules: shares between 0 and 1 of which high values speak against a text.
def shares(m: str) -> dict[str, Column]:
    c = lambda k: F.col(m)[k]
    over = lambda a, b: F.least(F.lit(1.0), F.coalesce(a / F.when(b > 0, b), F.lit(0.0)))
    return {
        "symbols": over(c("n_symbols"), c("n_words")),
        "dup_lines": over(c("n_dup_lines"), c("n_lines")),
        "repeats": over(c("n_repeat_words"), c("n_words")),
        "capitals": over(2 * c("n_upper"), c("word_chars")),
        "marks": over(c("n_marks"), c("n_words")),
    }


def grid_cell(share: Column) -> Column:
    """The highest cutoff that a share reaches, as its number on the grid; 0 is below all of them."""
    return F.floor(share * GRID).cast("int")


def at_most(rejected: int, good: int, rate: float) -> float:
    """The exact binomial probability of ``rejected`` or fewer among ``good`` at ``rate``; terms below 1e-20 of the sum end it."""
    if rejected >= good:
        return 1.0
    if rejected < 0 or rate >= 1:
        return 0.0
    log_top = math.lgamma(good + 1) - math.lgamma(rejected + 1) - math.lgamma(good - rejected + 1)
    log_top += rejected * math.log(rate) + (good - rejected) * math.log1p(-rate)
    term, total, k = 1.0, 0.0, rejected
    while k >= 0 and term > 1e-20 * total:
        total += term
        term *= k / (good - k + 1) * (1 - rate) / rate
        k -= 1
    return min(1.0, math.exp(log_top + math.log(total)))


def upper_bound(rejected: int, good: int, error: float) -> float:
    """Clopper-Pearson: the rate at which ``rejected`` or fewer of ``good`` has probability ``error``."""
    if rejected >= good:
        return 1.0
    low, high = rejected / good, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(rejected, good, mid) > error else (low, mid)
    return high


def admitted(counts: dict[tuple[str, str], list[int]], good: dict[str, int], alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """The strictest cutoff for each (stratum, rule) whose bound stays within alpha, at delta shared by all tests.

    counts: good texts at or over cutoff 1, 2, ... GRID; good: good texts of each stratum.
    """
    tests = max(1, len(counts) * GRID)
    out: dict[tuple[str, str], int] = {}
    for (stratum, rule), over in counts.items():
        n = good[stratum]
        for cutoff, rejected in enumerate(over, 1):
            if rejected <= alpha * n and at_most(rejected, n, alpha) <= delta / tests:  # so upper_bound() <= alpha
                out[stratum, rule] = cutoff
                break
    return out


#: Ways to choose cutoffs: together and apart.
WAYS = 2
#: The name under which counts have the union of all rules.
ANY = "any"


def strata(good: dict[str, int], alpha: float = ALPHA, delta: float = DELTA) -> tuple[list[str], list[str], list[str]]:
    """(strata with a test of their own, strata that go by the fallback, strata whose labels the fallback is tested on)."""
    order = sorted((s for s in good if good[s] > 0), key=lambda s: (-good[s], s))
    least = lambda n: math.log(delta / (n * WAYS)) / math.log1p(-alpha)  # noqa: E731  (with none rejected, in n strata)
    own = 0
    while own < len(order) and good[order[own]] >= least(min(own + 2, len(order))):
        own += 1
    few = order[own:]
    pool = list(few)
    for larger in reversed(order[:own] if few else []):
        if sum(good[s] for s in pool) >= least(own + 1):
            break
        pool.append(larger)
    return order[:own], few, pool


def last_passed(over: list[int], good: int, error: float, alpha: float = ALPHA) -> int | None:
    """The strictest cutoff of the sequence from lax to strict up to the first whose bound exceeds alpha; error is for the whole sequence."""
    chosen = None
    for cutoff in range(len(over), 0, -1):
        if over[cutoff - 1] > alpha * good or at_most(over[cutoff - 1], good, alpha) > error:
            break
        chosen = cutoff
    return chosen


def learned(
    counts: dict[tuple[str, str], list[int]], good: dict[str, int], bad: Callable[[str, dict[str, int]], int], alpha: float = ALPHA, delta: float = DELTA
) -> dict[tuple[str, str], int]:
    """The cutoff for each (stratum, rule) that has one.

    counts: good texts at or over cutoff 1, 2, ... GRID by (stratum, rule), and by (stratum, ANY) those at or over it
    in any rule; good: good texts of each stratum; bad: the texts of a stratum not labelled good that cutoffs reject.
    """
    rules = sorted({rule for _, rule in counts} - {ANY})
    own, few, pool = strata(good, alpha, delta)
    error = delta / max(1, (len(own) + bool(few)) * WAYS)
    out: dict[tuple[str, str], int] = {}
    for tested, used in [*(([s], [s]) for s in own), (pool, few)]:
        n = sum(good[s] for s in tested)
        over = {rule: [sum(column) for column in zip(*(counts[s, rule] for s in tested))] for rule in [*rules, ANY]}
        union = last_passed(over[ANY], n, error, alpha)
        together = {rule: union for rule in rules if union}
        apart = {rule: last_passed(over[rule], n, error / len(rules), alpha / len(rules)) for rule in rules}
        apart = {rule: cutoff for rule, cutoff in apart.items() if cutoff}
        chosen = max(together, apart, key=lambda cutoffs: sum(bad(s, cutoffs) for s in tested))
        out |= {(s, rule): cutoff for s in used for rule, cutoff in chosen.items()}
    return out


def calibrate(measured: DataFrame, labels: DataFrame, stratum: str, key: str = "doc_id", alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], int]:
    """Cutoffs by (stratum, rule) from all labelled rows of ``measured``, which has the measures in ``_m``.

    labels: (key, quality); a document labelled twice counts as good only if no label says otherwise. Counts by
    stratum, label and grid cells come to the driver and nothing else; most texts are in few of the combined cells.
    """
    told = labels.groupBy(F.col(key).alias("_told")).agg(F.coalesce(F.min("quality") == 1, F.lit(False)).alias("_is_good"))
    small = common.maybe_broadcast(told, told.count(), 1_000_000)
    found = shares("_m")
    rules = sorted(found)
    rows = (
        measured.join(small, F.col(key) == F.col("_told"))
        .where(F.col(stratum).isNotNull())
        .groupBy(F.col(stratum).alias("stratum"), "_is_good", F.array(*[F.least(grid_cell(found[rule]), F.lit(GRID)) for rule in rules]).alias("cells"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    counts: dict[tuple[str, str], list[int]] = {}
    total: dict[str, int] = {}
    others: dict[str, list[tuple[dict[str, int], int]]] = {}
    for r in rows:
        cells = dict(zip(rules, r["cells"]))
        if not r["_is_good"]:
            others.setdefault(r["stratum"], []).append((cells, r["n"]))
            continue
        total[r["stratum"]] = total.get(r["stratum"], 0) + r["n"]
        for rule, cell in [*cells.items(), (ANY, max(cells.values()))]:
            over = counts.setdefault((r["stratum"], rule), [0] * GRID)
            for cutoff in range(cell):
                over[cutoff] += r["n"]

    def bad(value: str, cutoffs: dict[str, int]) -> int:
        return sum(n for cells, n in others.get(value, []) if any(cells[rule] >= cutoff for rule, cutoff in cutoffs.items()))

    return learned(counts, total, bad, alpha, delta)


def judged(docs: DataFrame, labels: DataFrame, carry: list[str], key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """The columns ``carry`` of every row of ``docs`` with ``_m`` (struct of measures), ``_base_failed`` and ``_kept``.

    Null and empty texts have no words and fail the base rules. Rows of a stratum without labels, or of a null
    stratum, are judged by the base rules only. Repeated rows get equal verdicts. An empty label table switches
    all learned cutoffs off; an empty document table gives an empty table. Shares equal to a cutoff are over it;
    strata with equally many labels go by name. Texts of any length are measured whole, a slice of a batch at a time.
    Columns that are not in ``carry`` are left out; ``_m``, ``_base_failed`` and ``_kept`` are the operator's names, so
    ``keep_good`` packs rows whose columns may clash. The measures are stored once, for the calibration and for the
    verdicts.
    """
    common.small_batches(docs.sparkSession)
    columns = list(dict.fromkeys([key, stratum, *carry]))
    measured = common.stored(docs.withColumn("_m", measures(F.coalesce(F.col(text), F.lit("")))).select(*columns, "_m"), "measures")
    cutoffs = calibrate(measured, labels.select(key, "quality"), stratum, key)
    base = (F.col("_m")["n_words"] < MIN_WORDS) | (100 * F.col("_m")["n_repeat_words"] > 30 * F.col("_m")["n_words"])
    over = F.lit(False)
    for (value, rule), cutoff in sorted(cutoffs.items()):
        over = over | ((F.col(stratum) == value) & (grid_cell(shares("_m")[rule]) >= cutoff))
    return measured.select(*carry, "_m", base.alias("_base_failed"), (~base & ~F.coalesce(over, F.lit(False))).alias("_kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns of ``docs``."""
    return judged(common.packed(docs, "doc_id", "lang", "text"), labels, ["_doc"]).where("_kept").select("_doc.*")
