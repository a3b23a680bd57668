"""A quality classifier as a sparse ensemble of rules.

Boosted shallow trees are grown over statistics of labelled texts; every path from a root to a node is a rule, a
conjunction of comparisons. A logistic model with an L1 penalty weighs the rules and drops most of them. Rules and
statistics are Spark column expressions, so scoring is one projection without a shuffle.

Training takes at most ``MAX_LABELLED`` labelled rows, those with the smallest hash of their id: a bounded sample
by design, as the number of rules it can support is bounded too. Scoring covers every row.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

MAX_LABELLED = 20_000
TREES = 40
DEPTH = 3
LEARNING_RATE = 0.3
CUTS = 32
LEAF = 10
PENALTIES = [0.03, 0.01, 0.003, 0.001, 0.0003]


def statistics(text: Column) -> dict[str, Column]:
    """The statistics that rules compare, by name; all are 0 for an empty text. ``text`` must not be null."""
    size = F.length(text)
    words = F.col("_words")
    n_words = F.size(words)
    lines = F.split(text, "\n")
    over = lambda a, b: F.coalesce(a / F.when(b > 0, b), F.lit(0.0))
    marks = lambda c: size - F.length(F.replace(text, F.lit(c)))
    return {
        "n_chars": size.cast("double"),
        "n_words": n_words.cast("double"),
        "word_length": over(size, n_words),
        "distinct_words": over(F.size(F.array_distinct(words)), n_words),
        "distinct_lines": over(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": over(n_words, F.size(lines)),
        "hashes": over(marks("#") + marks("$") + marks("%"), n_words),
        "stars": over(marks("*") + marks("&"), n_words),
        "bars": over(marks("|"), n_words),
        "bangs": over(marks("!"), n_words),
        "stops": over(marks("."), n_words),
        "commas": over(marks(","), n_words),
        "capitals": over(F.length(F.regexp_replace(text, "[^A-ZÀ-ÖØ-Þ]+", "")), size),
        "digits": over(F.length(F.regexp_replace(text, "[^0-9]+", "")), size),
    }


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct ``_s`` of all statistics."""
    whole = F.coalesce(F.col(text), F.lit(""))
    split = docs.withColumn("_words", F.filter(F.split(whole, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return split.withColumn("_s", F.struct(*[c.alias(k) for k, c in statistics(whole).items()])).drop("_words")


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, above, cut): above means value > cut, else value <= cut


def _cuts(x: np.ndarray) -> list[np.ndarray]:
    out = []
    for column in x.T:
        values = np.unique(np.quantile(column, np.linspace(0, 1, CUTS + 1)))
        out.append((values[1:] + values[:-1]) / 2 if len(values) > 1 else np.array([]))
    return out


def _grow(x: np.ndarray, residual: np.ndarray, weight: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, path: Rule, rules: list[Rule]) -> np.ndarray:
    """Grow a regression tree on ``rows``, note its paths in ``rules`` and return its output for all rows."""
    out = np.zeros(len(x))
    g, h = residual[rows].sum(), weight[rows].sum() + 1.0
    best = (1e-6, -1, 0.0)
    if len(path) < DEPTH and len(rows) >= 2 * LEAF:
        for j, points in enumerate(cuts):
            if not len(points):
                continue
            cell = np.searchsorted(points, x[rows, j], side="left")  # cell <= i means value <= points[i]
            gl = np.cumsum(np.bincount(cell, residual[rows], len(points) + 1))[:-1]
            hl = np.cumsum(np.bincount(cell, weight[rows], len(points) + 1))[:-1]
            nl = np.cumsum(np.bincount(cell, minlength=len(points) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl) - g**2 / h
            gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), j, float(points[i]))
    if best[1] < 0:
        out[rows] = g / h
        return out
    _, j, cut = best
    above = x[rows, j] > cut
    for side, part in ((False, rows[~above]), (True, rows[above])):
        deeper = (*path, (j, side, cut))
        rules.append(deeper)
        out += _grow(x, residual, weight, cuts, part, deeper, rules)
    return out


def tree_rules(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The distinct rules of boosted trees, in the order in which they were found."""
    cuts, rules = _cuts(x), []
    score = np.full(len(y), math.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        score = score + LEARNING_RATE * _grow(x, y - p, p * (1 - p), cuts, np.arange(len(y)), (), rules)
    return list(dict.fromkeys(tuple(sorted(r)) for r in rules))


def fires(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    """A 0/1 column for each rule."""
    out = np.ones((len(x), len(rules)))
    for k, rule in enumerate(rules):
        for j, above, cut in rule:
            out[:, k] *= (x[:, j] > cut) == above
    return out


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and weights of an L1-penalised logistic model, by accelerated proximal gradient steps."""
    mean, spread = z.mean(0), z.std(0)
    spread[spread == 0] = 1
    zs = (z - mean) / spread
    rate = 4 * len(y) / (np.linalg.norm(zs, 2) ** 2 + len(y))
    b, w = math.log((y.sum() + 1) / (len(y) - y.sum() + 1)), np.zeros(z.shape[1])
    vb, v, t = b, w, 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-(vb + zs @ v))) - y
        nb = vb - rate * error.mean()
        nw = v - rate * (zs.T @ error) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        vb, v = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    w = w / spread
    return b - float(mean @ w), w


@dataclass(frozen=True)
class Model:
    names: tuple[str, ...]
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, s: str = "_s") -> Column:
        """The probability of label 1 as a column over the struct ``s`` of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            held = F.lit(True)
            for j, above, cut in rule:
                value = F.col(s)[self.names[j]]
                held = held & ((value > cut) if above else (value <= cut))
            total = total + F.when(held, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, names: list[str]) -> Model:
    """Rules, the penalty with the least loss on every fifth row, and the weights on all rows.

    Without rows, or with one label only, the model is a constant: the smoothed share of label 1.
    """
    if not len(y) or y.min() == y.max():
        share = (float(y.sum()) + 1) / (len(y) + 2)
        return Model(tuple(names), math.log(share / (1 - share)), ())
    check = np.arange(len(y)) % 5 == 4
    if y[~check].min() == y[~check].max() or check.sum() < 20:
        penalty = PENALTIES[0]
    else:
        rules = tree_rules(x[~check], y[~check])
        z, held = fires(rules, x[~check]), fires(rules, x[check])
        losses = []
        for candidate in PENALTIES:
            b, w = lasso_logistic(z, y[~check], candidate)
            s = b + held @ w
            losses.append((float(np.mean(np.logaddexp(0, s) - y[check] * s)), -candidate))
        penalty = -min(losses)[1]
    rules = tree_rules(x, y)
    b, w = lasso_logistic(fires(rules, x), y, penalty)
    return Model(tuple(names), b, tuple((r, float(v)) for r, v in zip(rules, w) if abs(v) > 1e-6))


def held_out(key: Column) -> Column:
    """Rows that no training may see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.encode(key.cast("string"), "UTF-8")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Fit on the labelled rows outside the held-out third. A row with two labels takes the lower one.

    Of documents with the same key the one with the least statistics counts, so repeated rows add nothing. Splits
    that gain the same go to the first statistic and cut; keys whose hashes tie go by key.
    """
    known = (
        labels.where(F.col(key).isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col(key)))
        .groupBy(F.col(key).alias("_key"))
        .agg(F.min("quality").alias("_y"))
        .orderBy(F.xxhash64("_key"), "_key")
        .limit(MAX_LABELLED)
    )
    # at most MAX_LABELLED rows of numbers, one for each key: broadcast, and collected for the fit
    marked = docs.select(key, text).join(F.broadcast(known), F.col(key) == F.col("_key"))
    counted = with_statistics(marked, text).groupBy("_key").agg(F.min(F.struct("_y", "_s")).alias("_r"))
    rows = counted.select("_key", "_r._y", "_r._s.*").toPandas().sort_values("_key", kind="stable")
    names = [c for c in rows.columns if c not in ("_key", "_y")]
    return fit(rows[names].to_numpy(float), (rows["_y"].to_numpy() == 1).astype(float), names)


def scored(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``_score``, the probability of quality 1, for every row.

    Null and empty texts have statistics of 0 and are scored like any other. Rows with a null key are scored and
    never trained on. Repeated rows get equal scores. Without labels every score is one half. Texts of any length are
    counted whole; an empty table gives an empty one. Columns of ``docs`` are kept; names that begin with ``_s`` or
    ``_words`` are the operator's own, so callers whose tables may have them pack the rows first, as ``keep_good`` does.
    """
    model = train(docs, labels, key, text)
    return with_statistics(docs, text).withColumn("_score", model.score()).drop("_s")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a score of one half or more, with the columns of ``docs``."""
    return scored(common.packed(docs, "doc_id", "text"), labels).where(F.col("_score") >= 0.5).select("_doc.*")
