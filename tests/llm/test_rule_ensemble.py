import numpy as np

from quirefold.llm import queries, rule_ensemble as R


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    scores = queries.op3_quality_classifier(spark, sf_dir).toPandas()
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").toPandas()
    assert len(scores) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert scores.score.between(0, 1).all() and (scores.predicted == (scores.score >= 0.5)).all()
    told = scores.merge(labels, on="doc_id")
    held = told[told.held_out]
    assert (held.predicted == held.quality).mean() >= 0.95
    good = held[held.quality == 1]
    assert (good.predicted == 1).mean() >= 0.97


def test_rules_are_paths_and_columns_agree_with_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random((400, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.4)).astype(float)
    model = R.fit(x, y, ["a", "b", "c"])
    assert 0 < len(model.rules) <= 200 and all(len(r) <= R.DEPTH for r, _ in model.rules)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double, c double").selectExpr("struct(a, b, c) _s")
    got = np.array([r[0] for r in frame.select(model.score()).collect()])
    z = model.intercept + R.fires([r for r, _ in model.rules], x) @ np.array([w for _, w in model.rules])
    assert np.allclose(np.sort(got), np.sort(1 / (1 + np.exp(-z))))
    assert ((got >= 0.5) == y).mean() > 0.97


def test_the_lasso_leaves_useless_rules_out():
    rng = np.random.default_rng(1)
    z = rng.integers(0, 2, (500, 20)).astype(float)
    y = (rng.random(500) < np.where(z[:, 0] == 1, 0.9, 0.1)).astype(float)
    _, w = R.lasso_logistic(z, y, 0.03)
    assert abs(w[0]) > 1 and (np.abs(w[1:]) > 1e-6).sum() <= 3


def test_nulls_empties_and_missing_labels(spark):
    docs = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (None, "some words here", "k"), (3, "some words here", "k"), (3, "some words here", "k")], "doc_id long, text string, _score2 string")
    labels = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (4, None), (None, 1)], "doc_id long, quality int")
    rows = R.scored(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r["_score"] <= 1 for r in rows)
    assert len({r["_score"] for r in rows if r["text"] == "some words here"}) == 1
    none = R.scored(docs, labels.where("false")).collect()
    assert {r["_score"] for r in none} == {0.5}
    assert R.scored(docs.where("false"), labels).collect() == []
    assert R.keep_good(docs, labels).columns == docs.columns
