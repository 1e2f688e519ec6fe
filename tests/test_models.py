"""Network inference, reports, and the forests on the smallest tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import models as M
from ledgerlens.operators import similarity as S
from ledgerlens.operators.selection import hash_order
from ledgerlens.plans.propensity import fit_propensity
from ledgerlens.sources import roles


def test_embed_equals_numpy(spark):
    rng = np.random.default_rng(1)
    layers = [(rng.normal(size=(3, 5)), rng.normal(size=5)), (rng.normal(size=(5, 2)), rng.normal(size=2))]
    x = rng.normal(size=(20, 3))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "k long, v array<double>")
    want = np.maximum(x @ layers[0][0] + layers[0][1], 0) @ layers[1][0] + layers[1][1]
    want /= np.linalg.norm(want, axis=1, keepdims=True)
    for r in M.embed(df, "v", layers).collect():
        assert r["embedding"] == pytest.approx(list(want[r["k"]]))
    same = M.embed(df, "v", M.identity_layers(3)).first()
    assert np.linalg.norm(same["embedding"]) == pytest.approx(1)


def test_mean_cosine_equals_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(size=(30, 4)), np.zeros((1, 4))])
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "k long, v array<double>")
    cohort = df.filter("k < 10")
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    want = (unit @ unit[:10].T).mean(axis=1)
    for r in S.cohort_similarity(df, cohort, "v", 4).collect():
        assert r["similarity_score"] == pytest.approx(want[r["k"]])


def test_top_share_is_exact_with_many_ties(spark):
    # A third of all scores are equal.
    df = spark.range(900).selectExpr("id as k", "if(id % 3 = 0, 0.5D, id / 900D) as s")
    for floor, share, rows in ((100, 0.2, 180), (300, 0.2, 300), (2000, 0.2, 900)):
        got = S.top_targets(df, "s", "k", share=share, floor=floor).collect()
        best = df.orderBy(F.desc("s"), hash_order(F.col("k")), "k").limit(rows).collect()
        assert len(got) == rows and sorted(got) == sorted(best)


def test_precision_skips_large_k(spark):
    df = spark.range(30).selectExpr("id as k", "id / 30D as s", "cast(id >= 20 as int) as y")
    got = {r["k"]: r["precision"] for r in S.precision_at_k(df, "s", "y", "k").collect()}
    assert got == {10: 1.0, 20: 0.5}


def test_report(spark):
    df = spark.createDataFrame([(1, 1)] * 3 + [(1, 0)] + [(0, 0)] * 4 + [(0, 1)] * 2, "y int, p int")
    got = {r["class"]: r for r in M.classification_report(df, "y", "p").collect()}
    assert got[1]["precision"] == pytest.approx(3 / 5) and got[1]["recall"] == pytest.approx(3 / 4)
    assert got[0]["support"] == 6 and got[0]["accuracy"] == pytest.approx(0.7)


def test_forests(spark, sf):
    fitted = fit_propensity(roles.bank(spark, sf), trees=5)
    assert "loan_amount" not in fitted.features and "balance_mean" in fitted.features
    n = fitted.train.count() + fitted.test.count()
    assert n == 1500 and fitted.test.count() == 300
    top = M.feature_importance(fitted.classifier, fitted.features).collect()
    assert len(top) <= 15 and top == sorted(top, key=lambda r: -r["importance"])
    error = M.regression_error(fitted.test, "loan_amount", "predicted_amount").first()
    assert error["n"] == 300 and error["mse"] > 0
    assert fitted.test.filter(F.col("predicted_taker").isin(0, 1)).count() == 300
