"""Fitted models against plain fits."""

import numpy as np
import pytest

from furlong.operators import models as M


def table(spark, n=600, seed=0):
    rng = np.random.default_rng(seed)
    year = rng.integers(2001, 2006, n)
    x = np.column_stack([rng.normal(50, 10, n), rng.random(n), rng.integers(0, 3, n)])
    y = (rng.random(n) < 1 / (1 + np.exp(-(0.1 * (x[:, 0] - 50) - 2 * x[:, 1] + 0.3 * x[:, 2])))).astype(int)
    rows = [(int(a), *map(float, b), int(c)) for a, b, c in zip(year, x, y)]
    rows += [(2001, None, 1.0, 1.0, 1), (2003, 50.0, 0.5, 1.0, None), (None, 50.0, 0.5, 1.0, 1)]
    return year, x, y, spark.createDataFrame(rows, "race_year int, a double, b double, c double, y int").repartition(4)


FEATURES = ["a", "b", "c"]


def test_linear_folds_equal_numpy(spark):
    year, x, y, df = table(spark)
    got = M.fit_linear_folds(df, FEATURES, "y")
    assert sorted(got) == [2002, 2003, 2004, 2005]
    for fold, w in got.items():
        of = year < fold
        assert w == pytest.approx(np.linalg.lstsq(np.column_stack([np.ones(of.sum()), x[of]]), y[of], rcond=None)[0], abs=1e-8)
    out = M.score_folds(df, got, FEATURES).collect()
    assert len(out) == (year > 2001).sum() + 1 and {r.race_year for r in out} == set(got)
    assert all(r.score == pytest.approx(got[r.race_year][0] + sum(w * r[f] for w, f in zip(got[r.race_year][1:], FEATURES))) for r in out)


def test_logistic_folds_equal_a_plain_fit(spark):
    year, x, y, df = table(spark, seed=1)
    got = M.fit_logistic_folds(df, FEATURES, "y", ridge=0.0)
    assert sorted(got) == [2002, 2003, 2004, 2005]
    for fold, w in got.items():
        of = year < fold
        z, t = np.column_stack([np.ones(of.sum()), x[of]]), y[of]
        # where the likelihood is largest its slope is nought
        q = 1 / (1 + np.exp(-(z @ w)))
        assert np.abs(z.T @ (t - q)).max() < 1e-4
    later = M.score_folds(df, got, FEATURES, logistic=True).where("score is not null and y is not null").collect()
    loss = lambda p: -np.mean([r.y * np.log(p(r)) + (1 - r.y) * np.log(1 - p(r)) for r in later])
    base = np.mean([r.y for r in later])
    assert all(0 < r.score < 1 for r in later) and loss(lambda r: r.score) < loss(lambda r: base) - 0.03


def test_folds_of_one_year_and_none(spark):
    df = table(spark)[3]
    for few in (df.where("race_year = 2001"), df.where("1 = 0")):
        assert M.fit_linear_folds(few, FEATURES, "y") == {} and M.fit_logistic_folds(few, FEATURES, "y") == {}
        assert M.score_folds(df, {}, FEATURES).count() == 0


def test_isotonic_of_a_skewed_score(spark):
    """Nearly all scores in a sliver: ranges go by quantiles, so none holds more than its share, and the curve is that of one pass."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.random(3000) * 1e-6, [0.5, 1.0]])
    y = (rng.random(len(x)) < np.clip(x * 1e6, 0, 1)).astype(int)
    df = spark.createDataFrame([("b", float(a), int(b)) for a, b in zip(x, y)] + [("c", 0.3, 1), ("b", float("nan"), 1)], "b string, s double, y int")
    one = {r.bucket: (r.xs, r.ys) for r in M.fit_isotonic(df, "b", "s", "y").collect()}
    many = {r.bucket: (r.xs, r.ys) for r in M.fit_isotonic(df, "b", "s", "y", points=200, fan_in=4).collect()}
    assert one.keys() == many.keys() == {"b", "c", None}
    for k in one:
        assert many[k][0] == pytest.approx(one[k][0]) and many[k][1] == pytest.approx(one[k][1]) and one[k][1] == sorted(one[k][1])
    from pyspark.sql import functions as F

    dealt = df.where("not isnan(s)").repartitionByRange(15, "b", "s").groupBy(F.spark_partition_id().alias("p")).count().collect()
    sizes = [r["count"] for r in dealt]
    assert len(sizes) > 10 and max(sizes) < 600
