"""Registered queries against their SQL on the smallest tables; the others must run."""

import pytest

from compare import DATA, same
from furlong import catalogue

QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()
#: One of every group of operators; bench.py and the driver run all.
SOME = "w2_rank_in_race w4_expanding w9_others w12_streak w17_same_day_prior j3_prior_history j6_asof j16_fallback j14_ancestors u5_placeholders k9_cascade a6_safe_corr a14_race_hits a20_kappa a26_adoption_gate a50_bucket_tiers p1_normalise p13_frame p26_blinkers f10_unpack m6_search_weights m13_impute_prior q4_classify_diff l2_career l3_jockey_trainer l22_head_to_head l23_going_pedigree l29_similar_race l31_cells l36_exotic_odds l45_heatmap l46_horse_series a33_trend a35_trend_in_race a45_combinations u9_person_summary w12_streak_capped q5_conflicts s2_write_partitioned s9_payouts s14_retention t2_changed_stream t3_latest t5_merge t5_merge_stream t8_slots t8_due t9_retry t12_dedupe_stream t13_incidents t13_incidents_stream".split()


@pytest.mark.parametrize("name", SOME)
def test_equals_sql(spark, name):
    same(spark, name, QUERIES[name], ORACLE[name])


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())


def test_calibration_is_monotone(spark):
    for r in QUERIES["m2_fit_calibration"](spark, f"{DATA}/sf0.001").collect():
        assert r.ys == sorted(r.ys) and r.xs == sorted(r.xs)


def test_calibrated_sums_to_one(spark):
    from pyspark.sql import functions as F

    rows = QUERIES["m3_apply_calibration"](spark, f"{DATA}/sf0.001").groupBy("race_id").agg(F.sum("calibrated").alias("s")).where("s is not null and abs(s - 1) > 1e-9")
    assert rows.count() == 0


def test_calibration_equals_plain_pooling(spark):
    """Pooled adjacent violators over all points at once, and what the curve gives: the same as in ranges."""
    import numpy as np

    from furlong.operators import models as M

    rng = np.random.default_rng(1)
    x = np.round(rng.random(400), 2)
    rows = [(str(i % 2), float(v), bool(rng.random() < v)) for i, v in enumerate(x)] + [("0", None, True)]
    got = {r.bucket: (r.xs, r.ys) for r in M.fit_isotonic(spark.createDataFrame(rows, "b string, s double, y boolean"), "b", "s", "y", points=9, fan_in=3).collect()}
    for bucket in ("0", "1", None):
        mine = [(v, y) for b, v, y in rows if v is not None and bucket in (b, None)]
        points = sorted({v for v, _ in mine})
        fit = []
        for p in points:  # the isotonic fit at a point: the largest over starts of the least over ends of the mean between
            mean = lambda a, b: np.mean([y for v, y in mine if a <= v <= b])
            fit.append(max(min(mean(a, b) for b in points if b >= p) for a in points if a <= p) if len(points) <= 120 else None)
        assert np.allclose(np.interp(points, *got[bucket]), fit)


def test_calibration_lowers_the_brier_score(spark):
    """On the rows it was fitted on, no monotone change of the score has a smaller squared error, so leaving it as it is has not."""
    rows = QUERIES["m2_brier"](spark, f"{DATA}/sf0.001").collect()
    assert rows and all(r.brier_calibrated <= r.brier_p + 1e-12 for r in rows) and any(r.brier_calibrated < r.brier_p - 1e-4 for r in rows)


def test_bootstrap_equals_plain_resampling(spark):
    """The same weights drawn in Python from the same hashes give the same means."""
    import math

    import numpy as np
    from pyspark.sql import functions as F

    from furlong.operators import metrics as M

    rows = [(i, float(i % 5) - 1.5) for i in range(60)]
    df = spark.createDataFrame(rows, "k long, d double")
    hashes = df.crossJoin(spark.range(40).select(F.col("id").cast("int").alias("r"))).select("k", "r", F.pmod(F.xxhash64("k", "r"), F.lit(1 << 40)).alias("h")).collect()
    steps = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(8)])
    weight = {(x.k, x.r): int((steps < (x.h + 0.5) / (1 << 40)).sum()) for x in hashes}
    means = [sum(weight[k, r] * d for k, d in rows) / sum(weight[k, r] for k, _ in rows) for r in range(40)]
    got = M.bootstrap_bound(df, "d", "k", replicates=40).first()
    assert abs(got["mean"] - np.mean(means)) < 1e-12 and abs(got.lower - np.quantile(means, 0.025)) < 1e-12


def test_bootstrap_bound_is_below_mean_and_repeatable(spark):
    one, two = (QUERIES["a25_bootstrap"](spark, f"{DATA}/sf0.001").first() for _ in (0, 1))
    assert one == two and one.lower <= one["mean"]
