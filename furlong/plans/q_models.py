"""Queries of the model operators (M) and of quality checks (Q)."""

from __future__ import annotations

import json

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import models as M
from ..operators import quality as Q
from ..operators import relative as R
from ..operators import trees as T
from ..sources.tables import folder
from .registry import query
from .views import entries, table

R6 = lambda c: F.round(c, 6)
KEY = ("race_id", "horse")
TREES = [
    {"feature": "odds", "threshold": 6.0, "left": {"feature": "body_weight", "threshold": 420.0, "left": {"value": 0.3}, "right": {"value": 0.5}}, "right": {"value": 0.1}},
    {"feature": "carried", "threshold": 54.0, "left": {"value": 0.05}, "right": {"feature": "age", "threshold": 5, "left": {"value": -0.05}, "right": {"value": 0.02}}},
]


@query("m1_score_trees", "SELECT race_id, horse, round(s, 6) AS score, row_number() OVER (PARTITION BY race_id ORDER BY s DESC, horse)::BIGINT AS predicted_rank FROM (SELECT race_id, horse, CASE WHEN odds < 6 THEN CASE WHEN body_weight < 420 THEN 0.3 ELSE 0.5 END ELSE 0.1 END::DOUBLE + CASE WHEN carried < 54 THEN 0.05 ELSE CASE WHEN age < 5 THEN -0.05 ELSE 0.02 END END::DOUBLE AS s FROM e)")
def m1(spark, d):
    df = T.score_forest(entries(spark, d), T.from_nested(TREES))
    return R.ordinal(df, "score").select(*KEY, R6("score").alias("score"), "predicted_rank")


#: One small model in each file format. `odds` is missing for every fifth horse; `venue` is a category.
OBLIVIOUS = {
    "features_info": {"float_features": [{"feature_index": 0, "flat_feature_index": 0, "feature_id": "odds_seen", "nan_value_treatment": "AsTrue"}, {"feature_index": 1, "flat_feature_index": 2, "feature_id": "body_weight", "nan_value_treatment": "AsFalse"}], "categorical_features": [{"feature_index": 0, "flat_feature_index": 1, "feature_id": "venue"}]},
    "oblivious_trees": [
        {"splits": [{"split_type": "FloatFeature", "float_feature_index": 0, "border": 6.0}, {"split_type": "OneHotFeature", "cat_feature_index": 0, "values": [3, 7]}], "leaf_values": [0.125, -0.25, 0.5, 0.75]},
        {"splits": [{"split_type": "FloatFeature", "float_feature_index": 1, "border": 420.0}], "leaf_values": [0.0625, -0.03125]},
    ],
    "scale_and_bias": [2.0, [0.25]],
}
BOOSTED = {
    "learner": {
        "feature_names": ["odds_seen", "body_weight", "venue"],
        "learner_model_param": {"base_score": "[5E-1]", "num_feature": "3", "num_class": "0"},
        "gradient_booster": {"model": {"tree_info": [0, 0], "trees": [
            {"left_children": [1, 3, -1, -1, -1], "right_children": [2, 4, -1, -1, -1], "split_indices": [0, 1, 0, 0, 0], "split_conditions": [6.0, 420.0, 0.125, 0.25, 0.5], "base_weights": [0.0, 0.0, 0.125, 0.25, 0.5], "default_left": [0, 1, 0, 0, 0]},
            {"left_children": [1, -1, -1], "right_children": [2, -1, -1], "split_indices": [2, 0, 0], "split_conditions": [0.0, -0.125, 0.0625], "base_weights": [0.0, -0.125, 0.0625], "default_left": [1, 0, 0], "categories_nodes": [0], "categories_segments": [0], "categories_sizes": [2], "categories": [3, 7]},
        ]}},
    }
}
_LEAF = lambda v: {"leaf_value": v}
LEAFWISE = {
    "num_class": 3, "num_tree_per_iteration": 3, "class_labels": ["front", "near", "rear"], "feature_names": ["odds_seen", "body_weight", "venue"],
    "trees": [
        {"tree_structure": {"split_feature": 0, "threshold": 6.0, "decision_type": "<=", "default_left": False, "left_child": _LEAF(0.5), "right_child": _LEAF(-0.5)}},
        {"tree_structure": {"split_feature": 2, "threshold": "3||7", "decision_type": "==", "default_left": False, "left_child": _LEAF(1.0), "right_child": {"split_feature": 1, "threshold": 430.0, "decision_type": "<=", "default_left": True, "left_child": _LEAF(0.25), "right_child": _LEAF(0.0)}}},
        {"tree_structure": _LEAF(0.125)},
    ],
}
SEEN = "CASE WHEN horse % 5 > 0 THEN odds END"


def model_file(spark, model: dict):
    """The forest of a model that was written as a file into the shared folder, and read back."""
    path = folder(spark, "model")
    spark.createDataFrame([(json.dumps(model),)], "value string").coalesce(1).write.text(path)
    return T.read_forest(spark, path)


def seen(spark, d):
    return entries(spark, d).withColumn("odds_seen", F.when(F.col("horse") % 5 > 0, F.col("odds")))


@query("m1_oblivious_file", f"SELECT race_id, horse, s AS score, row_number() OVER (PARTITION BY race_id ORDER BY s DESC, horse)::BIGINT AS predicted_rank FROM (SELECT race_id, horse, (2 * (CASE WHEN venue IN (3, 7) THEN CASE WHEN coalesce(o > 6, true) THEN 0.75 ELSE 0.5 END ELSE CASE WHEN coalesce(o > 6, true) THEN -0.25 ELSE 0.125 END END + CASE WHEN body_weight > 420 THEN -0.03125 ELSE 0.0625 END) + 0.25)::DOUBLE AS s FROM (SELECT *, {SEEN} AS o FROM e))")
def m1o(spark, d):
    return R.ordinal(T.score_forest(seen(spark, d), model_file(spark, OBLIVIOUS)), "score").select(*KEY, "score", "predicted_rank")


@query("m1_boosted_file", f"SELECT race_id, horse, s AS score, row_number() OVER (PARTITION BY race_id ORDER BY s DESC, horse)::BIGINT AS predicted_rank FROM (SELECT race_id, horse, (0.5 + CASE WHEN o < 6 THEN CASE WHEN body_weight < 420 THEN 0.25 ELSE 0.5 END ELSE 0.125 END + CASE WHEN venue IN (3, 7) THEN 0.0625 ELSE -0.125 END)::DOUBLE AS s FROM (SELECT *, {SEEN} AS o FROM e))")
def m1b(spark, d):
    return R.ordinal(T.score_forest(seen(spark, d), model_file(spark, BOOSTED)), "score").select(*KEY, "score", "predicted_rank")


@query("m1_leafwise_file", f"SELECT race_id, horse, round(exp(a) / (exp(a) + exp(b) + exp(c)), 9) AS front, round(exp(b) / (exp(a) + exp(b) + exp(c)), 9) AS near, round(exp(c) / (exp(a) + exp(b) + exp(c)), 9) AS rear, CASE WHEN a >= b AND a >= c THEN 'front' WHEN b >= c THEN 'near' ELSE 'rear' END AS style FROM (SELECT race_id, horse, CASE WHEN o <= 6 THEN 0.5 ELSE -0.5 END::DOUBLE AS a, CASE WHEN venue IN (3, 7) THEN 1.0 WHEN body_weight <= 430 THEN 0.25 ELSE 0.0 END::DOUBLE AS b, 0.125::DOUBLE AS c FROM (SELECT *, {SEEN} AS o FROM e))")
def m1l(spark, d):
    """Probabilities of three classes, and the label of the largest (the first of equals)."""
    forest = model_file(spark, LEAFWISE)
    df = T.score_forest(seen(spark, d), forest, name="p")
    place = F.array_position("p", F.array_max("p")).cast("int")
    return df.select(*KEY, *(F.round(F.col("p")[i], 9).alias(c) for i, c in enumerate(forest.labels)), F.element_at(F.array(*map(F.lit, forest.labels)), place).alias("style"))


@query("m1_routed_files", f"SELECT race_id, horse, model, (CASE model WHEN 'v1' THEN 0.25 + 2 * (CASE WHEN venue IN (3, 7) THEN CASE WHEN coalesce(o > 6, true) THEN 0.75 ELSE 0.5 END ELSE CASE WHEN coalesce(o > 6, true) THEN -0.25 ELSE 0.125 END END + CASE WHEN body_weight > 420 THEN -0.03125 ELSE 0.0625 END) WHEN 'v2' THEN 0.5 + CASE WHEN o < 6 THEN CASE WHEN body_weight < 420 THEN 0.25 ELSE 0.5 END ELSE 0.125 END + CASE WHEN venue IN (3, 7) THEN 0.0625 ELSE -0.125 END END)::DOUBLE AS score FROM (SELECT *, {SEEN} AS o, CASE WHEN distance < 1400 THEN 'v1' WHEN distance < 2000 THEN 'v2' ELSE 'v3' END AS model FROM e)")
def m1r(spark, d):
    """Each row by the model that its cell is routed to; one whose model is not there has no score."""
    df = M.route_cells(seen(spark, d), [(F.col("distance") < 1400, "v1"), (F.col("distance") < 2000, "v2")], "v3")
    return T.score_forest(df, {"v1": model_file(spark, OBLIVIOUS), "v2": model_file(spark, BOOSTED)}, by="model").select(*KEY, "model", "score")


@query("m2_fit_calibration")
def m2(spark, d):
    df = R.softmax(entries(spark, d), F.col("score_b") / 50, "p").withColumn("won", F.col("finish") == 1)
    return M.fit_isotonic(df, "surface", "p", "won")


@query("m3_apply_calibration")
def m3(spark, d):
    df = R.softmax(entries(spark, d), F.col("score_b") / 50, "p").withColumn("won", F.col("finish") == 1)
    return M.apply_isotonic(df, M.fit_isotonic(df, "surface", "p", "won"), "surface", "p").select(*KEY, "p", "calibrated", "predicted_rank")



def _norm(s):
    return f"CASE WHEN field_size > 1 THEN (field_size - row_number() OVER (PARTITION BY race_id ORDER BY {s} DESC, horse)) / (field_size - 1)::DOUBLE ELSE 0.5 END AS n_{s[-1]}"


N3 = ", n AS (SELECT *, " + ", ".join(_norm(s) for s in ("score_a", "score_b", "score_c")) + " FROM e)\n"


@query("m2_brier")
def m2b(spark, d):
    """Brier score of the raw and of the calibrated probability by bucket; the calibrated one is the curve's value, before renormalising."""
    df = R.softmax(entries(spark, d), F.col("score_b") / 50, "p").withColumn("won", F.col("finish") == 1)
    return M.brier(M.apply_isotonic(df, M.fit_isotonic(df, "surface", "p", "won"), "surface", "p", renormalise=False), ["p", "calibrated"], "won", ["surface"])


@query("m4_blend", N3 + "SELECT race_id, horse, round(0.5 * n_b + 0.3 * n_c + 0.2 * n_a, 6) AS blended, row_number() OVER (PARTITION BY race_id ORDER BY n_b * 0.5 + n_c * 0.3 + n_a * 0.2 DESC, horse)::BIGINT AS blended_rank FROM n")
def m4(spark, d):
    df = M.blend(entries(spark, d), {"score_b": 0.5, "score_c": 0.3, "score_a": 0.2})
    return df.select(*KEY, R6("blended").alias("blended"), "blended_rank")


@query("m5_average", "SELECT race_id, horse, round((score_a + score_b + score_c) / 3, 8) AS score FROM e")
def m5(spark, d):
    e = entries(spark, d)
    preds = J.union_all([e.select(*KEY, F.col(s).alias("score")) for s in ("score_a", "score_b", "score_c")])
    return M.average_ensemble(preds, KEY, ["score"]).select(*KEY, F.round("score", 8).alias("score"))


@query("m5_average_rank", "SELECT race_id, horse, round((ra + rb + rc) / 3, 8)::DOUBLE AS rank_mean, row_number() OVER (PARTITION BY race_id ORDER BY ra + rb + rc, horse)::BIGINT AS place FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY score_a DESC, horse) AS ra, row_number() OVER (PARTITION BY race_id ORDER BY score_b DESC, horse) AS rb, row_number() OVER (PARTITION BY race_id ORDER BY score_c DESC, horse) AS rc FROM e)")
def m5r(spark, d):
    e = entries(spark, d)
    preds = J.union_all([R.ordinal(e, s, "r").select(*KEY, "r") for s in ("score_a", "score_b", "score_c")])
    mean = M.average_ensemble(preds, KEY, ["r"])
    return mean.select(*KEY, F.round("r", 8).alias("rank_mean"), F.row_number().over(W.partitionBy("race_id").orderBy(F.round(F.col("r") * 3), "horse")).cast("long").alias("place"))


@query("m6_search_weights", N3 + ", g AS (SELECT a, b, 4 - a - b AS c, (row_number() OVER (ORDER BY a, b) - 1)::INT AS trial FROM range(5) t(a), range(5) u(b) WHERE a + b <= 4), s AS (SELECT trial, race_id, race_year, horse, finish, 0.0::DOUBLE + n_a * (a / 4) + n_b * (b / 4) + n_c * (c / 4) AS v FROM n, g), p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY trial, race_id ORDER BY v DESC, horse) = 1) SELECT trial, race_year, round(avg((finish = 1)::INT), 6) AS top1, count(*) AS races FROM p GROUP BY ALL")
def m6(spark, d):
    return M.search_weights(entries(spark, d), ["score_a", "score_b", "score_c"], 0.25).select("trial", "race_year", R6("top1").alias("top1"), "races")


@query("m6_stable_weights", N3 + ", g AS (SELECT a, b, 4 - a - b AS c, (row_number() OVER (ORDER BY a, b) - 1)::INT AS trial FROM range(5) t(a), range(5) u(b) WHERE a + b <= 4), s AS (SELECT trial, race_id, race_year, horse, finish, 0.0::DOUBLE + n_a * (a / 4) + n_b * (b / 4) + n_c * (c / 4) AS v FROM n, g), p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY trial, race_id ORDER BY v DESC, horse) = 1), y AS (SELECT trial, race_year, avg((finish = 1)::INT) AS t FROM p GROUP BY ALL), m AS (SELECT trial, avg(t) AS mean, stddev_pop(t) AS spread, min(t) AS least FROM y GROUP BY trial) SELECT trial, round(mean, 6) AS mean, round(spread, 6) AS spread, round(least, 6) AS least, row_number() OVER (ORDER BY round(mean - 0.5 * spread, 9) DESC, trial)::BIGINT AS place FROM m")
def m6s(spark, d):
    t = M.most_stable(M.search_weights(entries(spark, d), ["score_a", "score_b", "score_c"], 0.25), "top1")
    return t.select("trial", *(R6(c).alias(c) for c in ("mean", "spread", "least")), "place")


@query("m7_opinion_pool", ", p AS (SELECT race_id, horse, score_a / sum(score_a) OVER w AS pa, (1 / odds) / sum(1 / odds) OVER w AS po FROM e WINDOW w AS (PARTITION BY race_id)), v AS (SELECT *, exp(0.6 * ln(pa) + 0.4 * ln(po)) AS v FROM p) SELECT race_id, horse, round(v / sum(v) OVER (PARTITION BY race_id), 6) AS pooled FROM v")
def m7(spark, d):
    e = R.share(R.share(entries(spark, d), "score_a", "pa").withColumn("i", 1 / F.col("odds")), "i", "po")
    return M.opinion_pool(e, {"pa": 0.6, "po": 0.4}).select(*KEY, R6("pooled").alias("pooled"))


@query("m8_walk_forward", ", j AS (SELECT y.y AS fold, jockey, avg((finish = 1)::INT) AS rate FROM e, (VALUES (1998), (1999), (2000)) y(y) WHERE race_year < y.y GROUP BY ALL) SELECT fold, race_id, horse, round(coalesce(rate, 0), 6) AS score FROM e JOIN (VALUES (1998), (1999), (2000)) y(y) ON race_year = y.y LEFT JOIN j USING (jockey) WHERE fold = y.y")
def m8(spark, d):
    def rate(train, test):
        rates = train.groupBy("jockey").agg(F.avg((F.col("finish") == 1).cast("int")).alias("rate"))
        return test.join(rates, "jockey", "left").select(*KEY, R6(F.coalesce("rate", F.lit(0.0))).alias("score"))

    return M.walk_forward(entries(spark, d), [1998, 1999, 2000], rate)


@query("m8_linear_folds", ", y AS (SELECT DISTINCT race_year AS f FROM e WHERE race_year > (SELECT min(race_year) FROM e)), c AS (SELECT f, var_pop(odds) AS s11, var_pop(carried) AS s22, covar_pop(odds, carried) AS s12, covar_pop(finish, odds) AS c1, covar_pop(finish, carried) AS c2, avg(odds) AS m1, avg(carried) AS m2, avg(finish) AS m FROM e JOIN y ON race_year < f GROUP BY f), w AS (SELECT *, (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1, (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2 FROM c) SELECT race_id, horse, race_year, round(m + b1 * (odds - m1) + b2 * (carried - m2), 6) AS score FROM e JOIN w ON race_year = f")
def m8lin(spark, d):
    """Least squares of the finish by odds and carried weight; every year but the first is scored by the years before it."""
    e = entries(spark, d)
    features = ["odds", "carried"]
    return M.score_folds(e, M.fit_linear_folds(e, features, "finish"), features).select(*KEY, "race_year", R6("score").alias("score"))


@query("m8_logistic_folds")
def m8log(spark, d):
    """The chance to win by odds, weights and age, fitted for every year but the first on the years before it, and the rank in the race by it."""
    e = entries(spark, d).withColumn("won", (F.col("finish") == 1).cast("int"))
    features = ["odds", "carried", "body_weight", "age", "field_size"]
    df = M.score_folds(e, M.fit_logistic_folds(e, features, "won"), features, logistic=True)
    return R.ordinal(df, "score").select(*KEY, "race_year", R6("score").alias("score"), "predicted_rank")


@query("m9_sample_weights", "SELECT race_id, horse, round(greatest(0.5, least(1.75, (0.5 + 0.5 * (race_year - (SELECT min(race_year) FROM e)) / (SELECT max(race_year) - min(race_year) FROM e)) * (1 + 0.8 * (venue < 5)::INT))), 6) AS weight FROM e")
def m9(spark, d):
    return M.sample_weights(entries(spark, d), F.col("venue") < 5, 0.8).select(*KEY, R6("weight").alias("weight"))


@query("m10_group_kfold", "SELECT DISTINCT race_id, (f - 1) % 5 AS fold FROM (SELECT race_id, row_number() OVER (PARTITION BY venue, race_year ORDER BY md5(race_id || ':0'), race_id) AS f FROM (SELECT DISTINCT race_id, venue, race_year FROM e))")
def m10(spark, d):
    return M.group_kfold(entries(spark, d), "race_id", ["venue", "race_year"], 5).select("race_id", "fold").distinct()


@query("m11_stacking", "SELECT race_id, horse, round(CASE WHEN max(score_b) OVER w > min(score_b) OVER w THEN (score_b - min(score_b) OVER w) / (max(score_b) OVER w - min(score_b) OVER w) ELSE 0.5 END, 6) AS score_b_scaled, (surface = 'F')::INT AS surface_F, (surface = 'O')::INT AS surface_O FROM e WINDOW w AS (PARTITION BY race_id)")
def m11(spark, d):
    return M.stacking(entries(spark, d), ["score_b"], {"surface": ["F", "O"]}).select(*KEY, R6("score_b_scaled").alias("score_b_scaled"), "surface_F", "surface_O")


@query("m12_route_cells", "SELECT race_id, horse, CASE WHEN surface = 'F' AND distance < 1400 THEN 'sprint' WHEN venue = 3 THEN 'venue3' WHEN class = '1-URGENT' THEN 'graded' ELSE 'base' END AS model FROM e")
def m12(spark, d):
    rules = [((F.col("surface") == "F") & (F.col("distance") < 1400), "sprint"), (F.col("venue") == 3, "venue3"), (F.col("class") == "1-URGENT", "graded")]
    return M.route_cells(entries(spark, d), rules, "base").select(*KEY, "model")


@query("m13_impute_prior", ", x AS (SELECT *, CASE WHEN horse % 4 > 0 THEN odds END AS o FROM e), c AS (SELECT venue, distance, avg(o) AS m, count(o) AS n FROM x WHERE race_date < DATE '1999-01-01' GROUP BY ALL) SELECT race_id, horse, x.o IS NULL AS o_imputed, round(coalesce(x.o, CASE WHEN n >= 20 THEN m END, (SELECT avg(o) FROM x WHERE race_date < DATE '1999-01-01')), 10) AS o FROM x LEFT JOIN c USING (venue, distance)")
def m13(spark, d):
    x = entries(spark, d).withColumn("o", F.when(F.col("horse") % 4 > 0, F.col("odds")))
    return M.impute_prior(x, ["o"], ["venue", "distance"], F.col("race_date") < "1999-01-01").select(*KEY, "o_imputed", F.round("o", 10).alias("o"))


@query("m14_subset_metrics", N3 + ", s AS (SELECT race_id, horse, finish, unnest([0, 1, 2, 3]) AS mask, unnest([n_a, n_b, n_a + n_c, n_a + n_b + n_c]) AS v FROM n), p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY mask, race_id ORDER BY v DESC, horse) = 1) SELECT mask, round(avg((finish = 1)::INT), 6) AS top1, count(*) AS races FROM p GROUP BY mask")
def m14(spark, d):
    df = entries(spark, d)
    for s in ("a", "b", "c"):
        df = R.rank_norm(df, f"score_{s}", f"n_{s}")
    return M.subset_metrics(df, ["n_a", "n_b", "n_c"], [[0], [1], [0, 2], [0, 1, 2]]).select("mask", R6("top1").alias("top1"), "races")


@query("m14_subset_folds", N3 + ", s AS (SELECT race_id, horse, finish, race_year, unnest([0, 1, 2, 3]) AS mask, unnest([n_a, n_b, n_a + n_c, n_a + n_b + n_c]) AS v FROM n), p AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY mask, race_id ORDER BY v DESC, horse) = 1), f AS (SELECT mask, race_year, avg((finish = 1)::INT) AS t FROM p GROUP BY ALL) SELECT mask, count(*) AS folds, round(avg(t), 6) AS top1, row_number() OVER (ORDER BY round(avg(t), 9) DESC, mask)::BIGINT AS place FROM f GROUP BY mask")
def m14f(spark, d):
    """Every mask by fold (year), and the masks in order."""
    df = entries(spark, d)
    for s in ("a", "b", "c"):
        df = R.rank_norm(df, f"score_{s}", f"n_{s}")
    folds = M.subset_metrics(df, ["n_a", "n_b", "n_c"], [[0], [1], [0, 2], [0, 1, 2]], fold="race_year")
    t = folds.groupBy("mask").agg(F.count("*").alias("folds"), F.avg("top1").alias("t"))
    return t.select("mask", "folds", R6("t").alias("top1"), F.row_number().over(W.orderBy(F.desc(F.round("t", 9)), "mask")).cast("long").alias("place"))


@query("m15_override", ", r AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY score_b DESC, horse) AS r FROM e), s AS (SELECT *, max((venue < 10)::INT) OVER w = 1 AND max(CASE WHEN r = 2 THEN odds END) OVER w < max(CASE WHEN r = 1 THEN odds END) OVER w AS swap FROM r WINDOW w AS (PARTITION BY race_id)) SELECT race_id, horse, (CASE WHEN swap AND r = 1 THEN 2 WHEN swap AND r = 2 THEN 1 ELSE r END)::BIGINT AS predicted_rank FROM s")
def m15(spark, d):
    return M.override_top_two(R.ordinal(entries(spark, d), "score_b"), "predicted_rank", "odds", F.col("venue") < 10).select(*KEY, "predicted_rank")


@query("m16_style_order", ", p AS (SELECT race_id, horse, horse_no, 0.25 * (popularity / field_size::DOUBLE) + 0.6 * (corner1 / field_size::DOUBLE) AS s, CASE WHEN corner1 = 1 THEN 0 ELSE 1 END AS tier FROM e) SELECT race_id, horse, row_number() OVER (PARTITION BY race_id ORDER BY tier, round(s, 9), horse_no)::BIGINT AS position FROM p")
def m16(spark, d):
    e = entries(spark, d)
    s = 0.25 * (F.col("popularity") / F.col("field_size")) + 0.6 * (F.col("corner1") / F.col("field_size"))
    tier = F.when(F.col("corner1") == 1, 0).otherwise(1)
    return e.select(*KEY, F.row_number().over(R.race().orderBy(tier, F.round(s, 9), "horse_no")).cast("long").alias("position"))


@query("m17_pace_table", "SELECT horse, count(*) AS runs, round((sum(w * c) + 3 * 0.5) / (sum(w) + 3), 6) AS corner FROM (SELECT horse, (corner1 - 1) / greatest(field_size - 1, 1)::DOUBLE AS c, 1 / (1 + (11600 - day) / 365.0) AS w FROM e) GROUP BY horse")
def m17(spark, d):
    """Weighted mean corner place, drawn to the middle while a horse has few runs."""
    c = (F.col("corner1") - 1) / F.greatest(F.col("field_size") - 1, F.lit(1))
    w = 1 / (1 + (11600 - F.col("day")) / 365.0)
    return entries(spark, d).groupBy("horse").agg(F.count("*").alias("runs"), R6((F.sum(w * c) + 1.5) / (F.sum(w) + 3)).alias("corner"))


@query("m18_leg_probabilities", ", x AS (SELECT race_id, horse, CASE WHEN horse % 50 > 0 THEN score_b / 50 END AS s, -odds / 10 AS h FROM e), z AS (SELECT *, CASE WHEN bool_and(s IS NOT NULL) OVER (PARTITION BY race_id) THEN s / 0.4 ELSE h / 0.65 END AS z FROM x), y AS (SELECT *, greatest(exp(z - max(z) OVER (PARTITION BY race_id)), 0.001) AS v FROM z) SELECT race_id, horse, round(v / sum(v) OVER (PARTITION BY race_id), 6) AS p FROM y")
def m18(spark, d):
    x = entries(spark, d).withColumn("s", F.when(F.col("horse") % 50 > 0, F.col("score_b") / 50))
    whole = F.min(F.col("s").isNotNull()).over(R.race())
    z = F.when(whole, F.col("s") / 0.4).otherwise(-F.col("odds") / 10 / 0.65)
    return R.softmax(x.withColumn("z", z), F.col("z"), "p", temperature=1.0).select(*KEY, R6("p").alias("p"))


@query("m19_extract_rows", r"SELECT page_id, i - 1 AS place, regexp_extract(x, 'href=\"([^\"]*)\"', 1) AS href, regexp_replace(x, '<[^>]+>', '', 'g') AS text FROM (SELECT page_id, unnest(l) AS x, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '<li>.*?</li>') AS l FROM pages))", base=False)
def m19(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit("<li>.*?</li>"), F.lit(0))).alias("place", "x"))
    return rows.select("page_id", F.col("place").cast("long").alias("place"), F.regexp_extract("x", 'href="([^"]*)"', 1).alias("href"), F.regexp_replace("x", "<[^>]+>", "").alias("text"))


@query("m20_component_score", ", x AS (SELECT race_id, horse, CASE WHEN horse % 3 > 0 THEN 1 / odds END AS a, CASE WHEN horse % 5 > 0 THEN score_c / 10000 END AS b FROM e) SELECT race_id, horse, round((coalesce(a * 0.7, 0) + coalesce(b * 0.3, 0)) / nullif((a IS NOT NULL)::INT * 0.7 + (b IS NOT NULL)::INT * 0.3, 0), 3)::DOUBLE AS score, round((a IS NOT NULL)::INT * 0.7 + (b IS NOT NULL)::INT * 0.3, 4)::DOUBLE AS confidence FROM x")
def m20(spark, d):
    a, b = F.when(F.col("horse") % 3 > 0, 1 / F.col("odds")), F.when(F.col("horse") % 5 > 0, F.col("score_c") / 10000)
    value, sure = M.component_score({"a": (a, 0.7), "b": (b, 0.3)})
    return entries(spark, d).select(*KEY, F.round(value, 3).alias("score"), F.round(sure, 4).alias("confidence"))


@query("q1_completeness", ", x AS (SELECT *, CASE WHEN horse % 4 > 0 THEN odds END AS o FROM e) SELECT 'o' AS \"column\", false AS missing, round(1 - count(o) / count(*)::DOUBLE, 6) AS null_rate, NULL::BIGINT AS flat_groups FROM x UNION ALL SELECT 'ghost', true, NULL, NULL UNION ALL SELECT 'carried', false, 0, (SELECT count(*) FROM (SELECT race_id FROM e GROUP BY race_id HAVING count(*) > 1 AND min(carried) = max(carried)))")
def q1(spark, d):
    x = entries(spark, d).withColumn("o", F.when(F.col("horse") % 4 > 0, F.col("odds")))
    return Q.completeness(x, ["o", "ghost", "carried"], ["carried"]).select("column", "missing", R6("null_rate").alias("null_rate"), "flat_groups")


@query("q2_missing_fraction", "SELECT race_id, round(sum((horse % 4 = 0)::INT + (horse % 6 = 0)::INT) / (count(*) * 2.0)::DOUBLE, 6) AS missing, count(*) > 1 AND count(DISTINCT (horse % 4 > 0, horse % 6 > 0)) = 1 AS degenerate FROM e GROUP BY race_id")
def q2(spark, d):
    x = entries(spark, d).select("race_id", F.when(F.col("horse") % 4 > 0, 1).alias("a"), F.when(F.col("horse") % 6 > 0, 1).alias("b"))
    return Q.missing_fraction(x, ["a", "b"]).select("race_id", R6("missing").alias("missing"), "degenerate")


@query("q3_feature_parity", ", c AS (SELECT count(DISTINCT odds) AS odds, count(DISTINCT flat) AS flat, count(DISTINCT venue) AS venue FROM (SELECT odds, venue, 1 AS flat FROM e)) SELECT 'odds' AS \"column\", CASE WHEN odds > 1 THEN 'ok' ELSE 'dead' END AS status FROM c UNION ALL SELECT 'flat', CASE WHEN flat > 1 THEN 'ok' ELSE 'dead' END FROM c UNION ALL SELECT 'ghost', 'missing' UNION ALL SELECT 'venue', 'extra'")
def q3(spark, d):
    return Q.feature_parity(entries(spark, d).select("odds", "venue", F.lit(1).alias("flat")), ["odds", "flat", "ghost"])


@query("q4_classify_diff", "SELECT \"column\", kind, count(*) AS n FROM (SELECT 'a' AS \"column\", CASE WHEN o IS NOT DISTINCT FROM w THEN 'unchanged' WHEN o IS NULL THEN 'enriched' WHEN w IS NULL THEN 'regression' ELSE 'changed' END AS kind FROM (SELECT CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS o, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 3 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS w FROM customer)) GROUP BY ALL", base=False)
def q4(spark, d):
    c = table(spark, d, "customer")
    old = c.selectExpr("c_custkey id", "if(c_custkey % 5 > 0, c_nationkey, null) a")
    new = c.selectExpr("c_custkey id", "case when c_custkey % 7 = 0 then null when c_custkey % 3 = 0 then c_nationkey + 1 else c_nationkey end a")
    return Q.classify_diff(old, new, ["id"], ["a"]).groupBy("column", "kind").agg(F.count("*").alias("n"))


@query("q4_block_regression", "SELECT 'a' AS \"column\", count(*) FILTER (WHERE o IS NOT NULL AND w IS NULL) AS regressions, count(*) FILTER (WHERE o IS NOT NULL AND w IS NULL) > 0 AS blocked FROM (SELECT CASE WHEN c_custkey % 5 > 0 THEN c_nationkey END AS o, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_nationkey END AS w FROM customer)", base=False)
def q4b(spark, d):
    c = table(spark, d, "customer")
    old, new = c.selectExpr("c_custkey id", "if(c_custkey % 5 > 0, c_nationkey, null) a"), c.selectExpr("c_custkey id", "if(c_custkey % 7 = 0, null, c_nationkey) a")
    return Q.block_regressions(Q.classify_diff(old, new, ["id"], ["a"]))


@query("q5_idempotent_write", "SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE 'old' END AS state, c_custkey % 4 = 0 AND c_custkey % 8 = 0 AS migrated FROM customer", base=False)
def q5(spark, d):
    """Rows known by a placeholder id are moved to their real one, then updates win; writing twice gives the same table."""
    c = table(spark, d, "customer")
    target = c.selectExpr("if(c_custkey % 8 = 0, -1 - c_custkey, c_custkey) id", "'old' state", "c_custkey alt")
    updates = c.where("c_custkey % 4 = 0").selectExpr("c_custkey id", "'new' state", "c_custkey alt")
    moved = target.join(updates.select(F.col("id").alias("real"), "alt"), "alt", "left").select(F.when(F.col("id") < 0, F.coalesce("real", "id")).otherwise(F.col("id")).alias("id"), "state", "alt", ((F.col("id") < 0) & F.col("real").isNotNull()).alias("migrated"))
    once = Q.upsert(moved.select("id", "state"), updates.select("id", "state"), ["id"])
    return Q.upsert(once, updates.select("id", "state"), ["id"]).join(moved.select("id", "migrated"), "id")


@query("q5_conflicts", "SELECT count(*) FILTER (WHERE k % 6 = 0) AS inserted, count(*) FILTER (WHERE k % 6 > 0 AND k % 10 > 0 AND k % 4 > 0) AS unchanged, count(*) FILTER (WHERE k % 6 > 0 AND k % 10 = 0 AND k % 4 > 0) AS filled, count(*) FILTER (WHERE k % 6 > 0 AND k % 4 = 0) AS conflicts, count(*) FILTER (WHERE k % 6 > 0 AND k % 4 = 0)::BIGINT AS conflicting_fields FROM (SELECT c_custkey AS k FROM customer)", base=False)
def q5c(spark, d):
    """What a write would insert, leave, fill and overwrite."""
    c = table(spark, d, "customer")
    target = c.where("c_custkey % 6 > 0").selectExpr("c_custkey id", "c_nationkey nation", "if(c_custkey % 10 = 0, null, c_name) name")
    updates = c.selectExpr("c_custkey id", "if(c_custkey % 4 = 0, c_nationkey + 1, c_nationkey) nation", "c_name name")
    return Q.write_report(target, updates, ["id"], ["nation", "name"])


@query("q6_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1", base=False)
def q6(spark, d):
    return Q.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("q6_remove_duplicates", "SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC NULLS LAST, l_linenumber) = 1", base=False)
def q6r(spark, d):
    """Of rows with one key, the one with the newest date stays."""
    t = table(spark, d, "lineitem")
    return J.dedupe_priority(t, ["l_orderkey", "l_partkey"], [F.desc_nulls_last("l_shipdate"), "l_linenumber"]).select("l_orderkey", "l_partkey", "l_linenumber")


@query("q1_verdict", ", x AS (SELECT *, CASE WHEN horse % 4 > 0 THEN odds END AS o FROM e) SELECT 'o' AS \"column\", 1 - count(o) / count(*)::DOUBLE <= 0.1 AS complete FROM x UNION ALL SELECT 'ghost', false UNION ALL SELECT 'carried', true", base=True)
def q1v(spark, d):
    """A column passes if it is there and at most a tenth of it is null."""
    x = entries(spark, d).withColumn("o", F.when(F.col("horse") % 4 > 0, F.col("odds")))
    return Q.completeness(x, ["o", "ghost", "carried"]).select("column", (~F.col("missing") & (F.coalesce("null_rate", F.lit(1.0)) <= 0.1)).alias("complete"))


@query("q7_resolve", "SELECT c_custkey AS id, coalesce((SELECT min(s_suppkey)::VARCHAR FROM supplier WHERE regexp_extract(s_name, '[0-9]+$') = regexp_extract(c_name, '[0-9]+$')), 'X' || regexp_extract(c_name, '[0-9]+$')) AS code FROM customer", base=False)
def q7(spark, d):
    digits = lambda c: F.regexp_extract(c, "[0-9]+$", 0)
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), digits("c_name").alias("name"))
    master = table(spark, d, "supplier").select(digits("s_name").alias("name"), F.col("s_suppkey").alias("code"))
    return Q.resolve_entities(rows, [master], "name", "code", "X").select("id", "code")


@query("q8_coverage_by_year", "SELECT coalesce(a.y, b.y)::INT AS race_year, coalesce(a.n, 0) AS orders, coalesce(b.n, 0) AS shipped FROM (SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT year(l_shipdate) AS y, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) b ON a.y = b.y", base=False)
def q8(spark, d):
    a = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("race_year")).agg(F.count("*").alias("orders"))
    b = table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("race_year")).agg(F.count_distinct("l_orderkey").alias("shipped"))
    return J.outer_merge(a, b, ["race_year"]).fillna(0)


@query("q9_workouts", "SELECT e.race_id, e.horse, w.value AS workout FROM e LEFT JOIN (SELECT user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id) w ON ltrim(lpad(e.horse::VARCHAR, 6, '0'), '0') = w.user_id::VARCHAR")
def q9(spark, d):
    w = J.latest(table(spark, d, "events").select(F.col("user_id").cast("string").alias("number"), "ts", "event_id", "value"), ["number"], ["ts", "event_id"]).select("number", F.col("value").alias("workout"))
    e = entries(spark, d).select(*KEY, F.ltrim(F.lpad(F.col("horse").cast("string"), 6, "0"), F.lit("0")).alias("number"))
    return e.join(w, "number", "left").select(*KEY, "workout")


@query("q10_untested", ", t AS (SELECT venue, class, race_year, md5(array_to_string(list_sort(list(DISTINCT surface)), ',')) AS features, min(race_id) AS trial FROM e GROUP BY ALL), y AS (SELECT DISTINCT race_year FROM e), c AS (SELECT n_nationkey AS venue, o_orderpriority AS class, race_year FROM nation, (SELECT DISTINCT o_orderpriority FROM orders), y) SELECT c.venue, c.class, c.race_year::INT AS race_year, CASE WHEN t.venue IS NULL THEN 'untested' ELSE 'duplicate' END AS state, p.first AS earlier FROM c LEFT JOIN t USING (venue, class, race_year) LEFT JOIN (SELECT venue, class, features, min(race_year)::INT AS first FROM t GROUP BY ALL) p ON p.venue = t.venue AND p.class = t.class AND p.features = t.features WHERE t.venue IS NULL OR p.first < t.race_year")
def q10(spark, d):
    """A registry of trials by cell and year: cells never tried, and trials whose feature set the same cell had in an earlier year."""
    e = entries(spark, d)
    tried = e.groupBy("venue", "class", F.col("race_year").cast("int").alias("race_year")).agg(S.set_hash(F.collect_set("surface")).alias("features"))
    years, classes = e.select(F.col("race_year").cast("int").alias("race_year")).distinct(), table(spark, d, "orders").select(F.col("o_orderpriority").alias("class")).distinct()
    cells = table(spark, d, "nation").select(F.col("n_nationkey").alias("venue")).crossJoin(J.small(classes)).crossJoin(J.small(years))
    untested = J.without(cells, tried, ["venue", "class", "race_year"]).select("venue", "class", "race_year", F.lit("untested").alias("state"), F.lit(None).cast("int").alias("earlier"))
    first = tried.withColumn("earlier", F.min("race_year").over(W.partitionBy("venue", "class", "features")))
    return untested.unionByName(first.where("earlier < race_year").select("venue", "class", "race_year", F.lit("duplicate").alias("state"), "earlier"))


@query("q11_parity", "SELECT round(max(abs(score_a - score_a * 1.0001)), 6) AS max_a, round(max(abs(score_b - score_c)), 4) AS max_b, round(avg(((score_a >= score_b) = (score_a * 1.0001 >= score_c))::INT), 6) AS agreement, count(*) FILTER (WHERE greatest(abs(score_a - score_a * 1.0001), abs(score_b - score_c)) > 0.01) AS beyond, round(max(abs(0.0 + score_a + score_b - (0.0 + score_a * 1.0001 + score_c))), 4) AS sum_gap, count(*) AS rows FROM e")
def q11(spark, d):
    e = entries(spark, d)
    a, b = e.select(*KEY, F.col("score_a").alias("a"), F.col("score_b").alias("b")), e.select(*KEY, (F.col("score_a") * 1.0001).alias("a"), F.col("score_c").alias("b"))
    return Q.parity(a, b, KEY, ["a", "b"], 0.01).select(R6("max_a").alias("max_a"), F.round("max_b", 4).alias("max_b"), R6("agreement").alias("agreement"), "beyond", F.round("sum_gap", 4).alias("sum_gap"), "rows")
