"""Queries of the aggregate and evaluation operators (A)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import relative as R
from ..sources.tables import cut
from .registry import query
from .views import RUNS, entries, last, table

R6 = lambda c: F.round(c, 6)
PRED = ", p AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY score_b DESC, horse) AS r FROM e)\n"


def predicted(spark, d):
    return R.ordinal(entries(spark, d), "score_b")


@query("a1_rate", "SELECT jockey, round(avg((finish = 1)::INT), 6) AS win_rate, round(avg((finish = 1)::INT) FILTER (WHERE surface = 'F'), 6) AS win_rate_f FROM e GROUP BY jockey")
def a1(spark, d):
    win = F.col("finish") == 1
    return entries(spark, d).groupBy("jockey").agg(R6(M.rate(win)).alias("win_rate"), R6(M.rate(win, F.col("surface") == "F")).alias("win_rate_f"))


@query("a2_agg_if", "SELECT venue, count(*) FILTER (WHERE finish = 1 AND odds > 8) AS upsets, max(odds) FILTER (WHERE finish = 1) AS longest, min(odds) FILTER (WHERE finish > 3) AS shortest_lost FROM e GROUP BY venue")
def a2(spark, d):
    f = F.col("finish")
    return entries(spark, d).groupBy("venue").agg(F.count_if((f == 1) & (F.col("odds") > 8)).alias("upsets"), F.max(F.when(f == 1, F.col("odds"))).alias("longest"), F.min(F.when(f > 3, F.col("odds"))).alias("shortest_lost"))


@query("a3_finish_counts", "SELECT c_custkey AS owner, count(race_id) AS starts, count(*) FILTER (WHERE finish = 1) AS wins, count(*) FILTER (WHERE finish <= 2) AS places, count(*) FILTER (WHERE finish <= 3) AS shows FROM customer LEFT JOIN e ON owner = c_custkey GROUP BY c_custkey")
def a3(spark, d):
    owners = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"))
    return owners.join(M.finish_counts(entries(spark, d), ["owner"]), "owner", "left").fillna(0, ["starts", "wins", "places", "shows"])


@query("a4_median", "SELECT venue, round(median(odds), 6) AS median_odds, round(quantile_cont(time, 0.9), 4) AS time_p90 FROM e GROUP BY venue")
def a4(spark, d):
    t = M.percentiles(entries(spark, d), ["venue"], median_odds=("odds", 0.5), time_p90=("time", 0.9))
    return t.select("venue", R6("median_odds").alias("median_odds"), F.round("time_p90", 4).alias("time_p90"))


@query("a5_iqr", f"SELECT race_id, horse, round(quantile_cont(corner1, 0.75) {last(5)} - quantile_cont(corner1, 0.25) {last(5)}, 6) AS corner_iqr FROM {RUNS}")
def a5(spark, d):
    """The quartile range of the last five runs of earlier days, of a sorted array of five."""
    df = H.last_before(entries(spark, d), ["horse"], five=(5, F.collect_list("corner1")))
    five = F.sort_array("five")
    return df.select("race_id", "horse", R6(H.quartile(five, 0.75) - H.quartile(five, 0.25)).alias("corner_iqr"))


@query("a6_safe_corr", "SELECT horse, round(CASE WHEN count(*) * sum(finish * finish) > sum(finish) * sum(finish) AND stddev_pop(body_weight) > 0 THEN corr(finish, body_weight) END, 4) AS c FROM e GROUP BY horse")
def a6(spark, d):
    return entries(spark, d).groupBy("horse").agg(F.round(M.safe_corr("finish", "body_weight"), 4).alias("c"))


@query("a7_slope", "SELECT horse, round(CASE WHEN count(*) >= 3 THEN regr_slope(finish, day) END, 8) AS slope FROM e GROUP BY horse")
def a7(spark, d):
    return entries(spark, d).groupBy("horse").agg(F.round(M.slope(F.col("finish"), F.col("day")), 8).alias("slope"))


@query("a8_volatility", "SELECT horse, round(stddev_pop(body_weight), 6) AS sd_pop, round(stddev_samp(body_weight), 6) AS sd_samp FROM e GROUP BY horse")
def a8(spark, d):
    return entries(spark, d).groupBy("horse").agg(R6(F.stddev_pop("body_weight")).alias("sd_pop"), R6(F.stddev_samp("body_weight")).alias("sd_samp"))


@query("a9_decay_mean", "SELECT horse, round(sum(finish * exp(-0.001 * (11600 - day))) / sum(exp(-0.001 * (11600 - day))), 6) AS finish_decayed, round(sum(finish * finish * exp(-0.001 * (11600 - day))) / sum(exp(-0.001 * (11600 - day))) - (sum(finish * exp(-0.001 * (11600 - day))) / sum(exp(-0.001 * (11600 - day)))) ** 2, 6) AS finish_variance FROM e GROUP BY horse")
def a9(spark, d):
    age = 11600 - F.col("day")
    return entries(spark, d).groupBy("horse").agg(R6(M.decay_mean(F.col("finish"), age)).alias("finish_decayed"), R6(M.decay_variance(F.col("finish"), age)).alias("finish_variance"))


@query("a10_context_mean", "SELECT horse, round(sum(w * time) / sum(w), 6) AS time_weighted FROM (SELECT horse, time, 1 / (1 + (11600 - day) / 180.0) * greatest(0.3, 1 - abs(distance - 1600) / greatest(1600 * 0.25, 200.0)) * CASE WHEN venue = 3 THEN 1.2 WHEN surface = 'F' THEN 1.0 ELSE 0.55 END AS w FROM e) GROUP BY horse")
def a10(spark, d):
    w = M.context_weight(11600 - F.col("day"), 180.0, F.col("distance"), F.lit(1600), 200.0, 0.25, 0.3, F.col("surface"), F.lit("F"), F.col("venue"), F.lit(3))
    return entries(spark, d).withColumn("w", w).groupBy("horse").agg(R6(F.sum(F.col("w") * F.col("time")) / F.sum("w")).alias("time_weighted"))


@query("a11_eb_rate", "SELECT jockey, venue, round((wins + 20 * 0.0707) / (n + 20), 8) AS rate FROM (SELECT jockey, venue, count(*) FILTER (WHERE finish = 1) AS wins, count(*) AS n FROM e GROUP BY ALL)")
def a11(spark, d):
    c = M.finish_counts(entries(spark, d), ["jockey", "venue"])
    return c.select("jockey", "venue", F.round(M.eb_rate(F.col("wins"), F.col("starts"), F.lit(0.0707), 20), 8).alias("rate"))


@query("a12_guard", "SELECT sire, distance, CASE WHEN count(*) >= 200 THEN round(avg((finish = 1)::INT), 6) END AS rate FROM e GROUP BY ALL")
def a12(spark, d):
    c = entries(spark, d).groupBy("sire", "distance").agg(F.count("*").alias("n"), M.rate(F.col("finish") == 1).alias("rate"))
    return c.select("sire", "distance", M.guard(R6("rate"), F.col("n"), 200).alias("rate"))


HITS = PRED + ", h AS (SELECT race_id, any_value(venue) AS venue, any_value(class) AS class, any_value(surface) AS surface, any_value(race_year) AS race_year, any_value(race_date) AS race_date, count(*) AS field, max(CASE WHEN r = 1 THEN (finish = 1)::INT END) AS top1, max(CASE WHEN r = 2 THEN (finish = 2)::INT END) AS rank2_exact, (count(*) FILTER (WHERE r <= 3 AND finish <= 3) = 3)::INT AS top3_box FROM p GROUP BY race_id)\n"


def hits(spark, d):
    p = predicted(spark, d)
    return M.race_hits(p, ["race_id", "venue", "class", "surface", "race_year", "race_date"])


NINE = ("category", "venue", "class", "surface", "distance_band", "field_band", "season", "race_year", "weekday")
SUMS = ("top1", "place2", "rank2_exact", "rank3_exact", "top3_box", "top3_exact", "capture3", "capture5")


@query("a13_bucket_eval", PRED + """, h AS (SELECT race_id, CASE WHEN venue = 8 THEN 'draught' WHEN venue < 10 THEN 'national' ELSE 'local' END AS category, venue, class, surface, least(distance // 400, 5)::INT AS distance_band, CASE WHEN field_size <= 2 THEN 'small' WHEN field_size <= 5 THEN 'middle' ELSE 'large' END AS field_band, ((month(race_date) % 12) // 3)::INT AS season, race_year::INT AS race_year, dayofweek(race_date)::INT AS weekday,
max(CASE WHEN r = 1 THEN (finish = 1)::INT END) AS top1, max(CASE WHEN r = 1 THEN (finish <= 2)::INT END) AS place2, max(CASE WHEN r = 2 THEN (finish = 2)::INT END) AS rank2_exact, max(CASE WHEN r = 3 THEN (finish = 3)::INT END) AS rank3_exact, (count(*) FILTER (WHERE r <= 3 AND finish <= 3) = 3)::INT AS top3_box, (count(*) FILTER (WHERE r <= 3 AND finish = r) = 3)::INT AS top3_exact, max(CASE WHEN finish = 1 THEN (r <= 3)::INT END) AS capture3, max(CASE WHEN finish = 1 THEN (r <= 5)::INT END) AS capture5 FROM p GROUP BY ALL)
SELECT """ + ", ".join(NINE) + ", count(*) AS races, " + ", ".join(f"sum({c})::BIGINT AS {c}" for c in SUMS) + " FROM h GROUP BY ALL")
def a13(spark, d):
    """Additive sums by nine dimensions, from which coarser buckets are added up."""
    date = F.col("race_date")
    e = predicted(spark, d).withColumns({
        "category": F.when(F.col("venue") == 8, "draught").when(F.col("venue") < 10, "national").otherwise("local"), "distance_band": F.least(F.floor(F.col("distance") / 400), F.lit(5)).cast("int"), "field_band": F.when(F.col("field_size") <= 2, "small").when(F.col("field_size") <= 5, "middle").otherwise("large"),
        "season": F.floor((F.month(date) % 12) / 3).cast("int"), "race_year": F.col("race_year").cast("int"), "weekday": F.dayofweek(date) - 1,
    })
    h = M.race_hits(e, ["race_id", *NINE]).withColumn("place2", F.col("top1_in2"))
    return h.groupBy(*NINE).agg(F.count("*").alias("races"), *(F.sum(c).alias(c) for c in SUMS))


@query("a14_race_hits", PRED + "SELECT race_id, max(CASE WHEN r = 1 THEN (finish = 1)::INT END) AS top1, max(CASE WHEN r = 2 THEN (finish = 2)::INT END) AS rank2_exact, max(CASE WHEN r = 3 THEN (finish = 3)::INT END) AS rank3_exact, (count(*) FILTER (WHERE r <= 3 AND finish <= 3) = 3)::INT AS top3_box, (count(*) FILTER (WHERE r <= 3 AND finish = r) = 3)::INT AS top3_exact, max(CASE WHEN finish = 1 THEN (r <= 3)::INT END) AS capture3, max(CASE WHEN finish = 1 THEN (r <= 5)::INT END) AS capture5 FROM p GROUP BY race_id")
def a14(spark, d):
    return M.race_hits(predicted(spark, d)).select("race_id", "top1", "rank2_exact", "rank3_exact", "top3_box", "top3_exact", "capture3", "capture5")


@query("a15_serve_hits", PRED + "SELECT venue, count(DISTINCT race_id) AS races, round(avg(CASE WHEN r = 4 THEN (finish = 4)::INT END), 6) AS rank4, round(avg(CASE WHEN r = 6 THEN (finish = 6)::INT END), 6) AS rank6, round(avg(CASE WHEN r = 1 THEN (finish <= 2)::INT END), 6) AS top1_in2 FROM p GROUP BY venue")
def a15(spark, d):
    h = M.race_hits(predicted(spark, d), ["venue", "race_id"])
    return h.groupBy("venue").agg(F.count("*").alias("races"), R6(F.avg("rank4_exact")).alias("rank4"), R6(F.avg("rank6_exact")).alias("rank6"), R6(F.avg("top1_in2")).alias("top1_in2"))


@query("a16_concordance", "SELECT a.race_id, round(avg(CASE WHEN (a.score_b > b.score_b) = (a.finish < b.finish) THEN 1.0 ELSE 0 END), 6) AS concordance FROM e a JOIN e b ON a.race_id = b.race_id AND a.horse < b.horse GROUP BY a.race_id")
def a16(spark, d):
    pairs = J.pairs_within(entries(spark, d), ["race_id"], "horse", ["score_b", "finish"])
    right = (F.col("a_score_b") > F.col("b_score_b")) == (F.col("a_finish") < F.col("b_finish"))
    return pairs.groupBy("race_id").agg(R6(F.avg(right.cast("int"))).alias("concordance"))


@query("a17_ndcg_fixed", PRED + "SELECT race_id, round(sum(CASE WHEN r <= 3 THEN greatest(0, 4 - finish) / ln(2 + r) ELSE 0 END) / (3 / ln(3) + 2 / ln(4) + 1 / ln(5)), 6) AS ndcg3 FROM p GROUP BY race_id")
def a17(spark, d):
    return predicted(spark, d).groupBy("race_id").agg(R6(M.ndcg3_fixed(F.col("predicted_rank"), F.col("finish"))).alias("ndcg3"))


@query("a18_ndcg_ideal", PRED + "SELECT race_id, round(sum(CASE WHEN r <= 3 THEN greatest(0, 4 - finish) / log2(r + 1) END) / sum(CASE WHEN finish <= 3 THEN (4 - finish) / log2(finish + 1) END), 6) AS ndcg3 FROM p GROUP BY race_id")
def a18(spark, d):
    return M.ndcg3_ideal(predicted(spark, d)).select("race_id", R6("ndcg3").alias("ndcg3"))


STYLE = ", s AS (SELECT venue, CASE WHEN corner1 = 1 THEN 0 WHEN 3 * corner1 <= field_size THEN 1 WHEN 3 * corner1 <= 2 * field_size THEN 2 ELSE 3 END AS actual, CASE WHEN popularity = 1 THEN 0 WHEN 3 * popularity <= field_size THEN 1 WHEN 3 * popularity <= 2 * field_size THEN 2 ELSE 3 END AS predicted FROM e)\n"


def styles(spark, d):
    one = lambda c: F.when(F.col(c) == 1, 0).when(3 * F.col(c) <= F.col("field_size"), 1).when(3 * F.col(c) <= 2 * F.col("field_size"), 2).otherwise(3)
    return entries(spark, d).select("venue", one("corner1").alias("actual"), one("popularity").alias("predicted"))


@query("a19_confusion", STYLE + "SELECT venue, actual, predicted, count(*) AS n, round(sum(-ln(0.55 - 0.15 * abs(actual - predicted))), 4) AS log_loss, count(*) FILTER (WHERE abs(actual - predicted) <= 1) AS near FROM s GROUP BY ALL")
def a19(spark, d):
    gap = F.abs(F.col("actual") - F.col("predicted"))
    chance = F.lit(0.55) - F.lit(0.15) * gap  # of the actual class by a forecast around the predicted one
    return M.confusion(styles(spark, d).withColumns({"chance": chance, "near": gap <= 1}), "actual", "predicted", ["venue"], chance="chance", near="near").withColumn("log_loss", F.round("log_loss", 4))


@query("a20_class_metrics", STYLE + ", c AS (SELECT k, count(*) FILTER (WHERE actual = k) AS a, count(*) FILTER (WHERE predicted = k) AS p, count(*) FILTER (WHERE actual = k AND predicted = k) AS x FROM s, range(4) t(k) GROUP BY k) SELECT k::INT AS class, round(x / p::DOUBLE, 6) AS precision, round(x / a::DOUBLE, 6) AS recall, round(2 * (x / p::DOUBLE) * (x / a::DOUBLE) / (x / p::DOUBLE + x / a::DOUBLE), 6) AS f1 FROM c")
def a20(spark, d):
    m = M.class_metrics(M.confusion(styles(spark, d), "actual", "predicted"), "actual", "predicted")
    return m.select("class", *(R6(c).alias(c) for c in ("precision", "recall", "f1")))


@query("a20_averages", STYLE + ", c AS (SELECT k, count(*) FILTER (WHERE actual = k) AS a, count(*) FILTER (WHERE predicted = k) AS p, count(*) FILTER (WHERE actual = k AND predicted = k) AS x FROM s, range(4) t(k) GROUP BY k), m AS (SELECT a, x / p::DOUBLE AS pr, x / a::DOUBLE AS re, 2 * (x / p::DOUBLE) * (x / a::DOUBLE) / (x / p::DOUBLE + x / a::DOUBLE) AS f FROM c) SELECT round(avg(pr), 6) AS macro_precision, round(avg(re), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(f * a) / sum(a), 6) AS weighted_f1 FROM m")
def a20a(spark, d):
    return M.class_averages(M.confusion(styles(spark, d), "actual", "predicted"), "actual", "predicted").select(*(R6(c).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "weighted_f1")))


@query("a20_kappa", STYLE + ", n AS (SELECT count(*)::DOUBLE AS t FROM s), a AS (SELECT actual AS k, count(*) AS n FROM s GROUP BY actual), p AS (SELECT predicted AS k, count(*) AS n FROM s GROUP BY predicted) SELECT round(1 - (SELECT sum((actual - predicted) ** 2) FROM s) / (SELECT sum(a.n * p.n * (a.k - p.k) ** 2) / any_value(t) FROM a, p, n), 6) AS kappa")
def a20k(spark, d):
    counts = M.confusion(styles(spark, d), "actual", "predicted")
    return counts.agg(R6(M.quadratic_kappa(counts, "actual", "predicted")).alias("kappa"))


@query("a21_wilson", "SELECT jockey, round((p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS lower, round((p + 3.8416 / (2 * n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) AS upper FROM (SELECT jockey, count(*)::DOUBLE AS n, count(*) FILTER (WHERE finish = 1) / count(*)::DOUBLE AS p FROM e GROUP BY jockey)")
def a21(spark, d):
    c = M.finish_counts(entries(spark, d), ["jockey"])
    lo, hi = M.wilson(F.col("wins"), F.col("starts"))
    return c.select("jockey", R6(lo).alias("lower"), R6(hi).alias("upper"))


@query("a22_weak_buckets", HITS + "SELECT *, row_number() OVER (ORDER BY gap, races DESC, dimension, bucket)::BIGINT AS place FROM (SELECT dimension, bucket, races, rate, round(rate - mean, 6) AS gap FROM (SELECT dimension, bucket, count(*) AS races, round(avg(top1), 6) AS rate, (SELECT avg(top1) FROM h) AS mean FROM (SELECT 'venue' AS dimension, venue::VARCHAR AS bucket, top1 FROM h UNION ALL SELECT 'class', class, top1 FROM h UNION ALL SELECT 'surface', surface, top1 FROM h) GROUP BY ALL) WHERE races >= 200 AND rate < mean)")
def a22(spark, d):
    h = hits(spark, d)
    by = M.unpivot_dims(h, ["venue", "class", "surface"], ["top1"]).groupBy("dimension", "bucket").agg(F.count("*").alias("races"), R6(F.avg("top1")).alias("rate"))
    return J.with_context(by, h.agg(F.avg("top1").alias("mean"))).where("races >= 200 and rate < mean").select("dimension", "bucket", "races", "rate", R6(F.col("rate") - F.col("mean")).alias("gap")).withColumn("place", F.row_number().over(W.orderBy("gap", F.desc("races"), "dimension", "bucket")).cast("long"))


@query("a23_bucket_delta", HITS + "SELECT coalesce(a.venue, b.venue) AS venue, round(b.t - a.t, 6) AS delta FROM (SELECT venue, avg(top1) AS t FROM h WHERE race_year < 1998 GROUP BY venue) a FULL JOIN (SELECT venue, avg(top1) AS t FROM h WHERE race_year >= 1998 GROUP BY venue) b ON a.venue = b.venue")
def a23(spark, d):
    h = hits(spark, d)
    one = lambda cond, n: h.where(cond).groupBy("venue").agg(F.avg("top1").alias(n))
    return J.outer_merge(one("race_year < 1998", "before"), one("race_year >= 1998", "after"), ["venue"]).select("venue", R6(F.col("after") - F.col("before")).alias("delta"))


@query("a24_drift", HITS + ", y AS (SELECT race_year, avg(top1) AS t, race_year <= 1999 AS trained FROM h GROUP BY race_year) SELECT race_year, round(t, 6) AS rate, round(t - lag(t) OVER (ORDER BY race_year), 6) AS change, trained, coalesce(trained AND t - avg(CASE WHEN NOT trained THEN t END) OVER () > 0.002, false) AS leak FROM y")
def a24(spark, d):
    t = M.drift(hits(spark, d), "top1", 1999, most=0.002)
    return t.select("race_year", R6("rate").alias("rate"), R6("change").alias("change"), "trained", "leak")


@query("a25_bootstrap")
def a25(spark, d):
    h = hits(spark, d).select("race_id", (F.col("top1") - F.col("rank2_exact")).alias("delta"))
    return M.bootstrap_bound(h, "delta", "race_id")


GATE = ", m AS (SELECT race_id, any_value(venue) AS venue, max(CASE WHEN ra = 1 THEN (finish = 1)::INT END) AS a1, max(CASE WHEN rb = 1 THEN (finish = 1)::INT END) AS b1, max(CASE WHEN ra = 2 THEN (finish = 2)::INT END) AS a2, max(CASE WHEN rb = 2 THEN (finish = 2)::INT END) AS b2 FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY score_b DESC, horse) AS ra, row_number() OVER (PARTITION BY race_id ORDER BY score_c DESC, horse) AS rb FROM e) GROUP BY race_id)\n"


def two_models(spark, d):
    p = R.ordinal(R.ordinal(entries(spark, d), "score_b", "ra"), "score_c", "rb")
    at = lambda r, k: F.max(F.when(F.col(r) == k, (F.col("finish") == k).cast("int")))
    return p.groupBy("race_id", "venue").agg(at("ra", 1).alias("a1"), at("rb", 1).alias("b1"), at("ra", 2).alias("a2"), at("rb", 2).alias("b2"))


@query("a26_adoption_gate", GATE + "SELECT venue, count(*) AS races, avg(b1) - avg(a1) >= 0.0008 AND avg(b2) - avg(a2) >= -0.0005 AND count(*) >= 200 AS adopt, array_to_string(list_filter([CASE WHEN avg(b1) - avg(a1) < 0.0008 THEN 'top1' END, CASE WHEN avg(b2) - avg(a2) < -0.0005 THEN 'rank2' END, CASE WHEN count(*) < 200 THEN 'support' END], lambda x: x IS NOT NULL), ',') AS reasons FROM m GROUP BY venue")
def a26(spark, d):
    t = two_models(spark, d).groupBy("venue").agg(F.count("*").alias("races"), (F.avg("b1") - F.avg("a1")).alias("gain"), (F.avg("b2") - F.avg("a2")).alias("second"))
    why = F.array_compact(F.array(F.when(F.col("gain") < 0.0008, F.lit("top1")), F.when(F.col("second") < -0.0005, F.lit("rank2")), F.when(F.col("races") < 200, F.lit("support"))))
    return t.select("venue", "races", (F.size(why) == 0).alias("adopt"), F.array_join(why, ",").alias("reasons"))


@query("a27_frame_stats", ", f AS (SELECT least(horse_no, 8) AS frame, count(*) AS starts, 1 / avg(finish) + 1 / median(finish) AS raw FROM e GROUP BY 1) SELECT frame, starts, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 6) AS score FROM f")
def a27(spark, d):
    f = entries(spark, d).groupBy(F.least(F.col("horse_no"), F.lit(8)).alias("frame")).agg(F.count("*").alias("starts"), (1 / F.avg("finish") + 1 / F.percentile("finish", F.lit(0.5))).alias("raw"))
    ends = f.agg(F.min("raw").alias("lo"), F.max("raw").alias("hi"))
    return J.with_context(f, ends).select("frame", "starts", R6((F.col("raw") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("score"))


@query("a28_weight_class", "SELECT CASE WHEN body_weight < 410 THEN 'light' WHEN body_weight < 430 THEN 'middle' ELSE 'heavy' END AS weight_class, count(*) AS starts, count(*) FILTER (WHERE finish = 1) AS wins, count(*) FILTER (WHERE finish <= 2) AS places, count(*) FILTER (WHERE finish <= 3) AS shows FROM e GROUP BY 1")
def a28(spark, d):
    from ..functions.scalars import weight_class

    return M.finish_counts(entries(spark, d).withColumn("weight_class", weight_class("body_weight", {"light": 410, "middle": 430}, "heavy")), ["weight_class"])


@query("a29_finish_stats", "SELECT finish, round(avg(popularity), 6) AS popularity_avg, median(popularity) AS popularity_median, round(avg(odds), 6) AS odds_avg, round(median(odds), 6) AS odds_median FROM e WHERE finish <= 5 GROUP BY finish")
def a29(spark, d):
    return entries(spark, d).where("finish <= 5").groupBy("finish").agg(R6(F.avg("popularity")).alias("popularity_avg"), F.percentile("popularity", F.lit(0.5)).alias("popularity_median"), R6(F.avg("odds")).alias("odds_avg"), R6(F.percentile("odds", F.lit(0.5))).alias("odds_median"))


@query("a30_time_stats", "SELECT distance, count(*) AS winners, min(time) AS best, round(avg(time), 5) AS mean, round(median(time), 3) AS middle FROM e WHERE finish = 1 GROUP BY distance")
def a30(spark, d):
    won = cut(entries(spark, d).where("finish = 1").select("distance", "time"), "winners")
    t = won.groupBy("distance").agg(F.count("*").alias("winners"), F.min("time").alias("best"), F.round(F.avg("time"), 5).alias("mean"))
    return t.join(M.percentiles(won, ["distance"], middle=("time", 0.5)).withColumn("middle", F.round("middle", 3)), "distance")


@query("a31_bloodline", "SELECT role, name, count(*) AS starts, count(*) FILTER (WHERE finish = 1) AS wins, count(*) FILTER (WHERE finish <= 2) AS places, count(*) FILTER (WHERE finish <= 3) AS shows FROM (SELECT e.*, m AS dam, o AS sire_sire, b AS sire_dam, x AS damsire_sire, c AS damsire_dam FROM e JOIN (SELECT p_partkey AS horse, p_size::VARCHAR AS m, left(p_brand, 7) AS o, right(p_brand, 1) AS b, left(p_type, 3) AS x, right(p_type, 3) AS c FROM part) USING (horse)) UNPIVOT (name FOR role IN (sire, dam, damsire, sire_sire, sire_dam, damsire_sire, damsire_dam)) GROUP BY ALL")
def a31(spark, d):
    """Seven ancestor roles; those that the runner table lacks come from the horse's own row."""
    p = table(spark, d, "part").selectExpr("p_partkey horse", "cast(p_size as string) dam", "left(p_brand, 7) sire_sire", "right(p_brand, 1) sire_dam", "left(p_type, 3) damsire_sire", "right(p_type, 3) damsire_dam")
    slots = J.unpivot(entries(spark, d).join(p, "horse"), ["finish"], ["sire", "dam", "damsire", "sire_sire", "sire_dam", "damsire_sire", "damsire_dam"], "role", "name")
    return M.finish_counts(slots, ["role", "name"])


@query("a32_people", "SELECT role, id, count(*) AS starts, count(*) FILTER (WHERE finish = 1) AS wins, count(*) FILTER (WHERE finish <= 2) AS places, count(*) FILTER (WHERE finish <= 3) AS shows FROM (SELECT 'jockey' AS role, jockey::VARCHAR AS id, finish FROM e UNION ALL SELECT 'trainer', trainer::VARCHAR, finish FROM e UNION ALL SELECT 'jockey_frame', jockey || ':' || least(horse_no, 8), finish FROM e UNION ALL SELECT 'owner', owner::VARCHAR, finish FROM e) GROUP BY ALL")
def a32(spark, d):
    e = entries(spark, d).withColumn("jockey_frame", F.concat_ws(":", "jockey", F.least(F.col("horse_no"), F.lit(8))))
    rows = M.unpivot_dims(e, ["jockey", "trainer", "owner", "jockey_frame"], ["finish"]).withColumnsRenamed({"dimension": "role", "bucket": "id"})
    return M.finish_counts(rows, ["role", "id"])


TREND = (("jockey",), ("jockey", "venue"), ("trainer", "surface"), ("distance", "frame"), ("jockey", "venue", "surface", "distance", "frame"))
TREND_DIMS = ("jockey", "venue", "trainer", "surface", "distance", "frame")


@query("a33_trend", ", t AS (SELECT *, CASE WHEN race_id % 7 = 0 THEN 0 ELSE finish END AS f, least(horse_no, 8) AS frame FROM e), o AS (SELECT f, popularity, day, race_id, option, " + ", ".join(f"CASE WHEN option IN ({', '.join(str(i) for i, o in enumerate(TREND) if c in o)}) THEN {c} END AS {c}" for c in TREND_DIMS) + " FROM t, (SELECT unnest(range(5))::INT AS option)) SELECT option, " + ", ".join(TREND_DIMS) + ", count(*) AS starts, count(*) FILTER (WHERE f > 0) AS ranked, round(avg((f = 1)::INT) FILTER (WHERE f > 0), 6) AS win_rate, median(popularity) FILTER (WHERE f BETWEEN 1 AND 3) AS market_median, arg_max(race_id, (day, race_id)) AS newest FROM o GROUP BY ALL")
def a33(spark, d):
    t = entries(spark, d).withColumns({"f": F.when(F.col("race_id") % 7 == 0, 0).otherwise(F.col("finish")), "frame": F.least(F.col("horse_no"), F.lit(8))})
    return M.trend(t, TREND, "f", "popularity").withColumn("win_rate", R6("win_rate"))


@query("a33_trend_details", ", t AS (SELECT *, CASE WHEN race_id % 7 = 0 THEN 0 ELSE finish END AS f, least(horse_no, 8) AS frame FROM e), o AS (SELECT race_id, horse, f, popularity, day, option, " + ", ".join(f"CASE WHEN option IN ({', '.join(str(i) for i, o in enumerate(TREND) if c in o)}) THEN {c} END AS {c}" for c in TREND_DIMS) + " FROM t, (SELECT unnest(range(5))::INT AS option)) SELECT option, " + ", ".join(TREND_DIMS) + ", row_number() OVER (PARTITION BY option, " + ", ".join(TREND_DIMS) + " ORDER BY day DESC, race_id DESC, race_id, horse, f, popularity) AS place, race_id, horse, f, popularity FROM o")
def a33d(spark, d):
    t = entries(spark, d).withColumns({"f": F.when(F.col("race_id") % 7 == 0, 0).otherwise(F.col("finish")), "frame": F.least(F.col("horse_no"), F.lit(8))})
    return M.trend_details(t, TREND, ["race_id", "horse", "f", "popularity"])


@query("a34_trend_buckets", "SELECT 'jockey' AS bucket, jockey AS id, count(*) AS starts, count(*) FILTER (WHERE finish <= 3) AS shows FROM e WHERE race_id % 7 > 0 GROUP BY jockey UNION ALL SELECT 'frame', least(horse_no, 8), count(*), count(*) FILTER (WHERE finish <= 3) FROM e WHERE race_id % 7 > 0 GROUP BY least(horse_no, 8)")
def a34(spark, d):
    e = entries(spark, d).where("race_id % 7 > 0").withColumn("frame", F.least(F.col("horse_no"), F.lit(8)))
    arm = lambda c: e.groupBy(F.col(c).alias("id")).agg(F.count("*").alias("starts"), F.count_if(F.col("finish") <= 3).alias("shows")).select(F.lit(c).alias("bucket"), "id", "starts", "shows")
    return J.union_all([arm("jockey"), arm("frame")])


RUN_SCORE = "SELECT race_id, horse, jockey, sire, CASE WHEN finish > 5 THEN least(popularity - finish, 0) ELSE popularity - finish END + CASE WHEN finish <= 3 THEN (4 - finish) * w WHEN finish <= 5 THEN greatest(0, popularity - finish) * w * 0.5 ELSE 0 END AS s FROM (SELECT *, log10(greatest(odds, 1.1)) + 1 AS w FROM e)"
TREND_SCORES = f", r AS ({RUN_SCORE}), c AS (SELECT 'jockey' AS condition, jockey::VARCHAR AS id, sum(s) * ln(1 + count(*)) AS score FROM r GROUP BY jockey UNION ALL SELECT 'sire', sire, sum(s) * ln(1 + count(*)) FROM r GROUP BY sire)"


def run_scores(spark, d):
    gap, f = F.col("popularity") - F.col("finish"), F.col("finish")
    w = F.log10(F.greatest(F.col("odds"), F.lit(1.1))) + 1
    s = F.when(f > 5, F.least(gap, F.lit(0))).otherwise(gap) + F.when(f <= 3, (4 - f) * w).when(f <= 5, F.greatest(F.lit(0), gap) * w * 0.5).otherwise(0)
    return entries(spark, d).withColumn("s", s)


@query("a35_trend_score", TREND_SCORES + " SELECT condition, id, round(score, 5) AS score FROM c")
def a35(spark, d):
    return M.trend_score(run_scores(spark, d), ["jockey", "sire"], "s").withColumn("score", F.round("score", 5))


@query("a35_trend_in_race", TREND_SCORES + ", t AS (SELECT race_id, horse, j.score + k.score AS total FROM r JOIN c j ON j.condition = 'jockey' AND j.id = jockey::VARCHAR JOIN c k ON k.condition = 'sire' AND k.id = sire) SELECT race_id, horse, round(CASE WHEN max(total) OVER w > min(total) OVER w THEN (total - min(total) OVER w) / (max(total) OVER w - min(total) OVER w) ELSE 0.5 END, 6) AS score FROM t WINDOW w AS (PARTITION BY race_id)")
def a35r(spark, d):
    """The scores of a runner's conditions added up, and put between 0 and 1 in its race."""
    df = run_scores(spark, d)
    scores = M.trend_score(df, ["jockey", "sire"], "s")
    for c in ("jockey", "sire"):
        df = df.withColumn("_id", F.col(c).cast("string")).join(scores.where(F.col("condition") == c).select(F.col("id").alias("_id"), F.col("score").alias(f"_{c}")), "_id", "left").drop("_id")
    return R.minmax(df.withColumn("total", F.col("_jockey") + F.col("_sire")), "total", "score").select("race_id", "horse", R6("score").alias("score"))


@query("a36_dominant_share", "SELECT race_id, horse, round(greatest(" + ", ".join(f"count(*) FILTER (WHERE surface = '{x}') {last(5)}" for x in "FOP") + f") / nullif(count(*) {last(5)}, 0)::DOUBLE, 6) AS share FROM {RUNS}")
def a36(spark, d):
    """Of the last five runs of earlier days, the share of the commonest kind."""
    df = H.last_before(entries(spark, d), ["horse"], n=(5, F.count("*")), **{x: (5, F.count_if(F.col("surface") == x)) for x in "FOP"})
    return df.select("race_id", "horse", R6(F.try_divide(F.greatest(*"FOP"), F.nullif("n", F.lit(0)))).alias("share"))


@query("a37_rank_corr", "SELECT round(corr(ra, rb), 6) AS spearman FROM (SELECT rank() OVER (PARTITION BY race_id ORDER BY score_a DESC, horse) AS ra, rank() OVER (PARTITION BY race_id ORDER BY score_c DESC, horse) AS rb FROM e)")
def a37(spark, d):
    p = R.ordinal(R.ordinal(entries(spark, d), "score_a", "ra"), "score_c", "rb")
    return p.agg(R6(M.safe_corr("ra", "rb")).alias("spearman"))


@query("a38_corner_eval", "SELECT race_id, round(avg(abs(corner1 - finish)), 6) AS mae, count(*) FILTER (WHERE corner1 <= 3 AND finish <= 3) AS agree3 FROM e GROUP BY race_id")
def a38(spark, d):
    return entries(spark, d).groupBy("race_id").agg(R6(F.avg(F.abs(F.col("corner1") - F.col("finish")))).alias("mae"), F.count_if((F.col("corner1") <= 3) & (F.col("finish") <= 3)).alias("agree3"))


@query("a39_set_hits", PRED + "SELECT race_id, (count(*) FILTER (WHERE r <= 3 AND finish <= 3) >= 2)::INT AS two_of_three, (count(*) FILTER (WHERE r <= 2 AND finish <= 2) = 2)::INT AS top2_set FROM p GROUP BY race_id")
def a39(spark, d):
    both = lambda k: F.count_if((F.col("predicted_rank") <= k) & (F.col("finish") <= k))
    return predicted(spark, d).groupBy("race_id").agg((both(3) >= 2).cast("int").alias("two_of_three"), (both(2) == 2).cast("int").alias("top2_set"))


@query("a40_count_distinct", "SELECT jockey, count(DISTINCT (race_id, venue)) AS races, count(DISTINCT horse) AS horses FROM e GROUP BY jockey")
def a40(spark, d):
    return entries(spark, d).groupBy("jockey").agg(F.count_distinct(F.struct("race_id", "venue")).alias("races"), F.count_distinct("horse").alias("horses"))


@query("a42_daily", HITS + "SELECT race_date, count(*) AS races, round(avg(top1), 6) AS top1, round(avg(top3_box), 6) AS top3_box FROM h GROUP BY race_date")
def a42(spark, d):
    return hits(spark, d).groupBy("race_date").agg(F.count("*").alias("races"), R6(F.avg("top1")).alias("top1"), R6(F.avg("top3_box")).alias("top3_box"))


@query("a43_best_worst", HITS + ", c AS (SELECT venue, count(*) AS n, avg(top1) AS t FROM h GROUP BY venue HAVING count(*) >= 100) SELECT arg_max(venue, (t, -venue)) AS best, arg_min(venue, (t, venue)) AS worst FROM c")
def a43(spark, d):
    c = hits(spark, d).groupBy("venue").agg(F.count("*").alias("n"), F.avg("top1").alias("t")).where("n >= 100")
    return c.agg(F.max_by("venue", F.struct("t", -F.col("venue"))).alias("best"), F.min_by("venue", F.struct("t", "venue")).alias("worst"))


@query("a44_fold_stats", HITS + "SELECT round(avg(t), 6) AS mean, round(stddev_samp(t), 6) AS sd, round(min(t), 6) AS worst, round(max(t), 6) AS best FROM (SELECT avg(top1) AS t FROM h GROUP BY race_year)")
def a44(spark, d):
    f = hits(spark, d).groupBy("race_year").agg(F.avg("top1").alias("t"))
    return f.agg(R6(F.avg("t")).alias("mean"), R6(F.stddev_samp("t")).alias("sd"), R6(F.min("t")).alias("worst"), R6(F.max("t")).alias("best"))


@query("a45_payout", PRED + "SELECT venue, count(*) AS bets, sum((finish = 1)::INT)::BIGINT AS won, round(sum(CASE WHEN finish = 1 THEN odds * 100 ELSE 0 END) / (count(*) * 100), 6) AS return_rate FROM p WHERE r = 1 GROUP BY venue")
def a45(spark, d):
    bets, won = predicted(spark, d).where("predicted_rank = 1"), F.col("finish") == 1
    return bets.groupBy("venue").agg(F.count("*").alias("bets"), F.count_if(won).alias("won"), R6(F.sum(F.when(won, F.col("odds") * 100).otherwise(0)) / (F.count("*") * 100)).alias("return_rate"))


@query("a45_combinations", PRED + ", plan AS (SELECT a.race_id, list(lpad(a.horse_no::VARCHAR, 2, '0') || lpad(b.horse_no::VARCHAR, 2, '0')) AS picks FROM p a JOIN p b ON a.race_id = b.race_id AND a.horse_no < b.horse_no WHERE a.r <= 3 AND b.r <= 3 GROUP BY a.race_id), res AS (SELECT race_id, any_value(venue) AS venue, lpad(least(max(horse_no) FILTER (WHERE finish = 1), max(horse_no) FILTER (WHERE finish = 2))::VARCHAR, 2, '0') || lpad(greatest(max(horse_no) FILTER (WHERE finish = 1), max(horse_no) FILTER (WHERE finish = 2))::VARCHAR, 2, '0') AS combo, round(max(odds) FILTER (WHERE finish = 1) * max(odds) FILTER (WHERE finish = 2) * 100)::BIGINT AS yen FROM e GROUP BY race_id HAVING count(*) > 1), j AS (SELECT venue, len(picks) AS n, list_contains(picks, combo) AS won, yen FROM res JOIN plan USING (race_id)) SELECT venue, count(*) AS races, sum(n)::BIGINT AS bets, count(*) FILTER (WHERE won) AS covered, sum(CASE WHEN won THEN yen ELSE 0 END)::BIGINT AS paid, round(count(*) FILTER (WHERE won) / count(*)::DOUBLE, 6) AS coverage, round(sum(CASE WHEN won THEN yen ELSE 0 END) / (sum(n) * 100)::DOUBLE, 6) AS return_rate FROM j GROUP BY venue")
def a45c(spark, d):
    """All pairs of the three predicted first as a plan, against packed results: the winning pair and its payout in fixed widths."""
    p = predicted(spark, d)
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    picks = J.pairs_within(p.where("predicted_rank <= 3"), ["race_id"], "horse_no", []).groupBy("race_id").agg(F.collect_list(F.concat(two(F.col("a_horse_no")), two(F.col("b_horse_no")))).alias("picks"))
    at = lambda c, k: F.max(F.when(F.col("finish") == k, F.col(c)))
    first, second = at("horse_no", 1), at("horse_no", 2)
    packed = F.concat(two(F.least(first, second)), two(F.greatest(first, second)), F.lpad(F.round(at("odds", 1) * at("odds", 2) * 100).cast("long").cast("string"), 8, "0"))
    results = p.groupBy("race_id", "venue").agg(packed.alias("packed"), F.count("*").alias("n")).where("n > 1").drop("n")
    return M.payout_eval(picks, results, ["venue"]).withColumns({"coverage": R6("coverage"), "return_rate": R6("return_rate")})


@query("a46_person_summary", "SELECT CASE WHEN venue < 10 THEN 'national' ELSE 'local' END AS source, jockey, count(*) AS starts, count(*) FILTER (WHERE finish = 1) AS wins, round(avg((finish = 1)::INT), 6) AS win_rate, round(avg((finish <= 3)::INT), 6) AS show_rate, min(finish) AS best_finish, round(avg(odds) + 1e-10, 6) AS odds_mean, max(day) AS last_day FROM e WHERE race_date < DATE '2000-01-01' GROUP BY ALL")
def a46p(spark, d):
    past = entries(spark, d).where("race_date < '2000-01-01'").withColumn("source", F.when(F.col("venue") < 10, "national").otherwise("local"))
    return M.form_summary(past, ["source", "jockey"]).withColumns({"win_rate": R6("win_rate"), "show_rate": R6("show_rate"), "odds_mean": R6(F.col("odds_mean") + 1e-10)})


@query("a46_form_summary", "SELECT horse, count(*) AS starts, round(avg((finish = 1)::INT), 6) AS win_rate, max(day) AS last_day FROM e WHERE race_date < DATE '2000-01-01' GROUP BY horse")
def a46(spark, d):
    return entries(spark, d).where("race_date < '2000-01-01'").groupBy("horse").agg(F.count("*").alias("starts"), R6(M.rate(F.col("finish") == 1)).alias("win_rate"), F.max("day").alias("last_day"))


@query("a47_changed_groups", GATE + "SELECT venue, count(*) FILTER (WHERE a1 <> b1) AS changed, count(*) FILTER (WHERE b1 > a1) AS gained, count(*) FILTER (WHERE b1 < a1) AS lost FROM m GROUP BY venue")
def a47(spark, d):
    return two_models(spark, d).groupBy("venue").agg(F.count_if(F.col("a1") != F.col("b1")).alias("changed"), F.count_if(F.col("b1") > F.col("a1")).alias("gained"), F.count_if(F.col("b1") < F.col("a1")).alias("lost"))


@query("a48_breakdowns", HITS + "SELECT 'venue' AS dimension, venue::VARCHAR AS bucket, count(*) AS races, round(avg(top1), 6) AS top1 FROM h GROUP BY venue UNION ALL SELECT 'class', class, count(*), round(avg(top1), 6) FROM h GROUP BY class UNION ALL SELECT 'race_year', race_year::VARCHAR, count(*), round(avg(top1), 6) FROM h GROUP BY race_year")
def a48(spark, d):
    rows = M.unpivot_dims(hits(spark, d), ["venue", "class", "race_year"], ["top1"])
    return rows.groupBy("dimension", "bucket").agg(F.count("*").alias("races"), R6(F.avg("top1")).alias("top1"))


@query("a49_calendar", "SELECT y::INT AS race_year, coalesce(days, 0) AS days, coalesce(races, 0) AS races FROM range(1994, 2004) t(y) LEFT JOIN (SELECT race_year, count(DISTINCT race_date) AS days, count(DISTINCT race_id) AS races FROM e GROUP BY race_year) ON y = race_year")
def a49(spark, d):
    years = spark.range(1994, 2004).select(F.col("id").cast("int").alias("race_year"))
    by = entries(spark, d).groupBy("race_year").agg(F.count_distinct("race_date").alias("days"), F.count_distinct("race_id").alias("races"))
    return years.join(by, "race_year", "left").fillna(0)


@query("a50_bucket_tiers", HITS + ", x AS (SELECT venue, class, surface, count(*) AS races, sum(top1) AS hits FROM h GROUP BY ALL), t0 AS (SELECT venue, class, sum(races) AS n, sum(hits) AS k FROM x GROUP BY ALL), t1 AS (SELECT venue, sum(races) AS n, sum(hits) AS k FROM x GROUP BY venue), t2 AS (SELECT sum(races) AS n, sum(hits) AS k FROM x) SELECT venue, class, CASE WHEN t0.n >= 120 THEN 0 WHEN t1.n >= 120 THEN 1 ELSE 2 END AS tier, CASE WHEN t0.n >= 120 THEN t0.n WHEN t1.n >= 120 THEN t1.n ELSE t2.n END::BIGINT AS races, CASE WHEN t0.n >= 120 THEN t0.k WHEN t1.n >= 120 THEN t1.k ELSE t2.k END::BIGINT AS hits FROM t0 JOIN t1 USING (venue), t2")
def a50(spark, d):
    x = hits(spark, d).groupBy("venue", "class", "surface").agg(F.count("*").alias("races"), F.sum("top1").alias("hits"))
    return M.bucket_tiers(x, [["venue", "class"], ["venue"], []], ["races", "hits"], x.select("venue", "class").distinct(), 120, "races")
