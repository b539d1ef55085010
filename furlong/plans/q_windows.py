"""Queries of the window and history operators (W, J3-J6, J17, A1-A12)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators import relative as R
from .registry import query
from .views import entries

R6 = lambda c: F.round(c, 6)
KEY = ("race_id", "horse")


@query("w1_recent_rank", "SELECT race_id, horse, row_number() OVER (PARTITION BY horse ORDER BY day DESC, race_id DESC)::BIGINT AS recent_rank FROM e")
def w1(spark, d):
    return H.recent_rank(entries(spark, d), ["horse"]).select(*KEY, "recent_rank")


@query("w2_rank_in_race", "SELECT race_id, horse, rank() OVER (PARTITION BY race_id ORDER BY odds)::BIGINT AS odds_rank, rank() OVER (PARTITION BY race_id ORDER BY body_weight DESC)::BIGINT AS body_weight_rank FROM e")
def w2(spark, d):
    return R.rank_in_race(entries(spark, d), {"odds": False, "body_weight": True}).select(*KEY, "odds_rank", "body_weight_rank")


@query("w3_avg_rank", "SELECT race_id, horse, rank() OVER (PARTITION BY race_id ORDER BY carried) + (count(*) OVER (PARTITION BY race_id, carried) - 1) / 2.0::DOUBLE AS carried_rank FROM e")
def w3(spark, d):
    return R.avg_rank(entries(spark, d), "carried", "carried_rank").select(*KEY, "carried_rank")


@query("w4_expanding", "SELECT race_id, horse, round(avg((finish = 1)::INT) OVER w, 6) AS jockey_win_rate, count(*) OVER w AS jockey_starts FROM e WINDOW w AS (PARTITION BY jockey ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w4(spark, d):
    """The minimum slice: a jockey's win rate over strictly earlier days."""
    df = H.expanding(entries(spark, d), ["jockey"], jockey_win_rate=F.avg((F.col("finish") == 1).cast("int")), jockey_starts=F.count("*"))
    return df.select(*KEY, R6("jockey_win_rate").alias("jockey_win_rate"), "jockey_starts")


@query("w5_last_n", "SELECT race_id, horse, round(avg(finish) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS finish_avg5, min(time) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS time_best5, lag(finish) OVER w AS finish_last FROM e WINDOW w AS (PARTITION BY horse ORDER BY day, race_id)")
def w5(spark, d):
    df = H.last_n(entries(spark, d), ["horse"], 5, finish_avg5=F.avg("finish"), time_best5=F.min("time"))
    return H.last_n(df, ["horse"], 1, finish_last=F.max("finish")).select(*KEY, R6("finish_avg5").alias("finish_avg5"), "time_best5", "finish_last")


@query("w6_last_days", "SELECT race_id, horse, count(*) OVER w AS starts_30d, round(avg(finish) OVER w, 6) AS finish_30d FROM e WINDOW w AS (PARTITION BY jockey ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING)")
def w6(spark, d):
    return H.within_days(entries(spark, d), ["jockey"], 30, starts_30d=F.count("*"), finish_30d=F.avg("finish")).select(*KEY, "starts_30d", R6("finish_30d").alias("finish_30d"))


@query("w7_relative", "SELECT race_id, horse, round(body_weight - avg(body_weight) OVER w, 6) AS body_weight_diff, round(CASE WHEN stddev_samp(body_weight) OVER w > 0 THEN (body_weight - avg(body_weight) OVER w) / stddev_samp(body_weight) OVER w END, 5) AS body_weight_z FROM e WINDOW w AS (PARTITION BY race_id)")
def w7(spark, d):
    return R.relative(entries(spark, d), ["body_weight"]).select(*KEY, R6("body_weight_diff").alias("body_weight_diff"), F.round("body_weight_z", 5).alias("body_weight_z"))


@query("w8_share", "SELECT race_id, horse, round((1 / odds) / sum(1 / odds) OVER (PARTITION BY race_id), 6) AS implied FROM e")
def w8(spark, d):
    return R.share(entries(spark, d).withColumn("inverse", 1 / F.col("odds")), "inverse", "implied").select(*KEY, R6("implied").alias("implied"))


@query("w9_others", """SELECT a.race_id, a.horse, round(sum(b.body_weight), 6) AS body_weight_others_sum, round(avg(b.body_weight), 6) AS body_weight_others_mean, round(min(b.body_weight), 6) AS body_weight_others_min, round(max(b.body_weight), 6) AS body_weight_others_max
FROM e a LEFT JOIN e b ON a.race_id = b.race_id AND a.horse <> b.horse GROUP BY a.race_id, a.horse""")
def w9(spark, d):
    df = R.others(entries(spark, d), "body_weight")
    return df.select(*KEY, *(R6(c).alias(c) for c in df.columns if c.startswith("body_weight_others")))


@query("w10_rank_norm", "SELECT race_id, horse, round(CASE WHEN count(*) OVER w > 1 THEN (count(*) OVER w - row_number() OVER (w ORDER BY score_a DESC, horse)) / (count(*) OVER w - 1)::DOUBLE ELSE 0.5 END, 6) AS norm FROM e WINDOW w AS (PARTITION BY race_id)")
def w10(spark, d):
    return R.rank_norm(entries(spark, d), "score_a", "norm").select(*KEY, R6("norm").alias("norm"))


@query("w11_ordinal", "SELECT race_id, horse, row_number() OVER (PARTITION BY race_id ORDER BY score_b DESC, horse)::BIGINT AS predicted_rank FROM e")
def w11(spark, d):
    return R.ordinal(entries(spark, d), "score_b").select(*KEY, "predicted_rank")


@query("w12_streak", "SELECT race_id, horse, (rn - 1 - coalesce(max(CASE WHEN finish > 3 THEN rn END) OVER (PARTITION BY horse ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS streak FROM (SELECT *, row_number() OVER (PARTITION BY horse ORDER BY day, race_id) AS rn FROM e)")
def w12(spark, d):
    return R.streak(entries(spark, d), F.col("finish") <= 3, ["horse"]).select(*KEY, "streak")


@query("w12_streak_capped", "SELECT race_id, horse, least(5, rn - 1 - coalesce(max(CASE WHEN finish > 3 THEN rn END) OVER (PARTITION BY horse ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS streak FROM (SELECT *, row_number() OVER (PARTITION BY horse ORDER BY day, race_id) AS rn FROM e)")
def w12c(spark, d):
    return R.streak_capped(entries(spark, d), F.col("finish") <= 3, ["horse"]).select(*KEY, "streak")


@query("w13_field_strength", "SELECT race_id, horse, avg(c) OVER w AS field_mean, avg(CASE WHEN r <= 3 THEN c END) OVER w AS top_mean, count(c) OVER w AS field_count FROM (SELECT *, round(score_a * 100000)::BIGINT AS c FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY score_a DESC, horse) AS r FROM e)) WINDOW w AS (PARTITION BY race_id)")
def w13(spark, d):
    """Means of the field and of its best three, of whole units (sums of which are exact), as they are."""
    df = R.field_strength(entries(spark, d).withColumn("c", F.round(F.col("score_a") * 100000).cast("long")), "c")
    return df.select(*KEY, "field_mean", "top_mean", F.count("c").over(W.partitionBy("race_id")).alias("field_count"))


@query("w14_minmax", "SELECT race_id, horse, round(CASE WHEN max(odds) OVER w > min(odds) OVER w THEN (odds - min(odds) OVER w) / (max(odds) OVER w - min(odds) OVER w) ELSE 0.5 END, 6) AS odds_scaled FROM e WINDOW w AS (PARTITION BY race_id)")
def w14(spark, d):
    return R.minmax(entries(spark, d), "odds", "odds_scaled").select(*KEY, R6("odds_scaled").alias("odds_scaled"))


@query("w15_favourite_gap", "SELECT DISTINCT race_id, round(max(CASE WHEN popularity = 1 THEN odds END) OVER w / max(CASE WHEN popularity = 2 THEN odds END) OVER w, 6) AS favourite_gap FROM e WINDOW w AS (PARTITION BY race_id)")
def w15(spark, d):
    return R.favourite_gap(entries(spark, d)).select("race_id", R6("favourite_gap").alias("favourite_gap")).distinct()


@query("w16_softmax", "SELECT race_id, horse, round(x / sum(x) OVER (PARTITION BY race_id), 6) AS p FROM (SELECT race_id, horse, greatest(exp((score_b / 50 - max(score_b / 50) OVER (PARTITION BY race_id)) / 0.65), 0.001) AS x FROM e)")
def w16(spark, d):
    return R.softmax(entries(spark, d), F.col("score_b") / 50, "p").select(*KEY, R6("p").alias("p"))


@query("w17_same_day_prior", "SELECT DISTINCT race_id, jockey, day, coalesce(sum(s) OVER w, 0)::BIGINT AS starts, coalesce(sum(w1) OVER w, 0)::BIGINT AS wins FROM (SELECT jockey, day, race_id, count(*) AS s, count(*) FILTER (WHERE finish = 1) AS w1 FROM e GROUP BY ALL) WINDOW w AS (PARTITION BY jockey ORDER BY day, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def w17(spark, d):
    df = H.race_order(entries(spark, d), ["jockey"], ["day", "race_id"], starts=F.count("*"), wins=F.count_if(F.col("finish") == 1))
    return df.select("race_id", "jockey", "day", "starts", "wins")


@query("w18_same_day_wins", "SELECT race_id, jockey, coalesce(sum(w1) OVER (PARTITION BY day, jockey ORDER BY race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS wins_today FROM (SELECT jockey, day, race_id, count(*) FILTER (WHERE finish = 1) AS w1 FROM e GROUP BY ALL)")
def w18(spark, d):
    return H.race_order(entries(spark, d), ["day", "jockey"], ["race_id"], wins_today=F.count_if(F.col("finish") == 1)).select("race_id", "jockey", "wins_today")


@query("j3_prior_history", "SELECT a.race_id, a.horse, count(b.race_id) AS earlier, count(b.race_id) FILTER (WHERE abs(b.distance - a.distance) <= 200) AS near_distance, round(avg((b.finish = 1)::INT) FILTER (WHERE b.venue = a.venue), 6) AS venue_win_rate FROM e a JOIN e b ON a.horse = b.horse AND b.day < a.day AND b.race_date >= a.race_date - INTERVAL 10 YEAR GROUP BY a.race_id, a.horse")
def j3(spark, d):
    e = entries(spark, d)
    cols = ("race_id", "horse", "day", "distance", "venue", "finish")
    pairs = H.prior_history(e.select(*cols), e.select(*cols), ["horse"], years=10)
    same = F.col("h_venue") == F.col("venue")
    return pairs.groupBy(*KEY).agg(F.count("*").alias("earlier"), F.count_if(F.abs(F.col("h_distance") - F.col("distance")) <= 200).alias("near_distance"), R6(F.avg(F.when(same, (F.col("h_finish") == 1).cast("int")))).alias("venue_win_rate"))


@query("j4_recent_window", "SELECT DISTINCT venue, day, count(*) OVER w AS runners_5d, round(avg(CASE WHEN finish = 1 AND 2 * horse_no <= field_size + 1 THEN 1.0 ELSE 0 END) OVER w, 6) AS inside_share FROM e WINDOW w AS (PARTITION BY venue ORDER BY day RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def j4(spark, d):
    inside = ((F.col("finish") == 1) & (2 * F.col("horse_no") <= F.col("field_size") + 1)).cast("int")
    t = H.day_grain(entries(spark, d), ["venue"], days=5, runners_5d=F.count("*"), _inside=F.sum(inside))
    return t.select("venue", "day", "runners_5d", R6(F.try_divide("_inside", F.col("runners_5d"))).alias("inside_share"))


@query("j5_range_lookback", "SELECT a.race_id, a.horse, count(b.race_id) AS in_lookback FROM (SELECT *, 100 + distance / 10 AS lookback FROM e) a LEFT JOIN e b ON a.horse = b.horse AND b.day < a.day AND a.day - b.day <= a.lookback GROUP BY a.race_id, a.horse")
def j5(spark, d):
    e = entries(spark, d)
    target = e.select(*KEY, "day", (100 + F.col("distance") / 10).alias("lookback"))
    return H.range_join(target, e.select(*KEY, "day"), ["horse"], "lookback", how="left").groupBy(*KEY).agg(F.count("h_race_id").alias("in_lookback"))


@query("j6_asof", "SELECT t.race_id, t.horse, c.n::BIGINT AS n FROM e t ASOF LEFT JOIN (SELECT sire, venue, day, sum(count(*)) OVER (PARTITION BY sire, venue ORDER BY day) AS n FROM e GROUP BY sire, venue, day) c ON t.sire = c.sire AND t.venue = c.venue AND t.day > c.day")
def j6(spark, d):
    e = entries(spark, d)
    daily = e.groupBy("sire", "venue", "day").agg(F.count("*").alias("k"))
    cumulative = daily.withColumn("n", F.sum("k").over(W.partitionBy("sire", "venue").orderBy("day")))
    return H.asof_join(e.select(*KEY, "sire", "venue", "day"), cumulative, ["sire", "venue"], "day", ["n"]).select(*KEY, "n")


@query("j17_monthly", "SELECT sire, strftime(m, '%Y-%m') AS month, coalesce(sum(s) OVER w, 0)::BIGINT AS starts, coalesce(sum(w1) OVER w, 0)::BIGINT AS wins FROM (SELECT sire, date_trunc('month', race_date) AS m, count(*) AS s, count(*) FILTER (WHERE finish = 1) AS w1 FROM e GROUP BY ALL) WINDOW w AS (PARTITION BY sire ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def j17(spark, d):
    df = H.monthly_cumulative(entries(spark, d), ["sire"], starts=F.count("*"), wins=F.count_if(F.col("finish") == 1))
    return df.select("sire", F.date_format("month", "yyyy-MM").alias("month"), "starts", "wins")


@query("a41_day_grain", "SELECT sire, day, coalesce(sum(s) OVER w, 0)::BIGINT AS starts, coalesce(sum(w1) OVER w, 0)::BIGINT AS wins FROM (SELECT sire, day, count(*) AS s, count(*) FILTER (WHERE finish = 1) AS w1 FROM e GROUP BY ALL) WINDOW w AS (PARTITION BY sire ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def a41(spark, d):
    return H.day_grain(entries(spark, d), ["sire"], starts=F.count("*"), wins=F.count_if(F.col("finish") == 1))
