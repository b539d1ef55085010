"""Queries of the feature layers (L)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import rounded
from ..operators import history as H
from ..operators import joins as J
from ..operators import lineage as N
from ..operators import metrics as M
from ..sources.tables import cut
from . import layers as L
from .registry import query
from .views import RUNS, entries, last, table

KEY = ("race_id", "horse")
#: Added before rounding where values fall on ties (fractions of a power of two), which engines round their own way.
HAIR = 1e-12


def out(df, *cols, digits=9, **fewer):
    """Keys and columns; doubles rounded once, as the SQL rounds, to `digits` or to what `fewer` says of a column."""
    kinds = dict(df.dtypes)
    return df.select(*KEY, *(rounded(c, fewer.get(c, digits)).alias(c) if kinds[c] == "double" else F.col(c) for c in cols))


def runners(spark, d, *cols):
    """The runners by the columns that a layer reads: a layer that writes its runners down writes no others."""
    return entries(spark, d).select(*KEY, "day", "race_date", "finish", *cols)


def rate(cell, name, hit="finish = 1", frame="RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"):
    return f"round(avg(({hit})::INT) OVER (PARTITION BY {cell} ORDER BY day {frame}), 9) AS {name}"


def rows(value, n, name):
    return f"round({value} OVER (PARTITION BY horse ORDER BY day, race_id ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), 9) AS {name}"


def runs(value, n, name):
    return f"round({value} {last(n)}, 9) AS {name}"


def select(*items, src="e"):
    return f"SELECT race_id, horse, {', '.join(items)} FROM {src}"


@query("l1_skeleton", select("CASE WHEN venue = 8 THEN 'draught' WHEN venue < 10 THEN 'national' ELSE 'local' END AS category", "round(CASE WHEN field_size > 1 THEN (finish - 1) / (field_size - 1)::DOUBLE END, 9) AS finish_norm"))
def l1(spark, d):
    return out(L.skeleton(entries(spark, d)), "category", "finish_norm")


@query("l2_career", select(rate("horse", "career_win_rate"), rate("horse, venue", "venue_win_rate"), rate("horse, surface", "surface_win_rate"), runs("avg(time)", 5, "speed_avg5"), runs("min(time)", 5, "speed_best5"), "(day - max(day) OVER (PARTITION BY horse ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT AS days_since", "count(*) OVER (PARTITION BY horse ORDER BY day RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING) AS starts_30d", "round((SELECT avg((h.finish = 1)::INT) FROM e h WHERE h.horse = r.horse AND h.day < r.day AND abs(h.distance - r.distance) <= 200), 9) AS distance_win_rate", rate("horse, class", "class_win_rate"), rate("horse", "career_place_rate", "finish <= 2"), rate("horse", "career_show_rate", "finish <= 3"), "count(*) OVER (PARTITION BY horse ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS starts", "count(*) FILTER (WHERE finish = 1) OVER (PARTITION BY horse ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS wins", "count(*) OVER (PARTITION BY horse ORDER BY day RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING) AS starts_90d", runs("min(finish)", 5, "best_finish5"), runs("avg(odds)", 5, "odds_avg5"), "min(time) OVER (PARTITION BY horse, distance ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_time_distance", "count(*) OVER (PARTITION BY horse, jockey ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS starts_with_jockey", src=f"{RUNS} r"))
def l2(spark, d):
    return out(L.career(entries(spark, d)), "career_win_rate", "venue_win_rate", "surface_win_rate", "speed_avg5", "speed_best5", "days_since", "starts_30d", "distance_win_rate", "class_win_rate", "career_place_rate", "career_show_rate", "starts", "wins", "starts_90d", "best_finish5", "odds_avg5", "best_time_distance", "starts_with_jockey")


SEASON = "floor((month(race_date) + 9) % 12 / 3)"
CONTEXT = {"venue": "venue", "distance": "distance", "surface": "surface", "class": "class", "season": SEASON}
EVER = "RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query("l3_jockey_trainer", select(*(rate(f"{who}, {c}", f"{who}_{n}") for who in ("jockey", "trainer") for n, c in CONTEXT.items()), *(rate(who, f"{who}_win_rate") for who in ("jockey", "trainer")), *(rate(who, f"{who}_60d", frame="RANGE BETWEEN 60 PRECEDING AND 1 PRECEDING") for who in ("jockey", "trainer")), rate("jockey, horse", "pair_win_rate"), rate("jockey, trainer", "jockey_with_trainer"), rate("jockey, owner", "jockey_with_owner"), rate("jockey", "jockey_show_rate", "finish <= 3"), "count(*) OVER w AS jockey_starts", "count(*) FILTER (WHERE finish = 1) OVER w AS jockey_wins") + f" WINDOW w AS (PARTITION BY jockey ORDER BY day {EVER})")
def l3(spark, d):
    both = [f"{who}_{n}" for who in ("jockey", "trainer") for n in (*CONTEXT, "win_rate", "60d")]
    return out(L.jockey_trainer(runners(spark, d, "jockey", "trainer", "owner", "venue", "distance", "surface", "class")), *both, "pair_win_rate", "jockey_with_trainer", "jockey_with_owner", "jockey_show_rate", "jockey_starts", "jockey_wins")


RARE = ", ".join(f"CASE WHEN count(*) OVER {w} >= 5 THEN avg((finish = 1)::INT) OVER {w} END AS {n}" for n, w in ((n, f"(PARTITION BY {c} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)") for n, c in (("sb", "sire, distance // 400"), ("ss", "sire, surface"), ("db", "damsire, distance // 400"))))


@query("l4_pedigree", f"SELECT race_id, horse, round(sb, 9) AS sire_band, round(ss, 9) AS sire_surface, round(db, 9) AS damsire_band, round((coalesce(sb, 0) + coalesce(ss, 0) + coalesce(db, 0)) / 3, 7) AS pedigree FROM (SELECT *, {RARE} FROM e)")
def l4(spark, d):
    return out(L.pedigree(entries(spark, d)), "sire_band", "sire_surface", "damsire_band", "pedigree", pedigree=7)


@query("l5_track_bias", select("round(coalesce(avg((finish = 1 AND 2 * horse_no <= field_size + 1)::INT) OVER w, 0), 9) AS inside_bias", "round(coalesce(avg((finish = 1 AND CASE WHEN field_size > 1 THEN (corner1 - 1) / (field_size - 1)::DOUBLE ELSE 0 END <= 0.33)::INT) OVER w, 0), 9) AS front_bias") + " WINDOW w AS (PARTITION BY venue ORDER BY day RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING)")
def l5(spark, d):
    return out(L.track_bias(entries(spark, d)), "inside_bias", "front_bias")


@query("l6_weight", f"SELECT race_id, horse, round(a, 9) AS weight_avg5, round(body_weight - a, 9) AS weight_diff, round(CASE WHEN n >= 2 THEN s END, 4) AS weight_slope, round(greatest(-5, least(5, (body_weight - a) / greatest(sd, 1))), 9) AS weight_z, round(sd, 7) AS weight_volatility FROM (SELECT *, avg(body_weight) {last(5)} AS a, stddev_pop(body_weight) {last(5)} AS sd, count(*) {last(5)} AS n, regr_slope(body_weight, k) {last(5)} AS s FROM {RUNS})")
def l6(spark, d):
    return out(L.weight(entries(spark, d)), "weight_avg5", "weight_diff", "weight_slope", "weight_z", "weight_volatility", weight_slope=4, weight_volatility=7)


@query("l7_recent_form", f"SELECT race_id, horse, max(finish) {last(1)} AS last_finish, substr(class, 1, 1)::INT - max(substr(class, 1, 1)::INT) {last(1)} AS class_diff, distance - max(distance) {last(1)} AS distance_diff, round(avg(finish) {last(3)}, 9) AS finish_avg3, round(CASE WHEN count(*) {last(5)} >= 3 THEN -regr_slope(finish, k) {last(5)} END, 4) AS form_slope FROM {RUNS}")
def l7(spark, d):
    return out(L.recent_form(entries(spark, d)), "last_finish", "class_diff", "distance_diff", "finish_avg3", "form_slope", form_slope=4)


@query("l8_race_context", ", r AS (SELECT *, avg((finish = 1)::INT) OVER (PARTITION BY horse ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM e) SELECT race_id, horse, round(avg(q) OVER (PARTITION BY race_id), 9) AS field_mean, round(avg(CASE WHEN k <= 3 THEN q END) OVER (PARTITION BY race_id), 9) AS top_mean, round(field_size / 18, 9) AS field_ratio, (rank() OVER (PARTITION BY race_id ORDER BY q DESC NULLS LAST) - 1)::BIGINT AS rivals, (substr(class, 1, 1)::INT <= 3)::INT AS graded FROM (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY q DESC NULLS LAST, horse) AS k FROM r)")
def l8(spark, d):
    return out(L.race_context(entries(spark, d)), "field_mean", "top_mean", "field_ratio", "rivals", "graded")


@query("l9_class_velocity", "SELECT a.race_id, a.horse, (a.day - max(b.day))::INT AS class_velocity FROM e a LEFT JOIN e b ON a.horse = b.horse AND b.day < a.day AND b.finish = 1 AND substr(b.class, 1, 1)::INT >= substr(a.class, 1, 1)::INT - 1 GROUP BY a.race_id, a.horse, a.day")
def l9(spark, d):
    return out(L.class_velocity(entries(spark, d)), "class_velocity")


@query("l10_class_variance", select(runs("stddev_pop(substr(class, 1, 1)::INT)", 5, "class_variance"), src=RUNS))
def l10(spark, d):
    return out(L.class_variance(entries(spark, d)), "class_variance")


@query("l11_trainer_flat", ", g AS (SELECT trainer, day, count(*) FILTER (WHERE substr(class, 1, 1)::INT > 3) AS n, count(*) FILTER (WHERE substr(class, 1, 1)::INT > 3 AND finish = 1) AS k FROM e GROUP BY ALL), c AS (SELECT trainer, day, sum(n) OVER w AS n, sum(k) OVER w AS k FROM g WINDOW w AS (PARTITION BY trainer ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT race_id, horse, round(k / nullif(n, 0)::DOUBLE, 9) AS trainer_flat FROM e JOIN c USING (trainer, day)")
def l11(spark, d):
    return out(L.trainer_flat(runners(spark, d, "trainer", "class")), "trainer_flat")


#: Hours after which a reading says nothing about a race; the readings' years are moved back to those of the races.
STALE, SHIFT = 6, 28
HOURLY = f"SELECT user_id % 25 AS venue, date_trunc('hour', ts) - INTERVAL {SHIFT} YEAR AS hour, arg_max(value, (ts, event_id)) AS reading, arg_max(event_type, (ts, event_id)) AS kind FROM events GROUP BY ALL"


@query("l12_weather", f", h AS ({HOURLY}), r AS (SELECT DISTINCT race_id, venue, race_date + INTERVAL 1 HOUR * (9 + race_id % 8) AS starts FROM e), w AS (SELECT race_id, max(struct_pack(hour := hour, reading := reading, kind := kind)) AS m FROM r JOIN h ON h.venue = r.venue AND hour <= starts AND starts - hour <= INTERVAL {STALE} HOUR GROUP BY race_id) SELECT e.race_id, e.horse, m.kind AS weather, CASE WHEN m.reading IS NOT NULL THEN round(least(greatest(m.reading, 0), 100) / 100, 9) END AS going, date_diff('hour', m.hour, starts)::BIGINT AS hours_old FROM e JOIN r USING (race_id) LEFT JOIN w USING (race_id)")
def l12(spark, d):
    """Weather of a race: the newest hourly row of its venue not after its start and not staler than six hours; of an hour's readings the last counts."""
    hour = F.make_timestamp(F.year("ts") - SHIFT, F.month("ts"), F.dayofmonth("ts"), F.hour("ts"), F.lit(0), F.lit(0))
    hourly = table(spark, d, "events").groupBy((F.col("user_id") % 25).cast("int").alias("venue"), hour.alias("hour")).agg(F.max_by(F.struct(F.col("value").alias("reading"), F.col("event_type").alias("kind")), F.struct("ts", "event_id")).alias("m")).select("venue", "hour", "m.*")
    e = entries(spark, d)
    starts = F.col("race_date").cast("timestamp") + F.make_dt_interval(F.lit(0), (9 + F.col("race_id") % 8).cast("int"))
    df = L.weather(e.withColumn("starts", starts), hourly, STALE)
    return df.select(*KEY, "weather", F.round("going", 9).alias("going"), "hours_old")


@query("l13_physics", select("rank() OVER (PARTITION BY race_id ORDER BY carried / body_weight)::BIGINT AS carry_ratio_rank", "rank() OVER (PARTITION BY race_id ORDER BY body_weight DESC)::BIGINT AS body_weight_rank", "round(carried - avg(carried) OVER (PARTITION BY race_id), 9) AS carried_diff", "round(carried / body_weight, 9) AS carry_ratio", "round(CASE WHEN stddev_samp(carried) OVER w > 1e-9 AND stddev_samp(body_weight) OVER w > 1e-9 THEN (carried - avg(carried) OVER w) / stddev_samp(carried) OVER w - (body_weight - avg(body_weight) OVER w) / stddev_samp(body_weight) OVER w END, 6) AS joint_z") + " WINDOW w AS (PARTITION BY race_id)")
def l13(spark, d):
    return out(L.physics(entries(spark, d)), "carry_ratio_rank", "body_weight_rank", "carried_diff", "carry_ratio", "joint_z", joint_z=6)


@query("l14_history_speed", select(runs("avg(distance / time)", 5, "speed5"), runs("stddev_pop(distance / time)", 5, "speed_volatility"), runs("body_weight / 450 * avg(distance / time)", 5, "speed_weight"), runs("carried / 55 * avg(distance / time)", 5, "speed_carry"), runs("1.0::DOUBLE / age * avg(distance / time)", 5, "speed_age"), src=RUNS))
def l14(spark, d):
    return out(L.history_speed(entries(spark, d)), "speed5", "speed_volatility", "speed_weight", "speed_carry", "speed_age")


@query("l15_race_internal", select("rank() OVER (PARTITION BY race_id ORDER BY odds)::BIGINT AS odds_rank", "round(odds - avg(odds) OVER (PARTITION BY race_id), 9) AS odds_diff", "round(sum((corner1 <= 2)::INT) OVER (PARTITION BY race_id) / field_size::DOUBLE, 9) AS pace_pressure"))
def l15(spark, d):
    return out(L.race_internal(entries(spark, d)), "odds_rank", "odds_diff", "pace_pressure")


@query("l16_market", "SELECT race_id, horse, round((1 / odds) / sum(1 / odds) OVER w + 1e-12, 9) AS implied_share, rank() OVER (PARTITION BY race_id ORDER BY 1 / odds DESC)::BIGINT AS implied_rank, rank() OVER (PARTITION BY race_id ORDER BY f NULLS LAST)::BIGINT AS form_rank, rank() OVER (PARTITION BY race_id ORDER BY 1 / odds DESC)::BIGINT - CASE WHEN f IS NOT NULL THEN rank() OVER (PARTITION BY race_id ORDER BY f NULLS LAST)::BIGINT END AS disagreement, round(1 / odds, 9) AS implied, round(1 / odds - avg(1 / odds) OVER w, 9) AS implied_diff, round(f, 9) AS form, round(sum(1 / odds) OVER w, 9) AS overround FROM (SELECT *, avg(finish) OVER (PARTITION BY horse ORDER BY day, race_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS f FROM e) WINDOW w AS (PARTITION BY race_id)")
def l16(spark, d):
    return out(L.market(entries(spark, d)).withColumn("implied_share", F.col("implied_share") + HAIR), "implied_share", "implied_rank", "form_rank", "overround", "disagreement", "implied", "implied_diff", "form")


@query("l17_sectional", select(runs("avg(last3f)", 3, "last3f_avg3"), runs("avg(last3f)", 5, "last3f_avg5"), f"max(body_weight) {last(1)} AS last_weight", f"round(CASE WHEN count(*) {last(5)} >= 3 THEN regr_slope(last3f, k) {last(5)} END, 6) AS last3f_slope", src=RUNS))
def l17(spark, d):
    return out(L.sectional_weight(entries(spark, d)), "last3f_avg3", "last3f_avg5", "last_weight", "last3f_slope", last3f_slope=6)


@query("l18_carried_weight", select("round(avg(carried) OVER (h ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 9) AS carried_avg5", "round(avg((carried >= 54)::INT) OVER (h ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 9) AS carried_heavy10", "rank() OVER (PARTITION BY race_id ORDER BY carried DESC)::BIGINT AS carried_rank", "round(carried - avg(carried) OVER (PARTITION BY race_id), 9) AS carried_diff") + " WINDOW h AS (PARTITION BY horse ORDER BY day, race_id)")
def l18(spark, d):
    return out(L.carried_weight(entries(spark, d)), "carried_avg5", "carried_heavy10", "carried_rank", "carried_diff")


@query("l19_workouts", "SELECT event_id, count(*) OVER n AS workouts, round(avg(value) OVER n, 9) AS lap_avg, (day - max(day) OVER n)::INT AS days_since, " + ", ".join(f"CASE WHEN day - max(day) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN (k - kb + {i - 1}) PRECEDING AND (k - kb + {i - 1}) PRECEDING) <= 90 THEN max(value) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN (k - kb + {i - 1}) PRECEDING AND (k - kb + {i - 1}) PRECEDING) END AS lap{i}" for i in range(1, 6)) + " FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kb FROM (SELECT *, date_diff('day', DATE '1970-01-01', ts::DATE) AS day FROM events)) WINDOW n AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 90 PRECEDING AND 1 PRECEDING)", base=False)
def l19(spark, d):
    """Workouts of the last 90 days, today left out: how many, their mean, how long ago the last was, and the last five, newest first."""
    ev = table(spark, d, "events").withColumn("day", F.datediff(F.to_date("ts"), F.lit("1970-01-01")))
    df = H.within_days(ev, ["user_id"], 90, workouts=F.count("*"), lap_avg=F.avg("value"), last=F.max("day"))
    df = H.last_before(df, ["user_id"], order=("day", "ts", "event_id"), laps=(5, F.collect_list(F.struct("day", "value"))))
    recent = F.reverse(F.filter("laps", lambda x: F.col("day") - x["day"] <= 90))
    return df.select("event_id", "workouts", F.round("lap_avg", 9).alias("lap_avg"), (F.col("day") - F.col("last")).alias("days_since"), *(F.get(recent, i)["value"].alias(f"lap{i + 1}") for i in range(5)))


MARGIN = "(SELECT *, time - max(CASE WHEN finish = 1 THEN time END) OVER (PARTITION BY race_id) AS m FROM e)"


@query("l20_near_miss", select(rate("horse", "second_rate", "finish = 2"), rate("jockey", "jockey_second", "finish = 2"), rate("sire", "sire_second", "finish = 2"), rate("damsire", "damsire_second", "finish = 2"), rate("sire, surface", "sire_surface_second", "finish = 2"), "sum((finish = 2)::INT) OVER (PARTITION BY horse ORDER BY day, race_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)::BIGINT AS seconds5", rows("avg(m)", 5, "margin5"), rows("min(abs(m))", 5, "margin_best5"), rows("avg(CASE WHEN finish = 2 THEN m END)", 5, "second_margin5"), "round(max(CASE WHEN popularity = 1 THEN odds END) OVER r / max(CASE WHEN popularity = 2 THEN odds END) OVER r, 9) AS favourite_gap", src=MARGIN) + " WINDOW r AS (PARTITION BY race_id)")
def l20(spark, d):
    return out(L.near_miss(runners(spark, d, "jockey", "sire", "damsire", "surface", "time", "odds")), "second_rate", "jockey_second", "sire_second", "damsire_second", "sire_surface_second", "seconds5", "margin5", "margin_best5", "second_margin5", "favourite_gap")


#: Rules of the lineage: which races are targets (the smallest priority wins), and which are trials of a target, for how many days.
TARGETS = [("big", 0, "1-URGENT/F", None, None, None), ("mile", 1, None, "URGENT", None, 1600), ("home", 2, None, "-HIGH/", 3, None)]
TRIALS = [("big", "2-HIGH/F", None, 400), ("big", None, "MEDIUM", 200), ("mile", None, "/F", 300), ("mile", None, "URGENT", 300), ("home", None, "URGENT", 900)]


def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if v is None else repr(v) for v in r) + ")" for r in rows)


LINEAGE = f""", n AS (SELECT *, class || '/' || surface AS name, time - max(CASE WHEN finish = 1 THEN time END) OVER (PARTITION BY race_id) AS margin FROM e),
r AS (SELECT DISTINCT race_id, name, venue, distance FROM n),
g AS (SELECT race_id, target FROM r JOIN (VALUES {_values(TARGETS)}) t(target, priority, eq, con, v, d) ON coalesce(name = eq, contains(name, con)) AND (v IS NULL OR v = venue) AND (d IS NULL OR d = distance) QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY priority, target) = 1),
s AS (SELECT race_id, target, back FROM r JOIN (VALUES {_values(TRIALS)}) t(target, eq, con, back) ON coalesce(name = eq, contains(name, con))),
h AS (SELECT horse, day, finish, margin, target, back FROM n JOIN s USING (race_id)),
c AS (SELECT race_id, n.horse, count(*) AS trial_count, count(*) FILTER (WHERE h.finish = 1) AS trial_wins, count(*) FILTER (WHERE h.finish <= 3) AS trial_top3, min(h.finish) AS trial_best, avg(CASE WHEN h.finish <= 2 THEN h.margin END) AS trial_margin
  FROM n JOIN g USING (race_id) JOIN h ON h.horse = n.horse AND h.target = g.target AND h.day < n.day AND n.day - h.day <= back GROUP BY race_id, n.horse)
SELECT n.race_id, n.horse, target, coalesce(trial_count, 0) AS trial_count, coalesce(trial_wins, 0) AS trial_wins, coalesce(trial_top3, 0) AS trial_top3, trial_best, round(trial_margin, 7) AS trial_margin FROM n LEFT JOIN g USING (race_id) LEFT JOIN c ON c.race_id = n.race_id AND c.horse = n.horse"""


@query("l21_grade_lineage", LINEAGE)
def l21(spark, d):
    """A runner's record in the trials of its race's target, by two rule tables."""
    e = entries(spark, d).withColumns({"name": F.concat_ws("/", "class", "surface"), "margin": F.col("time") - F.max(F.when(F.col("finish") == 1, F.col("time"))).over(W.partitionBy("race_id"))})
    targets = spark.createDataFrame(TARGETS, "target string, priority int, equals string, contains string, venue int, distance int")
    trials = spark.createDataFrame(TRIALS, "target string, equals string, contains string, look_back int")
    df = N.trial_record(cut(e.select(*KEY, "day", "finish", "margin", "venue", "distance", "name"), "lineage"), targets, trials)
    return df.select(*KEY, "target", "trial_count", "trial_wins", "trial_top3", "trial_best", F.round("trial_margin", 7).alias("trial_margin"))


@query("l22_head_to_head", ", m AS (SELECT a.race_id, a.day, a.horse AS x, b.horse AS y, (a.finish < b.finish)::INT AS won, b.finish - a.finish AS gap FROM e a JOIN e b ON a.race_id = b.race_id AND a.horse <> b.horse), t AS (SELECT x, y, day, count(*) AS n, sum(won) AS w, sum(gap) AS g FROM m GROUP BY ALL) SELECT m.race_id, m.x AS horse, coalesce(sum(p.n), 0)::BIGINT AS meetings, coalesce(sum(p.w), 0)::BIGINT AS beaten, coalesce(sum(p.n - p.w), 0)::BIGINT AS lost, round(sum(p.w) / sum(p.n)::DOUBLE, 9) AS beaten_share, round(sum(p.g) / sum(p.n)::DOUBLE, 7) AS gap_mean, count(DISTINCT p.y) AS rivals_met FROM m LEFT JOIN t p ON p.x = m.x AND p.y = m.y AND p.day < m.day GROUP BY m.race_id, m.x")
def l22(spark, d):
    """Earlier meetings of a runner with today's rivals: how many, won, lost, the share won, by how many places on average, with how many of them. Pairs once, by a window over the pair."""
    p = J.pairs_within(entries(spark, d), ["race_id"], "horse", ["finish", "day"]).withColumn("day", F.col("a_day"))
    w = H.before("a_horse", "b_horse")
    p = p.withColumns({"n": F.count("*").over(w), "won": F.count_if(F.col("a_finish") < F.col("b_finish")).over(w), "gap": F.coalesce(F.sum(F.col("b_finish") - F.col("a_finish")).over(w), F.lit(0))})
    both = p.select("race_id", F.col("a_horse").alias("horse"), "n", "won", "gap").unionByName(p.select("race_id", F.col("b_horse").alias("horse"), "n", (F.col("n") - F.col("won")).alias("won"), (-F.col("gap")).alias("gap")))
    t = both.groupBy(*KEY).agg(F.sum("n").alias("meetings"), F.sum("won").alias("beaten"), F.sum("gap").alias("gap"), F.count_if(F.col("n") > 0).alias("rivals_met"))
    share = lambda c, digits: F.round(F.try_divide(F.col(c), F.col("meetings")), digits)
    return t.select(*KEY, "meetings", "beaten", (F.col("meetings") - F.col("beaten")).alias("lost"), share("beaten", 9).alias("beaten_share"), share("gap", 7).alias("gap_mean"), "rivals_met")


GOING = [x for who in ("sire", "damsire") for x in (rate(f"{who}, day % 3", f"{who}_going"), rate(f"{who}, day % 3", f"{who}_going_show", "finish <= 3"), f"count(*) OVER (PARTITION BY {who}, day % 3 ORDER BY day {EVER}) AS {who}_going_n", f"round(avg((finish = 1)::INT) OVER (PARTITION BY {who}, day % 3 ORDER BY day {EVER}) - avg((finish = 1)::INT) OVER (PARTITION BY {who} ORDER BY day {EVER}), 9) AS {who}_going_edge")]


@query("l23_going_pedigree", select(*GOING))
def l23(spark, d):
    return out(L.going_pedigree(entries(spark, d)), *(f"{who}_going{x}" for who in ("sire", "damsire") for x in ("", "_show", "_n", "_edge")))


@query("l24_trainer_affinity", select(rate("trainer, class", "trainer_class"), rate("trainer, venue, distance", "trainer_target")))
def l24(spark, d):
    return out(L.trainer_affinity(entries(spark, d)), "trainer_class", "trainer_target")


@query("l25_pace_style", ", v AS (SELECT race_id, horse, race_year, popularity, corner1, 'v1' AS version, score_a AS s FROM e UNION ALL SELECT race_id, horse, race_year, popularity, corner1, 'v2', score_b FROM e WHERE race_year >= 1998), k AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY race_id, horse ORDER BY CASE WHEN (version = 'v2') = (race_year >= 1998) THEN 0 ELSE 1 END, version) = 1), p AS (SELECT *, s / sum(s) OVER (PARTITION BY race_id) AS q FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY q DESC, horse) AS k, count(*) OVER (PARTITION BY race_id) AS n FROM p) SELECT race_id, version, count(*) AS runners, round(-sum(q * ln(q + 1e-9)), 9) AS style_entropy, round(exp(-sum(q * ln(q + 1e-9))), 8) AS style_effective, round(max(q), 9) AS style_max, round(min(q), 9) AS style_min, round(max(q) - min(q), 9) AS style_spread, round(max(CASE WHEN k = 2 THEN q END), 9) AS style_second, round(max(q) - max(CASE WHEN k = 2 THEN q END), 9) AS style_gap, round(stddev_pop(q), 6) AS style_sd, round(sum(CASE WHEN k <= 3 THEN q END), 9) AS style_top3, count(*) FILTER (WHERE q > 1 / n + 1e-9) AS above_mean, round(max(CASE WHEN popularity = 1 THEN q END), 9) AS favourite_share, round(max(CASE WHEN corner1 = 1 THEN q END), 9) AS leader_share FROM o GROUP BY race_id, version")
def l25(spark, d):
    """The model version preferred for the year, then what the field's style says."""
    e = entries(spark, d)
    cols = (*KEY, "race_year", "popularity", "corner1")
    v = e.select(*cols, F.lit("v1").alias("version"), F.col("score_a").alias("s")).unionByName(e.where("race_year >= 1998").select(*cols, F.lit("v2").alias("version"), F.col("score_b").alias("s")))
    k = J.first_per_key(v, KEY, [F.when((F.col("version") == "v2") == (F.col("race_year") >= 1998), 0).otherwise(1), "version"])
    t = L.pace_style(k.withColumn("q", F.col("s") / F.sum("s").over(W.partitionBy("race_id"))))
    return t.select("race_id", "version", "runners", "above_mean", *(F.round(c, n).alias(c) for c, n in {"style_effective": 8, "style_sd": 6}.items()), *(F.round(c, 9).alias(c) for c in ("style_entropy", "style_max", "style_min", "style_spread", "style_second", "style_gap", "style_top3", "favourite_share", "leader_share")))


@query("l26_course", ", c AS (SELECT c_nationkey AS venue, count(*) AS stands, min(c_acctbal) AS lowest, max(c_acctbal) AS highest, max(c_acctbal) - min(c_acctbal) AS climb, count(DISTINCT c_mktsegment) AS turns, round(median(c_acctbal), 6) AS straight FROM customer GROUP BY 1) SELECT race_id, horse, stands, lowest, highest, climb, turns, straight, n_regionkey AS shape FROM e LEFT JOIN c USING (venue) LEFT JOIN nation ON venue = n_nationkey")
def l26(spark, d):
    """Seven constants of the course, from a table with a row a venue (made from customers and nations); a venue that it lacks has nulls."""
    a = F.col("c_acctbal")
    grounds = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("venue")).agg(F.count("*").alias("stands"), F.min(a).alias("lowest"), F.max(a).alias("highest"), (F.max(a) - F.min(a)).alias("climb"), F.countDistinct("c_mktsegment").alias("turns"), F.round(F.median(a), 6).alias("straight"))
    courses = table(spark, d, "nation").selectExpr("n_nationkey venue", "n_regionkey shape").join(grounds, "venue", "left")
    return L.course(entries(spark, d), courses, ["venue"]).select(*KEY, "stands", "lowest", "highest", "climb", "turns", "straight", "shape")


R1 = ("carry_ratio_rank", "body_weight_rank", "carried_diff", "body_weight_diff", "carry_ratio", "joint_z", "speed5", "speed_volatility", "speed_weight", "speed_carry", "speed_age")


@query("l27_relationship", select("rank() OVER (PARTITION BY race_id ORDER BY carried / body_weight)::BIGINT AS carry_ratio_rank", "rank() OVER (PARTITION BY race_id ORDER BY body_weight DESC)::BIGINT AS body_weight_rank", "round(carried - avg(carried) OVER w, 9) AS carried_diff", "round(body_weight - avg(body_weight) OVER w, 9) AS body_weight_diff", "round(carried / body_weight, 9) AS carry_ratio", "round(CASE WHEN stddev_samp(carried) OVER w > 1e-9 AND stddev_samp(body_weight) OVER w > 1e-9 THEN (carried - avg(carried) OVER w) / stddev_samp(carried) OVER w - (body_weight - avg(body_weight) OVER w) / stddev_samp(body_weight) OVER w END, 6) AS joint_z", runs("avg(distance / time)", 5, "speed5"), runs("stddev_pop(distance / time)", 5, "speed_volatility"), runs("body_weight / 450 * avg(distance / time)", 5, "speed_weight"), runs("carried / 55 * avg(distance / time)", 5, "speed_carry"), runs("1.0::DOUBLE / age * avg(distance / time)", 5, "speed_age"), src=RUNS) + " WINDOW w AS (PARTITION BY race_id)")
def l27(spark, d):
    """L13 and L14 in one."""
    return out(L.history_speed(L.physics(entries(spark, d))), *R1, joint_z=6)


@query("l28_going_sectional", select(runs("avg(CASE WHEN day % 3 > 0 THEN last3f END)", 5, "firm3f"), runs("avg(CASE WHEN day % 3 = 0 THEN last3f END)", 5, "soft3f"), src=RUNS))
def l28(spark, d):
    return out(L.going_sectional(entries(spark, d)), "firm3f", "soft3f")


@query("l30_sire_venue", select("round(CASE WHEN count(*) OVER w > 3 THEN avg((finish = 1)::INT) OVER w END, 9) AS sire_venue_rate") + " WINDOW w AS (PARTITION BY sire, venue, surface, distance ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def l30(spark, d):
    return out(L.sire_venue(entries(spark, d)), "sire_venue_rate")



CELLS = {"own": "jockey", "cell": "jockey, sire, band", "pair": "jockey, damsire", "local": "jockey, venue", "line": "sire, band"}
CELL_SQL = ", b AS (SELECT *, CASE WHEN distance <= 1399 THEN 0 WHEN distance <= 1799 THEN 1 WHEN distance <= 2199 THEN 2 ELSE 3 END AS band FROM e)"
for _n, _by in CELLS.items():
    CELL_SQL += f", c_{_n} AS (SELECT {_by}, day, race_id, coalesce(sum(count(*)) OVER w, 0)::BIGINT AS {_n}_n, coalesce(sum(sum((finish = 1)::INT)) OVER w, 0)::BIGINT AS {_n}_w FROM b GROUP BY {_by}, day, race_id WINDOW w AS (PARTITION BY {_by} ORDER BY day, race_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_OWN = "((own_w + 30 * 0.0707) / (own_n + 30))"
CELL_SQL += ", j AS (SELECT b.race_id, b.horse, " + ", ".join(f"{n}_n, {n}_w" for n in CELLS) + f", {_OWN} AS own_rate, " + ", ".join(f"({n}_w + 20 * {'0.0707' if n == 'line' else _OWN}) / ({n}_n + 20) AS {n}_rate" for n in CELLS if n != "own") + " FROM b " + " ".join(f"JOIN c_{n} USING ({by}, day, race_id)" for n, by in CELLS.items()) + ")"
CELL_SQL += " SELECT race_id, horse, " + ", ".join(f"{n}_n, {n}_w, round({n}_rate, 11)::DOUBLE AS {n}_rate" for n in CELLS) + ", " + ", ".join(f"(rank() OVER (PARTITION BY race_id ORDER BY round({n}_rate, 8) DESC) + (count(*) OVER (PARTITION BY race_id, round({n}_rate, 8)) - 1) / 2.0)::DOUBLE AS {n}_rank" for n in CELLS if n != "own") + " FROM j"


@query("l31_cells", CELL_SQL)
def l31(spark, d):
    return out(L.cells(entries(spark, d)), *(f"{n}_{x}" for n in CELLS for x in ("n", "w", "rate")), *(f"{n}_rank" for n in CELLS if n != "own"), digits=11)


WHO = ("horse", "jockey", "trainer", "owner")


@query("l32_fade", select(*(x for w in WHO for x in (rate(w, f"{w}_fade", "finish > 3"), f"count(*) OVER (PARTITION BY {w} ORDER BY day {EVER}) AS {w}_starts", *(rate(w, f"{w}_fade_{n}d", "finish > 3", f"RANGE BETWEEN {n} PRECEDING AND 1 PRECEDING") for n in (60, 365)))), rows("avg((finish > 3)::INT)", 5, "fade5")))
def l32(spark, d):
    return out(L.fade(runners(spark, d, "jockey", "trainer", "owner")), *(f"{w}_{x}" for w in WHO for x in ("fade", "starts", "fade_60d", "fade_365d")), "fade5")


@query("l33_fade_extra", select(rows("avg((finish > 3)::INT)", 3, "fade3"), rows("avg((finish > 3)::INT)", 10, "fade10"), rate("horse", "fade_30d", "finish > 3", "RANGE BETWEEN 30 PRECEDING AND 1 PRECEDING"), rate("horse, jockey", "pair_fade", "finish > 3"), "(k - 1 - coalesce(max(CASE WHEN finish <= 3 THEN k END) OVER (PARTITION BY horse ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS fade_streak", src="(SELECT *, row_number() OVER (PARTITION BY horse ORDER BY day, race_id) AS k FROM e)"))
def l33(spark, d):
    return out(L.fade_extra(entries(spark, d)), "fade3", "fade10", "fade_30d", "pair_fade", "fade_streak")


@query("l34_locality", "SELECT a.race_id, a.horse, round(CASE WHEN count(b.race_id) > 0 THEN count(*) FILTER (WHERE b.venue = a.venue) / count(b.race_id)::DOUBLE END, 9) AS venue_share, count(DISTINCT b.venue) AS venues FROM e a LEFT JOIN e b ON a.horse = b.horse AND b.day < a.day GROUP BY a.race_id, a.horse")
def l34(spark, d):
    return out(L.locality(entries(spark, d)), "venue_share", "venues")


@query("l35_jockey_triple", select(rate("jockey, venue, CASE WHEN distance <= 1400 THEN 0 WHEN distance <= 1800 THEN 1 WHEN distance <= 2200 THEN 2 WHEN distance <= 2800 THEN 3 ELSE 4 END, surface", "jockey_triple")))
def l35(spark, d):
    return out(L.jockey_triple(entries(spark, d)), "jockey_triple")


def _marginal(legs, arms, name):
    return f"SELECT race_id, no AS horse_no, sum(p) AS {name} FROM ({' UNION ALL '.join(f'SELECT race_id, {x} AS no, p FROM {arms}' for x in legs)}) GROUP BY ALL"


@query("l36_exotic_odds", ", s2 AS (SELECT a.race_id, a.horse_no AS x, b.horse_no AS y, 1 / (round(a.odds * b.odds * 10)::INT / 10) AS p FROM e a JOIN e b ON a.race_id = b.race_id AND a.horse_no < b.horse_no), t2 AS (SELECT race_id, x, y, p / sum(p) OVER (PARTITION BY race_id) AS p FROM s2), s3 AS (SELECT a.race_id, a.horse_no AS x, b.horse_no AS y, c.horse_no AS z, 1 / (round(a.odds * b.odds * c.odds * 10)::INT / 10) AS p FROM e a JOIN e b ON a.race_id = b.race_id AND a.horse_no < b.horse_no JOIN e c ON b.race_id = c.race_id AND b.horse_no < c.horse_no), t3 AS (SELECT race_id, x, y, z, p / sum(p) OVER (PARTITION BY race_id) AS p FROM s3), m2 AS (" + _marginal("xy", "t2", "top2") + "), m3 AS (" + _marginal("xyz", "t3", "top3") + ") SELECT race_id, horse_no, round(top2, 8) AS top2, round(top3, 8) AS top3 FROM m2 LEFT JOIN m3 USING (race_id, horse_no)")
def l36(spark, d):
    """Packed odds of pairs and of triples, unpacked, overround removed, summed to each runner's chance of the first two and of the first three; null below three runners."""
    from .q_scalars import f10, f10_trio

    def marginal(slots, legs, name):
        s = slots.withColumn("p", F.try_divide(F.lit(1.0), F.col("odds")))
        t = s.withColumn("p", F.col("p") / F.sum("p").over(W.partitionBy("race_id")))
        each = t.select("race_id", F.explode(F.array(*(F.col(x).cast("long") for x in legs))).alias("horse_no"), "p")
        return each.groupBy("race_id", "horse_no").agg(F.round(F.sum("p"), 8).alias(name))

    return marginal(f10(spark, d), ["first", "second"], "top2").join(marginal(f10_trio(spark, d), ["first", "second", "third"], "top3"), ["race_id", "horse_no"], "left")


@query("l37_draught_class", select(rate("horse, CASE WHEN carried * 10 < 500 THEN 0 WHEN carried * 10 < 550 THEN 1 WHEN carried * 10 < 600 THEN 2 ELSE 3 END", "bucket_rate"), rate("CASE WHEN carried * 10 < 500 THEN 0 WHEN carried * 10 < 550 THEN 1 WHEN carried * 10 < 600 THEN 2 ELSE 3 END", "bucket_rate_all")))
def l37(spark, d):
    return out(L.draught_class(entries(spark, d)), "bucket_rate", "bucket_rate_all")


@query("l38_draught_grade", select(*(f"count(*) FILTER (WHERE class[1] = '{g}') OVER w AS starts_g{g}" for g in (1, 2, 3)), *(f"count(*) FILTER (WHERE class[1] = '{g}' AND finish = 1) OVER w AS wins_g{g}" for g in (1, 2, 3)), "(count(*) FILTER (WHERE class[1] = '1') OVER w * (class[1] > '1')::INT + count(*) FILTER (WHERE class[1] = '2') OVER w * (class[1] > '2')::INT + count(*) FILTER (WHERE class[1] = '3') OVER w * (class[1] > '3')::INT)::BIGINT AS higher_starts") + " WINDOW w AS (PARTITION BY horse ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def l38(spark, d):
    return out(L.draught_grade(entries(spark, d)), "starts_g1", "starts_g2", "starts_g3", "wins_g1", "wins_g2", "wins_g3", "higher_starts")


#: What differs between the runners of a race: of today, and of the last runs of earlier days.
DRAUGHT = ("last3f", "age", "odds", "carried", "body_weight", "horse_no", "popularity", "time", "score_b", "score_c", "corner1", "carry_ratio", "weight_avg5", "finish_avg3", "starts")
DRAUGHT_ROWS = f"(SELECT *, carried / body_weight AS carry_ratio, avg(body_weight) {last(5)} AS weight_avg5, avg(finish) {last(3)} AS finish_avg3, kb AS starts FROM {RUNS})"


@query("l39_draught_internal", select(*(f"rank() OVER (PARTITION BY race_id ORDER BY {c} DESC NULLS LAST)::BIGINT AS {c}_rank" for c in DRAUGHT), *(f"round({c} - avg({c}) OVER w + 1e-10, 4) AS {c}_diff" for c in ("odds", "body_weight")), *(f"round(CASE WHEN stddev_pop({c}) OVER w > 1e-9 THEN ({c} - avg({c}) OVER w) / stddev_pop({c}) OVER w END + 1e-10, 4) AS {c}_z" for c in DRAUGHT), src=DRAUGHT_ROWS) + " WINDOW w AS (PARTITION BY race_id)")
def l39(spark, d):
    """Rank and z of each of fifteen values, and two differences: 32 columns."""
    df = H.last_before(entries(spark, d), ["horse"], weight_avg5=(5, F.avg("body_weight")), finish_avg3=(3, F.avg("finish")))
    df = df.withColumns({"carry_ratio": F.col("carried") / F.col("body_weight"), "starts": F.count("*").over(H.before("horse"))})
    near = [f"{c}_z" for c in DRAUGHT] + ["odds_diff", "body_weight_diff"]
    df = L.draught_internal(df, DRAUGHT)
    flat = {f"{c}_z": F.when(F.stddev_pop(c).over(W.partitionBy("race_id")) > 1e-9, F.col(f"{c}_z")) for c in DRAUGHT}
    return out(df.withColumns(flat).withColumns({c: F.col(c) + 1e-10 for c in near}), *(f"{c}_rank" for c in DRAUGHT), *near, digits=4)


#: Places that stand for those at four corners.
CORNERS = ("corner1", "popularity", "horse_no", "finish")
STYLE_IF = {"front": "corner1 = 1", "near": "corner1 > 1 AND c1 <= 0.3", "mid": "c1 > 0.3 AND c1 <= 0.7", "rear": "c1 > 0.7"}


def _styles():
    """Columns of l40 in SQL: how they are computed, by name, and the digits they are compared at."""
    ever = lambda by: f"OVER (PARTITION BY {by} ORDER BY day {EVER})"
    made = {}
    for k in ("c1", "c2", "c3", "c4"):
        for n in (3, 5, 10):
            made |= {f"{k}_avg{n}": (f"avg({k}) {last(n)}", 9), f"{k}_best{n}": (f"min({k}) {last(n)}", 9), f"{k}_worst{n}": (f"max({k}) {last(n)}", 9), f"{k}_sd{n}": (f"stddev_pop({k}) {last(n)}", 6)}
        made |= {f"{k}_iqr5": (f"quantile_cont({k}, 0.75) {last(5)} - quantile_cont({k}, 0.25) {last(5)}", 9), f"{k}_last": (f"max({k}) {last(1)}", 9)}
        made |= {f"{k}_{name}": (f"avg({k}) {ever(by)}", 7) for name, by in {"ever": "horse", "surface": "horse, surface", "distance": "horse, distance", "jockey": "jockey"}.items()}
    for k in STYLE_IF:
        made |= {f"{k}_share{n}": (f"avg(is_{k}) {last(n)}", 9) for n in (5, 10)} | {f"{k}_share": (f"avg(is_{k}) {ever('horse')}", 7), f"{k}_jockey": (f"avg(is_{k}) {ever('jockey')}", 7), f"{k}_trainer": (f"avg(is_{k}) {ever('trainer')}", 7)}
        made[f"{k}_sire"] = (f"avg(is_{k}) OVER (PARTITION BY sire ORDER BY month RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING)", 7)
    total = " + ".join(f"sum(is_{k}) {last(5)}" for k in STYLE_IF)
    made["style_consistency"] = (f"greatest({', '.join(f'sum(is_{k}) {last(5)}' for k in STYLE_IF)}) / nullif({total}, 0)::DOUBLE", 9)
    return made


STYLE_COLUMNS = _styles()
STYLE_SQL = (
    ", a AS (SELECT *, date_trunc('month', race_date)::DATE AS month, " + ", ".join(f"CASE WHEN field_size > 1 THEN ({c} - 1) / (field_size - 1)::DOUBLE END AS c{i}" for i, c in enumerate(CORNERS, 1)) + f" FROM {RUNS}), b AS (SELECT *, " + ", ".join(f"coalesce({cond}, false)::INT AS is_{k}" for k, cond in STYLE_IF.items()) + " FROM a)"
    + ", m AS (SELECT race_id, horse, " + ", ".join(f"round({x} + 1e-12, {n}) AS {c}" for c, (x, n) in STYLE_COLUMNS.items()) + ", count(*) OVER h AS starts, (day - max(day) OVER h)::INT AS days_since FROM b WINDOW h AS (PARTITION BY horse ORDER BY day " + EVER + "))"
    + " SELECT *, " + ", ".join(f"rank() OVER (PARTITION BY race_id ORDER BY c{i}_avg5 NULLS LAST)::BIGINT AS c{i}_rank" for i in range(1, 5)) + " FROM m"
)


@query("l40_style_features", STYLE_SQL)
def l40(spark, d):
    df = L.style_features(runners(spark, d, "jockey", "trainer", "sire", "surface", "distance", "field_size", *(c for c in CORNERS if c != "finish")), CORNERS)
    return df.select(*KEY, *(F.round(F.col(c) + HAIR, n).alias(c) for c, (_, n) in STYLE_COLUMNS.items()), "starts", "days_since", *(f"c{i}_rank" for i in range(1, 5)))


@query("l41_field_style", "SELECT a.race_id, a.horse, count(*) FILTER (WHERE b.corner1 = 1) AS others_front, 2 * count(*) FILTER (WHERE b.corner1 = 1) + count(*) FILTER (WHERE b.corner1 BETWEEN 2 AND 3) AS pace_index, count(*) FILTER (WHERE b.corner1 BETWEEN 2 AND 3) AS others_stalk, count(b.horse) AS others, round(count(*) FILTER (WHERE b.corner1 = 1) / nullif(count(b.horse), 0)::DOUBLE, 9) AS front_share, round(count(*) FILTER (WHERE b.corner1 BETWEEN 2 AND 3) / nullif(count(b.horse), 0)::DOUBLE, 9) AS stalk_share, round(avg(b.corner1 / b.field_size::DOUBLE), 7) AS others_place, (a.corner1 = 1 AND count(*) FILTER (WHERE b.corner1 BETWEEN 2 AND 3) <= 1)::INT AS front_alone, min(b.corner1) AS others_first, max(b.corner1) AS others_last, count(*) FILTER (WHERE b.corner1 > 3 AND 3 * b.corner1 <= 2 * b.field_size) AS others_mid, count(*) FILTER (WHERE b.corner1 > 3 AND 3 * b.corner1 > 2 * b.field_size) AS others_rear, round(count(*) FILTER (WHERE b.corner1 > 3 AND 3 * b.corner1 <= 2 * b.field_size) / nullif(count(b.horse), 0)::DOUBLE, 9) AS mid_share, round(count(*) FILTER (WHERE b.corner1 > 3 AND 3 * b.corner1 > 2 * b.field_size) / nullif(count(b.horse), 0)::DOUBLE, 9) AS rear_share, round((a.corner1 - 1) / nullif(count(b.horse), 0)::DOUBLE, 9) AS ahead_share, a.corner1 - 1 AS gap_to_front, a.field_size - a.corner1 AS behind FROM e a LEFT JOIN e b ON a.race_id = b.race_id AND a.horse <> b.horse GROUP BY a.race_id, a.horse, a.corner1, a.field_size")
def l41(spark, d):
    return out(L.field_style(entries(spark, d)), "others_front", "pace_index", "others_stalk", "others", "front_share", "stalk_share", "others_place", "front_alone", "others_first", "others_last", "others_mid", "others_rear", "mid_share", "rear_share", "ahead_share", "gap_to_front", "behind", others_place=7)


@query("l42_abroad_card", select("(rank() OVER (PARTITION BY race_id ORDER BY age) + (count(*) OVER (PARTITION BY race_id, age) - 1) / 2.0)::DOUBLE AS age_rank", "round((1 / odds) / sum(1 / odds) OVER (PARTITION BY race_id), 9) AS implied_share", "rank() OVER (PARTITION BY race_id ORDER BY odds)::BIGINT AS odds_rank", "rank() OVER (PARTITION BY race_id ORDER BY body_weight DESC)::BIGINT AS body_weight_rank", "rank() OVER (PARTITION BY race_id ORDER BY carried DESC)::BIGINT AS carried_rank", "round(carried - avg(carried) OVER (PARTITION BY race_id), 9) AS carried_diff", "round(body_weight - avg(body_weight) OVER (PARTITION BY race_id), 9) AS body_weight_diff", "round(age - avg(age) OVER (PARTITION BY race_id), 7) AS age_diff", "round(horse_no / field_size::DOUBLE, 9) AS draw", "field_size", "round(ln(odds), 9) AS log_odds", "round(min(odds) OVER (PARTITION BY race_id), 9) AS favourite_odds", "round(max(odds) OVER (PARTITION BY race_id), 9) AS outsider_odds", "round((1 / odds) / sum(1 / odds) OVER (PARTITION BY race_id) - 1 / field_size::DOUBLE, 9) AS implied_edge", *(f"round(CASE WHEN stddev_pop({c}) OVER (PARTITION BY race_id) > 0 THEN ({c} - avg({c}) OVER (PARTITION BY race_id)) / stddev_pop({c}) OVER (PARTITION BY race_id) END + 1e-10, 4) AS {c}_z" for c in ("age", "carried", "body_weight", "odds"))))
def l42(spark, d):
    z = [f"{c}_z" for c in ("age", "carried", "body_weight", "odds")]
    return out(L.abroad_card(entries(spark, d)).withColumns({c: F.col(c) + 1e-10 for c in z}), *z, "outsider_odds", "implied_edge", "age_rank", "implied_share", "odds_rank", "body_weight_rank", "carried_rank", "carried_diff", "body_weight_diff", "age_diff", "draw", "field_size", "log_odds", "favourite_odds", age_diff=7, **dict.fromkeys(z, 4))


@query("l43_past_results", "SELECT t.horse, h.race_id, h.race_date, h.finish FROM (SELECT DISTINCT horse FROM e WHERE race_date = (SELECT max(race_date) FROM e)) t JOIN e h ON t.horse = h.horse AND h.race_date < (SELECT max(race_date) FROM e)")
def l43(spark, d):
    e = entries(spark, d)
    today = e.agg(F.max("day").alias("today"))
    marked = J.with_context(e, today)
    card = marked.where("day = today").select("horse").distinct()
    return J.focus(marked.where("day < today"), card, ["horse"]).select("horse", "race_id", "race_date", "finish")


@query("l44_training_table", "SELECT c_custkey AS horse, w.event_id FROM customer LEFT JOIN (SELECT user_id, event_id FROM events WHERE ts::DATE > DATE '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, ts, event_id) = 1) w ON c_custkey = w.user_id", base=False)
def l44(spark, d):
    """Fourteen days of workouts, one a day from the better source, and a row for horses without any."""
    ev = table(spark, d, "events").where("to_date(ts) > '2024-01-16'").select(F.col("user_id").alias("horse"), F.to_date("ts").alias("on"), "ts", "event_id", "value")
    one = J.dedupe_priority(ev, ["horse", "on"], [F.when(F.col("value") > 50, 0).otherwise(1), "ts", "event_id"]).select("horse", "event_id")
    horses = table(spark, d, "customer").select(F.col("c_custkey").alias("horse"))
    return J.with_placeholders(J.focus(one, horses, ["horse"]), horses, ["horse"])


FRAME, KILOS = "least(horse_no, 8)", "CASE WHEN body_weight < 410 THEN 0 WHEN body_weight < 430 THEN 1 ELSE 2 END"


@query("l45_heatmap", select(*(rate(w, f"{w}_rate") for w in ("jockey", "trainer", "owner", "sire", "damsire")), rate(f"jockey, {FRAME}", "jockey_frame_rate"), rate(FRAME, "frame_rate"), rate(KILOS, "weight_rate")))
def l45(spark, d):
    return out(L.heatmap(entries(spark, d)), "jockey_rate", "trainer_rate", "owner_rate", "sire_rate", "damsire_rate", "jockey_frame_rate", "frame_rate", "weight_rate")


@query("l46_horse_series", ", s AS (SELECT *, row_number() OVER (PARTITION BY horse ORDER BY day DESC, race_id DESC) = 1 AS upcoming, body_weight::INT AS kg, lag(body_weight::INT) OVER (PARTITION BY horse ORDER BY day, race_id) AS before FROM e) SELECT horse, count(*) AS points, string_agg(kg::VARCHAR, ',' ORDER BY day, race_id) AS weights, string_agg(coalesce((kg - before)::VARCHAR, ''), ',' ORDER BY day, race_id) AS deltas, string_agg(CASE WHEN upcoming THEN '' ELSE finish::VARCHAR END, ',' ORDER BY day, race_id) AS finishes, string_agg(CASE WHEN upcoming THEN '' ELSE round(time * 100)::INT::VARCHAR END, ',' ORDER BY day, race_id) AS centiseconds, string_agg((kg + round(carried)::INT)::VARCHAR, ',' ORDER BY day, race_id) AS combined FROM s GROUP BY horse")
def l46(spark, d):
    """A horse's series in order; its newest race stands for the upcoming one: a point with weights, without results."""
    w = W.partitionBy("horse").orderBy("day", "race_id")
    kg = F.col("body_weight").cast("int")
    s = entries(spark, d).withColumns({"kg": kg, "before": F.lag(kg).over(w), "upcoming": F.lead("race_id").over(w).isNull()})
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    point = F.struct("day", "race_id", text(F.col("kg")).alias("weights"), text(F.col("kg") - F.col("before")).alias("deltas"), text(F.when(~F.col("upcoming"), F.col("finish"))).alias("finishes"), text(F.when(~F.col("upcoming"), F.round(F.col("time") * 100).cast("int"))).alias("centiseconds"), text(F.col("kg") + F.round("carried").cast("int")).alias("combined"))
    t = s.groupBy("horse").agg(F.count("*").alias("points"), F.array_sort(F.collect_list(point)).alias("p"))
    joined = lambda c: F.array_join(F.transform("p", lambda x: x[c]), ",").alias(c)
    return t.select("horse", "points", *map(joined, ("weights", "deltas", "finishes", "centiseconds", "combined")))


POOL = ("time", "odds", "popularity", "corner1", "body_weight", "carried", "age", "horse_no", "last3f")
SHARES = {"favourite_won": "popularity = 1", "leader_won": "corner1 = 1", "inside_won": "horse_no = 1"}


@query("l29_similar_race", """, t AS (SELECT DISTINCT race_id AS key_id, venue, distance, class, surface, day FROM e),
w AS (SELECT * FROM e WHERE finish = 1),
c AS (SELECT t.key_id, count(*) FILTER (WHERE w.venue = t.venue AND w.class = t.class) AS n0, count(*) FILTER (WHERE w.venue = t.venue) AS n1, count(*) FILTER (WHERE w.surface = t.surface) AS n2 FROM t JOIN w ON w.distance = t.distance AND w.day < t.day AND w.day >= t.day - 1500 GROUP BY t.key_id),
l AS (SELECT t.*, CASE WHEN n0 >= 30 THEN 0 WHEN n1 >= 30 THEN 1 WHEN n2 >= 30 THEN 2 ELSE 3 END AS level FROM t LEFT JOIN c USING (key_id)),
p AS (SELECT l.key_id, level, w.* EXCLUDE (day), l.day - w.day AS back, exp(-0.001 * (l.day - w.day)) AS g, row_number() OVER (PARTITION BY key_id ORDER BY w.day DESC, w.race_id) AS rn FROM l LEFT JOIN w ON w.distance = l.distance AND w.day < l.day AND w.day >= l.day - 1500 AND CASE level WHEN 0 THEN w.venue = l.venue AND w.class = l.class WHEN 1 THEN w.venue = l.venue WHEN 2 THEN w.surface = l.surface ELSE true END)
SELECT key_id, level, count(race_id) AS matches, min(back)::INT AS days_since, round(avg(back) + 1e-9, 6) AS days_mean, """ + ", ".join(f"round(sum({c} * g) / sum(g), 8) AS {c}_mean" for c in POOL) + ", " + ", ".join(f"round(sum(({x})::INT * g) / sum(g), 8) AS {n}" for n, x in SHARES.items()) + """, round(stddev_pop(time) + 1e-9, 6) AS time_sd, round(stddev_pop(odds) + 1e-9, 6) AS odds_sd, round(CASE WHEN stddev_pop(odds) > 1e-6 AND stddev_pop(time) > 1e-6 THEN corr(time, odds) END, 4) AS time_odds FROM p WHERE rn <= 200 GROUP BY ALL""")
def l29(spark, d):
    """The pool of similar earlier races of every race (J16's levels and look-back), and what their winners were like: newer races weigh more."""
    e = cut(entries(spark, d).select("race_id", "venue", "class", "surface", "distance", "day", "finish", *POOL), "similar")
    targets = e.select(F.col("race_id").alias("key_id"), "venue", "distance", "class", "surface", "day").distinct()
    winners = e.where("finish = 1").select("race_id", "venue", "class", "surface", "distance", "day", *POOL)
    age = F.col("_day") - F.col("h_day")
    mean = lambda c: F.round(M.decay_mean(c, age), 8)
    stats = {"matches": F.count("h_race_id"), "days_since": F.min(age).cast("int"), "days_mean": F.round(F.avg(age) + 1e-9, 6)} | {f"{c}_mean": mean(F.col(f"h_{c}")) for c in POOL}
    stats |= {n: mean(F.expr(x.replace(x.split()[0], f"h_{x.split()[0]}")).cast("int")) for n, x in SHARES.items()} | {f"{c}_sd": F.round(F.stddev_pop(f"h_{c}") + 1e-9, 6) for c in ("time", "odds")}
    stats["time_odds"] = F.round(F.when((F.stddev_pop("h_odds") > 1e-6) & (F.stddev_pop("h_time") > 1e-6), F.corr("h_time", "h_odds")), 4)
    told = J.fallback_stats(targets, winners, [["venue", "distance", "class"], ["venue", "distance"], ["distance", "surface"], ["distance"]], stats, ties=["race_id"], look_back=1500)
    return told.withColumn("matches", F.coalesce("matches", F.lit(0)))
