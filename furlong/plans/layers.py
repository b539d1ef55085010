"""Feature layers: each takes the runner table and returns it with more columns.

A layer sees its runners and their history in one table. What concerns history is a window over strictly
earlier days, partitioned by the entity and by whatever must equal the target's value, so a layer costs one shuffle per
distinct partitioning; values within the race are windows over the race. Layers chain lazily.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import history as H
from ..operators import joins as J
from ..operators import metrics as M
from ..operators import relative as R


#: Distances are multiples of this many metres.
STEP = 100


def win() -> Column:
    return (F.col("finish") == 1).cast("int")


def show() -> Column:
    return (F.col("finish") <= 3).cast("int")


def prior_rates(df: DataFrame, cells: dict[str, Sequence[str]], hit: Column | None = None) -> DataFrame:
    """<name>: the hit rate of each cell (entity and equal context) over earlier days. For cells of one entity that has few rows; others go by cube."""
    hit = win() if hit is None else hit
    return df.withColumns({name: F.avg(hit).over(H.before(*cell)) for name, cell in cells.items()})


def skeleton(df: DataFrame) -> DataFrame:
    """L1: category and label."""
    category = F.when(F.col("venue") == 8, "draught").when(F.col("venue") < 10, "national").otherwise("local")
    return df.withColumns({"category": category, "finish_norm": S.norm_position("finish", "field_size")})


def career(df: DataFrame) -> DataFrame:
    """L2: a horse's career: rates overall, by venue, surface and class; nearby distances; speed; days since; runs in 30 days."""
    w = H.before("horse")
    df = prior_rates(df, {"career_win_rate": ["horse"], "venue_win_rate": ["horse", "venue"], "surface_win_rate": ["horse", "surface"], "class_win_rate": ["horse", "class"]})
    df = df.withColumns({"career_place_rate": F.avg((F.col("finish") <= 2).cast("int")).over(w), "career_show_rate": F.avg(show()).over(w), "starts": F.count("*").over(w), "wins": F.count_if(F.col("finish") == 1).over(w), "starts_90d": F.count("*").over(H.last_days("horse", days=90)), "best_time_distance": F.min("time").over(H.before("horse", "distance")), "starts_with_jockey": F.count("*").over(H.before("horse", "jockey"))})
    df = df.withColumns({"starts_30d": F.count("*").over(H.last_days("horse", days=30)), "days_since": F.col("day") - F.max("day").over(w)})
    df = H.last_before(df, ["horse"], speed_avg5=(5, F.avg("time")), speed_best5=(5, F.min("time")), best_finish5=(5, F.min("finish")), odds_avg5=(5, F.avg("odds")))
    return near_distance(df)


def near_distance(df: DataFrame) -> DataFrame:
    """distance_win_rate: the win rate of a horse's earlier runs within 200 m of today's distance.

    Distances are multiples of STEP, so a run counts for a few of them. Only keys and hits are laid out for each, and summed by day before the window.
    """
    near = F.explode(F.array(*(F.col("distance") + x for x in range(-200, 201, STEP))))
    daily = df.select("horse", "day", near.alias("distance"), win().alias("_w")).groupBy("horse", "distance", "day").agg(F.count("*").alias("_n"), F.sum("_w").alias("_w"))
    at = H.before("horse", "distance")
    past = daily.select("horse", "distance", "day", F.try_divide(F.sum("_w").over(at), F.sum("_n").over(at)).alias("distance_win_rate"))
    return df.join(past, ["horse", "distance", "day"], "left")


def jockey_trainer(df: DataFrame) -> DataFrame:
    """L3: rates of the jockey (13 columns) and of the trainer (7): overall, 60 days, venue, distance, surface, class, season, pairs."""
    df = df.withColumn("_season", S.season("race_date"))
    context = {"venue": "venue", "distance": "distance", "surface": "surface", "class": "class", "season": "_season"}
    cells = {f"{who}_{name}": H.Cell((who, c), "win") for who in ("jockey", "trainer") for name, c in context.items()}
    cells |= {f"{who}_win_rate": H.Cell((who,), "win") for who in ("jockey", "trainer")} | {f"{who}_60d": H.Cell((who,), "win", days=60) for who in ("jockey", "trainer")}
    cells |= {"pair_win_rate": H.Cell(("jockey", "horse"), "win"), "jockey_with_trainer": H.Cell(("jockey", "trainer"), "win"), "jockey_with_owner": H.Cell(("jockey", "owner"), "win")}
    cells |= {"jockey_show_rate": H.Cell(("jockey",), "show"), "jockey_starts": H.Cell(("jockey",), "win", "count"), "jockey_wins": H.Cell(("jockey",), "win", "sum")}
    return H.cube(df, {"win": win(), "show": show()}, cells).drop("_season")


def pedigree(df: DataFrame, least: int = 5) -> DataFrame:
    """L4: sire and damsire by 400 m band and by surface, from `least` starts; their mean over three."""
    df = df.withColumn("_band", F.floor(F.col("distance") / 400))
    by = {"sire_band": ("sire", "_band"), "sire_surface": ("sire", "surface"), "damsire_band": ("damsire", "_band")}
    df = H.cube(df, {"win": win()}, {name: H.Cell(cell, "win", least=least - 1) for name, cell in by.items()})
    return df.withColumn("pedigree", (F.coalesce("sire_band", F.lit(0.0)) + F.coalesce("sire_surface", F.lit(0.0)) + F.coalesce("damsire_band", F.lit(0.0))) / 3).drop("_band")


def track_bias(df: DataFrame) -> DataFrame:
    """Shares of inside and of front winners at the venue in the last 5 days; 0 without history."""
    inside = (F.col("finish") == 1) & (2 * F.col("horse_no") <= F.col("field_size") + 1)
    front = (F.col("finish") == 1) & (F.coalesce(S.norm_position("corner1", "field_size"), F.lit(0.0)) <= 0.33)
    df = H.cube(df, {"inside": inside.cast("int"), "front": front.cast("int")}, {f"{k}_bias": H.Cell(("venue",), k, days=5) for k in ("inside", "front")})
    return df.fillna(0.0, ["inside_bias", "front_bias"])


def weight(df: DataFrame) -> DataFrame:
    """Body weight against the last five of earlier days: mean, difference, slope by age of the run (newest last), spread, clamped z."""
    kg, n = F.col("body_weight"), F.col("_n")
    df = df.withColumn("_n", F.row_number().over(W.partitionBy("horse").orderBy("day", "race_id")))
    df = H.last_before(df, ["horse"], weight_avg5=(5, F.avg(kg)), weight_volatility=(5, F.stddev_pop(kg)), _runs=(5, F.count("*")), _slope=(5, F.regr_slope(kg, n)))
    df = df.withColumns({"weight_diff": kg - F.col("weight_avg5"), "weight_slope": F.when(F.col("_runs") >= 2, F.col("_slope"))})
    return df.withColumn("weight_z", F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("weight_diff") / F.greatest(F.col("weight_volatility"), F.lit(1.0))))).drop("_n", "_runs", "_slope")


def recent_form(df: DataFrame) -> DataFrame:
    """The last run of an earlier day, changes of class and distance since, mean of 3, slope over 5 by recency (1 = newest; from 3 runs)."""
    level, one = F.substring("class", 1, 1).cast("int"), lambda c: (1, F.max(c))
    df = df.withColumn("_n", F.row_number().over(W.partitionBy("horse").orderBy("day", "race_id")))
    df = H.last_before(df, ["horse"], last_finish=one("finish"), _distance=one("distance"), _level=one(level), finish_avg3=(3, F.avg("finish")), _runs=(5, F.count("*")), _slope=(5, F.regr_slope(F.col("finish"), F.col("_n"))))
    df = df.withColumns({"distance_diff": F.col("distance") - F.col("_distance"), "class_diff": level - F.col("_level"), "form_slope": F.when(F.col("_runs") >= 3, -F.col("_slope"))})
    return df.drop("_n", "_distance", "_level", "_runs", "_slope")


def race_context(df: DataFrame) -> DataFrame:
    """Strength of the field, rivals with a better prior rate, size over 18, graded flag."""
    df = prior_rates(df, {"_rate": ["horse"]})
    df = R.field_strength(df, "_rate")
    rivals = F.rank().over(R.race().orderBy(F.desc_nulls_last("_rate"))) - 1
    return df.withColumns({"rivals": rivals.cast("long"), "field_ratio": F.col("field_size") / 18, "graded": (F.substring("class", 1, 1).cast("int") <= 3).cast("int")}).drop("_rate")


def class_velocity(df: DataFrame) -> DataFrame:
    """Days since the last earlier win at the class level or one below it."""
    level = F.substring("class", 1, 1).cast("int")
    w = H.before("horse")
    at = {k: F.max(F.when((F.col("finish") == 1) & (level >= k), F.col("day"))).over(w) for k in range(0, 6)}
    best = F.coalesce(*(F.when(level - 1 == k, v) for k, v in at.items()))
    return df.withColumn("class_velocity", F.col("day") - best)


def class_variance(df: DataFrame) -> DataFrame:
    """Spread of the class over the last five runs of earlier days."""
    return H.last_before(df, ["horse"], class_variance=(5, F.stddev_pop(F.substring("class", 1, 1).cast("int"))))


def trainer_flat(df: DataFrame) -> DataFrame:
    """A trainer's rate in ungraded races."""
    return H.cube(df, {"flat": F.when(F.substring("class", 1, 1).cast("int") > 3, win())}, {"trainer_flat": H.Cell(("trainer",), "flat")})


def weather(df: DataFrame, hourly: DataFrame, stale: int = 6) -> DataFrame:
    """Weather (kind), going (the reading between 0 and 100, as a share) and hours_old of the newest hourly row (venue, hour, reading, kind) of the venue that is not after the start (starts), unless it is more than `stale` hours old.

    One window by venue and day over both tables, and none before the stalest hour: rows go by periods of a day, and a row counts for the period after its own too, so that a venue's whole history is never one task.
    """
    if stale > 24:
        raise ValueError("a row counts for its own day and the next: stale is 24 at most")
    period = lambda c: F.floor(F.unix_timestamp(c) / 86400)
    right = hourly.where("venue is not null").withColumn("_period", F.explode(F.array(period("hour"), period("hour") + 1))).select("venue", "_period", F.col("hour").alias("starts"), F.struct("hour", "reading", "kind").alias("_m"))
    races = df.select("race_id", "venue", "starts").distinct().withColumn("_period", period("starts"))
    found = H.asof_join(races, right, ["venue", "_period"], "starts", ["_m"], strict=False)
    old = F.timestamp_diff("HOUR", F.col("_m.hour"), F.col("starts"))
    fresh = (F.unix_timestamp("starts") - F.unix_timestamp("_m.hour")) <= stale * 3600
    found = found.select("race_id", F.when(fresh, F.col("_m")).alias("_m"), F.when(fresh, old).alias("hours_old"))
    rows = df.join(found, "race_id", "left")
    return rows.withColumns({"weather": F.col("_m.kind"), "going": F.when(F.col("_m.reading").isNotNull(), F.least(F.greatest(F.col("_m.reading"), F.lit(0.0)), F.lit(100.0)) / 100)}).drop("_m")


def course(df: DataFrame, courses: DataFrame, keys: Sequence[str] = ("venue",)) -> DataFrame:
    """The constants of the course, by a lookup table whose keys are one of rows. Its size is checked before it is broadcast."""
    return df.join(J.small(courses), list(keys), "left")


def physics(df: DataFrame) -> DataFrame:
    """Carried over body weight, ranks and the joint z."""
    df = df.withColumn("carry_ratio", F.col("carried") / F.col("body_weight"))
    df = R.relative(R.rank_in_race(df, {"carry_ratio": False, "body_weight": True}), ["carried", "body_weight"])
    return df.withColumn("joint_z", F.col("carried_z") - F.col("body_weight_z"))


def history_speed(df: DataFrame) -> DataFrame:
    """Speed over the last five runs of earlier days, scaled by weight, carry and age, and its spread."""
    speed = F.col("distance") / F.col("time")
    df = H.last_before(df, ["horse"], speed5=(5, F.avg(speed)), speed_volatility=(5, F.stddev_pop(speed)))
    return df.withColumns({"speed_weight": F.col("speed5") * F.col("body_weight") / 450, "speed_carry": F.col("speed5") * F.col("carried") / 55, "speed_age": F.col("speed5") / F.col("age")})


def race_internal(df: DataFrame) -> DataFrame:
    """Ranks and differences in the race, and how many would lead."""
    df = R.relative(R.rank_in_race(df, {"odds": False, "carried": True}), ["odds", "carried"])
    return df.withColumn("pace_pressure", F.sum((F.col("corner1") <= 2).cast("int")).over(R.race()) / F.col("field_size"))


def market(df: DataFrame) -> DataFrame:
    """Implied probability, its share, ranks, disagreement with form."""
    df = R.share(df.withColumn("implied", 1 / F.col("odds")), "implied", "implied_share")
    df = R.relative(R.rank_in_race(df.withColumn("form", F.avg("finish").over(H.last_rows("horse", n=3))), {"implied": True, "form": False}), ["implied"])
    return df.withColumns({"disagreement": F.col("implied_rank") - F.when(F.col("form").isNotNull(), F.col("form_rank")), "overround": F.sum("implied").over(R.race())})


def sectional_weight(df: DataFrame) -> DataFrame:
    """Last-three-furlong means of 3 and 5 runs of earlier days, slope, and the last weight."""
    df = df.withColumn("_n", F.row_number().over(W.partitionBy("horse").orderBy("day", "race_id")))
    df = H.last_before(df, ["horse"], last3f_avg3=(3, F.avg("last3f")), last3f_avg5=(5, F.avg("last3f")), _runs=(5, F.count("*")), _slope=(5, F.regr_slope(F.col("last3f"), F.col("_n"))), last_weight=(1, F.max("body_weight")))
    return df.withColumn("last3f_slope", F.when(F.col("_runs") >= 3, F.col("_slope"))).drop("_n", "_runs", "_slope")


def carried_weight(df: DataFrame, heavy: float = 54.0) -> DataFrame:
    """Mean carried weight of this run and the four before it, the share of runs at `heavy` or more among this and the nine before, rank and difference in the race.

    By rows, as the carried weight of a day's runs is known before they are run: an earlier run of the same day counts.
    """
    rows = W.partitionBy("horse").orderBy("day", "race_id")
    df = df.withColumns({"carried_avg5": F.avg("carried").over(rows.rowsBetween(-4, 0)), "carried_heavy10": F.avg((F.col("carried") >= heavy).cast("int")).over(rows.rowsBetween(-9, 0))})
    return R.relative(R.rank_in_race(df, {"carried": True}), ["carried"])


def near_miss(df: DataFrame) -> DataFrame:
    """Second-place rates of horse, jockey and ancestors, last-five seconds, margins to the winner, favourite gap. The last five go by rows."""
    second = (F.col("finish") == 2).cast("int")
    by = {"jockey_second": ("jockey",), "second_rate": ("horse",), "sire_second": ("sire",), "damsire_second": ("damsire",), "sire_surface_second": ("sire", "surface")}
    # what concerns the race first, as runners come by race, and what concerns the horse last, so that each entity is one shuffle
    df = R.favourite_gap(df.withColumn("_m", F.col("time") - F.max(F.when(F.col("finish") == 1, F.col("time"))).over(R.race())))
    df = H.cube(df, {"second": second}, {name: H.Cell(cell, "second") for name, cell in by.items()})
    return H.last_n(df, ["horse"], 5, seconds5=F.sum(second), margin5=F.avg("_m"), margin_best5=F.min(F.abs("_m")), second_margin5=F.avg(F.when(F.col("finish") == 2, F.col("_m")))).drop("_m")


def draught_class(df: DataFrame) -> DataFrame:
    """Rates by bucket of carried weight (times ten, in kg)."""
    kg = F.col("carried") * 10
    df = df.withColumn("_b", F.when(kg < 500, 0).when(kg < 550, 1).when(kg < 600, 2).otherwise(3))
    return H.cube(df, {"win": win()}, {"bucket_rate": H.Cell(("horse", "_b"), "win"), "bucket_rate_all": H.Cell(("_b",), "win")}).drop("_b")


def draught_grade(df: DataFrame) -> DataFrame:
    """Earlier starts and wins by grade, and starts at a higher grade than today's."""
    w, level = H.before("horse"), F.substring("class", 1, 1).cast("int")
    df = df.withColumns({f"starts_g{g}": F.count_if(level == g).over(w) for g in (1, 2, 3)} | {f"wins_g{g}": F.count_if((level == g) & (F.col("finish") == 1)).over(w) for g in (1, 2, 3)})
    higher = F.when(level == 2, F.col("starts_g1")).when(level == 3, F.col("starts_g1") + F.col("starts_g2")).when(level > 3, F.col("starts_g1") + F.col("starts_g2") + F.col("starts_g3")).otherwise(0)
    return df.withColumn("higher_starts", higher)


def draught_internal(df: DataFrame, cols: Sequence[str] = ("odds", "carried", "body_weight", "age", "last3f")) -> DataFrame:
    """Rank, difference and z of every column in the race."""
    return R.relative(R.rank_in_race(df, dict.fromkeys(cols, True)), cols, sample=False)


def cells(df: DataFrame, prior: float = 0.0707) -> DataFrame:
    """Four cells (jockey by sire and band, by damsire, by venue; sire by band): starts, wins, a rate shrunk to the jockey's own
    (the sire's to the prior), and its average-tie rank in the race. Earlier races count, those of the same day included."""
    df = base = df.withColumn("_band", S.band("distance", "pedigree"))
    ahead = lambda *cell: W.partitionBy(*cell).orderBy(H.race_number()).rangeBetween(W.unboundedPreceding, -1)
    keys = {"own": ["jockey"], "cell": ["jockey", "sire", "_band"], "pair": ["jockey", "damsire"], "local": ["jockey", "venue"]}
    for name, by in keys.items():
        df = df.withColumns({f"{name}_n": F.count("*").over(ahead(*by)), f"{name}_w": F.count_if(F.col("finish") == 1).over(ahead(*by))})
    line = H.race_order(base, ["sire", "_band"], ["day", "race_id"], line_n=F.count("*"), line_w=F.sum(win()))
    # a runner without a sire keeps its row, and has no line
    df = df.join(line, ["sire", "_band", "day", "race_id"], "left")
    own = M.eb_rate(F.col("own_w"), F.col("own_n"), F.lit(prior), 30)
    df = df.withColumn("own_rate", own)
    for name, base in {"cell": own, "pair": own, "local": own, "line": F.lit(prior)}.items():
        df = df.withColumn(f"{name}_rate", M.eb_rate(F.col(f"{name}_w"), F.col(f"{name}_n"), base, 20)).withColumn("_r", F.round(f"{name}_rate", 8))
        df = R.avg_rank(df, "_r", f"{name}_rank", down=True).drop("_r")
    return df.drop("_band")


def fade(df: DataFrame) -> DataFrame:
    """Of horse, jockey, trainer and owner: starts, shares of unplaced runs ever, in 60 and in 365 days; the last five (by rows) of the horse."""
    lost, cells = (F.col("finish") > 3).cast("int"), {}
    for who in ("jockey", "trainer", "owner", "horse"):
        cells |= {f"{who}_fade": H.Cell((who,), "lost"), f"{who}_starts": H.Cell((who,), "lost", "count")} | {f"{who}_fade_{n}d": H.Cell((who,), "lost", days=n) for n in (60, 365)}
    return H.last_n(H.cube(df, {"lost": lost}, cells), ["horse"], 5, fade5=F.avg(lost))


def fade_extra(df: DataFrame) -> DataFrame:
    """Last 3 and 10 runs, the running streak, 30 days, the pair with the jockey."""
    lost = (F.col("finish") > 3).cast("int")
    df = H.last_n(H.last_n(df, ["horse"], 3, fade3=F.avg(lost)), ["horse"], 10, fade10=F.avg(lost))
    df = R.streak(df, F.col("finish") > 3, ["horse"], name="fade_streak")
    return prior_rates(H.within_days(df, ["horse"], 30, fade_30d=F.avg(lost)), {"pair_fade": ["horse", "jockey"]}, lost)


def locality(df: DataFrame) -> DataFrame:
    """Share of earlier starts at today's venue, and how many venues there were."""
    w = H.before("horse")
    return df.withColumns({"venue_share": F.try_divide(F.count("*").over(H.before("horse", "venue")), F.nullif(F.count("*").over(w), F.lit(0))), "venues": F.size(F.collect_set("venue").over(w)).cast("long")})


def going_pedigree(df: DataFrame) -> DataFrame:
    """For sire and damsire: starts, win and show rate on today's going, and how far the win rate is from that on all goings."""
    df = df.withColumn("going_code", (F.col("day") % 3).cast("int"))
    cells = {}
    for role in ("sire", "damsire"):
        on = (role, "going_code")
        cells |= {f"{role}_going": H.Cell(on, "win"), f"{role}_going_show": H.Cell(on, "show"), f"{role}_going_n": H.Cell(on, "win", "count"), f"_{role}": H.Cell((role,), "win")}
    df = H.cube(df, {"win": win(), "show": show()}, cells)
    return df.withColumns({f"{role}_going_edge": F.col(f"{role}_going") - F.col(f"_{role}") for role in ("sire", "damsire")}).drop("_sire", "_damsire")


def trainer_affinity(df: DataFrame) -> DataFrame:
    """A trainer's rate in today's class, and in this distance at this venue."""
    return H.cube(df, {"win": win()}, {"trainer_class": H.Cell(("trainer", "class"), "win"), "trainer_target": H.Cell(("trainer", "venue", "distance"), "win")})


def sire_venue(df: DataFrame) -> DataFrame:
    """L30."""
    return H.cube(df, {"win": win()}, {"sire_venue_rate": H.Cell(("sire", "venue", "surface", "distance"), "win", least=3)})


def jockey_triple(df: DataFrame) -> DataFrame:
    """L35."""
    return H.cube(df.withColumn("_band", S.band("distance", "cells")), {"win": win()}, {"jockey_triple": H.Cell(("jockey", "venue", "_band", "surface"), "win")}).drop("_band")


def going_sectional(df: DataFrame) -> DataFrame:
    """Inside the last five runs of earlier days, not over all runs, the mean last three furlongs on firm and on soft going."""
    firm = F.col("day") % 3 > 0
    return H.last_before(df, ["horse"], firm3f=(5, F.avg(F.when(firm, F.col("last3f")))), soft3f=(5, F.avg(F.when(~firm, F.col("last3f")))))


def field_style(df: DataFrame) -> DataFrame:
    """Front runners, stalkers, middle and rear among the others, their shares, the pace index 2 * front + stalkers, and where the runner is among them."""
    at = F.col("corner1")
    kinds = {"front": at == 1, "stalk": at.between(2, 3), "mid": (at > 3) & (3 * at <= 2 * F.col("field_size")), "rear": (at > 3) & (3 * at > 2 * F.col("field_size"))}
    w, others = R.race(), F.col("field_size") - 1
    df = df.withColumns({f"others_{k}": F.count_if(c).over(w) - c.cast("int") for k, c in kinds.items()})
    df = df.withColumns({f"{k}_share": F.try_divide(F.col(f"others_{k}"), others) for k in kinds})
    place = at / F.col("field_size")
    df = df.withColumns({"pace_index": 2 * F.col("others_front") + F.col("others_stalk"), "others": others, "others_place": F.try_divide(F.sum(place).over(w) - place, others), "front_alone": ((at == 1) & (F.col("others_stalk") <= 1)).cast("int")})
    places = F.sort_array(F.collect_list("corner1").over(w))
    df = df.withColumns({"others_first": F.when(at == places[0], F.try_element_at(places, F.lit(2))).otherwise(places[0]), "others_last": F.when(at == F.element_at(places, -1), F.try_element_at(places, F.lit(-2))).otherwise(F.element_at(places, -1))})
    df = df.withColumn("others_last", F.when(others > 0, F.col("others_last")))
    return df.withColumns({"gap_to_front": at - 1, "behind": F.col("field_size") - at, "ahead_share": F.try_divide(at - 1, others)})


def abroad_card(df: DataFrame) -> DataFrame:
    """Average-tie ranks, market share, z: nothing about who runs."""
    df = R.share(df.withColumn("implied", 1 / F.col("odds")), "implied", "implied_share")
    df = R.rank_in_race(R.avg_rank(df, "age", "age_rank"), {"odds": False, "body_weight": True, "carried": True})
    df = R.relative(df, ["carried", "body_weight", "age", "odds"], sample=False)
    race = R.race()
    return df.withColumns({"draw": F.col("horse_no") / F.col("field_size"), "log_odds": F.log("odds"), "favourite_odds": F.min("odds").over(race), "outsider_odds": F.max("odds").over(race), "implied_edge": F.col("implied_share") - 1 / F.col("field_size")})


STYLES = ("front", "near", "mid", "rear")


def style_features(df: DataFrame, corners: Sequence[str] = ("corner1",)) -> DataFrame:
    """For each corner, normalised places over the last 3, 5 and 10 runs of earlier days (mean, best, worst, spread), the quartile range over 5, ever, on this
    surface, at this distance, of the jockey, the last place and the rank of the mean in the race; shares of the four styles (by the first corner)
    over 5 and 10 runs, ever, of the jockey, the trainer and (over earlier months) the sire; consistency, starts, days since."""
    places = {f"c{i}": S.norm_position(c, "field_size") for i, c in enumerate(corners, 1)}
    df = df.withColumns({f"_{k}": v for k, v in places.items()})
    # ranks need the race: they come first, from rows that are narrow; all wide columns come last, where rows lie by horse
    df = H.last_before(df, ["horse"], **{f"_{k}_avg5": (5, F.avg(f"_{k}")) for k in places})
    df = R.rank_in_race(df.withColumns({f"_{k}_avg5": F.round(f"_{k}_avg5", 9) for k in places}), {f"_{k}_avg5": False for k in places})
    df = df.withColumnsRenamed({f"_{k}_avg5_rank": f"{k}_rank" for k in places}).drop(*(f"_{k}_avg5" for k in places))
    first = F.col(corners[0])
    kinds = dict(zip(STYLES, (first == 1, (first > 1) & (F.col("_c1") <= 0.3), (F.col("_c1") > 0.3) & (F.col("_c1") <= 0.7), F.col("_c1") > 0.7)))
    kinds = {k: F.coalesce(v, F.lit(False)).cast("int") for k, v in kinds.items()}
    cells = {}
    for k in places:
        cells |= {f"{k}_{name}": H.Cell(by, k) for name, by in {"jockey": ("jockey",), "ever": ("horse",), "surface": ("horse", "surface"), "distance": ("horse", "distance")}.items()}
    for k in kinds:
        cells |= {f"{k}_jockey": H.Cell(("jockey",), k), f"{k}_share": H.Cell(("horse",), k), f"{k}_trainer": H.Cell(("trainer",), k), f"{k}_sire": H.Cell(("sire",), k, monthly=True)}
    cells |= {"starts": H.Cell(("horse",), "one", "count")}
    df = H.cube(df, {"one": F.lit(1)} | {k: F.col(f"_{k}") for k in places} | kinds, cells)
    last = {}
    for k in places:
        c = F.col(f"_{k}")
        for n in (3, 5, 10):
            last |= {f"{k}_avg{n}": (n, F.avg(c)), f"{k}_best{n}": (n, F.min(c)), f"{k}_worst{n}": (n, F.max(c)), f"{k}_sd{n}": (n, F.stddev_pop(c))}
        last |= {f"_{k}_five": (5, F.collect_list(c)), f"{k}_last": (1, F.max(c))}
    for k, hit in kinds.items():
        last |= {f"{k}_share{n}": (n, F.avg(hit)) for n in (5, 10)} | {f"_{k}_sum": (5, F.sum(hit))}
    df = H.last_before(df, ["horse"], **last)
    five = {k: F.sort_array(f"_{k}_five") for k in places}
    df = df.withColumns({f"{k}_iqr5": H.quartile(five[k], 0.75) - H.quartile(five[k], 0.25) for k in places})
    sums = [F.col(f"_{k}_sum") for k in kinds]
    df = df.withColumn("style_consistency", F.try_divide(F.greatest(*sums), F.nullif(sum(sums[1:], sums[0]), F.lit(0))))
    df = df.withColumn("days_since", F.col("day") - F.max("day").over(H.before("horse")))
    return df.drop(*(f"_{k}{x}" for k in places for x in ("", "_five")), *(f"_{k}_sum" for k in kinds))


def heatmap(df: DataFrame) -> DataFrame:
    """A row per runner with the earlier win rate of each of its entities: people, ancestors, frame, weight class."""
    kinds = {"frame": F.least(F.col("horse_no"), F.lit(8)), "weight": S.weight_class("body_weight", {"light": 410, "middle": 430}, "heavy")}
    df = df.withColumns({f"_{k}": c for k, c in kinds.items()})
    by = {f"{who}_rate": (who,) for who in ("jockey", "trainer", "owner", "sire", "damsire")} | {"jockey_frame_rate": ("jockey", "_frame")} | {f"{k}_rate": (f"_{k}",) for k in kinds}
    return H.cube(df, {"win": win()}, {name: H.Cell(cell, "win") for name, cell in by.items()}).drop(*(f"_{k}" for k in kinds))


def pace_style(df: DataFrame, share: str = "q") -> DataFrame:
    """Per race and model version, what the shares of style say: entropy, effective number, largest, second, gap, spread, those above the mean, the favourite's and the leader's."""
    q, race = F.col(share), W.partitionBy("race_id", "version")
    df = df.withColumns({"_k": F.row_number().over(race.orderBy(F.desc(share), "horse")), "_n": F.count("*").over(race)})
    at = lambda cond: F.max(F.when(cond, q))
    t = df.groupBy("race_id", "version").agg(
        F.count("*").alias("runners"), F.sum(S.entropy(share)).alias("style_entropy"), F.max(q).alias("style_max"), F.min(q).alias("style_min"), at(F.col("_k") == 2).alias("style_second"), F.stddev_pop(q).alias("style_sd"),
        F.sum(F.when(F.col("_k") <= 3, q)).alias("style_top3"), F.count_if(q > 1 / F.col("_n") + 1e-9).alias("above_mean"), at(F.col("popularity") == 1).alias("favourite_share"), at(F.col("corner1") == 1).alias("leader_share"),
    )
    return t.withColumns({"style_effective": F.exp("style_entropy"), "style_gap": F.col("style_max") - F.col("style_second"), "style_spread": F.col("style_max") - F.col("style_min")})
