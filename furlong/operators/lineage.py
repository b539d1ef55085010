"""Lineage of races (L21): which races a rule table makes trials of which targets, and what a runner did in them before a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins as J


def classify(races: DataFrame, targets: DataFrame, name: str = "name") -> DataFrame:
    """race_id, target of the races that a target rule fits: its name (equals, or contains), and venue and distance where the rule has them. Of several the rule with the smallest priority, then name."""
    fits = J.rule_match(races, targets.withColumnsRenamed({"venue": "_venue", "distance": "_distance"}), name)
    fits = fits.where((F.col("_venue").isNull() | (F.col("_venue") == F.col("venue"))) & (F.col("_distance").isNull() | (F.col("_distance") == F.col("distance"))))
    return fits.groupBy("race_id").agg(F.min(F.struct("priority", "target")).alias("m")).select("race_id", "m.target")


def trial_record(runners: DataFrame, targets: DataFrame, trials: DataFrame, name: str = "name") -> DataFrame:
    """Each runner with its race's target, and its record in that target's trials on earlier days, no farther back than the trial's own look-back.

    runners: race_id, horse, day, finish, margin, venue, distance and the race's name. targets: target, priority, equals, contains, venue, distance (null: any).
    trials: target, equals, contains, look_back. Adds target, trial_count, trial_wins, trial_top3, trial_best (finish), trial_margin (mean over the first two
    places). A race that several rules make a trial counts for each. A run falls into one period of its rule's look-back, and a target asks for two of
    them: an equi-join on horse, target, look-back and period, so that a horse with many runs is dealt out over its periods.
    """
    races = runners.select("race_id", name, "venue", "distance").distinct()
    serves = J.rule_match(races, trials, name).select("race_id", "target", "look_back")
    period = lambda day: F.floor(F.col(day) / F.col("look_back"))
    keys = ["horse", "target", "look_back", "period"]
    runs = runners.select("race_id", "horse", F.col("day").alias("h_day"), "finish", "margin").where("finish is not null and horse is not null").join(serves, "race_id").withColumn("period", period("h_day")).drop("race_id")
    of = classify(races, targets, name)
    asked = runners.select("race_id", "horse", "day").join(of, "race_id").join(J.small(trials.select("target", "look_back").distinct()), "target")
    asked = asked.withColumn("period", F.explode(F.array(period("day") - 1, period("day"))))
    met = asked.join(runs, keys).where((F.col("h_day") < F.col("day")) & (F.col("day") - F.col("h_day") <= F.col("look_back")))
    f = F.col("finish")
    record = met.groupBy("race_id", "horse").agg(F.count("*").alias("trial_count"), F.count_if(f == 1).alias("trial_wins"), F.count_if(f <= 3).alias("trial_top3"), F.min(f).alias("trial_best"), F.avg(F.when(f <= 2, F.col("margin"))).alias("trial_margin"))
    rows = runners.join(of, "race_id", "left").join(record, ["race_id", "horse"], "left")
    return rows.fillna(0, ["trial_count", "trial_wins", "trial_top3"])
