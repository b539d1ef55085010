"""Values relative to the other runners of a race: ranks, differences, shares, leave-one-out sums, softmax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RACE = ("race_id",)


def race(*by: str):
    return W.partitionBy(*(by or RACE))


def rank_in_race(df: DataFrame, cols: dict[str, bool], by: Sequence[str] = RACE) -> DataFrame:
    """<col>_rank for each column; True: largest first. Nulls last, ties share a rank (W2, and J22: no peer join)."""
    one = lambda c, down: F.desc_nulls_last(c) if down else F.asc_nulls_last(c)
    return df.withColumns({f"{c}_rank": F.rank().over(race(*by).orderBy(one(c, down))).cast("long") for c, down in cols.items()})


def avg_rank(df: DataFrame, col: str, name: str, down: bool = False, by: Sequence[str] = RACE) -> DataFrame:
    """Rank with ties at their mean: rank + (ties - 1) / 2."""
    order = F.desc_nulls_last(col) if down else F.asc_nulls_last(col)
    return df.withColumn(name, F.rank().over(race(*by).orderBy(order)) + (F.count("*").over(race(*by, col)) - 1) / 2)


def relative(df: DataFrame, cols: Sequence[str], sample: bool = True, by: Sequence[str] = RACE) -> DataFrame:
    """<col>_diff from the group's mean, and <col>_z by sample or population deviation; null if that is 0."""
    w, sd = race(*by), F.stddev_samp if sample else F.stddev_pop
    out = {}
    for c in cols:
        out[f"{c}_diff"] = F.col(c) - F.avg(c).over(w)
        out[f"{c}_z"] = F.try_divide(F.col(c) - F.avg(c).over(w), sd(c).over(w))
    return df.withColumns(out)


def share(df: DataFrame, col: str, name: str, by: Sequence[str] = RACE) -> DataFrame:
    """Part of the group's total."""
    return df.withColumn(name, F.try_divide(F.col(col), F.sum(col).over(race(*by))))


def others(df: DataFrame, col: str, by: Sequence[str] = RACE) -> DataFrame:
    """<col>_others_sum, _mean, _min, _max over the group's other rows (W9); for min and max the two smallest and largest values of the group suffice."""
    w = race(*by)
    n, total = F.count(col).over(w), F.sum(col).over(w)
    own = F.when(F.col(col).isNotNull(), 1).otherwise(0)
    least, most = F.row_number().over(w.orderBy(F.asc_nulls_last(col))), F.row_number().over(w.orderBy(F.desc_nulls_last(col)))
    df = df.withColumns({"_n": n - own, "_t": total - F.coalesce(F.col(col), F.lit(0)), "_lo": least, "_hi": most})
    pick = lambda r, k: F.max(F.when(F.col(r) == k, F.col(col))).over(w)
    return df.withColumns({
        f"{col}_others_sum": F.when(F.col("_n") > 0, F.col("_t")), f"{col}_others_mean": F.when(F.col("_n") > 0, F.col("_t") / F.col("_n")),
        f"{col}_others_min": F.when(F.col("_lo") == 1, pick("_lo", 2)).otherwise(pick("_lo", 1)), f"{col}_others_max": F.when(F.col("_hi") == 1, pick("_hi", 2)).otherwise(pick("_hi", 1)),
    }).drop("_n", "_t", "_lo", "_hi")


def ordinal(df: DataFrame, score: str, name: str = "predicted_rank", by: Sequence[str] = RACE, tie: str = "horse") -> DataFrame:
    """1, 2, ... by score, largest first, then by id."""
    return df.withColumn(name, F.row_number().over(race(*by).orderBy(F.desc_nulls_last(score), tie)).cast("long"))


def rank_norm(df: DataFrame, score: str, name: str, by: Sequence[str] = RACE, tie: str = "horse") -> DataFrame:
    """(n - rank) / (n - 1): 1 for the best, 0 for the last, 0.5 alone."""
    n = F.count("*").over(race(*by))
    place = F.row_number().over(race(*by).orderBy(F.desc_nulls_last(score), tie))
    return df.withColumn(name, F.when(n > 1, (n - place) / F.greatest(n - 1, F.lit(1))).otherwise(0.5))


def minmax(df: DataFrame, col: str, name: str, tie: float = 0.5, by: Sequence[str] = RACE) -> DataFrame:
    """0 to 1 over the group; `tie` where all are equal."""
    lo, hi = F.min(col).over(race(*by)), F.max(col).over(race(*by))
    return df.withColumn(name, F.when(hi > lo, F.try_divide(F.col(col) - lo, hi - lo)).when(F.col(col).isNotNull(), tie))


def softmax(df: DataFrame, score: Column, name: str, temperature: float = 0.65, floor: float = 0.001, by: Sequence[str] = RACE) -> DataFrame:
    """exp(score / temperature) over the group's sum, with a least value before the last division."""
    w = race(*by)
    df = df.withColumn("_z", score / temperature)
    df = df.withColumn("_x", F.greatest(F.exp(F.col("_z") - F.max("_z").over(w)), F.lit(floor)))
    return df.withColumn(name, F.col("_x") / F.sum("_x").over(w)).drop("_z", "_x")


def favourite_gap(df: DataFrame, odds: str = "odds", by: Sequence[str] = RACE, tie: str = "horse") -> DataFrame:
    """favourite_gap: lowest odds of the race over the second lowest."""
    w = race(*by)
    df = df.withColumn("_r", F.row_number().over(w.orderBy(F.asc_nulls_last(odds), tie)))
    first, second = (F.max(F.when(F.col("_r") == k, F.col(odds))).over(w) for k in (1, 2))
    return df.withColumn("favourite_gap", F.try_divide(first, second)).drop("_r")


def field_strength(df: DataFrame, score: str, by: Sequence[str] = RACE, tie: str = "horse", top: int = 3) -> DataFrame:
    """field_mean and top_mean: means of the score over the race and over its best `top`."""
    w = race(*by)
    df = df.withColumn("_r", F.row_number().over(w.orderBy(F.desc_nulls_last(score), tie)))
    return df.withColumns({"field_mean": F.avg(score).over(w), "top_mean": F.avg(F.when(F.col("_r") <= top, F.col(score))).over(w)}).drop("_r")


def streak(df: DataFrame, hit: Column, entity: Sequence[str], order: Sequence[str] = ("day", "race_id"), name: str = "streak") -> DataFrame:
    """How many rows in a row, ending with the one before, have hit (W12): rows since the last miss."""
    w = W.partitionBy(*entity).orderBy(*order)
    past = w.rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_at", F.row_number().over(w))
    missed = F.max(F.when(~hit, F.col("_at"))).over(past)
    return df.withColumn(name, (F.col("_at") - 1 - F.coalesce(missed, F.lit(0))).cast("long")).drop("_at")


def streak_capped(df: DataFrame, hit: Column, entity: Sequence[str], n: int = 5, order: Sequence[str] = ("day", "race_id"), name: str = "streak") -> DataFrame:
    """The streak as the last n rows show it, so never more than n (W12): the newest miss among them ends it."""
    w = W.partitionBy(*entity).orderBy(*order)
    df = df.withColumn("_hit", hit)
    missed = [F.when(~F.lag("_hit", k).over(w), k - 1) for k in range(1, n + 1)]
    known = F.count("*").over(w.rowsBetween(-n, -1))
    return df.withColumn(name, F.coalesce(*missed, known).cast("long")).drop("_hit")
