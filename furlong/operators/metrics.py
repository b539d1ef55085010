"""Aggregates: rates, slopes, decayed and shrunk means, race metrics, confusion counts, bucket evaluation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rate(hit: Column, cond: Column | None = None) -> Column:
    """Share of hits among the rows with the condition (A1)."""
    one = hit.cast("int")
    return F.avg(one if cond is None else F.when(cond, one))


def safe_corr(x: str, y: str) -> Column:
    """Correlation from sums; null where either side is constant."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    both = a.isNotNull() & b.isNotNull()
    a, b, n = F.when(both, a), F.when(both, b), F.count_if(both)
    spread = (n * F.sum(a * a) - F.pow(F.sum(a), 2)) * (n * F.sum(b * b) - F.pow(F.sum(b), 2))
    return F.try_divide(n * F.sum(a * b) - F.sum(a) * F.sum(b), F.when(spread > 0, F.sqrt(spread)))


def slope(y: Column, x: Column, least: int = 3) -> Column:
    """Regression slope of y on x from at least `least` pairs, else null."""
    return F.when(F.count_if(y.isNotNull() & x.isNotNull()) >= least, F.regr_slope(y, x))


def decay_mean(v: Column, days: Column, k: float = 0.001) -> Column:
    """Mean with weights exp(-k days)."""
    weight = F.when(v.isNotNull(), F.exp(-k * days))
    return F.try_divide(F.sum(v * weight), F.sum(weight))


def decay_variance(v: Column, days: Column, k: float = 0.001) -> Column:
    """Variance around that mean, with the same weights."""
    return decay_mean(v * v, days, k) - F.pow(decay_mean(v, days, k), 2)


def context_weight(days: Column, decay: float, distance: Column, current: Column, band: float, scale: float, least: float, surface: Column, here: Column, track: Column, same_track: Column) -> Column:
    """Hyperbolic decay by days, times nearness in distance, times likeness of track (A10)."""
    near = F.when(distance.isNull() | current.isNull(), 0.75).otherwise(F.greatest(F.lit(least), 1 - F.abs(distance - current) / F.greatest(current * scale, F.lit(band))))
    like = F.when(surface.isNull() | here.isNull(), 0.85).when(track == same_track, 1.2).when(surface == here, 1.0).otherwise(0.55)
    return 1 / (1 + days / decay) * near * like


def eb_rate(wins: Column, n: Column, prior: Column, k: float) -> Column:
    """Rate drawn to a prior worth k starts."""
    return (wins + k * prior) / (n + k)


def guard(value: Column, n: Column, least: int = 5) -> Column:
    return F.when(n >= least, value)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Lower and upper end of the Wilson interval."""
    p = F.try_divide(hits.cast("double"), n)
    centre, spread, scale = p + z * z / (2 * n), z * F.sqrt((p * (1 - p) + z * z / (4 * n)) / n), 1 + z * z / n
    return (centre - spread) / scale, (centre + spread) / scale


def finish_counts(df: DataFrame, by: Sequence[str], finish: str = "finish") -> DataFrame:
    """starts, wins, places (2 best), shows (3 best) by group (A3). A finish of 0 is a start without result."""
    f = F.col(finish)
    return df.groupBy(*by).agg(F.count("*").alias("starts"), F.count_if(f == 1).alias("wins"), F.count_if(f.between(1, 2)).alias("places"), F.count_if(f.between(1, 3)).alias("shows"))


def race_hits(df: DataFrame, by: Sequence[str] = ("race_id",), rank: str = "predicted_rank", finish: str = "finish") -> DataFrame:
    """Per race: top1, rank2_exact, rank3_exact, top3_box, top3_exact, top1_in2, capture3, capture5.

    rank4_exact to rank6_exact are null where the field is smaller than that, so that they leave the denominator.
    """
    r, f = F.col(rank), F.col(finish)
    exact = lambda k: F.max(F.when(r == k, (f == k).cast("int")))
    best = F.count_if((r <= 3) & (f <= 3))
    return df.groupBy(*by).agg(
        F.count("*").alias("field"), exact(1).alias("top1"), exact(2).alias("rank2_exact"), exact(3).alias("rank3_exact"), exact(4).alias("rank4_exact"), exact(5).alias("rank5_exact"), exact(6).alias("rank6_exact"),
        F.max(F.when(r == 1, (f <= 2).cast("int"))).alias("top1_in2"), (best == 3).cast("int").alias("top3_box"), (F.count_if((r <= 3) & (f == r)) == 3).cast("int").alias("top3_exact"), (best >= 2).cast("int").alias("two_of_three"),
        F.max(F.when(f == 1, (r <= 3).cast("int"))).alias("capture3"), F.max(F.when(f == 1, (r <= 5).cast("int"))).alias("capture5"),
    )


def ndcg3_fixed(rank: Column, finish: Column) -> Column:
    """nDCG@3 with gains 4 - finish, natural discounts and one ideal for all races."""
    ideal = 3 / math.log(3) + 2 / math.log(4) + 1 / math.log(5)
    return F.sum(F.when(rank <= 3, F.greatest(F.lit(0), 4 - finish) / F.log(2 + rank)).otherwise(0.0)) / ideal


def ndcg3_ideal(df: DataFrame, by: Sequence[str] = ("race_id",), rank: str = "predicted_rank", finish: str = "finish") -> DataFrame:
    """nDCG@3 with relevance 3, 2, 1 for the first three, binary discounts and each race's own ideal."""
    gain = F.greatest(F.lit(0), 4 - F.col(finish)).cast("double")
    place = F.row_number().over(W.partitionBy(*by).orderBy(F.desc(gain)))
    rows = df.withColumns({"_g": gain, "_i": place})
    got = F.sum(F.when(F.col(rank) <= 3, F.col("_g") / F.log2(F.col(rank) + 1)))
    ideal = F.sum(F.when(F.col("_i") <= 3, F.col("_g") / F.log2(F.col("_i") + 1)))
    return rows.groupBy(*by).agg(F.try_divide(got, ideal).alias("ndcg3"))


def unpivot_dims(df: DataFrame, dims: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per dimension: dimension, bucket (as text), and the columns of keep."""
    return df.select(*keep, F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("bucket")) for d in dims))).alias("_d")).select("_d.dimension", "_d.bucket", *keep)


def confusion(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = (), chance: str | None = None, near: str | None = None) -> DataFrame:
    """Counts by actual and predicted class; with the actual class's chance also sums of log-loss, with a flag of near hits their number (A19). All are additive."""
    more = ([F.sum(-F.log(F.greatest(F.col(chance), F.lit(1e-15)))).alias("log_loss")] if chance else []) + ([F.count_if(F.col(near)).alias("near")] if near else [])
    return df.groupBy(*by, actual, predicted).agg(F.count("*").alias("n"), *more)


def class_averages(counts: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Macro averages of precision, recall and F1, and F1 weighted by how often a class is actual."""
    m = class_metrics(counts, actual, predicted).join(counts.groupBy(F.col(actual).alias("class")).agg(F.sum("n").alias("w")), "class", "left").fillna(0, ["w"])
    mean = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return m.agg(mean("precision").alias("macro_precision"), mean("recall").alias("macro_recall"), mean("f1").alias("macro_f1"), F.try_divide(F.sum(F.coalesce("f1", F.lit(0.0)) * F.col("w")), F.sum("w")).alias("weighted_f1"))


def class_metrics(counts: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 of each class of a confusion table."""
    rows = counts.select(F.col(actual).alias("class"), F.col("n").alias("as_actual"), F.lit(0).alias("as_predicted"), F.when(F.col(actual) == F.col(predicted), F.col("n")).otherwise(0).alias("right"))
    rows = rows.unionByName(counts.select(F.col(predicted).alias("class"), F.lit(0).alias("as_actual"), F.col("n").alias("as_predicted"), F.lit(0).alias("right")))
    t = rows.groupBy("class").agg(*(F.sum(c).alias(c) for c in ("as_actual", "as_predicted", "right")))
    p, r = F.try_divide(F.col("right"), F.col("as_predicted")), F.try_divide(F.col("right"), F.col("as_actual"))
    return t.select("class", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))


def quadratic_kappa(counts: DataFrame, actual: str, predicted: str) -> Column:
    """Weighted agreement beyond chance of a confusion table with classes 0, 1, ... as an aggregate (A20): from first and second moments."""
    a, b, n = F.col(actual).cast("double"), F.col(predicted).cast("double"), F.col("n")
    total = F.sum(n)
    seen = F.sum(n * (a - b) * (a - b)) / total
    expected = F.sum(n * a * a) / total + F.sum(n * b * b) / total - 2 * F.sum(n * a) / total * F.sum(n * b) / total
    return 1 - F.try_divide(seen, expected)


def bucket_tiers(df: DataFrame, tiers: Sequence[Sequence[str]], sums: Sequence[str], wanted: DataFrame, least: int, n: str) -> DataFrame:
    """For each wanted bucket the sums of the finest tier with at least `least` of n."""
    out = wanted
    for i, tier in enumerate(tiers):
        summed = df.groupBy(*tier).agg(*(F.sum(s).alias(f"_{i}_{s}") for s in sums)) if tier else df.agg(*(F.sum(s).alias(f"_{i}_{s}") for s in sums))
        out = out.join(summed, list(tier), "left") if tier else out.crossJoin(F.broadcast(summed))
    ok = [F.col(f"_{i}_{n}") >= least for i in range(len(tiers))]
    pick = lambda s: F.coalesce(*(F.when(o, F.col(f"_{i}_{s}")) for i, o in enumerate(ok)))
    return out.select(*wanted.columns, F.coalesce(*(F.when(o, F.lit(i)) for i, o in enumerate(ok))).alias("tier"), *(pick(s).alias(s) for s in sums))


def bootstrap_bound(df: DataFrame, delta: str, key: str, replicates: int = 200, quantile: float = 0.025) -> DataFrame:
    """Lower bound of the mean delta over Poisson resamples (A25): each row's weight in each replicate comes from a hash of its key, so a lost task draws the same again; replicates are added up map-side."""
    u = (F.pmod(F.xxhash64(F.col(key), F.col("replicate")), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    steps, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        steps.append(total)
        p /= k + 1
    weight = sum(((u > s).cast("int") for s in steps), F.lit(0))
    sums = df.select(key, delta, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).groupBy("replicate").agg(F.try_divide(F.sum(weight * F.col(delta)), F.sum(weight)).alias("mean"))
    return sums.agg(F.percentile("mean", F.lit(quantile)).alias("lower"), F.avg("mean").alias("mean"))


def percentiles(df: DataFrame, by: Sequence[str], **wanted: tuple[str, float]) -> DataFrame:
    """by, and name=(column, share) for each: exact percentiles, linear between neighbours (A4, A30), of groups of any size.

    Rows become counts of equal values first (combined before they are shuffled). The values of a group, those of all columns one after another, are then walked in
    order with a running count: sorts and windows spill, and no buffer grows with a group, as that of an exact percentile aggregate does. From the running
    count the two neighbours of each share's place are picked. Nulls and NaN do not count; a group without values has nulls; a null group is one.
    """
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    value = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("_c"), value(c).alias("_v")) for i, c in enumerate(columns))))
    counts = df.select(*by, each.alias("_x")).select(*by, "_x.*").groupBy(*by, "_c", "_v").agg(F.count("_v").alias("_n"))
    order = W.partitionBy(*by, "_c").orderBy(F.asc_nulls_last("_v"))
    placed = counts.withColumns({"_upto": F.sum("_n").over(order), "_all": F.sum("_n").over(W.partitionBy(*by, "_c"))})
    picks, out = [], []
    for name, (column, share) in wanted.items():
        i, at = columns.index(column), (F.col("_all") - 1) * share
        here = (F.col("_c") == i) & F.col("_v").isNotNull()
        picks += [F.min(F.when(here & (F.col("_upto") > F.floor(at)), F.col("_v"))).alias(f"_a_{name}"), F.min(F.when(here & (F.col("_upto") > F.ceil(at)), F.col("_v"))).alias(f"_b_{name}"), F.max(F.when(here, at - F.floor(at))).alias(f"_f_{name}")]
        out.append((F.col(f"_a_{name}") + F.col(f"_f_{name}") * (F.col(f"_b_{name}") - F.col(f"_a_{name}"))).alias(name))
    return placed.groupBy(*by).agg(*picks).select(*by, *out)


def trend(df: DataFrame, options: Sequence[Sequence[str]], finish: str, market: str, order: Sequence[str] = ("day", "race_id")) -> DataFrame:
    """Starts, win rate, median market place of the placed and the newest race by each choice of dimensions (A33). The row's other dimensions
    are null and `option` numbers the choice. A finish of 0 has no result yet: it counts as a start, never in a rate."""
    dims = list(dict.fromkeys(c for o in options for c in o))
    rows = df.withColumn("option", F.explode(F.array(*(F.lit(i) for i in range(len(options))))))
    rows = rows.withColumns({f"_{c}": F.when(F.col("option").isin([i for i, o in enumerate(options) if c in o]), F.col(c)) for c in dims})
    f = F.col(finish)
    t = rows.groupBy("option", *(f"_{c}" for c in dims)).agg(
        F.count("*").alias("starts"), F.count_if(f > 0).alias("ranked"), rate(f == 1, f > 0).alias("win_rate"), F.percentile(F.when(f.between(1, 3), F.col(market)), F.lit(0.5)).alias("market_median"), F.max(F.struct(*order)).alias("_newest")
    )
    return t.withColumnsRenamed({f"_{c}": c for c in dims}).withColumn("newest", F.col("_newest")[order[-1]]).drop("_newest")


def trend_details(df: DataFrame, options: Sequence[Sequence[str]], details: Sequence[str], order: Sequence[str] = ("day", "race_id")) -> DataFrame:
    """The runs that each trend of A33 is made of, newest first: option, its dimensions (the others null), place (1: newest) and the details. Rows, not a list, so that a trend of any length is whole."""
    dims = list(dict.fromkeys(c for o in options for c in o))
    rows = df.select(F.explode(F.array(*(F.lit(i) for i in range(len(options))))).alias("option"), *(F.col(c).alias(f"_{c}") for c in dims), *details, *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)))
    rows = rows.withColumns({f"_{c}": F.when(F.col("option").isin([i for i, o in enumerate(options) if c in o]), F.col(f"_{c}")) for c in dims})
    w = W.partitionBy("option", *(f"_{c}" for c in dims)).orderBy(*(F.desc(f"_o{i}") for i in range(len(order))), *details)
    rows = rows.withColumn("place", F.row_number().over(w).cast("long")).drop(*(f"_o{i}" for i in range(len(order))))
    return rows.select("option", *(F.col(f"_{c}").alias(c if c not in details else f"by_{c}") for c in dims), "place", *details)


def trend_score(df: DataFrame, conditions: Sequence[str], score: str) -> DataFrame:
    """Sum of a run's score times ln(1 + n) per condition and its value (A35): condition, id, score."""
    rows = unpivot_dims(df, conditions, [score])
    return rows.groupBy(F.col("dimension").alias("condition"), F.col("bucket").alias("id")).agg((F.sum(score) * F.log(1 + F.count("*"))).alias("score"))


def payout_eval(plans: DataFrame, results: DataFrame, by: Sequence[str], stake: int = 100) -> DataFrame:
    """plans: race_id, picks (combinations, texts of 4 digits). results: race_id, by, packed (winning combination and 8 digits of payout).
    Per group: races, bets, races whose winner was covered, coverage, return rate (A45). A race without a plan has no bets."""
    j = results.join(plans, "race_id", "left").withColumns({"_won": F.coalesce(F.array_contains("picks", F.substring("packed", 1, 4)), F.lit(False)), "_paid": F.substring("packed", 5, 8).cast("long"), "_n": F.coalesce(F.size("picks"), F.lit(0))})
    t = j.groupBy(*by).agg(F.count("*").alias("races"), F.sum("_n").alias("bets"), F.count_if("_won").alias("covered"), F.sum(F.when(F.col("_won"), F.col("_paid")).otherwise(0)).alias("paid"))
    return t.withColumns({"coverage": F.col("covered") / F.col("races"), "return_rate": F.try_divide("paid", F.col("bets") * stake)})


def form_summary(df: DataFrame, who: Sequence[str]) -> DataFrame:
    """Starts, wins, rates, best finish, mean odds and last day of each entity."""
    f = F.col("finish")
    return df.groupBy(*who).agg(F.count("*").alias("starts"), F.count_if(f == 1).alias("wins"), rate(f == 1).alias("win_rate"), rate(f <= 3).alias("show_rate"), F.min("finish").alias("best_finish"), F.avg("odds").alias("odds_mean"), F.max("day").alias("last_day"))


def drift(df: DataFrame, metric: str, trained_to: int, year: str = "race_year", most: float = 0.02) -> DataFrame:
    """Mean of the metric by year, its change, whether the model was trained on the year, and whether such a year is better than the mean of the others by more than `most`: a leak."""
    by = df.groupBy(year).agg(F.avg(metric).alias("rate"))
    trained = F.col(year) <= trained_to
    return by.withColumns({"change": F.col("rate") - F.lag("rate").over(W.orderBy(year)), "trained": trained, "leak": F.coalesce(trained & (F.col("rate") - F.avg(F.when(~trained, F.col("rate"))).over(W.partitionBy(F.lit(0))) > most), F.lit(False))})
