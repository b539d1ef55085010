"""Models over runner tables: ensembles, calibration, walk-forward, weights, routing, imputation, tree scoring."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import joins as J
from . import relative as R


def fit_isotonic(df: DataFrame, bucket: str, score: str, label: str, points: int = 50_000, fan_in: int = 16) -> DataFrame:
    """Isotonic calibration per bucket, and for all rows under a null bucket (M2): bucket, xs, ys.

    Rows of one score are one point. Points are dealt into ranges of score by quantiles of a sample, about `points` to a range however the
    scores are spread, and each range pools adjacent violators in order, row by row: only the blocks that are left are held. Ranges are then brought together, `fan_in`
    at a time, until one is left; pooling parts first changes nothing in the result. Each round is written. The last group holds the blocks of
    one curve, which is as long as the curve itself. Rows without a score or a label do not count.
    """
    from ..sources.tables import cut

    own = df.select(F.col(bucket).cast("string").alias("bucket"), F.col(score).cast("double").alias("x"), F.col(label).cast("double").alias("y")).where("x is not null and not isnan(x) and y is not null")
    whole = own.withColumn("bucket", F.lit(None).cast("string"))
    blocks = own.unionByName(whole).groupBy("bucket", "x").agg(F.sum("y").alias("y"), F.count("*").cast("double").alias("n"))
    blocks = cut(blocks.select("bucket", F.col("x").alias("first"), F.col("x").alias("last"), "n", "y"), "isotonic")
    parts = -(-blocks.count() // points)
    while parts > 1:
        blocks = cut(blocks.repartitionByRange(parts, "bucket", "first").sortWithinPartitions("bucket", "first").mapInArrow(_pooled, blocks.schema), "isotonic")
        parts = parts // fan_in

    def curve(group):
        import pandas as pd

        rows = list(_pool(group.sort_values("first")[["first", "last", "n", "y"]].itertuples(index=False)))
        return pd.DataFrame({"bucket": [group["bucket"].iloc[0]], "xs": [[v for b in rows for v in b[:2]]], "ys": [[b[3] / b[2] for b in rows for _ in (0, 1)]]})

    return blocks.groupBy("bucket").applyInPandas(curve, "bucket string, xs array<double>, ys array<double>")


def _pool(rows):
    """Blocks [first, last, rows, sum of labels] of rows in order, adjacent violators pooled."""
    blocks: list[list[float]] = []
    for row in rows:
        blocks.append(list(row))
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            right, left = blocks.pop(), blocks[-1]
            left[1:] = right[1], left[2] + right[2], left[3] + right[3]
    return blocks


def _pooled(batches):
    """Blocks of each bucket of a partition that is in order; a batch at a time."""
    import pyarrow as pa

    names = ["bucket", "first", "last", "n", "y"]

    def table(bucket, blocks):
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(blocks), pa.string()), *(pa.array([b[i] for b in blocks], pa.float64()) for i in range(4))], names)

    held: tuple | None = None
    for batch in batches:
        rows = batch.to_pydict()
        for bucket, *row in zip(*(rows[c] for c in names)):
            if held and held[0] == bucket:
                blocks = held[1]
                blocks.append(row)
                blocks[-2:] = _pool(blocks[-2:])
                while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
                    blocks[-2:] = _pool(blocks[-2:])
            else:
                if held:
                    yield table(*held)
                held = (bucket, [row])
    if held:
        yield table(*held)


def brier(df: DataFrame, scores: Sequence[str], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean squared error of each score against a 0/1 label (M2)."""
    return df.groupBy(*by).agg(*(F.avg(F.pow(F.col(s) - F.col(label).cast("double"), 2)).alias(f"brier_{s}") for s in scores))


def most_stable(trials: DataFrame, metric: str, trial: str = "trial", worst: float = 0.5) -> DataFrame:
    """Of a metric by trial and year: mean, spread, and the rank of each trial by mean less `worst` spreads; 1 is the most stable good one (M6)."""
    t = trials.groupBy(trial).agg(F.avg(metric).alias("mean"), F.stddev_pop(metric).alias("spread"), F.min(metric).alias("least"))
    t = t.withColumn("stable", F.col("mean") - worst * F.col("spread"))
    return t.withColumn("place", F.row_number().over(W.orderBy(F.desc(F.round("stable", 9)), trial)).cast("long"))  # as many rows as trials


def apply_isotonic(df: DataFrame, curves: DataFrame, bucket: str, score: str, name: str = "calibrated", renormalise: bool = True) -> DataFrame:
    """The curve of the row's bucket, else the one for all, linear between knots; renormalised in the race and ranked (M3), or as the curve gives it."""
    whole = curves.where("bucket is null").select(F.col("xs").alias("_wx"), F.col("ys").alias("_wy"))
    own = curves.where("bucket is not null").withColumnRenamed("bucket", "_bucket")
    rows = J.with_context(df.withColumn("_bucket", F.col(bucket).cast("string")).join(own, "_bucket", "left"), whole)
    xs, ys, s = F.coalesce("xs", "_wx"), F.coalesce("ys", "_wy"), F.col(score)
    k = F.size(F.filter(xs, lambda x: x <= s))
    x0, x1, y0, y1 = F.get(xs, k - 1), F.get(xs, k), F.get(ys, k - 1), F.get(ys, k)
    value = F.when(k == 0, ys[0]).when(k >= F.size(xs), F.element_at(ys, -1)).otherwise(y0 + F.coalesce(F.try_divide(s - x0, x1 - x0), F.lit(0.0)) * (y1 - y0))
    rows = rows.withColumn("_v", value)
    if not renormalise:
        return rows.withColumn(name, F.col("_v")).drop("_v", "_bucket", "xs", "ys", "_wx", "_wy")
    return R.ordinal(rows.withColumn(name, F.try_divide(F.col("_v"), F.sum("_v").over(R.race()))), name).drop("_v", "_bucket", "xs", "ys", "_wx", "_wy")


def blend(df: DataFrame, weights: dict[str, float], name: str = "blended") -> DataFrame:
    """Weighted sum of each model's in-race rank score (M4), and its rank."""
    for s in weights:
        df = R.rank_norm(df, s, f"_{s}")
    df = df.withColumn(name, sum((F.col(f"_{s}") * w for s, w in weights.items()), F.lit(0.0)))
    return R.ordinal(df.drop(*(f"_{s}" for s in weights)), name, f"{name}_rank")


def average_ensemble(preds: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Mean of several models' rows of one key (M5), of probabilities or of ranks."""
    return preds.groupBy(*keys).agg(*(F.avg(v).alias(v) for v in values))


def search_weights(df: DataFrame, scores: Sequence[str], step: float, year: str = "race_year") -> DataFrame:
    """Top-1 rate by year of every weighting on the simplex grid (M6): the grid is a bounded list of columns beside each runner, and races are summed per weighting."""
    n = round(1 / step)
    grid = [w for w in product(range(n + 1), repeat=len(scores)) if sum(w) == n]
    for s in scores:
        df = R.rank_norm(df, s, f"_{s}")
    value = lambda w: sum((F.col(f"_{s}") * (k / n) for s, k in zip(scores, w)), F.lit(0.0))
    rows = df.select("race_id", year, "horse", "finish", F.posexplode(F.array(*(value(w) for w in grid))).alias("trial", "v"))
    picked = rows.groupBy("trial", "race_id", year).agg(F.max(F.struct("v", (-F.col("horse")).alias("h"), "finish")).alias("m"))
    return picked.groupBy("trial", year).agg(F.avg((F.col("m.finish") == 1).cast("int")).alias("top1"), F.count("*").alias("races"))


def opinion_pool(df: DataFrame, weights: dict[str, float], name: str = "pooled") -> DataFrame:
    """exp of the weighted mean log probability, normalised in the race (M7)."""
    df = df.withColumn("_v", F.exp(sum((w * F.log(F.col(c)) for c, w in weights.items()), F.lit(0.0))))
    return df.withColumn(name, F.try_divide(F.col("_v"), F.sum("_v").over(R.race()))).drop("_v")


def walk_forward(df: DataFrame, years: Sequence[int], fit_score, year: str = "race_year") -> DataFrame:
    """Each fold year scored by fit_score(train, test) with train = the years before (M8)."""
    return J.union_all([fit_score(df.where(F.col(year) < y), df.where(F.col(year) == y)).withColumn("fold", F.lit(y)) for y in years])


def fit_linear_folds(df: DataFrame, features: Sequence[str], label: str, year: str = "race_year", ridge: float = 0.0) -> dict[int, list[float]]:
    """Least squares for each year but the first, from the rows of all years before it (M8): year -> intercept, then a weight a feature.

    One pass: sums of products by year, as many numbers as features squared; sums of earlier years add up to those of a fold. Rows with a null
    among features and label do not train. ridge is added to the diagonal, but for the intercept; where the sums leave weights open, the shortest are taken.
    """
    import numpy as np

    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y = F.col(label).cast("double")
    whole = df.dropna(subset=[*features, label]).where(F.col(year).isNotNull())
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    sums = whole.groupBy(year).agg(*(F.sum(x[i] * x[j]).alias(f"xx{i}_{j}") for i, j in pairs), *(F.sum(c * y).alias(f"xy{i}") for i, c in enumerate(x)))
    xx, xy, out = np.zeros((len(x), len(x))), np.zeros(len(x)), {}
    for k, row in enumerate(sorted(sums.collect(), key=lambda r: r[year])):
        if k:
            out[row[year]] = np.linalg.lstsq(xx + ridge * np.diag([0.0] + [1.0] * len(features)), xy, rcond=None)[0].tolist()
        for i, j in pairs:
            xx[i, j] += row[f"xx{i}_{j}"]
            xx[j, i] = xx[i, j]
        xy += [row[f"xy{i}"] for i in range(len(x))]
    return out


def fit_logistic_folds(df: DataFrame, features: Sequence[str], label: str, year: str = "race_year", ridge: float = 1e-6, rounds: int = 25, tolerance: float = 1e-9) -> dict[int, list[float]]:
    """Logistic regression for each year but the first, from the rows of all years before it (M8): year -> intercept, then a weight a feature.

    Newton's rounds for all folds at once. The columns needed are written once; in each round every task adds up, for the folds that a row is of (those after
    its year), gradient and curvature, Spark adds the tasks' sums, and the driver solves as many small systems as there are folds. Features are
    scaled by their mean and spread over all rows. Rows with a null among features and label do not train.
    """
    import numpy as np

    from ..sources.tables import cut

    whole = cut(df.dropna(subset=[*features, label]).where(F.col(year).isNotNull()).select(F.col(year).cast("int").alias("year"), F.col(label).cast("double").alias("y"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features))), "folds")
    years = sorted(r.year for r in whole.select("year").distinct().collect())
    if len(years) < 2:
        return {}
    stats = whole.agg(*(x for i in range(len(features)) for x in (F.avg(f"x{i}"), F.stddev_pop(f"x{i}")))).first()
    mean, spread = np.array(stats[0::2], float), np.array([v if v and v > 0 else 1.0 for v in stats[1::2]])
    p = len(features) + 1
    weights = {y: np.zeros(p) for y in years[1:]}
    open_years = list(weights)
    for _ in range(rounds):
        given = {y: weights[y] for y in open_years}

        def add(batches, given=given):
            import numpy as np
            import pyarrow as pa

            sums = {y: np.zeros(p + p * p) for y in given}
            for batch in batches:
                year, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                x = np.column_stack([np.ones(len(y)), *((batch.column(2 + i).to_numpy() - mean[i]) / spread[i] for i in range(p - 1))])
                for fold, w in given.items():
                    of = year < fold
                    if of.any():
                        q = 1 / (1 + np.exp(-(x[of] @ w)))
                        sums[fold] += np.concatenate([x[of].T @ (y[of] - q), ((x[of] * (q * (1 - q))[:, None]).T @ x[of]).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["fold", "sums"])

        total: dict[int, dict[int, float]] = {}
        for r in whole.mapInArrow(add, "fold int, sums array<double>").select("fold", F.posexplode("sums")).groupBy("fold", "pos").agg(F.sum("col").alias("s")).collect():
            total.setdefault(r.fold, {})[r.pos] = r.s
        moved = []
        for fold in open_years:
            v = np.array([total[fold][i] for i in range(p + p * p)])
            penalty = ridge * np.array([0.0] + [1.0] * (p - 1))
            step = np.linalg.lstsq(v[p:].reshape(p, p) + np.diag(penalty), v[:p] - penalty * weights[fold], rcond=None)[0]
            weights[fold] = weights[fold] + np.clip(step, -5, 5)
            if np.abs(step).max() > tolerance:
                moved.append(fold)
        open_years = moved
        if not open_years:
            break
    return {y: [float(w[0] - (w[1:] * mean / spread).sum()), *(w[1:] / spread).tolist()] for y, w in weights.items()}


def score_folds(df: DataFrame, weights: dict[int, list[float]], features: Sequence[str], year: str = "race_year", name: str = "score", logistic: bool = False) -> DataFrame:
    """Rows of the years that have weights, with their score by those; null where a feature is. As many weight rows as years are broadcast."""
    table = df.sparkSession.createDataFrame([(int(y), [float(v) for v in w]) for y, w in weights.items()], f"`{year}` int, _w array<double>")
    rows = df.join(F.broadcast(table), year)
    value = sum((F.col("_w")[i + 1] * F.col(c) for i, c in enumerate(features)), F.col("_w")[0])
    return rows.withColumn(name, 1 / (1 + F.exp(-value)) if logistic else value).drop("_w")


def sample_weights(df: DataFrame, weak: Column, alpha: float, year: str = "race_year") -> DataFrame:
    """0.5 to 1 by year, times 1 + alpha for weak buckets, within 0.5 and 1.75 (M9)."""
    ends = df.agg(F.min(year).alias("_lo"), F.max(year).alias("_hi"))
    rows = J.with_context(df, ends)
    by_year = 0.5 + 0.5 * F.coalesce(F.try_divide(F.col(year) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(1.0))
    return rows.withColumn("weight", F.greatest(F.lit(0.5), F.least(F.lit(1.75), by_year * (1 + alpha * weak.cast("int"))))).drop("_lo", "_hi")


def group_kfold(df: DataFrame, group: str, strata: Sequence[str], k: int, seed: int = 0) -> DataFrame:
    """fold 0..k-1 by group, dealt in turn within each stratum in the order of a hash (M10): no group is in two folds."""
    groups = df.select(group, *strata).distinct()
    dealt = groups.withColumn("fold", ((F.row_number().over(W.partitionBy(*strata).orderBy(F.md5(F.concat_ws(":", F.col(group).cast("string"), F.lit(str(seed)))), group)) - 1) % k).cast("int"))
    return df.join(dealt.select(group, "fold"), group)


def stacking(df: DataFrame, scores: Sequence[str], one_hot: dict[str, Sequence]) -> DataFrame:
    """Scores scaled within the race, and 0/1 columns of category values."""
    for s in scores:
        df = R.minmax(df, s, f"{s}_scaled")
    return df.withColumns({f"{c}_{v}": (F.col(c) == v).cast("int") for c, vs in one_hot.items() for v in vs})


def route_cells(df: DataFrame, rules: Sequence[tuple[Column, str]], default: str) -> DataFrame:
    """model: that of the first rule that holds."""
    out = None
    for cond, model in rules:
        out = F.when(cond, model) if out is None else out.when(cond, model)
    return df.withColumn("model", F.lit(default) if out is None else out.otherwise(default))


def impute_prior(df: DataFrame, cols: Sequence[str], cell: Sequence[str], before: Column, least: int = 20) -> DataFrame:
    """Nulls of cols by the cell's mean over rows before the cutoff if at least `least` have one, else the mean of all such rows; <col>_imputed tells."""
    past = df.where(before)
    cells = past.groupBy(*cell).agg(*(x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.count(c).alias(f"_n_{c}"))))
    whole = past.agg(*(F.avg(c).alias(f"_w_{c}") for c in cols))
    rows = J.with_context(df.join(cells, list(cell), "left"), whole)
    out = {}
    for c in cols:
        out[f"{c}_imputed"] = F.col(c).isNull()
        out[c] = F.coalesce(F.col(c), F.when(F.col(f"_n_{c}") >= least, F.col(f"_m_{c}")), F.col(f"_w_{c}"))
    flags = rows.withColumns({k: v for k, v in out.items() if k.endswith("_imputed")})
    return flags.withColumns({c: out[c] for c in cols}).drop(*(f"_{p}_{c}" for c in cols for p in ("m", "n", "w")))


def subset_metrics(df: DataFrame, features: Sequence[str], masks: Sequence[Sequence[int]], fold: str | None = None) -> DataFrame:
    """Top-1 rate of the sum of each mask's features (M14), by fold if there is one."""
    by = [fold] if fold else []
    value = lambda m: sum((F.col(features[i]) for i in m), F.lit(0.0))
    rows = df.select("race_id", *by, "horse", "finish", F.posexplode(F.array(*(value(m) for m in masks))).alias("mask", "v"))
    picked = rows.groupBy("mask", *by, "race_id").agg(F.max(F.struct("v", (-F.col("horse")).alias("h"), "finish")).alias("m"))
    return picked.groupBy("mask", *by).agg(F.avg((F.col("m.finish") == 1).cast("int")).alias("top1"), F.count("*").alias("races"))


def override_top_two(df: DataFrame, rank: str, market: str, cond: Column) -> DataFrame:
    """Swap the two best where the condition holds and the market prefers the second."""
    w = R.race()
    first, second = (F.max(F.when(F.col(rank) == k, F.col(market))).over(w) for k in (1, 2))
    swap = F.max(cond.cast("int")).over(w).cast("boolean") & (second < first)
    return df.withColumn(rank, F.when(swap & (F.col(rank) == 1), 2).when(swap & (F.col(rank) == 2), 1).otherwise(F.col(rank)).cast("long"))


def component_score(parts: dict[str, tuple[Column, float]]) -> tuple[Column, Column]:
    """Weighted mean of the components that are there, and the share of weight that they have."""
    total = sum(w for _, w in parts.values())
    there = sum((F.when(c.isNotNull(), w).otherwise(0.0) for c, w in parts.values()), F.lit(0.0))
    value = sum((F.coalesce(c * w, F.lit(0.0)) for c, w in parts.values()), F.lit(0.0))
    return F.try_divide(value, there), there / total
