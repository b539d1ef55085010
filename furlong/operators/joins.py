"""Joins and set operations on runner tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a rule or context table that may be broadcast; larger ones are refused, as such tables are small by nature.
MOST_RULES = 10_000


def attach(df: DataFrame, side: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left enrichment."""
    return df.join(side, list(keys), "left")


def small(df: DataFrame, most: int = MOST_RULES) -> DataFrame:
    """The table as a broadcast side, after a check that it has no more than `most` rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows are no rule table")
    return F.broadcast(df)


def with_context(df: DataFrame, context: DataFrame) -> DataFrame:
    """Every row beside the one row of context."""
    return df.crossJoin(small(context, 1))


def rule_match(df: DataFrame, rules: DataFrame, text: str, equals: str = "equals", contains: str = "contains") -> DataFrame:
    """Rows with each rule whose `equals` is the text or whose `contains` is in it (J9). Exact rules join by key; only the pattern rules meet all rows."""
    exact = df.join(rules.where(F.col(equals).isNotNull()), F.col(text) == F.col(equals))
    within = df.join(small(rules.where(F.col(equals).isNull() & F.col(contains).isNotNull())), F.contains(F.col(text), F.col(contains)))
    return exact.unionByName(within)


def without(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(other, list(keys), "left_anti")


def focus(df: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(targets, list(keys), "left_semi")


def outer_merge(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of sparse statistics, keys merged."""
    return a.join(b, list(keys), "full")


def pairs_within(df: DataFrame, group: Sequence[str], id: str, keep: Sequence[str] = ()) -> DataFrame:
    """Pairs of a group's rows with a's id below b's (J7); columns of keep as a_<c>, b_<c>."""
    cols = [id, *keep]
    a = df.select(*group, *(F.col(c).alias(f"a_{c}") for c in cols))
    b = df.select(*group, *(F.col(c).alias(f"b_{c}") for c in cols))
    return a.join(b, list(group)).where(F.col(f"a_{id}") < F.col(f"b_{id}"))


def unpivot(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "slot", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def match_any(df: DataFrame, ids: Sequence[str], cols: Sequence[str], names: DataFrame, name: str = "name") -> DataFrame:
    """Rows of df with each of its slots whose value is among names (J14): an equi join after unpivoting, never an OR."""
    return unpivot(df, ids, cols, value=name).where(F.col(name).isNotNull()).join(names.select(name).distinct(), name, "left_semi")


def merge_masters(masters: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Of several masters, each key's row from the first that has it."""
    ranked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [m.withColumn("_priority", F.lit(i)) for i, m in enumerate(masters)])
    others = sorted(c for c in ranked.columns if c not in keys and c != "_priority")
    return first_per_key(ranked, keys, ["_priority", *others]).drop("_priority")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in the order (K3, U3); the order should be total."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], n: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def dedupe_priority(df: DataFrame, signature: Sequence[str], priority: Sequence[str | Column]) -> DataFrame:
    """Of rows with one signature the one of the best source (U4)."""
    return first_per_key(df, signature, priority)


def with_placeholders(df: DataFrame, runners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, and a row of nulls for each runner that has none."""
    return df.unionByName(without(runners.select(*keys).distinct(), df, keys), allowMissingColumns=True)


def coalesce_merge(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Field by field, b where it is not null or empty, else a."""
    fields = [c for c in a.columns if c not in keys]
    right = b.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in fields))
    filled = lambda c: F.nullif(F.col(f"_b_{c}"), F.lit("")) if dict(a.dtypes)[c] == "string" else F.col(f"_b_{c}")
    return a.join(right, list(keys), "full").select(*keys, *(F.coalesce(filled(c), F.col(c)).alias(c) for c in fields))


def route_small(a: DataFrame, b: DataFrame, sizes: DataFrame, most: int, by: Sequence[str], size: str = "field_size") -> DataFrame:
    """Rows of a for groups of at most `most`, rows of b for the others (U8)."""
    few = sizes.where(F.col(size) <= most).select(*by)
    return focus(a, few, by).unionByName(without(b, few, by))


def reconcile(a: DataFrame, b: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """status ('both', 'only_a', 'only_b') of each key, and the names of fields that differ."""
    left = a.select(*keys, F.struct(*fields).alias("_a"))
    right = b.select(*keys, F.struct(*fields).alias("_b"))
    differ = F.array_compact(F.array(*(F.when(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), F.lit(c)) for c in fields)))
    status = F.when(F.col("_b").isNull(), "only_a").when(F.col("_a").isNull(), "only_b").otherwise("both")
    return left.join(right, list(keys), "full").select(*keys, status.alias("status"), F.when(status == "both", F.array_join(differ, ",")).otherwise("").alias("differing"))


def coverage(expected: DataFrame, present: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """expected, present, missing of each group."""
    there = present.select(*keys).distinct().withColumn("_there", F.lit(1))
    counted = expected.join(there, list(keys), "left").groupBy(*group).agg(F.count("*").alias("expected"), F.count("_there").alias("present"))
    return counted.withColumn("missing", F.col("expected") - F.col("present"))


def latest(df: DataFrame, keys: Sequence[str], at: Sequence[str]) -> DataFrame:
    """Each key's newest row (J21, T3), without a sort: the largest struct."""
    others = [c for c in df.columns if c not in keys and c not in at]
    return df.groupBy(*keys).agg(F.max(F.struct(*at, *others)).alias("_m")).select(*keys, *(F.col("_m")[c].alias(c) for c in (*at, *others)))


def fallback_match(targets: DataFrame, history: DataFrame, levels: Sequence[Sequence[str]], day: str = "day", least: int = 30, most: int = 200, ties: Sequence[str] = (), look_back: int | None = None) -> DataFrame:
    """For each target key, the newest `most` earlier rows (of one day, those with the smallest ties) of the first level that has `least` of them in the last look_back days; the last level if none has.

    targets: key_id, the level columns, day. A level is a list of columns that must agree. The level is chosen by counts of days before any row is
    joined. A level's rows are numbered by age with offsets of days, so that no window is larger than a day of a level; a pool is then a run
    of numbers, found by an equi-join on runs of `most`: a target meets 2 * most rows, however many its level has.
    """
    met, pool = _pools(targets, history, levels, ["_last", "_first"], day, least, most, ties, look_back)
    return met.join(pool, ["_level", "_cell", "_last", "_first"], "left").select("key_id", F.col("_level").alias("level"), *(f"h_{c}" for c in history.columns))


def fallback_stats(targets: DataFrame, history: DataFrame, levels: Sequence[Sequence[str]], stats: dict[str, Column], day: str = "day", least: int = 30, most: int = 200, ties: Sequence[str] = (), look_back: int | None = None) -> DataFrame:
    """key_id, level and aggregates over the pool that fallback_match gives each target key (of history's columns, as h_, and of the target's day, as _day).

    Targets of one day and one value of their level share a pool: its rows are aggregated once, as they are found, and only what comes out goes to each target. Of an
    empty pool all are null.
    """
    keys = ["_level", "_cell", "_day"]
    met, pool = _pools(targets, history, levels, ["_day", "_last", "_first"], day, least, most, ties, look_back)
    told = pool.groupBy(*keys).agg(*(c.alias(n) for n, c in stats.items()))
    return met.join(told, keys, "left").select("key_id", F.col("_level").alias("level"), *stats)


def _pools(targets: DataFrame, history: DataFrame, levels: Sequence[Sequence[str]], of: Sequence[str], day: str, least: int, most: int, ties: Sequence[str], look_back: int | None) -> tuple[DataFrame, DataFrame]:
    """The level, cell, day and run of numbers of each target key; and the rows of each distinct pool, by level, cell and `of`."""
    from ..sources.tables import cut

    by = ["_level", "_cell"]

    def keyed(df: DataFrame) -> DataFrame:
        """Each row once a level, under the level's number and its values of the level's columns (null if one is)."""
        cells = (F.struct(F.lit(n).alias("_level"), F.when(F.concat(*(F.col(c).cast("string") for c in level)).isNotNull(), F.concat_ws("\x1f", *level)).alias("_cell")) for n, level in enumerate(levels))
        return df.select("*", F.inline(F.array(*cells)))

    rows, asked = keyed(history), keyed(targets.select("key_id", day, *dict.fromkeys(c for level in levels for c in level)))
    daily = rows.groupBy(*by, day).agg(F.count("*").alias("_c")).unionByName(asked.select(*by, day).distinct().withColumn("_c", F.lit(0).cast("long")))
    grid = daily.groupBy(*by, day).agg(F.sum("_c").alias("_c"))
    w = W.partitionBy(*by).orderBy(day)
    near = w.rangeBetween(-look_back if look_back else W.unboundedPreceding, -1)
    counts = grid.select(*by, day, F.coalesce(F.sum("_c").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.coalesce(F.sum("_c").over(near), F.lit(0)).alias("_near"))
    span = F.struct("_level", "_cell", F.col("_before").alias("_last"), (F.col("_before") - F.least(F.lit(most), "_near")).alias("_first"), F.col(day).alias("_day"))
    # what both the choice of levels and the numbering need is counted once
    counts = cut(counts, "fallback-counts")
    met = asked.join(counts, [*by, day], "left").groupBy("key_id").agg(F.coalesce(F.min(F.when(F.col("_near") >= least, span)), F.max(span)).alias("_s")).select("key_id", "_s.*")
    met = cut(met, "fallback-levels")
    runs = met.select(*by, *of).distinct().withColumn("_run", F.explode(F.array_distinct(F.array(F.floor((F.col("_first") + 1) / most), F.floor(F.col("_last") / most)))))
    at = F.row_number().over(W.partitionBy(*by, day).orderBy(*(F.desc(c) for c in ties))) + F.col("_before")
    placed = rows.join(counts.select(*by, day, "_before"), [*by, day]).withColumn("_at", at).select(*by, "_at", F.floor(F.col("_at") / most).alias("_run"), *(F.col(c).alias(f"h_{c}") for c in history.columns))
    pool = runs.join(placed, [*by, "_run"]).where((F.col("_at") > F.col("_first")) & (F.col("_at") <= F.col("_last"))).drop("_run", "_at")
    return met, pool


def union_all(arms: Sequence[DataFrame]) -> DataFrame:
    """Arms one after another, matched by column name."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), arms)
