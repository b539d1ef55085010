"""Checks and change control on tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import joins as J


def completeness(df: DataFrame, cols: Sequence[str], ranks: Sequence[str] = (), group: str = "race_id") -> DataFrame:
    """Per column: missing (not in the table), null_rate, flat_groups (groups of two rows or more in which a rank column has one value) (Q1). One pass for the rates, one for the groups."""
    there = [c for c in cols if c in df.columns]
    rates = df.agg(F.count("*").alias("n"), *(F.count(c).alias(c) for c in there))
    rows = rates.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(c not in there).alias("missing"), (1 - F.try_divide(F.col(c), F.col("n")) if c in there else F.lit(None).cast("double")).alias("null_rate")) for c in cols))).alias("s")).select("s.*")
    if not ranks:
        return rows.withColumn("flat_groups", F.lit(None).cast("long"))
    flat = df.groupBy(group).agg(F.count("*").alias("_n"), *((F.min(r) == F.max(r)).alias(r) for r in ranks)).where("_n > 1").agg(*(F.count_if(F.col(r)).alias(r) for r in ranks))
    tall = flat.select(F.explode(F.array(*(F.struct(F.lit(r).alias("column"), F.col(r).alias("flat_groups")) for r in ranks))).alias("s")).select("s.*")
    return rows.join(tall, "column", "left")


def missing_fraction(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ("race_id",)) -> DataFrame:
    """Share of null cells in each group, and whether every row of it is alike (Q2)."""
    nulls = sum((F.col(c).isNull().cast("int") for c in cols), F.lit(0))
    alike = F.when(F.count("*") > 1, F.min(F.struct(*cols)) == F.max(F.struct(*cols))).otherwise(False)
    return df.groupBy(*by).agg((F.sum(nulls) / (F.count("*") * len(cols))).alias("missing"), F.coalesce(alike, F.lit(False)).alias("degenerate"))


def feature_parity(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """status of each wanted or present column: missing, extra, dead (null or constant), ok (Q3)."""
    both = [c for c in names if c in df.columns]
    stats = df.agg(*(x for c in both for x in (F.count(c).alias(f"n_{c}"), F.min(c).cast("string").alias(f"lo_{c}"), F.max(c).cast("string").alias(f"hi_{c}"))))
    item = lambda c, s: F.struct(F.lit(c).alias("column"), s.alias("status"))
    dead = lambda c: F.when((F.col(f"n_{c}") == 0) | F.col(f"lo_{c}").eqNullSafe(F.col(f"hi_{c}")), "dead").otherwise("ok")
    items = [item(c, dead(c)) for c in both] + [item(c, F.lit("missing")) for c in names if c not in both] + [item(c, F.lit("extra")) for c in df.columns if c not in names]
    return stats.select(F.explode(F.array(*items)).alias("s")).select("s.*")


def classify_diff(db: DataFrame, incoming: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Per key and column that both sides know: unchanged, enriched (was null), regression (becomes null), changed (Q4)."""
    tall = lambda df, name: df.select(*keys, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias(name)) for c in cols))).alias("s")).select(*keys, "s.*")
    both = tall(db, "old").join(tall(incoming, "new"), [*keys, "column"])
    kind = F.when(F.col("old").eqNullSafe(F.col("new")), "unchanged").when(F.col("old").isNull(), "enriched").when(F.col("new").isNull(), "regression").otherwise("changed")
    return both.withColumn("kind", kind)


def block_regressions(diff: DataFrame, most: int = 0) -> DataFrame:
    """Per column of a diff how many values would be lost, and whether that blocks the write (Q4)."""
    return diff.groupBy("column").agg(F.count_if(F.col("kind") == "regression").alias("regressions")).withColumn("blocked", F.col("regressions") > most)


def upsert(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of updates, and those of target whose key they lack."""
    return updates.unionByName(J.without(target, updates, keys), allowMissingColumns=True)


def write_report(target: DataFrame, updates: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """What an upsert would do, in one row: inserted, unchanged, filled (a field was null), conflicts (a known field changes), conflicting fields (Q5)."""
    t = target.select(*keys, F.struct(*fields).alias("_t"))
    j = updates.select(*keys, F.struct(*fields).alias("_u")).join(t, list(keys), "left")
    clash = sum((F.when(F.col("_t")[c].isNotNull() & ~F.col("_t")[c].eqNullSafe(F.col("_u")[c]), 1).otherwise(0) for c in fields), F.lit(0))
    kind = F.when(F.col("_t").isNull(), "inserted").when(F.col("_t").eqNullSafe(F.col("_u")), "unchanged").when(clash == 0, "filled").otherwise("conflict")
    return j.select(kind.alias("k"), clash.alias("c")).agg(*(F.count_if(F.col("k") == k).alias(n) for k, n in (("inserted", "inserted"), ("unchanged", "unchanged"), ("filled", "filled"), ("conflict", "conflicts"))), F.coalesce(F.sum(F.when(F.col("k") == "conflict", F.col("c"))), F.lit(0)).alias("conflicting_fields"))


def insert_missing(target: DataFrame, updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of target, and those of updates whose key it lacks."""
    return target.unionByName(J.without(updates, target, keys), allowMissingColumns=True)


def resolve_entities(rows: DataFrame, masters: Sequence[DataFrame], name: str, code: str, placeholder: str) -> DataFrame:
    """The code of the first master that knows the name, else a placeholder (Q7)."""
    merged = J.merge_masters([m.select(name, code) for m in masters], [name])
    return rows.join(merged, name, "left").withColumn(code, F.coalesce(F.col(code).cast("string"), F.concat(F.lit(placeholder), F.col(name))))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys with more than one row (Q6)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def parity(a: DataFrame, b: DataFrame, keys: Sequence[str], classes: Sequence[str], tolerance: float) -> DataFrame:
    """Largest absolute difference per class, agreement of the largest class, rows beyond the tolerance, largest difference of the sums of classes (Q11)."""
    j = a.select(*keys, F.array(*classes).alias("x")).join(b.select(*keys, F.array(*classes).alias("y")), list(keys))
    diff = F.zip_with("x", "y", lambda p, q: F.abs(p - q))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, v: s + v)
    return j.agg(
        *(F.max(F.abs(F.col("x")[i] - F.col("y")[i])).alias(f"max_{c}") for i, c in enumerate(classes)),
        F.avg((F.array_position("x", F.array_max("x")) == F.array_position("y", F.array_max("y"))).cast("int")).alias("agreement"), F.count_if(F.array_max(diff) > tolerance).alias("beyond"), F.max(F.abs(total("x") - total("y"))).alias("sum_gap"), F.count("*").alias("rows"),
    )
