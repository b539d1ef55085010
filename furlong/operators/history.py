"""What was known before: aggregates over strictly earlier days, last runs, calendar frames, as-of and range joins.

Windows, not joins, wherever the condition does not depend on the target: one shuffle by entity. Frames
by day, and last_before, never show a run one of its own day; last_rows and last_n go by rows, and do. cube counts many cells of one table together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def before(*entity: str, day: str = "day"):
    """Window of an entity's rows on strictly earlier days."""
    return W.partitionBy(*entity).orderBy(day).rangeBetween(W.unboundedPreceding, -1)


def last_days(*entity: str, days: int, day: str = "day"):
    """Window of an entity's rows from `days` days before until yesterday."""
    return W.partitionBy(*entity).orderBy(day).rangeBetween(-days, -1)


def last_rows(*entity: str, n: int, order: Sequence[str] = ("day", "race_id")):
    """Window of an entity's last n rows before this one, in a total order."""
    return W.partitionBy(*entity).orderBy(*order).rowsBetween(-n, -1)


def expanding(df: DataFrame, entity: Sequence[str], day: str = "day", **aggregates: Column) -> DataFrame:
    """Add aggregates over the entity's strictly earlier days."""
    w = before(*entity, day=day)
    return df.withColumns({name: a.over(w) for name, a in aggregates.items()})


def last_before(df: DataFrame, entity: Sequence[str], order: Sequence[str] = ("day", "race_id"), **frames: tuple[int, Column]) -> DataFrame:
    """Add aggregates over the entity's last n rows of strictly earlier days: name=(n, aggregate). order: the day, then what breaks ties.

    Each row first has the aggregates over its last n rows up to itself; what a row gets is what the last row of an earlier day has. Both windows share one
    shuffle and one sort, a frame holds n rows at most, and the rows of one day all get the same. No earlier day, or no entity: nulls.
    """
    rows = W.partitionBy(*entity).orderBy(*order)
    state = F.struct(*(a.over(rows.rowsBetween(1 - n, 0)).alias(name) for name, (n, a) in frames.items()))
    known = F.max_by("_upto", F.struct(*order)).over(before(*entity, day=order[0]))
    for e in entity:
        known = F.when(F.col(e).isNotNull(), known)
    df = df.withColumn("_upto", state).withColumn("_known", known)
    return df.withColumns({name: F.col("_known")[name] for name in frames}).drop("_upto", "_known")


def quartile(sorted_values: Column, share: float) -> Column:
    """The value at a share of a sorted array, linear between neighbours; null of an empty one."""
    at = (F.size(sorted_values) - 1) * share
    low = F.floor(at).cast("int")
    a, b = F.get(sorted_values, low), F.get(sorted_values, F.ceil(at).cast("int"))
    return F.when(F.size(sorted_values) > 0, a + (at - low) * (b - a))


@dataclass(frozen=True)
class Cell:
    """What a column of a cube is: the mean, count or sum of a value over the earlier days of rows equal in `by`.

    days: only so many days back. least: a mean is null up to so many rows. monthly: earlier months count instead of earlier days.
    """

    by: tuple[str, ...]
    of: str
    how: str = "mean"
    days: int | None = None
    least: int = 0
    monthly: bool = False


#: Entities of so many values that one has few rows.
MANY = ("horse", "jockey", "owner")
#: Rows (a cell and a day each) of the groupings that are broadcast together, beside the rows of all days; larger groupings are joined by entity and day.
MOST_SENT = 300_000


def cube(df: DataFrame, values: dict[str, Column], cells: dict[str, Cell], key: Sequence[str] = ("race_id", "horse"), day: str = "day", date: str = "race_date", many: Sequence[str] = MANY) -> DataFrame:
    """Add a column for each cell: means, counts and sums over earlier days of many groupings of one table (A41, L3 and the like).

    Groupings that hold one of `many` are windows, all of one entity after one shuffle by it. The others have cells that may hold a third of
    all rows. For these df is written once, and read by the columns needed: each row is laid out once for each distinct grouping, sums are taken by
    grouping, cell and day (combined before they are shuffled, so that a cell is as small as its days), and one window runs
    over the days of each cell. What it gives is packed, a map from cell to sums for each grouping, and rows look their cells up: groupings with few
    cells and days go by day and are broadcast, the others go by entity and day, one join for all groupings of an entity. A null value
    is no row of the cell; a row that is null in a cell's grouping keeps its place and has a null there; other columns stay as they are.

    Entities come in the order of `cells`: df is left partitioned by the last of `many`. All columns of df are written: give it those that are needed.
    """
    few = {n: c for n, c in cells.items() if c.monthly or not set(c.by) & set(many)}
    near, far = (lambda rows: rows), (lambda rows: rows)
    if few:
        df, near, far = _by_days(df, values, few, day, date)
    # what is shuffled comes while rows are narrow, what is broadcast comes last
    df = far(df)
    for entity in dict.fromkeys(next(b for b in c.by if b in many) for n, c in cells.items() if n not in few):
        own = {n: c for n, c in cells.items() if n not in few and next(b for b in c.by if b in many) == entity}
        if not any(c.by == (entity,) for c in own.values()):
            df = df.repartition(entity)
        # the widest grouping first: it shuffles by the entity alone, and the others find their rows together
        for by in sorted(dict.fromkeys(c.by for c in own.values()), key=len):
            df = df.withColumns({n: _over_days(c, values[c.of], day) for n, c in own.items() if c.by == by})
    return near(df)


def _over_days(cell: Cell, value: Column, day: str) -> Column:
    w = last_days(*cell.by, days=cell.days, day=day) if cell.days else before(*cell.by, day=day)
    n = F.count(value).over(w)
    out = {"count": n, "sum": F.coalesce(F.sum(value).over(w), F.lit(0)), "mean": F.when(n > cell.least, F.avg(value).over(w))}[cell.how]
    for b in cell.by:
        out = F.when(F.col(b).isNotNull(), out)
    return out


def _by_days(df: DataFrame, values: dict[str, Column], cells: dict[str, Cell], day: str, date: str):
    """df as it is written, and two functions that add columns to it: those of the groupings that are broadcast, and those of the others."""
    from ..sources.tables import cut

    base = cut(df, "cube")
    arms = list(dict.fromkeys((c.by, c.monthly) for c in cells.values()))
    frames = list(dict.fromkeys((c.of, c.days) for c in cells.values()))
    at = {False: F.col(day).cast("int"), True: F.datediff(F.trunc(date, "month"), F.lit("1970-01-01")).cast("int")}

    def cell(i, by):
        """A hash of the grouping and its values stands for the cell; null if one of them is."""
        there = F.lit(True)
        for b in by:
            there = there & F.col(b).isNotNull()
        return F.when(there, F.xxhash64(F.lit(i), *by))

    def arm(i, by, monthly):
        # for the sums a second hash, 128 bits together: rows stay narrow, and keys are numbers whatever the values are
        return F.when(cell(i, by).isNotNull(), F.struct(F.lit(i).alias("arm"), F.xxhash64(by[0]).alias("e"), cell(i, by).alias("c1"), F.xxhash64(*reversed(by), F.lit(~i)).alias("c2"), at[monthly].alias("t")))

    used = list(dict.fromkeys(of for of, _ in frames))
    spread = F.explode(F.array_compact(F.array(*(arm(i, *a) for i, a in enumerate(arms)))))
    long = base.select(*(values[v].alias(f"_{v}") for v in used), spread.alias("a")).select("a.*", *(f"_{v}" for v in used))
    daily = long.groupBy("arm", "e", "c1", "c2", "t").agg(*(x for v in used for x in (F.count(f"_{v}").alias(f"_n_{v}"), F.sum(f"_{v}").alias(f"_s_{v}"))))
    w = W.partitionBy("arm", "e", "c1", "c2").orderBy("t")
    over = {}
    for v, days in frames:
        frame = w.rangeBetween(-days if days else W.unboundedPreceding, -1)
        over |= {f"n_{v}_{days}": F.coalesce(F.sum(f"_n_{v}").over(frame), F.lit(0)), f"s_{v}_{days}": F.sum(f"_s_{v}").over(frame)}
    past = cut(daily.where("t is not null").select("arm", "e", "c1", "t", *(c.alias(n) for n, c in over.items())), "cube-days")
    sizes, sent, left = {r.arm: r["count"] for r in past.groupBy("arm").count().collect()}, [], MOST_SENT
    for i in sorted(range(len(arms)), key=lambda i: sizes.get(i, 0)):
        left -= sizes.get(i, 0)
        if left >= 0:
            sent.append(i)

    def packed(some, keys):
        """By keys, a map for each grouping: from the cell to what its columns need."""
        needs = {i: dict.fromkeys(f"{k}_{c.of}_{c.days}" for c in cells.values() if (c.by, c.monthly) == arms[i] for k in "ns") for i in some}
        maps = (F.map_from_entries(F.collect_list(F.when(F.col("arm") == i, F.struct("c1", F.struct(*needs[i]))))).alias(f"_m{i}") for i in some)
        return past.where(F.col("arm").isin(some)).groupBy(*keys).agg(*maps)

    def look_up(rows, arms_of, by_entity):
        for entity, monthly in dict.fromkeys((arms[i][0][0] if by_entity else None, arms[i][1]) for i in arms_of):
            some = [i for i in arms_of if arms[i][1] == monthly and entity in (None, arms[i][0][0])]
            keys = {"_e": F.xxhash64(entity), "_t": at[monthly]} if by_entity else {"_t": at[monthly]}
            side = packed(some, [k[1:] for k in keys]).withColumnsRenamed({k[1:]: k for k in keys})
            rows = rows.withColumns(keys).join(side if by_entity else F.broadcast(side), list(keys), "left").withColumns({f"_p{i}": F.try_element_at(f"_m{i}", cell(i, arms[i][0])) for i in some}).drop(*keys, *(f"_m{i}" for i in some))
        out = {}
        for name, c in cells.items():
            i = arms.index((c.by, c.monthly))
            if i in arms_of:
                n, s = F.col(f"_p{i}")[f"n_{c.of}_{c.days}"], F.col(f"_p{i}")[f"s_{c.of}_{c.days}"]
                out[name] = {"count": n, "sum": F.when(n.isNotNull(), F.coalesce(s, F.lit(0))), "mean": F.when(n > c.least, F.try_divide(s, n))}[c.how]
        return rows.withColumns(out).drop(*(f"_p{i}" for i in arms_of)) if out else rows

    return base, lambda rows: look_up(rows, sent, False), lambda rows: look_up(rows, [i for i in range(len(arms)) if i not in sent], True)


def last_n(df: DataFrame, entity: Sequence[str], n: int, **aggregates: Column) -> DataFrame:
    """Add aggregates over the entity's last n rows in order, those of the same day included."""
    w = last_rows(*entity, n=n)
    return df.withColumns({name: a.over(w) for name, a in aggregates.items()})


def within_days(df: DataFrame, entity: Sequence[str], days: int, **aggregates: Column) -> DataFrame:
    """Add aggregates over the entity's last `days` days, today left out."""
    w = last_days(*entity, days=days)
    return df.withColumns({name: a.over(w) for name, a in aggregates.items()})


def day_grain(df: DataFrame, entity: Sequence[str], day: str = "day", days: int | None = None, **sums: Column) -> DataFrame:
    """Sums by entity and day, then over all earlier days, or the last `days` of them (A41): two runners of one day that share the entity do not see each other, and the window has a row a day."""
    daily = df.groupBy(*entity, day).agg(*(s.alias(n) for n, s in sums.items()))
    w = W.partitionBy(*entity).orderBy(day).rangeBetween(-days if days else W.unboundedPreceding, -1)
    return daily.select(*entity, day, *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums))


def race_order(df: DataFrame, entity: Sequence[str], order: Sequence[str], **sums: Column) -> DataFrame:
    """Sums by entity and race, then over all earlier races, those of the same day included."""
    by_race = df.groupBy(*entity, *order).agg(*(s.alias(n) for n, s in sums.items()))
    w = W.partitionBy(*entity).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return by_race.select(*entity, *order, *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums))


def race_number(day: str = "day", race: str = "race_id") -> Column:
    """A number that orders races by day and id, for frames over earlier races that need no join: ids are below 2^40."""
    return F.col(day).cast("long") * F.lit(1 << 40) + F.col(race)


def recent_rank(df: DataFrame, entity: Sequence[str], order: Sequence[str] = ("day", "race_id")) -> DataFrame:
    """recent_rank: 1 for an entity's newest row."""
    return df.withColumn("recent_rank", F.row_number().over(W.partitionBy(*entity).orderBy(*(F.desc(c) for c in order))).cast("long"))


def prior_history(target: DataFrame, history: DataFrame, entity: Sequence[str], day: str = "day", years: int | None = None) -> DataFrame:
    """Each target row with the entity's rows of strictly earlier days (J3); history's columns get the prefix h_. years: how far back, to the same day of the year."""
    h = history.select(*(F.col(c).alias(f"h_{c}") for c in history.columns))
    near = [F.col(c) == F.col(f"h_{c}") for c in entity] + [F.col(f"h_{day}") < F.col(day)]
    if years:
        near.append(F.to_date(F.date_from_unix_date(F.col(f"h_{day}"))) >= F.add_months(F.date_from_unix_date(F.col(day)), -12 * years))
    return target.join(h, near)


def range_join(target: DataFrame, history: DataFrame, entity: Sequence[str], days: str, day: str = "day", how: str = "inner") -> DataFrame:
    """As prior_history, but no farther back than the target's own column `days` says."""
    h = history.select(*(F.col(c).alias(f"h_{c}") for c in history.columns))
    near = [F.col(c) == F.col(f"h_{c}") for c in entity] + [F.col(f"h_{day}") < F.col(day), F.col(day) - F.col(f"h_{day}") <= F.col(days)]
    return target.join(h, near, how)


def asof_join(left: DataFrame, right: DataFrame, by: Sequence[str], on: str, values: Sequence[str], strict: bool = True) -> DataFrame:
    """Each left row with the values of the newest right row before it (strict) or not after it.

    Both sides go through one window by key: right rows carry their values, and the last one before a left row fills it. No row is
    paired with another, so a hot key costs a sort, not a product.
    """
    l = left.select(*left.columns, F.lit(None).cast(_struct(right, values)).alias("_v"), F.lit(0 if strict else 1).alias("_side"))
    r = right.select(*by, on, F.struct(*values).alias("_v"), F.lit(1 if strict else 0).alias("_side")).withColumn("_right", F.lit(True))
    both = l.withColumn("_right", F.lit(False)).unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(on, "_side").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where(~F.col("_right")).select(*left.columns, *(F.col("_v")[v].alias(v) for v in values))


def _struct(df: DataFrame, values: Sequence[str]):
    from pyspark.sql.types import StructField, StructType

    return StructType([StructField(v, df.schema[v].dataType, True) for v in values])


def monthly_cumulative(df: DataFrame, entity: Sequence[str], date: str = "race_date", **sums: Column) -> DataFrame:
    """Sums by entity and month, and over all earlier months (J17): one row per entity and month."""
    month = F.trunc(F.col(date), "month")
    monthly = df.groupBy(*entity, month.alias("month")).agg(*(s.alias(n) for n, s in sums.items()))
    w = W.partitionBy(*entity).orderBy("month").rowsBetween(W.unboundedPreceding, -1)
    return monthly.select(*entity, "month", *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums))
