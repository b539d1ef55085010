"""Domain views over the driver's tables: runners of races, made from order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: All columns of a line: of several lines of one order and part, the first by these is the runner.
_LINE = ("l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per runner: race = order, horse = part, jockey = supplier.

    Lines are shuffled twice, as they are: to their parts, then to their orders, where all else happens. Customers meet orders, which are fewer. Columns are made after that.
    """
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *_LINE)
    orders, customer, part = (table(spark, sf_dir, t) for t in ("orders", "customer", "part"))
    orders = orders.join(customer, orders.o_custkey == customer.c_custkey).select("o_orderkey", "o_custkey", "c_nationkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    rows = line.join(part, line.l_partkey == part.p_partkey).select(*line.columns, "p_brand", "p_type", "p_size").repartition("l_orderkey")
    one = rows.withColumn("rn", F.row_number().over(W.partitionBy("l_orderkey", "l_partkey").orderBy(*_LINE))).where("rn = 1").drop("rn")
    rows = one.join(orders, one.l_orderkey == orders.o_orderkey)
    day = F.to_date("o_orderdate")
    rows = rows.select(
        F.col("l_orderkey").alias("race_id"), day.alias("race_date"), F.datediff(day, F.lit("1970-01-01")).alias("day"), F.year(day).alias("race_year"), F.col("l_partkey").alias("horse"), F.col("l_suppkey").alias("jockey"), ((F.col("l_suppkey") * 7) % 40).alias("trainer"),
        F.col("o_custkey").alias("owner"), F.col("p_brand").alias("sire"), F.col("p_type").alias("damsire"), F.col("c_nationkey").alias("venue"), F.col("o_orderpriority").alias("class"), F.col("o_orderstatus").alias("surface"), (1000 + (F.col("l_orderkey") % 14) * 100).cast("int").alias("distance"),
        (2 + F.col("p_size") % 9).cast("int").alias("age"), (400 + F.col("l_quantity")).alias("body_weight"), F.round(50 + F.col("l_tax") * 100, 4).alias("carried"), F.round(1 + F.col("l_discount") * 100 + F.col("l_quantity") / 10, 4).alias("odds"),
        (60 + F.col("l_extendedprice") / 10000).alias("time"), F.round(33 + F.col("l_tax") * 50 + F.col("l_quantity") / 25, 4).alias("last3f"), F.col("l_extendedprice").alias("_p"), F.col("l_quantity").alias("_q"), F.col("l_discount").alias("_d"),
    )
    race = W.partitionBy("race_id")
    rows = rows.withColumns({
        "field_size": F.count("*").over(race), "finish": F.row_number().over(race.orderBy(F.desc("_p"), "horse")).cast("long"), "popularity": F.row_number().over(race.orderBy("odds", "horse")).cast("long"),
        "horse_no": F.row_number().over(race.orderBy("horse")).cast("long"), "corner1": F.row_number().over(race.orderBy(F.desc("_q"), "horse")).cast("long"),
        "score_a": F.col("_p") / 1000, "score_b": F.round(F.col("_q") * (1 - F.col("_d")), 4), "score_c": F.col("_p") / (1 + F.col("_q")),
    })
    return rows.drop("_p", "_q", "_d")


#: The same view in DuckDB.
SQL = """
WITH line AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) = 1),
runner AS (
  SELECT l_orderkey AS race_id, CAST(o_orderdate AS DATE) AS race_date, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS day, year(o_orderdate) AS race_year, l_partkey AS horse, l_suppkey AS jockey, (l_suppkey * 7) % 40 AS trainer,
    o_custkey AS owner, p_brand AS sire, p_type AS damsire, c_nationkey AS venue, o_orderpriority AS class, o_orderstatus AS surface, (1000 + (l_orderkey % 14) * 100)::INT AS distance,
    (2 + p_size % 9)::INT AS age, 400 + l_quantity AS body_weight, round(50 + l_tax * 100, 4) AS carried, round(1 + l_discount * 100 + l_quantity / 10, 4) AS odds,
    60 + l_extendedprice / 10000 AS time, round(33 + l_tax * 50 + l_quantity / 25, 4) AS last3f, l_extendedprice AS _p, l_quantity AS _q, l_discount AS _d
  FROM line JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey),
e AS (
  SELECT * EXCLUDE (_p, _q, _d), count(*) OVER (PARTITION BY race_id) AS field_size, row_number() OVER (PARTITION BY race_id ORDER BY _p DESC, horse) AS finish,
    row_number() OVER (PARTITION BY race_id ORDER BY odds, horse) AS popularity, row_number() OVER (PARTITION BY race_id ORDER BY horse) AS horse_no,
    row_number() OVER (PARTITION BY race_id ORDER BY _q DESC, horse) AS corner1, _p / 1000 AS score_a, round(_q * (1 - _d), 4) AS score_b, _p / (1 + _q) AS score_c
  FROM runner)
"""

#: Runs in a horse's order (k), and how many of them are of earlier days (kb): the last n of those are rows kb - n + 1 to kb.
RUNS = "(SELECT *, row_number() OVER (PARTITION BY horse ORDER BY day, race_id) AS k, count(*) OVER (PARTITION BY horse ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kb FROM e)"


def last(n):
    return f"OVER (PARTITION BY horse ORDER BY day, race_id ROWS BETWEEN (k - kb + {n - 1}) PRECEDING AND (k - kb) PRECEDING)"
