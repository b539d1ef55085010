"""Scans and sinks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import joins as J


def folder(spark, name: str) -> str:
    """A new folder that all executors see: under spark.checkpoint.dir, or, where that is unset, on one machine, in a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if top is None:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors see")
        top = "file://" + tempfile.mkdtemp(prefix="spark-furlong-")
    return f"{top.rstrip('/')}/furlong/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written once as a table into the shared folder, and read back: what reads it several times plans its source once, and reads only the columns it needs."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scan_parquet(spark: SparkSession, *paths: str, merge: bool = True) -> DataFrame:
    """Partitioned Parquet, columns united by name."""
    return spark.read.option("mergeSchema", str(merge).lower()).parquet(*paths)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], compression: str = "zstd") -> None:
    """Overwrite the partitions that df has, and no others (S2). Rows of a partition value are brought together, so that it has few files; a large one is split by AQE's rebalancing."""
    df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", compression).partitionBy(*by).parquet(path)


def load_table(spark: SparkSession, name: str, backend: str = "parquet", **options: str) -> DataFrame:
    """One resolver for files, the catalog and JDBC (S3). A JDBC table with a numeric `partitionColumn` is read in `numPartitions` ranges of it (8, unless told), over the bounds that the database gives."""
    if backend == "catalog":
        return spark.table(name)
    if backend == "jdbc":
        column = options.get("partitionColumn")
        if column and "lowerBound" not in options:
            plain = {k: v for k, v in options.items() if k not in ("partitionColumn", "numPartitions")}
            low, high = spark.read.format("jdbc").options(dbtable=name, **plain).load().agg(F.min(column), F.max(column)).first()
            options = {"numPartitions": "8"} | options | {"lowerBound": str(low or 0), "upperBound": str((high or 0) + 1)}
        return spark.read.format("jdbc").options(dbtable=name, **options).load()
    return spark.read.format(backend).options(**{k: v for k, v in options.items() if k != "root"}).load(f"{options['root']}/{name}.{backend}")


def read_jsonl(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv(spark: SparkSession, path: str, schema: str, years: Sequence[int], year: str) -> DataFrame:
    """CSV with a checked header (a wrong one fails), of some years."""
    return spark.read.option("header", True).option("enforceSchema", False).schema(schema).csv(path).where(F.col(year).isin(list(years)))


def explode_payouts(df: DataFrame, keys: Sequence[str], ticket: str) -> DataFrame:
    """list<struct<numbers, payout, popularity_rank>> to rows; numbers as '1-2-3' (S9)."""
    rows = df.select(*keys, F.explode(ticket).alias("t"))
    return rows.select(*keys, F.array_join(F.col("t.numbers").cast("array<string>"), "-").alias("numbers"), "t.payout", "t.popularity_rank")


def explode_hourly(df: DataFrame, keys: Sequence[str], json: str, fields: dict[str, str]) -> DataFrame:
    """Parallel arrays in JSON to one row per hour."""
    schema = "struct<" + ",".join(f"{c}:array<{t}>" for c, t in fields.items()) + ">"
    rows = df.select(*keys, F.from_json(json, schema).alias("h")).select(*keys, F.posexplode(F.arrays_zip(*(F.col(f"h.{c}") for c in fields))).alias("hour", "z"))
    return rows.select(*keys, "hour", *(F.col("z")[c].alias(c) for c in fields))


def stamp(df: DataFrame, **versions: str) -> DataFrame:
    """Version columns on every row."""
    return df.withColumns({k: F.lit(v) for k, v in versions.items()})


def export(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Fixed columns in a fixed order, sorted."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    return df.select(*columns).orderBy(*order)


def archive(df: DataFrame, path: str, ts: str, before: str) -> DataFrame:
    """Write rows of days before `before` into an archive by day, and return the rest, rows without a time included."""
    day = F.to_date(ts)
    write_partitioned(df.where(day < F.lit(before)).withColumn("day", day), path, ["day"])
    return df.where(F.coalesce(day >= F.lit(before), F.lit(True)))


def archive_table(spark: SparkSession, source: str, path: str, before: str) -> None:
    """Move the days before `before` of a table partitioned by day into the archive, then delete their partitions from the source (S14). A day goes only once its copy is written, so a run cut off can be run again."""
    table = scan_parquet(spark, source)
    write_partitioned(table.where(F.col("day") < F.lit(before)), path, ["day"])
    past = [str(r.day) for r in table.select("day").where(F.col("day") < F.lit(before)).distinct().collect()]
    for day in past:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/day={day}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialise_day(df: DataFrame, path: str, date: str, value: str) -> None:
    """Replace one day of a table partitioned by day."""
    write_partitioned(df.where(F.col(date) == F.lit(value)), path, [date])


def runner_facts(national: DataFrame, local: DataFrame, first: str, last: str, date: str = "race_date") -> DataFrame:
    """Two sources, each with its own filter pushed into its scan, under one source column."""
    within = F.col(date).between(F.lit(first), F.lit(last))
    return J.union_all([national.where(within).withColumn("source", F.lit("national")), local.where(within).withColumn("source", F.lit("local"))])
