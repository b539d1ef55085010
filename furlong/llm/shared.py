"""What the operators of this subpackage share: the shared folder, written cuts of a plan, lower-casing of A-Z, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower_ascii(text: str | None) -> str:
    """The text with A-Z, and nothing else, in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, where it is unset (tests, one machine), a new temporary one."""
    kept = spark.conf.get("spark.checkpoint.dir", None)
    if kept is None:
        here = spark.sparkContext.getCheckpointDir()
        if here is None:
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-furlong-"))
            here = spark.sparkContext.getCheckpointDir()
        kept = here
    return kept.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost executor costs no more than a re-read."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/furlong/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def local_path(uri: str) -> str:
    """file:///a/b as /a/b; other addresses stay."""
    return uri[7:] if uri.startswith("file://") else uri[5:] if uri.startswith("file:") else uri


def text_batches(column, most_rows: int = 2048, most_bytes: int = 8 << 20):
    """Slices (start, length) of an Arrow string column, each of bounded rows and bytes; one text longer than that stands alone."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and (i - start >= most_rows or total + n > most_bytes):
            yield start, i - start
            start, total = i, 0
        total += int(n)
    if len(sizes) > start:
        yield start, len(sizes) - start


def _pairs(edges: DataFrame) -> DataFrame:
    """Each edge once, smaller end first, without loops."""
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b): component is the smallest node reachable.

    Contraction: each round every node points to its smallest neighbour if that is smaller than itself. Pointers form trees, which pointer jumping (to what
    one's target points to) folds onto their roots in as many steps as the logarithm of their depth; then edges are
    redrawn between roots, and those within one tree vanish. So a chain of n nodes in order takes log n steps. Each step is written, so lineage stays short.
    """
    edges = cut(_pairs(edges), "edges")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        points = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "points")
        while True:
            jumped = cut(points.join(points.select(F.col("node").alias("to"), F.col("to").alias("root")), "to").select("node", F.col("root").alias("to"), (F.col("root") != F.col("to")).alias("moved")), "points")
            if jumped.where("moved").isEmpty():
                break
            points = jumped.select("node", "to")
        rounds.append(points)
        ends = edges
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            ends = ends.join(points.withColumnRenamed("node", end), end).select(F.col("to").alias(end), other)
        edges = cut(_pairs(ends), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[0].withColumnRenamed("to", "component")
    for points in rounds[1:]:
        found = found.join(points.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(found, "components")
