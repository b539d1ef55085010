"""Weighted rendezvous hashing of stable record keys over shards, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hexadecimal digits of an MD5 that make a uniform number: 13 digits are 52 bits, exact in a double.
DIGITS = 13
#: Sub-buckets of a shard within which rows are numbered; a count table of shards x BUCKETS rows joins the numbers up.
BUCKETS = 256


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    """-ln(u)/w with u uniform in (0, 1) from the key and the shard; the least cost wins, so a shard gets rows in proportion to w."""
    u = (F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, DIGITS), 16, 10).cast("double") + 0.5) / float(16**DIGITS)
    return -F.log(u) / weight


def _choice(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """struct(cost, shard) of the cheapest of the shards first, first + 1, ..."""
    shards = F.array(*[F.struct(F.lit(first + i).alias("shard"), F.lit(float(w)).alias("weight")) for i, w in enumerate(weights)])
    return F.array_min(F.transform(shards, lambda s: F.struct(_cost(key, s["shard"], s["weight"]).alias("cost"), s["shard"].alias("shard"))))


def assign(docs: DataFrame, shards: int | Sequence[float] = 40, grow_by: float | None = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Give every row of docs a shard by its key, and its place there.

    shards: their number, or their weights. Result: key, size (UTF-8 bytes of text plus 16),
    text_crc32, law ('key'), shard, slot (gapless from 0 in each shard), grown_shard (the shard with
    one more of weight grow_by: the old one or the new one, never another; null if grow_by is None).

    A null key is the key ''; its rows all share one shard, as every key's rows do, but are numbered in
    many sub-buckets. A null text has no bytes and CRC 0. Repeated rows each get their own slot.
    Other columns of docs are not read. No rows: no rows.
    """
    weights = [1.0] * shards if isinstance(shards, int) else [float(w) for w in shards]
    if not weights or min(weights) <= 0:
        raise ValueError("shards need positive weights")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_key"), name.alias("_name"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("_best", _choice(F.col("_name"), weights))
    bucket = F.conv(F.substring(F.md5(F.concat("_name", F.lit("/"), F.col("text_crc32").cast("string"))), 1, 2), 16, 10).cast("int")
    grown = F.lit(None).cast("int") if grow_by is None else F.when(_cost(F.col("_name"), F.lit(len(weights)), F.lit(float(grow_by))) < F.col("_best.cost"), F.lit(len(weights))).otherwise(F.col("_best.shard"))
    rows = rows.select("_key", "size", "text_crc32", F.col("_best.shard").alias("shard"), grown.cast("int").alias("grown_shard"), bucket.alias("_bucket"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("shard", "_bucket").orderBy("_key", "size", "text_crc32")
    numbered = rows.withColumn("_at", F.row_number().over(within)).join(offsets, ["shard", "_bucket"])
    return numbered.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_before") + F.col("_at") - 1).alias("slot"), "grown_shard")


#: The same result in DuckDB; CRC-32 by its table of 256 remainders, made from the polynomial.
ORACLE = """
WITH RECURSIVE step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END FROM step WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
base AS (
  SELECT doc_id, coalesce(doc_id::VARCHAR, '') AS name, encode(coalesce(text, '')) AS body FROM documents),
texts AS (
  SELECT body, list_prepend(4294967295::BIGINT, [('0x' || substr(hex(body), 2 * i::INT + 1, 2))::BIGINT FOR i IN range(octet_length(body))]) AS bytes
  FROM (SELECT DISTINCT body FROM base)),
crcs AS (SELECT body, xor(list_reduce(bytes, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT) AS text_crc32 FROM texts, crc),
costs AS (
  SELECT name, s, -ln((('0x' || substr(md5(name || ':' || s::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) AS cost
  FROM (SELECT DISTINCT name FROM base), range(41) t(s)),
best AS (
  SELECT name, arg_min(s, (cost, s)) FILTER (WHERE s < 40) AS shard, min(cost) FILTER (WHERE s < 40) AS cost, min(cost) FILTER (WHERE s = 40) AS new_cost
  FROM costs GROUP BY name)
SELECT doc_id, (octet_length(base.body) + 16)::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY substr(md5(name || '/' || text_crc32::VARCHAR), 1, 2), doc_id NULLS FIRST, octet_length(base.body), text_crc32) - 1)::BIGINT AS slot,
  (CASE WHEN new_cost < cost THEN 40 ELSE shard END)::INT AS grown_shard
FROM base JOIN crcs USING (body) JOIN best USING (name)
"""
