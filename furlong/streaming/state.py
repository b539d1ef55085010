"""Snapshot streams: change detection, latest value, monotonic merge, incidents; the same rules on batches and as streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, kind: str = "parquet", files: int = 1000) -> DataFrame:
    """A file source; `files` bounds what one micro-batch takes up."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(kind).load(path)


def drain(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now, then stop; sink gets each micro-batch."""
    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def append(df: DataFrame, path: str, checkpoint: str, kind: str = "parquet") -> None:
    """Snapshot ingest: a stream appended to a table of files, each row once."""
    df.writeStream.format(kind).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def changed(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Rows whose values differ from the key's row before, and each key's first (T2, batch); null equals null."""
    w = W.partitionBy(*keys).orderBy(*order)
    now = F.struct(*values)
    return df.withColumns({"_was": F.lag(now).over(w), "_n": F.row_number().over(w)}).where((F.col("_n") == 1) | ~F.col("_was").eqNullSafe(now)).drop("_was", "_n")


def changed_stream(stream: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """T2 as keyed state: rows of a key are taken in order within a micro-batch, and compared with the last kept value across them."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    types = dict(stream.dtypes)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(list(order))
        last = state.get[0] if state.exists else None
        known = state.exists
        kept = []
        for i, v in enumerate(rows[value].tolist()):
            v = None if pd.isna(v) else float(v)
            if not known or v != last:
                kept.append(i)
            last, known = v, True
        state.update((last,))
        yield rows.iloc[kept]

    out = ", ".join(f"{c} {t}" for c, t in types.items())
    return stream.groupBy(key).applyInPandasWithState(step, out, "last double", "append", GroupStateTimeout.NoTimeout)


def merge_cards(df: DataFrame, keys: Sequence[str], at: str, complete: str, finish: str, fields: Sequence[str]) -> DataFrame:
    """The monotonic merge (T5) over any set of snapshots, whatever their order of arrival.

    Newer wins; at equal time a complete snapshot is never replaced by an incomplete one; older ones only fill what is
    null or ''; a finish above 0 is never replaced by 0. The rule is a fold by priority, so it is an aggregate: for each field the value of the
    first snapshot by (time, complete) that has one.
    """
    rank = F.struct(F.col(at), F.col(complete).cast("int"))
    types = dict(df.dtypes)
    pick = lambda c, there: F.max_by(F.when(there, F.col(c)), F.when(there, F.struct(rank, F.col(c)))).alias(c)
    there = lambda c: F.col(c).isNotNull() & (F.col(c) != "" if types[c] == "string" else F.lit(True))
    return df.groupBy(*keys).agg(F.max(at).alias(at), F.max_by(F.col(complete), rank).alias(complete), F.coalesce(F.max_by(F.when(F.col(finish) > 0, F.col(finish)), F.when(F.col(finish) > 0, F.struct(rank, F.col(finish)))), F.max(F.when(F.col(finish) == 0, 0))).alias(finish), *(pick(c, there(c)) for c in fields))


def merge_cards_stream(stream: DataFrame, keys: Sequence[str], at: str, complete: str, finish: str, fields: Sequence[str]) -> DataFrame:
    """T5 as keyed state: the same aggregate over a stream, whose buffers (for each field the best time, complete and value so far) are the state of a key. A micro-batch gives the merged card of every key it touches (update mode), equal to merge_cards over all snapshots until then."""
    return merge_cards(stream.select(*keys, at, complete, finish, *fields), keys, at, complete, finish, fields)


def log_batch(path: str, keys: Sequence[str] = (), at: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that keeps a log: each micro-batch (with keys, its newest row of each) is written under its own number. Its cost is that of the batch, and a batch run again gives the same."""
    from ..operators import joins as J

    def sink(batch: DataFrame, number: int) -> None:
        (J.latest(batch, keys, at) if keys else batch).write.mode("overwrite").parquet(f"{path}/_batch={number}")

    return sink


def compacted(spark: SparkSession, path: str) -> int | None:
    """The last micro-batch that a finished compaction of a log holds; None without one."""
    marks = spark._jvm.org.apache.hadoop.fs.Path(f"{path}_base/upto=*/_SUCCESS")
    found = marks.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(marks) or []
    return max((int(x.getPath().getParent().getName().split("=")[1]) for x in found), default=None)


def _log(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest finished compaction, and of the micro-batches after it."""
    upto, rows = compacted(spark, path), spark.read.parquet(path)
    if upto is None:
        return rows
    return rows.where(F.col("_batch") > upto).unionByName(spark.read.parquet(f"{path}_base/upto={upto}"))


def compact(spark: SparkSession, path: str, keys: Sequence[str], at: Sequence[str] = ("_batch",)) -> int | None:
    """Fold a log's micro-batches into one table of each key's newest row, beside the log, and give the last one folded (None for an empty log).

    Only what came since the last compaction is read, and that compaction. Readers take a compaction once it is finished; one that is cut off has no
    mark, and is written again. Micro-batches up to the one given, and older compactions, can then be deleted, when no reader still uses them.
    """
    from ..operators import joins as J

    rows = _log(spark, path)
    upto = spark.read.parquet(path).agg(F.max("_batch")).first()[0]
    if upto is not None and upto != compacted(spark, path):
        J.latest(rows, keys, at).write.mode("overwrite").parquet(f"{path}_base/upto={upto}")
    return upto


def read_latest(spark: SparkSession, path: str, keys: Sequence[str], at: Sequence[str] = ("_batch",)) -> DataFrame:
    """Each key's newest row in a log (T3): by `at`, or by the micro-batch that wrote it. Compacted micro-batches are not opened."""
    from ..operators import joins as J

    return J.latest(_log(spark, path), keys, at).drop("_batch")


def slot_due(df: DataFrame, keys: Sequence[str], ts: str, now: str, minutes: int) -> DataFrame:
    """Fetch slots (T8): each key's last fetch aligned to slots of `minutes`, and whether the slot of `now` has none yet. Fetches after `now` do not count."""
    slot = lambda t: F.floor(F.unix_timestamp(t) / (60 * minutes))
    at = F.to_timestamp(F.lit(now))
    last = df.groupBy(*keys).agg(F.max(F.when(F.col(ts) <= at, F.col(ts))).alias("last"))
    return last.withColumns({"slots_missed": slot(at) - slot(F.col("last")), "due": F.coalesce(slot(F.col("last")) < slot(at), F.lit(True))})


def coverage_gaps(due: DataFrame, present: DataFrame, attempts: DataFrame, keys: Sequence[str], start: str, tried: str, now: str, retry_days: int) -> DataFrame:
    """What should be there and is not (T9), before or after its start, and whose last attempt is retry_days or longer ago, or was never made."""
    from ..operators import joins as J

    at = F.to_date(F.lit(now))
    last = attempts.groupBy(*keys).agg(F.max(tried).alias("_tried"))
    gaps = J.without(due, present, keys).join(last, list(keys), "left").where(F.col("_tried").isNull() | (F.date_diff(at, F.col("_tried")) >= retry_days))
    return gaps.drop("_tried").withColumn("phase", F.when(F.col(start) > at, "before").otherwise("after"))


def dedupe(stream: DataFrame, id: str, ts: str, delay: str = "10 minutes") -> DataFrame:
    """Each event id once, within the watermark."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([id])


def incidents(df: DataFrame, key: Sequence[str], at: Sequence[str], bad, open_after: int = 2, close_after: int = 2) -> DataFrame:
    """Open and close times of incidents (T13): opened by `open_after` bad signals in a row, closed by `close_after` good ones. A null signal is a good one."""
    w = W.partitionBy(*key).orderBy(*at)
    df = df.withColumn("_bad", F.coalesce(bad, F.lit(False)).cast("int"))
    run = lambda n, v: F.when(F.count("*").over(w.rowsBetween(-n + 1, 0)) == n, F.sum("_bad").over(w.rowsBetween(-n + 1, 0)) == v).otherwise(False)
    signal = F.when(run(open_after, open_after), "open").when(run(close_after, 0), "close")
    marked = df.withColumn("_s", signal).where(F.col("_s").isNotNull())
    return marked.withColumn("_was", F.coalesce(F.lag("_s").over(w), F.lit("close"))).where("_s <> _was").withColumn("event", F.col("_s")).drop("_s", "_was", "_bad")


def incidents_stream(stream: DataFrame, key: Sequence[str], at: Sequence[str], bad, open_after: int = 2, close_after: int = 2) -> DataFrame:
    """T13 as keyed state (bad and good signals in a row, open or not): the same events as incidents() if each key's rows come in order from one micro-batch to the next."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(list(at), ignore_index=True)
        ill, well, is_open = state.get if state.exists else (0, 0, False)
        kept, events = [], []
        for i, sign in enumerate(rows.pop("_bad").tolist()):
            ill, well = (ill + 1, 0) if sign else (0, well + 1)
            if (well >= close_after) if is_open else (ill >= open_after):
                is_open = not is_open
                kept.append(i)
                events.append("open" if is_open else "close")
        state.update((ill, well, is_open))
        yield rows.iloc[kept].assign(event=events)

    out = ", ".join(f"{c} {t}" for c, t in stream.dtypes) + ", event string"
    signed = stream.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    return signed.groupBy(*key).applyInPandasWithState(step, out, "ill long, well long, is_open boolean", "append", GroupStateTimeout.NoTimeout)


def refresh(features: DataFrame, market: DataFrame, weights: DataFrame, by: str = "horse", at: Sequence[str] = ("ts",)) -> DataFrame:
    """Late binding (T11): the newest odds and body weights by `by`, and every feature that follows from them; all other features stay as they were made.

    market: by, at, odds. weights: by, at, body_weight. A runner without a newer value keeps its own. Made anew: odds, popularity (the place of the odds in the
    race), odds_score, implied_share, favourite_ratio; body_weight, weight_diff (from weight_avg5, which is history), carry_ratio, and the ranks of both.
    """
    from ..functions.scalars import odds_score
    from ..operators import joins as J

    def newest(snap: DataFrame, value: str) -> DataFrame:
        return J.latest(snap.where(F.col(value).isNotNull() & F.col(by).isNotNull()), [by], at).select(by, F.col(value).alias(f"_{value}"))

    rows = features.join(newest(market, "odds"), by, "left").join(newest(weights, "body_weight"), by, "left")
    rows = rows.withColumns({c: F.coalesce(f"_{c}", c) for c in ("odds", "body_weight")}).drop("_odds", "_body_weight")
    race = W.partitionBy("race_id")
    implied = F.try_divide(F.lit(1.0), F.col("odds"))
    order = race.orderBy(F.asc_nulls_last("odds"), by)
    field = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    # added up in one order, the heaviest first, as DuckDB's plan of t11_refresh does: the last bits of a sum decide where shares are halves when rounded
    heavy = race.orderBy(F.desc_nulls_last("body_weight"), F.asc_nulls_last("odds"), by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"popularity": F.row_number().over(order).cast("long"), "odds_score": odds_score("odds"), "implied_share": implied / F.sum(implied).over(heavy), "_second": F.nth_value("odds", 2).over(field)})
    rows = rows.withColumns({"favourite_ratio": F.min("odds").over(race) / F.col("_second"), "weight_diff": F.col("body_weight") - F.col("weight_avg5"), "carry_ratio": F.col("carried") / F.col("body_weight")})
    ranks = {f"{c}_rank": F.rank().over(race.orderBy(F.desc_nulls_last(c) if down else F.asc_nulls_last(c))).cast("long") for c, down in (("body_weight", True), ("carry_ratio", False))}
    return rows.withColumns(ranks).drop("_second")
