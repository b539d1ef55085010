"""Queries of sources and sinks (S) and of streaming (T). What needs a folder takes a new one for each run."""

from __future__ import annotations

import datetime
import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import quality as Q
from ..sources import tables as S
from ..sources.tables import folder
from ..streaming import state as T
from .registry import query
from .views import RUNS, entries, last, table

KEY = ("race_id", "horse")


#: Days of events that are written at a time; a watermark of one day more loses nothing.
DAYS = 10
LATE = f"{DAYS + 1} days"


def stream(spark, d, name: str = "events", times: int = 1):
    """The events as a stream of files in the order of time: written once into the shared folder, ten days after ten days, so that a key's rows come in several micro-batches; each row `times` times.

    A micro-batch takes as many files as a write has made on average: there are as many micro-batches at any size of the table.
    """
    path, df = folder(spark, "stream"), table(spark, d, name)
    day = F.to_date("ts")
    first, last = df.agg(F.min(day), F.max(day)).first()
    starts = [first + datetime.timedelta(k) for k in range(0, (last - first).days + 1, DAYS)] if first else [None]
    for k, start in enumerate(starts):
        within = F.lit(False) if start is None else (day >= F.lit(start)) & (day < F.lit(start + datetime.timedelta(DAYS)))
        part = df.where(within | F.isnull("ts") if k == 0 else within)
        for _ in range(times):
            part.repartition("user_id").write.mode("append").parquet(path)
    files = len(spark.read.schema(df.schema).parquet(path).inputFiles())
    return T.read_stream(spark, path, df.schema, files=max(1, math.ceil(files / (len(starts) * times))))


@query("s1_scan", "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM orders WHERE o_orderdate >= DATE '2001-01-01'", base=False)
def s1(spark, d):
    return S.scan_parquet(spark, f"{d}/orders.parquet").where("o_orderdate >= '2001-01-01'").select("o_orderkey", "o_orderpriority", "o_orderstatus")


@query("s2_write_partitioned", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders", base=False)
def s2(spark, d):
    path = folder(spark, "partitioned")
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    S.write_partitioned(o, path, ["o_orderstatus"])
    S.write_partitioned(o.where("o_orderstatus = 'F'"), path, ["o_orderstatus"])
    return S.scan_parquet(spark, path)


@query("s3_load_table", "SELECT n_nationkey, n_name FROM nation", base=False)
def s3(spark, d):
    return S.load_table(spark, "nation", root=d).select("n_nationkey", "n_name")


@query("s4_jsonl", "SELECT race_id, horse, score_b AS score FROM e")
def s4(spark, d):
    path = folder(spark, "jsonl")
    entries(spark, d).select(*KEY, F.col("score_b").alias("score")).write.json(path)
    return S.read_jsonl(spark, path, "race_id long, horse long, score double")


@query("s5_csv", "SELECT o_orderkey AS race_id, year(o_orderdate)::INT AS race_year, o_orderstatus AS status FROM orders WHERE year(o_orderdate) IN (1999, 2000)", base=False)
def s5(spark, d):
    path = folder(spark, "csv")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("race_id"), F.year("o_orderdate").alias("race_year"), F.col("o_orderstatus").alias("status")).write.option("header", True).csv(path)
    return S.read_csv(spark, path, "race_id long, race_year int, status string", [1999, 2000], "race_year")


EVENTS = "SELECT event_id, user_id, event_type, value FROM events"


@query("s6_stream_append", EVENTS, base=False)
def s6(spark, d):
    path = folder(spark, "sink")
    T.append(stream(spark, d).select("event_id", "user_id", "event_type", "value"), path, folder(spark, "progress"))
    return spark.read.parquet(path)


@query("s7_upsert", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer", base=False)
def s7(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey id", "c_acctbal balance")
    return Q.upsert(c, c.where("id % 3 = 0").withColumn("balance", F.col("balance") + 1), ["id"])


@query("s8_insert_missing", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'old' ELSE 'new' END AS state FROM customer", base=False)
def s8(spark, d):
    c = table(spark, d, "customer").selectExpr("c_custkey id")
    return Q.insert_missing(c.where("id % 3 = 0").withColumn("state", F.lit("old")), c.withColumn("state", F.lit("new")), ["id"])


@query("s9_payouts", "SELECT race_id, string_agg(horse_no::VARCHAR, '-' ORDER BY finish) AS numbers, (sum(odds) * 100)::INT AS payout, 1 AS popularity_rank FROM e WHERE finish <= 2 GROUP BY race_id")
def s9(spark, d):
    two = entries(spark, d).where("finish <= 2").groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct("finish", "horse_no"))).alias("l"), F.round(F.sum("odds") * 100).cast("int").alias("p"))
    nested = two.select("race_id", F.array(F.struct(F.transform("l", lambda x: x["horse_no"].cast("int")).alias("numbers"), F.col("p").alias("payout"), F.lit(1).alias("popularity_rank"))).alias("ticket"))
    return S.explode_payouts(nested, ["race_id"], "ticket")


@query("s10_hourly", "SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INT AS hour, value AS temperature, event_id AS code FROM events", base=False)
def s10(spark, d):
    by = table(spark, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("l"))
    packed = by.select("user_id", F.to_json(F.struct(F.transform("l", lambda x: x["value"]).alias("temperature"), F.transform("l", lambda x: x["event_id"]).alias("code"))).alias("j"))
    return S.explode_hourly(packed, ["user_id"], "j", {"temperature": "double", "code": "bigint"})


@query("s11_runner_facts", "SELECT race_id, horse, CASE WHEN venue < 10 THEN 'national' ELSE 'local' END AS source FROM e WHERE race_date BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'")
def s11(spark, d):
    e = entries(spark, d)
    return S.runner_facts(e.where("venue < 10"), e.where("venue >= 10"), "1999-01-01", "1999-12-31").select(*KEY, "source")


@query("s12_stamp", "SELECT race_id, horse, 'v7' AS feature_version, 'm3' AS model_version FROM e")
def s12(spark, d):
    return S.stamp(entries(spark, d).select(*KEY), feature_version="v7", model_version="m3")


@query("s13_export", "SELECT race_id, horse, odds, carried, finish FROM e")
def s13(spark, d):
    return S.export(entries(spark, d), [*KEY, "odds", "carried", "finish"], KEY)


@query("s14_archive", "SELECT event_id, 'kept' AS place FROM events WHERE ts::DATE >= DATE '2024-01-15' UNION ALL SELECT event_id, 'archive' FROM events WHERE ts::DATE < DATE '2024-01-15'", base=False)
def s14(spark, d):
    path = folder(spark, "archive")
    kept = S.archive(table(spark, d, "events"), path, "ts", "2024-01-15")
    return kept.select("event_id", F.lit("kept").alias("place")).unionByName(spark.read.parquet(path).select("event_id", F.lit("archive").alias("place")))


@query("s15_materialise_day", "SELECT race_id, horse, race_date FROM e WHERE race_date IN (DATE '1999-05-01', DATE '1999-05-02')")
def s15(spark, d):
    path, e = folder(spark, "days"), entries(spark, d).select(*KEY, "race_date")
    for day in ("1999-05-01", "1999-05-02"):
        S.materialise_day(e, path, "race_date", day)
    return spark.read.parquet(path).select(*KEY, F.to_date("race_date").alias("race_date"))


@query("s14_retention", "SELECT event_id, 'kept' AS place FROM events WHERE ts::DATE >= DATE '2024-01-15' UNION ALL SELECT event_id, 'archive' FROM events WHERE ts::DATE < DATE '2024-01-15'", base=False)
def s14r(spark, d):
    source, path = folder(spark, "snapshots"), folder(spark, "archive")
    S.write_partitioned(table(spark, d, "events").select("event_id", F.to_date("ts").alias("day")), source, ["day"])
    S.archive_table(spark, source, path, "2024-01-15")
    place = lambda at, name: S.scan_parquet(spark, at).select("event_id", F.lit(name).alias("place"))
    return place(source, "kept").unionByName(place(path, "archive"))


@query("t1_ingest", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type", base=False)
def t1(spark, d):
    path = folder(spark, "sink")
    T.append(stream(spark, d), path, folder(spark, "progress"))
    return spark.read.parquet(path).groupBy("event_type").agg(F.count("*").alias("n"))


@query("t2_changed", "SELECT event_id FROM (SELECT event_id, floor(value / 50) AS v, lag(floor(value / 50)) OVER w AS was, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)) WHERE n = 1 OR v IS DISTINCT FROM was", base=False)
def t2(spark, d):
    ev = table(spark, d, "events").withColumn("level", F.floor(F.col("value") / 50))
    return T.changed(ev, ["user_id", "event_type"], ["ts", "event_id"], ["level"]).select("event_id")


@query("t2_changed_stream", "SELECT event_id FROM (SELECT event_id, floor(value / 50) AS v, lag(floor(value / 50)) OVER w AS was, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE n = 1 OR v IS DISTINCT FROM was", base=False)
def t2s(spark, d):
    """The same rule as keyed state: each key's rows come in several micro-batches."""
    path = folder(spark, "sink")
    rows = stream(spark, d).select("user_id", "ts", "event_id", F.floor(F.col("value") / 50).cast("double").alias("level"))
    T.append(T.changed_stream(rows, "user_id", ["ts", "event_id"], "level"), path, folder(spark, "progress"))
    return spark.read.parquet(path).select("event_id")


@query("t3_latest", "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL", base=False)
def t3(spark, d):
    """A stream folded into a log of the newest rows of each micro-batch, of which each key's newest is read."""
    path = folder(spark, "latest")
    T.drain(stream(spark, d).select("user_id", "event_type", "ts", "event_id"), T.log_batch(path, ["user_id", "event_type"], ["ts", "event_id"]), folder(spark, "progress"))
    return T.read_latest(spark, path, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("t4_trends", "SELECT user_id, event_type, string_agg(event_id::VARCHAR, ',' ORDER BY ts, event_id) AS series FROM events GROUP BY ALL", base=False)
def t4(spark, d):
    points = F.array_sort(F.collect_list(F.struct("ts", "event_id")))
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.array_join(F.transform(points, lambda x: x["event_id"].cast("string")), ",").alias("series"))


CARDS = "SELECT user_id, event_type, ts, value > 30 AS complete, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 9 END AS finish, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'j' || event_id END AS jockey FROM events"


MERGED = f"WITH c AS ({CARDS}) SELECT user_id, event_type, max(ts) AS ts, coalesce(arg_max(finish, (ts, complete::INT, finish)) FILTER (WHERE finish > 0), max(0)) AS finish, arg_max(jockey, (ts, complete::INT, jockey)) FILTER (WHERE jockey <> '') AS jockey FROM c GROUP BY ALL"
CARD = ("user_id", "event_type", "ts", "value > 30 complete", "if(event_id % 3 = 0, 0, event_id % 9) finish", "if(event_id % 4 = 0, '', concat('j', event_id)) jockey")


@query("t5_merge", MERGED, base=False)
def t5(spark, d):
    c = table(spark, d, "events").selectExpr(*CARD)
    return T.merge_cards(c, ["user_id", "event_type"], "ts", "complete", "finish", ["jockey"]).select("user_id", "event_type", "ts", "finish", "jockey")


@query("t5_merge_stream", MERGED, base=False)
def t5s(spark, d):
    """The same rule as keyed state; each key's last card in the log of micro-batches is the merged one."""
    path, keys = folder(spark, "cards"), ["user_id", "event_type"]
    cards = T.merge_cards_stream(stream(spark, d).selectExpr(*CARD), keys, "ts", "complete", "finish", ["jockey"])
    T.drain(cards, T.log_batch(path), folder(spark, "progress"), "update")
    return T.read_latest(spark, path, keys).select(*keys, "ts", "finish", "jockey")


@query("t6_complete", "SELECT l_orderkey AS race_id, count(*) >= 4 AND count(*) = count(*) FILTER (WHERE l_returnflag <> 'R') AS complete FROM lineitem GROUP BY 1", base=False)
def t6(spark, d):
    saved = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("race_id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("ranked"))
    return saved.select("race_id", ((F.col("n") >= 4) & (F.col("n") == F.col("ranked"))).alias("complete"))


@query("t7_health", "SELECT event_type, count(*) AS n, date_diff('minute', max(ts), TIMESTAMP '2024-02-01 00:00:00') > 60 AS stale FROM events GROUP BY event_type", base=False)
def t7(spark, d):
    late = (F.unix_timestamp(F.to_timestamp(F.lit("2024-02-01 00:00:00"))) / 60).cast("long") - (F.unix_timestamp(F.max("ts")) / 60).cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), (late > 60).alias("stale"))


@query("t8_slots", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS slot, count(*) AS n FROM events GROUP BY 1", base=False)
def t8(spark, d):
    """Tumbling slots over a stream: each micro-batch gives the slots that it changes, and state behind the watermark goes."""
    path = folder(spark, "slots")
    counted = stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE).groupBy(F.window("ts", "6 hours")).agg(F.count("*").alias("n"))
    T.drain(counted.select(F.col("window.start").cast("timestamp_ntz").alias("slot"), "n"), T.log_batch(path), folder(spark, "progress"), "update")
    return T.read_latest(spark, path, ["slot"])


@query("t8_due", "SELECT user_id, max(ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-20 15:00:00') AS last, floor(epoch(TIMESTAMP '2024-01-20 15:00:00') / 21600)::BIGINT - floor(floor(epoch(max(ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-20 15:00:00'))) / 21600)::BIGINT AS slots_missed, coalesce(max(ts) FILTER (WHERE ts <= TIMESTAMP '2024-01-20 15:00:00') < TIMESTAMP '2024-01-20 12:00:00', true) AS due FROM events GROUP BY user_id", base=False)
def t8d(spark, d):
    return T.slot_due(table(spark, d, "events"), ["user_id"], "ts", "2024-01-20 15:00:00", 360)


@query("t9_gaps", "SELECT o_orderkey AS race_id, CASE WHEN o_orderdate > DATE '2001-07-20' THEN 'before' ELSE 'after' END AS phase FROM orders WHERE o_orderdate >= DATE '2001-07-01' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')", base=False)
def t9(spark, d):
    due = table(spark, d, "orders").where("o_orderdate >= '2001-07-01'").select(F.col("o_orderkey").alias("race_id"), F.when(F.col("o_orderdate") > "2001-07-20", "before").otherwise("after").alias("phase"))
    return J.without(due, table(spark, d, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("race_id")), ["race_id"])


@query("t9_retry", "SELECT o_orderkey AS race_id, o_orderdate::DATE AS starts, CASE WHEN o_orderdate::DATE > DATE '2001-07-20' THEN 'before' ELSE 'after' END AS phase FROM orders LEFT JOIN (SELECT l_orderkey AS k, max(l_shipdate::DATE) AS tried, count(*) FILTER (WHERE l_returnflag = 'A') AS n FROM lineitem GROUP BY 1) ON k = o_orderkey WHERE coalesce(n, 0) = 0 AND (tried IS NULL OR date_diff('day', tried, DATE '2001-07-20') >= 14)", base=False)
def t9r(spark, d):
    due = table(spark, d, "orders").select(F.col("o_orderkey").alias("race_id"), F.to_date("o_orderdate").alias("starts"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("race_id"), F.to_date("l_shipdate").alias("tried"), "l_returnflag")
    return T.coverage_gaps(due, lines.where("l_returnflag = 'A'").select("race_id"), lines.select("race_id", "tried"), ["race_id"], "starts", "tried", "2001-07-20", 14)


@query("t10_readiness", "SELECT race_id, count(*) AS expected, count(*) FILTER (WHERE horse % 5 > 0) AS present, CASE WHEN count(*) = count(*) FILTER (WHERE horse % 5 > 0) THEN 'ready' WHEN any_value(day) % 3 = 0 THEN 'late' ELSE 'waiting' END AS state FROM e GROUP BY race_id")
def t10(spark, d):
    e = entries(spark, d)
    c = J.coverage(e.select(*KEY, "day"), e.where("horse % 5 > 0"), KEY, ["race_id", "day"])
    return c.select("race_id", "expected", "present", F.when(F.col("missing") == 0, "ready").when(F.col("day") % 3 == 0, "late").otherwise("waiting").alias("state"))


@query("t11_late_binding", "SELECT race_id, horse, round(greatest(0, least(1, ln(greatest(coalesce(v, odds), 1)) / ln(300))), 6)::DOUBLE AS odds_score FROM e LEFT JOIN (SELECT user_id AS horse, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY user_id) USING (horse)")
def t11(spark, d):
    from ..functions.scalars import odds_score
    from .q_joins import j23

    return j23(spark, d).select(*KEY, F.round(odds_score("odds"), 6).alias("odds_score"))


@query("t11_refresh", f", a AS (SELECT *, avg(body_weight) {last(5)} AS weight_avg5 FROM {RUNS}), m AS (SELECT user_id AS horse, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_id % 2 = 0 GROUP BY user_id), k AS (SELECT user_id AS horse, arg_max(400 + value / 4, (ts, event_id)) AS b FROM events WHERE event_id % 2 = 1 GROUP BY user_id), f AS (SELECT a.* EXCLUDE (odds, body_weight), coalesce(v, odds) AS odds, coalesce(b, body_weight) AS body_weight FROM a LEFT JOIN m USING (horse) LEFT JOIN k USING (horse)), g AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY odds, horse) AS p FROM f) SELECT race_id, horse, p AS popularity, round(odds, 6) AS odds, round(greatest(0, least(1, ln(greatest(odds, 1)) / ln(300))), 6)::DOUBLE AS odds_score, round(1 / odds / sum(1 / odds) OVER w, 6) AS implied_share, round(min(odds) OVER w / max(CASE WHEN p = 2 THEN odds END) OVER w, 6) AS favourite_ratio, round(body_weight, 6) AS body_weight, round(body_weight - weight_avg5, 6) AS weight_diff, round(carried / body_weight, 9) AS carry_ratio, rank() OVER (PARTITION BY race_id ORDER BY body_weight DESC)::BIGINT AS body_weight_rank, rank() OVER (PARTITION BY race_id ORDER BY carried / body_weight)::BIGINT AS carry_ratio_rank, finish FROM g WINDOW w AS (PARTITION BY race_id)")
def t11r(spark, d):
    """Every column that follows from odds or body weight, made anew from the newest snapshots; history (weight_avg5) and results stay."""
    from ..functions.scalars import rounded
    from ..operators.history import last_before

    features = last_before(entries(spark, d), ["horse"], weight_avg5=(5, F.avg("body_weight")))
    ev = table(spark, d, "events").select(F.col("user_id").alias("horse"), "ts", "event_id", "value")
    market = ev.where("event_id % 2 = 0").withColumnRenamed("value", "odds")
    weights = ev.where("event_id % 2 = 1").withColumn("body_weight", 400 + F.col("value") / 4).drop("value")
    df = T.refresh(features, market, weights, at=("ts", "event_id"))
    return df.select("race_id", "horse", "popularity", *(rounded(c, n).alias(c) for c, n in {"odds": 6, "odds_score": 6, "implied_share": 6, "favourite_ratio": 6, "body_weight": 6, "weight_diff": 6, "carry_ratio": 9}.items()), "body_weight_rank", "carry_ratio_rank", "finish")


@query("t12_dedupe_stream", "SELECT DISTINCT event_id FROM events", base=False)
def t12(spark, d):
    sink = folder(spark, "sink")
    twice = stream(spark, d, times=2).select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    T.append(T.dedupe(twice, "event_id", "ts", LATE).select("event_id"), sink, folder(spark, "progress"))
    return spark.read.parquet(sink)


INCIDENTS = "WITH b AS (SELECT *, coalesce(value > 60, false)::INT AS bad FROM events), r AS (SELECT user_id, event_id, ts, sum(bad) OVER w AS s, count(*) OVER w AS n FROM b WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)), m AS (SELECT user_id, event_id, ts, CASE WHEN n = 2 AND s = 2 THEN 'open' WHEN n = 2 AND s = 0 THEN 'close' END AS event FROM r), f AS (SELECT *, coalesce(lag(event) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'close') AS was FROM m WHERE event IS NOT NULL) SELECT user_id, event_id, event FROM f WHERE event <> was"


@query("t13_incidents", INCIDENTS, base=False)
def t13(spark, d):
    return T.incidents(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], F.col("value") > 60).select("user_id", "event_id", "event")


@query("t13_incidents_stream", INCIDENTS, base=False)
def t13s(spark, d):
    path = folder(spark, "sink")
    rows = stream(spark, d).select("user_id", "ts", "event_id", "value")
    T.append(T.incidents_stream(rows, ["user_id"], ["ts", "event_id"], F.col("value") > 60), path, folder(spark, "progress"))
    return spark.read.parquet(path).select("user_id", "event_id", "event")


@query("t14_expected_counts", "SELECT day, n, round(avg(n) OVER (ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), 6) AS expected FROM (SELECT ts::DATE AS day, count(*) AS n FROM events GROUP BY 1)", base=False)
def t14(spark, d):
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return daily.select("day", "n", F.round(F.avg("n").over(W.orderBy("day").rowsBetween(-7, -1)), 6).alias("expected"))


@query("t15_live_card", "SELECT race_id, horse, coalesce(v, odds) AS odds, CASE WHEN field_size <= 8 THEN horse_no END::INT AS frame FROM e LEFT JOIN (SELECT user_id AS horse, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY user_id) USING (horse) WHERE field_size <= 8")
def t15(spark, d):
    from ..functions.scalars import frame
    from .q_joins import j23

    e = entries(spark, d).where("field_size <= 8").select(*KEY, frame("horse_no", "field_size").alias("frame"))
    return J.attach(e, j23(spark, d), KEY).select(*KEY, "odds", "frame")
