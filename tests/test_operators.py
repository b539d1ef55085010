"""Operators on hand-made rows: one case for each trap."""

from pyspark.sql import functions as F

from furlong.functions import scalars as S
from furlong.operators import history as H
from furlong.operators import joins as J
from furlong.operators import metrics as M
from furlong.operators import models as MD
from furlong.operators import quality as Q
from furlong.operators import relative as R
from furlong.operators import trees as TR
from furlong.sources import tables
from furlong.streaming import state as T


def one(df, *cols):
    return [tuple(r) for r in df.orderBy(*df.columns[:2]).select(*cols).collect()]


def test_same_day_rows_do_not_leak(spark):
    df = spark.createDataFrame([("s", 1, 1, 1), ("s", 1, 2, 0), ("s", 2, 3, 0)], "sire string, day int, race_id int, win int")
    assert one(H.expanding(df, ["sire"], rate=F.avg("win")), "rate") == [(None,), (None,), (0.5,)]


def runner(spark, rows):
    """horse, trainer, day, race_id, value as a runner table."""
    return spark.createDataFrame(rows, "horse string, trainer string, day int, race_id long, value int").withColumn("race_date", F.date_add(F.lit("1970-01-01"), F.col("day")))


def test_last_runs_leave_the_day_out(spark):
    """Two runs of one day see neither each other, nor their day's others, whatever the order; the day after sees both."""
    df = runner(spark, [("a", None, 5, 1, 10), ("a", None, 5, 2, 20), ("a", None, 9, 3, 30), ("a", None, 9, 4, 40), ("a", None, 12, 5, 50), (None, None, 13, 6, 60), (None, None, 14, 7, 70)])
    got = H.last_before(df, ["horse"], mean=(3, F.avg("value")), last=(1, F.max("value")), all=(10, F.collect_list("value"))).orderBy("race_id").collect()
    assert [r.mean for r in got] == [None, None, 15.0, 15.0, 30.0, None, None]
    assert [r["last"] for r in got] == [None, None, 20, 20, 40, None, None]
    assert [r["all"] for r in got] == [None, None, [10, 20], [10, 20], [10, 20, 30, 40], None, None]


def test_last_runs_equal_a_plain_loop(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("abc"), "t", rng.randrange(12), i, rng.choice([None, 1, 2, 3, 4])) for i in range(120)]
    got = H.last_before(runner(spark, rows), ["horse"], n=(4, F.count("value")), total=(4, F.sum("value")), five=(5, F.collect_list("value"))).collect()
    assert len(got) == len(rows)
    for r in got:
        past = sorted((x for x in rows if x[0] == r.horse and x[2] < r.day), key=lambda x: (x[2], x[3]))
        four = [x[4] for x in past[-4:] if x[4] is not None]
        assert (r.n or 0) == len(four) and r.total == (sum(four) if four else None)
        assert (r.five or []) == [x[4] for x in past[-5:] if x[4] is not None]


def test_quartiles_of_short_arrays(spark):
    df = spark.createDataFrame([([],), ([1.0],), ([1.0, 3.0],), ([1.0, 2.0, 10.0, 20.0, 21.0],)], "a array<double>")
    assert [tuple(r) for r in df.select(H.quartile(F.col("a"), 0.25), H.quartile(F.col("a"), 0.75)).collect()] == [(None, None), (1.0, 1.0), (1.5, 2.5), (2.0, 20.0)]


def test_cube_equals_plain_loops_and_keeps_rows(spark):
    """Means, counts and sums of several groupings; a row without an entity keeps its place; texts that hold separators stay apart."""
    import random

    rng = random.Random(2)
    names = [None, "x", "1:x", "x,1:y", "y", ""]
    rows = [(rng.choice(["a", "b", None]), rng.choice(names), rng.randrange(90), i, rng.choice([None, 0, 1])) for i in range(200)]
    df = runner(spark, rows).withColumn("arm", F.lit("kept"))
    cells = {"m": H.Cell(("horse",), "v"), "n": H.Cell(("horse", "trainer"), "v", "count"), "s": H.Cell(("trainer",), "v", "sum", days=20), "q": H.Cell(("trainer",), "v", least=3), "c": H.Cell(("trainer",), "v", "count", monthly=True)}
    got = H.cube(df, {"v": F.col("value")}, cells, key=("race_id",)).collect()
    by_days = H.cube(df, {"v": F.col("value")}, cells, key=("race_id",), many=()).collect()
    assert sorted(map(repr, map(sorted, (r.asDict().items() for r in got)))) == sorted(map(repr, map(sorted, (r.asDict().items() for r in by_days))))
    assert len(got) == len(rows) and all(r.arm == "kept" for r in got)

    def past(r, by, days=None, monthly=False):
        key = lambda x: tuple({"horse": x[0], "trainer": x[1]}[b] for b in by)
        own = tuple(r[b] for b in by)
        if None in own:
            return None
        month = lambda day: 0 if day < 31 else 1 if day < 59 else 2
        return [x[4] for x in rows if key(x) == own and x[4] is not None and (month(x[2]) < month(r.day) if monthly else x[2] < r.day and (days is None or r.day - x[2] <= days))]

    for r in got:
        m, n, s, q, c = past(r, ["horse"]), past(r, ["horse", "trainer"]), past(r, ["trainer"], 20), past(r, ["trainer"]), past(r, ["trainer"], monthly=True)
        assert r.m == (sum(m) / len(m) if m else None)
        assert r.n == (None if n is None else len(n)) and r.s == (None if s is None else sum(s)) and r.c == (None if c is None else len(c))
        assert r.q == (sum(q) / len(q) if q and len(q) > 3 else None)


def test_layers_keep_runners_without_entities(spark):
    """A runner without a jockey, trainer, sire or damsire keeps its row in every layer that rates them."""
    from furlong.plans import layers as L
    from furlong.plans.views import entries

    e = entries(spark, "/root/testdata/sf0.001").where("race_id < 200")
    gone = e.withColumns({c: F.when(F.col("horse") % 3 > 0, F.col(c)) for c in ("jockey", "trainer", "sire", "damsire", "owner")})
    n = gone.count()
    for layer in (L.jockey_trainer, L.pedigree, L.near_miss, L.going_pedigree, L.trainer_affinity, L.fade, L.heatmap, L.cells, L.sire_venue, L.trainer_flat, L.jockey_triple):
        assert layer(gone).count() == n, layer.__name__
    rates = L.trainer_affinity(gone).where("trainer is null")
    assert rates.count() and rates.where("trainer_class is not null").count() == 0


def test_layers_plan_their_source_once(spark):
    from furlong.plans import layers as L
    from furlong.plans.views import entries

    e = entries(spark, "/root/testdata/sf0.001")
    for layer in (L.jockey_trainer, L.pedigree, L.near_miss, L.going_pedigree, L.fade, L.heatmap):
        plan = layer(e)._jdf.queryExecution().executedPlan().toString()
        assert "lineitem.parquet" not in plan and plan.count("Exchange") <= 8, layer.__name__


def test_future_rows_change_nothing(spark):
    rows = [("h", d, d, d % 2) for d in range(1, 8)]
    schema = "horse string, day int, race_id int, win int"
    past = one(H.expanding(spark.createDataFrame(rows[:5], schema), ["horse"], rate=F.avg("win")), "day", "rate")
    assert one(H.expanding(spark.createDataFrame(rows, schema), ["horse"], rate=F.avg("win")), "day", "rate")[:5] == past


def test_asof_join_strict_or_not(spark):
    left = spark.createDataFrame([("a", 5), ("a", 3), ("b", 1)], "k string, t int")
    right = spark.createDataFrame([("a", 3, 30), ("a", 4, 40)], "k string, t int, v int")
    assert sorted((r.k, r.t, r.v) for r in H.asof_join(left, right, ["k"], "t", ["v"]).collect()) == [("a", 3, None), ("a", 5, 40), ("b", 1, None)]
    assert ("a", 3, 30) in [(r.k, r.t, r.v) for r in H.asof_join(left, right, ["k"], "t", ["v"], strict=False).collect()]


def test_correlation_of_constants_is_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(M.safe_corr("x", "y").alias("c")).first().c is None


def test_rank_norm_alone_and_tied(spark):
    df = spark.createDataFrame([(1, 7, 3.0), (2, 1, 5.0), (2, 2, 5.0), (2, 3, 1.0)], "race_id int, horse int, s double")
    assert one(R.rank_norm(df, "s", "n"), "n") == [(0.5,), (1.0,), (0.5,), (0.0,)]


def test_small_fields_leave_the_denominator(spark):
    df = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "race_id int, predicted_rank int, finish int")
    r = M.race_hits(df).first()
    assert r.top1 == 1 and r.rank4_exact is None and r.top3_box == 0


def test_frames_and_codes(spark):
    df = spark.createDataFrame([("3E8", " 012", 18, 18), ("FFF", "0000", 1, 19), ("x", "1a", 9, 8)], "h string, c string, no int, n int")
    rows = df.select(S.hex_number("h").alias("h"), S.code_number("c", scale=10).alias("c"), S.frame("no", "n").alias("f")).collect()
    assert [tuple(r) for r in rows] == [(1000, 1.2, 8), (None, None, None), (None, None, None)]


def test_truncated_packed_string(spark):
    df = spark.createDataFrame([("0102012340001" + "0103",), ("",)], "s string")
    rows = [r.u for r in df.select(S.unpack("s", 13, (2, 2, 5, 4)).alias("u")).collect()]
    assert rows == [[["01", "02", "01234", "0001"]], []]


def test_merge_cards_any_order(spark):
    schema = "k int, t int, complete boolean, finish int, jockey string"
    rows = [(1, 5, True, 2, ""), (1, 5, False, 0, "late"), (1, 3, True, 1, "old"), (2, 1, False, 0, None)]
    for r in (rows, rows[::-1]):
        got = {x.k: (x.t, x.complete, x.finish, x.jockey) for x in T.merge_cards(spark.createDataFrame(r, schema), ["k"], "t", "complete", "finish", ["jockey"]).collect()}
        assert got == {1: (5, True, 2, "late"), 2: (1, False, 0, None)}


def test_upsert_twice_is_upsert_once(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    u = spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string")
    once = Q.upsert(t, u, ["id"])
    assert sorted(map(tuple, Q.upsert(once, u, ["id"]).collect())) == sorted(map(tuple, once.collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_masters_lowest_priority_number_wins(spark):
    a, b = (spark.createDataFrame(r, "id int, name string") for r in ([(1, "x")], [(1, "y"), (2, "z")]))
    assert sorted(map(tuple, J.merge_masters([a, b], ["id"]).collect())) == [(1, "x"), (2, "z")]


def test_trees_route_missing_left(spark):
    df = spark.createDataFrame([(None,), (5.0,)], "x double")
    tree = {"feature": "x", "threshold": 3.0, "left": {"value": 1}, "right": {"value": 2}}
    assert [r.score for r in TR.score_forest(df, TR.from_nested([tree])).collect()] == [1.0, 2.0]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "race_id int, horse int, day int, finish int, s double")
    assert R.rank_norm(df, "s", "n").count() == H.recent_rank(df, ["horse"]).count() == M.race_hits(R.ordinal(df, "s")).count() == 0


def test_jdbc_table_is_read_in_ranges(spark):
    url = {"url": "jdbc:derby:memory:furlong;create=true", "driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(10).selectExpr("id", "id * id as square").write.format("jdbc").options(dbtable="squares", **url).save()
    got = tables.load_table(spark, "squares", "jdbc", partitionColumn="id", numPartitions="3", **url)
    assert got.rdd.getNumPartitions() == 3 and sorted(map(tuple, got.collect())) == [(i, i * i) for i in range(10)]


def test_incidents_as_a_stream_with_nulls(spark, tmp_path):
    rows = [("a", t, bad) for t, bad in enumerate([True, True, None, True, None, False, True, True, True])] + [("b", 0, True)]
    for k in range(0, 9, 3):
        spark.createDataFrame([r for r in rows if k <= r[1] < k + 3], "k string, t int, bad boolean").repartition(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = T.read_stream(spark, f"file://{tmp_path}/in", "k string, t int, bad boolean", files=1)
    T.append(T.incidents_stream(stream, ["k"], ["t"], F.col("bad")), f"file://{tmp_path}/out", f"file://{tmp_path}/progress")
    want = one(T.incidents(spark.createDataFrame(rows, "k string, t int, bad boolean"), ["k"], ["t"], F.col("bad")), "k", "t", "event")
    assert one(spark.read.parquet(f"file://{tmp_path}/out"), "k", "t", "event") == want == [("a", 1, "open"), ("a", 5, "close"), ("a", 7, "open")]


def test_cards_merged_as_a_stream(spark, tmp_path):
    """Late, blank and null snapshots, a finish of 0 after one above: the same as the batch rule."""
    rows = [("a", "2024-01-02 00:00:00", True, 3, "x"), ("a", "2024-01-01 00:00:00", False, 0, "old"), ("a", "2024-01-02 00:00:00", False, 5, "y"), ("a", None, True, None, ""), ("b", "2024-01-01 00:00:00", None, 0, None), ("b", "2024-01-03 00:00:00", False, None, "z"), ("c", None, None, None, None)]
    frame = lambda some: spark.createDataFrame(some, "k string, at string, full boolean, finish long, jockey string").selectExpr("k", "cast(at as timestamp_ntz) at", "full", "finish", "jockey")
    for r in rows:
        frame([r]).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = T.read_stream(spark, f"file://{tmp_path}/in", frame(rows).schema, files=1)
    T.drain(T.merge_cards_stream(stream, ["k"], "at", "full", "finish", ["jockey"]), T.log_batch(f"file://{tmp_path}/log"), f"file://{tmp_path}/progress", "update")
    cols = ("k", "at", "full", "finish", "jockey")
    assert one(T.read_latest(spark, f"file://{tmp_path}/log", ["k"]), *cols) == one(T.merge_cards(frame(rows), ["k"], "at", "full", "finish", ["jockey"]), *cols)


def test_card_state_is_an_aggregate_and_micro_batches_are_as_many_at_any_size(spark, tmp_path):
    """No Python runs for each key, and a write of four files is one micro-batch, not four."""
    from furlong.plans import q_streams

    rows = spark.range(600).selectExpr("id event_id", "cast(timestampadd(HOUR, cast(id as int), timestamp '2024-01-01 00:00:00') as timestamp_ntz) ts", "id % 40 user_id", "'view' event_type", "id % 90 * 1D value", "'' props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stream = q_streams.stream(spark, str(tmp_path))
        batches = []
        T.drain(stream, lambda batch, number: batches.append(batch.count()), f"file://{tmp_path}/progress")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert batches == [240, 240, 120]
    cards = T.merge_cards_stream(stream.selectExpr(*q_streams.CARD), ["user_id", "event_type"], "ts", "complete", "finish", ["jockey"])
    assert "Pandas" not in cards._jdf.queryExecution().analyzed().toString()


def test_percentiles_equal_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [(g, float(rng.integers(0, 9)) if g == "a" else float(rng.normal()), int(rng.integers(0, 50))) for g in ["a"] * 40 + ["b"] * 7 + [None] * 5 + ["one"]]
    rows += [("a", None, 1), ("a", float("nan"), 1), ("none", None, 3), ("none", float("nan"), None)]
    got = {r.g: r for r in M.percentiles(spark.createDataFrame(rows, "g string, x double, n int"), ["g"], low=("x", 0.25), mid=("x", 0.5), top=("x", 0.9), n=("n", 0.5)).collect()}
    assert set(got) == {"a", "b", None, "one", "none"}
    for g, r in got.items():
        x = [v for k, v, _ in rows if k == g and v is not None and v == v]
        n = [v for k, _, v in rows if k == g and v is not None]
        assert all((r[name] is None) if not x else abs(r[name] - np.quantile(x, q)) < 1e-12 for name, q in (("low", 0.25), ("mid", 0.5), ("top", 0.9)))
        assert r.n == np.quantile(n, 0.5)


def test_late_binding_touches_what_follows_from_it_only(spark):
    rows = [(1, "a", 4.0, 450.0, 55.0, 448.0, "kept"), (1, "b", 2.0, 460.0, 56.0, None, "kept"), (1, "c", 9.0, None, 57.0, 440.0, "kept"), (2, "a", 3.0, 450.0, 55.0, 448.0, None)]
    f = spark.createDataFrame(rows, "race_id int, horse string, odds double, body_weight double, carried double, weight_avg5 double, source string")
    market = spark.createDataFrame([("a", 1, 8.0), ("a", 2, 1.0), ("b", 3, None), (None, 9, 1.5)], "horse string, ts int, odds double")
    weights = spark.createDataFrame([("c", 1, 444.0)], "horse string, ts int, body_weight double")
    got = {(r.race_id, r.horse): r for r in T.refresh(f, market, weights).collect()}
    assert len(got) == 4
    a, b, c = got[1, "a"], got[1, "b"], got[1, "c"]
    assert (a.odds, a.popularity, a.odds_score) == (1.0, 1, 0.0) and (b.odds, b.popularity) == (2.0, 2) and c.popularity == 3
    assert abs(a.implied_share - 1 / (1 + 1 / 2 + 1 / 9)) < 1e-12 and a.favourite_ratio == 0.5 and got[2, "a"].favourite_ratio is None
    assert c.body_weight == 444.0 and c.weight_diff == 4.0 and b.weight_diff is None and a.weight_diff == 2.0
    assert [r.body_weight_rank for r in (a, b, c)] == [2, 1, 3] and all(r.source == "kept" for r in (a, b, c))


def test_rounded_equals_duckdb_next_to_halves(spark):
    """Values within an ulp of a half of the last digit, either sign; what is not finite or too large to scale stays."""
    import math

    import duckdb

    halves = [(k + 0.5) / 10**6 for k in range(0, 400_000, 997)]
    values = [y for x in halves for y in (x, math.nextafter(x, 0), math.nextafter(x, 1), -x)] + [0.0, 1e300, float("inf"), None]
    got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(S.rounded("x", 6)).collect()]
    con = duckdb.connect()
    con.execute("create table t (i int, x double)")
    con.executemany("insert into t values (?, ?)", list(enumerate(values)))
    assert got == [r[0] for r in con.execute("select round(x, 6) from t order by i").fetchall()]


def test_rates_of_layers_round_as_their_sql(spark):
    """Shares of 5,120 and 25,600 runs, as a trainer has at 1 GB, are halves of the ninth digit."""
    import duckdb

    from furlong.plans.q_layers import out

    shares = [(k, n) for n in (1024, 5120, 25600) for k in range(1, 400, 2)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(shares)], "race_id int, k int, n int").selectExpr("race_id", "race_id horse", "k / n rate")
    con = duckdb.connect()
    got = {r.race_id: r.rate for r in out(df, "rate").collect()}
    assert got == {i: con.execute(f"select round({k} / {n}::double, 9)").fetchall()[0][0] for i, (k, n) in enumerate(shares)}


def test_shares_are_added_up_from_the_heaviest(spark):
    """0.1, 0.2 and 0.3 add up to another number in another order: the order is that of the weights, not of the rows or the odds."""
    odds, want = [10.0, 5.0, 10 / 3], {}
    for k, by in enumerate(((0, 1, 2), (2, 1, 0), (1, 2, 0), (0, 2, 1))):
        total = 0.0
        for i in by:
            total += 1 / odds[i]
        want |= {(k, i): 1 / odds[i] / total for i in by}
    rows = [(k, i, odds[i], 500.0 - by.index(i), 55.0, None) for k, by in enumerate(((0, 1, 2), (2, 1, 0), (1, 2, 0), (0, 2, 1))) for i in range(3)]
    f = spark.createDataFrame(rows, "race_id int, horse int, odds double, body_weight double, carried double, weight_avg5 double")
    none = lambda c: spark.createDataFrame([], f"horse int, ts int, {c} double")
    got = {(r.race_id, r.horse): r.implied_share for r in T.refresh(f, none("odds"), none("body_weight")).collect()}
    assert got == want and len(set(want.values())) > 3


def test_more_cells_cost_no_more_scans(spark):
    """Seven groupings read the written runners as often as one does."""
    one = spark.createDataFrame([(1, 1, 1, 1, 1, 1)], "race_id int, horse int, trainer int, venue int, day int, finish int").withColumn("race_date", F.current_date())
    by = [("trainer",), ("venue",), ("horse",), ("trainer", "venue"), ("trainer", "horse"), ("venue", "horse"), ("trainer", "venue", "horse")]
    scans = [H.cube(one, {"v": F.col("finish")}, {f"r{k}": H.Cell(c, "v") for k, c in enumerate(by[:n])}, many=())._jdf.queryExecution().analyzed().toString().count("Relation") for n in (1, 7)]
    assert scans[0] == scans[1] <= 3


def test_large_groupings_are_looked_up_by_entity_and_day(spark, monkeypatch):
    """With all, some or none of the groupings broadcast the cube is the same, runners are one scan, and their rows are laid out in no join."""
    rows = [(r, h, t, v, s, d, (r + h) % 4) for r in range(12) for h in range(5) for t, v, s, d in [((r + h) % 3, r % 2, "ab"[h % 2] if h < 4 else None, r // 2)]]
    df = spark.createDataFrame(rows, "race_id int, horse int, trainer int, venue int, surface string, day int, finish int").withColumn("race_date", F.date_add(F.lit("2000-01-20"), F.col("day") * 9))
    by = {"a": ("trainer",), "b": ("trainer", "venue"), "c": ("trainer", "surface"), "d": ("venue",)}
    cells = {f"{k}_{how}": H.Cell(c, "v", how) for k, c in by.items() for how in ("mean", "count", "sum")} | {"near": H.Cell(("trainer",), "v", days=2), "months": H.Cell(("trainer", "venue"), "v", monthly=True)}
    found = []
    for most in (0, 20, 10**6):
        monkeypatch.setattr(H, "MOST_SENT", most)
        made = H.cube(df, {"v": (F.col("finish") == 1).cast("int")}, cells)
        assert made._jdf.queryExecution().analyzed().toString().count("Generate") == 0
        found.append(one(made, "race_id", "horse", *cells))
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    for r, h, *got in found[0]:
        t, v, s, d = next(x[2:6] for x in rows if x[:2] == (r, h))
        past = [int(x[6] == 1) for x in rows if x[2] == t and x[3] == v and x[5] < d]
        assert got[list(cells).index("b_count")] == len(past) and got[list(cells).index("b_mean")] == (sum(past) / len(past) if past else None)
        assert (got[list(cells).index("c_count")] is None) == (s is None)


def test_style_features_shuffle_no_wide_rows(spark):
    """The last shuffle is by horse, before the columns of its runs are made."""
    from furlong.plans import layers as L

    rows = [(r, h, h % 3, h % 2, "s", "t", 1000, r, 4, h + 1, (h + r) % 4 + 1) for r in range(6) for h in range(4)]
    df = spark.createDataFrame(rows, "race_id int, horse int, jockey int, trainer int, sire string, surface string, distance int, day int, field_size int, corner1 int, finish int").withColumn("race_date", F.date_add(F.lit("2000-01-20"), F.col("day") * 9))
    made = L.style_features(df)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan[plan.index("Exchange hashpartitioning(") :].startswith("Exchange hashpartitioning(horse") and made.count() == len(rows)


def test_pools_are_aggregated_once_for_targets_that_share_them(spark):
    """The same as aggregates over fallback_match; pools, not targets, are what is joined to the rows of history."""
    import random

    draw = random.Random(8)
    rows = [(i, draw.randrange(30), draw.choice(["a", "b", None]), draw.randrange(2), draw.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "race_id int, day int, venue string, distance int, v double")
    targets, how = df.select(F.col("race_id").alias("key_id"), "venue", "distance", "day"), {"least": 10, "most": 20, "ties": ["race_id"], "look_back": 15}
    levels = [["venue", "distance"], ["distance"]]
    told = J.fallback_stats(targets, df, levels, {"n": F.count("h_race_id"), "far": F.sum(F.col("_day") - F.col("h_day")), "v": F.round(F.sum("h_v"), 9)}, **how)
    pool = J.fallback_match(targets, df, levels, **how).join(targets.select("key_id", "day"), "key_id")
    want = pool.groupBy("key_id", "level").agg(F.count("h_race_id").alias("n"), F.sum(F.col("day") - F.col("h_day")).alias("far"), F.round(F.sum("h_v"), 9).alias("v"))
    cols = ("key_id", "level", "n", "far", "v")
    assert one(told.fillna(0, ["n"]), *cols) == one(want, *cols) and told.count() == 300
    met, rows = J._pools(targets, df, levels, ["_day", "_last", "_first"], "day", 10, 20, ["race_id"], 15)
    assert rows.count() < pool.count() / 2


def test_capped_streak_equals_the_whole_one_up_to_its_cap(spark):
    import random

    from pyspark.sql import functions as F

    from furlong.operators import relative as R

    draw = random.Random(2)
    rows = [(h, d, d, draw.random() < 0.7) for h in range(5) for d in range(30)] + [(9, 1, 1, True)]
    df = spark.createDataFrame(rows, "horse int, day int, race_id int, hit boolean")
    both = R.streak_capped(R.streak(df, F.col("hit"), ["horse"], name="whole"), F.col("hit"), ["horse"])
    assert both.where("streak <> least(whole, 5)").count() == 0


def test_a_compacted_log_reads_the_same_from_fewer_files(spark, tmp_path):
    import shutil

    path = f"file://{tmp_path}/log"
    put = lambda n, rows: T.log_batch(path, ["k"], ["at"])(spark.createDataFrame(rows, "k string, at int, v string"), n)
    read = lambda: one(T.read_latest(spark, path, ["k"], ["at"]), "k", "at", "v")
    put(0, [("a", 1, "x"), ("a", 2, "y"), ("b", 5, None)])
    put(1, [("b", 4, "late"), (None, 1, "none")])
    want = [(None, 1, "none"), ("a", 2, "y"), ("b", 5, None)]
    assert T.compacted(spark, path) is None and read() == want
    assert T.compact(spark, path, ["k"], ["at"]) == 1 == T.compacted(spark, path) and read() == want
    put(2, [("a", 3, "z"), ("c", 1, "new")])
    shutil.rmtree(tmp_path / "log" / "_batch=0")
    shutil.rmtree(tmp_path / "log" / "_batch=1")
    want = [(None, 1, "none"), ("a", 3, "z"), ("b", 5, None), ("c", 1, "new")]
    assert read() == want
    # a compaction that was cut off has no mark and is not read
    (tmp_path / "log_base" / "upto=9").mkdir()
    assert read() == want and T.compact(spark, path, ["k"], ["at"]) == 2 == T.compact(spark, path, ["k"], ["at"])
    assert read() == want and T.compacted(spark, path) == 2
