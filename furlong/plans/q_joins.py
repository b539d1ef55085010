"""Queries of the joins, set operations and top-k operators (J, U, K)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import relative as R
from ..sources.tables import cut
from .registry import query
from .views import entries, table

R6 = lambda c: F.round(c, 6)
KEY = ("race_id", "horse")


@query("j1_race_runner", "SELECT l_orderkey AS race_id, o_orderstatus AS surface, count(*) AS lines, round(sum(l_quantity), 2) AS quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL", base=False)
def j1(spark, d):
    joined = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "race_id").join(table(spark, d, "orders").withColumnRenamed("o_orderkey", "race_id"), "race_id")
    return joined.groupBy("race_id", F.col("o_orderstatus").alias("surface")).agg(F.count("*").alias("lines"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("j2_attach", "SELECT e.race_id, e.horse, s.s_name AS jockey_name FROM e LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON e.jockey = s.s_suppkey")
def j2(spark, d):
    side = table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("jockey"), F.col("s_name").alias("jockey_name"))
    return J.attach(entries(spark, d).select(*KEY, "jockey"), side, ["jockey"]).select(*KEY, "jockey_name")


@query("j7_pairs", "SELECT a.race_id, a.horse AS a_horse, b.horse AS b_horse, a.finish AS a_finish, b.finish AS b_finish FROM e a JOIN e b ON a.race_id = b.race_id AND a.horse < b.horse")
def j7(spark, d):
    return J.pairs_within(entries(spark, d), ["race_id"], "horse", ["finish"])


@query("j8_context", "SELECT venue, count(*) AS starts, round(count(*)::DOUBLE / (SELECT count(*) FROM e), 8) AS share FROM e GROUP BY venue")
def j8(spark, d):
    e = entries(spark, d)
    by = e.groupBy("venue").agg(F.count("*").alias("starts"))
    return J.with_context(by, e.agg(F.count("*").alias("all"))).select("venue", "starts", F.round(F.col("starts") / F.col("all"), 8).alias("share"))


@query("j9_rules", "SELECT p_partkey AS horse, rule FROM part JOIN (VALUES ('brand', 'STANDARD ANODIZED TIN', NULL), ('steel', NULL, 'STEEL'), ('small', NULL, 'SMALL')) r(rule, eq, co) ON p_type = eq OR (eq IS NULL AND contains(p_type, co))", base=False)
def j9(spark, d):
    rules = spark.createDataFrame([("brand", "STANDARD ANODIZED TIN", None), ("steel", None, "STEEL"), ("small", None, "SMALL")], "rule string, equals string, contains string")
    return J.rule_match(table(spark, d, "part"), rules, "p_type").select(F.col("p_partkey").alias("horse"), "rule")


@query("j11_anti", "SELECT race_id, horse FROM e WHERE jockey NOT IN (SELECT jockey FROM e WHERE finish = 1 AND race_year = 1995 AND venue = 3)")
def j11(spark, d):
    e = entries(spark, d)
    return J.without(e, e.where("finish = 1 and race_year = 1995 and venue = 3").select("jockey"), ["jockey"]).select(*KEY)


@query("j12_semi", ", h AS MATERIALIZED (SELECT DISTINCT l_partkey AS horse FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '2001-06-01') SELECT race_id, horse FROM e JOIN h USING (horse)")
def j12(spark, d):
    e = entries(spark, d)
    return J.focus(e, e.where("race_date >= '2001-06-01'").select("horse"), ["horse"]).select(*KEY)


@query("j13_outer", "SELECT coalesce(a.horse, b.horse) AS horse, wins, last_places FROM (SELECT horse, count(*) AS wins FROM e WHERE finish = 1 GROUP BY horse) a FULL JOIN (SELECT horse, count(*) AS last_places FROM e WHERE finish = field_size GROUP BY horse) b ON a.horse = b.horse")
def j13(spark, d):
    e = entries(spark, d)
    return J.outer_merge(e.where("finish = 1").groupBy("horse").agg(F.count("*").alias("wins")), e.where("finish = field_size").groupBy("horse").agg(F.count("*").alias("last_places")), ["horse"])


@query("j14_ancestors", "SELECT p_partkey AS horse, slot, name FROM (SELECT p_partkey, p_brand, p_type, split_part(p_name, ' ', 1) AS p_first FROM part) UNPIVOT (name FOR slot IN (p_brand, p_type, p_first)) WHERE name IN (SELECT p_brand FROM part WHERE p_size < 3 UNION SELECT p_type FROM part WHERE p_size < 3)", base=False)
def j14(spark, d):
    part = table(spark, d, "part").withColumn("p_first", F.split_part("p_name", F.lit(" "), F.lit(1)))
    some = part.where("p_size < 3")
    names = some.select(F.col("p_brand").alias("name")).union(some.select("p_type"))
    return J.match_any(part, ["p_partkey"], ["p_brand", "p_type", "p_first"], names).select(F.col("p_partkey").alias("horse"), "slot", "name")


@query("j15_masters", "SELECT k AS id, coalesce(a.name, b.name, c.name) AS name FROM (SELECT c_custkey AS k FROM customer UNION SELECT s_suppkey FROM supplier UNION SELECT p_partkey FROM part) LEFT JOIN (SELECT s_suppkey AS k, s_name AS name FROM supplier) a USING (k) LEFT JOIN (SELECT c_custkey AS k, c_name AS name FROM customer) b USING (k) LEFT JOIN (SELECT p_partkey AS k, p_name AS name FROM part) c USING (k)", base=False)
def j15(spark, d):
    one = lambda t, k, n: table(spark, d, t).select(F.col(k).alias("id"), F.col(n).alias("name"))
    return J.merge_masters([one("supplier", "s_suppkey", "s_name"), one("customer", "c_custkey", "c_name"), one("part", "p_partkey", "p_name")], ["id"])


@query("j16_fallback", """, t AS (SELECT DISTINCT race_id AS key_id, venue, distance, class, surface, day FROM e),
w AS (SELECT DISTINCT race_id, venue, distance, class, surface, day, time FROM e WHERE finish = 1),
c AS (SELECT t.key_id, count(*) FILTER (WHERE w.venue = t.venue AND w.class = t.class) AS n0, count(*) FILTER (WHERE w.venue = t.venue) AS n1, count(*) FILTER (WHERE w.surface = t.surface) AS n2 FROM t JOIN w ON w.distance = t.distance AND w.day < t.day AND w.day >= t.day - 1500 GROUP BY t.key_id),
l AS (SELECT t.*, CASE WHEN n0 >= 30 THEN 0 WHEN n1 >= 30 THEN 1 WHEN n2 >= 30 THEN 2 ELSE 3 END AS level FROM t LEFT JOIN c USING (key_id)),
p AS (SELECT key_id, level, w.race_id, w.time, row_number() OVER (PARTITION BY key_id ORDER BY w.day DESC, w.race_id) AS rn FROM l LEFT JOIN w ON w.distance = l.distance AND w.day < l.day AND w.day >= l.day - 1500 AND CASE level WHEN 0 THEN w.venue = l.venue AND w.class = l.class WHEN 1 THEN w.venue = l.venue WHEN 2 THEN w.surface = l.surface ELSE true END)
SELECT key_id, level, count(race_id) AS n, round(avg(time) + 1e-9, 6) AS mean_time FROM p WHERE rn <= 200 GROUP BY ALL""")
def j16(spark, d):
    e = cut(entries(spark, d).select("race_id", "venue", "distance", "class", "surface", "day", "finish", "time"), "similar")
    targets = e.select(F.col("race_id").alias("key_id"), "venue", "distance", "class", "surface", "day").distinct()
    winners = e.where("finish = 1").select("race_id", "venue", "distance", "class", "surface", "day", "time")
    found = J.fallback_match(targets, winners, [["venue", "distance", "class"], ["venue", "distance"], ["distance", "surface"], ["distance"]], ties=["race_id"], look_back=1500)
    return found.groupBy("key_id", "level").agg(F.count("h_race_id").alias("n"), R6(F.avg("h_time") + 1e-9).alias("mean_time"))


@query("j18_lookup", "SELECT race_id, n_name AS venue_name, r_name AS region FROM e JOIN nation ON venue = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE finish = 1")
def j18(spark, d):
    places = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("venue"), F.col("n_name").alias("venue_name"), F.col("r_name").alias("region"))
    return entries(spark, d).where("finish = 1").join(J.small(places), "venue", "left").select("race_id", "venue_name", "region")


@query("j19_reconcile", "SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_a' WHEN a.id IS NULL THEN 'only_b' ELSE 'both' END AS status, CASE WHEN a.id IS NOT NULL AND b.id IS NOT NULL THEN array_to_string(list_filter([CASE WHEN a.nation IS DISTINCT FROM b.nation THEN 'nation' END, CASE WHEN a.rich IS DISTINCT FROM b.rich THEN 'rich' END], lambda x: x IS NOT NULL), ',') ELSE '' END AS differing FROM (SELECT s_suppkey AS id, s_nationkey AS nation, s_acctbal > 0 AS rich FROM supplier) a FULL JOIN (SELECT c_custkey AS id, c_nationkey AS nation, c_acctbal > 0 AS rich FROM customer WHERE c_custkey % 3 > 0) b ON a.id = b.id", base=False)
def j19(spark, d):
    a = table(spark, d, "supplier").selectExpr("s_suppkey id", "s_nationkey nation", "s_acctbal > 0 rich")
    b = table(spark, d, "customer").where("c_custkey % 3 > 0").selectExpr("c_custkey id", "c_nationkey nation", "c_acctbal > 0 rich")
    return J.reconcile(a, b, ["id"], ["nation", "rich"])


@query("j20_coverage", "SELECT c_nationkey AS venue, count(*) AS expected, count(k) AS present, count(*) - count(k) AS missing FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F') ON c_custkey = k GROUP BY c_nationkey", base=False)
def j20(spark, d):
    expected = table(spark, d, "customer").selectExpr("c_custkey owner", "c_nationkey venue")
    return J.coverage(expected, table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey owner"), ["owner"], ["venue"])


@query("j21_latest_card", "SELECT user_id, v.event_id AS last_view, p.event_id AS last_purchase, p.value AS paid FROM (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY user_id) v LEFT JOIN (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events WHERE event_type = (SELECT max(event_type) FROM events) GROUP BY user_id) p USING (user_id)", base=False)
def j21(spark, d):
    ev = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    ends = ev.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi")).first()
    view = J.latest(ev.where(F.col("event_type") == ends["lo"]).select("user_id", "ts", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("last_view"))
    paid = J.latest(ev.where(F.col("event_type") == ends["hi"]).select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_id").alias("last_purchase"), F.col("value").alias("paid"))
    return view.join(paid, "user_id", "left")


@query("j22_peer_rank", "SELECT a.race_id, a.horse, (1 + count(b.horse))::BIGINT AS body_weight_rank FROM e a LEFT JOIN e b ON a.race_id = b.race_id AND b.body_weight > a.body_weight GROUP BY a.race_id, a.horse")
def j22(spark, d):
    """The reference's peer self join as a rank: no pairs."""
    return R.rank_in_race(entries(spark, d), {"body_weight": True}).select(*KEY, "body_weight_rank")


@query("j23_overlay", "SELECT race_id, horse, coalesce(v, odds) AS odds FROM e LEFT JOIN (SELECT user_id AS horse, arg_max(value, (ts, event_id)) AS v FROM events GROUP BY user_id) USING (horse)")
def j23(spark, d):
    snap = J.latest(table(spark, d, "events").select(F.col("user_id").alias("horse"), "ts", "event_id", "value"), ["horse"], ["ts", "event_id"])
    return J.attach(entries(spark, d).select(*KEY, "odds"), snap.select("horse", "value"), ["horse"]).select(*KEY, F.coalesce("value", "odds").alias("odds"))


@query("u1_union_all", "SELECT 'jockey' AS role, jockey AS id, count(*) AS starts FROM e GROUP BY jockey UNION ALL SELECT 'owner', owner, count(*) FROM e GROUP BY owner")
def u1(spark, d):
    e = entries(spark, d)
    arm = lambda role: e.groupBy(F.col(role).alias("id")).agg(F.count("*").alias("starts")).select(F.lit(role).alias("role"), "id", "starts")
    return arm("jockey").unionByName(arm("owner"))


@query("u2_distinct", "SELECT DISTINCT sire, venue FROM e")
def u2(spark, d):
    return entries(spark, d).select("sire", "venue").distinct()


@query("u3_dedupe", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_quantity, l_shipdate) = 1", base=False)
def u3(spark, d):
    return J.first_per_key(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], [F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("u4_dedupe_priority", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN value > 50 THEN 0 ELSE 1 END, ts, event_id) = 1", base=False)
def u4(spark, d):
    return J.dedupe_priority(table(spark, d, "events"), ["user_id", "event_type"], [F.when(F.col("value") > 50, 0).otherwise(1), "ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("u5_placeholders", "SELECT o_custkey AS owner, count(*) AS orders FROM orders GROUP BY o_custkey UNION ALL SELECT c_custkey, NULL FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)", base=False)
def u5(spark, d):
    have = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(F.count("*").alias("orders"))
    return J.with_placeholders(have, table(spark, d, "customer").select(F.col("c_custkey").alias("owner")), ["owner"])


@query("u6_unpivot", "SELECT horse, slot, value FROM (SELECT p_partkey AS horse, p_brand AS brand, p_type AS kind FROM part) UNPIVOT (value FOR slot IN (brand, kind))", base=False)
def u6(spark, d):
    return J.unpivot(table(spark, d, "part").selectExpr("p_partkey horse", "p_brand brand", "p_type kind"), ["horse"], ["brand", "kind"])


@query("u7_coalesce_merge", "SELECT coalesce(a.id, b.id) AS id, coalesce(nullif(b.name, ''), a.name) AS name, coalesce(b.balance, a.balance) AS balance FROM (SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance FROM supplier) a FULL JOIN (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS balance FROM customer) b ON a.id = b.id", base=False)
def u7(spark, d):
    a = table(spark, d, "supplier").selectExpr("s_suppkey id", "s_name name", "s_acctbal balance")
    b = table(spark, d, "customer").selectExpr("c_custkey id", "if(c_custkey % 2 = 0, '', c_name) name", "if(c_custkey % 3 = 0, null, c_acctbal) balance")
    return J.coalesce_merge(a, b, ["id"])


@query("u8_route_small_fields", "SELECT race_id, horse, CASE WHEN field_size <= 3 THEN score_a ELSE score_b END AS score, CASE WHEN field_size <= 3 THEN 'a' ELSE 'b' END AS model FROM e")
def u8(spark, d):
    e = entries(spark, d)
    one = lambda m: e.select(*KEY, F.col(f"score_{m}").alias("score"), F.lit(m).alias("model"))
    return J.route_small(one("a"), one("b"), e.select("race_id", "field_size").distinct(), 3, ["race_id"])


@query("u9_merge_histories", "SELECT horse, day, finish, min(src) AS src FROM (SELECT horse, day, finish, 0 AS src FROM e WHERE race_id % 3 > 0 UNION ALL SELECT horse, day, finish, 1 FROM e WHERE race_id % 3 < 2) GROUP BY horse, day, finish")
def u9(spark, d):
    e = entries(spark, d).select("race_id", "horse", "day", "finish")
    both = e.where("race_id % 3 > 0").withColumn("src", F.lit(0)).unionByName(e.where("race_id % 3 < 2").withColumn("src", F.lit(1)))
    return J.first_per_key(both, ["horse", "day", "finish"], ["src", "race_id"]).select("horse", "day", "finish", "src")


@query("u9_person_summary", ", a AS (SELECT jockey, count(*) AS starts, count(*) FILTER (WHERE finish = 1) AS wins FROM e WHERE race_id % 3 > 0 GROUP BY jockey), b AS (SELECT jockey, count(*) AS starts, count(*) FILTER (WHERE finish = 1) AS wins FROM e WHERE race_id % 2 = 0 GROUP BY jockey) SELECT jockey, CASE WHEN b.starts IS NULL OR a.starts >= b.starts THEN a.starts ELSE b.starts END AS starts, CASE WHEN b.starts IS NULL OR a.starts >= b.starts THEN a.wins ELSE b.wins END AS wins, CASE WHEN b.starts IS NULL OR a.starts >= b.starts THEN 0 ELSE 1 END AS src FROM a FULL JOIN b USING (jockey)")
def u9p(spark, d):
    """Two sources' summaries of a person: the one with more starts wins, of equal ones the first."""
    e = entries(spark, d)
    one = lambda cond, src: e.where(cond).groupBy("jockey").agg(F.count("*").alias("starts"), F.count_if(F.col("finish") == 1).alias("wins")).withColumn("src", F.lit(src))
    return J.first_per_key(one("race_id % 3 > 0", 0).unionByName(one("race_id % 2 = 0", 1)), ["jockey"], [F.desc("starts"), "src"])


@query("k1_top", "SELECT race_id, horse, odds FROM e ORDER BY odds DESC, race_id, horse LIMIT 20")
def k1(spark, d):
    return entries(spark, d).orderBy(F.desc("odds"), *KEY).limit(20).select(*KEY, "odds")


@query("k2_top_per_group", "SELECT venue, race_id, horse FROM e QUALIFY row_number() OVER (PARTITION BY venue ORDER BY score_a DESC, race_id, horse) <= 5")
def k2(spark, d):
    return J.top_per_group(entries(spark, d), ["venue"], [F.desc("score_a"), *KEY], 5).select("venue", *KEY)


@query("k3_first_per_key", "SELECT horse, race_id, jockey FROM e QUALIFY row_number() OVER (PARTITION BY horse ORDER BY day DESC, race_id DESC) = 1")
def k3(spark, d):
    return J.latest(entries(spark, d).select("horse", "day", "race_id", "jockey"), ["horse"], ["day", "race_id"]).select("horse", "race_id", "jockey")


@query("k7_top_combinations", """, leg AS (SELECT race_id, horse, score_a / sum(score_a) OVER (PARTITION BY race_id) AS p, race_id % 5 AS leg FROM e WHERE race_id IN (SELECT race_id FROM e GROUP BY race_id ORDER BY max(day) DESC, race_id LIMIT 5)),
l AS (SELECT *, dense_rank() OVER (ORDER BY race_id) AS n FROM leg), t AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY race_id ORDER BY p DESC, horse) <= 3)
SELECT a.horse AS h1, b.horse AS h2, c.horse AS h3, x.horse AS h4, y.horse AS h5, round(a.p * b.p * c.p * x.p * y.p, 9) AS p FROM t a, t b, t c, t x, t y WHERE a.n = 1 AND b.n = 2 AND c.n = 3 AND x.n = 4 AND y.n = 5 ORDER BY a.p * b.p * c.p * x.p * y.p DESC, h1, h2, h3, h4, h5 LIMIT 10""")
def k7(spark, d):
    """Top combinations over five legs of at most three choices: 243 products at most."""
    e = entries(spark, d)
    races = e.groupBy("race_id").agg(F.max("day").alias("m")).orderBy(F.desc("m"), "race_id").limit(5).select("race_id")
    leg = R.share(J.focus(e, races, ["race_id"]), "score_a", "p")
    leg = J.top_per_group(leg, ["race_id"], [F.desc("p"), "horse"], 3).groupBy("race_id").agg(F.collect_list(F.struct("horse", "p")).alias("choices"))
    row = leg.agg(F.transform(F.array_sort(F.collect_list(F.struct("race_id", "choices"))), lambda x: x["choices"]).alias("legs"))
    for k in range(5):
        row = row.withColumn("c", F.explode(F.col("legs")[k])).withColumn(f"h{k + 1}", F.col("c.horse")).withColumn("p", F.col("c.p") * (F.col("p") if k else F.lit(1.0)))
    names = [f"h{k}" for k in range(1, 6)]
    return row.orderBy(F.desc("p"), *names).limit(10).select(*names, F.round("p", 9).alias("p"))


@query("k8_sort_trend", "SELECT row_number() OVER (ORDER BY wins DESC, starts DESC, jockey) AS place, jockey, wins, starts FROM (SELECT jockey, count(*) FILTER (WHERE finish = 1) AS wins, count(*) AS starts FROM e GROUP BY jockey) ORDER BY place LIMIT 50")
def k8(spark, d):
    by = entries(spark, d).groupBy("jockey").agg(F.count_if(F.col("finish") == 1).alias("wins"), F.count("*").alias("starts"))
    top = by.orderBy(F.desc("wins"), F.desc("starts"), "jockey").limit(50)
    return top.withColumn("place", F.row_number().over(W.orderBy(F.desc("wins"), F.desc("starts"), "jockey")).cast("long")).select("place", "jockey", "wins", "starts")
