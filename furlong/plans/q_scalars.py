"""Queries of projections, predicates and scalar functions (P, F), and of nearest-neighbour search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import names as M
from ..operators import nearest as N
from .registry import query
from .views import entries, table

R6 = lambda c: F.round(c, 6)
KEY = ("race_id", "horse")

RAW = ", raw AS (SELECT race_id, horse, CASE WHEN finish > 6 THEN '00' ELSE lpad(finish::VARCHAR, 2, '0') END AS chakujun, CASE WHEN horse % 11 = 0 THEN '0000' WHEN horse % 13 = 0 THEN ' 12x' ELSE lpad(round(odds * 10)::INT::VARCHAR, 4, '0') END AS odds10, CASE WHEN horse % 7 = 0 THEN 'FFF' ELSE upper(to_hex((body_weight * 2)::INT)) END AS hexw FROM e)\n"


def raw(spark, d):
    """Runners as zero-padded text codes with sentinels."""
    e = entries(spark, d)
    odds = F.when(F.col("horse") % 11 == 0, "0000").when(F.col("horse") % 13 == 0, " 12x").otherwise(F.lpad(F.round(F.col("odds") * 10).cast("int").cast("string"), 4, "0"))
    return e.select(*KEY, F.when(F.col("finish") > 6, "00").otherwise(F.lpad(F.col("finish").cast("string"), 2, "0")).alias("chakujun"), odds.alias("odds10"), F.when(F.col("horse") % 7 == 0, "FFF").otherwise(F.hex((F.col("body_weight") * 2).cast("int"))).alias("hexw"))


NUM = "CASE WHEN regexp_full_match(trim({c}), '[0-9]+') AND trim({c}) NOT IN ('', '00', '000', '0000') THEN trim({c})::DOUBLE / {s} END"


@query("p1_normalise", RAW + f"SELECT race_id, horse, {NUM.format(c='chakujun', s='1')} AS finish, {NUM.format(c='odds10', s='10')} AS odds FROM raw")
def p1(spark, d):
    return raw(spark, d).select(*KEY, S.code_number("chakujun").alias("finish"), S.code_number("odds10", scale=10).alias("odds"))


@query("p2_norm_position", "SELECT race_id, horse, round(CASE WHEN field_size > 1 THEN (finish - 1) / (field_size - 1)::DOUBLE END, 6) AS finish_norm FROM e")
def p2(spark, d):
    return entries(spark, d).select(*KEY, R6(S.norm_position("finish", "field_size")).alias("finish_norm"))


@query("p3_field_size", "SELECT race_id, horse, coalesce(nullif(CASE WHEN race_id % 3 = 0 THEN 0 ELSE field_size END, 0), count(*) OVER (PARTITION BY race_id)) AS field_size FROM e")
def p3(spark, d):
    stored = F.when(F.col("race_id") % 3 == 0, 0).otherwise(F.col("field_size"))
    return entries(spark, d).select(*KEY, F.coalesce(F.nullif(stored, F.lit(0)), F.count("*").over(W.partitionBy("race_id"))).alias("field_size"))


@query("p4_clean_text", "SELECT c_custkey AS id, coalesce(nullif(regexp_replace(trim(replace(CASE WHEN c_custkey % 5 = 0 THEN '　 ' ELSE '　00' || c_custkey || ' ' END, '　', ' ')), '^0+', ''), ''), c_name) AS name FROM customer", base=False)
def p4(spark, d):
    c = table(spark, d, "customer").withColumn("t", F.when(F.col("c_custkey") % 5 == 0, "　 ").otherwise(F.concat(F.lit("　00"), F.col("c_custkey").cast("string"), F.lit(" "))))
    return c.select(F.col("c_custkey").alias("id"), S.clean_text("t", "c_name").alias("name"))


@query("p5_fold_name", "SELECT s_suppkey AS id, trim(regexp_replace(regexp_replace(lower(s_name), '[#!-/:-@\\[-`{-~]+', ' ', 'g'), '\\s*\\b(co|ltd|inc|llc|kk)\\b\\s*', ' ', 'g')) AS name FROM supplier", base=False)
def p5(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), S.fold_name(F.translate("s_name", "#", "＃")).alias("name"))


@query("p6_name_alias", "SELECT c.c_custkey AS id, s.s_suppkey AS target FROM customer c JOIN supplier s ON regexp_extract(c.c_name, '[0-9]+$') = regexp_extract(s.s_name, '[0-9]+$') AND substr(c.c_name, 1, 1) = 'C'", base=False)
def p6(spark, d):
    """Names meet on any of their aliases: the aliases are exploded and joined by equality."""
    digits = lambda c: F.array(F.regexp_extract(c, "[0-9]+$", 0), F.concat(F.lit("full:"), F.col(c)))
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.explode(digits("c_name")).alias("alias"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("target"), F.explode(digits("s_name")).alias("alias"))
    return a.join(b, "alias").select("id", "target").distinct()


#: Abbreviations of part names: an initial and a word, two beginnings, a name with a letter left out, the name itself.
SHORT = "CASE p_partkey % 4 WHEN 0 THEN substr(p_name, 1, 1) || '. ' || split_part(p_name, ' ', 2) WHEN 1 THEN substr(p_name, 1, 2) || ' ' || substr(split_part(p_name, ' ', 2), 1, 2) WHEN 2 THEN substr(p_name, 1, 2) || substr(p_name, 4) ELSE p_name END"


@query("p6_abbreviated", f"""WITH a AS (SELECT p_partkey AS id, trim(regexp_replace(lower({SHORT}), '[. ]+', ' ', 'g')) AS n FROM part), b AS (SELECT DISTINCT p_name AS target FROM part),
f AS (SELECT id, target, CASE WHEN n = target THEN 0 WHEN len(string_split(n, ' ')) = len(string_split(target, ' ')) AND len(list_filter(range(1, len(string_split(n, ' ')) + 1), lambda i: NOT starts_with(string_split(target, ' ')[i], string_split(n, ' ')[i]))) = 0 THEN 1 WHEN levenshtein(n, target) <= 1 AND length(n) >= 4 THEN 2 END AS k FROM a, b),
m AS (SELECT *, min(k) OVER (PARTITION BY id) AS best FROM f WHERE k IS NOT NULL)
SELECT id, target, ['equal', 'abbreviated', 'slip'][k + 1] AS kind, count(*) OVER (PARTITION BY id) > 1 AS ambiguous FROM m WHERE k = best""", base=False)
def p6a(spark, d):
    """Shortened and misspelt part names, and the full names that they can stand for."""
    part = table(spark, d, "part")
    return M.match_names(part.select("p_partkey", F.expr(SHORT).alias("short")), part.select("p_name").distinct().withColumn("target", F.col("p_name")), "p_partkey", "target", "short", "p_name")


def _bands(col, steps):
    return "CASE " + " ".join(f"WHEN {col} <= {t} THEN '{n}'" for t, n in steps[:-1]) + f" ELSE '{steps[-1][1]}' END"


@query("p7_bands", f"SELECT race_id, horse, {_bands('distance', S.BANDS['cells'])} AS cell_band, {_bands('distance', S.BANDS['similar'])} AS similar_band, {_bands('field_size', S.BANDS['field'])} AS field_band, floor((month(race_date) + 9) % 12 / 3)::INT AS season FROM e")
def p7(spark, d):
    return entries(spark, d).select(*KEY, S.band("distance", "cells").alias("cell_band"), S.band("distance", "similar").alias("similar_band"), S.band("field_size", "field").alias("field_band"), S.season("race_date").alias("season"))


@query("p8_surface", "SELECT race_id, horse, CASE WHEN venue IN (0, 1, 2, 3, 4, 5, 6, 7) THEN 'turf' WHEN venue IN (8, 9, 10, 11, 12) THEN 'dirt' END AS track FROM e")
def p8(spark, d):
    return entries(spark, d).select(*KEY, S.code_set("venue", {"turf": range(8), "dirt": range(8, 13)}).alias("track"))


LEVELS = {"1-URGENT": 1, "2-HIGH": 2, "3-MEDIUM": 3}


@query("p9_class_level", "SELECT race_id, horse, CASE class WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 END AS level FROM e")
def p9(spark, d):
    return entries(spark, d).select(*KEY, S.code_level("class", LEVELS).alias("level"))


@query("p10_condition_key", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 25 THEN p_brand END, split_part(trim(p_type), ' ', 1)) AS condition FROM part", base=False)
def p10(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.condition_key(F.when(F.col("p_size") > 25, F.col("p_brand")), "p_type").alias("condition"))


@query("p11_weight_class", "SELECT race_id, horse, CASE WHEN carried < 52 THEN 'light' WHEN carried < 56 THEN 'middle' ELSE 'heavy' END AS carried_class FROM e")
def p11(spark, d):
    return entries(spark, d).select(*KEY, S.weight_class("carried", {"light": 52, "middle": 56}, "heavy").alias("carried_class"))


@query("p12_hex", RAW + "SELECT race_id, horse, CASE WHEN hexw <> 'FFF' THEN ('0x' || hexw)::INT END AS weight FROM raw")
def p12(spark, d):
    return raw(spark, d).select(*KEY, S.hex_number("hexw").alias("weight"))


@query("p13_frame", ", f AS (SELECT race_id, horse, horse_no AS no, field_size + race_id % 12 AS n FROM e), g AS (SELECT *, n // 8 AS b FROM f), h AS (SELECT *, (8 - (n - 8 * b)) * b AS t FROM g) SELECT race_id, horse, (CASE WHEN no > n OR n > 18 THEN NULL WHEN n <= 8 THEN no WHEN no <= t THEN (no - 1) // b + 1 ELSE 8 - (n - 8 * b) + (no - t - 1) // (b + 1) + 1 END)::INT AS frame FROM h")
def p13(spark, d):
    return entries(spark, d).select(*KEY, S.frame("horse_no", F.col("field_size") + F.col("race_id") % 12).alias("frame"))


@query("p14_running_style", "SELECT race_id, horse, CASE WHEN corner1 = 1 THEN 'nige' WHEN field_size < 2 THEN NULL WHEN (corner1 - 1) / (field_size - 1)::DOUBLE <= 0.3 THEN 'senkou' WHEN (corner1 - 1) / (field_size - 1)::DOUBLE <= 0.7 THEN 'sashi' ELSE 'oikomi' END AS style FROM e")
def p14(spark, d):
    return entries(spark, d).select(*KEY, S.running_style("corner1", "field_size").alias("style"))


@query("p15_race_key", "SELECT DISTINCT race_id, race_date || ':' || lpad(venue::VARCHAR, 2, '0') || ':' || race_id AS race_key, lpad(venue::VARCHAR, 2, '0') AS parsed_venue FROM e")
def p15(spark, d):
    e = entries(spark, d).select("race_id", S.race_key(F.col("race_date").cast("string"), F.lpad(F.col("venue").cast("string"), 2, "0"), F.col("race_id").cast("string")).alias("race_key"))
    return e.select("race_id", "race_key", S.parse_race_key("race_key", ["date", "parsed_venue"])[1]).distinct()


@query("p16_category", "SELECT race_id, CASE WHEN venue = 8 THEN 'draught' WHEN venue < 10 THEN 'national' ELSE 'local' END AS category, count(*) AS runners FROM e GROUP BY ALL")
def p16(spark, d):
    return entries(spark, d).groupBy("race_id", F.when(F.col("venue") == 8, "draught").when(F.col("venue") < 10, "national").otherwise("local").alias("category")).agg(F.count("*").alias("runners"))


@query("p17_reference_rows", "SELECT race_id, horse FROM e WHERE NOT (surface = 'P' AND venue BETWEEN 5 AND 9)")
def p17(spark, d):
    return entries(spark, d).where(~((F.col("surface") == "P") & F.col("venue").between(5, 9))).select(*KEY)


def similar(asked: dict):
    """Predicate of the similar-race toggles that are set (P18): null matches null; a class of None asks for ungraded open races."""
    conds = [F.col(c).eqNullSafe(F.lit(v)) for c, v in asked.items() if c != "class" or v is not None]
    if asked.get("class", "") is None:
        conds.append(F.col("class").isin("4-NOT SPECIFIED", "5-LOW") | F.col("class").isNull())
    return reduce(lambda a, b: a & b, conds, F.lit(True))


@query("p18_similar_predicate", "SELECT race_id, horse FROM e WHERE venue = 3 AND distance = 1600 AND (class IN ('4-NOT SPECIFIED', '5-LOW') OR class IS NULL)")
def p18(spark, d):
    return entries(spark, d).where(similar({"venue": 3, "distance": 1600, "class": None})).select(*KEY)


@query("p19_look_back", "SELECT race_id, horse FROM e WHERE race_date >= DATE '2000-08-01' - INTERVAL 2 YEAR AND race_date < DATE '2000-08-01' AND race_year >= 1998")
def p19(spark, d):
    """The year is tested beside the date, so that partitions by year can be skipped."""
    day = F.to_date(F.lit("2000-08-01"))
    return entries(spark, d).where((F.col("race_date") >= F.add_months(day, -24)) & (F.col("race_date") < day) & (F.col("race_year") >= 1998)).select(*KEY)


@query("p20_race_tags", "SELECT DISTINCT race_id, array_to_string(list_filter([CASE surface WHEN 'F' THEN 'flat' WHEN 'O' THEN 'open' END, CASE WHEN class = '1-URGENT' THEN 'graded' END, CASE WHEN distance >= 2000 THEN 'staying' END], lambda x: x IS NOT NULL), ' ') AS tags FROM e")
def p20(spark, d):
    tags = F.array_compact(F.array(S.code_level("surface", {"F": "flat", "O": "open"}), F.when(F.col("class") == "1-URGENT", "graded"), F.when(F.col("distance") >= 2000, "staying")))
    return entries(spark, d).select("race_id", F.array_join(tags, " ").alias("tags")).distinct()


@query("p21_prize_points", "SELECT race_id, horse, round(CASE class WHEN '1-URGENT' THEN 100 WHEN '2-HIGH' THEN 40 WHEN '3-MEDIUM' THEN 20 ELSE 8 END * CASE finish WHEN 1 THEN 1 WHEN 2 THEN 0.38 WHEN 3 THEN 0.22 WHEN 4 THEN 0.12 ELSE 0.03 END, 4)::DOUBLE AS points FROM e")
def p21(spark, d):
    grade = F.regexp_extract("class", "^([123])", 1)
    purse = F.coalesce(S.code_level(grade, {"1": 100, "2": 40, "3": 20}), F.lit(8))
    part = F.when(F.col("finish") == 1, 1.0).when(F.col("finish") == 2, 0.38).when(F.col("finish") == 3, 0.22).when(F.col("finish") == 4, 0.12).otherwise(0.03)
    return entries(spark, d).select(*KEY, F.round(purse * part, 4).alias("points"))


@query("p22_market_scores", ", s AS (SELECT race_id, horse, surface, CASE WHEN horse % 9 > 0 THEN greatest(0, least(1, ln(greatest(odds, 1)) / ln(300))) END AS o, CASE WHEN field_size > 1 THEN (popularity - 1) / (field_size - 1)::DOUBLE END AS p FROM e) SELECT race_id, horse, round(coalesce(o, (SELECT median(o) FROM s x WHERE x.surface = s.surface)), 6) AS odds_score, round(p, 6) AS popularity_score FROM s")
def p22(spark, d):
    s = entries(spark, d).select(*KEY, "surface", F.when(F.col("horse") % 9 > 0, S.odds_score("odds")).alias("o"), S.norm_position("popularity", "field_size").alias("p"))
    middle = s.groupBy("surface").agg(F.percentile("o", F.lit(0.5)).alias("m"))
    return s.join(middle, "surface", "left").select(*KEY, R6(F.coalesce("o", "m")).alias("odds_score"), R6("p").alias("popularity_score"))


@query("p23_project_features", "SELECT race_id, horse, odds, NULL::DOUBLE AS missing_feature, distance FROM e")
def p23(spark, d):
    e, names = entries(spark, d), ["odds", "missing_feature", "distance"]
    out = e.select(*KEY, *(F.col(c) if c in e.columns else F.lit(None).cast("double").alias(c) for c in names))
    if len(out.columns) != len(KEY) + len(names):
        raise ValueError("features are not as many as asked for")
    return out


@query("p24_interp", "SELECT race_id, horse, round(CASE WHEN odds <= 2 THEN 0.6 WHEN odds <= 6 THEN 0.6 + (odds - 2) * ((0.2 - 0.6) / 4) WHEN odds <= 14 THEN 0.2 + (odds - 6) * ((0.05 - 0.2) / 8) ELSE 0.05 END, 6) AS calibrated FROM e")
def p24(spark, d):
    return entries(spark, d).select(*KEY, R6(S.interp("odds", [2, 6, 14], [0.6, 0.2, 0.05])).alias("calibrated"))


@query("p25_serving", "SELECT event_id, CASE WHEN lag < 1 THEN 'live' WHEN lag <= 7 THEN 'genuine' ELSE 'backfill' END AS kind FROM (SELECT event_id, date_diff('day', DATE '2024-01-01', ts::DATE) % 12 AS lag FROM events)", base=False)
def p25(spark, d):
    lag = F.datediff(F.to_date("ts"), F.lit("2024-01-01")) % 12
    return table(spark, d, "events").select("event_id", F.when(lag < 1, "live").when(lag <= 7, "genuine").otherwise("backfill").alias("kind"))


@query("p26_blinkers", ", b AS (SELECT race_id, horse, (jockey % 3 = 0) AS flag, list((jockey % 3 = 0)::INT) OVER (PARTITION BY horse ORDER BY day DESC, race_id DESC ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS past FROM e) SELECT race_id, horse, CASE WHEN len(coalesce(past, [])) = 0 THEN 'F' WHEN flag AND list_sum(past) = 0 THEN 'A' WHEN flag AND past[1] = 0 THEN 'B' WHEN flag THEN 'C' WHEN past[1] = 1 THEN 'D' ELSE 'E' END AS pattern FROM b")
def p26(spark, d):
    """First time on, on again, kept on, taken off, still off, no past: from the current flag and the last three."""
    w = W.partitionBy("horse").orderBy("day", "race_id").rowsBetween(-3, -1)
    b = entries(spark, d).withColumn("on", (F.col("jockey") % 3 == 0).cast("int"))
    b = b.withColumns({"n": F.count("on").over(w), "k": F.sum("on").over(w), "last": F.last("on").over(w)})
    flag = F.col("on") == 1
    return b.select(*KEY, F.when(F.col("n") == 0, "F").when(flag & (F.col("k") == 0), "A").when(flag & (F.col("last") == 0), "B").when(flag, "C").when(F.col("last") == 1, "D").otherwise("E").alias("pattern"))


@query("p27_style_postproc", ", s AS (SELECT race_id, horse, [score_b, score_c, odds] AS a FROM e), n AS (SELECT race_id, horse, list_transform(a, lambda x: x / list_sum(a)) AS p FROM s) SELECT race_id, horse, (CASE WHEN p[2] >= 0.45 THEN 1 ELSE list_position(p, list_max(p)) - 1 END)::INT AS style, (list_position(p, list_sort(p, 'DESC')[2]) - 1)::INT AS second, round(list_max(p), 4) AS top, round(exp(score_b / 50) / (exp(score_b / 50) + exp(score_c / 50000) + exp(odds / 50)), 9) AS softmax_first FROM n JOIN e USING (race_id, horse)")
def p27(spark, d):
    """Probabilities summed to 1 (or by softmax of scaled scores); the class with a threshold wins beyond it, else the largest; and the second largest."""
    a = F.array("score_b", "score_c", "odds")
    total = F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    e = entries(spark, d).withColumn("t", total).withColumn("p", F.transform(a, lambda x: x / F.col("t")))
    return e.select(*KEY, F.when(F.col("p")[1] >= 0.45, 1).otherwise(F.array_position("p", F.array_max("p")) - 1).cast("int").alias("style"), (F.array_position("p", F.sort_array("p", asc=False)[1]) - 1).cast("int").alias("second"), F.round(F.array_max("p"), 4).alias("top"), F.round(S.softmax_of([F.col("score_b") / 50, F.col("score_c") / 50000, F.col("odds") / 50])[0], 9).alias("softmax_first"))


@query("f1_strings", "SELECT p_partkey AS id, upper(left(p_name, 3)) AS head, lpad(p_size::VARCHAR, 3, '0') AS size, replace(p_brand, '#', '-') AS brand, length(p_type) AS n, split_part(p_type, ' ', 2) AS second FROM part", base=False)
def f1(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper(F.left("p_name", F.lit(3))).alias("head"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("size"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.length("p_type").alias("n"), F.split_part("p_type", F.lit(" "), F.lit(2)).alias("second"))


@query("f2_regex", "SELECT p_partkey AS id, regexp_matches(p_brand, '[0-9]+$') AS numbered, regexp_replace(p_type, '[AEIOU]', '', 'g') AS consonants FROM part", base=False)
def f2(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").rlike("[0-9]+$").alias("numbered"), F.regexp_replace("p_type", "[AEIOU]", "").alias("consonants"))


@query("f3_dates", "SELECT o_orderkey AS id, month(o_orderdate)::INT AS month, floor((month(o_orderdate) + 9) % 12 / 3)::INT AS season, date_diff('day', o_orderdate::DATE, DATE '2001-08-01')::INT AS days, (o_orderdate::DATE + INTERVAL 1 YEAR)::DATE AS next_year, (o_orderdate + INTERVAL 9 HOUR)::DATE AS tokyo_day FROM orders", base=False)
def f3(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.month("o_orderdate").alias("month"), S.season("o_orderdate").alias("season"), F.datediff(F.lit("2001-08-01"), day).alias("days"), F.add_months(day, 12).alias("next_year"), F.to_date(F.from_utc_timestamp("o_orderdate", "Asia/Tokyo")).alias("tokyo_day"))


@query("f4_math", "SELECT race_id, horse, round(ln(odds), 6) AS a, round(log10(odds), 6) AS b, round(exp(-odds / 10), 6) AS c, greatest(odds, 5) AS d, floor(odds)::BIGINT AS e, round(sqrt(abs(odds - 6)), 6) AS f FROM e")
def f4(spark, d):
    o = F.col("odds")
    return entries(spark, d).select(*KEY, R6(F.log(o)).alias("a"), R6(F.log10(o)).alias("b"), R6(F.exp(-o / 10)).alias("c"), F.greatest(o, F.lit(5.0)).alias("d"), F.floor(o).alias("e"), R6(F.sqrt(F.abs(o - 6))).alias("f"))


@query("f5_conditional", "SELECT event_id, coalesce(try_cast(event_type AS INT), -1) AS n, nullif(event_type, 'view') AS kind, user_id IS DISTINCT FROM 7 AS other FROM events", base=False)
def f5(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(F.col("event_type").try_cast("int"), F.lit(-1)).alias("n"), F.nullif("event_type", F.lit("view")).alias("kind"), (~F.col("user_id").eqNullSafe(7)).alias("other"))


@query("f6_entropy", "SELECT race_id, round(-sum(p * ln(p + 1e-9)), 6) AS entropy FROM (SELECT race_id, score_a / sum(score_a) OVER (PARTITION BY race_id) AS p FROM e) GROUP BY race_id")
def f6(spark, d):
    p = F.col("score_a") / F.sum("score_a").over(W.partitionBy("race_id"))
    return entries(spark, d).withColumn("p", p).groupBy("race_id").agg(R6(F.sum(S.entropy("p"))).alias("entropy"))


@query("f7_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS norm, round(list_max(embedding)::DOUBLE, 5) AS top, (list_position(embedding, list_max(embedding)) - 1)::BIGINT AS arg FROM embeddings", base=False)
def f7(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(F.sqrt(S.dot("embedding", "embedding")), 5).alias("norm"), F.round(F.array_max("embedding").cast("double"), 5).alias("top"), (F.array_position("embedding", F.array_max("embedding")) - 1).alias("arg"))


@query("f8_json", "SELECT event_id, (props->>'$.k')::INT AS k, json_object('user', user_id, 'k', (props->>'$.k')::INT)::VARCHAR AS packed FROM events", base=False)
def f8(spark, d):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, d, "events").select("event_id", k.alias("k"), F.to_json(F.struct(F.col("user_id").alias("user"), k.alias("k"))).alias("packed"))


@query("f9_set_hash", "SELECT o_custkey AS owner, substr(sha256(array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',')), 1, 16) AS h FROM orders GROUP BY o_custkey", base=False)
def f9(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("owner")).agg(S.set_hash(F.collect_set("o_orderpriority")).alias("h"))


PACK = ", q AS (SELECT race_id, string_agg(lpad(a.horse_no::VARCHAR, 2, '0') || lpad(b.horse_no::VARCHAR, 2, '0') || lpad(round((a.odds * b.odds) * 10)::INT::VARCHAR, 5, '0') || '0001', '' ORDER BY a.horse_no, b.horse_no) AS packed FROM e a JOIN e b USING (race_id) WHERE a.horse_no < b.horse_no GROUP BY race_id)\n"


def packed(spark, d):
    """Pair odds of a race's runners as one string of 13-character slots."""
    pairs = J.pairs_within(entries(spark, d), ["race_id"], "horse_no", ["odds"])
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    slot = F.concat(two("a_horse_no"), two("b_horse_no"), F.lpad(F.round(F.col("a_odds") * F.col("b_odds") * 10).cast("int").cast("string"), 5, "0"), F.lit("0001"))
    slots = pairs.groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct("a_horse_no", "b_horse_no", slot.alias("s")))).alias("l"))
    return slots.select("race_id", F.array_join(F.transform("l", lambda x: x["s"]), "").alias("packed"))


@query("f10_unpack", PACK + "SELECT race_id, substr(s, 1, 2)::INT AS first, substr(s, 3, 2)::INT AS second, substr(s, 5, 5)::INT / 10 AS odds FROM (SELECT race_id, substr(packed, 13 * i::INT + 1, 13) AS s FROM (SELECT race_id, packed, unnest(range(length(packed) // 13)) AS i FROM q))")
def f10(spark, d):
    stride, widths = S.PACKED["quinella"]
    slots = packed(spark, d).select("race_id", F.explode(S.unpack("packed", stride, widths)).alias("s"))
    return slots.select("race_id", F.col("s")[0].cast("int").alias("first"), F.col("s")[1].cast("int").alias("second"), (F.col("s")[2].cast("int") / 10).alias("odds"))


_TWO = "lpad({}.horse_no::VARCHAR, 2, '0')"
PACK_WIDE = ", q AS (SELECT race_id, string_agg(" + _TWO.format("a") + " || " + _TWO.format("b") + " || lpad(round(least(a.odds, b.odds) * 10)::INT::VARCHAR, 5, '0') || lpad(round(greatest(a.odds, b.odds) * 10)::INT::VARCHAR, 5, '0') || '001', '' ORDER BY a.horse_no, b.horse_no) AS packed FROM e a JOIN e b USING (race_id) WHERE a.horse_no < b.horse_no GROUP BY race_id)\n"
PACK_TRIO = ", q AS (SELECT race_id, string_agg(" + " || ".join(map(_TWO.format, "abc")) + " || lpad(round(a.odds * b.odds * c.odds * 10)::INT::VARCHAR, 5, '0') || '0001', '' ORDER BY a.horse_no, b.horse_no, c.horse_no) AS packed FROM e a JOIN e b USING (race_id) JOIN e c USING (race_id) WHERE a.horse_no < b.horse_no AND b.horse_no < c.horse_no GROUP BY race_id)\n"


def _pack(rows, legs, tail):
    """Slots of a race, in order of their legs, as one string."""
    slot = F.concat(*(F.lpad(F.col(x).cast("string"), 2, "0") for x in legs), *tail)
    slots = rows.groupBy("race_id").agg(F.array_sort(F.collect_list(F.struct(*legs, slot.alias("s")))).alias("l"))
    return slots.select("race_id", F.array_join(F.transform("l", lambda x: x["s"]), "").alias("packed"))


def _tenths(c):
    return F.lpad(F.round(c * 10).cast("int").cast("string"), 5, "0")


def _slots(df, layout):
    stride, widths = S.PACKED[layout]
    return df.select("race_id", F.explode(S.unpack("packed", stride, widths)).alias("s"))


@query("f10_unpack_wide", PACK_WIDE + "SELECT race_id, substr(s, 1, 2)::INT AS first, substr(s, 3, 2)::INT AS second, substr(s, 5, 5)::INT / 10 AS low, substr(s, 10, 5)::INT / 10 AS high FROM (SELECT race_id, substr(packed, 17 * i::INT + 1, 17) AS s FROM (SELECT race_id, packed, unnest(range(length(packed) // 17)) AS i FROM q))")
def f10_wide(spark, d):
    pairs = J.pairs_within(entries(spark, d), ["race_id"], "horse_no", ["odds"])
    a, b = F.col("a_odds"), F.col("b_odds")
    s = _slots(_pack(pairs, ["a_horse_no", "b_horse_no"], [_tenths(F.least(a, b)), _tenths(F.greatest(a, b)), F.lit("001")]), "wide")
    return s.select("race_id", *(F.col("s")[i].cast("int").alias(n) for i, n in enumerate(("first", "second"))), *((F.col("s")[i].cast("int") / 10).alias(n) for i, n in ((2, "low"), (3, "high"))))


@query("f10_unpack_trio", PACK_TRIO + "SELECT race_id, substr(s, 1, 2)::INT AS first, substr(s, 3, 2)::INT AS second, substr(s, 5, 2)::INT AS third, substr(s, 7, 5)::INT / 10 AS odds FROM (SELECT race_id, substr(packed, 15 * i::INT + 1, 15) AS s FROM (SELECT race_id, packed, unnest(range(length(packed) // 15)) AS i FROM q))")
def f10_trio(spark, d):
    e = entries(spark, d)
    third = e.select("race_id", F.col("horse_no").alias("c_horse_no"), F.col("odds").alias("c_odds"))
    triples = J.pairs_within(e, ["race_id"], "horse_no", ["odds"]).join(third, "race_id").where("b_horse_no < c_horse_no")
    s = _slots(_pack(triples, ["a_horse_no", "b_horse_no", "c_horse_no"], [_tenths(F.col("a_odds") * F.col("b_odds") * F.col("c_odds")), F.lit("0001")]), "trio")
    return s.select("race_id", *(F.col("s")[i].cast("int").alias(n) for i, n in enumerate(("first", "second", "third"))), (F.col("s")[3].cast("int") / 10).alias("odds"))


KNN = "FROM embeddings t JOIN embeddings h ON t.label = h.label AND h.vec_id < t.vec_id WHERE t.vec_id % 10 = 0"


def neighbours(spark, d, k: int):
    """The k nearest earlier vectors of the same label of every tenth vector (J10, K4), by a pivot index."""
    v = table(spark, d, "embeddings")
    return N.earlier_neighbours(v.where("vec_id % 10 = 0"), v, k, ["label"], "vec_id", "embedding")


@query("j10_knn_join", f"SELECT vec_id, h_id FROM (SELECT t.vec_id AS vec_id, h.vec_id AS h_id, row_number() OVER (PARTITION BY t.vec_id ORDER BY list_distance(t.embedding::DOUBLE[], h.embedding::DOUBLE[]), h.vec_id) AS rn {KNN}) WHERE rn <= 10", base=False)
def j10(spark, d):
    return neighbours(spark, d, 10).select("vec_id", "h_id")


@query("k4_knn_features", f"SELECT vec_id, round(sum(w * h_id) FILTER (WHERE rn <= 10) / sum(w) FILTER (WHERE rn <= 10), 4) AS knn_mean10, round(sum(w * h_id) FILTER (WHERE rn <= 30) / sum(w) FILTER (WHERE rn <= 30), 4) AS knn_mean30, round(sum(w * h_id) / sum(w), 4) AS knn_mean50 FROM (SELECT t.vec_id AS vec_id, h.vec_id AS h_id, 1 / (1 + list_distance(t.embedding::DOUBLE[], h.embedding::DOUBLE[])) AS w, row_number() OVER (PARTITION BY t.vec_id ORDER BY list_distance(t.embedding::DOUBLE[], h.embedding::DOUBLE[]), h.vec_id) AS rn {KNN}) WHERE rn <= 50 GROUP BY vec_id", base=False)
def k4(spark, d):
    w = 1 / (1 + F.col("dist"))
    near = neighbours(spark, d, 50).withColumn("rn", F.row_number().over(W.partitionBy("vec_id").orderBy("dist", "h_id")))
    mean = lambda k: F.round(F.sum(F.when(F.col("rn") <= k, w * F.col("h_id"))) / F.sum(F.when(F.col("rn") <= k, w)), 4).alias(f"knn_mean{k}")
    return near.groupBy("vec_id").agg(*map(mean, (10, 30, 50)))


@query("k5_knn_vote", f"SELECT vec_id, round(sum(w * (h_id % 3)) / sum(w), 5) AS relevance FROM (SELECT t.vec_id AS vec_id, h.vec_id AS h_id, 1 / (1 + list_distance(t.embedding::DOUBLE[], h.embedding::DOUBLE[])) AS w, row_number() OVER (PARTITION BY t.vec_id ORDER BY list_distance(t.embedding::DOUBLE[], h.embedding::DOUBLE[]), h.vec_id) AS rn {KNN}) WHERE rn <= 10 GROUP BY vec_id", base=False)
def k5(spark, d):
    w = 1 / (1 + F.col("dist"))
    return neighbours(spark, d, 10).groupBy("vec_id").agg(F.round(F.sum(w * (F.col("h_id") % 3)) / F.sum(w), 5).alias("relevance"))


@query("k6_similar_trials", "SELECT trial, vec_id, round(s, 6) AS similarity FROM (SELECT a.vec_id AS trial, b.vec_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id) QUALIFY row_number() OVER (PARTITION BY trial ORDER BY s DESC, vec_id) <= 20", base=False)
def k6(spark, d):
    """The 20 trials most like each hundredth one, against all, as matrices."""
    v = table(spark, d, "embeddings")
    return N.most_similar(v.where("vec_id % 100 = 0"), v, 20, "vec_id", "embedding").select(F.col("asked").alias("trial"), F.col("id").alias("vec_id"), R6("similarity").alias("similarity"))


@query("k9_cascade", ", a AS (SELECT *, row_number() OVER (PARTITION BY race_id ORDER BY score_a DESC, horse) AS ra FROM e), b AS (SELECT race_id, horse, row_number() OVER (PARTITION BY race_id ORDER BY score_b DESC, horse) AS rb, score_b, lead(score_b) OVER (PARTITION BY race_id ORDER BY score_b DESC, horse) AS nxt FROM a WHERE ra > 1), p AS (SELECT race_id, horse FROM b WHERE rb = 1 AND (score_b - coalesce(nxt, score_b)) / greatest(abs(score_b), 1e-9) > 0.1) SELECT a.race_id, a.horse, row_number() OVER (PARTITION BY a.race_id ORDER BY CASE WHEN ra = 1 THEN 0 WHEN p.horse IS NOT NULL THEN 1 ELSE 2 END, ra)::BIGINT AS place FROM a LEFT JOIN p ON a.race_id = p.race_id AND a.horse = p.horse")
def k9(spark, d):
    """The first model fixes the winner; a specialist fills the second place where it is confident; the first model's order fills the rest."""
    race = W.partitionBy("race_id")
    e = entries(spark, d).withColumn("ra", F.row_number().over(race.orderBy(F.desc("score_a"), "horse")))
    left = W.partitionBy("race_id", F.col("ra") > 1).orderBy(F.desc("score_b"), "horse")
    e = e.withColumns({"rb": F.row_number().over(left), "next": F.lead("score_b").over(left)})
    sure = (F.col("ra") > 1) & (F.col("rb") == 1) & ((F.col("score_b") - F.coalesce("next", "score_b")) / F.greatest(F.abs("score_b"), F.lit(1e-9)) > 0.1)
    order = F.when(F.col("ra") == 1, 0).when(sure, 1).otherwise(2)
    return e.select(*KEY, F.row_number().over(race.orderBy(order, "ra")).cast("long").alias("place"))
