"""Rule-driven lineage and hourly weather on hand-made rows."""

import datetime

import pytest

from furlong.operators import lineage as N
from furlong.plans import layers as L

TARGETS = [("oaks", 1, "Oaks", None, None, None), ("oaks", 0, None, "aks", 7, None), ("cup", 2, None, "Cup", None, 1600)]
TRIALS = [("oaks", "Trial", None, 30), ("oaks", None, "ial", 60), ("cup", None, "Oaks", 100)]


def rules(spark):
    return spark.createDataFrame(TARGETS, "target string, priority int, equals string, contains string, venue int, distance int"), spark.createDataFrame(TRIALS, "target string, equals string, contains string, look_back int")


def test_lineage_equals_a_plain_loop(spark):
    import random

    rng = random.Random(4)
    names = ["Oaks", "Trial", "Big Trial", "Cup", "Cup Oaks", "other", None]
    races = {i: (rng.choice(names), rng.randrange(5, 9), rng.choice([1600, 2000]), rng.randrange(0, 150)) for i in range(80)}
    rows = [(r, h, races[r][3], rng.choice([None, 1, 2, 3, 4]), rng.random(), races[r][1], races[r][2], races[r][0]) for r in races for h in rng.sample(["a", "b", "c", None], 3)]
    df = spark.createDataFrame(rows, "race_id int, horse string, day int, finish int, margin double, venue int, distance int, name string").repartition(3)
    got = N.trial_record(df, *rules(spark)).collect()
    assert len(got) == len(rows)
    fits = lambda text, eq, con: text is not None and (text == eq if eq is not None else con in text)

    def target(r):
        name, venue, distance, _ = races[r]
        hits = [(p, t) for t, p, eq, con, v, d in TARGETS if fits(name, eq, con) and v in (None, venue) and d in (None, distance)]
        return min(hits)[1] if hits else None

    for g in got:
        t = target(g.race_id)
        met = [x for x in rows for tr, eq, con, back in TRIALS if t and tr == t and fits(x[7], eq, con) and x[1] == g.horse and g.horse and x[3] is not None and x[2] < g.day and g.day - x[2] <= back]
        top = [x[4] for x in met if x[3] <= 2]
        assert (g.target, g.trial_count, g.trial_wins, g.trial_top3) == (t, len(met), sum(x[3] == 1 for x in met), sum(x[3] <= 3 for x in met))
        assert g.trial_best == min((x[3] for x in met), default=None)
        assert g.trial_margin == (pytest.approx(sum(top) / len(top)) if top else None)


def test_lineage_of_nothing(spark):
    t, r = rules(spark)
    df = spark.createDataFrame([(1, "a", 5, 1, 0.0, 7, 1600, "Oaks")], "race_id int, horse string, day int, finish int, margin double, venue int, distance int, name string")
    assert N.trial_record(df.where("1 = 0"), t, r).count() == 0
    row = N.trial_record(df, t.where("1 = 0"), r).first()
    assert row.target is None and row.trial_count == 0


def test_weather_takes_the_newest_hour_that_is_fresh(spark):
    at = lambda d, h, m=0: datetime.datetime(2024, 1, d, h, m)
    races = [(1, 7, at(5, 12)), (2, 7, at(5, 11, 59)), (3, 7, at(5, 20)), (4, 7, at(6, 2)), (5, 8, at(5, 12)), (6, 7, at(4, 1)), (7, None, at(5, 12))]
    df = spark.createDataFrame([(r, h, v, s) for r, v, s in races for h in ("a", "b")], "race_id int, horse string, venue int, starts timestamp")
    hours = [(7, at(5, 12), 250.0, "rain"), (7, at(5, 10), 40.0, "sun"), (7, at(5, 23), -3.0, "snow"), (9, at(5, 12), 1.0, "far"), (None, at(5, 12), 1.0, "nowhere")]
    hourly = spark.createDataFrame(hours, "venue int, hour timestamp, reading double, kind string")
    got = {r.race_id: (r.weather, r.going, r.hours_old) for r in L.weather(df, hourly, 6).collect()}
    assert L.weather(df, hourly, 6).count() == len(races) * 2
    # on the hour itself; before it, the one before; eight hours after, none; over midnight; another venue; before all readings; no venue
    assert got == {1: ("rain", 1.0, 0), 2: ("sun", 0.4, 1), 3: (None, None, None), 4: ("snow", 0.0, 3), 5: (None, None, None), 6: (None, None, None), 7: (None, None, None)}
    with pytest.raises(ValueError):
        L.weather(df, hourly, 25)
