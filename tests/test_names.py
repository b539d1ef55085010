"""Abbreviations and slips against all pairs."""

import random
import re

from furlong.operators import names as N


def words(name):
    return re.sub(r"[.\s·・]+", " ", name.lower()).strip() if name else ""


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def fit(a, b):
    a, b = words(a), words(b)
    if not a or not b:
        return None
    if a == b:
        return 0
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and all(q.startswith(p) for p, q in zip(x, y)):
        return 1
    return 2 if 4 <= len(a) <= 60 and 4 <= len(b) <= 60 and one_edit(a, b) else None


def test_names_equal_all_pairs(spark):
    rng = random.Random(5)
    full = ["John Smith", "John Smithers", "Jane Smith", "Jon Smith", "Ann Lee", "Ann-Marie Lee", "デムーロ", "M. デムーロ", "X", "van der Berg", "Ｍ・ルメール", "", None, "  ", "John Smith"]
    short = ["J. Smi", "john smith", "Jo Sm", "J.S", "デム", "M.デム", "v. d. b.", "Jon Smith", "Ann Le", "Jane Smyth", "x", None, "", "...", "Johnsmith", "a" * 70, "Berg"]
    syllables = ["ka", "to", "mi", "ren", "o", "sho"]
    full += [" ".join("".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(rng.randrange(1, 3))) for _ in range(60)]
    short += [" ".join(w[: rng.randrange(1, 5)] for w in f.split(" ")) for f in full[-40:]] + [f[: (k := rng.randrange(len(f)))] + f[k + 1 :] for f in full[-40:] if len(f) > 1]
    a = spark.createDataFrame(list(enumerate(short)), "id int, name string")
    b = spark.createDataFrame([(i + 1000, f) for i, f in enumerate(full)], "id int, name string")
    got = sorted((r.id, r.target, r.kind, r.ambiguous) for r in N.match_names(a, b, "id", "id", "name", "name").collect())
    want = []
    for i, s in enumerate(short):
        fits = {j + 1000: k for j, f in enumerate(full) if (k := fit(s, f)) is not None}
        best = [j for j, k in fits.items() if k == min(fits.values())]
        want += [(i, j, ("equal", "abbreviated", "slip")[fits[j]], len(best) > 1) for j in best]
    assert got == sorted(want)
    kinds = {(short[i], full[t - 1000]): k for i, t, k, _ in got}
    assert kinds["J. Smi", "John Smith"] == "abbreviated" and kinds["Jane Smyth", "Jane Smith"] == "slip" and kinds["M.デム", "M. デムーロ"] == "abbreviated"
    assert all(amb for i, t, k, amb in got if short[i] == "J. Smi")


def test_no_product_of_names(spark):
    a = spark.createDataFrame([(1, "a b")], "id int, name string")
    plan = N.match_names(a, a.withColumn("id", a.id + 1), "id", "id", "name", "name")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    assert N.match_names(a.where("1 = 0"), a, "id", "id", "name", "name").count() == 0


def test_a_name_of_many_ids_is_matched_once(spark):
    """Thousands of ids of few names; an id with several names goes by its best. No side laid out by keys is broadcast, though the tables look small."""
    rows = [(i, ("J. Smith", "Ann Le", "nobody")[i % 3]) for i in range(3000)] + [(0, "John Smith"), (1, "x")]
    full = spark.createDataFrame([(1, "John Smith"), (2, "Jane Smith"), (3, "Ann Lee")], "id int, name string")
    made = N.match_names(spark.createDataFrame(rows, "id int, name string"), full, "id", "id", "name", "name")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Generate " not in plan and plan.count("BroadcastExchange") == 1
    got = {}
    for r in made.collect():
        got.setdefault(r.id, []).append((r.target, r.kind, r.ambiguous))
    assert got[0] == [(1, "equal", False)] and got[1] == [(3, "abbreviated", False)] and sorted(got[3]) == [(1, "abbreviated", True), (2, "abbreviated", True)]
    assert set(got) == {i for i in range(3000) if i % 3 < 2}
