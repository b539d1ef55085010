"""Model files of three formats against a plain walk of the files themselves."""

import json
import math
import random

import pytest

from furlong.operators import trees as T

WIDTH = 6
#: Column 4 is a category.
CATEGORY = 4


def rows(n, seed=0):
    rng = random.Random(seed)
    return [tuple(None if rng.random() < 0.2 else math.nan if rng.random() < 0.05 else float(rng.randrange(4)) if c == CATEGORY else round(rng.uniform(-2, 2), 2) for c in range(WIDTH)) for _ in range(n)]


def absent(v):
    return v is None or math.isnan(v)


def oblivious(trees, depth, seed=1):
    rng = random.Random(seed)
    floats = [i for i in range(WIDTH) if i != CATEGORY]
    info = [{"feature_index": k, "flat_feature_index": c, "nan_value_treatment": rng.choice(["AsIs", "AsTrue", "AsFalse"])} for k, c in enumerate(floats)]
    out = []
    for _ in range(trees):
        d = rng.randrange(depth + 1)
        splits = [{"split_type": "OneHotFeature", "cat_feature_index": 0, "values": rng.sample(range(4), 2)} if rng.random() < 0.2 else {"split_type": "FloatFeature", "float_feature_index": rng.randrange(len(floats)), "border": round(rng.uniform(-2, 2), 2)} for _ in range(d)]
        out.append({"splits": splits, "leaf_values": [rng.uniform(-1, 1) for _ in range(1 << d)]})
    return {"features_info": {"float_features": info, "categorical_features": [{"feature_index": 0, "flat_feature_index": CATEGORY}]}, "oblivious_trees": out, "scale_and_bias": [0.5, [0.125]]}


def walk_oblivious(model, row):
    floats = model["features_info"]["float_features"]
    total = 0.0
    for tree in model["oblivious_trees"]:
        leaf = 0
        for bit, s in enumerate(tree["splits"]):
            if s["split_type"] == "OneHotFeature":
                yes = not absent(row[CATEGORY]) and row[CATEGORY] in s["values"]
            else:
                f = floats[s["float_feature_index"]]
                v = row[f["flat_feature_index"]]
                yes = f["nan_value_treatment"] == "AsTrue" if absent(v) else v > s["border"]
            leaf += yes << bit
        total += tree["leaf_values"][leaf]
    return 0.5 * total + 0.125


def boosted(trees, depth, seed=2, classes=0):
    rng = random.Random(seed)
    out = []
    for _ in range(trees):
        t = {k: [] for k in ("left_children", "right_children", "split_indices", "split_conditions", "base_weights", "default_left", "categories", "categories_nodes", "categories_segments", "categories_sizes")}

        def add(d, t=t):
            at = len(t["left_children"])
            leaf = d == 0 or rng.random() < 0.1
            c = rng.randrange(WIDTH)
            for k, v in (("left_children", -1), ("right_children", -1), ("split_indices", 0 if leaf else c), ("split_conditions", round(rng.uniform(-2, 2), 2)), ("base_weights", rng.uniform(-1, 1)), ("default_left", rng.randrange(2))):
                t[k].append(v)
            if not leaf:
                if c == CATEGORY:
                    values = rng.sample(range(4), 2)
                    t["categories_nodes"].append(at)
                    t["categories_segments"].append(len(t["categories"]))
                    t["categories_sizes"].append(len(values))
                    t["categories"] += values
                t["left_children"][at] = add(d - 1)
                t["right_children"][at] = add(d - 1)
            return at

        add(depth)
        out.append(t)
    return {"learner": {"feature_names": [], "learner_model_param": {"base_score": "[-3.5E-1]", "num_feature": str(WIDTH), "num_class": str(classes)}, "gradient_booster": {"model": {"trees": out, "tree_info": [i % max(1, classes) for i in range(trees)]}}}}


def walk_boosted(model, row, classes=1):
    total = [-0.35] * classes
    for i, t in enumerate(model["learner"]["gradient_booster"]["model"]["trees"]):
        at = 0
        while t["left_children"][at] != -1:
            v = row[t["split_indices"][at]]
            if absent(v):
                left = t["default_left"][at]
            elif at in t["categories_nodes"]:
                k = t["categories_nodes"].index(at)
                left = v not in t["categories"][t["categories_segments"][k] :][: t["categories_sizes"][k]]
            else:
                left = v < t["split_conditions"][at]
            at = t["left_children" if left else "right_children"][at]
        total[i % classes] += t["base_weights"][at]
    return total


def leafwise(trees, depth, classes, seed=3):
    rng = random.Random(seed)

    def node(d):
        if d == 0 or rng.random() < 0.1:
            return {"leaf_value": rng.uniform(-1, 1)}
        c = rng.randrange(WIDTH)
        how = {"decision_type": "==", "threshold": "||".join(map(str, rng.sample(range(4), 2)))} if c == CATEGORY else {"decision_type": "<=", "threshold": round(rng.uniform(-2, 2), 2)}
        return {"split_feature": c, "default_left": rng.random() < 0.5, "left_child": node(d - 1), "right_child": node(d - 1), **how}

    return {"num_class": classes, "num_tree_per_iteration": classes, "class_labels": [f"k{i}" for i in range(classes)], "feature_names": [f"f{i}" for i in range(WIDTH)], "trees": [{"tree_structure": node(depth)} for _ in range(trees)]}


def walk_leafwise(model, row):
    k = model["num_tree_per_iteration"]
    total = [0.0] * k
    for i, tree in enumerate(model["trees"]):
        n = tree["tree_structure"]
        while "split_feature" in n:
            v = row[n["split_feature"]]
            left = n["default_left"] if absent(v) else v in map(float, n["threshold"].split("||")) if n["decision_type"] == "==" else v <= n["threshold"]
            n = n["left_child" if left else "right_child"]
        total[i % k] += n["leaf_value"]
    if k == 1:
        return total
    e = [math.exp(v - max(total)) for v in total]
    return [v / sum(e) for v in e]


@pytest.fixture(scope="module")
def table(spark):
    """Rows with an extra column named like the scorer's own, and a nested one."""
    data = rows(300)
    schema = "id int, " + ", ".join(f"f{i} double" for i in range(WIDTH)) + ", _x0 string, nested struct<a:int,b:array<string>>"
    return data, spark.createDataFrame([(i, *r, "kept", (1, ["z"])) for i, r in enumerate(data)], schema).repartition(3)


def scored(df, forest, **how):
    got = T.score_forest(df, forest, **how)
    assert got.columns == [*df.columns, "score"]
    out = {r.id: r for r in got.collect()}
    assert all(r["_x0"] == "kept" and r.nested.b == ["z"] for r in out.values())
    return {i: r.score for i, r in out.items()}


NAMES = [f"f{i}" for i in range(WIDTH)]


def test_oblivious_trees(table, spark):
    data, df = table
    model = oblivious(60, 6)
    got = scored(df, T.parse(json.dumps(model), NAMES))
    assert all(got[i] == pytest.approx(walk_oblivious(model, r), abs=1e-12) for i, r in enumerate(data)) and len(got) == len(data)


def test_boosted_trees(table, spark):
    data, df = table
    model = boosted(60, 6)
    got = scored(df, T.parse(json.dumps(model), NAMES))
    assert all(got[i] == pytest.approx(walk_boosted(model, r)[0], abs=1e-12) for i, r in enumerate(data))
    many = boosted(30, 4, classes=3)
    got = scored(df, T.parse(json.dumps(many), NAMES))
    assert all(got[i] == pytest.approx(walk_boosted(many, r, 3), abs=1e-12) for i, r in enumerate(data))


@pytest.mark.parametrize("classes", [1, 4])
def test_leafwise_trees(table, spark, classes):
    data, df = table
    model = leafwise(40, 6, classes)
    got = scored(df, T.parse(json.dumps(model)))
    for i, r in enumerate(data):
        want = walk_leafwise(model, r)
        assert got[i] == pytest.approx(want if classes > 1 else want[0], abs=1e-12)


def test_a_chain_of_splits_is_read(spark):
    node = {"leaf_value": 7.0}
    for i in range(5000):
        node = {"split_feature": 0, "threshold": float(i), "decision_type": "<=", "default_left": True, "left_child": node, "right_child": {"leaf_value": -1.0}}
    # as a dict: json itself does not read nesting this deep
    forest = T.from_leafwise({"feature_names": ["f0"], "trees": [{"tree_structure": node}]})
    df = spark.createDataFrame([(-1.0,), (None,), (9999.0,)], "f0 double")
    assert [r.score for r in T.score_forest(df, forest).collect()] == [7.0, 7.0, -1.0]


def test_files_routing_and_refusals(table, spark, tmp_path):
    data, df = table
    (tmp_path / "m.json").write_text(json.dumps(boosted(3, 3), indent=1))
    forest = T.read_forest(spark, str(tmp_path / "m.json"), NAMES)
    other = T.parse(json.dumps(oblivious(4, 3)), NAMES)
    by = df.withColumn("which", df.id.cast("int") % 3)
    got = T.score_forest(by, {"0": forest, "1": other}, by="which").collect()
    a, b = scored(df, forest), scored(df, other)
    assert len(got) == len(data) and all(r.score == (a[r.id] if r.which == 0 else b[r.id] if r.which == 1 else None) for r in got)
    assert T.score_forest(df.where("1 = 0"), forest).count() == 0
    for bad in ("{}", "[]", '{"learner": {}}', '{"oblivious_trees": [{"splits": [], "leaf_values": [1, 2]}], "features_info": {}}', '{"trees": [{}]}'):
        with pytest.raises(ValueError):
            T.parse(bad)
    with pytest.raises(ValueError, match="lacks"):
        T.score_forest(df.drop("f1", "f2"), forest)
    with pytest.raises(ValueError, match="most_bytes"):
        T.score_forest(df, forest, most_bytes=10)


def test_constant_trees(spark):
    df = spark.createDataFrame([(1,)], "id int")
    assert T.score_forest(df, T.from_nested([{"value": 2}, {"value": 0.5}])).first().score == 2.5
