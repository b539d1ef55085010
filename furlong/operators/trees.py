"""Tree ensembles from model files (M1): three JSON formats as flat arrays, walked for whole batches of rows at a time."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

#: How a node compares a value: below its threshold, up to it, above it, or equal to one of its values. Yes goes left.
BELOW, UP_TO, ABOVE, AMONG = range(4)
#: A model whose arrays take more than this is not broadcast.
MOST_BYTES = 512 << 20
#: Rows that are walked together.
ROWS = 8192


@dataclass
class Forest:
    """Trees as arrays over all their nodes. A leaf has no children (left < 0); trees of equal splits by level are tables of leaves instead.

    features: names or None of each column of the matrix. outputs: sums, tree i adds to sum i % outputs.
    """

    features: list
    outputs: int = 1
    scale: float = 1.0
    base: list[float] = field(default_factory=lambda: [0.0])
    labels: list[str] = field(default_factory=list)
    softmax: bool = False
    #: per node: column, comparison, threshold, left, right, whether a missing value goes left, its output, and where its values are in `among`
    nodes: dict = field(default_factory=dict)
    roots: list[int] = field(default_factory=list)
    among: list[list[float]] = field(default_factory=list)
    #: level tables: (columns, comparisons, thresholds, missing is yes, places in `among`, leaves)
    tables: list[tuple] = field(default_factory=list)

    def used(self) -> set[int]:
        """Columns that some split looks at."""
        import numpy as np

        n = self.nodes
        own = set(np.unique(n["column"][n["left"] >= 0]).tolist()) if n else set()
        return own | {c for t in self.tables for c in t[0]}

    def nbytes(self) -> int:
        return sum(a.nbytes for a in self.nodes.values()) + sum(len(t[5]) * 8 + 40 * len(t[0]) for t in self.tables) + sum(8 * len(v) for v in self.among)

    def score(self, x):
        """Sums of each row of x (missing: not a number) as rows by outputs."""
        import numpy as np

        out = np.zeros((len(x), self.outputs))
        missing = np.isnan(x)
        for i, root in enumerate(self.roots):
            out[:, i % self.outputs] += self._walk(x, missing, root)
        for i, table in enumerate(self.tables):
            out[:, i % self.outputs] += self._look_up(x, missing, table)
        out = self.scale * out + np.array(self.base)
        if self.softmax:
            e = np.exp(out - out.max(axis=1, keepdims=True))
            out = e / e.sum(axis=1, keepdims=True)
        return out

    def _walk(self, x, missing, root):
        import numpy as np

        n = self.nodes
        at = np.full(len(x), root)
        rows = np.flatnonzero(n["left"][at] >= 0)
        while len(rows):
            node = at[rows]
            column = n["column"][node]
            value, none, how = x[rows, column], missing[rows, column], n["how"][node]
            yes = np.where(how == BELOW, value < n["threshold"][node], value <= n["threshold"][node])
            for a in np.unique(n["among"][node[how == AMONG]]):
                here = (how == AMONG) & (n["among"][node] == a)
                yes[here] = np.isin(value[here], self.among[a])
            yes = np.where(none, n["missing_left"][node], yes)
            at[rows] = np.where(yes, n["left"][node], n["right"][node])
            rows = rows[n["left"][at[rows]] >= 0]
        return n["output"][at]

    def _look_up(self, x, missing, table):
        import numpy as np

        columns, hows, thresholds, missing_yes, among, leaves = table
        leaf = np.zeros(len(x), np.int64)
        for level, (c, how, t, m, a) in enumerate(zip(columns, hows, thresholds, missing_yes, among)):
            yes = np.isin(x[:, c], self.among[a]) if how == AMONG else x[:, c] > t
            leaf |= np.where(missing[:, c], m, yes).astype(np.int64) << level
        return leaves[leaf]


class _Nodes:
    """Collects nodes, then turns them into arrays."""

    _KINDS = {"column": "int32", "how": "int8", "threshold": "float64", "left": "int32", "right": "int32", "missing_left": "bool", "output": "float64", "among": "int32"}

    def __init__(self):
        self.rows: list[list] = []
        self.among: list[list[float]] = []

    def leaf(self, output) -> int:
        self.rows.append([0, BELOW, 0.0, -1, -1, False, float(output), -1])
        return len(self.rows) - 1

    def split(self, column, how, threshold, missing_left, values=None) -> int:
        if values is not None:
            self.among.append(sorted(values))
        self.rows.append([column, how, float(threshold), -1, -1, bool(missing_left), 0.0, len(self.among) - 1 if values is not None else -1])
        return len(self.rows) - 1

    def children(self, node, left, right):
        self.rows[node][3:5] = left, right

    def arrays(self) -> dict:
        import numpy as np

        return {name: np.array([r[i] for r in self.rows], kind) for i, (name, kind) in enumerate(self._KINDS.items())}


def _need(model, *path):
    """What lies at a path of keys; says which is missing."""
    at = model
    for i, key in enumerate(path):
        if not isinstance(at, dict) or key not in at:
            raise ValueError(f"model lacks {'.'.join(path[: i + 1])}")
        at = at[key]
    return at


def from_boosted(model: dict, features: Sequence[str] | None = None) -> Forest:
    """A model saved by XGBoost (learner.gradient_booster.model.trees, flat arrays by tree).

    A value below the condition goes left; a missing one where default_left says. A split by categories (split_type 1) sends those listed to the
    right. base_score may be a number or its text, in brackets or not. Several targets: trees go by tree_info.
    """
    learner = _need(model, "learner")
    trees = _need(learner, "gradient_booster", "model", "trees")
    param = _need(learner, "learner_model_param")
    score = _need(param, "base_score")
    base = [float(v) for v in (str(score).strip("[] ").split(",") if isinstance(score, str) else [score])]
    outputs = max(1, int(param.get("num_class", 0) or 0))
    names = list(learner.get("feature_names") or features or [None] * int(param.get("num_feature", 0)))
    nodes, roots = _Nodes(), []
    for tree in trees:
        left, right, column = (_need(tree, k) for k in ("left_children", "right_children", "split_indices"))
        condition, default, weight = (_need(tree, k) for k in ("split_conditions", "default_left", "base_weights"))
        listed = {n: tree["categories"][s : s + k] for n, s, k in zip(tree.get("categories_nodes", []), tree.get("categories_segments", []), tree.get("categories_sizes", []))}
        first = len(nodes.rows)
        for i in range(len(left)):
            if left[i] < 0:
                nodes.leaf(weight[i])
            elif i in listed:  # listed values go right: children change places
                nodes.children(nodes.split(column[i], AMONG, 0.0, not default[i], listed[i]), first + right[i], first + left[i])
            else:
                nodes.children(nodes.split(column[i], BELOW, condition[i], default[i]), first + left[i], first + right[i])
        roots.append(first)
    info = _need(learner, "gradient_booster", "model").get("tree_info") or [0] * len(roots)
    if outputs > 1 and list(info) != [i % outputs for i in range(len(roots))]:
        raise ValueError("trees of several classes are not in turn")
    return Forest(names, outputs, base=base * (outputs if len(base) == 1 else 1), nodes=nodes.arrays(), roots=roots, among=nodes.among)


def from_oblivious(model: dict, features: Sequence[str] | None = None) -> Forest:
    """A model saved by CatBoost as JSON: oblivious_trees, one split a level, the first split the lowest bit of the leaf's number.

    A float split is a 1 above its border; a missing value is a 1 where the feature's nan_value_treatment is AsTrue. A one-hot split is a 1 for
    the values listed (hashes, as the file has them); missing: 0. Columns go by flat_feature_index. Score: scale * sum + bias.
    """
    info = _need(model, "features_info")
    floats, kinds = info.get("float_features") or [], info.get("categorical_features") or []
    flat = {(k, f["feature_index"]): f.get("flat_feature_index", f["feature_index"]) for k, fs in (("f", floats), ("c", kinds)) for f in fs}
    as_true = {f["feature_index"] for f in floats if f.get("nan_value_treatment") == "AsTrue"}
    scale, bias = model.get("scale_and_bias", [1.0, [0.0]])
    names: dict[int, str | None] = {flat[k, f["feature_index"]]: f.get("feature_id") or None for k, fs in (("f", floats), ("c", kinds)) for f in fs}
    trees, among = [], []
    for tree in _need(model, "oblivious_trees"):
        levels = []
        for split in tree.get("splits") or []:
            kind = _need(split, "split_type")
            if kind == "FloatFeature":
                i = _need(split, "float_feature_index")
                levels.append((flat.get(("f", i), i), ABOVE, float(_need(split, "border")), i in as_true, -1))
            elif kind == "OneHotFeature":
                i = _need(split, "cat_feature_index")
                values = split["values"] if "values" in split else [split["value"]] if "value" in split else []
                among.append([float(v) for v in values])
                levels.append((flat.get(("c", i), i), AMONG, 0.0, False, len(among) - 1))
            else:
                raise ValueError(f"split_type {kind} is not supported")
        leaves = _need(tree, "leaf_values")
        if len(leaves) != 1 << len(levels):
            raise ValueError(f"{len(leaves)} leaves for {len(levels)} splits: one value a leaf is supported")
        trees.append((*(list(x) for x in (zip(*levels) if levels else [()] * 5)), leaves))
    width = max([c + 1 for t in trees for c in t[0]] + [c + 1 for c in names] + [0])
    named = [names.get(i) for i in range(width)]
    import numpy as np

    tables = [(*t[:5], np.array(t[5], float)) for t in trees]
    return Forest(list(features) if features else named, scale=float(scale), base=[float(bias[0] if bias else 0.0)], tables=tables, among=among)


def from_leafwise(model: dict, features: Sequence[str] | None = None) -> Forest:
    """A model dumped by LightGBM (trees or tree_info, each a nested tree_structure).

    Up to the threshold goes left; decision_type == compares with the values of `a||b||c`; a missing value goes where default_left says. Tree i
    belongs to class i % num_tree_per_iteration; an objective of several classes gives their softmax.
    """
    outputs = int(model.get("num_tree_per_iteration", 1))
    nodes, roots = _Nodes(), []
    for tree in model.get("trees") or _need(model, "tree_info"):
        # a stack, as a chain of splits may be deeper than Python calls go
        stack = [(_need(tree, "tree_structure"), None, None)]
        roots.append(len(nodes.rows))
        while stack:
            node, parent, side = stack.pop()
            if "split_feature" not in node:
                at = nodes.leaf(_need(node, "leaf_value"))
            else:
                equal = node.get("decision_type") == "=="
                at = nodes.split(node["split_feature"], AMONG if equal else UP_TO, 0.0 if equal else node["threshold"], node.get("default_left"), [float(v) for v in str(node["threshold"]).split("||")] if equal else None)
                stack += [(_need(node, "right_child"), at, 4), (_need(node, "left_child"), at, 3)]
            if parent is not None:
                nodes.rows[parent][side] = at
    labels = list(model.get("class_labels") or [])
    return Forest(list(model.get("feature_names") or features or []), outputs, base=[0.0] * outputs, labels=labels, softmax=outputs > 1, nodes=nodes.arrays(), roots=roots, among=nodes.among)


def from_nested(trees: list[dict]) -> Forest:
    """Trees as nested dicts {feature, threshold, left, right} or {value}: below the threshold, or missing, goes left."""
    names: list[str] = []
    nodes, roots = _Nodes(), []

    def add(node) -> int:
        if "value" in node:
            return nodes.leaf(node["value"])
        if node["feature"] not in names:
            names.append(node["feature"])
        at = nodes.split(names.index(node["feature"]), BELOW, node["threshold"], True)
        nodes.children(at, add(node["left"]), add(node["right"]))
        return at

    for tree in trees:
        roots.append(add(tree))
    return Forest(names, nodes=nodes.arrays(), roots=roots)


def parse(text: str, features: Sequence[str] | None = None) -> Forest:
    """The forest of a model file of any of the three formats, told apart by their keys."""
    model = json.loads(text)
    if not isinstance(model, dict):
        raise ValueError("a model file is a JSON object")
    if "learner" in model:
        return from_boosted(model, features)
    if "oblivious_trees" in model:
        return from_oblivious(model, features)
    if "trees" in model or "tree_info" in model:
        return from_leafwise(model, features)
    raise ValueError("none of the known model formats")


def read_forest(spark: SparkSession, path: str, features: Sequence[str] | None = None) -> Forest:
    """The forest of one model file, read by Spark, so that any path that Spark reads will do."""
    rows = spark.read.text(path, wholetext=True).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one file")
    return parse(rows[0][0], features)


def score_forest(df: DataFrame, forest: Forest | dict[str, Forest], features: Sequence[str] | None = None, by: str | None = None, name: str = "score", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Add the score of every row: a double, or for several outputs an array of them (probabilities under softmax).

    features: columns in the order of the model's, where the file has no names. forest may be several by a key: then `by` is the column whose value chooses
    one (M12), and a row of another value gets null. Null and NaN are missing. Arrays are broadcast once their size is checked; a batch of rows walks all trees
    together, level by level. The other columns come back as they were.
    """
    many = forest if isinstance(forest, dict) else {None: forest}
    if not many:
        raise ValueError("no model")
    if (size := sum(f.nbytes() for f in many.values())) > most_bytes:
        raise ValueError(f"models of {size} bytes are not broadcast (most_bytes={most_bytes})")
    columns = {k: [*(features or f.features)] for k, f in many.items()}
    for k, f in many.items():
        lacking = {i if i >= len(columns[k]) else columns[k][i] or i for i in f.used() if i >= len(columns[k]) or columns[k][i] not in df.columns}
        if lacking:
            raise ValueError(f"trees use features that the table lacks: {sorted(map(str, lacking))}")
    wanted = list(dict.fromkeys(columns[k][i] for k, f in many.items() for i in sorted(f.used())))
    outputs = {f.outputs for f in many.values()}
    if len(outputs) > 1:
        raise ValueError("models of one column have one number of outputs")
    single = outputs == {1}
    held = df.sparkSession.sparkContext.broadcast((many, columns, wanted))
    kept = df.columns
    # longer than any column's name, so none of theirs
    fresh = "_" + max(kept, key=len)
    kind = DoubleType() if single else ArrayType(DoubleType())

    def score(batches):
        import numpy as np
        import pyarrow as pa

        many, columns, wanted = held.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                # of a nested column only the values that Spark put last are read
                values = {c: part.column(len(kept) + i).to_numpy(zero_copy_only=False) for i, c in enumerate(wanted)}
                keys = part.column(len(kept) + len(wanted)).to_pylist() if by else None
                out = np.full((part.num_rows, next(iter(many.values())).outputs), np.nan)
                known = np.zeros(part.num_rows, bool)
                for k, f in many.items():
                    rows = np.flatnonzero([x == k for x in keys]) if by else np.arange(part.num_rows)
                    if not len(rows):
                        continue
                    x = np.full((len(rows), max(f.used(), default=-1) + 1), np.nan)
                    for i in f.used():
                        x[:, i] = values[columns[k][i]][rows]
                    out[rows], known[rows] = f.score(x), True
                scores = pa.array(out[:, 0], mask=~known) if single else pa.array([r.tolist() if ok else None for r, ok in zip(out, known)], pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], scores], [*kept, name])

    rows = df.select(*(F.col(f"`{c}`") for c in kept), *(F.col(f"`{c}`").cast("double").alias(f"{fresh}{i}") for i, c in enumerate(wanted)), *([F.col(by).cast("string").alias(f"{fresh}by")] if by else []))
    return rows.mapInArrow(score, StructType([*df.schema.fields, StructField(name, kind)]))
