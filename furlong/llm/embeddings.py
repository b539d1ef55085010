"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c lie sqrt(2 - 2c) apart. Rotated at random and split into blocks, two such
vectors are, in at least one block, no farther apart than that block's share of the squared distance (in
proportion to its dimensions). Each block is joined on a grid of its first coordinates, the union of what the blocks find is
verified exactly, and each link is counted in the first block that finds it.

A label of so few vectors that its parts would be sent about no oftener than a vector has blocks is not worth the blocks: its parts meet in pairs, and every pair
of vectors is compared whole. Both ways give the same links.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import components, cut

#: Dimensions of a block, and of its coordinates how many at most make the grid.
BLOCK_DIMS = 8
GRID_DIMS = 6
#: Side of a grid cell in radii of the block.
SIDE = 4.0
#: Vectors of a cell that meet in one task; a fuller cell is cut into parts that meet in pairs.
CELL = 1024
#: Vectors of a part of a label that is compared whole, and the most vectors of such a label for each block that its vectors have. A larger one goes by blocks.
#: A vector is sent as often as its label has parts; by blocks of 64 dimensions, of which few coordinates tell vectors apart, it is sent hundreds of times.
PART, DIRECT = 32768, 131072
#: Number that stands for a block in the cells of these.
WHOLE = -1
#: Vectors that are compared with all of a group at a time.
AT_ONCE = 256
#: Vectors of a label that a cell is meant to hold; the grid takes as many coordinates as that needs.
MEANT = 2000


def rotation(dims: int):
    """An orthogonal matrix, the same for the same number of dimensions."""
    import numpy as np

    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(dims)).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def budgets(dims: int, cosine: float) -> list[tuple[int, int, float]]:
    """(first, last, squared distance) of each block; the squared distances add up to 2 - 2 cosine."""
    total = 2 - 2 * cosine
    return [(a, min(a + BLOCK_DIMS, dims), total * (min(a + BLOCK_DIMS, dims) - a) / dims) for a in range(0, dims, BLOCK_DIMS)]


def _units(vectors):
    import numpy as np

    x = np.asarray(vectors, np.float64)
    # first to unit range: squares neither overflow nor vanish
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_vectors(vectors: DataFrame, cosine: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """Link vectors of equal, non-null label whose cosine in double precision is at least `cosine`.

    Result per row: vec_id, n_links (other rows linked directly), component_id (the smallest vec_id
    reachable by links, itself included), kept (vec_id = component_id). Ids are whole numbers.

    Vectors that are null, empty, zero, or hold null or non-finite components, and rows with a null label,
    link with nothing; vectors of different lengths do not link. Equal vectors of a label are one class
    and link with each other. Rows that share a vec_id are vectors of their own. A null vec_id takes no part and stands alone (null component, kept). Other columns are
    not read. No rows: no rows.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    sound = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 and 0.0 are one value
    good = rows.where(F.coalesce(sound, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    # a class goes by a number of its own, as an id may come with several vectors; the numbers are written with the classes
    classes = cut(good.groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()), "classes")
    found = link(classes.drop("least"), cosine)
    degrees = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    comps = components(found.where("kind = 1").select("a", "b")).select(F.col("node").alias("rep"), "component")
    smallest = comps.join(classes.select("rep", "least"), "rep").groupBy("component").agg(F.min("least").alias("first"))
    told = classes.join(degrees, "rep", "left").join(comps.join(smallest, "component").select("rep", "first"), "rep", "left").select("label", "v", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("first", "least").alias("component_id"))
    linked = good.select("vec_id", "label", "v").join(told, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.coalesce(sound, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def link(classes: DataFrame, cosine: float) -> DataFrame:
    """Of classes (label, v, rep, copies): rows kind 0 (a: rep, b: copies that it links to in other classes) and kind 1 (links a, b that connect all linked)."""
    sizes = classes.groupBy("label", F.size("v").alias("dims")).agg(F.count("*").alias("n")).where("n > 1")
    biggest = sizes.agg(F.max("n")).first()[0] or 0
    grid = max(1, min(GRID_DIMS, math.ceil(math.log(max(1, biggest / MEANT), 3))))
    label_type = dict(classes.dtypes)["label"]

    def spread(batches):
        """Each vector in every block: once at home, and in the cells around that its ball touches."""
        import itertools

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            frame = batch.to_pandas()
            for size, some in frame.groupby(frame["v"].map(len)):
                units = _units(np.stack(some["v"].to_list()))
                turned = units @ rotation(size)
                for number, (a, b, budget) in enumerate(budgets(size, cosine)):
                    radius = math.sqrt(budget) + 1e-9
                    at = turned[:, a : min(b, a + grid)]
                    low, home, high = (np.floor((at + d) / (SIDE * radius)).astype(np.int64) for d in (-radius, 0, radius))
                    picks = {"row": [], "cell": [], "home": []}
                    for i in range(len(some)):
                        for cell in itertools.product(*(range(x, y + 1) for x, y in zip(low[i], high[i]))):
                            picks["row"].append(i)
                            picks["cell"].append(",".join(map(str, (size, number, *cell))))
                            picks["home"].append(cell == tuple(home[i]))
                    rows = np.array(picks["row"])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some["label"].to_numpy()[rows], out[0].type), pa.array(picks["cell"]), pa.array(picks["home"]), pa.array(some["rep"].to_numpy()[rows]), pa.array(some["copies"].to_numpy()[rows]), pa.array([units_row.tobytes() for units_row in units[rows]], pa.binary())],
                        [f.name for f in out],
                    )

    def whole(batches):
        """Each vector of a label that is compared whole, once."""
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            frame = batch.to_pandas()
            for size, some in frame.groupby(frame["v"].map(len)):
                units = [row.tobytes() for row in _units(np.stack(some["v"].to_list()))]
                columns = [some["label"], [f"{size},{WHOLE}"] * len(some), [True] * len(some), some["rep"], some["copies"], units, some["parts"]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, all_)], [f.name for f in all_])

    from .postings import to_arrow

    ddl = f"label {label_type}, cell string, home boolean, rep long, copies long, unit binary"
    out, all_ = list(to_arrow(ddl)), list(to_arrow(ddl + ", parts int"))
    sized = classes.withColumn("dims", F.size("v")).join(sizes, ["label", "dims"])
    direct = F.col("n") <= DIRECT * F.ceil(F.col("dims") / BLOCK_DIMS)
    cells = sized.where(direct).select("label", "v", "rep", "copies", F.ceil(F.col("n") / PART).cast("int").alias("parts")).mapInArrow(whole, ddl + ", parts int")
    if biggest > DIRECT:
        large = sized.where(~direct).select(classes.columns)
        parts = large.mapInArrow(spread, ddl).groupBy("label", "cell").agg(F.count("*").alias("n")).where("n > 1").select("label", "cell", F.ceil(F.col("n") / CELL).cast("int").alias("parts"))
        cells = cells.unionByName(large.mapInArrow(spread, ddl).join(parts, ["label", "cell"]))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    cells = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("label", "cell", "home", "rep", "copies", "unit", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))

    def meet(group):
        import numpy as np
        import pyarrow as pa

        from .minhash import _forest

        size, number = map(int, group.column("cell")[0].as_py().split(",")[:2])
        units = np.frombuffer(b"".join(group.column("unit").to_pylist()), np.float64).reshape(-1, size)
        reps, copies, home, part, lo, hi = (group.column(c).to_numpy() for c in ("rep", "copies", "home", "part", "lo", "hi"))
        shares = budgets(size, cosine)
        ahead = len(reps)
        if number == WHOLE:
            # by part and id: each pair is compared once, those of two parts only across
            order = np.lexsort((reps, part))
            units, reps, copies, home, part = units[order], reps[order], copies[order], home[order], part[order]
            some, most = units.astype(np.float32), None
            ahead = int((part == lo[0]).sum())
        else:
            turned = units @ rotation(size)
            a, b, most = shares[number]
            some = turned[:, a:b].astype(np.float32)
            norms = (some * some).sum(axis=1)

        def apart(share, x, y):
            d = turned[x, share[0] : share[1]] - turned[y, share[0] : share[1]]
            return (d * d).sum(axis=-1)

        links, ones, others = np.zeros(len(reps)), [], []
        for i in range(0, ahead, AT_ONCE):
            # single precision with a margin finds what double precision then looks at
            first = 0 if number != WHOLE else i if lo[0] == hi[0] else ahead
            near = some[i : min(i + AT_ONCE, ahead)] @ some[first:].T
            near = near >= cosine - 1e-4 if number == WHOLE else norms[i : i + AT_ONCE, None] + norms - 2 * near <= most + 1e-5
            x, y = np.nonzero(near)
            x, y = x + i, y + first
            # a pair counts where the smaller id is at home
            if first < ahead:
                keep = home[x] & (reps[x] < reps[y])
                if lo[0] != hi[0]:
                    keep &= part[x] != part[y]
                x, y = x[keep], y[keep]
            if number != WHOLE:
                keep = apart(shares[number], x, y) <= most + 1e-9
                for share in shares[:number]:
                    keep &= apart(share, x, y) > share[2] + 1e-9
                x, y = x[keep], y[keep]
            linked = np.concatenate([(units[x[j : j + 65536]] * units[y[j : j + 65536]]).sum(axis=1) >= cosine for j in range(0, len(x), 65536)] or [np.zeros(0, bool)])
            x, y = x[linked], y[linked]
            links += np.bincount(x, copies[y], len(reps)) + np.bincount(y, copies[x], len(reps))
            forest = _forest(reps[x].tolist(), reps[y].tolist())
            ones += [p for p, _ in forest]
            others += [q for _, q in forest]
        forest = _forest(ones, others)
        met = np.flatnonzero(links)
        kinds = [0] * len(met) + [1] * len(forest)
        return pa.table({"kind": pa.array(kinds, pa.int32()), "a": pa.array([*reps[met].tolist(), *(p for p, _ in forest)], pa.int64()), "b": pa.array([*links[met].astype(np.int64).tolist(), *(q for _, q in forest)], pa.int64())})

    return cut(cells.groupBy("label", "cell", "lo", "hi").applyInArrow(meet, "kind int, a long, b long"), "vector-links")


#: DuckDB: every pair of a label, then what is reachable.
ORACLE = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(v, m) AS (SELECT DISTINCT a, a FROM links UNION SELECT b, m FROM reach JOIN links ON v = a),
least AS (SELECT v, min(m) AS m FROM reach GROUP BY v),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON v = vec_id LEFT JOIN n ON a = vec_id
"""
