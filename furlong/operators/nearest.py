"""Exact nearest neighbours within groups (J10, K4, K5) by a pivot index: blocks of rows with rings around pivots, and a bound that shrinks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut

#: Vectors that all distances are compared with; a block knows between which distances from each of them its rows lie.
PIVOTS = 12
#: Rings that a pivot's rows are cut into, and rows of a block at most on average.
RINGS, BLOCK = 16, 512
#: Targets that meet a block in one call.
CHUNK = 2048


def _placed(rows: DataFrame, id: str, by: Sequence[str], vec: str, pivots) -> DataFrame:
    """by, id, v, to (distances to the pivots) and near (number of the nearest) of rows whose vector is whole."""

    def place(batches):
        import numpy as np
        import pyarrow as pa

        centres = np.array(pivots)
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("v")
            v = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            to = np.stack([np.sqrt(((v - c) ** 2).sum(axis=1)) for c in centres], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(to.tolist(), pa.list_(pa.float64())), pa.array(to.argmin(axis=1), pa.int32())], [*batch.schema.names, "to", "near"])

    v = rows.select(*by, F.col(id).alias("id"), F.col(vec).cast("array<double>").alias("v"))
    whole = v.where(F.col("id").isNotNull() & (F.size("v") == len(pivots[0])) & F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    kinds = dict(whole.dtypes)
    return whole.mapInArrow(place, ", ".join(f"`{c}` {kinds[c]}" for c in whole.columns) + ", to array<double>, near int")


def _measured(pairs: DataFrame, blocks: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    """t, h, dist of the k nearest rows of each block for each target that meets it, no farther than its bound. pairs: by, block, t, x, bound."""
    keys = ["block", "chunk"]
    chunked = pairs.withColumn("chunk", F.pmod(F.xxhash64("t"), F.ceil(F.count("*").over(_over("block")) / CHUNK)).cast("int"))
    chunks = chunked.select("block", F.col("chunk").alias("of")).distinct()

    def meet(key, left, right):
        import numpy as np
        import pyarrow as pa

        empty = pa.table({"t": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "dist": pa.array([], pa.float64())})
        if not left.num_rows or not right.num_rows:
            return empty
        rows = lambda c: c.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)
        t, bound, x = left.column("t").to_numpy(), left.column("bound").to_numpy(), rows(left.column("x"))
        h, y = right.column("id").to_numpy(), rows(right.column("v"))
        order = np.argsort(h)
        h, y = h[order], y[order]
        found = []
        for i in range(len(t)):
            n = np.searchsorted(h, t[i])
            d = np.sqrt(((y[:n] - x[i]) ** 2).sum(axis=1))
            best = np.flatnonzero(d <= bound[i])
            best = best[np.argsort(d[best], kind="stable")[:k]]
            found.append((np.full(len(best), t[i]), h[best], d[best]))
        return pa.table([np.concatenate([f[i] for f in found]) for i in range(3)], ["t", "h", "dist"])

    left = chunked.select(*keys, "t", "x", "bound").groupBy(*keys)
    right = blocks.join(chunks, "block").select(F.col("block").alias("its"), "of", "id", "v").groupBy("its", "of")
    return left.cogroup(right).applyInArrow(meet, "t long, h long, dist double")


#: Asked rows and rows of a part that meet in one call of most_similar, and asked rows that are compared at a time.
ASKED, ROWS, AT_ONCE = 8192, 65536, 128


def most_similar(asked: DataFrame, rows: DataFrame, k: int, id: str, vec: str) -> DataFrame:
    """(asked, id, similarity) of the k other rows most like each asked one by cosine, equal ones by id (K6): all pairs are compared, none is laid out.

    Blocks of asked rows meet parts of all rows as matrices, and at most k rows of each go on. Products in any order find who may be among them; their cosines are then added up one
    component after another, so that equal vectors have equal ones, and DuckDB's. A cosine that is not defined (a null or zero vector, other lengths, components that are null or not finite) is null and comes last.
    """
    v = F.col("v")
    sound = (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    sides = [df.select(F.col(id).cast("long").alias("id"), F.col(vec).cast("array<double>").alias("v")).where("id is not null").withColumn("v", F.when(sound, v)) for df in (asked, rows)]
    n, m = (max(1, math.ceil(df.count() / size)) for df, size in zip(sides, (ASKED, ROWS)))

    def dealt(df, mine, block, other, others):
        """Each row once for every block of the other side."""
        return df.withColumn(mine, F.pmod(F.xxhash64("id"), F.lit(block)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))

    def matrix(table):
        """Ids in order, and by length of the vector (0: none) where the rows are and what they hold."""
        import numpy as np

        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        lists = table.column("v").combine_chunks().take(order)
        size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flat, starts = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(size) - size
        at = {int(d): np.flatnonzero(size == d) for d in np.unique(size)}
        return ids[order], {d: (rows, flat[starts[rows][:, None] + np.arange(d)]) for d, rows in at.items()}

    def fold(x, y):
        import numpy as np

        total = np.zeros(len(x))
        for i in range(x.shape[1]):
            total += x[:, i] * y[:, i]
        return total

    def meet(key, left, right):
        import numpy as np
        import pyarrow as pa

        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            (a, asked_by), (b, rows_by) = matrix(left), matrix(right)
            with np.errstate(all="ignore"):
                unit = lambda v: v / np.sqrt((v * v).sum(axis=1, keepdims=True))
                units = {d: unit(v) for d, (_, v) in rows_by.items()}
                for d, (at, x) in asked_by.items():
                    for i in range(0, len(at), AT_ONCE):
                        near = np.full((len(at[i : i + AT_ONCE]), len(b)), -3.0)
                        if d and d in rows_by:
                            rough = unit(x[i : i + AT_ONCE]) @ units[d].T
                            near[:, rows_by[d][0]] = np.where(np.isfinite(rough), rough, -3.0)
                        for j, line in enumerate(near):
                            me = a[at[i + j]]
                            # one more than asked for, as the row itself is among them
                            least = np.partition(line, -k - 1)[-k - 1] - 1e-9 if len(line) > k + 1 else -4.0
                            if least < -2:
                                # what has no cosine goes by id: the first few are enough
                                some = np.union1d(np.flatnonzero(line > -2), np.flatnonzero(line <= -2)[: k + 1])
                            else:
                                some = np.flatnonzero(line >= least)
                            some = some[b[some] != me]
                            s, real = np.full(len(some), -3.0), line[some] > -2
                            if real.any():
                                y = rows_by[d][1][np.searchsorted(rows_by[d][0], some[real])]
                                z = np.broadcast_to(x[i + j], y.shape)
                                s[real] = np.clip(fold(z, y) / (np.sqrt(fold(z, z)) * np.sqrt(fold(y, y))), -1, 1)
                            best = np.lexsort((b[some], -s))[:k]
                            found.append((np.full(len(best), me), b[some][best], s[best]))
        out = [np.concatenate([f[i] for f in found]) for i in range(3)]
        return pa.table({"asked": pa.array(out[0], pa.int64()), "id": pa.array(out[1], pa.int64()), "similarity": pa.array(out[2], pa.float64(), mask=out[2] < -2)})

    left, right = dealt(sides[0], "_a", n, "_b", m).groupBy("_a", "_b"), dealt(sides[1], "_b", m, "_a", n).groupBy("_a", "_b")
    near = left.cogroup(right).applyInArrow(meet, "asked long, id long, similarity double")
    rank = F.row_number().over(_over("asked").orderBy(F.desc_nulls_last("similarity"), "id"))
    return near.withColumn("_n", rank).where(F.col("_n") <= k).drop("_n")


def _over(*by):
    from pyspark.sql import Window

    return Window.partitionBy(*by)


def earlier_neighbours(targets: DataFrame, history: DataFrame, k: int, by: Sequence[str], id: str, vec: str, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """(id, h_id, dist) of the k nearest rows of history, among those equal in `by` with a smaller id, of each target; equal distances go by h_id.

    History is cut into blocks of about `block` rows: by nearest pivot, ring of distance from it, and a hash within a ring. A block keeps the least and the largest distance of its
    rows from every pivot, so that no row of it is nearer to a target than those allow. A target first meets the block where it would lie itself: its k-th
    distance there bounds what follows. Then it meets the blocks that may hold something nearer, in two steps, the most promising before the others, with the bound
    drawn in between. A target meets summaries of blocks, not rows; blocks and targets are measured as matrices, and at most k rows of each pair go on.

    Rows whose id or vector is null, or whose vector has another length than the pivots' or is not finite, are no neighbours and have none. Null groups match
    nothing. Ids are unique, whole numbers.
    """
    by = list(by)
    seeds = history.where(F.col(vec).isNotNull() & F.col(id).isNotNull()).select(F.col(vec).cast("array<double>").alias("v"), id).orderBy(F.xxhash64(id), id).limit(pivots).collect()
    seeds = [list(r.v) for r in seeds if r.v and None not in r.v]
    seeds = [v for v in seeds if len(v) == len(seeds[0])]
    if not seeds:
        return targets.select(F.col(id), F.col(id).alias("h_id"), F.lit(0.0).alias("dist")).where("1 = 0")
    p = len(seeds)
    placed = cut(_placed(history, id, by, vec, seeds), "knn-rows")
    own = F.get("to", F.col("near"))
    ends = placed.groupBy(*by, "near").agg(F.min(own).alias("lo"), F.max(own).alias("hi"))
    ring = F.least(F.lit(RINGS - 1), F.floor(F.coalesce(F.try_divide(own - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.0)) * RINGS)).cast("int")
    ringed = placed.join(ends, [*by, "near"]).withColumn("ring", ring).drop("lo", "hi")
    parts = ringed.groupBy(*by, "near", "ring").agg(F.ceil(F.count("*") / block).alias("parts"))
    name = F.to_json(F.struct(*by, "near", "ring", "part"))
    blocks = cut(ringed.join(parts, [*by, "near", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("block", name).drop("part", "parts"), "knn-blocks")
    rings = cut(blocks.groupBy(*by, "block").agg(F.min("id").alias("first"), *(f(F.col("to")[i]).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(p))), "knn-rings")

    asked = cut(_placed(targets, id, by, vec, seeds).withColumnsRenamed({"id": "t", "v": "x"}), "knn-targets")
    # no row of the block is nearer than the farthest of its rings is
    least = F.greatest(F.lit(0.0), *(F.greatest(F.col(f"lo{i}") - F.col("to")[i], F.col("to")[i] - F.col(f"hi{i}")) for i in range(p)))
    met = cut(asked.drop("near").join(rings, by).where("first < t").select("t", "x", "block", (least * (1 - 1e-12)).alias("least")), "knn-pairs")
    rank = F.row_number().over(_over("t").orderBy("least", "block"))
    met = met.withColumn("step", F.when(rank == 1, 0).when(rank <= 9, 1).otherwise(2))

    found = None
    bounds = asked.select("t", F.lit(float("inf")).alias("bound"))
    for step in range(3):
        pairs = met.where(F.col("step") == step).join(bounds, "t").where("least <= bound").select("t", "x", "block", "bound")
        got = _measured(pairs, blocks.select("block", "id", "v"), by, k)
        got = got if found is None else found.unionByName(got)
        best = got.withColumn("n", F.row_number().over(_over("t").orderBy("dist", "h"))).where(F.col("n") <= k)
        found = cut(best.drop("n"), "knn-found")
        bounds = asked.select("t").join(found.groupBy("t").agg(F.when(F.count("*") >= k, F.max("dist")).alias("bound")), "t", "left").select("t", F.coalesce("bound", F.lit(float("inf"))).alias("bound"))
    return found.select(F.col("t").alias(id), F.col("h").alias("h_id"), "dist")
