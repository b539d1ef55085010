"""Centroid clustering on bit planes: whole components, and exact distances by AND and population counts."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Components of a vector: one bit plane of them is one 64-bit word.
DIMS = 64
#: A vector whose squared length (in whole components) is not below this can be too far from a centroid for a 64-bit distance.
MOST = 2.0**60
#: Vectors whose distances are computed at a time.
CHUNK = 4096


def whole(vectors, scale: int):
    """floor(scale * x) of vectors (rows of doubles) as int64, and which rows are short enough."""
    import numpy as np

    scaled = np.floor(vectors * scale)
    fits = (scaled * scaled).sum(axis=1) < MOST
    return np.where(fits[:, None], scaled, 0).astype(np.int64), fits


def planes(rows):
    """Bit planes of rows of 64 whole numbers: word p of a row has bit p of each component; the last plane is the sign's."""
    import numpy as np

    most = int(max(rows.max(initial=0), -(rows.min(initial=0) + 1)))
    bits = np.arange(most.bit_length() + 1)
    return np.packbits((rows[:, None, :] >> bits[:, None]) & 1 > 0, axis=2).view(np.uint64)[:, :, 0]


def numbers(words):
    """The rows that planes() was given."""
    import numpy as np

    bits = np.unpackbits(np.ascontiguousarray(words)[:, :, None].view(np.uint8), axis=2)
    return np.einsum("npd,p->nd", bits.astype(np.int64), weights(words.shape[1]))


def weights(n: int):
    """What a bit of each plane counts: powers of two, the sign's below nought."""
    import numpy as np

    return np.array([1 << p for p in range(n - 1)] + [-(1 << n - 1)], np.int64)


def dots(a, b):
    """Dot products of all rows of a with all of b, both as planes."""
    import numpy as np

    out = np.zeros((len(a), len(b)), np.int64)
    for p, u in enumerate(weights(a.shape[1]).tolist()):
        for q, v in enumerate(weights(b.shape[1]).tolist()):
            out += np.bitwise_count(a[:, p, None] & b[:, q]) * np.int64(u * v)
    return out


def squares(words):
    """Squared lengths of rows as planes."""
    import numpy as np

    out = np.zeros(len(words), np.int64)
    for p, u in enumerate(weights(words.shape[1]).tolist()):
        for q, v in enumerate(weights(words.shape[1]).tolist()):
            out += np.bitwise_count(words[:, p] & words[:, q]) * np.int64(u * v)
    return out


def nearest(words, centroids):
    """Number of the nearest centroid (the smallest of equals) and the squared distance to it, of rows as planes."""
    import numpy as np

    centres = planes(np.array(centroids, np.int64))
    lengths, cluster, distance = squares(centres), [], []
    for i in range(0, len(words), CHUNK):
        part = words[i : i + CHUNK]
        far = lengths - 2 * dots(part, centres)
        cluster.append(far.argmin(axis=1))
        distance.append(far.min(axis=1) + squares(part))
    return np.concatenate(cluster), np.concatenate(distance)


def _read(column):
    """Planes of an Arrow binary column; rows with fewer planes repeat their sign's."""
    import numpy as np

    rows = [np.frombuffer(x, np.uint64) for x in column.to_pylist()]
    most = max(map(len, rows))
    if all(len(x) == most for x in rows):
        return np.stack(rows)
    return np.stack([np.concatenate([x, np.full(most - len(x), x[-1], np.uint64)]) for x in rows])


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Lloyd's rounds from seeded centroids in exact whole numbers.

    Kept are vectors of 64 components of which none is null or not finite; a component x becomes floor(scale * x). Centroids 0, 1, ... start as the k
    kept vectors with the smallest sha256 of `<seed>:<id>` (ids in decimal; equal hashes, as of repeated ids, go by the vectors' planes; null ids come
    last). Each round gives every vector the nearest centroid (squared distance; the smaller number of equals) and moves each
    centroid that has vectors to floor(sum / count) of each component. Result per kept vector: vec_id, cluster, distance, and, after the last
    assignment, cluster_inertia, inertia and centroid_sha256 of its cluster.

    Vectors are packed once, a word of 64 bits a bit plane, and written; each round reads them, and brings k * 64 sums to the driver. Repeated
    rows are vectors of their own. Fewer than k vectors: as many centroids. Vectors of other lengths give no row; nor does one whose squared
    length is 2^60 or more (components of millions), as its distance may not fit 64 bits. An inertia beyond 64 bits is null. No rows: no rows.
    """

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            rows, fits = whole(flat.reshape(-1, DIMS), scale)
            if fits.any():
                words = planes(rows[fits])
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fits)), pa.array([w.tobytes() for w in words], pa.binary())], ["vec_id", "planes"])

    ids = dict(vectors.dtypes)[vec_id]
    v = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    packed = cut(v.where((F.size("v") == DIMS) & finite).mapInArrow(pack, f"vec_id {ids}, planes binary"), "vector-planes")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = packed.orderBy(F.asc_nulls_last(hashed), "planes").limit(k).collect()
    if not first:
        return packed.selectExpr("vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    import pyarrow as pa

    centroids = numbers(_read(pa.array([r.planes for r in first]))).tolist()
    for _ in range(rounds):
        centroids = _moved(packed, centroids)

    def assign(batches):
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                c, d = nearest(_read(batch.column(1)), centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(c, pa.int32()), pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = cut(packed.mapInArrow(assign, f"vec_id {ids}, cluster int, distance long"), "vector-clusters")
    within = {r[0]: int(r[1]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fit = lambda n: n if n < 1 << 63 else None
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    # k rows at most
    facts = [(c, fit(n), fit(sum(within.values())), sha(centroids[c])) for c, n in within.items()]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _moved(packed: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: each task adds up the vectors of each cluster, Spark adds the tasks' sums."""

    def add(batches):
        import numpy as np
        import pyarrow as pa

        sums = np.zeros((len(centroids), DIMS + 1), np.int64)
        for batch in batches:
            if batch.num_rows:
                words = _read(batch.column(1))
                own, _ = nearest(words, centroids)
                order = np.argsort(own, kind="stable")
                some, starts = np.unique(own[order], return_index=True)
                rows = np.concatenate([numbers(words), np.ones((len(words), 1), np.int64)], axis=1)
                sums[some] += np.add.reduceat(rows[order], starts)
        met = np.flatnonzero(sums[:, DIMS])
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(sums[met].tolist(), pa.list_(pa.int64()))], ["cluster", "sums"])

    parts = packed.select("vec_id", "planes").mapInArrow(add, "cluster int, sums array<long>")
    totals = parts.select("cluster", F.posexplode("sums")).groupBy("cluster", "pos").agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("s"))
    of: dict[int, dict[int, int]] = {}
    for r in totals.collect():
        of.setdefault(r.cluster, {})[r.pos] = int(r.s)
    return [[of[c][i] // of[c][DIMS] for i in range(DIMS)] if c in of else old for c, old in enumerate(centroids)]


def _oracle(k: int, rounds: int) -> str:
    near = "SELECT rid, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT v.rid, t.c, list_inner_product(v.q, v.q) - 2 * list_inner_product(v.q, t.q) + list_inner_product(t.q, t.q) AS d FROM v, {t} t) GROUP BY rid"
    sql = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
t0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c, q FROM v QUALIFY c < {k})"""
    for r in range(1, rounds + 1):
        sql += f""",
a{r} AS MATERIALIZED ({near.format(t=f"t{r - 1}")}),
m{r} AS (SELECT c, i, floor(sum(x)::HUGEINT::DOUBLE / count(*)) AS x FROM (SELECT a{r}.c, unnest(range(1, 65)) AS i, unnest(v.q) AS x FROM v JOIN a{r} USING (rid)) GROUP BY c, i),
t{r} AS MATERIALIZED (SELECT c, coalesce(n.q, o.q) AS q FROM t{r - 1} o LEFT JOIN (SELECT c, list(x ORDER BY i) AS q FROM m{r} GROUP BY c) n USING (c))"""
    return sql + f""",
z AS MATERIALIZED ({near.format(t=f"t{rounds}")})
SELECT vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(list_transform(t.q, lambda x: x::BIGINT), ',')) AS centroid_sha256
FROM z JOIN v USING (rid) JOIN t{rounds} t USING (c)"""


#: DuckDB: the rounds one after another; doubles are exact at these sizes.
ORACLE = _oracle(40, 5)
