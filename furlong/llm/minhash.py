"""Near-duplicate texts by a signature-coordinate inverted join.

Documents with equal shingle sets are one class. Each class has a MinHash signature of K coordinates and is posted
under its coordinate-value pairs. Two signatures that agree in T of K coordinates share at least one
of any K - T + 1, so only that many, the rarest, are posted (prefix), and values that no other class
has are skipped: a class whose prefix holds nothing else has no partner. Within a posting list each class is first
held against the list's leader, the least edited of its classes; what that leaves in different components
meets in blocks of the list. Every link is confirmed on full shingle sets.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from .shared import components, cut, text_batches

#: Words of a shingle and the least similarity, in hundredths, unless a caller says otherwise.
WIDTH = 5
PERCENT = 80
#: Coordinates of a signature.
COORDINATES = 64
#: Classes of a posting list that meet in one block.
BLOCK = 512


def least_matches(percent: int, k: int = COORDINATES) -> int:
    """Agreeing coordinates asked of a pair: 4.5 standard deviations below what a pair at the threshold has."""
    j = percent / 100
    return max(1, math.floor(k * j - 4.5 * math.sqrt(k * j * (1 - j))))


def sketches(docs: DataFrame, width: int, k: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, set_key (128 bits of the whole shingle set, null if empty), signature (array<int>)."""
    id_type = dict(docs.dtypes)["doc_id"]

    def each(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        seeds = shingles.seeds(k)
        for batch in batches:
            for start, length in text_batches(batch.column("text")):
                part = batch.slice(start, length)
                found = shingles.sets(part.column("text").to_pylist(), width)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in found]
                made = np.concatenate([shingles.signature(s, seeds) for s in found]).view(np.int32)
                offsets = np.arange(0, len(made) + 1, k, dtype=np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(made))], ["doc_id", "n_shingles", "set_key", "signature"])

    return docs.mapInArrow(each, f"doc_id {id_type}, n_shingles long, set_key binary, signature array<int>")


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """rep (the doc_id), set (sorted hashes)."""
    id_type = dict(docs.dtypes)["doc_id"]

    def each(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for start, length in text_batches(batch.column("text"), most_rows=512):
                part = batch.slice(start, length)
                found = shingles.sets(part.column("text").to_pylist(), width)
                offsets = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))], ["rep", "set"])

    return docs.mapInArrow(each, f"rep {id_type}, set array<long>")


def _forest(a, b):
    """Of links (a[i], b[i]) a subset that connects the same nodes."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for x, y in zip(a, b):
        p, q = root(x), root(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append((x, y))
    return kept


def _meet(percent: int):
    """A block of a posting list -> links between its components, enough to connect what is linked."""

    def each(group):
        import numpy as np
        import pyarrow as pa

        reps = group.column("rep").to_numpy()
        comp, side, first, second = (group.column(c).to_numpy() for c in ("comp", "chunk", "lo", "hi"))
        key = group.column("key")[0].as_py()
        n = len(reps)
        mask = np.triu(np.ones((n, n), bool), 1) & (comp[:, None] != comp[None, :]) & (reps[:, None] != reps[None, :])
        if first[0] != second[0]:
            mask &= side[:, None] != side[None, :]
        links = []
        if mask.any():
            mask &= _common(group.column("prefix"), n, lambda v: v < key) == 0  # a smaller common key has its own list
            sets = group.column("set").combine_chunks()
            size = np.array([len(s) for s in sets])
            low, high = np.minimum(size[:, None], size), np.maximum(size[:, None], size)
            mask &= 100 * low >= percent * high
            if mask.any():
                rows = np.flatnonzero(mask.any(1) | mask.any(0))
                sub = mask[np.ix_(rows, rows)]
                both = _common(sets.take(pa.array(rows)), len(rows), None)
                union = size[rows][:, None] + size[rows] - both
                x, y = np.nonzero(sub & (100 * both >= percent * union))
                links = _forest(reps[rows[x]].tolist(), reps[rows[y]].tolist())
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    return each


def _common(lists, n: int, chosen):
    """How many values each pair of lists shares (of those that chosen takes), by a product of incidence matrices in slices."""
    import numpy as np

    if hasattr(lists, "combine_chunks"):
        lists = lists.combine_chunks()
    values = lists.flatten().to_numpy()
    owner = np.repeat(np.arange(n), lists.value_lengths().to_numpy())
    if chosen is not None:
        take = chosen(values)
        values, owner = values[take], owner[take]
    _, number, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[number] > 1 if len(count) else np.zeros(0, bool)
    number, owner = number[shared], owner[shared]
    _, number = np.unique(number, return_inverse=True)
    total = np.zeros((n, n), np.float32)
    for a in range(0, int(number.max()) + 1 if len(number) else 0, 8192):
        inside = (number >= a) & (number < a + 8192)
        m = np.zeros((n, min(8192, int(number.max()) + 1 - a)), np.float32)
        m[owner[inside], number[inside] - a] = 1
        total += m @ m.T
    return np.rint(total).astype(np.int64)


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, k: int = COORDINATES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Link documents whose sets of word shingles have 100 * intersection >= percent * union.

    Result per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself
    included), kept (doc_id = component_id). Ids are whole numbers.

    Null, empty or wordless texts have no shingles and link with nothing. Rows that share an id are one
    document of several texts, with one component; a null id stands alone with a null component and is kept. Other
    columns are not read. No rows: no rows.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sketched = cut(sketches(rows, width, k), "sketches")
    linked = sketched.where("n_shingles > 0 and doc_id is not null")
    least = linked.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "signature")).alias("m"))
    classes = cut(least.select("set_key", F.col("m.doc_id").alias("rep"), "m.n_shingles", "m.signature"), "classes")
    links = link_classes(rows, classes, width, percent, k)
    found = components(links)
    same = linked.join(classes.select("set_key", "rep"), "set_key").groupBy("doc_id").agg(F.min("rep").alias("rep"), F.max("rep").alias("other"))
    # an id with several texts joins their classes
    several = same.where("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    if not several.isEmpty():
        every = linked.join(classes.select("set_key", "rep"), "set_key").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
        found = components(links.unionByName(every))
    members = same.select("doc_id", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("_component"))
    out = sketched.select("doc_id", "n_shingles").join(members, "doc_id", "left")
    component = F.coalesce("_component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def link_classes(rows: DataFrame, classes: DataFrame, width: int, percent: int, k: int) -> DataFrame:
    """Links (a, b) between classes, confirmed on full sets, that connect all that are linked."""
    t = least_matches(percent, k)
    posts = classes.select("rep", F.posexplode("signature").alias("at", "value")).select("rep", F.xxhash64("at", "value").alias("key"))
    counts = posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = posts.join(counts, "key").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "key"))).alias("ranked"))
    room = F.lit(k - t + 1) - (F.lit(k) - F.size("ranked"))
    prefix = shared.withColumn("room", room).where("room > 0").select("rep", (F.lit(k) - F.size("ranked")).alias("alone"), F.transform(F.slice("ranked", 1, F.col("room")), lambda s: s["key"]).alias("prefix"))
    posted = cut(classes.select("rep", "n_shingles", "signature").join(prefix, "rep"), "posted")
    sets = cut(shingle_sets(rows.withColumnRenamed("doc_id", "rep").join(posted.select("rep"), "rep", "left_semi").withColumnRenamed("rep", "doc_id"), width), "sets")

    lists = posted.select("rep", "alone", "signature", F.explode("prefix").alias("key"))
    leaders = lists.groupBy("key").agg(F.min(F.struct("alone", "rep", "signature")).alias("first"))
    agree = F.aggregate(F.zip_with("signature", "first.signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = lists.join(leaders, "key").where(F.col("rep") != F.col("first.rep")).select("rep", F.col("first.rep").alias("leader"), agree.alias("agree")).where(F.col("agree") >= t)
    best = near.groupBy("rep").agg(F.max(F.struct("agree", (-F.col("leader")).alias("leader"))).alias("m")).select("rep", (-F.col("m.leader")).alias("leader"))
    pairs = best.join(sets, "rep").withColumnRenamed("set", "one").join(sets.select(F.col("rep").alias("leader"), "set"), "leader")
    both = F.size(F.array_intersect("one", "set"))
    stars = cut(pairs.where(100 * both >= percent * (F.size("one") + F.size("set") - both)).select(F.col("rep").alias("a"), F.col("leader").alias("b")), "stars")

    comps = components(stars).select(F.col("node").alias("rep"), "component")
    placed = cut(posted.select("rep", "prefix").join(comps, "rep", "left").select("rep", "prefix", F.coalesce("component", "rep").alias("comp")), "placed")
    lists = placed.select("rep", "comp", F.explode("prefix").alias("key"))
    mixed = lists.groupBy("key").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    chunks = F.ceil(F.col("n") / BLOCK).cast("int")
    blocked = lists.join(mixed.select("key", chunks.alias("chunks")), "key").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    blocked = blocked.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("rep", "key", "comp", "chunk", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"))
    full = blocked.join(placed.select("rep", "prefix").join(sets, "rep"), "rep")
    crossed = full.groupBy("key", "lo", "hi").applyInArrow(_meet(percent), "a long, b long")
    return cut(stars.unionByName(crossed), "links")


#: DuckDB: all pairs that share a shingle, then what is reachable.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 3) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
reach(v, m) AS (SELECT DISTINCT a, a FROM links UNION SELECT b, m FROM reach JOIN links ON v = a),
least AS (SELECT v, min(m) AS m FROM reach GROUP BY v)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least ON v = doc_id
"""
