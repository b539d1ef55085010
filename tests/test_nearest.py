"""The pivot index against all pairs."""

import math

import numpy as np
import pytest

from furlong.operators import nearest as N


def plain(rows, asked, k):
    out = []
    for g, t, x in asked:
        if x is None or g is None:
            continue
        near = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(x, y))), h) for q, h, y in rows if q == g and h is not None and h < t and y is not None and len(y) == len(x) and None not in y and all(map(math.isfinite, y)))
        out += [(t, h, round(d, 9)) for d, h in near[:k]]
    return sorted(out)


@pytest.mark.parametrize("k, block", [(3, 8), (10, 64), (30, 512)])
def test_neighbours_equal_all_pairs(spark, k, block):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((6, 8)) * 5
    rows = [("ab"[i % 2], i, (centres[i % 6] + rng.standard_normal(8)).tolist()) for i in range(300)]
    rows += [("a", 300 + i, rows[5][2]) for i in range(20)]  # copies: ties go by id
    asked = [r for r in rows if r[1] % 7 == 0]
    bad = [("a", 900, None), (None, 3, rows[0][2]), ("b", 901, [math.nan] * 8), ("b", 902, [None] * 8), ("b", 903, [1.0]), ("b", 904, []), ("b", None, rows[0][2])]
    df = lambda r: spark.createDataFrame([(*x, 1) for x in r], "label string, vec_id long, embedding array<double>, block int").repartition(3)
    got = N.earlier_neighbours(df(asked + bad[:1] + bad[2:6]), df(rows + bad), k, ["label"], "vec_id", "embedding", pivots=5, block=block).collect()
    assert sorted((r.vec_id, r.h_id, round(r.dist, 9)) for r in got) == plain(rows, asked, k)
    assert N.earlier_neighbours(df(asked), df(rows).where("1 = 0"), k, ["label"], "vec_id", "embedding").count() == 0
    assert N.earlier_neighbours(df(asked).where("1 = 0"), df(rows), k, ["label"], "vec_id", "embedding").count() == 0


def test_rings_spare_most_rows(spark, monkeypatch):
    """Of clustered rows, a target is measured against few: four times the rows cost fewer than four times the pairs of a label's product."""
    rng = np.random.default_rng(2)
    shares = []
    for n in (1000, 4000):
        centres = rng.standard_normal((n // 50, 4)) * 20
        rows = [("a", i, (centres[i % len(centres)] + rng.standard_normal(4) * 0.1).tolist()) for i in range(n)]
        df = spark.createDataFrame(rows, "label string, vec_id long, embedding array<double>")
        seen = []
        whole = N._measured

        def counting(pairs, blocks, by, k):
            seen.append(pairs.join(blocks.groupBy("block").count(), "block").agg({"count": "sum"}).first()[0] or 0)
            return whole(pairs, blocks, by, k)

        monkeypatch.setattr(N, "_measured", counting)
        asked = df.where("vec_id % 100 = 99")
        assert N.earlier_neighbours(asked, df, 5, ["label"], "vec_id", "embedding", block=32).count() == 5 * asked.count() - sum(max(0, 5 - t) for t in range(99, n, 100))
        monkeypatch.setattr(N, "_measured", whole)
        shares.append(sum(seen) / (n * (n // 100)))
    assert shares[1] < shares[0] < 1


def test_most_similar_equals_all_pairs(spark, monkeypatch):
    """Copies (ties by id), zero and null vectors, other lengths; one block and several give the same, and no pair is laid out."""
    import math
    import random

    draw = random.Random(3)
    base = [[draw.gauss(0, 1) for _ in range(6)] for _ in range(12)]
    vectors = [[x + draw.choice((0, 0.1)) for x in base[i % 12]] for i in range(60)] + [[0.0] * 6, None, [1.0, 2.0], [None] * 6, [float("nan")] * 6]
    df = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<double>")

    def cosine(x, y):
        if not x or not y or len(x) != len(y) or None in x or None in y:
            return None
        dot = lambda p, q: sum(a * b for a, b in zip(p, q))
        size = math.sqrt(dot(x, x)) * math.sqrt(dot(y, y))
        return dot(x, y) / size if size > 0 else None

    asked = [0, 10, 30, 60, 61, 62]
    want = {}
    for a in asked:
        scored = [(b, cosine(vectors[a], y)) for b, y in enumerate(vectors) if b != a]
        want[a] = [b for b, s in sorted(scored, key=lambda p: (math.inf if p[1] is None else -min(1.0, p[1]), p[0]))][:7]
    for blocks in ((8192, 65536), (2, 16)):
        for name, value in zip(("ASKED", "ROWS"), blocks):
            monkeypatch.setattr(N, name, value)
        made = N.most_similar(df.where(df.id.isin(asked)), df, 7, "id", "v")
        got = {a: [] for a in asked}
        for r in made.orderBy("asked", "similarity", ascending=[True, False]).collect():
            got[r.asked].append((r.similarity, r.id))
        assert {a: [i for s, i in sorted(g, key=lambda p: (math.inf if p[0] is None else -p[0], p[1]))] for a, g in got.items()} == want
        assert "NestedLoop" not in made._jdf.queryExecution().executedPlan().toString()
