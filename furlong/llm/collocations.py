"""Phrase collocations: n-grams of word numbers counted in counting quotient filters, merged range by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import quotient
from .postings import Numbers
from .shared import cut

#: Text bytes of a block: its words are numbered together, and its n-grams are one filter.
BLOCK = 12 << 20
#: Occurrences that one range of the quotient stands for at most on average: its merged filter holds no more entries.
RANGE = 1 << 21
#: Lower-case A-Z; every sign at which pieces end is a line feed, every other blank a space.
_SIGNS = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\v\f\r" else 32 if c == 9 else c for c in range(256))

_BLOCKS = "block string, lang string, size int, ids binary, words array<string>, counts array<long>"


def collocations(docs: DataFrame, least: int = 10, most_share: int = 50, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The top phrases of two and three words of each language by how much oftener they occur than their parts do.

    Texts: A-Z in lower case, cut into pieces at . , ; : ! ? and line ends, and those into words at spaces and tabs. Per language (null:
    `und`): n counts words, f(phrase) its contiguous occurrences within pieces, overlaps included. A phrase
    with a = f of at least `least` is a candidate; cut after k words it has l = f(first part), r = f(rest), score
    floor(1000000 a a / (l r)); the lowest cut counts, the smallest k of equals. A candidate inside a longer one whose f is at
    least most_share percent of its own is dropped. Result: lang, rank, phrase, a, l, r, n, score, the first `top` of each language by
    score, a (both descending) and phrase (by bytes).

    A word below `least` cannot be in a candidate and ends a piece. The others are numbered, whatever their number, by ranges of their hash; each block of texts
    learns the numbers of its own words by a join, so that no task holds all words. Its n-grams are counted in a filter
    (furlong.llm.quotient) that is cut into ranges of the quotient, of which each is merged over all blocks: as many ranges as the corpus needs.
    Scores are decimals of 38 digits. Null and empty texts have no words; ids, repeated rows (each counts) and other
    columns do not matter; a word has any length; no rows, or no candidate: no rows.
    """
    blocks = cut(docs.select(F.col(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")).mapInArrow(_blocks, _BLOCKS), "collocation-blocks")
    each = blocks.select("block", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "w")).select("block", "lang", "place", F.col("w.words").alias("word"), F.col("w.counts").alias("n"))
    words = cut(each.groupBy("lang", "word").agg(F.sum("n").alias("f")), "collocation-words")
    known = cut(_numbered(words.where(F.col("f") >= least)), "collocation-numbers")
    size = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("f"), F.lit(0)).alias("f")).first()
    bits = max(1, int(size.n).bit_length())
    if bits > 32:
        raise ValueError(f"{size.n} words of {least} occurrences or more: their numbers take over 32 bits")
    parts = min(bits, max(0, (2 * int(size.f) // RANGE).bit_length()))

    named = each.join(known.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), "place", "id")
    filters = blocks.select("block", "size", "ids").groupBy("block").cogroup(named.groupBy("of")).applyInArrow(_count(bits, parts), "part int, filter binary")

    def merged(group):
        import pyarrow as pa

        q, r, n = quotient.merge(group.column("filter").to_pylist(), bits)
        often = n >= least
        return pa.table([*(x.astype("int64") for x in quotient.restore(q[often], r[often], bits)), n[often]], ["x", "y", "z", "a"])

    found = cut(filters.groupBy("part").applyInArrow(merged, "x long, y long, z long, a long"), "collocation-candidates")
    return _ranked(found, known, words, most_share, top)


def _blocks(batches):
    """Rows of one language and at most about BLOCK bytes: words in the order in which they are met, their counts, and all texts as their numbers (from 1; 0 ends a piece)."""
    import uuid

    import numpy as np
    import pyarrow as pa

    schema = pa.schema([("block", pa.string()), ("lang", pa.string()), ("size", pa.int32()), ("ids", pa.binary()), ("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
    # random names only tell blocks apart; the table is written before it is used, so a task that runs again can't mix two sets
    held: dict[str, tuple[Numbers, list]] = {}
    size = 0

    def rows():
        for lang, (numbers, texts) in held.items():
            ids = np.concatenate(texts)
            width = 2 if len(numbers) < 1 << 16 else 4
            counts = np.bincount(ids, minlength=len(numbers))[1:]
            words = [w.decode("utf-8", "surrogatepass") for w in list(numbers)[1:]]
            values = [[uuid.uuid4().hex], [lang], [width], [ids.astype(f"<u{width}").tobytes()], [words], [counts]]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, schema)], schema=schema)

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            blob = (text.as_py() or "").encode("utf-8", "surrogatepass")
            numbers, texts = held.setdefault(lang, (Numbers(None, {b"\n": 0}), []))
            ids: list[int] = []
            for piece in blob.translate(_SIGNS).split(b"\n"):
                ids.extend(map(numbers.__getitem__, piece.split()))
                ids.append(0)
            texts.append(np.array(ids, np.uint32))
            size += len(blob)
            if size >= BLOCK:
                yield from rows()
                held, size = {}, 0
    yield from rows()


def _numbered(words: DataFrame, spread: int = 1 << 16) -> DataFrame:
    """words with id: 1, 2, ... without gaps, by ranges of a hash of about `spread` words, in each by language and word."""
    buckets = max(64, words.count() // spread)
    rows = words.withColumn("bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    before = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    # a row a bucket: a few thousand at most before numbers take over 32 bits
    offsets = rows.groupBy("bucket").count().select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = rows.withColumn("k", F.row_number().over(W.partitionBy("bucket").orderBy("lang", "word")))
    return inside.join(F.broadcast(offsets), "bucket").select("lang", "word", "f", (F.col("offset") + F.col("k")).alias("id"))


def _count(bits: int, parts: int):
    """Filters of a block's n-grams, given the numbers of its words."""

    def count(block, named):
        import numpy as np
        import pyarrow as pa

        empty = pa.table({"part": pa.array([], pa.int32()), "filter": pa.array([], pa.binary())})
        if not block.num_rows or not named.num_rows:
            return empty
        ids = np.frombuffer(block.column("ids")[0].as_py(), f"<u{block.column('size')[0].as_py()}")
        place = named.column("place").to_numpy()
        of = np.zeros(max(int(ids.max()), int(place.max()) + 1) + 1, np.uint64)
        of[place + 1] = named.column("id").to_numpy()
        ids = of[ids]
        two = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        three = two[:-1][np.diff(two) == 1]
        x, y = ids[np.concatenate([two, three])], ids[np.concatenate([two, three]) + 1]
        z = np.concatenate([np.zeros(len(two), np.uint64), ids[three + 2]])
        entries = quotient.tally(*quotient.permute(x, y, z, bits), bits)
        rows = list(quotient.split(*entries, bits, parts))
        return pa.table({"part": pa.array([p for p, _ in rows], pa.int32()), "filter": pa.array([f for _, f in rows], pa.binary())})

    return count


def _ranked(found: DataFrame, known: DataFrame, words: DataFrame, most_share: int, top: int) -> DataFrame:
    two, three = found.where("z = 0").drop("z"), found.where("z > 0")
    word = lambda c, f: known.select(F.col("id").alias(c), F.col("word").alias(f"word_{c}"), F.col("f").alias(f))
    wide = lambda c: F.col(c).cast("decimal(19,0)")

    def score(l: str, r: str):
        return F.expr(f"CAST((CAST(1000000 AS DECIMAL(7,0)) * (CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)))) div (CAST({l} AS DECIMAL(18,0)) * CAST({r} AS DECIMAL(18,0))) AS BIGINT)")

    # f of a longest phrase that holds this one
    inside = three.select("x", "y", "a").unionByName(three.select(F.col("y").alias("x"), F.col("z").alias("y"), "a")).groupBy("x", "y").agg(F.max("a").alias("longer"))
    two = two.join(inside, ["x", "y"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < most_share * wide("a")))
    two = two.join(word("x", "l"), "x").join(word("y", "r"), "y").select("x", F.concat_ws(" ", "word_x", "word_y").alias("phrase"), "a", "l", "r", score("l", "r").alias("score"))

    pairs = found.where("z = 0")
    three = three.join(pairs.select("x", "y", F.col("a").alias("xy")), ["x", "y"]).join(pairs.select(F.col("x").alias("y"), F.col("y").alias("z"), F.col("a").alias("yz")), ["y", "z"])
    three = three.join(word("x", "fx"), "x").join(word("y", "fy"), "y").join(word("z", "fz"), "z")
    first, second = score("fx", "yz"), score("xy", "fz")
    three = three.select("x", F.concat_ws(" ", "word_x", "word_y", "word_z").alias("phrase"), "a", F.when(first <= second, F.col("fx")).otherwise(F.col("xy")).alias("l"), F.when(first <= second, F.col("yz")).otherwise(F.col("fz")).alias("r"), F.least(first, second).alias("score"))

    rows = two.unionByName(three).join(known.select(F.col("id").alias("x"), "lang"), "x").drop("x")
    best = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    rows = rows.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= top)
    return rows.join(words.groupBy("lang").agg(F.sum("f").alias("n")), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: DuckDB: all n-grams as text.
ORACLE = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
q AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM q),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3)) v(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a, string_split(phrase, ' ') AS w FROM g GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM f WHERE k > 1 AND a >= 10),
h AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
x AS MATERIALIZED (SELECT *, array_to_string(w[1:cut], ' ') AS p1, array_to_string(w[cut + 1:], ' ') AS p2 FROM h),
y AS MATERIALIZED (SELECT x.*, f.a AS l FROM x JOIN f ON f.lang = x.lang AND f.phrase = p1),
s AS (SELECT y.*, f.a AS r, 1000000::HUGEINT * y.a * y.a // (l::HUGEINT * f.a) AS score FROM y JOIN f ON f.lang = y.lang AND f.phrase = p2),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3 UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3) GROUP BY ALL),
n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, b.a DESC, phrase) AS rank, phrase, b.a, l, r, n, score::BIGINT AS score
FROM b LEFT JOIN i USING (lang, phrase) JOIN n USING (lang) WHERE longer IS NULL OR 100 * longer < 50 * b.a
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, b.a DESC, phrase) <= 2000
"""
