"""Benchmark decontamination: one Aho-Corasick automaton over normalised test items, each text scanned once."""

from __future__ import annotations

import hashlib
import math
import re
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Words in a window of an item.
WINDOW = 10
#: Bytes of benchmark text that one automaton may hold (about 150 bytes of memory each); a larger benchmark is scanned for in several rounds.
MOST_BYTES = 4 << 20
#: What a scan finds of a row, as DDL.
FOUND = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<start:int,end:int>>"
#: A word after A-Z are lower-cased: a run of a-z, 0-9 and everything beyond ASCII.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: The same on UTF-8 bytes: lower-case A-Z, blank for what no word holds.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[tuple[bytes, ...], tuple[int, tuple[str, ...]]]:
    """Pattern -> (its number of words, the items that hold it). An item of fewer words than a window is one window; one without words has none."""
    found: dict[tuple[bytes, ...], tuple[int, tuple[str, ...]]] = {}
    for item, text in items:
        w = words(text)
        own = (min(len(w), window), (item,))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = tuple(w[i : i + window])
            size, owners = found.setdefault(part, own)
            if item not in owners:
                found[part] = (size, (*owners, item))
    return found


class Matcher:
    """The automaton and what one text has of it. Built once in each Python worker from the broadcast items.

    The automaton reads two signs a word, the digits of the word's number among the words of the items, so that it has two states a word
    and no state with many ways out. First and second digits are different signs: a match begins and ends with words.
    """

    _built: dict[str, Matcher] = {}

    def __init__(self, items, window):
        import ahocorasick

        patterns = windows(items, window)
        number = dict.fromkeys(w for p in patterns for w in p)
        base = max(1, math.isqrt(len(number)) + 1)
        self.signs = {w: chr(1 + i // base) + chr(1 + base + i % base) for i, w in enumerate(number)}
        self.automaton = ahocorasick.Automaton()
        for pattern, value in patterns.items():
            self.automaton.add_word("".join(map(self.signs.__getitem__, pattern)), value)
        if len(self.automaton):
            self.automaton.make_automaton()

    @classmethod
    def of(cls, token: str, items, window: int) -> Matcher:
        if token not in cls._built:
            cls._built.clear()
            cls._built[token] = cls(items, window)
        return cls._built[token]

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], list[str]]:
        """Number of words; merged runs [first, last) of hit words; the items found."""
        w = words(text)
        if not w or not len(self.automaton):
            return len(w), [], []
        # a word of no item is two zeros
        hits = [(end // 2 + 1, n, owners) for end, (n, owners) in self.automaton.iter("".join(map(self.signs.get, w, repeat("\0\0"))))]
        runs: list[list[int]] = []
        for a, b in sorted((end - n, end) for end, n, _ in hits):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        return len(w), [(a, b) for a, b in runs], sorted({x for _, _, owners in hits for x in owners})


def spans(text: str, runs: list[tuple[int, int]]) -> list[dict]:
    """Runs of words as [start, end) characters of the text as it was given."""
    at = [m.span() for m in WORD.finditer(text.translate({c: c + 32 for c in range(65, 91)}))]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in runs]


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", most_bytes: int = MOST_BYTES, least_words: int = 1, keep: bool = False) -> DataFrame:
    """Which words of each text lie in an occurrence of a window of a benchmark item.

    Result per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items
    (array<string>), spans (array<struct<start, end>>, characters of the original text).
    keep=True instead returns the rows of docs that are not contaminated, all their columns as they were.

    The benchmark reaches the workers as a broadcast of most_bytes at most; a larger one is cut by a
    hash of item_id into groups, docs is scanned once for each, and the findings are joined by row.
    Items of fewer than least_words words are left out. A null or empty text has no words and no hits;
    null items and items without words have no windows; repeated items count as one id. Empty tables
    give no rows, or no hits. Rows that share an id, or have none, have findings of their own. Long texts are scanned whole. Extra columns of docs are ignored (keep=False) or kept (keep=True).
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null")
    weight = bench.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("b")).first()["b"]
    groups = max(1, -(-weight * 2 // most_bytes)) if weight > most_bytes else 1
    found = docs if keep else None
    id_type = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    if groups > 1 and not keep:  # findings meet by a number of the row, written once so that all scans see the same
        numbered = cut(rows.withColumn("row", F.monotonically_increasing_id()), "decontam-rows")
        rows, id_type = numbered.select(F.col("row").alias("doc_id"), "text"), "bigint"
    for g in range(groups):
        part = bench if groups == 1 else bench.where(F.pmod(F.xxhash64("i"), F.lit(groups)) == g)
        items = sorted({(r["i"], r["t"]) for r in part.toLocalIterator()})
        items = [x for x in items if len(words(x[1])) >= least_words]
        shared = spark.sparkContext.broadcast(items)
        token = f"{hashlib.sha256(repr((items, window)).encode()).hexdigest()}"

        if keep:
            found = found.mapInArrow(_cleaner(shared, token, window, text), docs.schema)
            continue
        one = rows.mapInArrow(_scanner(shared, token, window), f"doc_id {id_type}, {FOUND}")
        found = one if found is None else found.unionByName(one)
    if keep or groups == 1:
        return found
    merged = found.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return merged.join(numbered, "row").mapInArrow(_merger, f"doc_id {dict(docs.dtypes)[doc_id]}, {FOUND}")


def _digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def _row(doc, n, runs, items, text):
    hit = sum(b - a for a, b in runs)
    return doc, n, hit, len(items), _digest(items), hit > 0, items, spans(text, runs) if runs else []


def _table(rows, id_type):
    import pyarrow as pa

    kinds = (id_type, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.list_(pa.string()), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans")
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def _scanner(shared, token, window):
    def scan(batches):
        matcher = Matcher.of(token, shared.value, window)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            yield _table([_row(d.as_py(), *matcher.scan(t := x.as_py()), t) for d, x in zip(ids, texts)], ids.type)

    return scan


def _cleaner(shared, token, window, text):
    def clean(batches):
        import pyarrow as pa

        matcher = Matcher.of(token, shared.value, window)
        for batch in batches:
            yield batch.filter(pa.array([not matcher.scan(x.as_py())[1] for x in batch.column(text)], pa.bool_()))

    return clean


def _merger(batches):
    """Findings of several scans of one text as one: character spans back to runs of words, merged."""
    import bisect

    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            at = [m.start() for m in WORD.finditer((r["text"] or "").translate({c: c + 32 for c in range(65, 91)}))]
            runs: list[list[int]] = []
            for a, b in sorted((bisect.bisect_left(at, s["start"]), bisect.bisect_left(at, s["end"])) for s in r["spans"]):
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = max(b, runs[-1][1])
                else:
                    runs.append([a, b])
            rows.append(_row(r["doc_id"], r["n_words"], [tuple(x) for x in runs], sorted(set(r["items"])), r["text"]))
        yield _table(rows, batch.column("doc_id").type)


#: DuckDB: windows of each length that items have, matched with every stretch of as many words of a text.
ORACLE = r"""
WITH split AS (SELECT rowid AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
grams AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, (SELECT DISTINCT n FROM wins) WHERE len(w) >= n)),
hits AS (SELECT r, i, grams.n AS n, item_id FROM grams JOIN wins ON grams.n = wins.n AND grams.g = wins.g),
hit_words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hits) GROUP BY r),
hit_items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS xs FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(xs, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN hit_words USING (r) LEFT JOIN hit_items USING (r)
"""
