"""Blocks of term frequencies: a term's documents of one block in one row, so that a join by term moves packed entries instead of (document, term) rows."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Documents of a block at most: an entry is 16 bits, 12 of them the place in the block and 4 a count of 1 to 15 (a larger count is several entries).
BLOCK_ROWS = 4096
#: Text bytes after which a block ends; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Entries that a task adds up before it passes sums on.
HELD = 1_000_000

Terms = Callable[[list], list[list[str]]]


class Numbers(defaultdict):
    """Numbers keys in the order in which they first come."""

    def __missing__(self, key):
        n = self[key] = len(self)
        return n


def to_arrow(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def distinct_terms(rows: DataFrame, terms: Terms) -> DataFrame:
    """Each distinct term of the texts of rows (text), once."""

    def each(batches):
        import pyarrow as pa

        seen: set[str] = set()
        table = lambda: pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.string())], ["term"])
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(terms([text])[0])
                if len(seen) > 200_000:
                    yield table()
                    seen.clear()
        yield table()

    return rows.select("text").mapInArrow(each, "term string").distinct()


@dataclass(frozen=True)
class Postings:
    """rows: (term, block, packed, head); documents: DDL of the table that a head holds."""

    rows: DataFrame
    documents: str


def _write(batch) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def build(rows: DataFrame, terms: Terms, extra: str = "", measure: Callable | None = None) -> Postings:
    """Rows (term, block, packed) and, for each block, one row with term null and head.

    rows: doc_id, text. packed: entries of the documents that have the term. head: the block's documents as an Arrow
    stream: doc_id, n_bytes, n_terms, and what measure gives under the names of extra (their DDL): measure() is
    called for each block, and what it returns is called with the terms that are new in the block and, of each text, the
    numbers of its terms in the order in which the block has met them; it returns a dict of lists. As one binary value it costs the other rows nothing. Blocks do not span partitions, and a partition that is
    computed again gives the same rows.
    """
    documents = f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_terms long" + f", {extra}" * bool(extra)
    more = StructType.fromDDL(extra).names if extra else []
    schema = "term string, block long, packed binary, head binary"
    out, told = to_arrow(schema), to_arrow(documents)

    def each(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        from .shared import text_batches

        block = TaskContext.get().partitionId() << 32

        def flush(s):
            ids = np.concatenate(s["ids"])
            owners = np.repeat(np.arange(len(s["ids"])), [len(x) for x in s["ids"]])
            key, freq = np.unique(ids * BLOCK_ROWS + owners, return_counts=True)
            times = -(-freq // 15)
            key = np.repeat(key, times)
            count = np.full(len(key), 15)
            count[np.cumsum(times) - 1] = freq - (times - 1) * 15
            term, doc = key // BLOCK_ROWS, key % BLOCK_ROWS
            entries = (doc * 16 + count).astype("<u2")
            names = list(s["of"])
            starts = np.append(np.flatnonzero(np.diff(term, prepend=-1)), len(key))
            for a in range(0, len(names), 50_000):
                b = min(len(names), a + 50_000)
                lo, hi = starts[a], starts[b]
                packed = pa.BinaryArray.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(((starts[a : b + 1] - lo) * 2).astype(np.int32)), pa.py_buffer(entries[lo:hi].tobytes())])
                cols = [pa.array(names[a:b], pa.string()), pa.array(np.full(b - a, block), pa.int64()), packed]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(b - a, out.field("head").type)], schema=out)
            head = [s["doc_ids"], s["n_bytes"], [len(x) for x in s["ids"]], *([v for part in s["more"] for v in part[m]] for m in more)]
            head = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(head, told)], schema=told)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.array([block], pa.int64()), pa.nulls(1, pa.binary()), pa.array([_write(head)], pa.binary())], schema=out)

        fresh = lambda: {"of": Numbers(), "ids": [], "bytes": 0, "doc_ids": [], "n_bytes": [], "more": [], "measure": measure() if measure else None}
        state = fresh()
        for batch in batches:
            for start, length in text_batches(batch.column("text")):
                part = batch.slice(start, length)
                texts = part.column("text").to_pylist()
                if state["ids"] and (len(state["ids"]) + length > BLOCK_ROWS or state["bytes"] >= BLOCK_BYTES):
                    yield from flush(state)
                    state, block = fresh(), block + 1
                found, met, first = terms(texts), len(state["of"]), len(state["ids"])
                state["doc_ids"] += part.column("doc_id").to_pylist()
                for text, words in zip(texts, found):
                    state["ids"].append(np.fromiter(map(state["of"].__getitem__, words), np.int64, len(words)))
                    state["n_bytes"].append(len((text or "").encode("utf-8", "surrogatepass")))
                    state["bytes"] += state["n_bytes"][-1]
                del texts, found
                if measure:
                    state["more"].append(state["measure"](list(islice(state["of"], met, None)), state["ids"][first:]))
        if state["ids"]:
            yield from flush(state)

    return Postings(rows.mapInArrow(each, schema), documents)


def weigh(posted: Postings, values: DataFrame, ddl: str) -> DataFrame:
    """Per document the sums over its terms of frequency times each of the term's values.

    values: (term, and the columns of ddl); a term that has no row there counts 0. Result: doc_id, the rest of head, and the
    sums under the names of ddl. The join is by term; a term that every block has is split like any skewed join
    key. A task adds up what it has of each block, and a block's sums meet in one group, whose size the block bounds.
    """
    fields = StructType.fromDDL(ddl).fields
    names = [f.name for f in fields]
    joined = posted.rows.join(values.select("term", *names), "term", "left").select("block", "packed", "head", *(F.col(c).cast("double").alias(c) for c in names))
    out_ddl = f"{posted.documents}, {ddl}"
    mid_ddl = "block long, places binary, sums binary, head binary"
    mid, kept = to_arrow(mid_ddl), to_arrow(out_ddl)

    def add(batches):
        """Sums of a task by block and place."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        held: list[tuple] = []

        def flush():
            blocks, entries, weights = (np.concatenate([x[i] for x in held]) for i in range(3))
            known, at = np.unique(blocks, return_inverse=True)
            key, number = np.unique(at * BLOCK_ROWS + entries // 16, return_inverse=True)
            sums = np.stack([np.bincount(number, (entries % 16) * weights[:, i]) for i in range(len(names))], 1)
            starts = np.append(np.flatnonzero(np.diff(key // BLOCK_ROWS, prepend=-1)), len(key))
            places = (key % BLOCK_ROWS).astype("<u2")
            cols = [pa.array(known, pa.int64()), pa.array([places[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary()), pa.array([sums[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())]
            held.clear()
            return pa.RecordBatch.from_arrays([*cols, pa.nulls(len(known), mid.field("head").type)], schema=mid)

        size = 0
        for batch in batches:
            heads = pc.is_valid(batch.column("head"))
            if (told := batch.filter(heads)).num_rows:
                yield pa.RecordBatch.from_arrays([told.column("block"), pa.nulls(told.num_rows, pa.binary()), pa.nulls(told.num_rows, pa.binary()), told.column("head")], schema=mid)
            body = batch.filter(pc.invert(heads))
            if body.num_rows:
                times = pc.binary_length(body.column("packed")).to_numpy() // 2
                entries = np.frombuffer(b"".join(body.column("packed").to_pylist()), "<u2").astype(np.int64)
                weights = np.stack([pc.fill_null(body.column(c), 0.0).to_numpy() for c in names], 1)
                held.append((np.repeat(body.column("block").to_numpy(), times), entries, np.repeat(weights, times, axis=0)))
                size += len(entries)
                if size >= HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def each(group):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        heads = pc.is_valid(group.column("head"))
        told = pa.ipc.open_stream(group.filter(heads).column("head")[0].as_py()).read_all().combine_chunks()
        flat = told.columns
        total = np.zeros((len(flat[0]), len(names)))
        for places, sums in zip(*(group.filter(pc.invert(heads)).column(c).to_pylist() for c in ("places", "sums"))):
            np.add.at(total, np.frombuffer(places, "<u2"), np.frombuffer(sums).reshape(-1, len(names)))
        sums = [pa.array(np.rint(total[:, i]).astype(np.int64) if pa.types.is_integer(kept.field(c).type) else total[:, i]) for i, c in enumerate(names)]
        return pa.Table.from_arrays([c.cast(k.type) for c, k in zip([*flat, *sums], kept)], schema=kept)

    return joined.mapInArrow(add, mid_ddl).groupBy("block").applyInArrow(each, out_ddl)
