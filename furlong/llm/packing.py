"""Order-preserving packing of token streams into windows, by dynamic programming over document and sentence boundaries."""

from __future__ import annotations

import zlib
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a window; the id that ends a document.
WINDOW = 1024
END = 0
#: What a cut costs in padded ids: at a sentence's end within a document, and inside a sentence (more than a sentence has ids); and what each window costs.
SENTENCE_PENALTY = 1
HARD_PENALTY = 32
WINDOW_COST = 8
#: Full windows that one transition may lay inside sentences before it ends at a boundary.
RUN = 3
#: Ids that are packed at a time; the last window of such a stretch ends with it.
STRETCH = 1 << 21


def plan(bounds: list[int], documents: list[bool], window: int = WINDOW, sentence: float = SENTENCE_PENALTY, hard: float = HARD_PENALTY, run: int = RUN, each: float = WINDOW_COST) -> tuple[list[int], float]:
    """Cuts that split ids 0..bounds[-1] into windows, and their cost.

    bounds ascend from 0; documents[i] tells whether bounds[i] ends a document. A transition from bound
    i to bound j lays m windows, m <= run unless bounds lie farther apart: all but the last are full, and
    end inside a sentence unless a bound happens to be there. It costs the last one's padding (none for
    a power of two), each for every window, hard for each of the m - 1 inner cuts, and sentence if j is not a document's end. Cost of i for given m is
    best[i] + i's place, so one monotone queue for each m finds the least over the sliding range of i;
    lengths that are powers of two are tried besides.
    """
    n = len(bounds)
    best, back = [0.0] * n, [0] * n
    at = {b: i for i, b in enumerate(bounds)}
    powers = [1 << k for k in range(4, window.bit_length()) if 1 << k <= window]
    queues = [deque() for _ in range(run)]
    feeds = [0] * run
    value = [0.0] * n
    for j in range(1, n):
        p = bounds[j]
        low, who = float("inf"), j - 1
        for m in range(run):
            # starts i with m * window < p - bounds[i] <= (m + 1) * window
            q, i, near, far = queues[m], feeds[m], p - m * window, p - (m + 1) * window
            while i < j and bounds[i] < near:
                v = value[i]
                while q and value[q[-1]] >= v:
                    q.pop()
                q.append(i)
                i += 1
            feeds[m] = i
            while q and bounds[q[0]] < far:
                q.popleft()
            if q:
                c = value[q[0]] + (m + 1) * (window + each) - p + m * hard
                if c < low:
                    low, who = c, q[0]
        if low == float("inf"):  # bounds too far apart: as many full windows as it takes
            span = p - bounds[j - 1]
            m = -(-span // window)
            low = best[j - 1] + m * (window + each) - span + (m - 1) * hard
        for s in powers:
            i = at.get(p - s)
            if i is not None and best[i] + each < low:
                low, who = best[i] + each, i
        best[j] = low if documents[j] else low + sentence
        back[j] = who
        value[j] = best[j] + p
    cuts, j = [bounds[-1]], n - 1
    while j:
        i = back[j]
        cuts += range(bounds[i] + (bounds[j] - bounds[i] - 1) // window * window, bounds[i], -window)
        cuts.append(bounds[i])
        j = i
    return cuts[::-1], best[-1]


class Encoder:
    """Ids of the tokenizer file, by its library; sentence ends by what an id's string ends with."""

    _of: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import numpy as np
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        size = self.library.get_vocab_size()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        texts = self.library.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
        self.ends = np.array([t.rstrip(" \"')]»”").endswith((".", "!", "?", "\n", "。", "！", "？")) for t in texts])
        self.fast = _same_in_ranks(self.library, path)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __call__(self, text: str) -> list[int]:
        if self.fast and not any(s in text for s in self.special):
            return self.fast.encode_ordinary(text)
        return self.library.encode(text, add_special_tokens=False).ids


def _same_in_ranks(library, path: str):
    """A byte-level BPE file as ranks for tiktoken, whose merges run several times as fast; None for other files.

    Byte-level ids in the order of their merges are ranks: the vocabulary must be the bytes, then
    the merges in order. A probe of mixed text must give the same ids.
    """
    import json

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model = spec["model"]
    if spec.get("normalizer") or spec["pre_tokenizer"].get("type") != "ByteLevel" or not spec["pre_tokenizer"].get("use_regex") or spec["pre_tokenizer"].get("add_prefix_space") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    import public_tokenizers
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    if [model["vocab"].get(m) for m in merged] != list(range(256, 256 + len(merged))):
        return None
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    probe = "Hello  wörld, it's 42\n\n\tñandú — thedble  don't    x!! 漢字 🙂 ＡＢ \r\n end "
    return fast if fast.encode_ordinary(probe) == library.encode(probe, add_special_tokens=False).ids else None


def pack(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents as pieces in windows of at most `window` ids, in the order of their partition.

    A document is the ids of its text by the tokenizer at path, without added ones, then the id `end`.
    Result per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id, offset (gapless from 0 within the sequence), ids (array<int>). Every id lies in one piece.

    Partitions of docs are packed as they lie (no shuffle), each sorted by doc_id, in stretches of
    bounded ids; sequence_id holds the partition's number. A null or empty text is the id `end` alone.
    Rows that repeat, and null ids, are documents like others. Other columns are not read. No rows: no rows.
    """
    id_type = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).sortWithinPartitions("doc_id", "text")
    ddl = f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"

    def each(batches):
        import numpy as np
        from pyspark import TaskContext

        encoder = Encoder.of(path)
        sequence = TaskContext.get().partitionId() << 33
        held: list[tuple] = []  # (doc_id, start, ids, document's ids in all, ends it here)
        size = 0

        def stretch():
            nonlocal sequence
            flat = np.concatenate([x[2] for x in held])
            closes = np.zeros(len(flat) + 1, bool)
            closes[np.cumsum([len(x[2]) for x in held])[[x[4] for x in held]]] = True
            stops = np.flatnonzero(encoder.ends[flat]) + 1
            bounds = np.unique(np.concatenate([[0], stops, np.flatnonzero(closes), [len(flat)]]))
            cuts, _ = plan(bounds.tolist(), closes[bounds].tolist(), window)
            begins = np.cumsum([0, *(len(x[2]) for x in held)])
            edges = np.unique(np.concatenate([begins, cuts]))
            owner = np.searchsorted(begins, edges[:-1], "right") - 1
            seq = np.searchsorted(cuts, edges[:-1], "right") - 1
            first = np.asarray(cuts)[seq]
            small = flat.astype("<u4")
            out = []
            for a, b, o, s, f in zip(edges[:-1].tolist(), edges[1:].tolist(), owner.tolist(), seq.tolist(), first.tolist()):
                doc, start, _, total, _ = held[o]
                out.append((doc, start + a - int(begins[o]), b - a, zlib.crc32(small[a:b]), total, sequence + s, a - f, a, b))
            sequence += len(cuts) - 1
            yield from _pieces(out, small, id_arrow)

        id_arrow = None
        for batch in batches:
            id_arrow = batch.column("doc_id").type
            for doc, value in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.array([*encoder(value.as_py() or ""), end], np.int64)
                for start in range(0, len(ids), STRETCH):
                    part = ids[start : start + STRETCH]
                    held.append((doc, start, part, len(ids), start + len(part) == len(ids)))
                    size += len(part)
                    if size >= STRETCH:
                        yield from stretch()
                        held.clear()
                        size = 0
        if held:
            yield from stretch()

    return rows.mapInArrow(each, ddl)


def _pieces(out: list[tuple], ids, id_type, at_once: int = 2000):
    import numpy as np
    import pyarrow as pa

    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    for i in range(0, len(out), at_once):
        part = out[i : i + at_once]
        lo, hi = part[0][7], part[-1][8]
        offsets = np.array([p[7] for p in part] + [hi]) - lo
        cols = [pa.array([p[k] for p in part], id_type if k == 0 else pa.int64()) for k in range(7)]
        yield pa.RecordBatch.from_arrays([*cols, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids[lo:hi].astype(np.int32)))], [*names, "ids"])
