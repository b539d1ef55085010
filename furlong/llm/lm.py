"""Language-model scoring: a small causal self-attention model over subword ids, trained and run in numpy, and the memory of the whole corpus.

Ids are read through tables (query, key, value and residual rows of each id); the attention of one head goes over the
last one to two blocks of BLOCK ids with learned weights of distance; what it gathers, plus the residual
row, predicts the class of the next id, and a class's ids share its probability by their frequency. So the
probabilities of all ids add up to 1 at each place. Ids either begin a word or go on with one; the end begins one. A word's probability by its ids
is that of its first among the ids that begin a word, times those of the others, times the chance that the id after them begins a
word; over all words it adds up to 1. It is mixed with how often the training
rows have the word at all, after the word before it, and after the two words before it. The shares of the four depend on how often
those words were met, and are found on training texts with what the corpus has from the text itself taken off.

Words are counted over all training rows under 63-bit hashes, pairs and triples of words under 56-bit ones: each block of texts sends its distinct
keys, sorted, in ranges of the hash; each range adds its keys up and sends every block the totals of what it sent, in the same order.
"""

from __future__ import annotations

import pickle
import uuid
from collections import defaultdict
from dataclasses import dataclass
from itertools import chain, count, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings, shingles
from .shared import cut

#: Ids of a block of the attention. A window is two; it scores the ids of its second, so each is scored once, with BLOCK to 2 * BLOCK - 1 ids before it.
BLOCK = 16
#: Width of the rows; ids with rows of their own (others share one by class); ids that are classes of their own; bands of frequency for the rest, each for word-initial and inner pieces.
DIMS, ROWS, SINGLES, BANDS = 16, 4096, 112, 8
#: Rounds of training, after each of which the tasks' tables are averaged. Every window of the training texts teaches once, in one of the rounds, however large the corpus is.
ROUNDS = 4
#: Blocks that follow each other in a run, runs to a step, rate of the first round.
RUN, BATCH, RATE = 16, 4, 0.03
#: Pieces in which tables are added up, and copies that are averaged in one group.
PIECES, MEET = 16, 64
#: Text bytes after which a block of texts ends, and its texts at most.
BLOCK_BYTES, BLOCK_ROWS = 4 << 20, 4096
#: Packed bytes of tokens and words to a range of the hash.
RANGE_BYTES = 4 << 20
#: The token that ends a text, and stands before its first; no word holds a blank.
ENDING = " "
#: Windows that are scored at a time.
AT_ONCE = 64
#: Words that are encoded in one call.
TOGETHER = 20_000


def words(text: str | None) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in _words((text or "").encode("utf-8", "surrogatepass"))]


def _words(raw: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8, with A-Z in lower case: those six bytes are what bytes.split takes for blanks, and UTF-8 has them nowhere else."""
    return raw.translate(shingles._LOWER).split()


class Subwords:
    """Ids of words: those of the tokenizer file for the word after a blank. END stands for a text's end."""

    _of: dict[str, Subwords] = {}

    def __init__(self, path: str):
        from .packing import Encoder

        self.encode = Encoder.of(path)
        self.end = self.encode.library.get_vocab_size()
        #: Ids whose string begins with a blank.
        self.initial = np.array([t[:1] == " " for t in self.encode.library.decode_batch([[i] for i in range(self.end)], skip_special_tokens=False)] + [True])

    @classmethod
    def of(cls, path: str) -> Subwords:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __call__(self, word: str) -> list[int]:
        """Ids of a word, or of ENDING."""
        return [self.end] if word == ENDING else self.encode(" " + word)

    def all(self, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all of them in turn. Words are encoded many in one text: an id that begins with a blank begins a word. Where that does not come out even, each is encoded by itself."""
        if names and ENDING not in names:
            flat = np.array(self.encode(" " + " ".join(names)), np.int32)
            starts = np.flatnonzero(self.initial[flat])
            if len(starts) == len(names) and not any(x in w for w in names for x in self.encode.special):
                return np.diff(np.append(starts, len(flat))), flat
        ids = [self(w) for w in names]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter((i for w in ids for i in w), np.int32, int(sizes.sum()))


class Lexicon:
    """Ids of numbered words, one after another."""

    def __init__(self, sizes: np.ndarray, flat: np.ndarray):
        self.sizes, self.flat = sizes.astype(np.int64), flat
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def made(cls, names: list[str], subwords: Subwords) -> Lexicon:
        """names: ENDING, and then words."""
        parts = [subwords.all(x) for x in (names[:1], *(names[i : i + TOGETHER] for i in range(1, len(names), TOGETHER)))]
        return cls(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words of these numbers in turn, and how many each has."""
        sizes = self.sizes[numbers]
        skipped = self.starts[numbers] - (np.cumsum(sizes) - sizes)
        return self.flat[np.repeat(skipped, sizes) + np.arange(int(sizes.sum()))], sizes


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of runs of these sizes, none of them empty."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0, values.dtype)


#: Of each query of a window's second block and each key of the window: the place of their distance among the learned ones, and whether the key is not after the query.
FAR = np.maximum(BLOCK - 1 - np.arange(BLOCK)[:, None] + np.arange(2 * BLOCK), 0)
CAUSAL = FAR < 2 * BLOCK
FAR = np.minimum(FAR, 2 * BLOCK - 1)
#: The same, with a place behind them all where the key comes after the query.
FAR_OR_NONE = np.where(CAUSAL, FAR, 2 * BLOCK)


_rooms: dict[str, np.ndarray] = {}


def _room(name: str, shape: tuple, kind) -> np.ndarray:
    """Memory for a product, asked for once in a process: new memory costs as much as the product. What it held before is lost."""
    held = _rooms.get(name)
    if held is None or held.shape != shape or held.dtype != kind:
        held = _rooms[name] = np.empty(shape, kind)
    return held


#: Tables that every step changes whole.
SMALL = ["out", "bias", "far"]


#: What each of Adam's two means moves by.
MOVES = np.array([[0.1], [0.01]])


def _adam(means, g, values, rate: float, over: float) -> None:
    """A step of Adam by the gradient g. means: [..., 2, width], both side by side; g, values: [..., width]. rate and over: the rate over the share that the first mean has, and one over that of the second."""
    step = np.empty_like(means)
    step[..., 0, :] = g
    np.multiply(g, g, out=step[..., 1, :])
    step -= means
    step *= MOVES.astype(means.dtype)
    means += step
    root = np.sqrt(means[..., 1, :])
    root += root.dtype.type(1e-6 / over**0.5)
    np.divide(means[..., 0, :], root, out=root)
    root *= root.dtype.type(rate / over**0.5)
    values -= root


class Steps:
    """Adam's means over the steps of a task in a round, and how many ids have taught."""

    def __init__(self, model: Model, rate: float):
        #: Of each table both means, side by side, so that a step fetches and puts back the rows it meets at once. Those of the other tables lie one after another, so that a step changes them at once.
        self.means = {"rows": np.zeros((len(model.p["rows"]), 2, *model.p["rows"].shape[1:]), model.p["rows"].dtype)}
        self.small, at = np.zeros((2, sum(model.p[k].size for k in SMALL)), model.p["rows"].dtype), 0
        for k in SMALL:
            v = model.p[k]
            self.means[k] = self.small[:, at : at + v.size].reshape(2, *v.shape).swapaxes(0, 1)
            at += v.size
        self.n, self.ids, self.rate = 0, 0, rate


def _at_most_20(x: np.ndarray) -> np.ndarray:
    """np.minimum(x, 20) in place; to look for the largest costs less."""
    return np.minimum(x, 20, out=x) if x.max() > 20 else x


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each of keys its place among the distinct ones, sorted; and these."""
    order = np.argsort(keys)
    in_order = keys.take(order)
    first = np.ones(len(keys), bool)
    np.not_equal(in_order[1:], in_order[:-1], out=first[1:])
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(first) - 1
    return place, in_order[first]


class Model:
    """Tables and classes; everything is float32. size: ids with END."""

    def __init__(self, size: int, initial: np.ndarray, counts: np.ndarray, end: int):
        order = np.argsort(-counts, kind="stable")
        self.size, self.end = size, end
        self.of = np.empty(size, np.int32)  # class of an id
        self.of[order[:SINGLES]] = np.arange(min(SINGLES, size))
        rest = order[SINGLES:]
        for side in (0, 1):
            some = rest[initial[rest] == side]
            mass = np.cumsum(counts[some] + 0.5)
            self.of[some] = SINGLES + side * BANDS + np.minimum((mass / mass[-1] * BANDS).astype(int), BANDS - 1) if len(some) else 0
        self.classes = SINGLES + 2 * BANDS
        self.begins = np.zeros(self.classes, np.float32)  # 1 for classes whose ids begin a word
        self.begins[self.of[initial > 0]] = 1
        self.row = np.empty(size, np.uint16)  # row of an id
        self.row[:] = ROWS + self.of
        own = order[:ROWS][counts[order[:ROWS]] > 0]
        self.row[own] = np.arange(len(own))
        share = counts + 0.5
        self.inside = np.log(share / np.bincount(self.of, share, self.classes)[self.of]).astype(np.float32)
        rng = np.random.Generator(np.random.PCG64(2))
        rows = ROWS + self.classes
        # query, key, value, residual side by side
        self.p = {"rows": rng.normal(0, 0.1, (rows, 4 * DIMS)), "out": rng.normal(0, 0.1, (DIMS, self.classes)), "bias": np.zeros(self.classes), "far": np.linspace(-1, 0.5, 2 * BLOCK)}
        total = np.bincount(self.of, counts, self.classes) + 1
        self.p["bias"] = np.where(np.bincount(self.of, minlength=self.classes) > 0, np.log(total / total.sum()), -50)  # a class without ids has no share
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.shares = PRIOR.copy()
        self.n = self.v = 0  # tokens of the training rows, and how many of them are distinct

    def _distance(self):
        """Factors of a window: [query, key], 0 where the key comes after the query."""
        factors = np.zeros(2 * BLOCK + 1, self.p["far"].dtype)
        np.exp(self.p["far"], out=factors[:-1])
        return factors.take(FAR_OR_NONE)

    def layout(self, flat: np.ndarray, sizes: np.ndarray):
        """Texts of these many ids in blocks: (inputs, targets, blocks that lead a text, place of each id). One block of padding leads each text; targets -1 are padding."""
        padded = BLOCK + -(-sizes // BLOCK) * BLOCK
        at, begin = np.cumsum(padded) - padded, np.cumsum(sizes) - sizes
        place = np.repeat(at + BLOCK - begin, sizes) + np.arange(len(flat))
        inputs, targets = np.full(int(padded.sum()), self.end, np.int32), np.full(int(padded.sum()), -1, np.int32)
        before = np.roll(flat, 1)
        before[begin] = self.end
        targets[place], inputs[place] = flat, before
        lead = np.zeros(len(inputs) // BLOCK, bool)
        lead[at // BLOCK] = True
        return inputs.reshape(-1, BLOCK), targets.reshape(-1, BLOCK), lead, place

    def logs(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Natural log-probability of each id of texts, and of any id there that begins a word. Texts are given one after another with their numbers of ids (at least 1 each); each ends with END."""
        inputs, targets, lead, place = self.layout(flat, sizes)
        rows, of, d = self.row[inputs], self.of[targets], DIMS
        # query, key, value with a 1 that adds up the weights, residual with a 0 for it
        some, one = self.p["rows"], np.ones((len(self.p["rows"]), 1), np.float32)
        table = np.concatenate([some[:, :d] * np.float32(1 / np.sqrt(d)), some[:, d : 3 * d], one, some[:, 3 * d :], 0 * one], 1)
        far = self._distance()
        last, both_sums = np.concatenate([self.p["out"], self.p["bias"][None]]), np.stack([np.ones_like(self.begins), self.begins], 1)
        out, begin = np.zeros(inputs.size, np.float32), np.zeros(inputs.size, np.float32)
        held = np.empty((AT_ONCE * BLOCK, self.classes), np.float32)  # asked for once: new memory costs as much as a product
        for i in range(1, len(inputs), AT_ONCE):
            some = table.take(rows[i - 1 : i + AT_ONCE], axis=0)
            n, now = len(some) - 1, some[1:]
            # a window is two blocks that follow each other in memory, so no block is copied
            both = np.ndarray((n, 2 * BLOCK, some.shape[2]), some.dtype, some, 0, some.strides)
            e = now[:, :, :d] @ both[:, :, d : 2 * d].transpose(0, 2, 1)
            np.exp(_at_most_20(e), out=e)
            e *= far
            e[lead[i - 1 : i - 1 + n], :, :BLOCK] = 0
            hidden = e @ both[:, :, 2 * d : 3 * d + 1]
            hidden /= hidden[:, :, d:].copy()
            hidden += now[:, :, 3 * d + 1 :]
            z = np.matmul(hidden.reshape(-1, d + 1), last, out=held[: n * BLOCK])
            own = z.ravel().take(np.arange(len(z)) * self.classes + of[i : i + n].ravel())
            np.exp(z, out=z)
            total = np.log(z @ both_sums)
            out[i * BLOCK : (i + n) * BLOCK] = own - total[:, 0]
            begin[i * BLOCK : (i + n) * BLOCK] = total[:, 1] - total[:, 0]
        return out[place] + self.inside[flat], begin[place]

    def tokens(self, texts: Texts) -> np.ndarray:
        """Log-probability by the ids of all tokens of the texts in turn: of a word's ids and of a word's beginning after them, where it is known that a word begins. Nothing comes after an end."""
        flat, sizes = texts.lexicon.ids(texts.numbers)
        logs, begin = self.logs(flat, sums(sizes, texts.sizes))
        opened_ = begin[np.cumsum(sizes) - sizes].astype(np.float64)
        closed = np.append(opened_[1:], 0.0)[: len(opened_)]
        closed[np.cumsum(texts.sizes) - 1] = 0
        return sums(logs.astype(np.float64), sizes) - opened_ + closed

    def mixed(self, texts: Texts) -> np.ndarray:
        """Log-probability of all tokens of the texts in turn."""
        by_ids, (by_corpus, bucket) = self.tokens(texts), texts.memory(self.n)
        rest = np.einsum("ij,ij->i", self.shares[bucket, 1:], by_corpus)
        with np.errstate(divide="ignore"):
            out = np.log(self.shares[:, 0][bucket] * np.exp(by_ids) + rest)
        alone = np.flatnonzero(rest == 0)  # the corpus has no such word: what its ids say may be too little for a number that is no logarithm
        out[alone] = np.log(self.shares[:, 0])[bucket[alone]] + by_ids[alone]
        return out

    def mix(self, codes: np.ndarray, weight: np.ndarray) -> None:
        """Find each bucket's shares by expectation and maximisation, from what evidence() counts."""
        bucket, lead = told(codes)
        ratio = np.concatenate([np.ones((len(lead), 1)), lead], 1)
        for _ in range(40):
            got = ratio * self.shares[bucket]
            got *= (weight / got.sum(1))[:, None]
            added = np.stack([np.bincount(bucket, got[:, i], len(PRIOR)) for i in range(4)], 1) + SURE * PRIOR
            self.shares = added / added.sum(1, keepdims=True)

    def train(self, flat: np.ndarray, sizes: np.ndarray, part: int, parts: int, steps: Steps) -> None:
        """Adam over every parts-th run of blocks of the texts, in random order; the same texts give the same model. Rows that a step does not meet stay as they are."""
        inputs, targets, lead, _ = self.layout(flat, sizes)
        runs = -(-(len(inputs) - 1) // RUN)
        begin = np.random.Generator(np.random.PCG64(3)).permutation(np.arange(runs)[part % parts :: parts])
        # the last run is made full: blocks without targets, with the last one's inputs
        more = runs * RUN + 1 - len(inputs)
        rows, lead = (np.concatenate([x, np.repeat(x[-1:], more, axis=0)]) for x in (self.row[inputs], lead))
        targets = np.concatenate([targets[1:], np.full((more, BLOCK), -1, targets.dtype)]).reshape(runs, RUN, BLOCK)
        steps.ids += int((targets[begin] >= 0).sum())
        small, at = np.concatenate([self.p[k].ravel() for k in SMALL]), 0
        for k in SMALL:
            shape, size = self.p[k].shape, self.p[k].size
            self.p[k], at = small[at : at + size].reshape(shape), at + size
        means, table = steps.means["rows"], self.p["rows"]
        for i in range(0, len(begin), BATCH):
            now = begin[i : i + BATCH]
            at = now[:, None] * RUN + np.arange(RUN + 1)
            where, grads = self.gradient(rows[at], lead[at[:, :-1]], targets[now])
            steps.n += 1
            rate, over = steps.rate / (1 - 0.9**steps.n), 1 / (1 - 0.99**steps.n)
            some, values = means.take(where, axis=0), table.take(where, axis=0)
            _adam(some, grads["rows"], values, rate, over)
            means[where], table[where] = some, values
            _adam(steps.small, np.concatenate([grads[k].ravel() for k in SMALL]), small, rate, over)

    def gradient(self, rows, after_lead, targets):
        """Of the mean log-loss: rows that are met, and gradients of these and of the other tables.

        rows: of the ids of runs of blocks with the block before them [runs, blocks + 1, BLOCK]; after_lead: blocks without a past [runs, blocks]; targets: -1 is none.
        """
        d, p = DIMS, self.p
        root = p["out"].dtype.type(1 / np.sqrt(d))
        some = p["rows"].take(rows, axis=0)
        now = some[:, 1:]
        # as in logs, a window is two blocks that follow each other in memory
        shape, (s0, s1, s2, s3) = (len(some), some.shape[1] - 1, 2 * BLOCK, 4 * d), some.strides
        both = np.ndarray(shape, some.dtype, some, 0, (s0, s1, s2, s3))
        q, k, v = now[..., :d], both[..., d : 2 * d], both[..., 2 * d : 3 * d]
        # weights before they are divided by their sums, which the narrower products are instead
        a = np.matmul(q, k.swapaxes(2, 3), out=_room("a", (*q.shape[:3], 2 * BLOCK), root.dtype))
        a *= root
        np.exp(_at_most_20(a), out=a)
        a *= self._distance()
        a[..., :BLOCK][after_lead] = 0
        over = (1 / (a.reshape(-1, 2 * BLOCK) @ np.ones(2 * BLOCK, a.dtype))).reshape(*a.shape[:3], 1)
        gathered = a @ v
        gathered *= over
        # a column of ones takes the bias in
        n = gathered.size // d
        hidden = _room("hidden", (n, d + 1), root.dtype)
        np.add(gathered, now[..., 3 * d :], out=hidden.reshape(*gathered.shape[:3], d + 1)[..., :d])
        hidden[:, d] = 1
        z = np.matmul(hidden, np.concatenate([p["out"], p["bias"][None]]), out=_room("z", (n, self.classes), root.dtype))
        np.exp(z, out=z)
        y = targets.reshape(-1)
        right, known = self.of.take(y, mode="wrap"), y >= 0
        weight = known * z.dtype.type(1 / max(1, np.count_nonzero(known)))
        # before they are divided by their sums, the classes' shares go through two products only; another column adds them up
        ahead = p["out"].T
        dh = z @ np.concatenate([ahead, np.ones((self.classes, 1), z.dtype)], 1)
        total = dh[:, d].copy()
        share = (weight / total)[:, None]
        dh = dh[:, :d] * share
        dh -= ahead.take(right, axis=0) * weight[:, None]
        z.reshape(-1)[np.arange(0, z.size, self.classes) + right] -= total
        hidden *= share
        last = np.ascontiguousarray((z.T @ hidden).T)
        dh = dh.reshape(gathered.shape)
        by_weight = dh * over
        scaled = by_weight * root
        s = np.matmul(scaled, v.swapaxes(2, 3), out=_room("s", a.shape, root.dtype))
        gathered *= scaled
        s -= (gathered.reshape(-1, d) @ np.ones(d, s.dtype)).reshape(*s.shape[:3], 1)
        s *= a
        g = _room("g", some.shape, root.dtype)
        g[:, 0, :, :d], g[:, 0, :, 3 * d :], g[:, 1:, :, 3 * d :] = 0, 0, dh
        np.matmul(s, k, out=g[:, 1:, :, :d])
        both = _room("both", (*a.shape[:2], 2 * BLOCK, 2 * d), root.dtype)
        np.matmul(s.swapaxes(2, 3), q, out=both[..., :d])
        np.matmul(a.swapaxes(2, 3), by_weight, out=both[..., d:])
        # a block's keys and values serve its own queries, and those of the block after it
        g[:, 0, :, d : 3 * d], g[:, -1, :, d : 3 * d] = both[:, 0, :BLOCK], both[:, -1, BLOCK:]
        np.add(both[:, 1:, :BLOCK], both[:, :-1, BLOCK:], out=g[:, 1:-1, :, d : 3 * d])
        order = np.argsort(rows.reshape(-1), kind="stable")
        sorted_ = rows.reshape(-1)[order]
        first = np.ones(len(order), bool)
        np.not_equal(sorted_[1:], sorted_[:-1], out=first[1:])
        starts = np.flatnonzero(first)
        far = np.bincount(FAR.reshape(-1), np.ones(len(s) * s.shape[1], s.dtype) @ s.reshape(-1, FAR.size), 2 * BLOCK) / root
        # two columns as one complex number: half as many runs to add up
        pairs = g.reshape(-1, 4 * d).take(order, axis=0).view(np.complex64 if g.dtype == np.float32 else np.complex128)
        return sorted_[starts], {"rows": np.add.reduceat(pairs, starts, axis=0).view(g.dtype), "out": last[:d], "bias": last[d], "far": far.astype(g.dtype)}


#: Buckets of a history: how often the two words before were met (0, 1, 2-3, 4-7, 8 or more), and the one before (0, 1, 2-3, ... 64 or more).
PAIRS, SINGLE = 5, 8
#: Shares of ids, word, pair and triple before anything is found; a bucket holds them as SURE tokens would.
PRIOR = np.tile([0.3, 0.6, 0.05, 0.05], (PAIRS * SINGLE, 1))
PRIOR[: SINGLE, 3] = 0
PRIOR[::SINGLE, 2] = 0
PRIOR /= PRIOR.sum(1, keepdims=True)
SURE = 5.0
#: Steps in which evidence counts the log of a component over that of the ids: 1 is none at all, 2 to STEPS - 1 are -8 to 17 by halves.
STEPS = 52


def _step(lead: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(lead), np.clip(np.rint(np.where(np.isfinite(lead), lead, 0) * 2) + 18, 2, STEPS - 1), 1).astype(np.int64)


def told(codes: np.ndarray):
    """Bucket, and the three components over that of the ids, of codes of evidence."""
    parts = np.stack([codes // STEPS**2 % STEPS, codes // STEPS % STEPS, codes % STEPS], 1)
    return codes // STEPS**3, np.where(parts > 1, np.exp((parts - 18) / 2.0), 0.0)


_ODD = np.random.Generator(np.random.PCG64(5)).integers(1, 1 << 63, 4, dtype=np.uint64) | np.uint64(1)


def _before(sizes: np.ndarray) -> np.ndarray:
    """Place of the token before each; before a text's first comes its last, the end, as if texts were said again and again."""
    ends = np.cumsum(sizes)
    out = np.arange(-1, int(sizes.sum()) - 1)
    out[ends - sizes] = ends - 1
    return out


def _met(keys: np.ndarray) -> np.ndarray:
    """How often each of keys is among them."""
    place, _ = _ranks(keys)
    return np.bincount(place)[place]


@dataclass
class Texts:
    """Texts by the numbers of their tokens, one after another; one, two, three: how often training rows have the word, pair and triple that end at each token."""

    numbers: np.ndarray
    sizes: np.ndarray
    lexicon: Lexicon
    one: np.ndarray
    two: np.ndarray
    three: np.ndarray

    def some(self, chosen: np.ndarray) -> Texts:
        """Those that a mask of texts chooses."""
        inside = np.repeat(chosen, self.sizes)
        return Texts(self.numbers[inside], self.sizes[chosen], self.lexicon, self.one[inside], self.two[inside], self.three[inside])

    def apart(self) -> Texts:
        """The same with what each text itself has given to the counts taken off."""
        before = _before(self.sizes)
        key = shingles.mix(np.repeat(np.arange(len(self.sizes), dtype=np.uint64), self.sizes) * _ODD[0] + self.numbers.astype(np.uint64))
        pair = shingles.mix(key[before] * _ODD[1] + key)
        own = [_met(key), _met(pair), _met(shingles.mix(key[before[before]] * _ODD[2] + pair))]
        return Texts(self.numbers, self.sizes, self.lexicon, self.one - own[0], self.two - own[1], self.three - own[2])

    def memory(self, n: int):
        """Of each token the share of its word in n, of its pair in what followed the word before, and of its triple in what followed the two before; and the bucket of those histories."""
        before = _before(self.sizes)
        single, pair = self.one[before], self.two[before]
        pair[np.cumsum(self.sizes) - self.sizes] = 0  # no two words stand before the first
        out = np.stack([self.one / max(n, 1), self.two / np.maximum(single, 1), np.where(pair > 0, self.three, 0) / np.maximum(pair, 1)], 1)
        level = lambda c, most: np.minimum(np.frexp(c.astype(np.float64))[1], most - 1)
        return out, level(pair, PAIRS) * SINGLE + level(single, SINGLE)


def _zip(values: np.ndarray) -> bytes:
    """Numbers by planes of their bytes, compressed; the first eight bytes are how many."""
    import pyarrow as pa

    size = values.dtype.itemsize
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), size).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unzip(packed: bytes, kind) -> np.ndarray:
    import pyarrow as pa

    n, size = int.from_bytes(packed[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(packed[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


#: A block of texts: their rows (Arrow), the numbers of their tokens, how many ids each word has, and the ids.
BODY = "docs binary, numbers binary, sizes binary, flat binary"
BODIES = ["docs", "numbers", "sizes", "flat"]
#: What a row tells of itself.
DOCS = "doc_id {}, n_tokens long, learn boolean"


def _rows(packed: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(packed).read_all().combine_chunks()


def each_row(batch):
    """Rows of a batch as dicts, one at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _learn(docs) -> np.ndarray:
    return docs.column("learn").to_numpy(zero_copy_only=False).astype(bool)


def split(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, learn) in blocks, written once: block, learned (tokens of rows that learn), docs (Arrow), numbers (of the tokens; ENDING is 0), names (the block's words from 1 on, a line each)."""
    told = postings.to_arrow(DOCS.format(dict(rows.dtypes)["doc_id"]))
    schema = "block long, learned long, docs binary, numbers binary, names binary"
    out = postings.to_arrow(schema)

    def each(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        from .shared import text_batches

        block, ending = TaskContext.get().partitionId() << 32, [ENDING.encode()]

        def flush(parts, tokens):
            whole = pa.Table.from_batches(parts).combine_chunks()
            lengths = np.array([len(x) for x in tokens], np.int64)
            docs = pa.RecordBatch.from_arrays([whole.column("doc_id").combine_chunks(), pa.array(lengths), whole.column("learn").combine_chunks()], schema=told)
            of = defaultdict(count().__next__)  # a new word gets the next number
            numbers = np.fromiter(map(of.__getitem__, chain(ending, chain.from_iterable(tokens))), np.uint32, 1 + int(lengths.sum()))[1:]
            names = b"\n".join(islice(of, 1, None))
            bodies = [postings._write(docs), _zip(numbers), _zip(np.frombuffer(names, np.uint8))]
            return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([int(lengths[_learn(docs)].sum())]), *(pa.array([b], pa.binary()) for b in bodies)], schema=out)

        parts, tokens, size = [], [], 0
        for batch in batches:
            for start, length in text_batches(batch.column("text"), most_bytes=BLOCK_BYTES // 4):
                if parts and (len(tokens) + length > BLOCK_ROWS or size >= BLOCK_BYTES):
                    yield flush(parts, tokens)
                    parts, tokens, size, block = [], [], 0, block + 1
                part = batch.slice(start, length)
                parts.append(part.select(["doc_id", "learn"]))
                tokens += (_words(x or b"") + ending for x in part.column("text").cast(pa.binary()).to_pylist())
                size += part.column("text").nbytes
        if parts:
            yield flush(parts, tokens)

    return cut(rows.mapInArrow(each, schema), "lm-split")


def keys(numbers: np.ndarray, sizes: np.ndarray, names: bytes):
    """Keys of each distinct word, of the pair and of the triple that end at each token."""
    before = _before(sizes)
    hashes = np.concatenate([np.ones(1, np.uint64), shingles.hashed(names)])
    own = hashes[numbers]
    pair = own[before] * _ODD[0] + own * _ODD[1]
    return shingles.mix(hashes) >> np.uint64(1), shingles.mix(pair) >> np.uint64(8), shingles.mix(own[before[before]] * _ODD[2] + pair) >> np.uint64(8)


def _block(row):
    """Of a row of split: its docs, numbers of tokens, numbers of tokens a text, and names."""
    docs = _rows(row["docs"])
    return docs, _unzip(row["numbers"], np.uint32), docs.column("n_tokens").to_numpy(), _unzip(row["names"], np.uint8).tobytes()


def _edges(keys: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Where each range of the hash begins in sorted keys of these many bits."""
    return np.searchsorted(keys, np.arange(ranges, dtype=np.uint64) << np.uint64(bits - ranges.bit_length() + 1))


def _sent(row, ranges: int):
    """Of a block: its distinct keys in the order in which they are sent, words first, how often its rows that learn have each, and where each of 2 * ranges ranges begins."""
    docs, numbers, sizes, names = _block(row)
    one, two, three = keys(numbers, sizes, names)
    learn = np.repeat(_learn(docs), sizes).astype(np.uint64)
    order = np.argsort(one)
    marked = np.concatenate([two, three]) << np.uint64(1) | np.concatenate([learn, learn])
    marked.sort()
    longer = marked >> np.uint64(1)
    first = np.flatnonzero(np.diff(longer, prepend=np.uint64(1 << 63)))
    count = np.add.reduceat(marked & np.uint64(1), first).astype(np.uint32)
    longer = longer[first]
    words_ = np.bincount(numbers, learn, len(one))[order].astype(np.uint32)
    starts = np.concatenate([_edges(one[order], 63, ranges), len(one) + _edges(longer, 56, ranges), [len(one) + len(longer)]])
    return np.concatenate([one[order], longer]), np.concatenate([words_, count]), starts


def _places(row):
    """Where each word's, and each token's pair's and triple's key is in the order of _sent."""
    _, numbers, sizes, names = _block(row)
    one, two, three = keys(numbers, sizes, names)
    place = np.empty(len(one), np.int64)
    place[np.argsort(one)] = np.arange(len(one))
    number, _ = _ranks(np.concatenate([two, three]))
    return place, len(one) + number[: len(two)], len(one) + number[len(two) :]


def totals(blocks: DataFrame, ranges: int) -> DataFrame:
    """(block, range, totals, known), written once: how often training rows have each of the keys that a block sent to a range, in order; known, in rows of block -1: how many distinct words the range has.

    A block sends a key once however often it has it, so a frequent word weighs no more in a range than it has blocks.
    """
    sent_ddl, ddl = "range int, block long, keys binary, counts binary", "block long, range int, totals binary, known long"
    sent, out = postings.to_arrow(sent_ddl), postings.to_arrow(ddl)

    def send(batches):
        import pyarrow as pa

        for batch in batches:
            for row in each_row(batch):
                key, count, starts = _sent(row, ranges)
                some = [(r, a, b) for r, (a, b) in enumerate(zip(starts[:-1].tolist(), starts[1:].tolist())) if b > a]
                packed = [(_zip(np.diff(key[a:b], prepend=np.uint64(0))), _zip(count[a:b])) for _, a, b in some]
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in some], pa.int32()), pa.array([row["block"]] * len(some), pa.int64()), *(pa.array([p[i] for p in packed], pa.binary()) for i in (0, 1))], schema=sent)

    def add(group):
        import pyarrow as pa

        number = group.column("range")[0].as_py()
        some = [np.cumsum(_unzip(x.as_py(), np.uint64), dtype=np.uint64) for x in group.column("keys")]
        count = np.concatenate([_unzip(x.as_py(), np.uint32) for x in group.column("counts")])
        back, met = _ranks(np.concatenate(some))
        total = np.bincount(back, count, len(met)).astype(np.int64)
        parts = np.split(total[back], np.cumsum([len(x) for x in some])[:-1])
        known = int((total > 0).sum()) if number < ranges else 0
        blocks = [*group.column("block").to_pylist(), -1]
        return pa.Table.from_arrays([pa.array(blocks, pa.int64()), pa.array([number] * len(blocks), pa.int32()), pa.array([*map(_zip, parts), None], pa.binary()), pa.array([0] * len(parts) + [known], pa.int64())], schema=out)

    sent_rows = blocks.select("block", "docs", "numbers", "names").mapInArrow(send, sent_ddl)
    return cut(sent_rows.groupBy("range").applyInArrow(add, ddl), "lm-totals")


def gather(blocks: DataFrame, counted: DataFrame, path: str) -> DataFrame:
    """block, BODY, and one (of each word), two, three (of each token), written once: what the totals say of the block's words, pairs and triples."""
    ddl = f"block long, {BODY}, one binary, two binary, three binary"
    out = postings.to_arrow(ddl)
    names = ["docs", "numbers", "names"]
    heads = blocks.select("block", *names, F.lit(-1).alias("range"), F.lit(None).cast("binary").alias("totals"))
    tails = counted.where("block >= 0").select("block", *(F.lit(None).cast("binary").alias(c) for c in names), "range", "totals")

    def meet(group):
        import pyarrow as pa

        group = group.sort_by("range")
        row = group.slice(0, 1).to_pylist()[0]
        total = np.concatenate([_unzip(x.as_py(), np.int64) for x in group.column("totals").slice(1)])
        packed = [_zip(total[p]) for p in _places(row)]
        names = _unzip(row["names"], np.uint8).tobytes().decode()
        lexicon = Lexicon.made([ENDING, *(names.split("\n") if names else [])], Subwords.of(path))
        body = [row["docs"], row["numbers"], _zip(lexicon.sizes.astype(np.uint32)), _zip(lexicon.flat.astype(np.uint32))]
        return pa.Table.from_arrays([pa.array([row["block"]]), *(pa.array([x], pa.binary()) for x in (*body, *packed))], schema=out)

    return cut(heads.unionByName(tails).groupBy("block").applyInArrow(meet, ddl), "lm-blocks")


def _opened(row):
    """Of a row with BODY: its docs, and their tokens by number, numbers of tokens and lexicon."""
    docs = _rows(row["docs"])
    return docs, _unzip(row["numbers"], np.uint32), docs.column("n_tokens").to_numpy(), Lexicon(_unzip(row["sizes"], np.uint32), _unzip(row["flat"], np.uint32).astype(np.int32))


def opened(batches):
    """Of each row of gather: its docs and their Texts."""
    for batch in batches:
        for row in each_row(batch):
            docs, numbers, sizes, lexicon = _opened(row)
            yield docs, Texts(numbers, sizes, lexicon, _unzip(row["one"], np.int64)[numbers], _unzip(row["two"], np.int64), _unzip(row["three"], np.int64))


@dataclass
class Corpus:
    """blocks: of gather; n, v: tokens of the rows that learn, and how many are distinct."""

    blocks: DataFrame
    n: int
    v: int
    path: str


def corpus(rows: DataFrame, path: str) -> Corpus:
    """rows (doc_id, text, learn), counted."""
    blocks = split(rows)
    size = blocks.agg(F.coalesce(F.sum("learned"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.octet_length("numbers") + F.octet_length("names")), F.lit(0)).alias("b")).first()
    ranges = 1 << int(size["b"] // RANGE_BYTES).bit_length()
    counted = totals(blocks, ranges)
    known = counted.where("block < 0").agg(F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()["v"]
    return Corpus(gather(blocks, counted, path), size["n"], known, path)


def mixing(docs) -> np.ndarray:
    """Which rows of a block find the shares: every tenth of those that learn. They do not train."""
    learn = _learn(docs)
    return learn & ((np.cumsum(learn) - 1) % 10 == 0)


def id_counts(blocks: DataFrame, path: str) -> np.ndarray:
    """How often each id, END the last, comes in all rows that learn."""

    def each(batches):
        import pyarrow as pa

        found = np.zeros(Subwords.of(path).end + 1, np.int64)
        for batch in batches:
            for row in each_row(batch):
                docs, numbers, sizes, lexicon = _opened(row)
                count = np.bincount(numbers[np.repeat(_learn(docs), sizes)], minlength=len(lexicon.sizes))
                found += np.bincount(lexicon.flat, np.repeat(count, lexicon.sizes), len(found)).astype(np.int64)
        ids = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found[ids])], ["id", "n"])

    seen = np.zeros(Subwords.of(path).end + 1, np.int64)
    table = _bodies(blocks).mapInArrow(each, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()  # as many rows as the tokenizer has ids
    seen[table.column("id").to_numpy()] = table.column("n").to_numpy()
    return seen


def _bodies(blocks: DataFrame) -> DataFrame:
    return blocks.select("block", *BODIES)


def fit(known: Corpus) -> Model:
    """A model of all texts of the corpus that learn; mixing() ones find the shares, the others train.

    In each round every task trains its own copy on every ROUNDS-th of its texts, whole ones, and the copies are averaged by the number of their
    ids. How the blocks are dealt to tasks has a bearing on the averages. Without any text it is a model that has seen an end only.
    """
    subwords = Subwords.of(known.path)
    seen = id_counts(known.blocks, known.path)
    if not seen.any():
        seen[subwords.end] = 1
    model = Model(subwords.end + 1, subwords.initial.astype(int), seen.astype(float), subwords.end)
    model.n, model.v = known.n, known.v
    context = known.blocks.sparkSession.sparkContext
    for k in range(ROUNDS):
        shared = context.broadcast(pickle.dumps(model))
        _average(_bodies(known.blocks).mapInArrow(_learner(shared, k), "piece int, task long, ids long, tables binary"), model, known.blocks.rdd.getNumPartitions())
        shared.unpersist()
    shared = context.broadcast(pickle.dumps(model))
    found = known.blocks.mapInArrow(_evidence(shared, uuid.uuid4().hex), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()  # bounded by the codes there are
    if found.num_rows:
        order = np.argsort(found.column("code").to_numpy())
        model.mix(found.column("code").to_numpy()[order], found.column("n").to_numpy()[order])
    return model


def _learner(shared, part: int):
    """Trains a copy of the model on every ROUNDS-th of a task's texts that train, whole, and gives its tables in pieces. The other rounds have the others, and no round lays out texts that it does not train on."""

    def each(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        model = pickle.loads(shared.value)
        steps, met = Steps(model, RATE * (1 - part / ROUNDS)), 0
        for batch in batches:
            for row in each_row(batch):
                docs, numbers, sizes, lexicon = _opened(row)
                train = _learn(docs) & ~mixing(docs)
                now = train & ((np.cumsum(train) + met) % ROUNDS == part)
                met += int(train.sum())
                if now.any():
                    flat, each_word = lexicon.ids(numbers[np.repeat(now, sizes)])
                    model.train(flat, sums(each_word, sizes[now]), 0, 1, steps)
        if steps.ids:
            pieces = np.array_split(np.concatenate([v.ravel() for v in model.p.values()]), PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PIECES, dtype=np.int32)), pa.array(np.full(PIECES, TaskContext.get().partitionId())), pa.array(np.full(PIECES, steps.ids)), pa.array([x.tobytes() for x in pieces], pa.binary())], ["piece", "task", "ids", "tables"])

    return each


def _average(copies: DataFrame, model: Model, tasks: int) -> None:
    """Put the average of the copies' tables, weighted by ids, into the model; without copies it stays. MEET copies at most meet in a group, and their averages again."""
    ddl = "piece int, task long, ids long, tables binary"
    schema = postings.to_arrow(ddl)

    def each(group):
        import pyarrow as pa

        group = group.sort_by("task")
        ids = group.column("ids").to_pylist()
        total = np.zeros(len(group.column("tables")[0].as_py()) // 4)
        for n, x in zip(ids, group.column("tables")):
            total += n * np.frombuffer(x.as_py(), np.float32).astype(np.float64)
        mean = (total / sum(ids)).astype(np.float32)
        first = group.slice(0, 1)
        return pa.Table.from_arrays([first.column("piece"), pa.array([first.column("task")[0].as_py() // MEET]), pa.array([sum(ids)]), pa.array([mean.tobytes()], pa.binary())], schema=schema)

    while tasks > 0:
        copies = copies.groupBy("piece", F.floor(F.col("task") / MEET)).applyInArrow(each, ddl)
        tasks = tasks // MEET
    found = sorted((r["piece"], bytes(r["tables"])) for r in copies.select("piece", "tables").collect())  # one row a piece
    if found:
        flat, at = np.frombuffer(b"".join(x for _, x in found), np.float32), 0
        for k, v in model.p.items():
            model.p[k] = flat[at : at + v.size].reshape(v.shape).copy()
            at += v.size


def _evidence(shared, token: str):
    """How many tokens of the mixing() rows have each code: bucket of the history, and what word, pair and triple say over what the ids say."""

    def each(batches):
        import pyarrow as pa

        model = _model(token, shared)
        for docs, texts in opened(batches):
            chosen = mixing(docs)
            if not chosen.any():
                continue
            some = texts.some(chosen).apart()
            share, bucket = some.memory(model.n)
            with np.errstate(divide="ignore"):
                lead = _step(np.log(share) - model.tokens(some)[:, None])
            code, n = np.unique(((bucket * STEPS + lead[:, 0]) * STEPS + lead[:, 1]) * STEPS + lead[:, 2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(code.astype(np.int64)), pa.array(n.astype(np.int64))], ["code", "n"])

    return each


_loaded: dict[str, Model] = {}


def _model(token: str, shared) -> Model:
    """The broadcast model, unpickled once in a worker."""
    if token not in _loaded:
        _loaded.clear()
        _loaded[token] = pickle.loads(shared.value)
    return _loaded[token]


def score(docs: DataFrame, learn, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Score whole texts by the model, and by the frequencies of their words.

    learn: a boolean Column, true for the rows of docs that teach (null: not). Result per row of docs: doc_id, n_tokens
    (words and one end), n_known (those that training rows have), train_tokens (N, theirs in all),
    base_score (sum of log10((c + 1) / (N + 1 * (V + 1)))), score (log10 probability of the text by the model).
    Counts of words, pairs and triples and id frequencies cover all training rows. The attention learns from every window of all of them
    but those that find the shares, once, so what it learns from grows with the
    input. The score is a probability where, as in byte-level vocabularies, the ids that begin with a blank are those that begin a word. Two different words share a 63-bit key with probability 1e-19, two pairs or triples a 56-bit one with 1e-17.

    A null or empty text is its end alone. A long text is scored whole; a block holds at least one text, so a task needs memory for the longest. Repeated rows
    and null ids are rows like others. Other columns are not read. No rows: no rows.
    """
    id_type = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    known = corpus(rows, path)
    return scores(known, fit(known), id_type)


def scores(known: Corpus, model: Model, id_type: str) -> DataFrame:
    """The rows of score() by a model."""
    shared, token = known.blocks.sparkSession.sparkContext.broadcast(pickle.dumps(model)), uuid.uuid4().hex

    def each(batches):
        import pyarrow as pa

        model = _model(token, shared)
        n, v = model.n, model.v
        for docs, texts in opened(batches):
            base = np.log10((texts.one + 1) / (n + v + 1))
            made = [docs.column("doc_id").combine_chunks(), pa.array(texts.sizes), pa.array(sums((texts.one > 0).astype(np.int64), texts.sizes)), pa.array(np.full(len(texts.sizes), n, np.int64)), pa.array(sums(base, texts.sizes)), pa.array(sums(model.mixed(texts), texts.sizes) / np.log(10))]
            yield pa.RecordBatch.from_arrays(made, ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return known.blocks.mapInArrow(each, f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
