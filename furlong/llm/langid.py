"""Language identification by interpolated Kneser-Ney character models.

A text is its words (runs of letters, lower-cased); a word is its letters between boundary signs. Each
language has a model of ORDER letters. The models' n-grams are kept together, by order, in sorted arrays of
64-bit hashes with one row of log-probabilities for all languages, so that one search serves them all.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

#: Letters of an n-gram; the discount of counts.
ORDER = 4
DISCOUNT = 0.75
#: The bound of the training sample: texts of a language, at most about as many.
PER_LANGUAGE = 1000
#: Letters that count toward confidence at most.
EVIDENCE = 40
#: Texts of fewer letters are never rejected for their entropy.
LEAST_LETTERS = 20
#: Nats above the highest calibration entropy at which a language is rejected.
MARGIN = 1.0
WORD = re.compile(r"[^\W\d_]+")
_MULTIPLIER = 0xD1342543DE82EF95


def letters(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. Numerals that are no decimal digits (fractions, circled, Roman) part words like any sign."""
    found = WORD.findall((text or "").lower())
    if all(map(str.isalpha, found)):
        return found
    return [part for w in found for part in "".join(c if c.isalpha() else " " for c in w).split()]


def _grams(words: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the n-grams, n = 1..ORDER, that end at each letter and at each word's end; places of each word's first letter."""
    pad = "\x02" * (ORDER - 1)
    flat = np.frombuffer("".join(pad + w + "\x03" for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) + ORDER for w in words])
    begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scored = np.ones(len(flat), bool)
    for k in range(ORDER - 1):
        scored[begin + k] = False
    at = np.flatnonzero(scored)
    out, total = [], np.zeros(len(at), np.uint64)
    power = 1
    for n in range(ORDER):
        total = total + (flat[at - n] + np.uint64(1)) * np.uint64(power)
        power = power * _MULTIPLIER & (1 << 64) - 1
        out.append(total)
    lengths = sizes - (ORDER - 1)
    return out, np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _contexts(grams: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of what stands before the last letter of each n-gram, n = 2..ORDER: of n - 1 letters."""
    inverse = pow(_MULTIPLIER, -1, 1 << 64)
    return [(grams[n] - grams[0]) * np.uint64(inverse) for n in range(1, ORDER)]


def _find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Rows of keys in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)


class _Counts:
    """Kneser-Ney pieces of one language, from how often it has each word."""

    def __init__(self, words: dict[str, int]):
        names = list(words)
        grams, begin = _grams(names)
        weight = np.repeat(np.array([words[w] for w in names], float), np.diff(np.append(begin, len(grams[0]))))
        contexts = _contexts(grams)
        self.own, self.weight = [], []  # by order: distinct n-grams, and (continuation) counts less the discount over their context's total
        self.backs = []
        for n in range(ORDER):
            keys, first, number = np.unique(grams[n], return_index=True, return_inverse=True)
            if n == ORDER - 1:
                count = np.bincount(number, weight)
            else:  # of how many longer n-grams it is the end
                _, one = np.unique(grams[n + 1], return_index=True)
                count = np.bincount(number[one], minlength=len(keys)).astype(float)
            if n:
                before, at = np.unique(contexts[n - 1][first], return_inverse=True)
            else:
                before, at = np.zeros(1, np.uint64), np.zeros(len(keys), int)
            total = np.bincount(at, count)
            kinds = np.bincount(at)
            self.own.append(keys)
            self.weight.append(np.maximum(count - DISCOUNT, 0) / total[at])
            self.backs.append((before, DISCOUNT * kinds / total))


class Model:
    """By order n: tables[n] = (sorted hashes of n-grams that any language has, a row of log-probabilities each);
    backs[n] = (sorted hashes of the contexts of n-grams, a row of log back-off weights each)."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        self.tables, self.backs, self.unseen, self.limits = [], [], 0.0, np.zeros(0)
        if not self.languages:
            return
        every = [_Counts(counts[x]) for x in self.languages]
        names = sorted({w for x in counts.values() for w in x})
        letters_seen = len({c for w in names for c in w}) + 2
        grams, _ = _grams(names)
        contexts = _contexts(grams)
        shorter = np.full((len(grams[0]), len(every)), 1 / letters_seen)
        for n in range(ORDER):
            keys, first = np.unique(grams[n], return_index=True)
            context = contexts[n - 1] if n else np.zeros(len(grams[0]), np.uint64)
            seen = np.empty_like(shorter)
            for i, one in enumerate(every):
                back = _find(one.backs[n][0], context)
                own = _find(one.own[n], grams[n])
                seen[:, i] = np.where(own >= 0, one.weight[n][own], 0) + np.where(back >= 0, one.backs[n][1][back], 1) * shorter[:, i]
            shorter = seen
            self.tables.append((keys, np.log(seen[first])))
            before, first = np.unique(context, return_index=True)
            rows = np.zeros((len(before), len(every)))
            for i, one in enumerate(every):
                back = _find(one.backs[n][0], before)
                rows[:, i] = np.where(back >= 0, np.log(one.backs[n][1][back]), 0)
            self.backs.append((before, rows))
        self.unseen = -np.log(letters_seen)
        self.limits = np.full(len(self.languages), np.inf)

    def words(self, names: list[str]) -> np.ndarray:
        """Log-probability of each word, letters and end, in each language."""
        grams, begin = _grams(names)
        contexts = _contexts(grams)
        total = np.zeros((len(grams[0]), len(self.languages)))
        open_ = np.arange(len(total))
        for n in range(ORDER - 1, -1, -1):
            at = _find(self.tables[n][0], grams[n][open_])
            hit = at >= 0
            total[open_[hit]] += self.tables[n][1][at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                break
            back = _find(self.backs[n][0], contexts[n - 1][open_] if n else np.zeros(len(open_), np.uint64))
            known = back >= 0
            total[open_[known]] += self.backs[n][1][back[known]]
        total[open_] += self.unseen
        return np.add.reduceat(total, begin) if len(total) else total

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats a sign (letters and word ends) by language, and the number of letters, of each text."""
        from .postings import Numbers

        number = Numbers()
        found = [letters(t) for t in texts]
        ids = [np.fromiter(map(number.__getitem__, w), np.int64, len(w)) for w in found]
        entropy = np.zeros((len(texts), len(self.languages)))
        sizes = np.array([sum(map(len, w)) for w in found], np.int64)
        if number:
            table = self.words(list(number))
            for i, (x, w) in enumerate(zip(ids, found)):
                if len(x):
                    entropy[i] = -table[x].sum(axis=0) / (sizes[i] + len(w))
        return entropy, sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, or 'und' for a text without letters; confidence; rejected) of each text."""
        if not self.languages:
            return [("und", 0.0, True)] * len(texts)
        entropy, sizes = self.texts(texts)
        best = entropy.argmin(axis=1)
        gap = (entropy - entropy.min(axis=1, keepdims=True)) * np.minimum(sizes, EVIDENCE)[:, None]
        sure = 1 / np.exp(-np.minimum(gap, 700)).sum(axis=1)
        out = []
        for i, n in enumerate(sizes.tolist()):
            if not n:
                out.append(("und", 0.0, True))
            else:
                out.append((self.languages[best[i]], float(sure[i]), bool(n >= LEAST_LETTERS and entropy[i, best[i]] > self.limits[best[i]])))
        return out


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on labelled rows (a null text or language teaches nothing).

    The sample is bounded: about per_language texts of each language, those with the smallest hashes of
    doc_id and text, whole; rows that are equal in both count once. Four fifths of it train the models; the rest calibrates, for each language, the entropy
    beyond which a text is rejected: the highest seen there plus MARGIN. Words are counted on the executors.
    """
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.col(text)), F.lit(1 << 30)).alias("h"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return Model({})
    cut = F.create_map(*[F.lit(v) for k, n in sizes.items() for v in (k, int((1 << 30) * min(1.0, per_language / n)))])
    sample = rows.where(F.col("h") < cut[F.col("lang")]).dropDuplicates(["lang", "h", "text"]).withColumn("held", F.col("h") % 5 == 0)

    def count(batches):
        import pyarrow as pa
        from collections import Counter, defaultdict

        found: dict = defaultdict(Counter)
        for batch in batches:
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found[name].update(letters(text))
        for name, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(words)), pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["lang", "word", "n"])

    counts: dict[str, dict[str, int]] = {x: {} for x in sizes}
    trained = sample.where("not held").select("lang", "text").mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    for batch in trained.toArrow().to_batches(max_chunksize=10_000):  # columns, not row objects, on the driver
        for name, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts[name][word] = n
    model = Model({x: w for x, w in counts.items() if w})
    if not model.languages:
        return model
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def entropies(batches):
        import pyarrow as pa

        model = shared.value
        for batch in batches:
            for start, length in text_batches(batch.column("text")):
                part = batch.slice(start, length)
                names = part.column("lang").to_pylist()
                entropy, n = model.texts(part.column("text").to_pylist())
                own = [(x, float(entropy[i, model.languages.index(x)])) for i, x in enumerate(names) if n[i] >= LEAST_LETTERS and x in model.languages]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in own], pa.string()), pa.array([h for _, h in own], pa.float64())], ["lang", "h"])

    for r in sample.where("held").select("lang", "text").mapInArrow(entropies, "lang string, h double").groupBy("lang").agg(F.max("h").alias("h")).collect():
        model.limits[model.languages.index(r["lang"])] = r["h"] + MARGIN
    return model


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, lang_pred (the language of the lowest length-normalised cross-entropy; 'und' if the
    text is null or has no letter), score (confidence, 0 to 1; 0 for 'und'), rejected (no letters, or an
    entropy beyond what calibration allows for that language).

    Ties go to the first language by name. Repeated rows and null ids are rows like others. Other columns are not read. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            for start, length in text_batches(batch.column("text")):
                part = batch.slice(start, length)
                found = shared.value.predict(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(each, f"doc_id {dict(docs.dtypes)[doc_id]}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose language is not rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            for start, length in text_batches(batch.column(text)):
                part = batch.slice(start, length)
                yield part.filter(pa.array([not x[2] for x in shared.value.predict(part.column(text).to_pylist())], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
