"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer reads the letters of a word and writes a sign (insult, threat, target, negation, report, intent, other) with
a weight. Small machines over signs each know one thing of a clause: whether a negation, an intent or a target is near, whether
speech is reported. Composed, they are one machine that reads a clause from the left; another reads it from the right for targets to come. What
both say at an insult or threat is its kind: aimed at someone, denied, or said of what someone else said. A document's weights by kind go
through a logistic model. The insults' weights are learned from labelled texts: whole words, and stems with any ending.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_batches

#: The bound of the training sample: texts of each label, at most about as many.
TOXIC_SAMPLE, CLEAN_SAMPLE = 3000, 9000
#: Lengths of stems that are tried.
STEMS = (4, 5, 6, 7, 8)
#: Least share of toxic texts among those that have a pattern.
PURITY = 0.6
THRESHOLD = 0.7
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE = re.compile(r"[^.!?;:\n]+")

# The words that the grammar knows before it learns.
INSULTS = "idiot idiots moron morons imbecile imbeciles stupid scum scumbag loser losers worthless pathetic disgusting trash clown clowns dumbass bastard bastards".split()
THREATS = "kill hurt destroy beat stab shoot burn strangle crush töten umbringen verprügeln erschießen erwürgen tuer frapper étrangler poignarder matar golpear apuñalar estrangular".split()
INTENTS = "will gonna shall going werde wirst vais voy".split()
TARGETS = "you your yours u he she him her his they them their these those du dich dir ihr euch tu te toi vous ils elles tú usted ustedes ellos".split()
NEGATIONS = "not no never none don't doesn't isn't aren't wasn't won't can't nicht kein keine nie ne pas jamais nunca jamás ni".split()
REPORTS = "said says say wrote writes called calls claimed claims quoted quotes according sagte schrieb nannte disait écrit dit dijo dice escribió llamó".split()

#: Kinds of clause findings, with the weight each has before anything is learned.
KINDS = {"insult": 0.8, "aimed insult": 1.0, "denied insult": 0.3, "reported insult": 0.3, "threat": 1.0, "weak threat": 0.2}
BIAS = -3.0
#: Weight of a threat.
THREAT = 3.0
#: Words after a negation that it covers; words around an insult in which a target aims it.
SCOPE, REACH = 3, 4
#: What one kind adds up to in a document goes toward this, the slower the nearer.
FULL = 8.0


SIGNS = ("other", "insult", "threat", "target", "negation", "report", "intent")
_CLOSED = {"target": TARGETS, "report": REPORTS, "negation": NEGATIONS, "intent": INTENTS, "threat": THREATS}


class Machine:
    """A finite-state machine over SIGNS: moves[state][sign] is the next state, says[state] what it tells a word that it has come to; state 0 is the start."""

    def __init__(self, moves: list[list[int]], says: list[tuple]):
        self.moves, self.says = moves, says

    @classmethod
    def near(cls, name: str, reach: int) -> Machine:
        """Tells whether one of the last `reach` words had the sign."""
        own = SIGNS.index(name)
        return cls([[reach if k == own else max(0, left - 1) for k in range(len(SIGNS))] for left in range(reach + 1)], [(left > 0,) for left in range(reach + 1)])

    @classmethod
    def since(cls, name: str) -> Machine:
        """Tells whether any word before had the sign."""
        own = SIGNS.index(name)
        return cls([[int(k == own or met) for k in range(len(SIGNS))] for met in (0, 1)], [(False,), (True,)])

    def __mul__(self, other: Machine) -> Machine:
        """Both at once: of their pairs of states those that can be reached, and what both tell."""
        number, queue, moves = {(0, 0): 0}, [(0, 0)], []
        for a, b in queue:
            row = []
            for x, y in zip(self.moves[a], other.moves[b]):
                if (x, y) not in number:
                    number[x, y] = len(number)
                    queue.append((x, y))
                row.append(number[x, y])
            moves.append(row)
        return Machine(moves, [self.says[a] + other.says[b] for a, b in queue])

    def run(self, signs: list[int]) -> list[tuple]:
        """What it tells each word of what came before."""
        state, out = 0, []
        for k in signs:
            out.append(self.says[state])
            state = self.moves[state][k]
        return out


#: From the left: is a negation near, was speech reported, is an intent near, is a target near. From the right: is a target near.
LEFT = Machine.near("negation", SCOPE) * Machine.since("report") * Machine.near("intent", REACH) * Machine.near("target", REACH)
RIGHT = Machine.near("target", REACH)


def kind(sign: str, denied: bool, reported: bool, intended: bool, aimed: bool) -> str | None:
    """What an insult or threat is where the machines tell this; None for a threat without intent or target."""
    if sign == "insult":
        return "reported insult" if reported else "denied insult" if denied else "aimed insult" if aimed else "insult"
    return ("weak threat" if reported or denied else "threat") if intended and aimed else None


class Lexicon:
    """The lexicon transducer: states are beginnings of words; a state may have an output for a word that ends there, and one for words that go on in any way."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.moves: list[dict[str, int]] = [{}]
        self.whole: dict[int, tuple[int, float]] = {}
        self.open: dict[int, tuple[int, float]] = {}
        for name, closed in _CLOSED.items():
            for w in closed:
                self.whole.setdefault(self._state(w), (SIGNS.index(name), 0.0))
        for p, weight in stems.items():
            self.open[self._state(p)] = (1, weight)
        for w, weight in words.items():
            self.whole[self._state(w)] = (1, weight)

    def _state(self, beginning: str) -> int:
        state = 0
        for c in beginning:
            if c not in self.moves[state]:
                self.moves[state][c] = len(self.moves)
                self.moves.append({})
            state = self.moves[state][c]
        return state

    def read(self, word: str) -> tuple[int, float]:
        """Sign and weight: a learned word before a stem, a longer stem before a shorter one, a stem before other words."""
        state, found = 0, None
        for c in word:
            state = self.moves[state].get(c, -1)
            if state < 0:
                return found or (0, 0.0)
            found = self.open.get(state, found)
        end = self.whole.get(state)
        return end if end and (end[0] == 1 or not found) else found or (0, 0.0)


class Grammar:
    """Lexicon and clause transducers composed. words and stems: pattern -> weight (log-odds)."""

    def __init__(self, words: dict[str, float], stems: dict[str, float], weights: dict[str, float] | None = None, bias: float = BIAS):
        self.words, self.stems, self.weights, self.bias = words, stems, weights or dict(KINDS), bias
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def _parts(self):
        """The lexicon transducer, and an automaton that finds where its insults and threats may begin."""
        if self.made is None:
            import ahocorasick

            machine = ahocorasick.Automaton()
            for p in {*self.words, *self.stems, *THREATS}:
                machine.add_word(p, len(p))
            machine.make_automaton()
            self.made = Lexicon(self.words, self.stems), machine
        return self.made

    def clause(self, text: str) -> list[tuple[str, float]]:
        """(kind, weight) of each insult and threat of a clause."""
        lexicon = self._parts()[0]
        read = [lexicon.read(w) for w in WORD.findall(text)]
        signs = [k for k, _ in read]
        left, right = LEFT.run(signs), RIGHT.run(signs[::-1])[::-1]
        out = []
        for (k, weight), (denied, reported, intended, before), (after,) in zip(read, left, right):
            if SIGNS[k] in ("insult", "threat"):
                name = kind(SIGNS[k], denied, reported, intended, before or after)
                if name:
                    out.append((name, weight if SIGNS[k] == "insult" else THREAT))
        return out

    def features(self, text: str | None) -> list[float]:
        """Weight of each kind in a text, saturating. Only clauses where a pattern begins a word are parsed, each once."""
        total = dict.fromkeys(KINDS, 0.0)
        low = (text or "").lower()
        machine = self._parts()[1]
        begins = sorted({e - n + 1 for e, n in machine.iter(low) if e - n < 0 or not low[e - n].isalpha()}) if len(low) and len(machine) else []
        done = 0
        for b in begins:
            if b < done:
                continue
            start = max(low.rfind(c, done, b) for c in ".!?;:\n") + 1 or done  # no farther back than the clause before
            found = CLAUSE.match(low, start)
            done = found.end()
            for name, weight in self.clause(found.group()):
                total[name] += weight
        return [FULL * -math.expm1(-v / FULL) for v in total.values()]

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[k] * x for k, x in zip(KINDS, self.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _patterns(text: str | None) -> set[str]:
    """'=word' and 'stem' of a text."""
    out = set()
    for w in set(WORD.findall((text or "").lower())):
        out.add("=" + w)
        out.update(w[:k] for k in STEMS if len(w) > k)
    return out


def lexicon(found: list[tuple[str, int, int]], toxic: int, clean: int, tried: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with log-odds, from (pattern, toxic texts, clean texts). A pattern stays if chance would give such counts to fewer than one in a hundred of all patterns tried."""
    base = toxic / max(1, toxic + clean)
    kept: dict[str, tuple[int, int]] = {}
    for p, a, b in found:
        q = a / (a + b)
        if a >= 3 and q >= PURITY and q > base:
            gain = a * math.log(q / base) + (b * math.log((1 - q) / (1 - base)) if b else 0)
            if gain >= math.log(100 * max(1, tried)):
                kept[p] = (a, b)
    stems = {p: n for p, n in kept.items() if p[0] != "="}
    out: dict[str, tuple[int, int]] = {}
    for p, (a, b) in sorted(stems.items(), key=lambda x: len(x[0])):
        if any(p[:k] in out for k in range(1, len(p))):
            continue
        while True:  # the longest stem that loses none of what this one finds
            longer = [x for x in stems if x.startswith(p) and len(x) > len(p) and stems[x][0] >= 0.97 * a]
            if not longer:
                break
            p = min(longer, key=len)
            a, b = stems[p]
        out[p] = (a, b)
    words = {p[1:]: n for p, n in kept.items() if p[0] == "="}
    # a stem that is little more than one of its words is that word
    for w, (a, b) in words.items():
        for k in range(1, len(w) + 1):
            if w[:k] in out and a >= 0.9 * out[w[:k]][0]:
                del out[w[:k]]
    words = {w: n for w, n in words.items() if not any(w[:k] in out for k in range(1, len(w) + 1))}
    weight = lambda n: math.log((n[0] + 0.5) / (n[1] + 0.5)) - math.log(max(base, 1e-6) / max(1 - base, 1e-6))
    return {w: weight(n) for w, n in words.items()}, {p: weight(n) for p, n in out.items()}


def fit(labelled: DataFrame, toxic: int = TOXIC_SAMPLE, clean: int = CLEAN_SAMPLE, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Grammar:
    """Learn insults and the kinds' weights from rows with a 0/1 label (rows without one teach nothing).

    The sample is bounded: about `toxic` and `clean` texts of either label, those with the smallest hashes of doc_id and text, whole, whatever their length;
    of near copies (equal in one of three MinHash values) the one with the smallest hash is taken, lest a copied text teach its words as insults. The same rows give the same grammar.
    Patterns are counted on the executors; those that at least three toxic texts of the sample have, and few clean ones, reach the driver.
    Without texts of both labels the grammar is what it knows before it learns. Null texts are empty; repeated rows count once.
    """
    from . import shingles

    rows = labelled.where(F.col(label).isin(0, 1)).select(F.col(doc_id).cast("string").alias("d"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(label).cast("int").alias("y"))
    rows = rows.withColumn("h", F.pmod(F.xxhash64("d", "text"), F.lit(1 << 30)))
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return Grammar(dict.fromkeys(INSULTS, 4.0), {})
    share = {1: min(1.0, toxic / sizes[1]), 0: min(1.0, clean / sizes[0])}
    # the first condition asks nothing of the label, so that texts beyond it never meet the labels
    sample = rows.where(F.col("h") < int(max(share.values()) * (1 << 30))).where(F.col("h") < F.when(F.col("y") == 1, int(share[1] * (1 << 30))).otherwise(int(share[0] * (1 << 30))))

    def least(batches):
        import pyarrow as pa

        seeds = shingles.seeds(3)
        for batch in batches:
            for start, length in text_batches(batch.column("text")):
                part = batch.slice(start, length)
                made = [shingles.signature(s, seeds).tolist() if len(s) else [None] * 3 for s in shingles.sets(part.column("text").to_pylist(), 3)]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([m[i] for m in made], pa.int64()) for i in range(3))], ["text", "y", "h", "m0", "m1", "m2"])

    from .shared import cut

    sample = cut(sample.select("text", "y", "h").mapInArrow(least, "text string, y int, h long, m0 long, m1 long, m2 long"), "toxicity-sketches")
    # texts without words have no values and stay apart
    ranks = sample.select("y", "h", F.coalesce("m0", -F.col("h") - 1).alias("m0"), F.coalesce("m1", -F.col("h") - 1).alias("m1"), F.coalesce("m2", -F.col("h") - 1).alias("m2"))
    for c in ("m0", "m1", "m2"):
        ranks = ranks.groupBy("y", c).agg(F.min(F.struct("h", *(x for x in ("m0", "m1", "m2") if x != c))).alias("s")).select("y", c, "s.*")
    sample = sample.select("text", "y", "h").join(ranks.select("y", "h").distinct(), ["y", "h"], "left_semi").dropDuplicates(["y", "h"])
    sample = cut(sample.select("text", "y"), "toxicity-sample")
    sizes = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}

    def count(batches):
        import pyarrow as pa
        from collections import Counter

        found = (Counter(), Counter())
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                found[y].update(_patterns(text))
        names = list(found[0] | found[1])
        for i in range(0, len(names), 100_000):
            part = names[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array([found[y][p] for p in part], pa.int64()) for y in (1, 0))], ["p", "a", "b"])

    counted = cut(sample.mapInArrow(count, "p string, a long, b long").groupBy("p").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "patterns")
    tried = counted.where("a >= 3").count()
    pure = counted.where(f"a >= 3 and a >= {PURITY} * (a + b)")
    words, stems = lexicon(sorted((r["p"], r["a"], r["b"]) for r in pure.collect()), sizes.get(1, 0), sizes.get(0, 0), tried)
    grammar = Grammar(dict.fromkeys(INSULTS, 4.0) | words, stems)
    shared = sample.sparkSession.sparkContext.broadcast(grammar)

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            made = [shared.value.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.list_(pa.float64())), batch.column("y")], ["x", "y"])

    # texts with the same findings teach as one row with a count
    seen = sample.mapInArrow(features, "x array<double>, y int").withColumn("x", F.transform("x", lambda v: F.round(v, 1))).groupBy("x", "y").count().collect()
    grammar.bias, grammar.weights = _logistic([r["x"] for r in seen], [r["y"] for r in seen], [r["count"] for r in seen])
    return grammar


def _logistic(x, y, n, strength: float = 1.0) -> tuple[float, dict[str, float]]:
    """Newton's method; weights are drawn to what KINDS gives them."""
    import numpy as np

    a = np.c_[np.ones(len(x)), np.array(x, float).reshape(len(x), len(KINDS))]
    y, n = np.array(y, float), np.array(n, float)
    prior = np.array([BIAS, *KINDS.values()])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (n * (p - y)) + strength * (w - prior)
        step = np.linalg.solve((a * (n * p * (1 - p))[:, None]).T @ a + strength * np.eye(len(w)), grad)
        w -= step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), dict(zip(KINDS, np.maximum(w[1:], 0.0).tolist()))


def score(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts get the score of a text in which nothing is found. Repeated rows and null ids are rows
    like others. Other columns are not read. No rows: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            made = [shared.value.score(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64()), pa.array([int(s >= threshold) for s in made], pa.int32())], ["doc_id", "score", "predicted"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(each, f"doc_id {dict(docs.dtypes)[doc_id]}, score double, predicted int")


def keep_clean(docs: DataFrame, grammar: Grammar, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """The rows of docs, all their columns, whose score is below the threshold. Null and empty texts stay, as do rows without an id; repeated rows are judged alike; long texts are read whole."""
    shared = docs.sparkSession.sparkContext.broadcast(grammar)

    def each(batches):
        import pyarrow as pa

        for batch in batches:
            yield batch.filter(pa.array([shared.value.score(t) < threshold for t in batch.column(text).to_pylist()], pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
