"""Each operator of the llm subpackage against a plain re-computation, on small tables with all the awkward rows."""

import itertools
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from furlong.llm import decontam, embeddings, langid, lm, minhash, packing, queries, sharding, token_counts, toxicity, warc  # noqa: E402

GPT = public_tokenizers.path("byte_bpe_50k.json")
CLIP = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return brute.documents(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return brute.documents(spark).where("1 = 0")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equals_sql(spark, name):
    from compare import same

    same(spark, name, queries.QUERIES[name], queries.ORACLE[name])


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, "Quick brown fox, jumps over the lazy dog it was fun"), (2, "one TWO"), (3, None), (4, "!!"), (5, "a b c d e f g h i j k l m")], "item_id long, text string")
    got = {r.doc_id: r for r in decontam.contamination(docs, items).collect()}
    assert len(got) == docs.count()
    fun = got[5]
    assert (fun.n_words, fun.n_hit, fun.items) == (12, 11, ["1"]) and brute.TEXTS[5][fun.spans[0].start : fun.spans[0].end].startswith("quick") and brute.TEXTS[5][fun.spans[0].start : fun.spans[0].end].endswith("fun")
    assert got[7].n_hit == 10 and got[0].n_words == 0 and got[4].items == ["2"]
    assert got[14].n_hit == 20 * 13 and got[14].contaminated
    small = {r.doc_id: (r.n_words, r.n_hit, r.items_sha256, r.spans) for r in decontam.contamination(docs.where("doc_id is not null"), items, most_bytes=40).collect()}
    assert small == {k: (r.n_words, r.n_hit, r.items_sha256, r.spans) for k, r in got.items() if k is not None}
    kept = decontam.contamination(docs, items, keep=True)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 5
    assert decontam.contamination(none, items).count() == 0 and decontam.contamination(docs, items.where("1 = 0")).where("contaminated").count() == 0


def test_decontamination_rounds_keep_rows(spark):
    """Several rounds give each row its own findings, whatever the ids: null, or one id for different texts."""
    items = spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon"), (3, "zeta eta theta")], "item_id long, text string")
    rows = [(None, "so alpha beta gamma"), (None, "delta epsilon zeta eta theta"), (7, "nothing"), (7, "delta epsilon it is"), (7, "delta epsilon it is"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = lambda most: sorted((repr(tuple(r)) for r in decontam.contamination(docs, items, most_bytes=most).collect()))
    once = plain(1 << 20)
    assert len(once) == len(rows) and plain(20) == once


def test_packing(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(GPT)
    want = {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in [*enumerate(brute.TEXTS), (None, "no id here")]}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in packing.pack(docs, GPT, window=64).collect():
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
    for i, ids in want.items():
        mine = sorted(pieces[i], key=lambda r: r.start)
        assert [x for r in mine for x in r.ids] == ids and all(r.doc_tokens == len(ids) for r in mine)
    for rows in windows.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 64
    assert packing.pack(none, GPT).count() == 0


def test_packing_plan_is_optimal():
    """Against a quadratic programme over the same transitions."""
    rng = np.random.default_rng(5)
    for _ in range(30):
        bounds = np.unique(np.concatenate([[0], rng.integers(1, 400, 25)])).tolist()
        ends = [bool(x) for x in rng.integers(0, 2, len(bounds))]
        _, cost = packing.plan(bounds, ends, window=32, sentence=1, hard=6, run=3, each=2)
        best = [0.0] + [np.inf] * (len(bounds) - 1)
        for j in range(1, len(bounds)):
            for i in range(j):
                span = bounds[j] - bounds[i]
                m = -(-span // 32)
                if m <= 3 or i == j - 1:
                    best[j] = min(best[j], best[i] + m * 34 - span + 6 * (m - 1))
                if span in (16, 32):
                    best[j] = min(best[j], best[i] + 2)
            best[j] += 0 if ends[j] else 1
        assert cost == pytest.approx(best[-1])


def test_sharding(spark, docs, none):
    rows = sharding.assign(docs).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = {r.doc_id: r.shard for r in sharding.assign(docs, shards=41).collect()}
    assert all(again[r.doc_id] == r.grown_shard for r in rows)
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    share = Counter(r.shard for r in sharding.assign(many, shards=[1.0, 3.0]).select("shard").collect())
    assert 2.8 < share[1] / share[0] < 3.2
    assert sharding.assign(none).count() == 0


def test_language(spark, docs, none):
    rows = [(i, t, x) for i, (t, x) in enumerate([("der hund und die katze sind nicht im haus", "de"), ("the dog and the cat are not in the house", "en"), ("le chien et le chat ne sont pas dans la maison", "fr")] * 30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert got[5].lang_pred == "en" and got[0].lang_pred == got[1].lang_pred == "und" and got[0].score == 0 and all(0 <= r.score <= 1 for r in got.values())
    assert got[9].lang_pred in model.languages and len(got) == docs.count()
    kept = langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.where("text is null").count() == 0
    assert langid.identify(none, model).count() == 0 and langid.fit(none).languages == []


def test_letters_are_no_numerals(spark):
    model = langid.Model({"x": {"ab": 3}, "y": {"cab": 4}})
    assert [x[0] for x in model.predict(["½ ② Ⅷ 12", "a½b", "", None])] == ["und", "x", "und", "und"] and langid.letters("Ab½C ②") == ["ab", "c"]


def plain_kneser_ney(counts, word, order=langid.ORDER, discount=langid.DISCOUNT, signs=5):
    """Log-probability of a word, straight from the definition."""
    pad = "\x02" * (order - 1)
    grams = [Counter() for _ in range(order)]  # by length - 1; the longest by how often, the others by how many distinct longer ones end in them
    for w, n in counts.items():
        x = pad + w + "\x03"
        for i in range(order - 1, len(x)):
            grams[-1][x[i - order + 1 : i + 1]] += n
    for n in range(order - 2, -1, -1):
        for g in grams[n + 1]:
            grams[n][g[1:]] += 1

    def p(context, c):
        lower = p(context[1:], c) if context else 1 / signs
        own = {g: n for g, n in grams[len(context)].items() if g[:-1] == context}
        total = sum(own.values())
        return (max(own.get(context + c, 0) - discount, 0) + discount * len(own) * lower) / total if total else lower

    x = pad + word + "\x03"
    return sum(np.log(p(x[i - order + 1 : i], x[i])) for i in range(order - 1, len(x)))


def test_kneser_ney_equals_its_definition():
    counts = {"x": {"ab": 3, "ba": 1, "abc": 2}, "y": {"cab": 4}}
    model = langid.Model(counts)
    names = ["ab", "cab", "b", "zz", "abcab"]
    want = [[plain_kneser_ney(counts[x], w) for x in ("x", "y")] for w in names]
    assert np.allclose(model.words(names), want)


def test_toxicity(spark, docs, none):
    rng = np.random.default_rng(3)
    vocabulary = [f"wort{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(600)]
    rows = []
    for i in range(900):
        t = rng.choice(vocabulary, 30).tolist()
        y = int(i % 5 == 0)
        if y:
            t[7] = "zork" + str(rng.choice(["a", "en", "isch", "ung", "o"]))
        rows.append((i, " ".join(t), y))
    grammar = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert list(grammar.stems) == ["zork"]
    assert grammar.score("das ist ein zorkling hier") > 0.7 > grammar.score("das ist ein haus hier")
    kinds = {k for k, _ in grammar.clause("he said you are an idiot")} | {k for k, _ in grammar.clause("you are not an idiot")} | {k for k, _ in grammar.clause("you idiot")} | {k for k, _ in grammar.clause("i will hurt you")}
    assert kinds == {"reported insult", "denied insult", "aimed insult", "threat"}
    got = {r.doc_id: r for r in toxicity.score(docs, grammar).collect()}
    assert got[0].score == got[1].score == got[2].score and got[0].predicted == 0 and len(got) == docs.count()
    assert toxicity.keep_clean(docs, grammar).columns == docs.columns
    assert toxicity.score(none, grammar).count() == 0
    assert toxicity.fit(none.withColumn("toxic", F.lit(None).cast("int"))).stems == {}


def plain_findings(grammar, text):
    """Kinds of a clause by looking around each word."""
    signs, out = [], []
    for w in toxicity.WORD.findall(text):
        stem = max((p for p in grammar.stems if w.startswith(p)), key=len, default=None)
        closed = [k for k, v in (("target", toxicity.TARGETS), ("report", toxicity.REPORTS), ("negation", toxicity.NEGATIONS), ("intent", toxicity.INTENTS), ("threat", toxicity.THREATS)) if w in v]
        signs.append(("insult", grammar.words[w]) if w in grammar.words else ("insult", grammar.stems[stem]) if stem else (closed[0] if closed else "other", 3.0))
    names = [s for s, _ in signs]
    for i, (name, weight) in enumerate(signs):
        denied, reported, intended = "negation" in names[max(0, i - 3) : i], "report" in names[:i], "intent" in names[max(0, i - 4) : i]
        aimed = "target" in names[max(0, i - 4) : i + 5]
        if name == "insult":
            out.append(("reported insult" if reported else "denied insult" if denied else "aimed insult" if aimed else "insult", weight))
        elif name == "threat" and intended and aimed:
            out.append(("weak threat" if reported or denied else "threat", weight))
    return out


def test_composed_machines_equal_a_plain_look_around():
    rng = np.random.default_rng(8)
    grammar = toxicity.Grammar({"idiot": 4.0, "scum": 3.0}, {"zork": 2.0, "zorken": 5.0})
    vocabulary = "idiot scum zorkish zorkenling zork you they not never said wrote will gonna kill töten house tree the of".split()
    for _ in range(400):
        clause = " ".join(rng.choice(vocabulary, rng.integers(1, 14)))
        assert grammar.clause(clause) == plain_findings(grammar, clause), clause
    # each clause once, whatever its length
    text = ", ".join(["you idiot"] * 2000)
    assert grammar.features(text) == grammar.features(text + ". a house") and len(grammar.clause(text)) == 2000


def test_toxicity_learns_the_same_from_rows_in_any_order(spark):
    rows = [(i, f"das wort{i % 7} " + ("zorkig " if i % 4 == 0 else "") + f"und noch {i} mal", int(i % 4 == 0)) for i in range(200)]
    one, two = (toxicity.fit(spark.createDataFrame(r, "doc_id long, text string, toxic int").repartition(n)) for r, n in ((rows, 2), (rows[::-1], 5)))
    assert (one.words, one.stems, one.bias, one.weights) == (two.words, two.stems, two.bias, two.weights)


def test_components_of_a_long_chain(spark, monkeypatch):
    """A chain of ascending ids is found in as many steps as the logarithm of its length."""
    from furlong.llm import shared

    steps, real = [], shared.cut
    monkeypatch.setattr(shared, "cut", lambda df, name: steps.append(name) or real(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(500)] + [(1000, 1001), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in shared.components(edges).collect()}
    assert got == {**dict.fromkeys(range(501), 0), 1000: 1000, 1001: 1000}
    assert len(steps) <= 16


def test_warc(spark):
    path = queries.shared_dir(spark) + "/warc-test"
    same = "<p>" + "x" * 200 + "</p>"
    pages = spark.createDataFrame([(1, "u1", None), (2, None, same), (3, "u3\r\nX: y", same), (4, "u4", "tiny"), (5, "u5", "tiny"), (6, "u6", "\r\n\r\n" + "é" * 80)], "page_id long, url string, html string")
    warc.write(warc.as_records(pages), path)
    got = {r.record_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == 6 and got["<urn:page:6>"].payload.decode() == "\r\n\r\n" + "é" * 80 and got["<urn:page:1>"].payload == b""
    assert [r.refers_to for r in got.values() if r.record_type == "revisit"] == ["<urn:page:2>"]
    only = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    assert only.count() == 1 and only.first().payload is None and only.first().payload_length == len(same)
    assert warc.read(spark, path).where(F.col("target_uri").isin("u4", "u5")).count() == 2


def test_warc_without_skip_lengths(tmp_path):
    import gzip

    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(record) + gzip.compress(record))
    (tmp_path / "b.warc").write_bytes(record * 3)
    reader = warc.WarcReader({"path": str(tmp_path)})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 5 and {r[-1] for r in rows} == {b"hello"}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_minhash(spark, none, width, percent):
    texts = [*brute.TEXTS, *brute.copies(np.random.default_rng(1))]
    docs = brute.documents(spark, texts)
    sets = {i: brute.shingles(t, width) for i, t in enumerate(texts)}
    want = brute.components(list(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    got = {r.doc_id: r for r in minhash.near_duplicates(docs, width, percent).collect()}
    assert {i: got[i].component_id for i in want} == want and all(got[i].n_shingles == len(s) for i, s in sets.items())
    assert got[None].kept and got[None].component_id is None
    assert minhash.near_duplicates(none).count() == 0


def test_minhash_blocks_of_a_long_list(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    texts = brute.copies(np.random.default_rng(2), 48, 60)
    sets = {i: brute.shingles(t, 3) for i, t in enumerate(texts)}
    want = brute.components(list(sets), lambda a, b: 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(brute.documents(spark, texts), 3, 85).collect()}
    assert {i: got[i] for i in want} == want


def test_vectors(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL", 8)
    x = brute.units(np.random.default_rng(4))
    rows = [(i, [float(v) for v in e], i % 2) for i, e in enumerate(x)] + [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] * 16, 0), (103, [1.0] * 16, None), (104, [2.0 * float(v) for v in x[0]], 0), (105, [1.0, 2.0], 0), (None, [1.0] * 16, 0)]
    got = {r.vec_id: r for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    f = {i: (np.array(e, np.float32).astype(float), y) for i, e, y in rows if i is not None and e is not None and len(e) == 16 and y is not None and np.isfinite(e).all() and np.any(e)}
    linked = lambda a, b: f[a][1] == f[b][1] and f[a][0] @ f[b][0] / np.linalg.norm(f[a][0]) / np.linalg.norm(f[b][0]) >= 0.98
    want = brute.components(list(f), linked)
    assert {i: got[i].component_id for i in f} == want
    assert all(got[i].n_links == sum(linked(i, j) for j in f if j != i) for i in f)
    assert all(got[i].n_links == 0 and got[i].kept for i in (100, 101, 102, 103, 105, None))


def test_token_counts(docs, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(CLIP)
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, CLIP).collect()}
    for i, t in [*enumerate(brute.TEXTS), (None, "no id here")]:
        assert got[i].n_tokens == len(library.encode(t or "", add_special_tokens=False).ids) and got[i].n_bytes == len((t or "").encode())
    assert got[11].over_limit and token_counts.count_tokens(none, CLIP).count() == 0


def test_language_model(docs, none):
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    got = {r.doc_id: r for r in lm.score(docs, ~held, GPT).collect()}
    tokens = {i: [*lm.words(t), lm.ENDING] for i, t in [*enumerate(brute.TEXTS), (None, "no id here")]}
    c = Counter(w for i, t in tokens.items() if brute.crc(i) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in t)) and r.score < 0
    assert lm.score(none, ~held, GPT).count() == 0


def corpus_of(spark, texts, path=GPT):
    rows = spark.createDataFrame([(i, t, i % 7 != 0) for i, t in enumerate(texts)], "doc_id long, text string, learn boolean").repartition(3)
    return lm.corpus(rows, path)


def ngrams(texts):
    """Plain counts of words, pairs and triples; the token before the first is the last."""
    found = Counter()
    for t in texts:
        w = [*lm.words(t), lm.ENDING]
        for i in range(len(w)):
            found.update([(w[i],), (w[i - 1], w[i]), (w[i - 2 if len(w) > 1 else 0], w[i - 1], w[i])])
    return found


def test_counts_are_those_of_the_whole_corpus(spark, monkeypatch):
    """Words, pairs and triples of every text, in several blocks and ranges of keys, rare or not; and without the text itself."""
    monkeypatch.setattr(lm, "RANGE_BYTES", 500)
    texts = [f"rare{i} rare{i} common stays common rare{i % 50} end" for i in range(300)] + brute.TEXTS
    known = corpus_of(spark, texts)
    want = ngrams(t for i, t in enumerate(texts) if i % 7)
    assert (known.n, known.v) == (sum(n for k, n in want.items() if len(k) == 1), sum(len(k) == 1 for k in want))
    seen = 0
    for docs, found in lm.opened(known.blocks.toArrow().to_batches()):
        at = np.cumsum([0, *found.sizes])
        apart = found.apart()
        for k, i in enumerate(docs.column("doc_id").to_pylist()):
            w, own = [*lm.words(texts[i]), lm.ENDING], ngrams([texts[i]])
            for j in range(len(w)):
                for some, counts in ((w[j],), found.one), ((w[j - 1], w[j]), found.two), ((w[j - 2 if len(w) > 1 else 0], w[j - 1], w[j]), found.three):
                    assert counts[at[k] + j] == want[some]
                for some, counts in ((w[j],), apart.one), ((w[j - 1], w[j]), apart.two), ((w[j - 2 if len(w) > 1 else 0], w[j - 1], w[j]), apart.three):
                    assert counts[at[k] + j] == want[some] - own[some]
            seen += 1
    assert seen == len(texts)


def test_all_training_texts_teach(spark):
    """Id frequencies are those of the whole corpus, a long text among them; windows of a text that learns train, each in one part of a pass."""
    texts = [f"text {i} of many" for i in range(1200)] + ["zebra " * 12_000]
    subwords, want = lm.Subwords.of(GPT), Counter()
    for i, t in enumerate(texts):
        if i % 7:
            for w in (*lm.words(t), lm.ENDING):
                want.update(subwords(w))
    got = lm.id_counts(corpus_of(spark, texts).blocks, GPT)
    assert {i: n for i, n in enumerate(got.tolist()) if n} == want
    model = lm.Model(50, np.arange(50) % 2, np.arange(50.0), 49)
    flat, sizes = np.arange(400) % 49, np.array([1, 300, 99])
    for parts in (1, 5):
        taught = 0
        for k in range(parts):
            steps = lm.Steps(model, 0.01)
            model.train(flat, sizes, k, parts, steps)
            taught += steps.ids
        assert taught == 400


def test_each_window_trains_once_in_a_corpus_of_any_size(spark, monkeypatch):
    """The rounds together teach as many ids as the texts that train have; a small corpus is passed no more often than a large one."""
    texts, subwords, taught, average = [f"text {i} of many, or few" * 9 for i in range(60)], lm.Subwords.of(GPT), [], lm._average

    def spy(copies, model, tasks):
        taught.append(copies.where("piece = 0").agg(F.sum("ids")).first()[0] or 0)
        average(copies, model, tasks)

    monkeypatch.setattr(lm, "_average", spy)
    known, want = corpus_of(spark, texts), 0
    for row in known.blocks.select("docs").collect():
        docs = lm._rows(row["docs"])
        train = lm._learn(docs) & ~lm.mixing(docs)
        want += sum(len(subwords(w)) for i in np.array(docs.column("doc_id").to_pylist())[train] for w in (*lm.words(texts[i]), lm.ENDING))
    lm.fit(known)
    assert len(taught) == lm.ROUNDS and sum(taught) == want > 0


def test_a_round_lays_out_the_texts_it_trains_on_only(spark, monkeypatch):
    """Over all rounds each text that trains is laid out once, and every round has some."""
    import pickle
    from types import SimpleNamespace

    import pyspark

    texts, subwords, laid, layout = [f"text {i} of many, or few " * (i % 9 + 1) for i in range(90)], lm.Subwords.of(GPT), [], lm.Model.layout
    known, want = corpus_of(spark, texts), Counter()
    batches = known.blocks.select("block", *lm.BODIES).toArrow().to_batches()
    for docs in (lm._rows(x.as_py()) for b in batches for x in b.column("docs")):
        for i in np.array(docs.column("doc_id").to_pylist())[lm._learn(docs) & ~lm.mixing(docs)].tolist():
            want[tuple(x for w in (*lm.words(texts[i]), lm.ENDING) for x in subwords(w))] += 1

    def spy(self, flat, sizes):
        laid.extend(tuple(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1]))
        return layout(self, flat, sizes)

    monkeypatch.setattr(lm.Model, "layout", spy)
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    model = lm.Model(subwords.end + 1, subwords.initial.astype(int), np.ones(subwords.end + 1), subwords.end)
    taught = [next(lm._learner(SimpleNamespace(value=pickle.dumps(model)), k)(batches)).column("ids")[0].as_py() for k in range(lm.ROUNDS)]
    assert Counter(laid) == want and sum(taught) == sum(len(t) * n for t, n in want.items()) and min(taught) > 0


def test_words_are_cut_at_six_blanks_only():
    for text in ("", " \t\n\x0b\x0c\r", "A\x1cB\x1d\x1e\x1f c\x85d\u00a0e\u2003f\u2028g\u3000h\x00i", "\xc9T\xc9 Stra\u00dfe \u0130 漢字\t🙂"):
        assert lm.words(text) == re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def test_ranks_and_words_beyond_all_numbers():
    keys = np.random.default_rng(1).integers(0, 50, 400).astype(np.uint64)
    met, back, n = np.unique(keys, return_inverse=True, return_counts=True)
    place, distinct = lm._ranks(keys)
    assert place.tolist() == back.tolist() and distinct.tolist() == met.tolist() and lm._met(keys).tolist() == n[back].tolist()
    assert [len(x) for x in lm._ranks(keys[:0])] == [0, 0]
    # a word of 2,000 ids that the corpus does not have: its probability is below every number, its logarithm is not
    model = lm.Model(5, np.array([1, 1, 0, 0, 1]), np.array([5.0, 3, 1, 1, 2]), 4)
    model.n = 9
    zero = np.zeros(2, np.int64)
    said = lm.Texts(np.array([1, 0]), np.array([2]), lm.Lexicon(np.array([1, 2000]), np.array([4, 0, *[2] * 1999], np.int32)), zero, zero, zero)
    assert model.mixed(said)[0] == pytest.approx(model.tokens(said)[0] + np.log(model.shares[0, 0])) and model.mixed(said)[0] < -1000


def test_words_encoded_together_are_those_encoded_alone():
    subwords = lm.Subwords.of(GPT)
    for names in (["plain", "don't", "\u00a0odd\u00a0\u00a0", "\x1c", "a\u2003b", "漢字", "🙂👍🏽", "x" * 5000, "end\u00a0"], ["<|endoftext|>", "b"]):
        sizes, flat = subwords.all(names)
        assert [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])] == [subwords(w) for w in names]


def plain_logs(model, ids):
    """The attention, one id at a time: log-probability of each id, and of any that begins a word."""
    d, p, out, begin = lm.DIMS, {k: v.astype(float) for k, v in model.p.items()}, [], []
    said = [model.end, *ids[:-1]]
    for i, y in enumerate(ids):
        q = p["rows"][model.row[said[i]]]
        weights, values = [], []
        for j in range(max(0, (i // lm.BLOCK - 1) * lm.BLOCK), i + 1):
            r = p["rows"][model.row[said[j]]]
            weights.append(np.exp(min(q[:d] @ r[d : 2 * d] / np.sqrt(d), 20) + p["far"][2 * lm.BLOCK - 1 - (i - j)]))
            values.append(r[2 * d : 3 * d])
        z = (np.average(values, axis=0, weights=weights) + q[3 * d :]) @ p["out"] + p["bias"]
        out.append(z[model.of[y]] - np.log(np.exp(z).sum()) + model.inside[y])
        begin.append(np.log(np.exp(z)[model.begins > 0].sum() / np.exp(z).sum()))
    return out, begin


def test_score_equals_a_plain_loop(spark):
    """Counts by a Counter, attention one id at a time, shares by bucket: the same score of every text."""
    texts = [*brute.TEXTS, *brute.copies(np.random.default_rng(6), 60, 30)]
    known = corpus_of(spark, texts)
    model = lm.fit(known)
    assert np.allclose(model.shares.sum(1), 1) and (model.shares[:, 0] > 0).all()
    want, subwords = ngrams(t for i, t in enumerate(texts) if i % 7), lm.Subwords.of(GPT)
    got = {r.doc_id: r.score for r in lm.scores(known, model, "long").collect()}
    level = lambda c, most: min(int(c).bit_length(), most - 1)
    for i, t in enumerate(texts):
        w = [*lm.words(t), lm.ENDING]
        ids = [subwords(x) for x in w]
        (logs, begin), at, total = plain_logs(model, [x for y in ids for x in y]), 0, 0.0
        for j in range(len(w)):
            single, pair = want[(w[j - 1],)], want[(w[j - 2 if len(w) > 1 else 0], w[j - 1])] if j else 0
            shares = model.shares[level(pair, lm.PAIRS) * lm.SINGLE + level(single, lm.SINGLE)]
            by_ids = sum(logs[at : at + len(ids[j])]) - begin[at]
            at += len(ids[j])
            by_ids += begin[at] if at < len(begin) else 0
            rest = shares[1] * want[(w[j],)] / known.n + shares[2] * want[(w[j - 1], w[j])] / max(single, 1) + (shares[3] * want[(w[j - 2], w[j - 1], w[j])] / pair if pair else 0)
            total += np.logaddexp(np.log(shares[0]) + by_ids, np.log(rest) if rest else -np.inf)
        assert got[i] == pytest.approx(total / np.log(10), rel=1e-4)


def test_words_of_all_ids_add_up_to_one():
    """A vocabulary of two ids that begin a word, two that go on and the end: all words of up to some ids, and those that are longer, are all there is after a history."""
    initial = np.array([1, 1, 0, 0, 1])
    model = lm.Model(5, initial, np.array([5.0, 3, 1, 1, 2]), 4)
    rng = np.random.default_rng(3)
    model.p = {k: rng.normal(0, 0.5, v.shape).astype(np.float32) for k, v in model.p.items()}
    model.p["bias"] = np.where(np.isin(np.arange(model.classes), model.of), model.p["bias"], -50).astype(np.float32)
    model.p["bias"][model.of[[2, 3]]] -= 1
    words_ = [(a, *rest) for n in range(5) for a in (0, 1) for rest in itertools.product((2, 3), repeat=n)]
    lexicon = lm.Lexicon(np.array([1, *map(len, words_)]), np.array([4, *(i for w in words_ for i in w)], np.int32))
    zeros = lambda n: np.zeros(n, np.int64)
    for history in ([], [1], [5, 2, 9], [30, 1, 1, 62]):
        total = 0.0
        for w in range(len(words_) + 1):
            said = [*history, w, *([0] if w else [])]
            logs = model.tokens(lm.Texts(np.array(said), np.array([len(said)]), lexicon, *map(zeros, (len(said),) * 3)))
            total += np.exp(logs[len(history)])
        assert 0.9 < total < 1.0001


def test_gradient_is_that_of_the_loss():
    """Against differences of the loss, in double precision; blocks without a past, ids that repeat and padding among them."""
    rng = np.random.default_rng(4)
    model = lm.Model(300, np.arange(300) % 2, np.arange(300.0), 299)
    model.p = {k: rng.normal(0, 0.3, v.shape) for k, v in model.p.items()}
    ids = rng.integers(0, 40, (2, 4, lm.BLOCK))
    lead, y = np.array([[True, False, False], [False, False, True]]), np.where(rng.random((2, 3, lm.BLOCK)) < 0.2, -1, rng.integers(0, 299, (2, 3, lm.BLOCK)))

    def loss():
        d, p, total, n = lm.DIMS, model.p, 0.0, 0
        for r, b, i in np.argwhere(y >= 0):
            said = model.row[ids[r, b : b + 2].ravel()]
            q = p["rows"][said[lm.BLOCK + i]]
            keys = range(lm.BLOCK if lead[r, b] else 0, lm.BLOCK + i + 1)
            weights = [np.exp(q[:d] @ p["rows"][said[j], d : 2 * d] / np.sqrt(d) + p["far"][2 * lm.BLOCK - 1 - (lm.BLOCK + i - j)]) for j in keys]
            z = (np.average([p["rows"][said[j], 2 * d : 3 * d] for j in keys], axis=0, weights=weights) + q[3 * d :]) @ p["out"] + p["bias"]
            total, n = total + np.log(np.exp(z).sum()) - z[model.of[y[r, b, i]]], n + 1
        return total / n

    where, grads = model.gradient(model.row[ids], lead, y)
    assert where.tolist() == sorted(set(model.row[ids].ravel().tolist()))
    places = [("rows", (int(where[a]), b), grads["rows"][a, b]) for a, b in zip(rng.integers(0, len(where), 12), range(0, 64, 5))]
    places += [("out", (3, 7), grads["out"][3, 7]), ("bias", (5,), grads["bias"][5]), *(("far", (k,), grads["far"][k]) for k in (0, 9, 20, 31))]
    for name, at, want in places:
        was = model.p[name][at]
        model.p[name][at] = was + 1e-5
        up = loss()
        model.p[name][at] = was - 1e-5
        down = loss()
        model.p[name][at] = was
        assert (up - down) / 2e-5 == pytest.approx(want, abs=1e-7, rel=1e-4)


def test_steps_change_the_rows_they_meet():
    """Two steps of Adam against the plain formula; rows and means that a step does not meet stay as they are."""
    ids = np.arange(2 * lm.RUN * lm.BATCH * lm.BLOCK - 2 * lm.BLOCK) % 49
    sizes = np.array([len(ids)])
    model = lm.Model(50, np.arange(50) % 2, np.arange(50.0), 49)
    plain, seen, gradient = {k: v.astype(float) for k, v in model.p.items()}, [], lm.Model.gradient
    means = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in plain.items()}

    def spy(*args):
        where, grads = gradient(model, *args)
        seen.append((where, {k: g.astype(float) for k, g in grads.items()}))
        return where, grads

    model.gradient = spy
    steps = lm.Steps(model, 0.01)
    assert all(v.shape == (len(model.p[k]), 2, *model.p[k].shape[1:]) for k, v in steps.means.items())
    model.train(ids, sizes, 0, 1, steps)
    assert steps.n == len(seen) == 2
    for n, (where, grads) in enumerate(seen, 1):
        for k, g in grads.items():
            at = where if k == "rows" else slice(None)
            m, s = means[k]
            m[at] += 0.1 * (g - m[at])
            s[at] += 0.01 * (g * g - s[at])
            plain[k][at] -= 0.01 / (1 - 0.9**n) * m[at] / (np.sqrt(s[at] / (1 - 0.99**n)) + 1e-6)
    assert all(np.allclose(model.p[k], v, atol=2e-3) for k, v in plain.items())
    unmet = np.setdiff1d(np.arange(len(model.p["rows"])), np.concatenate([w for w, _ in seen]))
    assert len(unmet) and not steps.means["rows"][unmet].any()


def test_held_out_texts_score_above_the_base(spark):
    """By what it learns from copies and histories, the model is better on texts it has not seen than add-one frequencies."""
    rows = queries.op2_score(spark, "/root/testdata/sf0.001").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert rows.s > rows.b


def test_attention_is_causal_and_adds_up():
    rng = np.random.default_rng(0)
    model = lm.Model(400, np.arange(400) % 2, np.arange(400.0), 399)
    logs = lambda ids: model.logs(np.array(ids, np.int32), np.array([len(ids)]))[0]
    text = rng.integers(0, 399, 70).tolist() + [399]
    for cut in (5, 16, 17, 40):
        assert np.allclose(logs(text)[:cut], logs(text[:cut]), atol=1e-5)
    assert np.allclose(model.logs(np.array(text * 2, np.int32), np.array([71, 71]))[0], np.tile(logs(text), 2), atol=1e-5)
    both = model.logs(np.array(text, np.int32), np.array([71]))
    assert np.allclose(both, plain_logs(model, text), atol=1e-4)
    # after any ids, those that begin a word have the probability that is given for them
    said = sum(np.exp(logs(text[:20] + [k])[-1]) for k in range(400) if k % 2)
    assert said == pytest.approx(np.exp(both[1][20]), abs=1e-4)
    whole = sum(np.exp(logs(text[:20] + [k])[-1]) for k in range(400))
    assert whole == pytest.approx(1, abs=1e-4)


def test_pipeline(spark):
    import corpus_pipeline as P

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count(), name
    near = P.drop_near_duplicates(spark, docs, d)
    sets = {r.doc_id: brute.shingles(r.text, 5) for r in docs.collect()}
    want = brute.components(list(sets), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]))
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, c in want.items() if i == c)
    assert P.run(spark, d).count() > 0
