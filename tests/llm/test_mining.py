"""Collocations, clustering and quality rules against plain re-computations, on small tables with all the awkward rows."""

import hashlib
import math
import os
import re
import sys
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from furlong.llm import bitplanes, collocations, fertility, quotient  # noqa: E402

PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("bits", [1, 2, 7, 17, 21, 22, 31, 32])
def test_filters_lose_nothing(bits):
    rng = np.random.default_rng(bits)
    limbs = rng.integers(0, 1 << bits, (3, 3000)).astype(np.uint64)
    limbs = np.concatenate([limbs, limbs[:, :700], np.repeat(limbs[:, :1], 400, axis=1)], axis=1)
    want = Counter(zip(*limbs.tolist()))
    q, r = quotient.permute(*limbs, bits)
    assert len(set(zip(q.tolist(), r.tolist()))) == len(want)
    halves = [quotient.tally(q[s], r[s], bits) for s in (slice(0, 2000), slice(2000, None))]
    parts = min(bits, 3)
    by_part = defaultdict(list)
    for half in halves:
        for part, blob in quotient.split(*half, bits, parts):
            by_part[part].append(blob)
    got = {}
    for part, blobs in by_part.items():
        a, b, n = quotient.merge(blobs, bits)
        assert (a >> np.uint64(bits - parts) == part).all()
        got |= dict(zip(zip(*(x.tolist() for x in quotient.restore(a, b, bits))), n.tolist()))
    assert got == want


def test_filters_are_compact():
    rng = np.random.default_rng(0)
    q, r, n = quotient.tally(*quotient.permute(*rng.integers(0, 1 << 17, (3, 100_000)).astype(np.uint64), 17), 17)
    # two marks, a byte of quotient at most, five of remainder and a counter
    assert len(quotient.pack(q, r, n, 17, 0, 17)) < 8 * len(q)


def plain_collocations(rows, least, share, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(brute.LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in often.items():
            if any(len(t) > len(p) and p in (t[:2], t[1:]) and 100 * b >= share * a for t, b in often.items()):
                continue
            score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, i, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least, share, top", [(2, 50, 2000), (1, 100, 7), (3, 1, 2000)])
def test_collocations(spark, least, share, top):
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)] + ["Ünïcode", "漢字", "x'y", "UPPER", "A", "z" * 3000]
    texts = brute.TEXTS + [" ".join(rng.choice(words, 60)) + rng.choice([".", "\n", "", " ,", " "]) + "\tso  so so" for _ in range(25)]
    rows = [(t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    rows += [rows[20]] * 2
    df = spark.createDataFrame([(None, t, lang, 1, "x", 2) for t, lang in rows], "doc_id long, text string, lang string, n long, word string, f long").repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, least, share, top).collect()))
    assert got == plain_collocations(rows, least, share, top)
    assert collocations.collocations(df.where("1 = 0")).count() == 0 and collocations.collocations(df.where("text is null")).count() == 0


def test_collocations_in_many_blocks_and_ranges(spark, monkeypatch):
    """Small blocks and ranges give what one of each gives."""
    rng = np.random.default_rng(4)
    rows = [(" ".join(rng.choice([f"w{i}" for i in range(30)], 50)), "en") for _ in range(120)]
    df = spark.createDataFrame(rows, "text string, lang string").repartition(2)
    monkeypatch.setattr(collocations, "RANGE", 300)
    assert sorted(map(tuple, collocations.collocations(df, 4).collect())) == plain_collocations(rows, 4, 50, 2000)


def plain_clusters(rows, k, rounds, seed="2", scale=256):
    kept = []
    for i, v in rows:
        if v is None or len(v) != 64 or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(scale * x) for x in v]
        if sum(float(x) ** 2 for x in q) < 2.0**60:
            kept.append((i, q))
    order = sorted((r for r in kept if r[0] is not None), key=lambda r: (hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), bitplanes.planes(np.array([r[1]])).tobytes()))
    centres = [q for _, q in order + [r for r in kept if r[0] is None]][:k]

    def near(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centres))

    for _ in range(rounds):
        own = [near(q)[1] for _, q in kept]
        for j in range(len(centres)):
            mine = [q for (_, q), o in zip(kept, own) if o == j]
            if mine:
                centres[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *near(q)) for i, q in kept]
    within = Counter()
    for _, d, j in found:
        within[j] += d
    return sorted(((-1 if i is None else i), j, d, within[j], sum(within.values()), hashlib.sha256(",".join(map(str, centres[j])).encode()).hexdigest()) for i, d, j in found)


def clusters(df, **how):
    return sorted((-1 if r.vec_id is None else r.vec_id, *tuple(r)[1:]) for r in bitplanes.cluster(df, **how).collect())


def test_clusters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.standard_normal(64) * 10.0 ** rng.integers(-2, 3)).astype(np.float32).tolist()) for i in range(90)]
    rows += [(200, [0.0] * 64), (201, [0.0] * 64), (202, [-1.0] * 64), (3, rows[7][1]), (None, rows[9][1]), (203, None), (204, [1.0] * 63), (205, [1.0] * 65), (206, [])]
    rows += [(207, [math.nan] + [0.0] * 63), (208, [math.inf] + [0.0] * 63), (209, [None] + [0.0] * 63), (210, [-4e6] + [1.0] * 63), (211, [3e38] * 64), (212, [-1e-40] * 64)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "vec_id long, embedding array<float>, distance long, cluster string").repartition(3)
    for k, rounds in ((40, 5), (3, 2), (1, 1), (500, 1)):
        assert clusters(df, k=k, rounds=rounds) == plain_clusters(rows, k, rounds)
    assert clusters(df.where("1 = 0")) == [] and clusters(df.where("vec_id = 204")) == []
    assert len(clusters(df.where("vec_id = 200"))) == 1
    doubles = spark.createDataFrame(rows[:50], "vec_id int, embedding array<double>")
    assert clusters(doubles, k=5, rounds=3) == plain_clusters(rows[:50], 5, 3)


def test_planes_are_exact():
    rng = np.random.default_rng(6)
    for most in (1, 2, 255, 256, 1 << 24):
        a, b = rng.integers(-most, most, (50, 64)), rng.integers(-most, most + 1, (9, 64))
        a[0], b[0] = -most, most
        pa, pb = bitplanes.planes(a), bitplanes.planes(b)
        assert (bitplanes.numbers(pa) == a).all() and (bitplanes.dots(pa, pb) == a @ b.T).all() and (bitplanes.squares(pa) == (a * a).sum(axis=1)).all()


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    held = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(held), len(words) < 20 or 100 * len(held) > 30 * len(words)


LINES = "one two\n\n one two\none two\r\none two\n \t\none two\n# <b> $5 | 7%"
PROSE = "It was a bright cold day in April, and the clocks were striking thirteen, while nobody in the long queue outside seemed to notice how late the hour had become."


def test_quality(spark):
    rng = np.random.default_rng(7)
    texts = brute.TEXTS + [LINES, PROSE, " ".join(PROSE), "Это было в холодный ясный апрельский день, и часы били тринадцать, но никто из стоявших в очереди людей не заметил этого вовсе."]
    texts += ["spam " * 40 + PROSE, "\n".join(f"row {i} of the table with nothing else" for i in range(30)), "\U000e0001" * 10, "这是一个寒冷的晴天 " * 3] + [" ".join(rng.choice([f"w{i}" for i in range(3)], 60)) for _ in range(10)]
    df = brute.documents(spark, texts)
    got = {r.doc_id: r for r in fertility.quality(df, PIECES).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == plain_quality(t), t
        assert r.kept == (r.reason is None) and not (r.kept and r.base_failed)
    of = {t: got[i] for i, t in enumerate(texts)}
    assert of[PROSE].kept and of[PROSE].script == "latin"
    cyrillic = next(r for r in got.values() if r.script == "cyrillic")
    assert cyrillic.kept and cyrillic.chars_per_token > 0.9
    assert of[" ".join(PROSE)].reason in ("characters per token", "token entropy") and of["spam " * 40 + PROSE].reason == "repeated words"
    assert of["x" * 5000].base_failed and of[None].script == "none" and of["\U000e0001" * 10].fallback_share > 0.5
    assert fertility.quality(df.where("1 = 0"), PIECES).count() == 0


def test_quality_counts_pieces_like_the_library(spark):
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=PIECES)
    words = fertility.Words(PIECES)
    for text in brute.TEXTS + [PROSE]:
        m = fertility.measure(text, words)
        pieces = [p for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for p in library.encode(w)]
        freq = Counter(pieces)
        assert m[6] == len(pieces)
        if len(pieces) > 1:
            entropy = -sum(c / len(pieces) * math.log2(c / len(pieces)) for c in freq.values()) / math.log2(min(len(pieces), 256))
            assert m[7] == pytest.approx(m[2] / len(pieces)) and m[8] == pytest.approx(sum(map(library.is_byte, pieces)) / len(pieces)) and m[9] == pytest.approx(entropy)


def test_words_are_cut_many_at_a_time():
    """Pieces of all words lie in one array that grows and starts afresh; letters are counted by text, and windows are numbered only where two may be equal."""
    from sentencepiece import SentencePieceProcessor

    library, words = SentencePieceProcessor(model_file=PIECES), fertility.Words(PIECES)
    for said in (["a", "b", "a"], [f"word{i % 70}" for i in range(200)], ["漢字", "b", "\U000e0001", "\u2581x"]):
        assert words.cut(words.of(said)).tolist() == [p for w in said for p in library.encode(w)]
    assert words.letters("ab1 Я漢 é\U0001f600").tolist() == [3, 1, 1, 0, 0]
    words.clear()
    assert words.cut(words.of(["b", "word1"])).tolist() == library.encode("b") + library.encode("word1")
    rng = np.random.default_rng(1)
    for ids in (np.arange(50), rng.integers(0, 2, 40), np.tile(rng.integers(0, 50, 12), 2), np.zeros(9, int), np.zeros(8, int)):
        windows = Counter(tuple(ids[i : i + 8]) for i in range(len(ids) - 7))
        assert fertility.repeated(ids) == len({j for i in range(len(ids) - 7) if windows[tuple(ids[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_bands_leave_clean_documents_alone(spark):
    """Of documents labelled good, those that the base rules keep stay; of the bad ones the bands find more than the rules do."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = fertility.quality(docs, PIECES).join(labels, "doc_id").groupBy("quality", "base_failed", "kept").count().collect()
    got = {(r.quality, r.base_failed, r.kept): r["count"] for r in rows}
    assert sum(got.values()) > 100 and got.get((1, False, False), 0) == 0 and got.get((0, False, False), 0) > 0


def test_vectors_that_share_an_id_are_their_own(spark):
    """Links and classes go by vectors: an id with two unrelated vectors does not lend one's links to the other."""
    from furlong.llm import embeddings

    v, w = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    near = [1.0, 0.01, 0.0, 0.0]
    rows = [(1, v, 0), (1, w, 0), (2, near, 0), (3, w, 0), (0, near, 1), (2, near, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df).collect())
    assert got == [(0, 0, 0, True), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (3, 1, 1, False)]
    assert embeddings.near_vectors(df.where("1 = 0")).count() == 0


def test_vectors_by_blocks_and_whole_give_the_same_links(spark, monkeypatch):
    """Small labels are compared whole in parts, large ones by blocks, both against all pairs; vectors of other lengths among them."""
    from furlong.llm import embeddings

    rng = np.random.default_rng(12)
    x = rng.standard_normal((160, 20))
    x[80:] = x[rng.integers(0, 80, 80)] + rng.normal(0, 0.25, (80, 20))
    label = np.where(np.arange(160) % 4 > 0, 1, 2)
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (units @ units.T >= 0.9) & (label[:, None] == label) & ~np.eye(160, dtype=bool)
    rows = [(i, x[i].tolist(), int(label[i])) for i in range(160)] + [(i, x[i - 160, :3].tolist(), 1) for i in range(160, 162)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "CELL", 16)
    for part, direct in ((8, 1000), (8, 60), (8, 1)):
        monkeypatch.setattr(embeddings, "PART", part)
        monkeypatch.setattr(embeddings, "DIRECT", direct)
        got = {r.vec_id: r for r in embeddings.near_vectors(df, 0.9).collect()}
        assert linked.sum() > 40 and [got[i].n_links for i in range(160)] == linked.sum(1).tolist()
        for i, j in np.argwhere(linked):
            assert got[i].component_id == got[j].component_id


def test_parts_of_a_label_meet_across_and_within(spark, monkeypatch):
    """A label beyond DIRECT is compared whole if its vectors have many dimensions, and a large label's vectors are sent a few times, not hundreds."""
    from furlong.llm import embeddings

    assert 60_000 <= embeddings.DIRECT * len(embeddings.budgets(64, 0.98)) and -(-60_000 // embeddings.PART) <= 2
    rng = np.random.default_rng(4)
    x = rng.standard_normal((90, 64))
    x[45:] = x[rng.integers(0, 45, 45)] + rng.normal(0, 0.1, (45, 64))
    units = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = (units @ units.T >= 0.98) & ~np.eye(90, dtype=bool)
    df = spark.createDataFrame([(i, x[i].tolist(), 1) for i in range(90)], "vec_id long, embedding array<double>, label int")
    monkeypatch.setattr(embeddings, "DIRECT", 12)
    for part in (7, 30, 1000):
        monkeypatch.setattr(embeddings, "PART", part)
        got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
        assert linked.sum() > 20 and [got[i].n_links for i in range(90)] == linked.sum(1).tolist()
        assert all(got[i].component_id == got[j].component_id for i, j in np.argwhere(linked))


def test_pipeline_near_duplicates_on_awkward_rows(spark):
    """One row of each group stays, rows without ids stay, repeated rows are one, and other columns come through."""
    import corpus_pipeline as P

    base = " ".join(f"word{i}" for i in range(60))
    other = " ".join(f"else{i}" for i in range(60))
    rows = [(1, base, "a"), (1, base, "a"), (2, base, "b"), (3, base + " more", "c"), (4, other, "d"), (5, None, "e"), (6, "", "f"), (None, base, "g"), (None, base, "g"), (7, "tiny", "h"), (8, "tiny", "i"), (9, other[:200], "j"), (9, "x y z w v u", "j")]
    docs = spark.createDataFrame([(i, t, "en", s, 0, True) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, kept boolean")
    out = P.drop_near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r.doc_id or 0), r.text or "") for r in out.collect())
    want_ids = brute.components([1, 2, 3, 4, 5, 6, 7, 8], lambda a, b: (lambda x, y: bool(x) and bool(y) and 100 * len(x & y) >= 80 * len(x | y))(*(brute.shingles(dict((r[0], r[1]) for r in rows)[k], 5) for k in (a, b))))
    want = sorted([(0, base)] * 2 + [(i, dict((r[0], r[1]) for r in rows)[i] or "") for i in want_ids if want_ids[i] == i] + [(9, other[:200]), (9, "x y z w v u")])
    assert got == want
    assert P.drop_near_duplicates(spark, docs.where("1 = 0"), "").count() == 0
