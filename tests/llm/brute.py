"""Plain re-computations that the operators are held against."""

import re
import zlib

import numpy as np

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Texts with what operators must bear: null, empty, blank, ties, repeats, long, odd letters, special strings.
TEXTS = [
    None, "", " \t\n", "One", "one two", "The quick brown fox jumps over the lazy dog. It was fun!", "The quick brown fox jumps over the lazy dog. It was fun!", "the QUICK brown fox jumps over the lazy dog. It was grand!",
    "l'été déjà passé — ÀÉ", "漢字 テスト １２３", "<|endoftext|> hi <|startoftext|>x", "word " * 3000, "x" * 5000, "🙂👍🏽 ok", "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 20,
]


def documents(spark, texts=TEXTS, ids=None):
    """A documents table with a clashing extra column; the last row has no id and no language."""
    rows = [(i, t, "en", "src0", 1, "x", 7) for i, t in zip(ids or range(len(texts)), texts)] + [(None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, term string, n_words int").repartition(3)


def crc(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode())


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {n: root(n) for n in nodes}


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def copies(rng, n=60, words=40):
    """Texts in groups of copies with a few words changed."""
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary, words).tolist() for _ in range(n // 6)]
    out = []
    for i in range(n):
        t = list(base[i % len(base)])
        for k in rng.integers(0, words, rng.integers(0, 3)):
            t[k] = vocabulary[rng.integers(500)]
        out.append(" ".join(t))
    return out


def units(rng, n=80, dims=16):
    base = rng.standard_normal((n // 8, dims))
    return np.concatenate([base + 0.04 * rng.standard_normal(base.shape) for _ in range(8)])
