"""Quality rules by tokeniser fertility: how a public vocabulary cuts a text's words says whether it is prose."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .postings import to_arrow
from .shared import text_batches

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_BLANKS, _SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
#: Words in the windows that are looked for again; a power of two.
WINDOW = 8
#: Odd factors of the places of a window.
_PLACE = tuple(0x9E3779B97F4A7C15 * 3**j % (1 << 64) | 1 for j in range(1, 65))
#: Words and their pieces that a task remembers before it starts afresh.
HELD_WORDS, HELD_BYTES = 300_000, 64 << 20
#: The largest number of tokens that a text could be expected to use without repeating one: what its entropy is measured by.
FULL = 256


class Band(NamedTuple):
    """What a text of one script may have: characters per token from and to, share of byte fallback to, entropy (of the largest possible) from."""

    chars_from: float
    chars_to: float
    fallback_to: float
    entropy_from: float


#: Bands by script. Prose in Latin letters has 1.6 characters a token or more, hardly a byte, and 0.74 of the entropy or more; a repeated word, shouted or spaced
#: letters and runs of signs have less. Vocabularies know other scripts less well: fewer characters a token, more bytes.
BANDS = {
    "latin": Band(1.2, 9.0, 0.2, 0.70),
    "cyrillic": Band(0.9, 9.0, 0.3, 0.65),
    "cjk": Band(0.2, 4.0, 0.9, 0.55),
    "other": Band(0.2, 9.0, 0.98, 0.50),
    "none": Band(0.5, 9.0, 0.5, 0.60),
}
SCRIPTS = tuple(BANDS)
_CJK = {"CJK", "HIRAGANA", "KATAKANA", "HANGUL", "BOPOMOFO"}

_MEASURES = "script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, fallback_share double, entropy double"


def script(letter: str) -> int:
    """Number of a letter's script among SCRIPTS, by the first word of its name; -1 of what is no letter."""
    if not letter.isalpha():
        return -1
    name = unicodedata.name(letter, "").split(" ")[0].split("-")[0]
    return SCRIPTS.index("latin" if name == "LATIN" else "cyrillic" if name == "CYRILLIC" else "cjk" if name in _CJK else "other")


class _Numbers(dict):
    """Numbers of words as they come; new: those that came since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _appended(array, used: int, more):
    """array, of which `used` are in use, with more behind them; it doubles when it is full."""
    import numpy as np

    if used + len(more) > len(array):
        array = np.concatenate([array[:used], np.empty(max(used, len(more)), array.dtype)])
    array[used : used + len(more)] = more
    return array


class Words:
    """Words numbered as they come, each with its pieces, encoded once."""

    def __init__(self, path: str):
        import numpy as np
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.library.is_byte(i) for i in range(self.library.vocab_size())])
        #: Script of each character that was met, -1 of what is no letter, -2 of those not met.
        self.script = np.full(0x110000, -2, np.int8)
        self.clear()

    def clear(self):
        import numpy as np

        self.number = _Numbers()
        self.pieces, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)
        self.n_pieces = self.bytes = 0

    def of(self, words: list[str]):
        """The numbers of words."""
        import numpy as np

        known = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new = self.number.new
        if new:
            encoded = self.library.encode(new, num_threads=1)
            sizes = np.fromiter(map(len, encoded), np.int64, len(new))
            flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(sizes.sum()))
            self.starts = _appended(self.starts, known, self.n_pieces + np.cumsum(sizes) - sizes)
            self.sizes = _appended(self.sizes, known, sizes)
            self.pieces = _appended(self.pieces, self.n_pieces, flat)
            self.n_pieces += len(flat)
            self.bytes += 8 * sum(map(len, new)) + 200 * len(new)
            self.number.new = []
        return numbers

    def cut(self, numbers):
        """The pieces of words in turn."""
        import numpy as np

        sizes = self.sizes[numbers]
        return self.pieces[np.repeat(self.starts[numbers] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))]

    def letters(self, text: str):
        """How many letters of each script a text has."""
        import numpy as np

        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds = self.script[points]
        if (kinds == -2).any():
            for c in np.unique(points[kinds == -2]).tolist():
                self.script[c] = script(chr(c))
            kinds = self.script[points]
        return np.bincount(kinds[kinds >= 0], minlength=len(SCRIPTS))


def repeated(ids, width: int = WINDOW) -> int:
    """How many of ids lie in windows of `width` that occur twice or more: windows are numbered by doubling, pair by pair, so equal numbers are equal windows."""
    import numpy as np

    if len(ids) <= width:
        return 0
    # equal windows have equal sums of their numbers times odd ones, so where no two sums are equal there is nothing to number
    n = len(ids) - width + 1
    sums = np.zeros(n, np.uint64)
    for j in range(width):
        sums += ids[j : j + n].astype(np.uint64) * np.uint64(_PLACE[j % len(_PLACE)])
    sums.sort()
    if (sums[1:] != sums[:-1]).all():
        return 0
    at, step = np.unique(ids, return_inverse=True)[1], 1
    while step < width:
        at = np.unique(at[:-step] * (int(at.max()) + 1) + at[step:], return_inverse=True)[1]
        step *= 2
    start = np.flatnonzero(np.bincount(at)[at] > 1)
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[start] += 1
    edge[start + width] -= 1
    return int((edge.cumsum() > 0).sum())


def measure(text: str | None, words: Words) -> tuple:
    """The measures of one text, in the order of _MEASURES."""
    import numpy as np

    text = text or ""
    found = _WORD.findall(text)
    symbols = sum(map(text.count, _SYMBOLS))
    if not found:
        return "none", 0, 0, symbols, 0, 0, 0, 0.0, 0.0, 0.0
    lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
    chars = len(text) - sum(map(text.count, _BLANKS))
    ids = words.of(found)
    letters = words.letters(text)
    pieces = words.cut(ids)
    n = len(pieces)
    if not n:  # words of nothing but signs that the vocabulary drops
        return "none", len(found), chars, symbols, len(lines) - len(set(lines)), repeated(ids), 0, 0.0, 0.0, 0.0
    pieces.sort()
    first = np.flatnonzero(np.append(True, pieces[1:] != pieces[:-1]))
    kinds, freq = pieces[first], np.diff(np.append(first, n))
    entropy = float(-(freq / n * np.log2(freq / n)).sum()) / float(np.log2(min(n, FULL))) if n > 1 else 1.0
    name = SCRIPTS[int(letters.argmax())] if letters.any() else "none"
    return name, len(found), chars, symbols, len(lines) - len(set(lines)), repeated(ids), n, chars / n, float(freq[words.is_byte[kinds]].sum() / n), entropy


def quality(docs: DataFrame, path: str, bands: dict[str, Band] = BANDS, least_words: int = 20, most_repeated: int = 30, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base rules and the verdict of the bands on every text. path: a sentencepiece vocabulary with byte fallback.

    Result per row of docs: doc_id; n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in windows of eight that the text has twice or more);
    base_failed (fewer than least_words words, or more than most_repeated percent of them repeated); kept: neither that nor outside a band; and what the
    bands look at: script (of most letters; `none` without letters), n_tokens, chars_per_token, fallback_share, entropy (of tokens, over
    that of the smaller of n_tokens and 256 different ones), and reason (null where kept).

    Words are cut into pieces by themselves, so a word's pieces are worked out once a task and blanks do not matter. Bands are
    parameters, of each script, and look at nothing but the text. A null or empty text has no words and fails the base rules. Null ids and repeated rows are rows
    like others, long texts are measured whole, other columns are not read. No rows: no rows.
    """

    def each(batches):
        import pyarrow as pa

        words = Words(path)
        for batch in batches:
            for start, length in text_batches(batch.column(1)):
                rows = []
                for t in batch.column(1).slice(start, length):
                    rows.append(measure(t.as_py(), words))
                    if len(words.number) > HELD_WORDS or words.bytes > HELD_BYTES:
                        words.clear()
                cols = [batch.column(0).slice(start, length)] + [pa.array(c, f.type) for c, f in zip(zip(*rows), list(schema)[1:])]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    ids = dict(docs.dtypes)[doc_id]
    schema = to_arrow(f"doc_id {ids}, {_MEASURES}")
    got = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(each, f"doc_id {ids}, {_MEASURES}")
    outside = F.lit(None).cast("string")
    for name, b in bands.items():
        why = F.when(~F.col("chars_per_token").between(b.chars_from, b.chars_to), "characters per token").when(F.col("fallback_share") > b.fallback_to, "byte fallback").when(F.col("entropy") < b.entropy_from, "token entropy")
        outside = F.when(F.col("script") == name, why).otherwise(outside)
    base = F.when(F.col("n_words") < least_words, "few words").when(100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"), "repeated words")
    got = got.withColumns({"base_failed": base.isNotNull(), "reason": F.coalesce(base, outside)})
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("reason").isNull().alias("kept"), "script", "n_tokens", "chars_per_token", "fallback_share", "entropy", "reason")
