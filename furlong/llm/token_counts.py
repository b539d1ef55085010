"""Token counts: the pieces of each distinct pre-token are counted once and joined to how often every text has it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import postings

#: Texts of more tokens are over the limit.
LIMIT = 2048
#: Pre-tokens whose pieces are counted in one call.
CALL = 4096
#: In Latin letters and general punctuation Python's classes agree with the library's; a text with
#: anything else (or with the few signs below) goes through the library's own normaliser and pre-tokenizer.
_SETTLED = re.compile("[\\t-\\r -~¡-©«-±´-¸»¿-įı-ɏ‐-‧]*")
#: Fixed: the split pattern of word_bpe_49k.json, for settled texts.
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
#: Every settled sign alone, within letters, and by digits, and contractions: where the library cuts them like _PIECE, settled texts need no library.
_PROBES = [x for c in map(chr, range(0x2028)) if _SETTLED.fullmatch(c) for x in (c, f"a{c}b", f"A{c}{c} 1{c}2")] + ["it's WE'LL don't I'm you're we've he'd 's x's"]


class PreTokens:
    """The library's normaliser and pre-tokenizer, without its merges."""

    _of: dict[str, PreTokens] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = all(_PIECE.findall(x.lower()) == self._by_library(x) for x in _PROBES)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @classmethod
    def of(cls, path: str) -> PreTokens:
        if path not in cls._of:
            cls._of[path] = cls(path)
        return cls._of[path]

    def __call__(self, text: str) -> list[str]:
        """Pre-tokens of the text after normalisation; a special string of the library is one by itself."""
        if self.cut and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return [x for i, p in enumerate(parts) for x in ([p] if i % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if self.fast and _SETTLED.fullmatch(text):
            return _PIECE.findall(text.lower())
        return self._by_library(text)

    def _by_library(self, text: str) -> list[str]:
        if self.library.pre_tokenizer is None:
            return [text] if text else []
        if self.library.normalizer is None:
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        normal = self.library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def count(self, pieces: list[str]) -> list[int]:
        return [len(e.ids) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokens of every text as the library for the tokenizer file at path gives them, without added ones.

    Result per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit. Pre-tokens are what the
    tokenizer's normaliser and pre-tokenizer make; their pieces are counted once for each distinct one,
    and joined to blocks of per-document frequencies (furlong.llm.postings). No ids are kept.

    A null or empty text has 0 bytes and 0 tokens. Null ids and repeated rows are rows like others.
    Other columns of docs are not read. No rows: no rows.
    """

    def terms(batch):
        cutter = PreTokens.of(path)
        return [cutter(x or "") for x in batch]

    def pieces(batches):
        import pyarrow as pa

        cutter = PreTokens.of(path)
        for batch in batches:
            for i in range(0, batch.num_rows, CALL):
                part = batch.column(0).slice(i, CALL)
                yield pa.RecordBatch.from_arrays([part, pa.array(cutter.count(part.to_pylist()), pa.int64())], ["term", "value"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    values = postings.distinct_terms(rows, terms).mapInArrow(pieces, "term string, value long")
    sums = postings.weigh(postings.build(rows, terms), values, "value long")
    return sums.select("doc_id", "n_bytes", F.col("value").alias("n_tokens"), (F.col("value") > limit).alias("over_limit"))
