"""Exact byte-level BPE encoding of Arrow text columns with a bounded word cache."""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space as the pre-tokenizer's pattern sees it.
_SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
#: A space that stands between white space on the left and white space or the
#: text's end on the right belongs to a longer white-space token; such texts are
#: encoded whole. Before every other space the pre-tokenizer always cuts.
_WHOLE = rf"{_SPACE} {_SPACE}|{_SPACE} $"


class CachedEncoder:
    """Encodes texts as ``tokenizers`` does, asking it once for each distinct word.

    The pre-tokenizer cuts before a space that follows other text, and merges never
    cross a cut, so a text's ids are the ids of its first word and of each
    following ``" " + word``. Distinct words come from Arrow's dictionary encoding;
    up to ``max_words`` stay in the cache, the rest are encoded again.

    A text that spells an added token out, such as ``<|endoftext|>``, is encoded whole, so
    that it gets the ids that the library gives it.
    """

    def __init__(self, path: str, max_words: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = "|".join([_WHOLE, *(rf"\Q{t}\E" for t in added)])
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_bytes = np.zeros(max(vocab.values(), default=0) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # one character of a byte-level token is one byte
        self.max_words = max_words
        self.words = pa.array([], pa.string())
        self.pool = np.zeros(0, np.uint32)
        self.bounds = np.zeros(1, np.int64)

    def _ids(self, strings: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def _spaced(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of every " " + word, one after another, and their bounds."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        spaced = [" " + w for w in words]
        parts = []
        for i in range(0, len(spaced), 20_000):  # the library's results are large beside their ids
            lists = self._ids(["".join(spaced[j : min(j + 1000, i + 20_000)]) for j in range(i, min(i + 20_000, len(spaced)), 1000)])
            parts += [np.array(x, np.uint32) for x in lists]
        ids = np.concatenate(parts)
        ends = np.cumsum(self.n_bytes[ids])
        at = np.cumsum([len(w.encode()) for w in spaced])
        return ids, np.concatenate([[0], np.searchsorted(ends, at, side="right")]).astype(np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all ``texts`` (no nulls) one after another, and their bounds."""
        texts = texts.cast(pa.string())
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
        n = len(texts)
        if not n:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        whole = pc.match_substring_regex(texts, self.whole)
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        bounds = np.asarray(split.offsets, dtype=np.int64)
        flat = pc.dictionary_encode(split.flatten())
        codes, words = np.array(flat.indices, dtype=np.int64), flat.dictionary
        first = words.take(pa.array(codes[bounds[:-1]])).to_pylist()
        if pc.any(whole).as_py():
            for i in np.flatnonzero(np.asarray(whole)).tolist():
                first[i] = texts[i].as_py()

        known = pc.index_in(words, value_set=self.words)
        missing = words.filter(pc.is_null(known))
        ids, ends = self._spaced(missing.to_pylist())
        first_ids = [np.array(x, np.uint32) for x in self._ids(first)]
        where = np.array(pc.fill_null(known, -1), dtype=np.int64)
        where[where < 0] = len(self.words) + np.arange(len(missing))
        pool = np.concatenate([self.pool, ids, *first_ids])
        new_bounds = np.concatenate([self.bounds, self.bounds[-1] + ends[1:]])
        starts = np.concatenate([new_bounds, new_bounds[-1] + np.cumsum([len(x) for x in first_ids])])

        entry = where[codes]
        entry[bounds[:-1]] = len(new_bounds) - 1 + np.arange(n)
        lengths = (starts[1:] - starts[:-1])[entry]
        ends_at = np.cumsum(lengths)
        at = np.arange(ends_at[-1], dtype=np.int32)
        at += np.repeat((starts[entry] - (ends_at - lengths)).astype(np.int32), lengths)
        out = pool[at]
        doc_bounds = np.concatenate([[0], ends_at[bounds[1:] - 1]])
        if len(self.words) + len(missing) <= self.max_words:
            self.words = pa.concat_arrays([self.words, missing])
            self.pool, self.bounds = np.concatenate([self.pool, ids]), new_bounds
        return out, doc_bounds


@lru_cache(maxsize=2)
def encoder(path: str) -> CachedEncoder:
    """One encoder for each Python worker, kept between its tasks."""
    return CachedEncoder(path)
