"""Encoding of a corpus with a public byte-level BPE tokenizer (problem 6).

Texts are split into words by the tokenizer's pattern; each distinct word of a batch is encoded once. The distinct words'
symbols lie in one flat numpy array, and in each round every word's lowest-ranked pairs, found by binary search over the
sorted pair keys, are merged at once, until no word has a pair left.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import portions
from tidemark.session import spread

#: Where the public tokenizer's file lies on every executor; a parameter, the file is not part of the library.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
#: A worker keeps the encodings of at most so many distinct words and then starts afresh.
CACHE_WORDS = 400_000
#: A longer word is merged with a heap: rounds over one very long word would be quadratic.
LONG_WORD = 512
#: Symbols that are merged together in one call.
SYMBOLS = 1 << 20

# Fixed values of the tokenizer's format: the pattern that splits texts into words. White space is spelled out because
# Python's \s also has U+001C to U+001F, which the Unicode property White_Space lacks.
_SPACE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = regex.compile(rf"'(?:[sdmt]|ll|ve|re)| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
#: The same for texts that are all ASCII.
ASCII_WORDS = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t\n\v\f\r A-Za-z0-9]+|[\t\n\v\f\r ]+(?![^\t\n\v\f\r ])|[\t\n\v\f\r ]+")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 ones for themselves, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """A byte-level BPE vocabulary with merges, loaded from a tokenizer file in JSON."""

    def __init__(self, path: str = TOKENIZER):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        self.byte_ids = np.zeros(256, np.int32)
        for letter, b in _byte_letters().items():
            self.byte_ids[b] = vocab[letter]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = len(vocab)
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(order.astype(np.int32), 0)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)  # by rank
        self.none = np.int32(len(pairs))
        self.cache: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.cache.clear()
        self.flat = np.zeros(0, np.int32)
        self.start = np.zeros(1, np.int64)

    # -- merging ---------------------------------------------------------------------------------------------------

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, self.none where it is no merge."""
        want = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, want)
        return np.where(self.keys[at] == want, self.ranks[at], self.none)

    def merge_words(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge all words to the end; symbols and lengths of the result, words in order. lengths are positive."""
        done_words, done_symbols = [], []
        word = np.repeat(np.arange(len(lengths)), lengths)  # of each symbol
        rank = np.full(len(symbols), self.none, np.int32)  # of the pair that begins at each symbol
        inner = word[:-1] == word[1:]
        rank[:-1][inner] = self.pair_ranks(symbols[:-1][inner], symbols[1:][inner])
        while len(symbols):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            low = np.minimum.reduceat(rank, first)
            sizes = np.diff(np.append(first, len(word)))
            over = np.repeat(low == self.none, sizes)
            if over.any():  # finished words leave
                done_words.append(word[over])
                done_symbols.append(symbols[over])
                going = ~over
                word, symbols, rank = word[going], symbols[going], rank[going]
                low, sizes = low[low < self.none], sizes[low < self.none]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(low, sizes))
            # Of equal pairs that overlap (a run like 'aaa') every second one, from the left, is merged.
            run = np.append(True, np.diff(hit) > 1)
            place = np.arange(len(hit))
            hit = hit[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            symbols[hit] = self.merged[rank[hit]]
            keep = np.ones(len(symbols), bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged symbols are now
            symbols, word, rank = symbols[keep], word[keep], rank[keep]
            # Only pairs that have a new symbol on a side change.
            near = np.concatenate([at, at[at > 0] - 1])
            last = near == len(symbols) - 1
            rank[near[last]] = self.none
            near = near[~last]
            same = word[near] == word[near + 1]
            rank[near[~same]] = self.none
            near = near[same]
            rank[near] = self.pair_ranks(symbols[near], symbols[near + 1])
        if not done_words:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        word, symbols = np.concatenate(done_words), np.concatenate(done_symbols)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.bincount(word, minlength=len(lengths))

    def merge_long(self, symbols: list[int]) -> list[int]:
        """One word with a heap of its pairs: the lowest rank first, of equal ones the leftmost."""
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        ranks = self.pair_ranks(np.array(symbols[:-1]), np.array(symbols[1:])).tolist()
        heap = [(r, i, symbols[i], symbols[i + 1]) for i, r in enumerate(ranks) if r < self.none]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i] if symbols[i] == a else n
            if j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n:
                    s = int(self.pair_ranks(np.array([symbols[x]]), np.array([symbols[y]]))[0])
                    if s < self.none:
                        heapq.heappush(heap, (s, x, symbols[x], symbols[y]))
        return [s for s in symbols if s >= 0]

    def _learn(self, words: list[str]) -> None:
        """Encode words that are not in the cache and append them to it."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        out: list[np.ndarray] = []
        lengths = np.zeros(len(raw), np.int64)
        i = 0
        while i < len(raw):
            if sizes[i] > LONG_WORD:
                ids = np.array(self.merge_long(self.byte_ids[np.frombuffer(raw[i], np.uint8)].tolist()), np.int32)
                out.append(ids)
                lengths[i] = len(ids)
                i += 1
                continue
            j, total = i, 0
            while j < len(raw) and sizes[j] <= LONG_WORD and total < SYMBOLS:
                total += sizes[j]
                j += 1
            symbols = self.byte_ids[np.frombuffer(b"".join(raw[i:j]), np.uint8)]
            ids, lengths[i:j] = self.merge_words(symbols, sizes[i:j])
            out.append(ids)
            i = j
        self.flat = np.concatenate([self.flat, *out])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(lengths)])

    # -- texts -----------------------------------------------------------------------------------------------------

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and the offsets of each text; null and empty texts have none."""
        if len(self.cache) > CACHE_WORDS:
            self._reset()
        cache, new = self.cache, []
        places: list[int] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for k, text in enumerate(texts):
            if text:
                words = (ASCII_WORDS if text.isascii() else WORDS).findall(text)
                try:
                    places += [cache[w] for w in words]
                except KeyError:
                    del places[counts[k] :]
                    for w in words:
                        if w not in cache:
                            cache[w] = len(cache)
                            new.append(w)
                    places += [cache[w] for w in words]
            counts[k + 1] = len(places)
        if new:
            self._learn(new)
        at = np.array(places, np.int64)
        size = self.start[at + 1] - self.start[at]
        ends = np.append(0, np.cumsum(size))
        take = np.repeat(self.start[at] - ends[:-1], size) + np.arange(ends[-1])
        return self.flat[take], ends[counts]


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, ids): the ids of each row's text as it stands, without special tokens, whose strings are ordinary text.

    A null or empty text gives an empty list. One row comes out for each row in, repeated and null keys too. Very long
    texts are encoded whole. Only key and text are read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(df.schema[key].dataType)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in portions(texts):
                ids, offsets = encoder.encode_batch(texts[i:j])
                part = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).cast(kind), part], [key, "ids"])

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(work, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")
