"""Evaluation texts that leak into training text (problem 7).

Both sides are sequences of words. Every window of `size` words of an item and of a document is mapped by a CGK random
walk (Chakraborty, Goldenberg, Koucky, STOC 2016) of 3 * size steps from edit distance to Hamming distance: step j emits
the word under the pointer, and a random bit of (j, word), the same for all windows, says whether the pointer moves on.
Bit-sampling LSH takes some of the emitted words as the key of a window; windows with equal keys are candidates, and each is
verified by its exact edit distance. The repetitions follow from the share of equal steps that edits leave, which is
simulated, so that the expected recall reaches its target. Equal windows always have equal keys and are all found.

Keys are made lazily: a window is given up as soon as the words sampled so far begin no item's key.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import portions
from tidemark.session import materialize, spread

#: Words of a window: this many consecutive words of an item make a leak.
WINDOW = 25
#: Sampled coordinates of a key; half of them from the first third of the walk.
SAMPLES = 6
#: Expected share of the true pairs within max_edits that is found.
RECALL = 0.95
SEED = 20_240_501
#: Items of at most so many characters are indexed once and broadcast; more are indexed by the executors and joined.
BLOCK_CHARS = 16_000_000
#: Bits of the bitmaps of words and keys that are broadcast where items are joined.
BITMAP_BITS = 1 << 27
#: Pairs of windows whose edit distances are computed together.
VERIFIED = 50_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """The longest runs of letters, digits and underscores, in lower case; none for null. Both small sigmas are one letter."""
    if not text:
        return []
    if "İ" in text:  # its lower case is two characters, of which the second is no letter
        return [w.lower().replace("ς", "σ") for w in _WORD.findall(text)]
    low = text.lower()
    return _WORD.findall(low.replace("ς", "σ") if "ς" in low else low)


def _hash(word: str) -> int:
    """64 bits of a word; 0 stands for no word."""
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) or 1


def _mixed(x: np.ndarray, seed: np.uint64) -> np.ndarray:
    """Well mixed bits of numbers under a seed."""
    with np.errstate(over="ignore"):
        z = (x ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(32))


@lru_cache(None)
def equal_steps(size: int, edits: int, pairs: int = 100, walks: int = 30) -> np.ndarray:
    """Of simulated pairs of windows so many random edits apart, the share of steps at which they agree: a row for each pair, a column for each walk."""
    rng = np.random.default_rng(SEED)
    found = np.zeros((pairs, walks))
    for n in range(pairs):
        x = list(range(1, size + 1))
        y = list(x)
        for e in range(edits):
            kind, at = rng.integers(3), int(rng.integers(len(y)))
            if kind == 0:
                y[at] = size + 1 + e
            elif kind == 1:
                y.insert(at, size + 1 + e)
            else:
                del y[at]
        y = (y + [size + 100 + k for k in range(edits)])[:size]
        for w in range(walks):
            p = q = same = 0
            for row in rng.integers(0, 2, (3 * size, size + 100 + edits), dtype=np.int8).tolist():
                a, b = x[p] if p < size else 0, y[q] if q < size else 0
                same += a == b
                p, q = p + row[a], q + row[b]
            found[n, w] = same / (3 * size)
    return found


def repetitions(size: int, samples: int, max_edits: int, recall: float) -> int:
    """Keys that a window needs so that the expected share of pairs max_edits apart that agree in one of them is recall."""
    if max_edits == 0:
        return 1
    agree = (equal_steps(size, max_edits) ** samples).mean(axis=1)
    for n in range(1, 1000):
        if 1 - ((1 - agree) ** n).mean() >= recall:
            return n
    raise ValueError(f"{max_edits} edits in {size} words leave too little in common")


def edit_distances(items: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each row the least edit distance between the item's words and any beginning of the document's words.

    docs may be longer than items; 0 in docs is no word and equals none.
    """
    steps = np.arange(docs.shape[1] + 1)
    row = np.tile(steps, (len(docs), 1))
    for i in range(items.shape[1]):
        above = np.minimum(row[:, :-1] + ((docs != items[:, i : i + 1]) | (docs == 0)), row[:, 1:] + 1)
        new = np.concatenate([np.full((len(docs), 1), i + 1), above], axis=1) - steps
        row = np.minimum.accumulate(new, axis=1) + steps
    return row.min(axis=1)


class Walks:
    """The random walks of all repetitions and the steps that are sampled from each."""

    def __init__(self, size: int, samples: int = SAMPLES, max_edits: int = 0, recall: float = RECALL, seed: int = SEED):
        self.size, self.max_edits = size, max_edits
        rng = np.random.default_rng(seed)
        self.rounds: list[tuple[np.ndarray, np.ndarray]] = []
        early = min(size, samples - samples // 2)
        for _ in range(repetitions(size, samples, max_edits, recall)):
            steps = np.append(rng.choice(size, early, replace=False), size + rng.choice(2 * size, min(samples // 2, 2 * size), replace=False))
            self.rounds.append((np.sort(steps), rng.integers(0, 1 << 63, int(steps.max()) + 1, dtype=np.uint64)))

    def keys(self, number: int, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The whole key, 64 bits, of each window hashes[start : end] in one repetition."""
        steps, seeds = self.rounds[number]
        at, key, wanted = start.copy(), np.full(len(start), number + 1, np.uint64), set(steps.tolist())
        for j, seed in enumerate(seeds):
            symbol = np.where(at < end, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0))
            if j in wanted:
                key = _mixed(key * np.uint64(3) + symbol, np.uint64(SEED))
            at += (_mixed(symbol, seed) & np.uint64(1)).astype(np.int64)
        return key


class ItemIndex:
    """The windows of a block of items: symbols, LSH keys, and the items that have each window."""

    def __init__(self, items: list[tuple[int, str | None]], size: int = WINDOW, samples: int = SAMPLES, max_edits: int = 0, recall: float = RECALL, seed: int = SEED):
        self.size, self.max_edits = size, max_edits
        self.vocabulary: dict[str, int] = {}
        windows: dict[tuple, set] = {}
        for item, text in items:
            symbols = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            for i in range(len(symbols) - size + 1):
                windows.setdefault(tuple(symbols[i : i + size]), set()).add(item)
        self.windows = np.array(list(windows), np.int32).reshape(len(windows), size)
        self.items = [sorted(x) for x in windows.values()]
        hashes = np.array([0, *map(_hash, self.vocabulary)], np.uint64)
        self.rounds = []
        for steps, seeds in Walks(size, samples, max_edits, recall, seed).rounds:
            moves = np.stack([(_mixed(hashes, s) & np.uint64(1)).astype(np.int32) for s in seeds])
            keys = np.zeros(len(self.windows), np.int64)
            stages = []
            start = np.arange(len(self.windows)) * size
            for coordinate in self._walk(self.windows.ravel(), start, steps, moves):
                # A prefix of the key is numbered among the items' prefixes.
                keys, kept = self._number(keys, coordinate)
                stages.append(kept)
            self.rounds.append((steps, moves, stages, *self._grouped(keys)))

    def _walk(self, flat: np.ndarray, start: np.ndarray, steps: np.ndarray, moves: np.ndarray) -> Iterator[np.ndarray]:
        at, end = start.copy(), start + self.size
        wanted = set(steps.tolist())
        for j in range(steps[-1] + 1):
            symbol = np.where(at < end, flat[np.minimum(at, end - 1)], 0)
            if j in wanted:
                yield symbol
            at += moves[j][symbol]

    def _number(self, prefix: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = prefix * (len(self.vocabulary) + 1) + symbol
        kept, number = np.unique(both, return_inverse=True)
        return number.astype(np.int64), kept

    @staticmethod
    def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return order, np.append(np.searchsorted(keys[order], np.arange(keys.max() + 1 if len(keys) else 0)), len(keys))

    def symbols(self, text: str | None) -> list[int]:
        get = self.vocabulary.get
        return [get(w, 0) for w in words_of(text)]

    def candidates(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into start, window number) with equal keys; flat[s : e] is the window at each s of start."""
        found = []
        for steps, moves, stages, order, begin in self.rounds:
            alive, at = np.arange(len(start)), start.copy()
            key = np.zeros(len(start), np.int64)
            stage, wanted = 0, set(steps.tolist())
            for j in range(steps[-1] + 1):
                symbol = np.where(at < end[alive], flat[np.minimum(at, end[alive] - 1)], 0)
                if j in wanted:
                    kept = stages[stage]
                    both = key * (len(self.vocabulary) + 1) + symbol
                    number = np.searchsorted(kept, both)
                    hit = kept[np.minimum(number, len(kept) - 1)] == both
                    alive, at, key, symbol = alive[hit], at[hit], number[hit], symbol[hit]
                    stage += 1
                    if not len(alive):
                        break
                at = at + moves[j][symbol]
            if len(alive):
                n = begin[key + 1] - begin[key]
                where = np.repeat(begin[key], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                found.append(np.stack([np.repeat(alive, n), order[where]]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        pos, window = np.unique(np.concatenate(found, axis=1), axis=1)
        return pos, window

    def find(self, texts: list[str | None]) -> tuple[list[int], list[int], list[int]]:
        """(index of the text, item id, least edits between windows of both), each pair once."""
        best: dict[tuple[int, int], int] = {}
        if not len(self.windows):
            return [], [], []
        flat, doc, start, end, last = _windows([self.symbols(t) for t in texts], self.size, self.max_edits, np.int32)
        pos, window = self.candidates(flat, start, end)
        exact = np.zeros(len(pos), bool)
        padded = np.append(flat, np.zeros(self.size + self.max_edits, np.int32))
        for i in range(0, len(pos), VERIFIED):
            p, w = pos[i : i + VERIFIED], window[i : i + VERIFIED]
            there = padded[start[p][:, None] + np.arange(self.size)]
            exact[i : i + VERIFIED] = (there == self.windows[w]).all(axis=1) & (end[p] - start[p] == self.size)
        for p, w in np.unique(np.stack([doc[start[pos[exact]]], window[exact]]), axis=1).T.tolist():
            for item in self.items[w]:
                best[p, item] = 0
        if self.max_edits:
            # Pairs that share an equal window are settled; the rest is measured.
            rest = [r for r in np.flatnonzero(~exact).tolist() if any(best.get((int(doc[start[pos[r]]]), x), 9) for x in self.items[window[r]])]
            reach = self.size + self.max_edits
            for i in range(0, len(rest), VERIFIED):
                r = np.array(rest[i : i + VERIFIED])
                s = start[pos[r]]
                there = padded[s[:, None] + np.arange(reach)]
                there[s[:, None] + np.arange(reach) >= last[doc[s]][:, None]] = 0
                edits = edit_distances(self.windows[window[r]], there)
                for d, w, e in zip(doc[s].tolist(), window[r].tolist(), edits.tolist()):
                    if e <= self.max_edits:
                        for item in self.items[w]:
                            best[d, item] = min(e, best.get((d, item), e))
        rows = sorted((d, i, e) for (d, i), e in best.items())
        return [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]


def _windows(lists: list[list], size: int, max_edits: int, kind) -> tuple[np.ndarray, ...]:
    """All words in one array, the text of each, and begin and end of each window with at most max_edits unknown words (0).

    At a text's end windows may be shorter by max_edits words. last: the end of each text.
    """
    sizes = np.array([len(x) for x in lists], np.int64)
    last = np.cumsum(sizes)
    flat = np.fromiter((s for x in lists for s in x), kind, int(sizes.sum()))
    doc = np.repeat(np.arange(len(lists)), sizes)
    start = np.arange(len(flat))
    end = np.minimum(start + size, last[doc]) if len(flat) else start
    strange = np.append(0, np.cumsum(flat == 0))
    ok = (end - start >= size - max_edits) & (strange[end] - strange[start] + size - (end - start) <= max_edits)
    return flat, doc, start[ok], end[ok], last


def _bitmap(bits: DataFrame) -> np.ndarray:
    """The bits named in a column, of BITMAP_BITS; what comes to the driver is bounded by that."""
    words = bits.groupBy(F.expr("bit div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("v")).toArrow()
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    out[words["w"].to_numpy()] = words["v"].to_numpy()
    return out.view(np.uint64)


def _has(bitmap: np.ndarray, x: np.ndarray) -> np.ndarray:
    bit = x % np.uint64(BITMAP_BITS)
    return (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _joined(documents: DataFrame, items: DataFrame, walks: Walks) -> DataFrame:
    """(doc, item, edits) for items of any number: executors make the keys of both sides, which are joined and verified.

    documents, items: (id, text). Bitmaps of the items' words and keys keep all but the likely windows out of the shuffle.
    """
    spark, size, most = documents.sparkSession, walks.size, walks.max_edits
    signed = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))

    def rows(ids: pa.Array, texts: list, known, wide: int) -> Iterator[pa.RecordBatch]:
        for i, j in portions(texts):
            lists = [[_hash(w) for w in words_of(t)] for t in texts[i:j]]
            if known is not None:
                lists = [np.where(_has(known[0], np.array(x, np.uint64)), np.array(x, np.uint64), np.uint64(0)).tolist() for x in lists]
            flat, doc, start, end, last = _windows(lists, size, 0 if known is None else most, np.uint64)
            padded = np.append(flat, np.zeros(wide, np.uint64))
            for n in range(len(walks.rounds) if len(start) else 0):
                key = walks.keys(n, flat, start, end)
                some = np.flatnonzero(_has(known[1], key)) if known is not None else np.arange(len(key))
                for a in range(0, len(some), VERIFIED):
                    r = some[a : a + VERIFIED]
                    there = padded[start[r][:, None] + np.arange(wide)]
                    there[start[r][:, None] + np.arange(wide) >= last[doc[start[r]]][:, None]] = 0
                    words = pa.ListArray.from_arrays(pa.array(np.arange(len(r) + 1, dtype=np.int32) * wide), signed(there.ravel()))
                    yield pa.RecordBatch.from_arrays([signed(key[r]), ids.slice(i, j - i).take(pa.array(doc[start[r]])).cast(pa.int64()), words], ["key", "id", "words"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from rows(b.column(0), b.column(1).to_pylist(), None, size)

    schema = "key bigint, id bigint, words array<bigint>"
    indexed = materialize(spread(items).mapInArrow(index, schema).distinct(), "items")
    bit = lambda c: F.expr(f"cast(pmod(cast({c} as decimal(20,0)) + if({c} < 0, 18446744073709551616, 0), {BITMAP_BITS}) as bigint)").alias("bit")
    known = spark.sparkContext.broadcast((_bitmap(indexed.select(F.explode("words").alias("w")).select(bit("w"))), _bitmap(indexed.select(bit("key")))))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from rows(b.column(0), b.column(1).to_pylist(), known.value, size + most)

    found = spread(documents).mapInArrow(search, schema).select("key", F.col("id").alias("doc"), F.col("words").alias("there"))
    pairs = found.join(indexed.select("key", F.col("id").alias("item"), "words"), "key").select("doc", "item", "there", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                there, words = (np.stack(b.column(k).to_numpy(zero_copy_only=False)) for k in (2, 3))
                edits = edit_distances(words, there)
                ok = pa.array(edits <= most)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok), pa.array(edits).filter(ok)], ["doc", "item", "edits"])

    return pairs.mapInArrow(verify, "doc bigint, item bigint, edits bigint")


def find_leaks(documents: DataFrame, items: DataFrame, doc: str = "doc_id", item: str = "item_id", text: str = "text", size: int = WINDOW, max_edits: int = 0, recall: float = RECALL) -> DataFrame:
    """(doc, item, edits): each pair in which the document contains size consecutive words of the item, up to max_edits edits.

    edits is the least number found. Pairs with 0 edits are all found, of those with more at least the share recall is
    expected. All documents are searched, whole, whatever their length. Items are the query set: up to BLOCK_CHARS
    characters of them are indexed on the driver and broadcast, more are indexed by the executors and joined. Null and empty
    texts, and items of fewer than size words, give no rows; a document or item that is there twice under one id gives its
    pair once. Columns other than those named are not read.
    """
    spark = documents.sparkSession
    named = items.where(F.col(item).isNotNull() & F.col(text).isNotNull()).select(F.col(item).cast("bigint").alias("item"), F.col(text).alias("text"))
    searched = documents.where(F.col(doc).isNotNull()).select(F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"))
    total = named.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).head()[0]
    if total > BLOCK_CHARS:
        out = _joined(searched, named, Walks(size, max_edits=max_edits, recall=recall))
    else:
        index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in named.collect()], size, max_edits=max_edits, recall=recall))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts = b.column(1).to_pylist()
                for i, j in portions(texts):
                    d, found, edits = index.value.find(texts[i:j])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i + x for x in d], pa.int64())), pa.array(found, pa.int64()), pa.array(edits, pa.int64())], ["doc", "item", "edits"])

        out = spread(searched).mapInArrow(work, "doc bigint, item bigint, edits bigint")
    return out.groupBy("doc", "item").agg(F.min("edits").cast("int").alias("edits")).select(F.col("doc").alias(doc), F.col("item").alias(item), "edits")
