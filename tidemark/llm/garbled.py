"""Text that was decoded with another encoding than it was written in (problem 8).

A hidden Markov model labels the non-ASCII characters of a text. One state is clean text; each other state is a pair of
encodings (written, read). Under a pair's state a character is explained by what the pair's inverse transform makes of it:
its emission is the likelihood of the restored character among its neighbours, so every state uses one model of clean
text. That model counts characters by the classes of their neighbours; it is first counted over all texts as they are,
then again over all texts as the first labelling restores them. Each labelled span gets its state's inverse transform.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.texts import portions
from tidemark.session import materialize, spread

# Names of encodings. Pairs (written, read); 'cp1252' as what text was read with also stands for latin-1.
UTF8_READ_AS = ["cp1252", "cp1250", "cp1251", "cp1253", "koi8-r", "mac-roman", "cp437", "cp850", "cp866"]
BYTE_PAIRS = [
    ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp1253", "cp1252"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"),
    ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac-roman"), ("cp1252", "cp1250"), ("cp1252", "cp1251"), ("cp1252", "cp1253"), ("cp1252", "koi8-r"),
    ("cp1250", "cp437"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "cp437"), ("cp1253", "cp437"), ("cp1251", "mac-roman"), ("cp1253", "mac-roman"), ("cp1250", "mac-roman"),
    ("mac-roman", "cp1252"), ("cp437", "cp1252"), ("cp866", "cp1252"), ("cp1253", "koi8-r"), ("cp1253", "cp1251"), ("cp1251", "cp1253"),
]
#: Written with two bytes a character, read as single bytes.
WIDE_WRITTEN = [(a, "cp1252") for a in ("shift_jis", "euc-jp", "gbk", "big5", "euc-kr")]
#: UTF-8 read with two bytes a character.
WIDE_READ = [("utf-8", b) for b in ("gbk", "shift_jis", "big5", "euc-kr")]
PAIRS = [("utf-8", b) for b in UTF8_READ_AS] + [("utf-8 twice", "cp1252")] + BYTE_PAIRS + [("bytes", "utf-8")] + WIDE_WRITTEN + WIDE_READ
LOST = 0xFFFD

#: Log likelihood of a character that a state cannot explain.
IMPOSSIBLE = -16.0
#: Log likelihood of a character that was lost in decoding but fits the state.
DROPPED = -5.0
#: Cost of a change of state between lines, between words, and inside a run of non-ASCII characters.
SWITCH = (-4.5, -8.0, -11.0)
#: Weight of the class-free model under the one with neighbours, and of the flat model under that.
BACKOFF, FLAT = 20.0, 50.0

#: Characters whose likelihoods under all states are in memory at once.
PIECE = 200_000
#: Characters that the memory of explained stretches holds.
WIDE_CACHE = 5_000_000
#: ASCII characters of class 0 that no garbled character reaches over.
_BORDER = re.compile(r"[\x00-\x2f\x3a-\x3f\x7f]")

_CLASSES = 8


def _class_table() -> np.ndarray:
    """0 blanks and marks, 1 ASCII letters, 2 digits, 3 Latin letters beyond ASCII, 4 Greek, 5 Cyrillic, 6 East Asian, 7 other."""
    t = np.full(0x110000, 7, np.int8)
    t[:0x80] = 0
    for lo, hi, k in ((0x41, 0x5B, 1), (0x61, 0x7B, 1), (0x30, 0x3A, 2), (0xC0, 0x250, 3), (0x1E00, 0x1F00, 3), (0x370, 0x400, 4), (0x1F00, 0x2000, 4), (0x400, 0x530, 5), (0x2E80, 0xA000, 6), (0xAC00, 0xD7A4, 6), (0xF900, 0xFB00, 6), (0x20000, 0x30000, 6)):
        t[lo:hi] = k
    t[[0xD7, 0xF7]] = 7
    return t


def _byte_table(codec: str) -> np.ndarray:
    """Code point -> byte of a single-byte encoding, -1 if it has none; bytes it leaves undefined are the C1 controls."""
    t = np.full(0x110000, -1, np.int32)
    t[:0x80] = np.arange(0x80)
    if codec == "cp1252":
        t[0x80:0x100] = np.arange(0x80, 0x100)
    for b in range(0x80, 0x100):
        try:
            t[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            t[b] = b if t[b] < 0 else t[b]
    return t


def _char_table(codec: str) -> np.ndarray:
    t = np.full(256, -1, np.int32)
    for b in range(256):
        try:
            t[b] = ord(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            pass
    return t


@lru_cache(None)
def _tables() -> tuple[np.ndarray, dict[str, np.ndarray], dict[str, np.ndarray]]:
    reads = {b: _byte_table(b) for b in {b for _, b in BYTE_PAIRS} | set(UTF8_READ_AS)}
    return _class_table(), reads, {a: _char_table(a) for a in {a for a, _ in BYTE_PAIRS}}


def parse_utf8(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code point of the well-formed UTF-8 character that begins at each place, else -1; and the places that continue one.

    b: bytes; anything outside 0 to 255 breaks a character. Places of neither kind that are 0x80 or more are ill-formed.
    """
    n = len(b)
    pad = np.append(b, [-1, -1, -1])
    b1, b2, b3 = pad[1 : n + 1], pad[2 : n + 2], pad[3 : n + 3]
    c1, c2, c3 = ((x >= 0x80) & (x < 0xC0) for x in (b1, b2, b3))
    cp = np.where((b >= 0) & (b < 0x80), b, -1)
    two = (b >= 0xC2) & (b < 0xE0) & c1
    cp = np.where(two, ((b & 0x1F) << 6) | (b1 & 0x3F), cp)
    v3 = ((b & 0x0F) << 12) | ((b1 & 0x3F) << 6) | (b2 & 0x3F)
    three = (b >= 0xE0) & (b < 0xF0) & c1 & c2 & (v3 >= 0x800) & ((v3 < 0xD800) | (v3 > 0xDFFF))
    cp = np.where(three, v3, cp)
    v4 = ((b & 0x07) << 18) | ((b1 & 0x3F) << 12) | ((b2 & 0x3F) << 6) | (b3 & 0x3F)
    four = (b >= 0xF0) & (b < 0xF5) & c1 & c2 & c3 & (v4 >= 0x10000) & (v4 < 0x110000)
    cp = np.where(four, v4, cp)
    inner = np.zeros(n + 3, bool)
    for k, long in ((1, two | three | four), (2, three | four), (3, four)):
        inner[k : n + k] |= long
    return cp, inner[:n]


def restore_chars(pair: tuple[str, str], c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the inverse of a pair makes of code points c: (restored code point or -1, continues the one before)."""
    _, reads, writes = _tables()
    written, read = pair
    none = np.zeros(len(c), bool)
    if written == "bytes":
        return np.where(c == LOST, LOST, np.where(c < 0x80, c, -1)), none
    b = reads[read][c]
    if written == "utf-8":
        return parse_utf8(b)
    if written == "utf-8 twice":
        once, inner = parse_utf8(b)
        at = np.flatnonzero(~inner)
        mid = once[at]
        again, inner2 = parse_utf8(np.where(mid >= 0, reads[read][np.maximum(mid, 0)], -1))
        out, cont = np.full(len(c), -1), inner.copy()
        out[at] = again
        cont[at] |= inner2
        return out, cont
    return np.where(b >= 0, writes[written][np.maximum(b, 0)], -1), none


_LOST_HANDLER = "tidemark-lost"
# A lost byte is given back as one that is no UTF-8.
codecs.register_error(_LOST_HANDLER, lambda e: (b"\xff" * (e.end - e.start), e.end))


@lru_cache(None)
def _encodable(codec: str) -> np.ndarray:
    """Which code points an encoding has; the mark of a lost byte counts as one."""
    t = np.zeros(0x110000, bool)
    t[:0x10000] = True

    def lacking(e: UnicodeEncodeError) -> tuple[str, int]:
        t[e.start : e.end] = False
        return "", e.end

    codecs.register_error("tidemark-lacking", lacking)
    "".join(map(chr, range(0x10000))).encode(codec, "tidemark-lacking")
    t[LOST] = True
    return t


class CleanModel:
    """Likelihood of a non-ASCII character of clean text, given the classes of its neighbours."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        """keys: (previous class * 8 + next class) << 21 | code point; counts of each."""
        cp, ctx = keys & 0x1FFFFF, keys >> 21
        counts = counts.astype(float)
        single = np.bincount(cp, counts, 0x110000) if len(keys) else np.zeros(0x110000)
        context = np.bincount(ctx, counts, _CLASSES * _CLASSES) if len(keys) else np.zeros(_CLASSES * _CLASSES)
        total = single.sum()
        # No clean text has the mark of a lost byte, control characters or private ones.
        never = np.zeros(0x110000, bool)
        never[0x80:0xA0] = never[LOST] = never[0xE000:0xF900] = True
        # One column for each character that was seen, before them one for all others and one for those that never are clean.
        seen = np.unique(cp[~never[cp]])
        self.place = np.zeros(0x110000, np.int32)
        self.place[never] = 1
        self.place[seen] = np.arange(2, len(seen) + 2)
        alone = np.concatenate([[1e-5 * FLAT / (total + FLAT), 1e-9], (single[seen] + 1e-5 * FLAT) / (total + FLAT)])
        n = np.zeros((_CLASSES * _CLASSES, len(alone)))
        kept = ~never[cp]
        n[ctx[kept], self.place[cp[kept]]] = counts[kept]
        self.width = len(alone)
        self.table = np.log((n + BACKOFF * alone) / (context[:, None] + BACKOFF)).astype(np.float32).ravel()

    def log(self, cp: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """cp: code points, all >= 0; before and after: neighbours' classes."""
        return self.look_up(self.place[cp], before, after)

    def look_up(self, place: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The same for characters that are given by their columns."""
        return self.table[(before.astype(np.int32) * _CLASSES + after) * self.width + place]


def codes_of(texts: list[str]) -> np.ndarray:
    """Code points of all texts, with a line end after each."""
    joined = "\n".join(texts) + "\n"
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)


def foreign_characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, place in the joined texts, text number) of all non-ASCII characters and the ones beside them."""
    return _foreign(codes_of(texts), texts)


def _foreign(c: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    high = c > 0x7F
    keep = high.copy()
    keep[1:] |= high[:-1]
    keep[:-1] |= high[1:]
    at = np.flatnonzero(keep)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return c[at], at, np.searchsorted(ends, at, "right")


def _neighbours(cls: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters before and after each; 0 where the one beside it was not kept."""
    return _beside(cls, np.diff(at) == 1)


def _beside(cls: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters before and after each, 0 where the next one is not joined to it."""
    before, after = np.zeros_like(cls), np.zeros_like(cls)
    before[1:] = cls[:-1] * joined
    after[:-1] = cls[1:] * joined
    return before, after


def counted(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of the texts' non-ASCII characters, for CleanModel."""
    c, at, _ = foreign_characters(texts)
    before, after = _neighbours(_tables()[0][c], at)
    high = c > 0x7F
    key = ((before[high].astype(np.int64) * _CLASSES + after[high]) << 21) | c[high]
    return np.unique(key, return_counts=True)


def stretches_of(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each stretch that a two-byte encoding can make: non-ASCII characters with the ASCII ones beside them that can be second bytes."""
    stops = np.flatnonzero((c < 0x40) | (c == 0x7F))
    after = np.unique(np.searchsorted(stops, np.flatnonzero(c > 0x7F)))
    return np.where(after > 0, stops[after - 1] + 1, 0), np.append(stops, len(c))[after]


class Labeller:
    """The hidden Markov model over one clean state and all PAIRS."""

    def __init__(self, model: CleanModel):
        self.model = model
        self.cls = _tables()[0]
        self._wide_cache: dict[str, list] = {}
        self._wide_size = 0

    # -- emissions -------------------------------------------------------------------------------------------------

    def _score_text(self, s: str) -> float:
        """Log likelihood of the non-ASCII characters of a restored stretch."""
        c = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        cls = self.cls[c]
        before, after = np.append(0, cls[:-1]), np.append(cls[1:], 0)
        high = c > 0x7F
        score = self.model.log(c[high], before[high], after[high])
        return float(np.where(c[high] == LOST, DROPPED, score).sum())

    def wide(self, stretch: str) -> list[tuple[int, float, str]]:
        """(state, log likelihood, restored) of a stretch under each pair with a two-byte encoding that explains it."""
        if stretch in self._wide_cache:
            return self._wide_cache[stretch]
        out = []
        first = 1 + len(PAIRS) - len(WIDE_WRITTEN) - len(WIDE_READ)
        codes = np.frombuffer(stretch.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int32)
        high = int((codes > 0x7F).sum())
        as_bytes = np.where(codes == LOST, 0xFF, _tables()[1]["cp1252"][codes])
        if as_bytes.min() >= 0:
            raw = as_bytes.astype(np.uint8).tobytes()
            for k, (written, _) in enumerate(WIDE_WRITTEN):
                restored = raw.decode(written, "replace")
                lost = restored.count("\ufffd")
                if 4 * lost <= high and restored != stretch:
                    out.append((first + k, self._score_text(restored), restored))
        else:
            self._wide_eastern([stretch])
            return self._wide_cache[stretch]
        self._remember(stretch, out)
        return out

    def _remember(self, stretch: str, out: list) -> None:
        if self._wide_size > WIDE_CACHE:
            self._wide_cache.clear()
            self._wide_size = 0
        self._wide_cache[stretch] = out
        self._wide_size += len(stretch) * (1 + len(out))

    def _wide_eastern(self, stretches: list[str]) -> None:
        """Explain stretches that UTF-8 may have become when it was read with two bytes a character, all at once."""
        found: list[list] = [[] for _ in stretches]
        # ASCII beside them is the same in all of these encodings and says nothing for or against.
        plain = [len(s.encode("ascii", "ignore")) for s in stretches]
        first = 1 + len(PAIRS) - len(WIDE_READ)
        codes, ends = codes_of(stretches), np.cumsum([len(s) + 1 for s in stretches])
        for k, (_, read) in enumerate(WIDE_READ):
            strange = np.append(0, np.cumsum(~_encodable(read)[codes]))[np.append(0, ends)]
            some = np.flatnonzero(strange[1:] == strange[:-1]).tolist()
            # A line end is no part of a character in any of them.
            raw = "\n".join([stretches[n] for n in some]).encode(read, _LOST_HANDLER)
            for n, restored in zip(some, raw.decode("utf-8", "replace").split("\n")):
                if 2 * restored.count("\ufffd") <= len(restored) - plain[n]:
                    found[n].append((first + k, self._score_text(restored), restored))
        for s, out in zip(stretches, found):
            self._remember(s, out)

    def _byte_row(self, pair: tuple[str, str], u: np.ndarray, at_u: np.ndarray, beside: np.ndarray) -> np.ndarray | None:
        """Emissions under a pair that maps characters one by one, from the distinct characters u; None if it explains none."""
        r, _ = restore_chars(pair, u)
        fits = (r >= 0x80) & (u >= 0x80)
        if not fits.any():
            return None
        cls = np.where(r >= 0, self.cls[np.maximum(r, 0)], 7)[at_u]
        before, after = _beside(cls, beside)
        row = self.model.look_up(self.model.place[np.maximum(r, 0)][at_u], before, after)
        row[~(fits | (u < 0x80))[at_u]] = IMPOSSIBLE
        return row

    def _utf8_row(self, pair: tuple[str, str], u: np.ndarray, at_u: np.ndarray, c: np.ndarray, at: np.ndarray, row: np.ndarray) -> bool:
        """Fill in the emissions under a pair that UTF-8 was read with, around places where its bytes can be; False if there are none."""
        b = _tables()[1][pair[1]][u][at_u]
        lead = np.flatnonzero((b[:-1] >= 0xC2) & (b[:-1] < 0xF5) & (b[1:] >= 0x80) & (b[1:] < 0xC0))
        if not len(lead):
            return False
        reach = 9  # more than any character that was encoded twice, and its neighbours
        near = np.zeros(len(c) + 1, np.int32)
        np.add.at(near, np.maximum(lead - reach, 0), 1)
        np.add.at(near, np.minimum(lead + reach + 1, len(c)), -1)
        part = np.flatnonzero(np.cumsum(near)[:-1] > 0)
        # A blank between parts that do not touch keeps them apart.
        gaps = np.flatnonzero(np.diff(part) > 1) + 1
        cs, places = np.insert(c[part], gaps, 0x20), np.insert(at[part], gaps, -9)
        back = np.insert(part, gaps, -1)
        r, cont = restore_chars(pair, cs)
        head = np.flatnonzero(~cont)
        cls = np.where(r[head] >= 0, self.cls[np.maximum(r[head], 0)], 7)
        # Neighbours of a restored character are those of the restored text; continuations take no place in it.
        beside = places[head[1:]] - places[head[:-1]] == np.diff(head)
        before, after = _beside(cls, beside)
        score = self.model.log(np.maximum(r[head], 0), before, after)
        score[~((r[head] >= 0x80) | (cs[head] < 0x80))] = IMPOSSIBLE
        found = np.zeros(len(cs), np.float32)
        found[head] = score
        row[back[back >= 0]] = found[back >= 0]
        return True

    def emissions(self, texts: list[str]):
        """(states, E: state x character for these, code points, place, text number, high, stretches, all code points).

        States that explain nothing here are left out; state 0, clean text, is first.
        """
        whole = codes_of(texts)
        c, at, doc = _foreign(whole, texts)
        high = c > 0x7F
        lost = c == LOST
        beside = np.diff(at) == 1
        u, at_u = np.unique(c, return_inverse=True)
        states, rows = [0], [self.model.look_up(self.model.place[u][at_u], *_beside(self.cls[u][at_u], beside))]
        for s, pair in enumerate(PAIRS[: -len(WIDE_WRITTEN) - len(WIDE_READ)], 1):
            if pair[0] in ("utf-8", "utf-8 twice"):
                row = np.full(len(c), IMPOSSIBLE, np.float32)
                if not self._utf8_row(pair, u, at_u, c, at, row):
                    continue
            elif pair[0] == "bytes":
                if not lost.any():
                    continue
                row = np.full(len(c), IMPOSSIBLE, np.float32)
            elif (row := self._byte_row(pair, u, at_u, beside)) is None:
                continue
            row[lost] = DROPPED if pair[0] == "bytes" else DROPPED - 3
            states.append(s)
            rows.append(row)
        wide: dict[int, np.ndarray] = {}
        stretches: dict[int, list] = {}
        begins, ends = stretches_of(whole)
        if len(begins):
            starts = np.cumsum([0] + [len(t) + 1 for t in texts])
            which = np.searchsorted(starts, begins, "right") - 1
            # Only stretches that are all readable as cp1252, or that have East Asian characters, can be explained.
            eastern = np.append(0, np.cumsum(self.cls[whole] == 6))
            outside = np.append(0, np.cumsum((_tables()[1]["cp1252"][whole] < 0) & (whole != LOST)))
            could = (eastern[ends] > eastern[begins]) | (outside[ends] == outside[begins])
            begins, ends, which, eastern = begins[could], ends[could], which[could], (outside[ends] != outside[begins])[could]
            cut = [texts[k][i - s : j - s] for i, j, k, s in zip(begins.tolist(), ends.tolist(), which.tolist(), starts[which].tolist())]
            new = {x for x, e in zip(cut, eastern.tolist()) if e and x not in self._wide_cache}
            if new:
                self._wide_eastern(sorted(new))
            for stretch, i, j, k in zip(cut, begins.tolist(), ends.tolist(), which.tolist()):
                found = self.wide(stretch)
                if found:
                    a, b = np.searchsorted(at, [i, j])
                    mine = np.flatnonzero(high[a:b]) + a
                    for s, score, text in found:
                        if s not in wide:
                            wide[s] = np.full(len(c), IMPOSSIBLE, np.float32)
                        wide[s][mine] = score / len(mine)
                        stretches.setdefault(k, []).append((s, i - int(starts[k]), j - int(starts[k]), text, int(mine[0])))
        for s in sorted(wide):
            states.append(s)
            rows.append(wide[s])
        E = np.stack(rows)
        E[:, ~high] = 0
        return np.array(states), E, c, at, doc, high, stretches, whole

    def label_all(self, texts: list[str]) -> list[tuple[str, int, int] | None]:
        """label for texts of any length and number, in portions.

        A text of more than PIECE characters is cut where the labels of both sides do not depend on each other: after a
        blank or mark beyond which every state is entered afresh. Where there is no such place the piece grows.
        """
        out: list = [None] * len(texts)
        short = [k for k, t in enumerate(texts) if len(t) <= PIECE]
        for i, j in portions([texts[k] for k in short], PIECE):
            for k, found in zip(short[i:j], self.label([texts[k] for k in short[i:j]])):
                out[k] = found
        for k, t in enumerate(texts):
            if len(t) > PIECE:
                parts, done, head = [], 0, SWITCH[0]
                while done < len(t):
                    end, tail = self._cut(t, done, head)
                    found = self.label([t[done:end]], head, tail)[0]
                    parts.append((t[done:end], found))
                    done, head = end, tail
                if any(f is not None for _, f in parts):
                    out[k] = ("".join(p if f is None else f[0] for p, f in parts), sum(f[1] for _, f in parts if f), sum(f[2] for _, f in parts if f))
        return out

    def _cut(self, text: str, begin: int, head: float) -> tuple[int, float]:
        """Where the piece that begins there ends, and the cost of a change of state after it (half of the usual one at the text's end)."""
        size = PIECE
        while begin + size < len(text):
            m = _BORDER.search(text, begin + size)
            end = m.end() if m else len(text)
            if end == len(text):
                break
            part = text[begin:end]
            states, E, _, at, _, high, _, whole = self.emissions([part])
            at_hi = at[np.flatnonzero(high)]
            if not len(at_hi):
                return end, SWITCH[1] if text[end - 1] != "\n" else SWITCH[0]
            switch, first = self._switches(whole, at_hi, np.zeros(len(at_hi), np.int64), head)
            _, fresh = self._screen(E[:, high], switch, first)
            # The last character after which all states are entered anew, with a border before the next one.
            for t in np.flatnonzero(fresh)[::-1][:1000].tolist():
                stop = at_hi[t + 1] if t + 1 < len(at_hi) else len(part)
                border = max((x.end() for x in _BORDER.finditer(part, int(at_hi[t]) + 1, int(stop))), default=0)
                if border:
                    return begin + border, float(switch[t + 1]) if t + 1 < len(at_hi) else SWITCH[2]
            size *= 2
        return len(text), SWITCH[0] / 2

    # -- labels ----------------------------------------------------------------------------------------------------

    @staticmethod
    def _switches(whole: np.ndarray, at: np.ndarray, doc: np.ndarray, head: float = SWITCH[0]) -> tuple[np.ndarray, np.ndarray]:
        """The cost of a change of state before each non-ASCII character, and which of them are the first of their text."""
        switch = np.full(len(at), SWITCH[1], np.float32)
        first = np.append(True, doc[1:] != doc[:-1])
        switch[1:][np.diff(at) == 1] = SWITCH[2]
        switch[1:][np.diff(np.searchsorted(np.flatnonzero(whole == 10), at)) > 0] = SWITCH[0]
        switch[first] = SWITCH[0]
        if len(switch) and head != SWITCH[0]:
            switch[0] = head
        return switch, first

    @staticmethod
    def _screen(E: np.ndarray, switch: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each character how much better than clean the best single span that ends there is, and whether all states are entered anew after it.

        A span's worth is V[t] = max(V[t - 1], switch[t]) + gain[t]; with C the running sum of gains that is
        C[t] + max over u up to t of (switch[u] - C[u - 1]), so that no loop over characters is needed.
        """
        n = E.shape[1]
        top, entered = np.full(n, -np.inf), np.ones(n, bool)
        text = np.cumsum(first) - 1
        later = np.append(switch[1:], SWITCH[2])
        for row in E[1:]:
            gain = (row - E[0]).astype(np.float64)
            total = np.cumsum(gain)
            # Texts are kept apart by steps that are larger than any difference of sums.
            step = text * (total.max() - total.min() + abs(gain).max() + 100)
            worth = total + np.maximum.accumulate(switch - (total - gain) + step) - step
            np.maximum(top, worth, out=top)
            entered &= worth <= later
        entered[np.flatnonzero(first)[1:] - 1] = True
        return top, entered

    @staticmethod
    def _viterbi(E: np.ndarray, switch: np.ndarray, spans: list[tuple[int, int]], tails: list[float]) -> list[np.ndarray]:
        """The best states of each span of characters, all spans at once, each from clean to clean; tails: the cost of that return."""
        rows = np.ascontiguousarray(E.T)
        order = sorted(range(len(spans)), key=lambda k: spans[k][0] - spans[k][1])
        begin = np.array([spans[k][0] for k in order])
        size = np.array([spans[k][1] - spans[k][0] for k in order])
        tail = np.array([tails[k] for k in order], np.float32)
        own = np.arange(E.shape[0], dtype=np.int8)
        best = rows[begin].copy()
        best[:, 1:] += switch[begin][:, None]
        back: list[np.ndarray] = []
        live, ends = len(order), np.zeros(len(order), np.int64)
        for t in range(int(size[0])):
            if t:
                at = begin[:live] + t
                top = best[:live].argmax(axis=1)
                moved = (best[np.arange(live), top] + switch[at])[:, None]
                stay = best[:live] >= moved
                back.append(np.where(stay, own, top[:, None].astype(np.int8)))
                best[:live] = np.where(stay, best[:live], moved) + rows[at]
            while live and size[live - 1] == t + 1:
                live -= 1
                last = best[live].copy()
                last[1:] += tail[live]
                ends[live] = last.argmax()
        out: list = [None] * len(spans)
        for k, n in enumerate(size.tolist()):
            path = np.zeros(n, np.int16)
            path[-1] = ends[k]
            for t in range(n - 1, 0, -1):
                path[t - 1] = back[t - 1][k, path[t]]
            out[order[k]] = path
        return out

    def label(self, texts: list[str], head: float = SWITCH[0], tail: float = SWITCH[0] / 2) -> list[tuple[str, int, int] | None]:
        """Of each text None if it is clean, else (restored text, characters in garbled spans, of these not restored).

        head, tail: the cost of a change of state at the first text's beginning and after its end, for a piece of a text.
        """
        if not texts:
            return []
        out: list = [None] * len(texts)
        states, E, c, at, doc, high, stretches, whole = self.emissions(texts)
        hi = np.flatnonzero(high)
        if not len(hi) or len(states) == 1:
            return out
        E, at_hi, doc_hi = E[:, hi], at[hi], doc[hi]
        switch, first = self._switches(whole, at_hi, doc_hi, head)
        top, entered = self._screen(E, switch, first)
        if top.max() <= 0:  # no span anywhere is worth its cost
            return out
        ends = np.append(np.flatnonzero(entered[:-1]) + 1, len(hi))
        begins = np.append(0, ends[:-1])
        last = np.append(first[1:], True)
        spans = [(i, j) for i, j, x in zip(begins.tolist(), ends.tolist(), np.maximum.reduceat(top, begins).tolist()) if x > 0]
        path = np.zeros(len(hi), np.int16)
        upto = {int(i): int(j) for i, j in zip(begins, ends)}
        while spans:
            found = self._viterbi(E, switch, spans, [tail if last[j - 1] else float(switch[j]) for _, j in spans])
            again = []
            for (i, j), p in zip(spans, found):
                if p[-1] and not last[j - 1]:
                    again.append((i, upto[j]))  # the best path goes on beyond this place
                else:
                    path[i:j] = states[p]
            spans = again
        begin = np.searchsorted(doc_hi, np.arange(len(texts) + 1))
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        for k in np.unique(doc_hi[path > 0]).tolist():
            i, j = begin[k], begin[k + 1]
            a, b = np.searchsorted(at, [starts[k], starts[k + 1]])
            restored = {s: restore_chars(PAIRS[s - 1], c[a:b]) for s in np.unique(path[i:j]).tolist() if 0 < s <= len(PAIRS) - len(WIDE_WRITTEN) - len(WIDE_READ)}
            out[k] = self._restore(texts[k], path[i:j], at_hi[i:j] - starts[k], hi[i:j] - a, c, restored, stretches.get(k, []))
        return out

    def _restore(self, text, path, places, flat, c, restored, stretches) -> tuple[str, int, int]:
        chars = list(text)
        bad = lost = 0
        wide_from = 1 + len(PAIRS) - len(WIDE_WRITTEN) - len(WIDE_READ)
        done = np.zeros(len(path), bool)
        for s, start, end, fixed, _ in stretches:
            mine = (places >= start) & (places < end)
            if (path[mine] == s).all() and not done[mine].any():
                done |= mine
                bad += int(mine.sum())
                lost += fixed.count("�")
                chars[start:end] = [fixed] + [""] * (end - start - 1)
        for s, p, f in zip(path.tolist(), places.tolist(), flat.tolist()):
            if not s or chars[p] == "" or (s >= wide_from and done[np.searchsorted(places, p)]):
                continue
            bad += 1
            if s >= wide_from:
                lost += 1
                continue
            r, cont = restored[s]
            if cont[f]:
                chars[p] = ""
            elif r[f] >= 0 and r[f] != LOST:
                chars[p] = chr(r[f])
            else:
                lost += 1
        return "".join(chars), bad, lost


# -- tables ---------------------------------------------------------------------------------------------------------


def _model(counts: DataFrame) -> CleanModel:
    """The model of clean text; its size is bounded by the alphabet: one number for each character and pair of classes."""
    t = counts.groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toPandas()
    return CleanModel(t["key"].to_numpy(np.int64), t["n"].to_numpy(np.int64))


def find_garbled(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, chars, lost) of each document with at least one garbled passage.

    restored: the text with every garbled span turned back as far as it can be; chars: non-ASCII characters in such
    spans; lost: how many of them could not be restored. The model of clean text counts all documents. Null, empty and
    pure ASCII texts give no row, as do clean ones: the pairs here leave ASCII as it is. Encodings that write other scripts in
    ASCII bytes (UTF-7, HZ, ISO-2022-JP) are not looked for.
    Each row is looked at by itself, so repeated rows and keys give repeated results. Whole texts are read.
    """
    spark = documents.sparkSession
    kind = documents.schema[key].dataType.simpleString()
    foreign = documents.where(F.length(text) != F.octet_length(text)).select(F.col(key).alias("k"), F.col(text).alias("t"))
    foreign = spread(materialize(spread(foreign), "foreign"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in portions(texts):
                keys, n = counted(texts[i:j])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    first = spark.sparkContext.broadcast(_model(foreign.select("t").mapInArrow(count, "key bigint, n bigint")))

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(first.value)
        for b in batches:
            texts = b.column(0).to_pylist()
            for i, j in portions(texts):
                keys, n = counted([t if found is None else found[0] for t, found in zip(texts[i:j], labeller.label_all(texts[i:j]))])
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], ["key", "n"])

    second = spark.sparkContext.broadcast(_model(foreign.select("t").mapInArrow(recount, "key bigint, n bigint")))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(second.value)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in portions(texts):
                part = b.slice(i, j - i)
                found = labeller.label_all(texts[i:j])
                rows = [k for k, x in enumerate(found) if x is not None]
                cols = list(zip(*(found[k] for k in rows))) or [(), (), ()]
                kinds = (pa.string(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(list(x), t) for x, t in zip(cols, kinds))], [key, "restored", "chars", "lost"])

    return foreign.mapInArrow(label, f"`{key}` {kind}, restored string, chars int, lost int")
