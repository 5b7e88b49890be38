"""Texts as arrays of code points: word boundaries and word hashes without a Python loop per word.

Python's regular expressions cost about a microsecond per word.  Here a
block of texts becomes one ``uint32`` array; boundaries are comparisons of
neighbouring character classes, and the hash of any span is the difference
of two prefix sums (a polynomial hash modulo 2**64 over a random value per
code point).  Such a hash is quick but weak, so it only finds a word's place:
``Words`` compares the code points too.  Spans over ``LONG`` code points are
not kept at all.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

# Character classes.
SPACE, LETTER, NUMBER, OTHER, SEP = 0, 1, 2, 3, 9
# The code points with the Unicode property White_Space.
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
N_CODES = 0x110000
LONG = 256
BLOCK_CHARS = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(maxsize=1)
def char_class() -> np.ndarray:
    """Class of every code point: white space, letter (L*), number (N*), other."""
    out = np.full(N_CODES, OTHER, np.uint8)
    for c in range(N_CODES):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            out[c] = LETTER
        elif k == "N":
            out[c] = NUMBER
    out[WHITE_SPACE] = SPACE
    return out


@lru_cache(maxsize=1)
def lower_code() -> np.ndarray:
    """Lower-case code point of every code point (those with a longer form stay as they are)."""
    out = np.arange(N_CODES, dtype=np.uint32)
    for c in range(N_CODES):
        low = chr(c).lower()
        if len(low) == 1:
            out[c] = ord(low)
    return out


def slices(batches, rows: int = 256):
    """The rows of Arrow batches, a few at a time: texts become Python objects no faster than they are used."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def mix64(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each integer (the splitmix64 finaliser)."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _values() -> np.ndarray:
    return mix64(np.arange(N_CODES, dtype=np.uint64))


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = max(n, BLOCK_CHARS + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            f = np.full(size, base, np.uint64)
            f[0] = 1
            _POWERS[name] = np.cumprod(f, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def prefix_hash(c: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(c) + 1)
    out = np.zeros(len(c) + 1, np.uint64)
    np.cumsum(_values()[c] * up[: len(c)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span; equal spans have equal hashes wherever they lie."""
    _, down = _powers(len(prefix))
    return (prefix[end] - prefix[start]) * down[start]


class Block:
    """Some whole texts (or parts of very long ones) as one array with a separator after each."""

    def __init__(self, texts: list[str], owner: list[int], ahead: list[int] | None = None, before: list[str] | None = None):
        self.owner = np.asarray(owner, np.int64)
        self.ahead = np.asarray(ahead if ahead else [0] * len(texts), np.int64)  # characters at a piece's end that the next piece begins with
        self.before = before if before else [""] * len(texts)  # the word in front of a piece that is no beginning
        self.codes = codes("\n".join(texts) + "\n")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        self.begin = np.concatenate(([0], ends[:-1] + 1)).astype(np.int64)
        self.end = ends.astype(np.int64)

    def classes(self, table: np.ndarray | None = None) -> np.ndarray:
        out = (char_class() if table is None else table)[self.codes]
        out[self.end] = SEP
        return out


def _cut(text: str, at: int) -> int:
    """The first place from ``at`` where a space stands between two letters: every pre-tokenizer cuts there."""
    while True:
        at = text.find(" ", at)
        if at < 0 or at + 1 >= len(text):
            return len(text)
        if text[at - 1].isalpha() and text[at - 1].isascii() and text[at + 1].isalpha() and text[at + 1].isascii():
            return at
        at += 1


def blocks(texts, limit: int = BLOCK_CHARS, ahead: int = 0) -> Iterator[Block]:
    """Blocks of about ``limit`` characters; longer texts are cut between words, each piece with ``ahead`` characters of the next."""
    part: list[str] = []
    owner: list[int] = []
    extra: list[int] = []
    before: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while True:
            to = len(text) if len(text) - at <= 2 * limit else _cut(text, at + limit)
            more = min(ahead, len(text) - to)
            piece = text[at : to + more] if at or to + more < len(text) else text
            if part and size + len(piece) > limit:
                yield Block(part, owner, extra, before)
                part, owner, extra, before, size = [], [], [], [], 0
            part.append(piece)
            owner.append(i)
            extra.append(more)
            before.append(text[text.rfind(" ", 0, at) + 1 : at].split()[-1] if at else "")
            size += len(piece) + 1
            at = to
            if at >= len(text):
                break
    if part:
        yield Block(part, owner, extra, before)


class HashTable:
    """Open addressing over arrays: 64-bit hash to a non-negative integer, looked up a block at a time."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.vals = np.full(1 << bits, -1, np.int64)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, h: np.ndarray) -> np.ndarray:
        """Value of each hash, -1 where there is none."""
        slot = self._slot(h)
        out = self.vals[slot]
        left = np.flatnonzero((self.keys[slot] != h) & (out >= 0))
        out[(out >= 0) & (self.keys[slot] != h)] = -1
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            v, same = self.vals[slot], self.keys[slot] == h[left]
            found = same & (v >= 0)
            out[left[found]] = v[found]
            go = ~same & (v >= 0)
            left, slot = left[go], slot[go]
        return out

    def put(self, h: np.ndarray, v: np.ndarray) -> None:
        """Add hashes that are distinct and not there yet."""
        while (self.n + len(h)) * 2 > 1 << self.bits:
            keys, vals = self.keys[self.vals >= 0], self.vals[self.vals >= 0]
            self.clear(self.bits + 1)
            self._place(keys, vals)
        self._place(h, v)

    def _place(self, h: np.ndarray, v: np.ndarray) -> None:
        self.n += len(h)
        slot = self._slot(h)
        while len(h):
            free = np.flatnonzero(self.vals[slot] < 0)
            self.keys[slot[free]] = h[free]
            self.vals[slot[free]] = v[free]
            placed = (self.keys[slot] == h) & (self.vals[slot] == v)
            h, v, slot = h[~placed], v[~placed], slot[~placed]
            slot = (slot + 1) & ((1 << self.bits) - 1)


def room(a: np.ndarray, n: int) -> np.ndarray:
    """The array, longer if need be, with space for n values."""
    if len(a) >= n:
        return a
    out = np.zeros(max(n, 2 * len(a)), a.dtype)
    out[: len(a)] = a
    return out


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of some spans, one after the other."""
    to = np.cumsum(size)
    return np.repeat(start - (to - size), size) + np.arange(int(to[-1]) if len(to) else 0)


class Words:
    """Distinct words, numbered from 0: found by hash, held against their code points."""

    def __init__(self):
        self.table, self.n, self.used = HashTable(), 0, 0
        self.at, self.size, self.pool = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.uint32)

    def find(self, c: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Number of each span's word; -1 where there is none, or another word has its hash."""
        got = self.table.get(h)
        size = end - start
        got[(got >= 0) & (self.size[got] != size)] = -1
        on = np.flatnonzero(got >= 0)
        if len(on):
            n = size[on]
            here = spread(start[on], n)
            there = here + np.repeat(self.at[got[on]] - start[on], n)
            wrong = np.flatnonzero(c[here] != self.pool[there])
            if len(wrong):
                got[on[np.searchsorted(np.cumsum(n), wrong, "right")]] = -1
        return got

    def add(self, c: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Add words of distinct hashes that the table lacks; their numbers."""
        size = end - start
        new = np.arange(self.n, self.n + len(h), dtype=np.int64)
        flat = c[spread(start, size)]
        self.at, self.size, self.pool = room(self.at, self.n + len(h)), room(self.size, self.n + len(h)), room(self.pool, self.used + len(flat))
        self.at[new], self.size[new] = self.used + np.cumsum(size) - size, size
        self.pool[self.used : self.used + len(flat)] = flat
        self.table.put(h, new)
        self.n, self.used = self.n + len(h), self.used + len(flat)
        return new

    def text(self, k: int) -> str:
        return self.pool[self.at[k] : self.at[k] + self.size[k]].astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")


def words_of(texts: list[str]) -> tuple[Words, np.ndarray]:
    """A table of distinct texts and the number of each in it (-1: another text has its hash)."""
    words = Words()
    block = Block(texts, list(range(len(texts))))
    h = span_hash(prefix_hash(block.codes), block.begin, block.end)
    _, first = np.unique(h, return_index=True)
    words.add(block.codes, block.begin[first], block.end[first], h[first])
    return words, words.find(block.codes, block.begin, block.end, h)
