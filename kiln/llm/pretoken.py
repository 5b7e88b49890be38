"""Pre-tokens of public byte-pair tokenizers, found and encoded a block at a time.

``Encoder`` gives the ids of whole texts exactly as the ``tokenizers``
library does.  Word boundaries follow the tokenizer's published split
pattern; each distinct pre-token is encoded once by the library's own model
and then kept, with its code points, in a bounded worker cache.  Texts that hold a special string,
or a character whose normal form is not one code point, go through the
library whole.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from kiln.llm import textcodes as X

# Letters that may follow an apostrophe to make a pre-token of its own.
CONTRACTIONS_1 = "stmd"
CONTRACTIONS_2 = ("re", "ve", "ll")
CACHE_WORDS = 1_000_000


def _contractions(c: np.ndarray, start: np.ndarray, cls: np.ndarray) -> None:
    """Move starts so that 's, 't, 're ... are pre-tokens; ``start`` is changed in place."""
    at = np.flatnonzero((c == 39) & start)
    if not len(at):
        return
    n = np.zeros(len(at), np.int64)
    # the last place is a separator, so a letter after the apostrophe always has a place after it
    one, two = at + 1, np.minimum(at + 2, len(c) - 1)
    a, b = c[one], c[two]
    n[np.isin(a, [ord(x) for x in CONTRACTIONS_1]) & (cls[one] == X.LETTER)] = 2
    for x, y in CONTRACTIONS_2:
        n[(a == ord(x)) & (b == ord(y)) & (cls[one] == X.LETTER) & (cls[two] == X.LETTER)] = 3
    at, n = at[n > 0], n[n > 0]
    start[at + 1] = False
    to = at + n
    start[to] |= cls[to] == X.LETTER


def spaced_starts(c: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the byte-level pattern in which a word takes the space before it; white space is kept."""
    prev = np.concatenate(([X.SEP], cls[:-1]))
    after = np.concatenate((cls[1:], [X.SEP]))
    ws, word = cls == X.SPACE, (cls != X.SPACE) & (cls != X.SEP)
    before_blank = np.concatenate(([False], c[:-1] == 32)) & (prev == X.SPACE)
    start = (ws & (prev != X.SPACE)) | (ws & (after != X.SPACE) & (after != X.SEP))
    start |= word & (cls != prev) & ~before_blank
    start |= cls == X.SEP
    _contractions(c, start, cls)
    at = np.flatnonzero(start)
    end = np.concatenate((at[1:], [len(c)]))
    keep = cls[at] != X.SEP
    return at[keep], end[keep]


def word_starts(c: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the pattern that drops white space and takes numbers one by one."""
    prev = np.concatenate(([X.SEP], cls[:-1]))
    start = (cls != prev) | (cls == X.NUMBER) | (cls == X.SEP)
    _contractions(c, start, cls)
    at = np.flatnonzero(start)
    end = np.concatenate((at[1:], [len(c)]))
    keep = (cls[at] != X.SEP) & (cls[at] != X.SPACE)
    return at[keep], end[keep]


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(spare)
            spare += 1
    return out


class Encoder:
    """Ids of texts under one tokenizer file; keeps ids of pre-tokens seen by this worker."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.load(open(path, encoding="utf-8"))
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.lower = spec["normalizer"] is not None
        kinds = json.dumps([spec["normalizer"], spec["pre_tokenizer"]])
        # only the two published layouts below are split here; anything else goes through the library
        self.known = (not self.lower and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}) or (
            self.lower and spec["model"].get("end_of_word_suffix") == "</w>" and "NFC" in kinds and "Lowercase" in kinds)
        self.chars = _byte_chars()
        self.cache_words = cache_words
        self.reset()

    def reset(self) -> None:
        self.known_words = X.Words()
        self.at, self.n_ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.pool, self.used = np.zeros(4096, np.uint32), 0

    def word_ids(self, word: str) -> list[int]:
        mapped = "".join(self.chars[b] for b in word.encode("utf-8", "surrogatepass"))
        return [t.id for t in self.tok.model.tokenize(mapped)]

    def whole_ids(self, text: str) -> list[int]:
        return self.tok.encode(text, add_special_tokens=False).ids

    def plain(self, text: str) -> bool:
        """True if splitting here is certain to equal the library's result."""
        if not self.known or any(s in text for s in self.special):
            return False
        return not self.lower or text.isascii() or ("İ" not in text and unicodedata.is_normalized("NFC", text))

    def spans(self, block: X.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cls = block.classes()
        if self.lower:
            c = X.lower_code()[block.codes]
            return (c, *word_starts(c, cls))
        return (block.codes, *spaced_starts(block.codes, cls))

    def _learn(self, c, h, start, end) -> None:
        """Encode the distinct pre-tokens whose hash the cache lacks."""
        h, first = np.unique(h, return_index=True)
        lacks = self.known_words.table.get(h) < 0
        h, first = h[lacks], first[lacks]
        if not len(h):
            return
        if self.known_words.n + len(h) > self.cache_words:
            self.reset()
        start, end = start[first], end[first]
        ids = [self.word_ids(c[s:e].tobytes().decode("utf-32-le", "surrogatepass")) for s, e in zip(start.tolist(), end.tolist())]
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for w in ids for x in w), np.uint32, int(n.sum()))
        new = self.known_words.add(c, start, end, h)
        self.at, self.n_ids, self.pool = X.room(self.at, self.known_words.n), X.room(self.n_ids, self.known_words.n), X.room(self.pool, self.used + len(flat))
        self.at[new], self.n_ids[new] = self.used + np.cumsum(n) - n, n
        self.pool[self.used : self.used + len(flat)] = flat
        self.used += len(flat)

    def lookup(self, c, start, end, h=None) -> tuple[np.ndarray, dict[int, list[int]]]:
        """Cache index of every span (``h``: their hashes); spans over LONG code points, and those whose hash belongs to
        another word, come back beside it, encoded."""
        h = X.span_hash(X.prefix_hash(c), start, end) if h is None else h
        short = np.flatnonzero(end - start <= X.LONG)
        got = np.full(len(start), -1, np.int64)
        got[short] = self.known_words.find(c, start[short], end[short], h[short])
        for _ in range(2):  # once more if learning emptied the cache
            miss = short[got[short] < 0]
            if not len(miss):
                break
            before = self.known_words
            self._learn(c, h[miss], start[miss], end[miss])
            again = miss if self.known_words is before else short
            got[again] = self.known_words.find(c, start[again], end[again], h[again])
        apart = {int(i): self.word_ids(c[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass")) for i in np.flatnonzero(got < 0)}
        return got, apart

    def encode(self, texts: list[str]):
        """Yield (index of a text, its ids as uint32) for parts of texts, in order."""
        for i, ids in self._runs(texts):
            yield i, ids

    def _runs(self, texts):
        run: list[str] = []
        base = 0
        for i, text in enumerate(texts):
            if not self.plain(text):
                yield from self._flush(run, base)
                run, base = [], i + 1
                yield i, np.asarray(self.whole_ids(text), np.uint32)
            else:
                run.append(text)
        yield from self._flush(run, base)

    def _flush(self, run, base):
        for block in X.blocks(run):
            c, start, end = self.spans(block)
            got, apart = self.lookup(c, start, end)
            n, at = self.n_ids[got], self.at[got]
            for i, ids in apart.items():
                n[i] = len(ids)
            to = np.cumsum(n)
            flat = self.pool[X.spread(at, n)] if not apart else self._flat(n, at, to, apart)
            first = np.searchsorted(start, block.begin)
            last = np.searchsorted(start, block.end)
            ends = np.concatenate(([0], to))
            for k, who in enumerate(block.owner.tolist()):
                yield base + who, flat[ends[first[k]] : ends[last[k]]]

    def _flat(self, n, at, to, apart):
        at = at.copy()
        at[list(apart)] = 0
        src = np.repeat(at - (to - n), n) + np.arange(int(to[-1]))
        flat = self.pool[np.clip(src, 0, len(self.pool) - 1)]
        for i, ids in apart.items():
            flat[to[i] - n[i] : to[i]] = ids
        return flat


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
