"""Hierarchical multi-length packing of documents into training sequences.

Every task packs the documents of its own input split, a bounded buffer at a
time; nothing is shuffled.  Within a buffer:

1. *Route.*  Whole windows of the longest tier are cut off a document; what
   remains goes to the shortest context tier that holds it.
2. *Pack each tier*, longest first.  A document opens a window of its tier.
3. *Fill gaps.*  The window's gap takes the longest shorter pieces that fit
   and then the beginning of one more, whose rest is routed again.  A window
   that can't be filled waits for the next buffer.
4. *Balance.*  The finished sequences, longest first, are dealt back and
   forth over step groups of about ``step_tokens`` tokens, so that groups
   hold the same tokens and the same mix of lengths.

All full windows have a tier's exact length, so they carry no padding.  What
is left at the end of a split is cut at powers of two.

A null text counts as empty: the document is the closing id alone.  Each id
lies in exactly one piece; repeated rows are packed as often as they occur.
Extra columns are ignored.  An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import pretoken as PT
from kiln.llm import textcodes as X

TIERS = (512, 1024, 2048, 4096)
END_ID = 2
BUFFER_TOKENS = 1 << 20
STEP_TOKENS = 1 << 16


class Packer:
    """Packs one split.  A piece is (length, document number, start); documents live until their pieces are out."""

    def __init__(self, tiers=TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens = sorted(tiers), step_tokens
        self.waiting: list[tuple[int, int, int]] = []
        self.steps = 0

    def pack(self, docs: list[tuple[int, int]], last: bool) -> list[tuple[int, int, list]]:
        """``docs``: (document number, length).  Returns (tier, step group, pieces) of the finished sequences."""
        top = self.tiers[-1]
        done: list[tuple[int, list]] = []
        items = self.waiting
        for k, n in docs:
            done += [(top, [(top, k, at)]) for at in range(0, n - n % top, top)]
            if n % top:
                items.append((n % top, k, n - n % top))
        items.sort()
        self.waiting = []
        for tier, below in zip(reversed(self.tiers), [*reversed(self.tiers[:-1]), 0]):
            while items and items[-1][0] > below:
                window = [items.pop()]
                gap = tier - window[0][0]
                while gap and items:
                    # the longest piece of a shorter tier that fits, else the start of the shortest piece there is
                    at = bisect_right(items, (gap, 1 << 62, 0)) - 1
                    if at >= 0:
                        piece = items.pop(at)
                    else:
                        n, k, start = items.pop(0)
                        piece, rest = (gap, k, start), (n - gap, k, start + gap)
                        items.insert(bisect_left(items, rest), rest)
                    window.append(piece)
                    gap -= piece[0]
                if gap:
                    self.waiting += window
                else:
                    done.append((tier, window))
        if last and self.waiting:
            done += self._tail(self.waiting)
            self.waiting = []
        return self._balanced(done)

    def _tail(self, pieces) -> list[tuple[int, list]]:
        """What no window could take, cut into sequences of falling powers of two."""
        left = sum(n for n, _, _ in pieces)
        pieces, out = list(pieces), []
        while left:
            size = min(self.tiers[-1], 1 << (left.bit_length() - 1))
            room, window = size, []
            while room:
                n, k, start = pieces.pop(0)
                window.append((min(n, room), k, start))
                if n > room:
                    pieces.insert(0, (n - room, k, start + room))
                room -= window[-1][0]
            out.append((size, window))
            left -= size
        return out

    def _balanced(self, done):
        done.sort(key=lambda s: -s[0])
        groups = max(1, -(-sum(n for n, _ in done) // self.step_tokens))
        out = []
        for i, (n, pieces) in enumerate(done):
            lap, at = divmod(i, groups)
            out.append((n, self.steps + (at if lap % 2 == 0 else groups - 1 - at), pieces))
        self.steps += groups
        return out


def _documents(batches, path: str):
    """Yield (row id, ids of the whole text and the closing id) for each document of the split."""
    enc = PT.encoder(path)
    for b in X.slices(batches):
        names, texts = b.column(0).to_pylist(), [t or "" for t in b.column(1).to_pylist()]
        at, parts = 0, []
        for i, ids in enc.encode(texts):
            while at < i:
                yield names[at], _joined(parts)
                at, parts = at + 1, []
            parts.append(ids)
        while at < len(names):
            yield names[at], _joined(parts)
            at, parts = at + 1, []


def _joined(parts) -> np.ndarray:
    return np.concatenate([*parts, np.array([END_ID], np.uint32)]).astype("<u4")


SCHEMA = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, step_group long"


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", tiers=TIERS,
         buffer_tokens: int = BUFFER_TOKENS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece: document, span of its ids, their CRC-32, sequence and place in it.

    ``sequence_tokens`` is the length of the piece's sequence, ``step_group``
    the training step that it was dealt to.  Sequence and group numbers lead
    with the split's number, so they are unique without any exchange.
    """
    id_type = df.schema[id_col].dataType.simpleString()

    def run(batches):
        base = TaskContext.get().partitionId() << 36
        packer, docs, n_seq = Packer(tiers, step_tokens), {}, 0
        arrow_id = None

        def rows(done):
            nonlocal n_seq
            out = [[] for _ in range(9)]
            for size, group, pieces in done:
                at = 0
                for n, k, start in pieces:
                    name, ids = docs[k]
                    for col, v in zip(out, (name, start, n, zlib.crc32(ids[start : start + n]), len(ids), base + n_seq, at, size, base + group)):
                        col.append(v)
                    at += n
                n_seq += 1
            if out[0]:
                return pa.RecordBatch.from_arrays([pa.array(out[0], arrow_id), *[pa.array(x, pa.int64()) for x in out[1:]]],
                                                  ["doc_id", *[c.split()[0] for c in SCHEMA.split(", ")]])
            return None

        def typed(it):
            nonlocal arrow_id
            for b in it:
                arrow_id = b.schema.field(0).type
                yield b

        fresh, size, number = [], 0, 0
        for name, ids in _documents(typed(batches), path):
            docs[number] = (name, ids)
            fresh.append((number, len(ids)))
            number, size = number + 1, size + len(ids)
            if size >= buffer_tokens:
                if (out := rows(packer.pack(fresh, False))) is not None:
                    yield out
                kept = {k for _, k, _ in packer.waiting}
                docs = {k: v for k, v in docs.items() if k in kept}
                fresh, size = [], 0
        if (out := rows(packer.pack(fresh, True))) is not None:
            yield out

    return df.select(F.col(id_col).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")
