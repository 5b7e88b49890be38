"""Minimal acyclic transducers over sorted terms.

``build`` takes distinct byte strings in ascending order and makes the
smallest acyclic automaton that accepts just those: the branch that the next
term leaves is closed from its end, and a state equal to an earlier one (same
finality, same arcs) is that one.  An arc carries the number of terms that
come before all terms through it, so the sum along a term's path is its place
in the order.  Arcs lie in one table (an arc of state s on byte b at
``base[s] + b``, owned by s), and ``places`` follows all terms of a text at
once, one byte a step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_FIELDS = ("base", "owner", "target", "weight", "final")


@dataclass
class Transducer:
    base: np.ndarray
    owner: np.ndarray
    target: np.ndarray
    weight: np.ndarray
    final: np.ndarray

    def arrays(self) -> list[bytes]:
        return [getattr(self, f).tobytes() for f in _FIELDS]

    @classmethod
    def of(cls, arrays: list[bytes]) -> "Transducer":
        return cls(*[np.frombuffer(a, bool if f == "final" else np.int32) for f, a in zip(_FIELDS, arrays)])

    def places(self, text: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Place of each span of the text among the terms, -1 if it is none."""
        out = np.full(len(start), -1, np.int64)
        who, at, state, place = np.arange(len(start)), start, np.zeros(len(start), np.int32), np.zeros(len(start), np.int32)
        while len(who):
            arc = self.base[state] + text[at]
            on = self.owner[arc] == state
            who, at, arc, place = who[on], at[on] + 1, arc[on], place[on]
            place = place + self.weight[arc]
            state = self.target[arc]
            over = at == end[who]
            if over.any():
                good = over & self.final[state]
                out[who[good]] = place[good]
                who, at, state, place = who[~over], at[~over], state[~over], place[~over]
        return out


def build(terms: list[bytes]) -> Transducer:
    """The transducer of distinct non-empty terms in ascending order."""
    ids: dict[tuple, int] = {}
    states: list[tuple] = []
    branch: list[list] = [[False, []]]  # finality and arcs of each state along the last term
    last = b""

    def close(depth: int) -> None:
        while len(branch) > depth + 1:
            final, arcs = branch.pop()
            state = (final, tuple(arcs))
            if state not in ids:
                ids[state] = len(states)
                states.append(state)
            branch[-1][1].append((last[len(branch) - 1], ids[state]))

    for term in terms:
        same = 0
        for a, b in zip(last, term):
            if a != b:
                break
            same += 1
        close(same)
        branch.extend([False, []] for _ in range(len(term) - same))
        branch[-1][0] = True
        last = term
    close(0)
    states.append((branch[0][0], tuple(branch[0][1])))
    states = [states[-1], *states[:-1]]  # the root is state 0; arcs lead to the old numbers plus one
    return _layout(states)


def _layout(states: list[tuple]) -> Transducer:
    n_terms = np.zeros(len(states), np.int64)
    for s in [*range(1, len(states)), 0]:  # targets come before those that lead to them, the root last
        final, arcs = states[s]
        n_terms[s] = final + sum(n_terms[t + 1] for _, t in arcs)
    size = sum(len(a) for _, a in states) * 2 + 1024
    owner = np.full(size, -1, np.int32)
    base, target, weight = np.zeros(len(states), np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    low = 256
    for s in sorted(range(len(states)), key=lambda i: -len(states[i][1])):
        final, arcs = states[s]
        if not arcs:
            continue
        labels = np.fromiter((b for b, _ in arcs), np.int64, len(arcs))
        while owner[low] >= 0:
            low += 1
        at, look = low, 64
        while True:
            if at + look + 512 > len(owner):
                more = len(owner)
                owner = np.concatenate((owner, np.full(more, -1, np.int32)))
                target, weight = np.concatenate((target, np.zeros(more, np.int32))), np.concatenate((weight, np.zeros(more, np.int32)))
            free = at + np.flatnonzero(owner[at : at + look] < 0) - labels[0]
            fits = free[(owner[free[:, None] + labels] < 0).all(axis=1)]
            if len(fits):
                break
            at, look = at + look, min(2 * look, 1 << 14)
        base[s] = fits[0]
        before = int(final)
        for b, t in arcs:
            slot = base[s] + b
            owner[slot], target[slot], weight[slot] = s, t + 1, before
            before += n_terms[t + 1]
    used = int(base.max()) + 512
    cut = lambda a, fill: np.concatenate((a, np.full(512, fill, a.dtype)))[:used]
    return Transducer(base, cut(owner, -1), cut(target, 0), cut(weight, 0), np.array([f for f, _ in states]))
