"""Minimal acyclic transducers: sorted terms to their places in the order, as flat arrays.

Terms come in ascending order of their bytes. A state that can get no more
edges is replaced by an equal one, so common ends are stored once. An edge
carries how many terms precede those behind it; the sum along a term's path is
its ordinal. Arrays of terms walk in step, one byte at a time.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np


@dataclass
class Transducer:
    """Edges sorted by (state, byte): where they lead, and the terms they pass over."""

    root: int
    depth: int
    edges: np.ndarray
    targets: np.ndarray
    passed: np.ndarray
    final: np.ndarray

    @classmethod
    def of(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms without zero bytes, in ascending order."""
        states: dict[tuple, int] = {}
        counts: list[int] = []
        open_: list[list] = [[False, []]]  # the states of the last term's path: final, edges
        last = b""

        def close(upto: int) -> None:
            while len(open_) > upto + 1:
                final, out = open_.pop()
                open_[-1][1].append((last[len(open_) - 1], closed(final, tuple(out))))

        def closed(final: bool, out: tuple) -> int:
            state = states.setdefault((final, out), len(states))
            if state == len(counts):
                counts.append(final + sum(counts[target] for _, target in out))
            return state

        depth = 0
        for term in terms:
            shared = 0
            for x, y in zip(last, term):  # noqa: B905 - up to the shorter one
                if x != y:
                    break
                shared += 1
            close(shared)
            open_ += [[False, []] for _ in term[shared:]]
            open_[-1][0] = True
            last, depth = term, max(depth, len(term))
        close(0)
        root = closed(open_[0][0], tuple(open_[0][1]))

        edges, targets, passed = [], [], []
        for state, (final, out) in enumerate(states):
            before = int(final)
            for byte, target in out:
                edges.append(state << 8 | byte)
                targets.append(target)
                passed.append(before)
                before += counts[target]
        return cls(root, depth, np.array(edges, np.int64), np.array(targets, np.int32), np.array(passed, np.int64),
                   np.array([final for final, _ in states], bool))

    def ordinals(self, terms: np.ndarray) -> np.ndarray:
        """Places of terms, an array of bytes padded with zeros, from 0; -1 for what is no term."""
        out = np.full(len(terms), -1, np.int64)
        if not len(terms) or not len(self.edges):
            return out
        letters = terms.view(np.uint8).reshape(len(terms), -1)
        alive = np.arange(len(terms))
        state, place = np.full(len(terms), self.root, np.int64), np.zeros(len(terms), np.int64)
        for column in range(letters.shape[1] + 1):
            letter = letters[alive, column] if column < letters.shape[1] else np.zeros(len(alive), np.uint8)
            ended = letter == 0
            found = ended & self.final[state]
            out[alive[found]] = place[found]
            alive, state, place, letter = (x[~ended] for x in (alive, state, place, letter))
            if not len(alive):
                break
            wanted = state << 8 | letter
            at = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            hit = self.edges[at] == wanted
            alive, at = alive[hit], at[hit]
            state, place = self.targets[at].astype(np.int64), place[hit] + self.passed[at]
        return out

    def pack(self) -> list:
        """Plain values for a table row; ``unpack`` takes them in the same order."""
        return [self.root, self.depth, self.edges.tobytes(), self.targets.tobytes(), self.passed.tobytes(), self.final.tobytes()]

    @classmethod
    def unpack(cls, root: int, depth: int, edges: bytes, targets: bytes, passed: bytes, final: bytes) -> Transducer:
        return cls(root, depth, np.frombuffer(edges, np.int64), np.frombuffer(targets, np.int32), np.frombuffer(passed, np.int64),
                   np.frombuffer(final, bool))
