"""Least paths of many words at once through the lattices that a vocabulary's tokens span over them.

An automaton (a trie with failure links, in arrays) reads one sign of all words at a time and names the longest token that
ends there in each; links lead to the shorter ones. The least path to a position is that to where a token starts plus the token's
weight behind the last token of that path. All words advance together, so every step is a few array operations.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Mapping

import numpy as np

NEVER = np.inf  # the weight of an arc that cannot be taken
UNKNOWN = -1  # the id of a sign without a token
PAIRS = 400_000  # weights of token pairs remembered


class Automaton:
    """Arrays of the states: children by class of sign, the longest proper suffix that is a state, the longest token that ends there."""

    def __init__(self, tokens: Mapping[str, int], alike: Mapping[str, str]):
        kids: list[dict[str, int]] = [{}]
        at = {}
        for token, i in tokens.items():
            state = 0
            for sign in token:
                if sign not in kids[state]:
                    kids[state][sign] = len(kids)
                    kids.append({})
                state = kids[state][sign]
            at[state] = i
        self._number_signs(kids, alike)
        n = len(kids)
        self.back = np.zeros(n, np.int32)
        self.longest = np.full(n, -1, np.int32)
        self.shorter = np.full(max(tokens.values(), default=-1) + 2, -1, np.int32)
        self.length = np.zeros(len(self.shorter), np.int32)
        for token, i in tokens.items():
            self.length[i] = len(token)
        back, longest = [0] * n, [-1] * n
        queue = deque([0])
        while queue:
            state = queue.popleft()
            for sign, child in kids[state].items():
                if state:
                    fall = back[state]
                    while sign not in kids[fall] and fall:
                        fall = back[fall]
                    back[child] = kids[fall].get(sign, 0)
                below = longest[back[child]]
                if child in at:
                    self.shorter[at[child]] = below
                    longest[child] = at[child]
                else:
                    longest[child] = below
                queue.append(child)
        self.back[:], self.longest[:] = back, longest
        self._lay_out(kids)

    def _number_signs(self, kids: list[dict[str, int]], alike: Mapping[str, str]) -> None:
        """Classes of signs from 1 on, the frequent ones first, so that a state's children lie close together."""
        often: dict[str, int] = {}
        for own in kids:
            for sign in own:
                often[sign] = often.get(sign, 0) + 1
        self.classes = {s: i for i, s in enumerate(sorted(often, key=lambda s: (-often[s], s)), 1)}
        self.class_of = np.zeros(0x110000, np.int32)
        for sign, i in self.classes.items():
            self.class_of[ord(sign)] = i
            if sign in alike:
                self.class_of[ord(alike[sign])] = i

    def _lay_out(self, kids: list[dict[str, int]]) -> None:
        """The children of each state as a stretch of one array, from its first to its last class."""
        self.first = np.zeros(len(kids), np.int32)
        self.size = np.zeros(len(kids), np.int32)
        self.place = np.zeros(len(kids), np.int64)
        at = 0
        stretches = []
        for state, own in enumerate(kids):
            if own:
                classes = [self.classes[s] for s in own]
                low, high = min(classes), max(classes)
                stretch = np.full(high - low + 1, -1, np.int32)
                stretch[np.array(classes) - low] = list(own.values())
                self.first[state], self.size[state], self.place[state] = low, len(stretch), at
                at += len(stretch)
                stretches.append(stretch)
        self.children = np.concatenate([*stretches, np.full(1, -1, np.int32)])

    def step(self, states: np.ndarray, classes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(states), np.int32)
        todo, now = np.arange(len(states)), states
        while len(todo):
            at = classes[todo] - self.first[now]
            inside = (at >= 0) & (at < self.size[now])
            child = self.children[np.where(inside, self.place[now] + at, -1)]
            found = child >= 0
            out[todo[found]] = child[found]
            more = ~found & (now > 0)
            todo, now = todo[more], self.back[now[more]]
        return out


class Lattice:
    """``weight(p, t)`` weighs token t behind token p (-1: at the start) and is asked once per pair; ``alone`` has the weight of t itself if
    no pairs matter. A sign without a token of its own weighs ``unknown``; no path weighs less than ``least``. Signs of ``alike`` can also be read as others."""

    def __init__(
        self,
        tokens: Mapping[str, int],
        weight: Callable[[int, int], float] | None,
        alone: np.ndarray | None = None,
        unknown: float = NEVER,
        least: float = 0.0,
        alike: Mapping[str, str] | None = None,
    ):
        alike = alike or {}
        self.machine = Automaton(tokens, alike)
        self.weight, self.alone, self.unknown, self.least = weight, alone, unknown, least
        self.has_token = np.zeros(len(self.machine.classes) + 1, bool)
        for sign, i in self.machine.classes.items():
            self.has_token[i] = sign in tokens
        self.base = len(self.machine.length) + 1
        self._forget()

    def _forget(self) -> None:
        self.keys, self.values = np.full(1, np.iinfo(np.int64).max), np.zeros(1)

    def _weights(self, p: np.ndarray, t: np.ndarray) -> np.ndarray:
        if self.weight is None:
            return self.alone[t]
        asked = (p.astype(np.int64) + 1) * self.base + t
        at = np.searchsorted(self.keys, asked)
        new = self.keys[at] != asked
        if new.any():
            fresh = np.unique(asked[new])
            if len(self.keys) + len(fresh) > PAIRS:
                self._forget()
                fresh = np.unique(asked)
            known = np.array([self.weight(int(k // self.base) - 1, int(k % self.base)) for k in fresh.tolist()], np.float64)
            where = np.searchsorted(self.keys, fresh)
            self.keys, self.values = np.insert(self.keys, where, fresh), np.insert(self.values, where, known)
            at = np.searchsorted(self.keys, asked)
        return self.values[at]

    def paths(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the tokens on the least path of every word one after another, and where each word's end; ``UNKNOWN`` for signs without a token."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        classes = self.machine.class_of[np.frombuffer("".join([words[i] for i in order.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")]
        start = np.cumsum(sizes) - sizes
        base = start + np.arange(len(words))  # a word has one more position than signs
        cost, last, came = np.zeros(len(classes) + len(words)), np.full(len(classes) + len(words), -1, np.int32), np.zeros(len(classes) + len(words), np.int32)
        states = np.zeros(len(words), np.int32)
        machine = self.machine
        for j in range(1, int(sizes[0]) + 1):
            n = int(np.searchsorted(-sizes, -j, side="right"))  # words that are long enough
            sign = classes[start[:n] + (j - 1)]
            states = machine.step(states[:n], sign)
            best, arc, source = np.full(n, NEVER), np.full(n, UNKNOWN, np.int32), np.full(n, j - 1, np.int32)
            token = machine.longest[states]
            todo = np.flatnonzero(token >= 0)
            token = token[todo]
            while len(todo):
                i = j - machine.length[token]
                at = base[todo] + i
                c = cost[at] + self._weights(last[at], token)
                less = c < best[todo]
                hit = todo[less]
                best[hit], arc[hit], source[hit] = c[less], token[less], i[less]
                token = machine.shorter[token]
                more = (token >= 0) & (best[todo] > self.least)
                todo, token = todo[more], token[more]
            here = base[:n] + j
            skipped = cost[here - 1] + self.unknown
            lost = ~self.has_token[sign] & (skipped < best)
            best[lost], arc[lost], source[lost] = skipped[lost], UNKNOWN, j - 1
            cost[here], last[here], came[here] = best, arc, source
        return self._followed_back(base, sizes, order, last, came)

    def _followed_back(self, base: np.ndarray, sizes: np.ndarray, order: np.ndarray, last: np.ndarray, came: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rounds = []
        todo = np.flatnonzero(sizes)
        at = sizes[todo]
        while len(todo):
            here = base[todo] + at
            rounds.append((todo, last[here]))
            at = came[here].astype(np.int64)
            more = at > 0
            todo, at = todo[more], at[more]
        counts = np.zeros(len(sizes), np.int64)
        for own, _ in rounds:
            counts[order[own]] += 1
        ends = np.cumsum(counts)
        ids = np.empty(int(ends[-1]), np.int32)
        for back, (own, token) in enumerate(rounds, 1):
            ids[ends[order[own]] - back] = token
        return ids, ends


def as_bytes(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The ids of every word as little-endian 32-bit numbers."""
    data, at = ids.astype("<i4").tobytes(), 0
    out = []
    for end in (ends * 4).tolist():
        out.append(data[at:end])
        at = end
    return out
