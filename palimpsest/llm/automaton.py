"""Deterministic automata over bytes, scanned in many lanes at once with numpy.

Grammars in a small pattern language are combined into one automaton by the
subset construction. Text is cut into overlapping chunks; each chunk is a lane, and all
lanes take a step per column, so the Python loop is over a chunk's length and
not over the text's. A lane that is still inside a pattern behind its overlap goes on until the next lane
has come to the same state, so that no pattern is lost however long it is. From each end the automaton of the reversed
grammars leads back to the start.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ESCAPES = {"n": {10}, "t": {9}, "r": {13}, "s": {9, 10, 11, 12, 13, 32}, "d": set(range(48, 58)), "w": set(range(48, 58)) | set(range(65, 91)) | set(range(97, 123)) | {95}}
_ALL = frozenset(range(256))


class _Builder:
    """Thompson's construction for literals, classes, groups, |, *, +, ? and {m} or {m,n}."""

    def __init__(self):
        self.step: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def new(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def parse(self, pattern: str, fold: bool) -> tuple[int, int]:
        self.p, self.i, self.fold = pattern, 0, fold
        out = self._either()
        if self.i != len(pattern):
            raise ValueError(f"unexpected {pattern[self.i]!r} at {self.i}")
        return out

    def _either(self) -> tuple[int, int]:
        parts = [self._sequence()]
        while self.i < len(self.p) and self.p[self.i] == "|":
            self.i += 1
            parts.append(self._sequence())
        if len(parts) == 1:
            return parts[0]
        a, z = self.new(), self.new()
        for s, e in parts:
            self.free[a].append(s)
            self.free[e].append(z)
        return a, z

    def _sequence(self) -> tuple[int, int]:
        a = z = self.new()
        while self.i < len(self.p) and self.p[self.i] not in "|)":
            begin = self.i
            s, e = self._atom()
            low, high, end = self._repeat()
            for n in range(max(low, 0 if high is None else high, 1)):
                if n:  # another copy
                    self.i = begin
                    s, e = self._atom()
                if n >= low:
                    self.free[z].append(self._join(s, e, z))
                    z = self._after
                else:
                    self.free[z].append(s)
                    z = e
            if high is None:
                loop, out = self.new(), self.new()
                self.i = begin
                s, e = self._atom()
                self.free[z].append(loop)
                self.free[loop] += [s, out]
                self.free[e].append(loop)
                z = out
            self.i = end
        return a, z

    def _join(self, s: int, e: int, z: int) -> int:
        out = self.new()
        self.free[e].append(out)
        self.free[z].append(out)
        self._after = out
        return s

    def _repeat(self) -> tuple[int, int | None, int]:
        c = self.p[self.i] if self.i < len(self.p) else ""
        if c == "*":
            self.i += 1
            return 0, None, self.i
        if c == "+":
            self.i += 1
            return 1, None, self.i
        if c == "?":
            self.i += 1
            return 0, 1, self.i
        if c == "{":
            end = self.p.index("}", self.i)
            low, _, high = self.p[self.i + 1 : end].partition(",")
            many = "," in self.p[self.i : end]
            self.i = end + 1
            return int(low), (int(high) if high else None) if many else int(low), self.i
        return 1, 1, self.i

    def _atom(self) -> tuple[int, int]:
        c = self.p[self.i]
        if c == "(":
            self.i += 1
            out = self._either()
            self.i += 1
            return out
        s, e = self.new(), self.new()
        self.step[s].append((self._class(), e))
        return s, e

    def _class(self) -> frozenset:
        c = self.p[self.i]
        self.i += 1
        if c == ".":
            return _ALL - {10}
        if c == "\\":
            out = self._escape()
        elif c == "[":
            no = self.p[self.i] == "^"
            self.i += no
            out, first = set(), True
            while first or self.p[self.i] != "]":
                first = False
                if self.p[self.i] == "\\":
                    self.i += 1
                    out |= self._escape()
                    continue
                a = ord(self.p[self.i])
                self.i += 1
                if self.p[self.i] == "-" and self.p[self.i + 1] != "]":
                    out |= set(range(a, ord(self.p[self.i + 1]) + 1))
                    self.i += 2
                else:
                    out.add(a)
            self.i += 1
            if no:
                return frozenset(_ALL - self._folded(out))
        else:
            out = {ord(c)}
        return frozenset(self._folded(out))

    def _escape(self) -> set[int]:
        c = self.p[self.i]
        self.i += 1
        return set(_ESCAPES.get(c, {ord(c)}))

    def _folded(self, out: set[int]) -> set[int]:
        return out | {b ^ 32 for b in out if chr(b).isascii() and chr(b).isalpha()} if self.fold else out


@dataclass
class Automaton:
    """A search automaton: a step table over byte classes, and the kinds of the patterns that have just ended in each state."""

    classes: np.ndarray  # byte -> class
    table: np.ndarray  # state * classes + class -> state * classes
    accepts: np.ndarray  # state -> a bit for each kind
    width: int
    back: Automaton | None = None  # of the reversed patterns, from an end on; its state 0 is dead

    def ends(self, data: np.ndarray, chunk: int = 1024, overlap: int = 256, before: int | None = None) -> np.ndarray:
        """Absolute offsets of last bytes, in order and once each, at which a pattern ends. `before` is a byte that the data are taken to follow."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        lanes = -(-n // chunk)
        padded = np.zeros(lanes * chunk + overlap, np.uint8)
        padded[:n] = data
        cls = self.classes[padded]
        # Columns of all lanes side by side: row j holds byte j of every chunk.
        grid = np.ascontiguousarray(np.lib.stride_tricks.as_strided(cls, (chunk + overlap, lanes), (1, chunk)))
        state = np.zeros(lanes, np.int32)
        if before is not None:
            state[0] = self.table[self.classes[before]]
        found = []
        base = np.arange(lanes, dtype=np.int64) * chunk
        good = np.repeat(self.accepts != 0, self.width)
        met = state
        for j in range(chunk + overlap):
            state = self.table[state + grid[j]]
            hit = good[state]
            if hit.any():
                found.append(base[hit] + j)
            if j == overlap - 1:
                met = state
        # A lane that isn't where the next one was at the same byte goes on, and the next one with it.
        own, other, at = state[:-1], met[1:], base[1:] + overlap
        while True:
            live = (own != other) & (at < n)
            if not live.any():
                break
            own, other, at = own[live], other[live], at[live]
            c = cls[at]
            own, other = self.table[own + c], self.table[other + c]
            hit = good[own]
            if hit.any():
                found.append(at[hit])
            at = at + 1
        if not found:
            return np.zeros(0, np.int64)
        ends = np.unique(np.concatenate(found))
        return ends[ends < n]

    def spans(self, data: np.ndarray, chunk: int = 1024, overlap: int = 256, before: int | None = None) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the patterns, each once: of those that end at a byte the longest of each kind, and of those that start at one.

        The reversed automaton takes all ends a step to the left at a time until all are dead.
        """
        ends = self.ends(data, chunk, overlap, before)
        back = self.back
        best: dict[tuple[int, int], int] = {}
        state = np.full(len(ends), back.width, np.int32)  # its first state
        at, who = ends.copy(), np.arange(len(ends))
        first: dict[tuple[int, int], int] = {}
        while len(at):
            byte = np.where(at >= 0, data[np.maximum(at, 0)], before or 0)
            state = back.table[state + back.classes[byte]]
            kinds = back.accepts[state // back.width]
            for i in np.flatnonzero(kinds).tolist():
                mask, k = int(kinds[i]), 0
                while mask:
                    if mask & 1:
                        first[int(ends[who[i]]), k] = int(at[i])  # later ones lie further left
                    mask >>= 1
                    k += 1
            live = (state != 0) & (at > (0 if before is None else -1))
            at, state, who = at[live] - 1, state[live], who[live]
        for (end, k), start in first.items():
            best[start, k] = max(end + 1, best.get((start, k), 0))
        return sorted((start, end, k) for (start, k), end in best.items())


def compile_search(patterns: list[tuple], limit: int = 60_000) -> Automaton:
    """One automaton that finds every end of any of the (pattern, ignore case[, kind]) given, and their starts."""
    b = _Builder()
    start = b.new()
    finals: dict[int, int] = {}
    firsts: dict[int, int] = {}
    for pattern, fold, *kind in patterns:
        s, e = b.parse(pattern, fold)
        b.free[start].append(s)
        finals[e] = finals.get(e, 0) | 1 << (kind[0] if kind else 0)
        firsts[s] = finals[e]
    forward = _determine(b.step, b.free, [start], finals, True, limit)
    # The same arcs the other way round, from the ends to the starts.
    step: list[list[tuple[frozenset, int]]] = [[] for _ in b.step]
    free: list[list[int]] = [[] for _ in b.free]
    for s, edges in enumerate(b.step):
        for chars, t in edges:
            step[t].append((chars, s))
    for s, to in enumerate(b.free):
        if s != start:
            for t in to:
                free[t].append(s)
    forward.back = _determine(step, free, list(finals), firsts, False, limit)
    return forward


def _determine(step: list, free: list, starts: list[int], finals: dict[int, int], search: bool, limit: int) -> Automaton:
    """The subset construction; `search` begins anew at every byte. Without it state 0 is dead and state 1 the first."""
    # Bytes that no pattern tells apart are one class.
    signs: dict[tuple, int] = {}
    sets = sorted({c for edges in step for c, _ in edges}, key=lambda c: (len(c), sorted(c)))
    classes = np.zeros(256, np.uint8)
    for byte in range(256):
        classes[byte] = signs.setdefault(tuple(byte in c for c in sets), len(signs))
    sample = [int(np.flatnonzero(classes == k)[0]) for k in range(len(signs))]

    # Sets of states are bit masks; into[s] has what state s leads to on a byte of each class.
    reach = []
    for s in range(len(free)):
        seen, todo = {s}, [s]
        while todo:
            for t in free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach.append(sum(1 << t for t in seen))
    into: list[list[tuple[int, int]]] = []
    for edges in step:
        by: dict[int, int] = {}
        for chars, t in edges:
            for k, byte in enumerate(sample):
                if byte in chars:
                    by[k] = by.get(k, 0) | reach[t]
        into.append(list(by.items()))
    busy = sum(1 << s for s, x in enumerate(into) if x)
    first = 0
    for s in starts:
        first |= reach[s]
    queue = [first] if search else [0, first]
    number, rows = {m: i for i, m in enumerate(queue)}, []
    for states in queue:
        then = [first if search else 0] * len(sample)
        live = states & busy
        while live:
            low = live & -live
            live ^= low
            for k, mask in into[low.bit_length() - 1]:
                then[k] |= mask
        for mask in then:
            if mask not in number:
                number[mask] = len(number)
                queue.append(mask)
                if len(number) > limit:
                    raise ValueError("the automaton is too large")
        rows.append([number[mask] for mask in then])
    width = len(sample)
    bits = [(1 << s, k) for s, k in finals.items()]
    accepts = np.array([_union(states, bits) for states in queue], np.int64)
    return Automaton(classes, (np.array(rows, np.int32) * width).ravel(), accepts, width)


def _union(states: int, bits: list[tuple[int, int]]) -> int:
    out = 0
    for b, kinds in bits:
        if states & b:
            out |= kinds
    return out
