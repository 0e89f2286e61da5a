"""Rule regexes to one minimal deterministic automaton over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

EPS = None


class _Parser:
    """Regexes over bytes: literals, \\xNN and \\ escapes, [classes], (groups), |, ?, *, +, {m}, {m,}, {m,n}, and (?i:...) for a group."""

    def __init__(self, pattern: str):
        self.s, self.i, self.fold = pattern, 0, False

    def alternatives(self):
        out = [self.sequence()]
        while self.peek() == "|":
            self.i += 1
            out.append(self.sequence())
        return out[0] if len(out) == 1 else ("alt", out)

    def peek(self) -> str:
        return self.s[self.i : self.i + 1]

    def sequence(self):
        out = []
        while self.peek() not in ("", "|", ")"):
            out.append(self.repeat(self.atom()))
        return ("seq", out)

    def repeat(self, node):
        while (c := self.peek()) and c in "?*+{":
            self.i += 1
            lo, hi = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                end = self.s.index("}", self.i)
                lo, _, hi = self.s[self.i : end].partition(",")
                hi = int(hi) if hi else None if "," in self.s[self.i : end] else int(lo)
                lo, self.i = int(lo), end + 1
            node = ("rep", node, lo, hi)
        return node

    def char(self) -> int:
        c = self.s[self.i]
        self.i += 1
        if c != "\\":
            return ord(c)
        c = self.s[self.i]
        self.i += 1
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord(c)

    def atom(self):
        if self.peek() == "(":
            self.i += 1
            before = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            node = self.alternatives()
            self.fold = before
            self.i += 1
            return node
        if self.peek() != "[":
            return ("set", self.folded({self.char()}))
        self.i += 1
        found: set[int] = set()
        while self.peek() != "]":
            a = self.char()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.i += 1
                found |= set(range(a, self.char() + 1))
            else:
                found.add(a)
        self.i += 1
        return ("set", self.folded(found))

    def folded(self, chars: set[int]) -> frozenset[int]:
        return frozenset(chars | {ord(chr(c).swapcase()) for c in chars if c < 128} if self.fold else chars)


class _Nfa:
    def __init__(self):
        self.moves: list[list[tuple[frozenset[int] | None, int]]] = []

    def state(self) -> int:
        self.moves.append([])
        return len(self.moves) - 1

    def build(self, node, start: int) -> int:
        """Adds node from start; returns where it ends."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "seq":
            for x in node[1]:
                start = self.build(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1]:
                own = self.state()
                self.moves[start].append((EPS, own))
                self.moves[self.build(x, own)].append((EPS, end))
            return end
        _, inner, lo, hi = node
        for _ in range(lo):
            start = self.build(inner, start)
        if hi is None:
            loop = self.state()
            self.moves[start].append((EPS, loop))
            self.moves[self.build(inner, loop)].append((EPS, loop))
            return loop
        end = self.state()
        self.moves[start].append((EPS, end))
        for _ in range(hi - lo):
            start = self.build(inner, start)
            self.moves[start].append((EPS, end))
        return end


@dataclass(frozen=True)
class Automaton:
    """table[state * width + classes[byte]] is the next state times width; states from `accepting` on accept; rules[state - accepting] has a bit for each rule; dead (times width) is never left, -1 where there's none."""

    classes: bytes
    width: int
    table: list[int]
    start: int
    accepting: int
    rules: tuple[int, ...]
    dead: int


def compile_rules(patterns: list[str], anchored: bool = False, backward: bool = False) -> Automaton:
    """All patterns as one minimal automaton.

    Each pattern is made deterministic and minimal first; the states of the joint automaton are the reachable tuples of theirs
    (the same sets as by subset construction over all rules, without its many equal ones), which are then minimised
    together. Unanchored, a match may start at any byte. backward: it reads matches from their end to their start.
    """
    single = [_single(p, anchored, backward) for p in patterns]
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(a.classes[b] for a in single), len(kinds)) for b in range(256))
    begin = tuple(a.start for a in single)
    number, states, rows = {begin: 0}, [begin], []
    for now in states:  # grows
        row = []
        for kind in kinds:
            to = tuple(a.table[s + c] for a, s, c in zip(single, now, kind))
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
        rows.append(row)
    masks = [sum(1 << k for k, (a, s) in enumerate(zip(single, now)) if s >= a.accepting * a.width) for now in states]
    return _minimal(classes, rows, masks)


def _single(pattern: str, anchored: bool, backward: bool) -> Automaton:
    """Subset construction; sets of NFA states are integers with a bit for each state."""
    nfa = _Nfa()
    root = nfa.state()
    node = _Parser(pattern).alternatives()
    final = nfa.build(_turned(node) if backward else node, root)
    sets = {s for moves in nfa.moves for s, _ in moves if s is not EPS}
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    reach: list[int] = []
    for state in range(len(nfa.moves)):
        seen, todo = {state}, [state]
        while todo:
            for s, t in nfa.moves[todo.pop()]:
                if s is EPS and t not in seen:
                    seen.add(t)
                    todo.append(t)
        reach.append(sum(1 << t for t in seen))
    steps = [[0] * len(nfa.moves) for _ in kinds]
    for state, moves in enumerate(nfa.moves):
        for s, t in moves:
            if s is not EPS:
                for c in {classes[b] for b in s}:
                    steps[c][state] |= reach[t]
    begin = reach[root]
    number, states, rows = {begin: 0}, [begin], []
    for now in states:  # grows
        inside = [i for i in range(now.bit_length()) if now >> i & 1]
        row = []
        for step in steps:
            to = 0 if anchored else begin
            for i in inside:
                to |= step[i]
            if to not in number:
                number[to] = len(states)
                states.append(to)
            row.append(number[to])
        rows.append(row)
    return _minimal(classes, rows, [now >> final & 1 for now in states])


def _minimal(classes: bytes, rows: list[list[int]], masks: list[int]) -> Automaton:
    """States part as long as their own marks or their successors' parts differ."""
    width, moves = len(rows[0]), np.array(rows)
    _, part = np.unique(masks, return_inverse=True)
    while True:
        keys: dict[bytes, int] = {}
        new = np.array([keys.setdefault(row.tobytes(), len(keys)) for row in np.column_stack([part, part[moves]])])
        if new.max() == part.max():
            break
        part = new
    part = part.tolist()
    of = {p: s for s, p in reversed(list(enumerate(part)))}
    order = sorted(of, key=lambda p: (masks[of[p]] > 0, of[p]))
    rank = {p: i for i, p in enumerate(order)}
    table = [rank[part[t]] * width for p in order for t in rows[of[p]]]
    accepting = next((i for i, p in enumerate(order) if masks[of[p]]), len(order))
    dead = next((s * width for s in range(accepting) if set(table[s * width : (s + 1) * width]) == {s * width}), -1)
    return Automaton(classes, width, table, rank[part[0]] * width, accepting, tuple(masks[of[p]] for p in order[accepting:]), dead)


def _turned(node):
    if node[0] == "seq":
        return ("seq", [_turned(x) for x in reversed(node[1])])
    if node[0] == "alt":
        return ("alt", [_turned(x) for x in node[1]])
    return ("rep", _turned(node[1]), *node[2:]) if node[0] == "rep" else node
