"""Deterministic byte automata from regular expressions: Thompson construction,
subset construction over byte classes, and minimisation by partition
refinement, into transition arrays."""

from __future__ import annotations

import re._parser as sre

import numpy as np

MAX_STATES = 5_000


class _Nfa:
    """States with empty moves and one optional (byte set, target) move."""

    def __init__(self):
        self.empty: list[list[int]] = []
        self.move: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.empty.append([])
        self.move.append(None)
        return len(self.empty) - 1

    def add(self, items, flags: int, at: int) -> int:
        """Append the parsed ``items`` after state ``at``; returns the last state."""
        for op, arg in items:
            name = str(op)
            if name in ("LITERAL", "NOT_LITERAL", "IN", "ANY"):
                to = self.state()
                self.move[at] = (_bytes(name, arg, flags), to)
                at = to
            elif name == "SUBPATTERN":
                _, on, off, inner = arg
                at = self.add(inner, (flags | on) & ~off, at)
            elif name == "BRANCH":
                end = self.state()
                for option in arg[1]:
                    first = self.state()
                    self.empty[at].append(first)
                    self.empty[self.add(option, flags, first)].append(end)
                at = end
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                for _ in range(low):
                    at = self.add(inner, flags, at)
                if high is sre.MAXREPEAT:
                    first, end = self.state(), self.state()
                    self.empty[at] += [first, end]
                    self.empty[self.add(inner, flags, first)] += [first, end]
                    at = end
                else:
                    end = self.state()
                    for _ in range(high - low):
                        first = self.state()
                        self.empty[at] += [first, end]
                        at = self.add(inner, flags, first)
                    self.empty[at].append(end)
                    at = end
            else:
                raise ValueError(f"rule syntax not supported: {name}")
            if self.move[at] is not None or self.empty[at]:
                to = self.state()
                self.empty[at].append(to)
                at = to
        return at

    def close(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.empty[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def _bytes(name: str, arg, flags: int) -> frozenset[int]:
    if name == "ANY":
        return frozenset(range(256)) - {10}
    if name in ("LITERAL", "NOT_LITERAL"):
        found, negate = {arg}, name == "NOT_LITERAL"
    else:
        found, negate = set(), False
        for op, x in arg:
            kind = str(op)
            if kind == "NEGATE":
                negate = True
            elif kind == "LITERAL":
                found.add(x)
            elif kind == "RANGE":
                found |= set(range(x[0], x[1] + 1))
            else:
                raise ValueError(f"class syntax not supported: {kind}")
    if flags & sre.SRE_FLAG_IGNORECASE:
        found |= {b ^ 32 for b in found if 65 <= (b & ~32) <= 90}
    return frozenset(range(256)) - found if negate else frozenset(found)


class Dfa:
    """``table[state, byte]`` and ``accepts[state]`` (bit i: rule i). State 0 is
    the start; in an anchored automaton state ``dead`` never accepts again.
    ``reverse``: reads backwards from the end of any prefix of a match, and
    accepts at its start."""

    def __init__(self, rules: list[bytes], anchored: bool, reverse: bool = False):
        nfa, starts, ends = _Nfa(), [], {}
        for i, rule in enumerate(rules):
            parsed = sre.parse(rule)
            first = nfa.state()
            ends[nfa.add(parsed, parsed.state.flags, first)] = i
            starts.append(first)
        if reverse:
            nfa, starts, ends = self._turned(nfa, starts, ends)
        self.table, self.accepts = self._minimised(*self._subsets(nfa, starts, ends, anchored))
        stuck = [s for s in range(len(self.table)) if not self.accepts[s] and (self.table[s] == s).all()]
        self.dead = stuck[0] if anchored and stuck else -1

    @staticmethod
    def _turned(nfa: _Nfa, starts, ends):
        back = _Nfa()
        for _ in nfa.empty:
            back.state()
        for s in range(len(nfa.empty)):
            for t in nfa.empty[s]:
                back.empty[t].append(s)
            if nfa.move[s]:
                chars, t = nfa.move[s]
                via = back.state()          # one move a state: reach it by an empty move
                back.empty[t].append(via)
                back.move[via] = (chars, s)
        return back, list(range(len(nfa.empty))), {s: i for i, s in enumerate(starts)}

    @staticmethod
    def _subsets(nfa: _Nfa, starts, ends, anchored: bool):
        sets = sorted({m[0] for m in nfa.move if m}, key=sorted)
        sign = [tuple(b in c for c in sets) for b in range(256)]
        kinds = {s: i for i, s in enumerate(dict.fromkeys(sign))}
        group = np.array([kinds[s] for s in sign])
        sample = {int(g): b for b, g in reversed(list(enumerate(group)))}
        start = nfa.close(starts)
        number, todo, rows, accepts = {start: 0}, [start], [], []
        for here in todo:                     # grows while it is read
            if len(number) > MAX_STATES:
                raise ValueError(f"the rules need over {MAX_STATES} states")
            accepts.append(sum({1 << ends[s] for s in here if s in ends}))
            row = []
            for g in range(len(kinds)):
                b = sample[g]
                to = {nfa.move[s][1] for s in here if nfa.move[s] and b in nfa.move[s][0]}
                to = nfa.close(to if anchored else to | set(starts))
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row.append(number[to])
            rows.append(row)
        return np.array(rows)[:, group], np.array(accepts)

    @staticmethod
    def _minimised(table: np.ndarray, accepts: np.ndarray):
        part = np.unique(accepts, return_inverse=True)[1]
        while True:
            sign = np.column_stack((part, part[table]))
            finer = np.unique(sign, axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        order = np.unique(finer, return_index=True)[1]
        order = np.concatenate(([0], [s for s in order if finer[s] != finer[0]])).astype(int)
        rank = np.empty(len(order), int)
        rank[finer[order]] = np.arange(len(order))
        return rank[finer[table[order]]], accepts[order]


class Matcher:
    """All rules in one byte pass; leftmost non-overlapping longest spans by rule.

    The combined automaton reads every byte once. Where it accepts, a reverse
    automaton finds the earliest start of any match that is open or complete
    there, the pass goes on to the next byte at which no match is open, and each
    rule's spans are taken inside that region.
    """

    def __init__(self, rules: list[bytes]):
        both = Dfa(rules, anchored=False)
        self.table, self.accepts = both.table.tolist(), both.accepts.tolist()
        # A row for each state; a move into an accepting state holds its number, which
        # has no items: the inner loop below stops there without a test for each byte.
        self.rows: list[list] = [[] for _ in self.table]
        for row, to in zip(self.rows, self.table, strict=True):
            row.extend(t if self.accepts[t] else self.rows[t] for t in to)
        back = Dfa(rules, anchored=True, reverse=True)
        self.back, self.back_accepts, self.back_dead = back.table.tolist(), back.accepts.tolist(), back.dead
        self.own = [Dfa([r], anchored=True) for r in rules]
        self.own_tables = [(d.table.tolist(), d.accepts.tolist(), d.dead) for d in self.own]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) byte spans, sorted."""
        found: list[tuple[int, int, int]] = []
        n, it, row, floor = len(data), iter(data), self.rows[0], 0
        while True:
            try:
                for b in it:
                    row = row[b]
                read = n
            except TypeError:
                read = n - it.__length_hint__() - 1
            if isinstance(row, list):
                return sorted(found)
            state, end = row, read
            first = self._earliest(data, end, floor)
            if read < n:                      # the byte at ``read`` was taken by the loop
                state, end = self.table[state][data[read]], read + 1
            while state and end < n:
                state = self.table[state][next(it)]
                end += 1
            for rule in range(len(self.own)):
                self._inside(data, rule, first, end, found)
            floor, row = end, self.rows[0]
            if end >= n:
                return sorted(found)

    def _earliest(self, data: bytes, end: int, floor: int) -> int:
        state, first = 0, end
        for i in range(end - 1, floor - 1, -1):
            state = self.back[state][data[i]]
            if state == self.back_dead:
                break
            if self.back_accepts[state]:
                first = i
        return first

    def _inside(self, data: bytes, rule: int, first: int, end: int, found: list) -> None:
        table, accepts, dead = self.own_tables[rule]
        at = first
        while at < end:
            state, stop = 0, -1
            for i in range(at, len(data)):
                state = table[state][data[i]]
                if state == dead:
                    break
                if accepts[state]:
                    stop = i + 1
            if stop > 0:
                found.append((at, rule, stop))
                at = stop
            else:
                at += 1
