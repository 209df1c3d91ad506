"""One minimal deterministic automaton for many rules, and its scan over bytes.

Rules are regular expressions over ASCII (literals, classes, groups,
alternatives, ``? + * {m,n}``, ``(?i:...)``). Their parse trees become one
nondeterministic automaton; subset construction and minimisation (partition
refinement) give a transition array over byte classes. Every state carries a
bit mask of the rules that accept in it.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from re import _constants as C
from re import _parser as parser

import numpy as np

LANE = 2048


@dataclass
class _Nfa:
    moves: list[list[tuple[frozenset[int], int]]] = field(default_factory=list)
    empty: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1


def _cases(codes: set[int], fold: bool) -> frozenset[int]:
    """Bytes of the codes; with ``fold``, ASCII letters in both cases."""
    if fold:
        codes = codes | {ord(f(chr(c))) for c in codes if c < 128 and chr(c).isalpha() for f in (str.upper, str.lower)}
    return frozenset(codes)


def _add(nfa: _Nfa, tree, at: int, fold: bool, backward: bool) -> int:
    """Append the parse tree behind state ``at``; returns the state after it."""
    for op, arg in reversed(list(tree)) if backward else tree:
        if op in (C.LITERAL, C.IN):
            codes = {arg} if op is C.LITERAL else set()
            for kind, value in arg if op is C.IN else ():
                codes |= set(range(value[0], value[1] + 1)) if kind is C.RANGE else {value}
            to = nfa.state()
            nfa.moves[at].append((_cases(codes, fold), to))
        elif op is C.SUBPATTERN:
            to = _add(nfa, arg[3], at, fold or bool(arg[1] & 2), backward)  # 2: the flag of (?i:...)
        elif op is C.BRANCH:
            to = nfa.state()
            for branch in arg[1]:
                nfa.empty[_add(nfa, branch, at, fold, backward)].append(to)
        elif op is C.MAX_REPEAT:
            least, most, body = arg
            to = at
            for _ in range(least):
                to = _add(nfa, body, to, fold, backward)
            if most is C.MAXREPEAT:
                loop = nfa.state()
                nfa.empty[to].append(loop)
                nfa.empty[_add(nfa, body, loop, fold, backward)].append(loop)
                to = loop
            else:
                end = nfa.state()
                for _ in range(most - least):
                    nfa.empty[to].append(end)
                    to = _add(nfa, body, to, fold, backward)
                nfa.empty[to].append(end)
                to = end
        else:
            raise ValueError(f"not supported in a rule: {op}")
        at = to
    return at


@dataclass
class Dfa:
    """``table[state * width + kind[byte]]`` is the next state; state 0 starts; ``accepts[state]`` is a mask of rules."""

    kind: np.ndarray
    width: int
    table: np.ndarray
    accepts: np.ndarray

    def longest(self, data: bytes, at: int) -> int:
        """End of the longest match from ``at``; -1 if none. For automata that are anchored."""
        table, kind, accepts, state, found = self._lists()
        for i in range(at, len(data)):
            state = table[state * self.width + kind[data[i]]]
            if state == self.dead:
                break
            if accepts[state]:
                found = i + 1
        return found

    def farthest_back(self, data: bytes, end: int, least: int) -> int:
        """Smallest start >= ``least`` of a match that ends at ``end``, read backwards; -1 if none."""
        table, kind, accepts, state, found = self._lists()
        for i in range(end - 1, least - 1, -1):
            state = table[state * self.width + kind[data[i]]]
            if state == self.dead:
                break
            if accepts[state]:
                found = i
        return found

    def _lists(self):
        if not hasattr(self, "_kept"):
            own = np.arange(len(self.accepts))
            stuck = (self.table.reshape(-1, self.width) == own[:, None]).all(axis=1) & (self.accepts == 0)
            self.dead = int(np.flatnonzero(stuck)[0]) if stuck.any() else -1
            self._kept = self.table.tolist(), self.kind.tolist(), self.accepts.tolist()
        return *self._kept, 0, -1

    def states(self, data: np.ndarray) -> np.ndarray:
        """State after every byte of ``data``.

        The bytes are dealt to lanes of ``LANE`` bytes which advance together,
        all from the start state; lanes whose true first state differs are
        run again until they meet what is there."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32)
        lanes = -(-n // LANE)
        cells = np.zeros(lanes * LANE, np.int32)
        cells[:n] = self.kind[data]
        cells = np.ascontiguousarray(cells.reshape(lanes, LANE).T)
        out = np.empty((LANE, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for t in range(LANE):
            state = self.table[state * self.width + cells[t]]
            out[t] = state
        begun = np.zeros(lanes, np.int32)
        while True:
            true = np.concatenate([[0], out[-1, :-1]])
            lane = np.flatnonzero(true != begun)
            if not len(lane):
                break
            begun[lane] = true[lane]
            state = true[lane]
            for t in range(LANE):
                state = self.table[state * self.width + cells[t, lane]]
                differs = state != out[t, lane]
                out[t, lane] = state
                lane, state = lane[differs], state[differs]
                if not len(lane):
                    break
        return out.T.reshape(-1)[:n]


def compile_rules(rules: list[str], anchored: bool = False, backward: bool = False) -> Dfa:
    """Minimal automaton of all rules; rule r accepts with bit r.

    Unless ``anchored``, a match may start at any byte. ``backward`` reads the
    rules' matches from their last byte to their first."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {_add(nfa, parser.parse(rule), start_of(nfa, start), False, backward): 1 << r for r, rule in enumerate(rules)}

    # bytes that no rule tells apart form one class
    signatures: dict[tuple, int] = {}
    sets = sorted({codes for moves in nfa.moves for codes, _ in moves}, key=sorted)
    kind = np.array([signatures.setdefault(tuple(b in s for s in sets), len(signatures)) for b in range(256)], np.int32)
    member = {k: int(np.flatnonzero(kind == k)[0]) for k in range(len(signatures))}

    def closure(states: set[int]) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for to in nfa.empty[todo.pop()]:
                if to not in out:
                    out.add(to)
                    todo.append(to)
        return frozenset(out)

    restart = frozenset() if anchored else closure({start})
    first = closure({start})
    number, rows, masks, todo = {first: 0}, [], [], [first]
    for subset in todo:
        by_byte: list[set[int]] = [set() for _ in member]
        for s in subset:
            for codes, to in nfa.moves[s]:
                for k, b in member.items():
                    if b in codes:
                        by_byte[k].add(to)
        row = []
        for targets in by_byte:
            target = closure(targets) | restart
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
        rows.append(row)
        masks.append(sum({ends[s] for s in subset if s in ends}))
    return _minimal(kind, np.array(rows, np.int32), np.array(masks, np.int64))


def start_of(nfa: _Nfa, start: int) -> int:
    own = nfa.state()
    nfa.empty[start].append(own)
    return own


def _minimal(kind: np.ndarray, rows: np.ndarray, masks: np.ndarray) -> Dfa:
    """Merge states that accept alike and move to merged states, until no class splits."""
    part = np.unique(masks, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[rows]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == part.max():
            break
        part = finer
    order = np.full(part.max() + 1, -1)
    seen = 0
    for p in part:  # number classes by first appearance, so the start state stays 0
        if order[p] < 0:
            order[p] = seen
            seen += 1
    part = order[part]
    first = np.unique(part, return_index=True)[1]
    return Dfa(kind, rows.shape[1], part[rows[first]].reshape(-1).astype(np.int32), masks[first])
