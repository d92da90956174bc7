"""One deterministic automaton for many patterns, run over many chunks at once.

Patterns are determinized together by subset construction over byte classes. A buffer of texts is cut into chunks of
equal length; all chunks advance by one byte with one table lookup, so the cost of a byte is a few nanoseconds whatever
the number of patterns. Each chunk begins in the start state, which is only a guess: afterwards the beginning of each
chunk is run again from the state in which the chunk before it ended, until both runs are in the same state or the chunk
ends. So a match may be as long as the buffer and begin in any chunk; each is reported once, at its absolute place.
"""

from __future__ import annotations

import re._constants as c
import re._parser as parser

import numpy as np

CHUNK = 8192
AGAIN = 64  # bytes after which a chunk that is run again is first compared with its first run


class _Nfa:
    def __init__(self):
        self.edges: list[list[tuple[frozenset[int], int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.edges.append([])
        self.empty.append([])
        return len(self.edges) - 1

    def add(self, items, at: int, fold: bool) -> int:
        for op, arg in items:
            if op is c.LITERAL:
                at = self.step(at, self.folded({arg}, fold))
            elif op is c.NOT_LITERAL:
                at = self.step(at, frozenset(range(256)) - self.folded({arg}, fold))
            elif op is c.ANY:
                at = self.step(at, frozenset(range(256)) - {10})
            elif op is c.IN:
                at = self.step(at, self.members(arg, fold))
            elif op is c.BRANCH:
                end = self.state()
                for branch in arg[1]:
                    start = self.state()
                    self.empty[at].append(start)
                    self.empty[self.add(branch, start, fold)].append(end)
                at = end
            elif op is c.SUBPATTERN:
                at = self.add(arg[3], at, fold or bool(arg[1] & 2))
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                lo, hi, body = arg
                for _ in range(lo):
                    at = self.add(body, at, fold)
                if hi == c.MAXREPEAT:
                    loop = self.state()
                    self.empty[at].append(loop)
                    self.empty[self.add(body, loop, fold)].append(loop)
                    at = loop
                else:
                    ends = [at]
                    for _ in range(hi - lo):
                        at = self.add(body, at, fold)
                        ends.append(at)
                    end = self.state()
                    for e in ends:
                        self.empty[e].append(end)
                    at = end
            else:
                raise ValueError(f"{op} has no place in an automaton")
        return at

    def step(self, at: int, chars: frozenset[int]) -> int:
        to = self.state()
        self.edges[at].append((chars, to))
        return to

    @staticmethod
    def folded(chars: set[int], fold: bool) -> frozenset[int]:
        if fold:
            chars = chars | {ord(chr(x).swapcase()) for x in chars if x < 128 and chr(x).isalpha()}
        return frozenset(chars)

    def members(self, items, fold: bool) -> frozenset[int]:
        chars: set[int] = set()
        negated = False
        for op, arg in items:
            if op is c.NEGATE:
                negated = True
            elif op is c.LITERAL:
                chars.add(arg)
            elif op is c.RANGE:
                chars |= set(range(arg[0], arg[1] + 1))
            elif op is c.CATEGORY:
                words = {"CATEGORY_DIGIT": range(48, 58), "CATEGORY_SPACE": (9, 10, 11, 12, 13, 32), "CATEGORY_WORD": [x for x in range(128) if chr(x).isalnum() or x == 95]}
                chars |= set(words[str(arg)])
        chars = set(self.folded(chars, fold))
        return frozenset(range(256)) - chars if negated else frozenset(chars)


class Automaton:
    """Finds where any of the patterns (byte regular expressions without groups' values or lookarounds) ends."""

    def __init__(self, patterns: list[str], fold_case: bool | list[bool] = False, max_states: int = 60_000):
        nfa = _Nfa()
        start = nfa.state()
        finals: dict[int, int] = {}
        folds = fold_case if isinstance(fold_case, list) else [fold_case] * len(patterns)
        for i, (p, fold) in enumerate(zip(patterns, folds)):
            begin = nfa.state()
            nfa.empty[start].append(begin)
            finals[nfa.add(parser.parse(p.encode("utf-8")) if isinstance(p, str) else parser.parse(p), begin, fold)] = i
        self.patterns = patterns

        cuts: dict[tuple, int] = {}
        member = [[] for _ in range(256)]
        sets = {chars for e in nfa.edges for chars, _ in e}
        for k, chars in enumerate(sets):
            for x in chars:
                member[x].append(k)
        self.classes = np.array([cuts.setdefault(tuple(m), len(cuts)) for m in member], np.uint8)
        sample = [int(np.flatnonzero(self.classes == k)[0]) for k in range(len(cuts))]

        def closure(state: int) -> frozenset[int]:
            todo, seen = [state], {state}
            while todo:
                for t in nfa.empty[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            return frozenset(s for s in seen if nfa.edges[s] or s in finals)

        closed = [closure(s) for s in range(len(nfa.edges))]
        class_sets = {chars: frozenset(int(self.classes[x]) for x in chars) for chars in sets}
        base = closed[start]
        # where each state can go by each class
        moves = [[(k, closed[t]) for chars, t in e for k in class_sets[chars]] for e in nfa.edges]
        home: list[frozenset[int]] = [base] * len(sample)
        for s in base:
            for k, to in moves[s]:
                home[k] = home[k] | to
        known, order, table, accept = {base: 0}, [base], [], []
        for states in order:
            row = list(home)
            for s in states - base:
                for k, to in moves[s]:
                    row[k] = row[k] | to
            numbers = []
            for to in row:
                if to not in known:
                    known[to] = len(order)
                    order.append(to)
                    if len(order) > max_states:
                        raise ValueError("the automaton has too many states")
                numbers.append(known[to])
            table.append(numbers)
            accept.append([finals[s] for s in states if s in finals])
        self.accepts = accept
        self.width = len(cuts)
        # states are numbered so that accepting ones come last: one comparison finds them
        rank = sorted(range(len(order)), key=lambda s: bool(accept[s]))
        place = {s: i for i, s in enumerate(rank)}
        self.first_accepting = sum(1 for a in accept if not a) * self.width
        self.table = np.array([[place[t] for t in table[s]] for s in rank], np.int32).ravel() * self.width
        self.accepts = [accept[s] for s in rank]
        self.start = place[0] * self.width

    def ends(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, states): each position after which some pattern ends, once, ascending."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        chunk = min(CHUNK, max(4 * AGAIN, n // 512))
        lanes = -(-n // chunk)
        padded = np.full(lanes * chunk, self.classes[0], np.uint8)
        padded[:n] = self.classes[data]
        columns = np.ascontiguousarray(padded.reshape(lanes, chunk).T)
        every = np.arange(lanes)
        begun = np.full(lanes, self.start, np.int32)
        early, where, which = self.advance(columns, every, begun, 0, AGAIN)
        ended, *more = self.advance(columns, every, early, AGAIN, chunk)
        where, which = np.concatenate([where, more[0]]), np.concatenate([which, more[1]])
        while True:
            entered = np.concatenate([begun[:1], ended[:-1]])
            wrong = np.flatnonzero(entered != begun)
            if not len(wrong):
                break
            begun[wrong] = entered[wrong]
            state, w1, s1 = self.advance(columns, wrong, entered[wrong], 0, AGAIN)
            far = state != early[wrong]
            early[wrong] = state
            until = np.zeros(lanes, np.int64)  # what the earlier run of a chunk found before this is replaced
            until[wrong] = np.where(far, chunk, AGAIN)
            ended[wrong[far]], w2, s2 = self.advance(columns, wrong[far], state[far], AGAIN, chunk)
            kept = where % chunk >= until[where // chunk]
            where, which = np.concatenate([where[kept], w1, w2]), np.concatenate([which[kept], s1, s2])
        inside = where < n
        where, which = where[inside], which[inside]
        order = np.argsort(where, kind="stable")
        return where[order], which[order]

    def advance(self, columns: np.ndarray, lanes: np.ndarray, state: np.ndarray, start: int, stop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The states of some chunks after their bytes start..stop, and the positions and states at which patterns ended."""
        chunk, whole = len(columns), len(lanes) == columns.shape[1]
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if len(lanes):
            for t in range(start, stop):
                state = self.table[state + (columns[t] if whole else columns[t, lanes])]
                hit = state >= self.first_accepting
                if hit.any():
                    at = np.flatnonzero(hit)
                    where.append(lanes[at] * chunk + t)
                    which.append(state[at] // self.width)
        return state, np.concatenate(where), np.concatenate(which)
