"""Deterministic automata: rule patterns to transition arrays that find all rules' matches in one pass over bytes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Rule:
    """A kind of match: pattern, and how long the match (or its repeated end, ``tail``) must be to count.

    Patterns are made of ASCII characters, ``\\xHH`` and escaped characters, ``[...]`` of characters and ranges,
    groups ``(...)`` and ``(?i:...)``, ``|``, ``?``, ``*``, ``+``, ``{m}``, ``{m,}``, ``{m,n}``.
    """

    kind: str
    pattern: str
    least: int = 0
    tail: bool = False


def _parse(pattern: str):
    """Nested tuples: ("set", bytes), ("seq", parts), ("alt", parts), ("rep", part, least, most or None)."""
    at = 0

    def char() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
        return ord(c)

    def atom(fold: bool):
        nonlocal at
        if pattern.startswith("(", at):
            own = pattern.startswith("(?i:", at)
            at += 4 if own else 1
            inner = choice(fold or own)
            at += 1
            return inner
        found = set()
        if pattern.startswith("[", at):
            at += 1
            while pattern[at] != "]":
                low = high = char()
                if pattern[at] == "-" and pattern[at + 1] != "]":
                    at += 1
                    high = char()
                found.update(range(low, high + 1))
            at += 1
        else:
            found.add(char())
        if fold:
            found |= {ord(chr(b).swapcase()) for b in found if chr(b).isalpha()}
        return ("set", frozenset(found))

    def piece(fold: bool):
        nonlocal at
        part = atom(fold)
        while at < len(pattern) and pattern[at] in "?*+{":
            c = pattern[at]
            at += 1
            if c == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at:end].partition(",")
                at = end + 1
                part = ("rep", part, int(low), int(high) if high else None if comma else int(low))
            else:
                part = ("rep", part, int(c == "+"), 1 if c == "?" else None)
        return part

    def choice(fold: bool):
        nonlocal at
        branches, parts = [], []
        while at < len(pattern) and pattern[at] != ")":
            if pattern[at] == "|":
                at += 1
                branches.append(("seq", tuple(parts)))
                parts = []
            else:
                parts.append(piece(fold))
        branches.append(("seq", tuple(parts)))
        return ("alt", tuple(branches)) if len(branches) > 1 else branches[0]

    return choice(False)


def _reversed(tree):
    if tree[0] == "seq":
        return ("seq", tuple(_reversed(p) for p in reversed(tree[1])))
    if tree[0] == "alt":
        return ("alt", tuple(_reversed(p) for p in tree[1]))
    return ("rep", _reversed(tree[1]), *tree[2:]) if tree[0] == "rep" else tree


class Anchored:
    """Deterministic automaton of a pattern from its first character: ``step[state][byte]``, ``accepts[state]``."""

    def __init__(self, tree):
        free: list[list[int]] = []  # steps without a character
        edges: list[tuple[frozenset, int] | None] = []

        def state() -> int:
            free.append([])
            edges.append(None)
            return len(free) - 1

        def build(node, start: int) -> int:
            if node[0] == "set":
                end = state()
                edges[start] = (node[1], end)
                out = state()
                free[end].append(out)
                return out
            if node[0] == "seq":
                for part in node[1]:
                    start = build(part, start)
                return start
            out = state()
            if node[0] == "alt":
                for part in node[1]:
                    begin = state()
                    free[start].append(begin)
                    free[build(part, begin)].append(out)
                return out
            _, part, least, most = node
            for _ in range(least):
                start = build(part, start)
            if most is None:
                loop = state()
                free[start].append(loop)
                begin = state()
                free[loop] += [begin, out]
                free[build(part, begin)].append(loop)
                return out
            for _ in range(most - least):
                free[start].append(out)
                begin = state()
                free[start].append(begin)
                start = build(part, begin)
            free[start].append(out)
            return out

        first = state()
        last = build(tree, first)

        def closure(found: set[int]) -> frozenset:
            todo = list(found)
            while todo:
                for s in free[todo.pop()]:
                    if s not in found:
                        found.add(s)
                        todo.append(s)
            return frozenset(found)

        subsets = {closure({first}): 0}
        self.step: list[dict[int, int]] = []
        todo = list(subsets)
        for subset in todo:  # grows while it is read
            reach: dict[int, set[int]] = {}
            for s in subset:
                if edges[s]:
                    for b in edges[s][0]:
                        reach.setdefault(b, set()).add(edges[s][1])
            own = {}
            for b, targets in reach.items():
                target = closure(targets)
                if target not in subsets:
                    subsets[target] = len(subsets)
                    todo.append(target)
                own[b] = subsets[target]
            self.step.append(own)
        self.accepts = [last in subset for subset in todo]


def _search_step(rule: Rule, own: Anchored, threads: tuple[int, ...], byte: int) -> tuple[int, ...]:
    """Attempts of a rule, oldest first, after another byte; an accepting attempt ends all younger ones.

    When it cannot go on, the search begins anew with this byte, so matches are leftmost and do not overlap.
    """
    if threads and own.accepts[threads[0]]:
        target = own.step[threads[0]].get(byte)
        if target is not None:
            if not own.accepts[target]:
                raise ValueError(f"rule {rule.kind}: a match may go on only with characters that keep it a match")
            return (target,)
        threads = _search_step(rule, own, (), byte)
        if threads and own.accepts[threads[0]]:
            raise ValueError(f"rule {rule.kind}: a match may not begin and end with one character")
        return threads
    moved = (own.step[t].get(byte) for t in (*threads, 0))
    alive = tuple(dict.fromkeys(t for t in moved if t is not None))
    done = [k for k, t in enumerate(alive) if own.accepts[t]]
    if done and done[0]:
        raise ValueError(f"rule {rule.kind}: a later match may end before an earlier one")
    return alive[:1] if done else alive


class Scanner:
    """All rules in one automaton: ``table[state, byte]`` and, per state, the bits of the rules being matched."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [_parse(r.pattern) for r in rules]
        forward = [Anchored(t) for t in trees]
        self.backward = [Anchored(_reversed(t)) for t in trees]
        # Bytes that no rule tells apart move together.
        kinds: dict[tuple, list[int]] = {}
        for b in range(256):
            kinds.setdefault(tuple(tuple(s.get(b) for s in own.step) for own in forward), []).append(b)
        groups = list(kinds.values())
        begin = tuple(() for _ in rules)
        states, moves = {begin: 0}, []
        todo = [begin]
        for state in todo:
            row = []
            for group in groups:
                target = tuple(_search_step(r, own, t, group[0]) for r, own, t in zip(rules, forward, state))
                if target not in states:
                    states[target] = len(states)
                    todo.append(target)
                row.append(states[target])
            moves.append(row)
        masks = [sum(1 << k for k, (own, t) in enumerate(zip(forward, s)) if t and own.accepts[t[0]]) for s in todo]
        self.states_before = len(todo)
        # Minimisation: split states of equal output until equal ones also move alike.
        part = np.unique(masks, return_inverse=True)[1]
        moves = np.array(moves)
        while True:
            finer = np.unique(np.column_stack((part, part[moves])), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == part.max():
                break
            part = finer
        self.table = np.zeros((part.max() + 1, 256), np.int32)
        self.masks = np.zeros(part.max() + 1, np.int64)
        self.masks[part] = masks
        for k, group in enumerate(groups):
            self.table[part[:, None], np.array(group)[None, :]] = part[moves[:, k]][:, None]
        self.begin = int(part[0])
        # The same as linked rows: entry 256 of a row is its mask.
        rows: list[list] = [[] for _ in self.masks]
        for row, targets, mask in zip(rows, self.table.tolist(), self.masks.tolist()):
            row.extend(rows[t] for t in targets)
            row.append(mask)
        self._row = rows[self.begin]

    def scan(self, data: bytes) -> list[tuple[int, int, int]]:
        """Matches long enough to count: (start, number of the rule, end) in bytes, in order."""
        row, mask, changes = self._row, 0, []
        for at, byte in enumerate(data):
            row = row[byte]
            if row[256] != mask:
                changes.append((at, mask, row[256]))
                mask = row[256]
        if mask:
            changes.append((len(data), mask, 0))
        found, open_, ended = [], {}, {}
        for at, before, after in changes:
            bits = before ^ after
            for k, rule in enumerate(self.rules):
                if not bits >> k & 1:
                    continue
                if after >> k & 1:
                    open_[k] = at
                    continue
                start = self._start(k, data, open_[k], ended.get(k, 0))
                ended[k] = at
                if at - (open_[k] if rule.tail else start) >= rule.least:
                    found.append((start, k, at))
        return sorted(found)

    def _start(self, k: int, data: bytes, at: int, least: int) -> int:
        """Leftmost start, from ``least`` on, of the match that is first complete with byte ``at``."""
        own, state, start = self.backward[k], 0, at
        for place in range(at, least - 1, -1):
            state = own.step[state].get(data[place])
            if state is None:
                break
            if own.accepts[state]:
                start = place
        return start
