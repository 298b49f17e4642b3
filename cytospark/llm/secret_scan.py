"""Secrets by a combined deterministic automaton.

Rules are regular expressions over bytes. Their parse trees become one nondeterministic automaton,
subset construction makes it deterministic, partition refinement makes it minimal, and its
transitions are one flat array: a text is read once, a byte a step, for all rules at a time. Only
where a rule has been seen are its spans then placed, by that rule's own two automata: one read
backwards marks each position where a match starts, one read forwards finds the longest end.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words


class Rule(NamedTuple):
    kind: str
    pattern: str  #: what a match is, leftmost and longest
    least: int = 1  #: shorter values are dropped
    lead: str = ""  #: the value starts after this
    seen: str = ""  #: what the first pass looks for: every match that is kept holds one


#: The base rules, then publicly documented key formats.
RULES = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20, seen=r"AKIA"),
    Rule("hex", r"[0-9a-f]+", 24, seen=r"[0-9a-f]{24,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]+", 24, seen=r"gh[oprsu]_"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 15, seen=r"xox[abprs]-"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 24, seen=r"[rs]k_live_"),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39, seen=r"AIza"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 24, seen=r"eyJ[A-Za-z0-9_-]+\.eyJ"),
]
BASE = ("assign", "access", "hex")


class Automaton(NamedTuple):
    step: list[int]  #: 256 a state, the next state times 256
    accepts: list[int]  #: rules, as bits, by state
    first_accepting: int  #: states from here (times 256) accept
    dead: int  #: the state from which no match comes, or -1


_TOKEN = re.compile(r"\\x[0-9a-fA-F]{2}|\\.|\(\?i:|\(\?:|\{\d+,?\d*\}|.", re.S)
_EVERY = frozenset(range(256))


def tree_of(pattern: str):
    """A rule's pattern as a tree: ("bytes", set), ("all", parts in turn), ("any", parts), ("repeat", part, least, most).

    Patterns are ASCII: literals, \\xHH and escaped signs, classes, dots, groups (also (?i:..) and (?:..)), |, *, +, ? and {..}.
    """
    tokens, at = _TOKEN.findall(pattern), 0

    def code(t: str) -> int:
        if t.startswith("\\x"):
            return int(t[2:], 16)
        if len(t) > 2 or t[-1].isalnum() and t[0] == "\\" or ord(t[-1]) > 127:
            raise ValueError(f"{t} isn't for an automaton")
        return ord(t[-1])

    def folded(found: set[int], fold: bool) -> frozenset[int]:
        return frozenset(found | {x ^ 32 for x in found if chr(x).isalpha()} if fold else found)

    def one_of(fold: bool):
        nonlocal at
        negated, found = tokens[at] == "^", set()
        at += negated
        while tokens[at] != "]":
            lo = hi = code(tokens[at])
            if tokens[at + 1] == "-" and tokens[at + 2] != "]":
                hi = code(tokens[at + 2])
                at += 2
            found.update(range(lo, hi + 1))
            at += 1
        at += 1
        found = folded(found, fold)
        return ("bytes", _EVERY - found if negated else found)

    def either(fold: bool):
        nonlocal at
        parts = [in_turn(fold)]
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            parts.append(in_turn(fold))
        return parts[0] if len(parts) == 1 else ("any", parts)

    def in_turn(fold: bool):
        nonlocal at
        parts = []
        while at < len(tokens) and tokens[at] not in ("|", ")"):
            t = tokens[at]
            at += 1
            if t in ("(", "(?i:", "(?:"):
                part = either(fold or t == "(?i:")
                at += 1
            elif t == "[":
                part = one_of(fold)
            else:
                part = ("bytes", _EVERY - {10} if t == "." else folded({code(t)}, fold))
            if at < len(tokens) and (tokens[at] in "*+?" or len(tokens[at]) > 2 and tokens[at][0] == "{"):
                lo, _, hi = tokens[at][1:-1].partition(",") if tokens[at][0] == "{" else {"*": ("0", ",", ""), "+": ("1", ",", ""), "?": ("0", ",", "1")}[tokens[at]]
                part = ("repeat", part, int(lo), int(hi) if hi else None if "," in tokens[at] or tokens[at] in "*+" else int(lo))
                at += 1
            parts.append(part)
        return ("all", parts)

    out = either(False)
    if at < len(tokens):
        raise ValueError(f"unbalanced: {pattern}")
    return out


class _Nfa:
    def __init__(self):
        self.empty: list[list[int]] = []
        self.edges: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.empty.append([])
        self.edges.append([])
        return len(self.empty) - 1

    def add(self, tree, at: int, backwards: bool) -> int:
        """The state after ``tree`` from state ``at``."""
        kind, value = tree[:2]
        if kind == "bytes":
            to = self.state()
            self.edges[at].append((value, to))
            return to
        if kind == "all":
            for part in reversed(value) if backwards else value:
                at = self.add(part, at, backwards)
            return at
        if kind == "any":
            out = self.state()
            for part in value:
                self.empty[self.add(part, at, backwards)].append(out)
            return out
        least, most = tree[2:]
        for _ in range(least):
            at = self.add(value, at, backwards)
        out = self.state()
        self.empty[at].append(out)
        if most is None:
            self.empty[self.add(value, out, backwards)].append(out)
            return out
        for _ in range(most - least):
            at = self.add(value, at, backwards)
            self.empty[at].append(out)
        return out


def compiled(patterns: list[str], anywhere: bool, backwards: bool = False) -> Automaton:
    """The minimal automaton of all patterns; anywhere: a match may start at any byte."""
    nfa = _Nfa()
    start = nfa.state()
    ends = {nfa.add(tree_of(p), start, backwards): 1 << k for k, p in enumerate(patterns)}
    if anywhere:
        nfa.edges[start].append((frozenset(range(256)), start))

    def closed(states) -> frozenset[int]:
        out, todo = set(states), list(states)
        while todo:
            for t in nfa.empty[todo.pop()]:
                if t not in out:
                    out.add(t)
                    todo.append(t)
        return frozenset(out)

    # Bytes that every edge treats alike are one class.
    masks = {by for edges in nfa.edges for by, _ in edges}
    like: dict[tuple, int] = {}
    kind = [like.setdefault(tuple(b in m for m in masks), len(like)) for b in range(256)]
    sample = [kind.index(k) for k in range(len(like))]
    states, order, table = {}, [], []
    states[closed([start])] = 0
    order.append(closed([start]))
    while len(table) < len(order):
        now, row = order[len(table)], []
        for b in sample:
            to = closed([t for s in now for by, t in nfa.edges[s] if b in by])
            if to not in states:
                states[to] = len(order)
                order.append(to)
            row.append(states[to])
        table.append(row)
    step = np.array(table)
    accepts = np.array([sum({ends[s] for s in x if s in ends}) for x in order])
    part = np.unique(accepts, return_inverse=True)[1]
    while True:  # partition refinement
        new = np.unique(np.column_stack([part, part[step]]), axis=0, return_inverse=True)[1].ravel()
        if new.max() == part.max():
            break
        part = new
    one = np.unique(part, return_index=True)[1]
    start_part = part[0]
    rank = np.lexsort((one, np.arange(len(one)) != start_part, accepts[one] != 0))  # the start first, accepting states last
    place = np.empty(len(one), np.int64)
    place[rank] = np.arange(len(one))
    small = place[part[step[one[rank]]]][:, kind]
    accepts = accepts[one[rank]]
    stuck = np.flatnonzero((small == np.arange(len(small))[:, None]).all(1) & (accepts == 0))
    return Automaton((small * 256).ravel().tolist(), accepts.tolist(), int((accepts == 0).sum()) * 256, int(stuck[0]) * 256 if len(stuck) else -1)


class Scanner:
    def __init__(self, rules: list[Rule] = RULES):
        self.rules = rules
        self.all = compiled([r.seen or r.pattern for r in rules], anywhere=True)
        self.starts = [compiled([r.pattern], anywhere=True, backwards=True) for r in rules]
        self.ends = [compiled([r.pattern], anywhere=False) for r in rules]
        self.leads = [compiled([r.lead], anywhere=False) if r.lead else None for r in rules]

    def seen(self, data: bytes) -> int:
        """Rules with a match in data, as bits: the one pass over all bytes."""
        step, first, s, hit = self.all.step, self.all.first_accepting, 0, set()
        for b in data:
            s = step[s + b]
            if s >= first:
                hit.add(s)
        out = 0
        for s in hit:
            out |= self.all.accepts[s >> 8]
        return out

    @staticmethod
    def longest(a: Automaton, data: bytes, at: int) -> int:
        """The end of the longest match that starts at ``at``."""
        step, first, dead, s, end = a.step, a.first_accepting, a.dead, 0, at
        for i in range(at, len(data)):
            s = step[s + data[i]]
            if s == dead:
                break
            if s >= first:
                end = i + 1
        return end

    def spans(self, k: int, data: bytes) -> list[tuple[int, int]]:
        """Rule k's matches, leftmost, longest, apart, with values of the least length."""
        rule, back = self.rules[k], self.starts[k]
        step, first, s, begins = back.step, back.first_accepting, 0, []
        for i in range(len(data) - 1, -1, -1):
            s = step[s + data[i]]
            if s >= first:
                begins.append(i)
        out, done = [], 0
        for at in reversed(begins):
            if at < done:
                continue
            done = self.longest(self.ends[k], data, at)
            value = self.longest(self.leads[k], data, at) if self.leads[k] else at
            if done - value >= rule.least:
                out.append((at, done))
        return out


_scanner: list[Scanner] = []


def scanned(texts: pa.Array, scanner: Scanner) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, rule, end) in code points, in order."""
    out = []
    for _, _, data, off in words.slabs(texts):
        raw = data.tobytes()
        for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
            part, found = raw[a:b], []
            bits = scanner.seen(part)
            if bits:
                cp = words.code_points(data[a:b])
                found = sorted((int(cp[s]), k, int(cp[e])) for k in range(len(scanner.rules)) if bits >> k & 1 for s, e in scanner.spans(k, part))
            out.append(found)
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """A row for each row of docs: numbers of base spans by kind, their digest, and all spans.

    Null and empty texts have no spans (their digest is that of the empty string); a null or
    repeated doc_id is passed through; other columns are left out.
    """

    def run(batches):
        if not _scanner:
            _scanner.append(Scanner())  # once a worker
        rules = _scanner[0].rules
        for b in batches:
            rows = scanned(b.column(1), _scanner[0])
            own = [[x for x in r if rules[x[1]].kind in BASE] for r in rows]
            text = lambda spans: ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in spans)
            n = [pa.array([sum(rules[x[1]].kind == kind for x in r) for r in own], pa.int64()) for kind in BASE]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *n, pa.array([hashlib.sha256(text(r).encode()).hexdigest() for r in own], pa.string()), pa.array([text(r) for r in rows], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
