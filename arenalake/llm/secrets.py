"""Secret scans with one combined deterministic automaton.

All rules' regular expressions, read backwards, become one non-deterministic automaton; subset construction makes it
deterministic, partition refinement minimises it, and the result is a transition array over byte classes.  One pass over
the bytes of all texts of a batch, from right to left, runs every rule at once and tells at each byte which rules have a
match that starts there.  The bytes are dealt to columns that advance together, one array step for their n-th bytes;
where a column should have begun in another state, it is run again until it meets its earlier states.  From the leftmost
start of each match a second automaton, the rules read forwards from a fixed start, goes on to the longest end.

A row is a document: a null or empty text has no spans, repeated rows are scanned one by one, long texts are scanned
whole, and other columns pass through (a column named like the new one is replaced).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small

BASE = ("assign", "access", "hex")
# Fixed values. kind: (expression, least length of the match, or of what follows its first : or = for assign).
# A match that is too short is dropped, and what it covers is not searched again.  Runs of hex digits are maximal, so
# their least length may stand in the expression.
RULES: dict[str, tuple[str, int]] = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 12),
    "access": (r"AKIA[A-Z0-9]+", 18),
    "hex": (r"[0-9a-f]{16,}", 16),
    "github": (r"gh[pousr]_[A-Za-z0-9]+", 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]+", 15),
    "google": (r"AIza[A-Za-z0-9_-]+", 39),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 30),
    "private_key": (r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
}
ANY_CASE = {"assign"}  #: letters of the pattern's words in either case
KINDS = tuple(RULES)
CHUNK = 4 << 20  #: bytes that are scanned together, about; a longer text stands alone
COLUMNS = 4096  #: columns that advance together at most
ROUNDS = 8  #: times that columns are run again before what is left goes byte by byte
EDGE = 256  #: stands between texts; no rule holds it


def parse(pattern: str, fold: bool) -> tuple:
    """Literals, classes, groups, alternatives and repeats -> ("set", bytes), ("cat" or "alt", parts), ("rep", part, least, most)."""
    tokens = re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|\[(?:\\.|[^\]])+\]|\{\d+,?\d*\}|.", pattern)
    at = 0

    def letter(t: str) -> int:
        return int(t[2:], 16) if t.startswith("\\x") else ord(t[-1])

    def members(t: str) -> set[int]:
        parts = re.findall(r"\\x[0-9A-Fa-f]{2}|\\.|.", t[1:-1])
        out: set[int] = set()
        while parts:
            a = letter(parts.pop(0))
            if len(parts) > 1 and parts[0] == "-":
                parts.pop(0)
                out |= set(range(a, letter(parts.pop(0)) + 1))
            else:
                out.add(a)
        return out

    def alternatives() -> tuple:
        nonlocal at
        ways = [sequence()]
        while at < len(tokens) and tokens[at] == "|":
            at += 1
            ways.append(sequence())
        return ("alt", ways) if len(ways) > 1 else ways[0]

    def sequence() -> tuple:
        nonlocal at
        parts: list[tuple] = []
        while at < len(tokens) and tokens[at] not in "|)":
            t = tokens[at]
            at += 1
            if t == "(":
                parts.append(alternatives())
                at += 1  # the closing bracket
            elif t in "?*+" or t[0] == "{" and len(t) > 1:
                bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(t)
                if bounds is None:
                    least, comma, most = t[1:-1].partition(",")
                    bounds = int(least), int(most) if most else None if comma else int(least)
                parts[-1] = ("rep", parts[-1], *bounds)
            else:
                own = members(t) if t[0] == "[" and len(t) > 1 else {letter(t)}
                if fold:
                    own |= {ord(f(chr(c))) for c in own if c < 128 for f in (str.lower, str.upper)}
                parts.append(("set", frozenset(own)))
        return ("cat", parts)

    return alternatives()


class _Nfa:
    """Thompson's construction: edges on byte sets, and empty moves."""

    def __init__(self) -> None:
        self.on: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def new(self) -> int:
        self.on.append([])
        self.free.append([])
        return len(self.on) - 1

    def add(self, node: tuple, at: int, back: bool) -> int:
        """Appends a parsed part after state ``at``, read backwards if ``back``, and gives the state behind it."""
        if node[0] == "set":
            to = self.new()
            self.on[at].append((node[1], to))
            return to
        if node[0] == "cat":
            for part in reversed(node[1]) if back else node[1]:
                at = self.add(part, at, back)
            return at
        to = self.new()
        if node[0] == "alt":
            for way in node[1]:
                self.free[self.add(way, at, back)].append(to)
            return to
        _, part, least, most = node
        for _ in range(least):
            at = self.add(part, at, back)
        if most is None:
            self.free[at].append(to)
            self.free[self.add(part, to, back)].append(to)
        else:
            for _ in range(most - least):
                self.free[at].append(to)
                at = self.add(part, at, back)
            self.free[at].append(to)
        return to


@lru_cache(maxsize=2)
def automaton(back: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class of each byte and of EDGE, transitions as state * classes + class -> state * classes, rules that end in each state).

    State 0 is the start; a state's rules are a bit set in the order of KINDS.  Backwards, a match may begin at any byte;
    forwards, all begin at the first one, and a state without moves is dead.
    """
    nfa = _Nfa()
    start = nfa.new()
    ends = {nfa.add(parse(rule[0], kind in ANY_CASE), start, back): 1 << i for i, (kind, rule) in enumerate(RULES.items())}
    if back:
        nfa.on[start].append((frozenset(range(EDGE + 1)), start))

    # bytes that no edge tells apart form a class
    edges = [s for own in nfa.on for s, _ in own]
    marks = np.array([[b in s for b in range(EDGE + 1)] for s in edges])
    _, first, classes = np.unique(marks, axis=1, return_index=True, return_inverse=True)
    classes = classes.reshape(-1).astype(np.uint8)

    def closure(states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for s in nfa.free[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return frozenset(seen)

    by_class = [[[closure([to]) for s, to in own if int(b) in s] for own in nfa.on] for b in first]
    names, rows, queue = {closure([start]): 0}, [], [closure([start])]
    for subset in queue:  # grows while it runs
        row = []
        for moves in by_class:
            to = frozenset().union(*(t for s in subset for t in moves[s]))
            if to not in names:
                names[to] = len(names)
                queue.append(to)
            row.append(names[to])
        rows.append(row)
    table = np.array(rows)
    fires = np.array([sum({ends.get(s, 0) for s in subset}) for subset in queue])

    # states with equal rules and equal successors are one state
    block = np.unique(fires, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([block, block[table]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == block.max():
            break
        block = finer
    order = np.full(block.max() + 1, -1)
    kept = []
    for s, b in enumerate(block):  # the start comes first
        if order[b] < 0:
            order[b] = len(kept)
            kept.append(s)
    n = len(by_class)
    small = (order[block[table[kept]]] * n).astype(np.int32).reshape(-1)
    return classes, small, fires[kept].astype(np.uint16)


def states(code: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The state (times classes) after each code of the one sequence ``code``, from state 0."""
    width = max(1, min(COLUMNS, len(code) // 64))
    length = -(-len(code) // width)
    padded = np.zeros(width * length, np.uint8)
    padded[: len(code)] = code
    step = np.ascontiguousarray(padded.reshape(width, length).T)
    at = np.empty((length, width), np.int32)
    s = np.zeros(width, np.int32)
    for t in range(length):
        s = table[s + step[t]]
        at[t] = s
    begun = np.zeros(width, np.int32)
    for _ in range(ROUNDS):  # columns whose first state was another one
        entry = np.append(np.int32(0), at[-1, :-1])
        columns = np.flatnonzero(entry != begun)
        if not len(columns):
            break
        begun, s = entry, entry[columns]
        for t in range(length):
            s = table[s + step[t, columns]]
            other = s != at[t, columns]
            if not other.any():
                break
            s, columns = s[other], columns[other]
            at[t, columns] = s
    flat = at.T.reshape(-1)
    ends = np.arange(length, width * length, length)
    for i in ends[flat[ends - 1] != begun[1:]].tolist():  # long runs that hold a state: byte by byte
        s, moves, codes = int(flat[i - 1]), memoryview(table), memoryview(padded)
        for j in range(i, len(flat)):
            s = moves[s + codes[j]]
            if s == flat[j]:
                break
            flat[j] = s
    return flat[: len(code)]


def starts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in ``data``, bit sets): where matches of the rules start, in the texts ``data[offsets[i]:offsets[i + 1]]``."""
    classes, table, fires = automaton(True)
    sizes = np.diff(offsets)
    edge = np.arange(len(data)) + np.repeat(np.arange(len(sizes)), sizes)  # an EDGE behind each text
    code = np.full(len(data) + len(sizes), classes[EDGE], np.uint8)
    code[edge] = classes[data]
    found = fires[states(code[::-1], table) // (int(classes.max()) + 1)][::-1][edge]
    at = np.flatnonzero(found)
    return at, found[at]


@lru_cache(maxsize=1)
def _forwards() -> tuple[bytes, list[list[int]], list[int]]:
    """(class of each byte, successor of each state by class, bit set of each state); -1 is the dead state."""
    classes, table, fires = automaton(False)
    n = int(classes.max()) + 1
    rows = (table.reshape(-1, n) // n).tolist()
    dead = [s for s, row in enumerate(rows) if set(row) == {s} and not fires[s]]
    return classes[:EDGE].tobytes(), [[-1 if to in dead else to for to in row] for row in rows], fires.tolist()


def end(raw: bytes, at: int, k: int) -> int:
    """The longest end of rule ``k``'s match that starts at ``at``."""
    classes, rows, fires = _forwards()
    state, last = 0, at
    for i in range(at, len(raw)):
        state = rows[state][classes[raw[i]]]
        if state < 0:
            break
        if fires[state] >> k & 1:
            last = i + 1
    return last


def spans(raw: bytes, places: list[int], rules: list[int]) -> list[dict]:
    """Leftmost, longest, non-overlapping spans of each rule in code points, by start and then kind.

    ``places``, in order, are where matches of ``rules`` (bit sets) start.  Other rules' spans inside a base span go.
    """
    found = []
    for k, (kind, (_, least)) in enumerate(RULES.items()):
        own = [p for p, r in zip(places, rules, strict=True) if r >> k & 1]
        i = 0
        while i < len(own):
            to = end(raw, own[i], k)
            match = raw[own[i] : to]
            if kind == "assign":
                match = re.sub(rb"""^[^:=]*[:=]\x20*["']?""", b"", match)
            if len(match) >= least:
                found.append((own[i], k, to))
            i = bisect_left(own, to, i + 1)
    kept, reach = [], -1
    for s, k, e in sorted(found, key=lambda x: (x[0], x[1] >= len(BASE), x[1])):
        if k < len(BASE):
            reach = max(reach, e)
        if k < len(BASE) or e > reach:
            kept.append((s, k, e))
    kept.sort()
    chars, place = 0, {}
    for a, b in pairwise([0, *sorted({x for s, _, e in kept for x in (s, e)})]):
        chars += len(raw[a:b].decode("utf-8", "ignore"))
        place[b] = chars
    place.setdefault(0, 0)
    return [{"kind": KINDS[k], "start": place[s], "end": place[e], "base": k < len(BASE)} for s, k, e in kept]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def scan(docs: DataFrame, text: str = "text", to: str = "secret_spans") -> DataFrame:
    """``docs`` with the spans of each text in column ``to``."""
    docs = docs.drop(to) if to != text else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(to, SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            column = whole.schema.get_field_index(text)
            for batch in small(iter([whole]), column, CHUNK):
                texts = batch.column(column).cast(pa.large_binary()).fill_null(b"")
                ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
                data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
                at, rules = starts(data, ends - ends[0]) if len(data) else (np.zeros(0, np.int64),) * 2
                cuts = np.searchsorted(at, ends - ends[0])
                found = [spans(texts[i].as_py(), (at[a:b] - (ends[i] - ends[0])).tolist(), rules[a:b].tolist()) if b > a else [] for i, (a, b) in enumerate(pairwise(cuts.tolist()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, to])

    return docs.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """The columns of op10: counts and digest of the base spans, and all spans as text."""
    listed = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["base"])
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs.select("doc_id", "text"), to="spans").select("doc_id", *map(of, BASE), F.sha2(listed(base), 256).alias("base_sha256"), listed("spans").alias("spans"))
