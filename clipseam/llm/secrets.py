"""Secret scans by one combined deterministic automaton.

The rules' regexes become one non-deterministic automaton; subset construction over byte classes and partition
refinement make it the smallest deterministic one, laid out as a flat array of transitions. A text takes one pass over
its bytes through this array, whatever the number of rules. The pass runs from the end of the text to its start through the
reversed rules, so it comes out with every place at which a match of a rule starts, and nothing has to be
tried elsewhere. From each rule's first such place that no earlier match of the rule covers, the rule's own automaton
runs to the match's longest end; matches of a rule don't overlap, so these runs stay within the matched bytes and the
whole is linear in the text. Python's ``re`` serves as the parser of the rules alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, table, text_bytes


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: kind: (regex over bytes, least length of the match, or of what follows the separator for assign).
#: The first three rules, and the well-known forms of issued credentials.
RULES: dict[str, tuple[str, int]] = {
    "assign": (f"(?:{'|'.join(map(either_case, ('password', 'passwd', 'secret', 'token', 'api_?key')))})[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", 6),
    "access": ("AKIA[A-Z0-9]+", 20),
    "hex": ("[0-9a-f]{24,}", 24),
    "private_key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", 0),
    "forge_token": ("gh[oprsu]_[A-Za-z0-9]+", 40),
    "chat_token": ("xox[abprs]-[A-Za-z0-9-]+", 15),
    "pay_key": ("sk_live_[A-Za-z0-9]+", 32),
    "web_token": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
}
BASE = ("assign", "access", "hex")
#: What an assign match has before its value.
ASSIGN_HEAD = re.compile(rb"[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?")


@dataclass
class Automaton:
    """moves[state * 256 + byte] is the next state times 256; accepts[state] has a bit per rule, and states from ``last`` on are those with any; state 0 starts, and nothing can follow in the dead one."""

    moves: list[int]
    accepts: list[int]
    last: int
    dead: int


def compile_rules(patterns: list[str], backward: bool) -> Automaton:
    """The smallest automaton for the patterns; backward: it reads from a text's end, a match may end at any byte, and accepts where one starts."""
    arcs: list[list[tuple[frozenset[int], int]]] = [[]]
    empty: list[list[int]] = [[]]

    def state() -> int:
        arcs.append([])
        empty.append([])
        return len(arcs) - 1

    def members(items) -> frozenset[int]:
        found: set[int] = set()
        negated = False
        for kind, value in items:
            if kind is op.NEGATE:
                negated = True
            elif kind is op.LITERAL:
                found.add(value)
            elif kind is op.RANGE:
                found.update(range(value[0], value[1] + 1))
            else:
                raise ValueError(f"not supported in a rule: {kind}")
        return frozenset(range(256)) - found if negated else frozenset(found)

    def add(tree, at: int) -> int:
        for kind, value in tree:
            if kind is op.LITERAL:
                to = state()
                arcs[at].append((frozenset([value]), to))
            elif kind is op.IN:
                to = state()
                arcs[at].append((members(value), to))
            elif kind is op.SUBPATTERN:
                to = add(value[3], at)
            elif kind is op.BRANCH:
                to = state()
                for branch in value[1]:
                    empty[add(branch, at)].append(to)
            elif kind is op.MAX_REPEAT:
                low, high, part = value
                for _ in range(low):
                    at = add(part, at)
                to = state()
                empty[at].append(to)
                if high is op.MAXREPEAT:
                    empty[add(part, to)].append(to)
                else:
                    for _ in range(high - low):
                        at = add(part, at)
                        empty[at].append(to)
            else:
                raise ValueError(f"not supported in a rule: {kind}")
            at = to
        return at

    ends, begins = {}, {}
    for k, pattern in enumerate(patterns):
        begin = state()
        begins[begin] = 1 << k
        ends[add(_parser.parse(pattern.encode()), begin)] = 1 << k
    if backward:
        back_arcs, back_empty = [[] for _ in arcs], [[] for _ in arcs]
        for at, own in enumerate(arcs):
            for chars, to in own:
                back_arcs[to].append((chars, at))
            for to in empty[at]:
                back_empty[to].append(at)
        arcs, empty, begins, ends = back_arcs, back_empty, ends, begins
    empty[0] += begins
    sets = sorted({s for a in arcs for s, _ in a}, key=sorted)
    signatures = [tuple(b in s for s in sets) for b in range(256)]
    kinds = {s: i for i, s in enumerate(dict.fromkeys(signatures))}
    byte_class = np.array([kinds[s] for s in signatures])
    one_of = [next(b for b in range(256) if byte_class[b] == c) for c in range(len(kinds))]

    def closed(states) -> frozenset[int]:
        todo, found = list(states), set(states)
        while todo:
            for to in empty[todo.pop()]:
                if to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(found)

    first = closed([0])
    numbers, order, moves = {first: 0}, [first], []
    for states in order:
        row = []
        for b in one_of:
            to = closed([t for s in states for chars, t in arcs[s] if b in chars])
            to = to | first if backward else to
            if to not in numbers:
                numbers[to] = len(order)
                order.append(to)
            row.append(numbers[to])
        moves.append(row)
    table_ = np.array(moves)
    accepts = np.array([sum({ends[s] for s in states if s in ends}) for states in order])
    part = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([part, part[table_]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == part.max():
            break
        part = finer
    # Numbered anew: the start, those that accept nothing, those that accept.
    keep = np.unique(part, return_index=True)[1]
    marks = accepts[keep]
    order_ = np.lexsort((np.arange(len(keep)) != part[0], marks > 0))
    rename = np.argsort(order_)
    small = rename[part[table_[keep]]][order_][:, byte_class]
    marks = marks[order_]
    if marks[0]:
        raise ValueError("a rule must not match the empty text")
    dead = next((s for s in range(len(keep)) if not marks[s] and (small[s] == s).all()), -1)
    return Automaton((small * 256).ravel().tolist(), marks.tolist(), int((marks == 0).sum()), dead)


class Scanner:
    def __init__(self, rules: dict[str, tuple[str, int]]):
        self.kinds = list(rules)
        self.least = [n for _, n in rules.values()]
        self.combined = compile_rules([p for p, _ in rules.values()], True)
        self.single = [compile_rules([p], False) for p, _ in rules.values()]

    def starts(self, text: bytes) -> list[list[int]]:
        """For each rule the places at which a match starts, from the last to the first: one pass over the bytes."""
        moves, accepts, first = self.combined.moves, self.combined.accepts, self.combined.last * 256
        found: list[list[int]] = [[] for _ in self.kinds]
        state, end = 0, len(text) - 1
        for i, b in enumerate(reversed(text)):
            state = moves[state + b]
            if state >= first:
                seen = accepts[state >> 8]
                while seen:
                    found[(seen & -seen).bit_length() - 1].append(end - i)
                    seen &= seen - 1
        return found

    def spans(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in code points, by start, then rule."""
        found = []
        for k, starts in enumerate(self.starts(text)):
            if not starts:
                continue
            own, free = self.single[k], 0
            moves, first, dead = own.moves, own.last * 256, own.dead * 256
            for at in reversed(starts):
                if at < free:
                    continue
                state, end = 0, -1
                for i in range(at, len(text)):
                    state = moves[state + text[i]]
                    if state == dead:
                        break
                    if state >= first:
                        end = i + 1
                free = end
                head = ASSIGN_HEAD.match(text, at, end).end() if self.kinds[k] == "assign" else at
                if end - head >= self.least[k]:
                    found.append((at, end, k))
        if found and not text.isascii():
            point = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
            found = [(int(point[a]), int(point[b]), k) for a, b, k in found]
        return sorted(found, key=lambda x: (x[0], x[2]))


def scanner(rules: tuple) -> Scanner:
    return held(("secrets", rules), lambda: Scanner(dict(rules)))


def merged(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b, _ in spans:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def find_secrets(docs: DataFrame, rules: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """A row per row of docs: doc_id and spans, an array of kind, start and end (code points, end exclusive).

    Null and empty texts have none; a text of any length is scanned whole; other columns are left out; repeated rows
    give repeated rows; an empty table gives none.
    """
    chosen = docs.select("doc_id", text_bytes().alias("_text"))
    key = tuple((rules or RULES).items())
    kinds = [k for k, _ in key]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = scanner(key)
        for batch in batches:
            found = [[{"kind": kinds[k], "start": a, "end": b} for a, b, k in work.spans(t.as_py())] for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(span))], names=["doc_id", "spans"])

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")


def redact_secrets(docs: DataFrame, mark: str = "[secret]", rules: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """docs with every found span of text replaced by mark; all columns and rows stay, null texts stay null."""
    names, key = docs.columns, tuple((rules or RULES).items())
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = scanner(key)
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                spans = merged(work.spans(text.encode())) if text else []
                for a, b in reversed(spans):
                    text = text[:a] + mark + text[b:]
                out.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.types[at]) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *[of(k).alias(f"n_{k}") for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
