"""Periodic runs of words: branching tandem repeats from a suffix tree, rotated and merged into maximal runs.

A run with ``powers`` periods or more holds each of its words at least ``powers`` times, so words that are rarer in
their stretch of a text cut it, until no stretch changes; what is left of many texts becomes one sequence with distinct
separators. Its suffix tree is kept as sorted suffixes with their common lengths. At each node the leaves of all children
but the largest are listed (a leaf is listed at most log2(n) times): leaf j of a node of depth D starts or ends the first half of a tandem
repeat of period D if j + D or j - D is a leaf of another child. Such a repeat branches: its run ends where it ends.
Rotations to the left, compared in doubling steps, lead to the run's start; repeats of multiples of a period merge into its run.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, table, text_bytes

LEAST, POWERS = 6, 4
#: Bytes of text that are searched together, and listed leaves that are held at a time.
CHUNK, LEAVES = 4_000_000, 1_000_000


def stretches(ids: np.ndarray, text: np.ndarray, least: int, powers: int) -> np.ndarray:
    """The positions that may stand in a run: neighbours in the same text whose words all occur ``powers`` times in their stretch."""
    at = np.arange(len(ids))
    while len(at):
        new = np.concatenate([[True], (np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])])
        stretch = np.cumsum(new) - 1
        length = np.bincount(stretch)
        _, inverse, count = np.unique(stretch * np.int64(ids.max() + 1) + ids[at], return_inverse=True, return_counts=True)
        kept = (count[inverse] >= powers) & (length[stretch] >= least)
        if kept.all():
            break
        at = at[kept]
    return at


class Suffixes:
    """Sorted suffixes of a sequence by doubling; the orders of all prefixes of lengths 1, 2, 4, ... are kept."""

    def __init__(self, s: np.ndarray):
        n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.levels = [rank]
        while (top := int(rank.max())) < n - 1:
            width = 1 << (len(self.levels) - 1)
            after = np.full(n, -1)
            after[:-width] = rank[width:]
            key = rank * np.int64(top + 2) + after + 1
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = new
            self.levels.append(rank)
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many items the suffixes at a and b share, a and b different."""
        n, a, b = len(self.rank), a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            inside = np.maximum(a, b) < n
            same = inside.copy()
            same[inside] = self.levels[k][a[inside]] == self.levels[k][b[inside]]
            step = same.astype(np.int64) << k
            out += step
            a += step
            b += step
        return out


def small_children(lcp: list[int], deepest: int) -> np.ndarray:
    """Rows of (first leaf, last leaf, node's first, node's last, depth) for each child but the largest of every node of depth 1 to deepest; lcp[i]: what sorted suffixes i - 1 and i share."""
    out: list[tuple[int, int, int, int, int]] = []
    stack: list[tuple[int, list[int]]] = []  # depth, first leaves of the children
    for i, depth in enumerate([*lcp[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, starts = stack.pop()
            first = starts[0]
            if d <= deepest:
                ends = [*starts[1:], i]
                sizes = [b - a for a, b in zip(starts, ends, strict=True)]
                largest = sizes.index(max(sizes))
                out.extend((a, b - 1, first, i - 1, d) for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if k != largest)
        if depth:
            if stack and stack[-1][0] == depth:
                stack[-1][1].append(i)
            else:
                stack.append((depth, [first, i]))
    return np.array(out, np.int64).reshape(-1, 5)


def branching_repeats(tree: Suffixes, deepest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of the tandem repeats that cannot be moved one to the right."""
    n = len(tree.rank)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = tree.common(tree.order[:-1], tree.order[1:])
    children = small_children(lcp.tolist(), deepest)
    starts, periods = [], []
    size = children[:, 1] - children[:, 0] + 1
    part = np.cumsum(size) // LEAVES
    for k in range(int(part[-1]) + 1 if len(part) else 0):
        mine, m = children[part == k], size[part == k]
        if not len(mine):
            continue
        low, high, first, last, depth = (np.repeat(mine[:, c], m) for c in range(5))
        leaf = tree.order[np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + low]
        for other, start in ((leaf + depth, leaf), (leaf - depth, leaf - depth)):
            at = np.flatnonzero((other >= 0) & (other < n))
            r = tree.rank[other[at]]
            at = at[(r >= first[at]) & (r <= last[at]) & ((r < low[at]) | (r > high[at]))]
            starts.append(start[at])
            periods.append(depth[at])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    return found[0], found[1]


def rotated(s: np.ndarray, start: int, period: int) -> int:
    """The start of the run that the tandem repeat at start belongs to: how far it rotates to the left, in doubling steps."""
    step = 16
    while start > 0:
        low = max(0, start - step)
        differs = np.flatnonzero(s[low:start] != s[low + period : start + period])
        if len(differs):
            return low + int(differs[-1]) + 1
        start, step = low, 2 * step
    return start


def runs_of(s: np.ndarray, longest: int, least: int = LEAST, powers: int = POWERS) -> list[tuple[int, int, int]]:
    """Start, end and period of every maximal run of max(least, powers * period) items; longest: no run can be longer."""
    if len(s) < least:
        return []
    tree = Suffixes(s)
    start, period = branching_repeats(tree, longest // powers)
    end = start + 2 * period
    need = np.maximum(least, powers * period)
    room = end >= need
    start, period, end, need = start[room], period[room], end[room], need[room]
    whole = tree.common(end - need, end - need + period) >= need - period
    best: dict[tuple[int, int], int] = {}
    by_end: dict[int, list[int]] = {}
    for e, p in sorted(zip(end[whole].tolist(), period[whole].tolist(), strict=True)):
        by_end.setdefault(e, []).append(p)
    for e, periods in by_end.items():
        known: list[tuple[int, int]] = []
        for p in periods:  # the smallest first: a multiple whose repeat lies in a known run is that run
            if not any(p % q == 0 and a <= e - 2 * p for a, q in known):
                a = rotated(s, e - 2 * p, p)
                known.append((a, p))
                best[a, e] = min(p, best.get((a, e), p))
    return [(a, e, p) for (a, e), p in best.items()]


def search(texts: list[bytes], least: int, powers: int) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs (start, length, period, by start and period) of each text."""
    words = [t.split() for t in texts]  # bytes split at these six characters
    sizes = np.array([len(w) for w in words])
    first = np.cumsum(sizes) - sizes
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if sizes.sum():
        ids = pd.factorize(np.fromiter((x for w in words for x in w), object, int(sizes.sum())))[0].astype(np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        at = stretches(ids, text, least, powers)
        if len(at):
            cuts = np.flatnonzero((np.diff(at) != 1) | (text[at[1:]] != text[at[:-1]])) + 1
            # A separator that occurs nowhere else stands between stretches.
            s = np.insert(ids[at], cuts, -1 - np.arange(len(cuts)))
            origin = np.insert(at, cuts, -1)
            longest = int(np.diff(np.concatenate([[0], cuts, [len(at)]])).max())
            for a, e, p in runs_of(s, longest, least, powers):
                k = int(text[origin[a]])
                found[k].append((int(origin[a] - first[k]), e - a, p))
    return [(w, sorted(r, key=lambda x: (x[0], x[2]))) for w, r in zip(words, found, strict=True)]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats, joined by single spaces: of each run its first period stays, unless another run drops it."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return b" ".join(compress(words, np.cumsum(change[:-1]) == 0))


def find_runs(docs: DataFrame, least: int = LEAST, powers: int = POWERS) -> DataFrame:
    """A row per row of docs: doc_id, n_words, runs (array of start, length, period: word numbers from 0, by start and period) and collapsed, the words outside of repetitions joined by single spaces.

    A run is a stretch of words with smallest period p, of at least max(least, powers * p) words, that neither neighbour
    extends; powers must be 2 or more. Null and empty texts have no words. A text is searched whole in one task, with memory of some
    hundred times its words that may repeat. doc_id may be null or of any type; other columns are left out; repeated rows
    give repeated rows; an empty table gives none.
    """
    if powers < 2 or least < 2:
        raise ValueError("a run has at least two periods and two words")
    chosen = docs.select("doc_id", text_bytes().alias("_text"))
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, low = batch.column(1), 0
            while low < batch.num_rows:
                part, size = [], 0
                while low + len(part) < batch.num_rows and size < CHUNK:
                    part.append(texts[low + len(part)].as_py())
                    size += len(part[-1])
                found = search(part, least, powers)
                runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in own] for _, own in found], kind)
                kept = pa.array([collapsed(*x).decode() for x in found], pa.string())
                counts = pa.array([len(w) for w, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, len(part)), counts, runs, kept], names=["doc_id", "n_words", "runs", "collapsed"])
                low += len(part)

    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def with_periods(docs: DataFrame) -> DataFrame:
    """docs with the words of each tenth text (by hash of its id; no id: the empty string) from some word on made periodic, as the query's contract has it."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))
    g, n, a = F.floor(F.col("_h") / 10), F.size("_words"), F.col("_a")
    place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % F.col("_p"))
    changed = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.element_at("_words", (place(i) + 1).cast("int"))), " ")
    # The words are split once: what refers to them stands in later projections.
    rows = docs.select("doc_id", "text", F.when(h % 10 == 0, words).alias("_words"), h.alias("_h"))
    rows = rows.withColumn("_a", F.when(n > 0, g % n)).withColumn("_p", 1 + F.floor((n - a) / (3 + g % 8)))
    return rows.select("doc_id", F.when(n > 0, changed).otherwise(F.col("text")).alias("text"))


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length over period; ties to the smallest start, then period; null without runs."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")

    def better(best: Column, x: Column) -> Column:
        new, old = x["length"] * best["period"], best["length"] * x["period"]
        return F.when(best.isNull() | (new > old), x).otherwise(best)

    return F.aggregate(runs, none, better)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    found = find_runs(with_periods(table(spark, sf_dir, "documents"))).withColumn("_best", strongest(F.col("runs")))
    line = lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.floor(1000 * F.col("_best.length") / F.col("_best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
