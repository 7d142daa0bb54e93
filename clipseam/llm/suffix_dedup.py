"""Removal of repeated byte strings by a hash-compared suffix sort.

A string of WIDTH bytes that starts at two places has the same GRAM-byte anchor in both: the gram of smallest hash (the
leftmost of equal ones). So every string's start belongs to exactly one anchor, and only starts that belong to equal
anchors, at the same distance, need be compared. (1) Each task cuts its texts into segments, the bytes of all strings
that belong to one anchor; one per some 185 bytes. (2) Segments of equal 128-bit digests form a class; alone in its
anchor and of one member, a class can't repeat anything. Of every other class one member, and of larger ones a second,
goes to the sort. (3) There two members are folded once their bytes have been compared, and the suffixes of segments around equal anchors,
in sets of one anchor and distance, go through a mergesort whose comparisons find the common extension of two suffixes by
prefix polynomial hashes and binary search. A suffix repeats if it was folded or shares WIDTH bytes with its neighbour in
the order, byte by byte; where bytes don't bear a hash out, the set is sorted anew by its bytes. (4) What the sort found
returns to all members' texts.

Pieces of texts lie in a table bucketed by block, so that fetching segments and removing bytes read them where they are.
An anchor with many different segments (as around a very common passage of under WIDTH bytes) is split: its segments are cut into
parts by the strings' distance to the anchor, and the bytes that all strings of a part cover take the anchor's place, as equal
strings have them in common. Parts get narrower, down to one string, until no set is beyond what one task sorts; the work stays
in proportion to the segments.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, cut, join_skewed, mix64, table, text_bytes

WIDTH, GRAM = 400, 64
BLOCK, PIECE = 16 << 20, 1 << 20
#: Starts that are cut into segments at once; their places take PLACE bits beside the hashes.
CHUNK, PLACE = 1 << 24, 26
#: Different segments of one anchor that are sorted in one task, those of larger ones are split; bytes of segments that are sorted at once.
TILE, SORTED = 256, 1 << 18
#: Neighbouring distances to the anchor that share a part, one step of splitting after another.
STEPS = (48, 8, 1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class PrefixHash:
    """Polynomial hashes (modulo 2**64, bytes mapped to random values) of any part of some bytes, from its prefixes."""

    def __init__(self, raw: np.ndarray):
        self.raw = raw
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUE[raw] * powers(BASE, len(raw)))])
        self.back = powers(INVERSE, len(raw) + 1)

    def of(self, at: np.ndarray, length) -> np.ndarray:
        return (self.sums[at + length] - self.sums[at]) * self.back[at]


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each place on, by doubling."""
    x, n = raw.astype(np.uint64), 1
    while n < 8:
        x = x[:-n] | (x[n:] << np.uint64(8 * n))
        n *= 2
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    while n < GRAM:
        x = x[:-n] * np.uint64(0x94D049BB133111EB) + (x[n:] ^ (x[n:] >> np.uint64(31)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        n *= 2
    return x ^ (x >> np.uint64(32))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n = len(x) - width + 1
    whole = np.concatenate([x, np.full(-len(x) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(whole, axis=1).ravel()
    behind = np.minimum.accumulate(whole[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def segments(raw: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of texts in a row: per segment the anchor's hash, the two halves of the digest of its bytes, its first string's start, and its strings with the distance of the first one to the anchor."""
    ends, view, found = np.cumsum(lengths), memoryview(raw), []
    for at in range(0, len(raw) - WIDTH + 1, CHUNK):
        part = raw[at : at + CHUNK + WIDTH - 1]
        hashes = gram_hashes(part)
        low_bits = np.uint64((1 << PLACE) - 1)
        smallest = sliding_minimum((hashes & ~low_bits) | np.arange(len(hashes), dtype=np.uint64), WIDTH - GRAM + 1)
        place = np.arange(at, at + len(smallest))
        starts = np.flatnonzero(place + WIDTH <= ends[np.searchsorted(ends, place, side="right")])
        anchor = (smallest[starts] & low_bits).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)])[: len(starts)])
        count, anchor, low = np.diff(np.append(first, len(starts))), anchor[first], starts[first]
        found.append((hashes[anchor].view(np.int64), low + at, count | (anchor - low) << 20))
    anchors, lows, shapes = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 3
    sizes = (shapes & ((1 << 20) - 1)) - 1 + WIDTH
    digests = b"".join([hashlib.blake2b(view[a : a + n], digest_size=16).digest() for a, n in zip(lows.tolist(), sizes.tolist(), strict=True)])
    halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
    return anchors, halves[:, 0], halves[:, 1], lows, shapes


class SuffixSorter:
    """Sorts suffixes, cut at WIDTH bytes, inside sets."""

    def __init__(self, raw: np.ndarray):
        self.raw, self.hash = np.concatenate([raw, np.zeros(WIDTH, np.uint8)]), None
        self.hash = PrefixHash(self.raw)
        self.compared = 0

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Bytes that suffixes x and y share, WIDTH at most: binary search over prefix hashes."""
        found = np.zeros(len(x), np.int64)
        step = 1 << (WIDTH.bit_length() - 1)
        while step:
            same = (found + step <= WIDTH) & (self.hash.of(x + found, step) == self.hash.of(y + found, step))
            found += step * same
            step //= 2
        self.compared += len(x)
        return found

    def less(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        shared = self.common(x, y)
        return (shared < WIDTH) & (self.raw[x + np.minimum(shared, WIDTH - 1)] < self.raw[y + np.minimum(shared, WIDTH - 1)])

    def sort(self, suffixes: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """The suffixes in order inside each set (sets ascend): a bottom-up mergesort, all sets and merges at once."""
        if not len(sets):
            return suffixes
        suffixes = suffixes.copy()
        first = np.flatnonzero(np.concatenate([[True], sets[1:] != sets[:-1]]))
        sizes = np.diff(np.append(first, len(sets)))
        begin, size = np.repeat(first, sizes), np.repeat(sizes, sizes)
        rank = np.arange(len(sets)) - begin
        run = 1
        while run < sizes.max():
            mine = rank // run
            other = (mine ^ 1) * run
            low, high = np.minimum(other, size), np.minimum(other + run, size)
            base, right = low.copy(), mine % 2 == 1
            todo = np.flatnonzero(low < high)
            while len(todo):
                middle = (low[todo] + high[todo]) // 2
                x, y = suffixes[todo], suffixes[begin[todo] + middle]
                # A suffix of the right run comes after equal ones of the left run.
                ahead = np.where(right[todo], ~self.less(x, y), self.less(y, x))
                low[todo] = np.where(ahead, middle + 1, low[todo])
                high[todo] = np.where(ahead, high[todo], middle)
                todo = todo[low[todo] < high[todo]]
            to = begin + (mine // 2) * 2 * run + (rank - mine * run) + (low - base)
            merged = np.empty_like(suffixes)
            merged[to] = suffixes
            suffixes = merged
            run *= 2
        return suffixes

    def sort_bytes(self, suffixes: np.ndarray, sets: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """The suffixes with those of the chosen sets in order of their bytes."""
        out, whole = suffixes.copy(), self.raw.tobytes()
        at = np.flatnonzero(chosen)
        out[at] = [x for _, _, x in sorted((s, whole[x : x + WIDTH], x) for s, x in zip(sets[at].tolist(), suffixes[at].tolist(), strict=True))]
        return out

    def equal_bytes(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        rows = np.lib.stride_tricks.sliding_window_view(self.raw, WIDTH)
        return np.concatenate([(rows[x[k : k + 8192]] == rows[y[k : k + 8192]]).all(1) for k in range(0, len(x), 8192)] or [np.zeros(0, bool)])


def repeated(texts: list[bytes], anchors: np.ndarray, distances: np.ndarray, folded: np.ndarray | None = None) -> list[np.ndarray]:
    """For different segments: the places in each at which a string starts that starts also in another one of equal anchor at equal distance, or anywhere in a folded one.

    anchors: a number per segment; distances: from its first string's start to its anchor; folded: segments that stand for two of equal bytes.
    """
    if not texts:
        return []
    lengths = np.array([len(t) for t in texts])
    counts = lengths - WIDTH + 1
    segment = np.repeat(np.arange(len(texts)), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    suffixes = (np.cumsum(lengths) - lengths)[segment] + inside
    sorter = SuffixSorter(np.frombuffer(b"".join(texts), np.uint8))
    sets = anchors[segment] * 1024 + (distances[segment] - inside)
    by_set = np.argsort(sets, kind="stable")
    # A suffix alone in its set has no neighbour.
    mates = np.diff(sets[by_set]) == 0
    by_set = by_set[np.append(mates, False) | np.append(False, mates)]
    suffixes, sets = suffixes[by_set], sets[by_set]
    number = np.zeros(len(sorter.raw), np.int64)
    number[suffixes] = by_set
    suffixes = sorter.sort(suffixes, sets)
    mates = sets[1:] == sets[:-1]
    near = np.flatnonzero(mates)
    near = near[sorter.common(suffixes[1:][near], suffixes[:-1][near]) == WIDTH]
    same = sorter.equal_bytes(suffixes[near], suffixes[near + 1])
    if not same.all():
        # Hashes met by chance: what they were believed in is sorted by its bytes.
        wrong = np.isin(sets, sets[near[~same]])
        suffixes = sorter.sort_bytes(suffixes, sets, wrong)
        near = np.union1d(near[~wrong[near]], np.flatnonzero(mates & wrong[1:]))
        near = near[sorter.equal_bytes(suffixes[near], suffixes[near + 1])]
    found = np.zeros(len(suffixes), bool) if folded is None else folded[segment]
    found[number[suffixes[near]]] = True
    found[number[suffixes[near + 1]]] = True
    return np.split(inside[found], np.cumsum(np.bincount(segment[found], minlength=len(texts)))[:-1])


def reduce_texts(docs: DataFrame) -> DataFrame:
    """Pass 1. A row per piece of a block: its texts, and its segments with starts counted in the block."""
    from pyspark.sql.pandas.types import to_arrow_type

    chosen = docs.select("doc_id", text_bytes().alias("_text"))
    id_type = to_arrow_type(chosen.schema["doc_id"].dataType)
    numbers = ("anchors", "heads", "tails", "lows", "shapes")
    schema = pa.schema([("block", pa.int64()), ("start", pa.int64()), ("ids", pa.list_(id_type)), ("lengths", pa.list_(pa.int64())), ("texts", pa.binary()), *[(n, pa.list_(pa.int64())) for n in numbers]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, start = TaskContext.get().partitionId() << 12, 0
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1).to_pylist(), 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE):
                    size += len(texts[to])
                    to += 1
                if start and start + size > BLOCK:
                    block, start = block + 1, 0
                    if not block & 4095:
                        raise ValueError(f"a task's texts are beyond 4096 blocks of {BLOCK} bytes: read the table in smaller partitions")
                joined, lengths = b"".join(texts[at:to]), np.array([len(t) for t in texts[at:to]], np.int64)
                anchors, heads, tails, lows, shapes = segments(np.frombuffer(joined, np.uint8), lengths)
                values = (block, start, ids.slice(at, to - at).to_pylist(), lengths, zstandard.compress(joined, 3), anchors, heads, tails, lows + start, shapes)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, schema, strict=True)], schema=schema)
                start, at = start + size, to

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"block long, start long, ids array<{kind}>, lengths array<long>, texts binary, {', '.join(f'{n} array<long>' for n in numbers)}")


def block_bytes(pieces: pa.Table) -> bytes:
    order = np.argsort(np.asarray(pieces["start"]), kind="stable")
    return b"".join([zstandard.decompress(pieces["texts"][int(i)].as_py()) for i in order])


def fold_and_sort(rows: list[list]) -> pa.RecordBatch:
    """Of segments with their keys (anchor; low and high, the digest of a class that is folded by itself), digests, places and members: place and end of each repeated part of a class of one member, and the digest of each class whose two members were found equal."""
    anchor, low, high, head, tail, place, members, distance, texts = rows
    kept: dict[tuple, int] = {}
    folded = np.zeros(len(texts), bool)
    for i, key in enumerate(zip(anchor, low, high, head, tail, strict=True)):
        first = kept.setdefault(key, i)
        if first != i:
            if texts[first] == texts[i]:
                folded[first] = True
            else:
                kept[*key, i] = i
    chosen = [*kept.values()]
    numbers: dict[tuple, int] = {}
    sets = np.array([numbers.setdefault((anchor[i], low[i], high[i]), len(numbers)) for i in chosen], np.int64)
    found = repeated([texts[i] for i in chosen], sets, np.array([distance[i] for i in chosen], np.int64), folded[chosen])
    out: list[tuple] = []
    for i, places in zip(chosen, found, strict=True):
        if not len(places):
            continue
        if members[i] > 1:
            # Both members hold all strings of the class.
            if len(places) == len(texts[i]) - WIDTH + 1:
                out.append((head[i], tail[i], None, None))
            continue
        gap = np.flatnonzero(np.diff(places) > 1)
        out += [(None, None, place[i] + int(places[x]), int(places[y] - places[x]) + WIDTH) for x, y in zip(np.append(0, gap + 1), np.append(gap, len(places) - 1), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["head", "tail", "place", "size"])


def sort_segments(wanted: DataFrame) -> DataFrame:
    """wanted: anchor, low, high, head and tail of the digest, place, members, distance, segment. What fold_and_sort finds, keys one after another."""
    dealt = wanted.repartition("anchor", "low", "high").sortWithinPartitions("anchor", "low", "high")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in range(9)]
        size = 0
        for batch in batches:
            for row in zip(*batch.to_pydict().values(), strict=True):
                if size > SORTED and row[:3] != tuple(c[-1] for c in held[:3]):
                    yield fold_and_sort(held)
                    held, size = [[] for _ in range(9)], 0
                for c, x in zip(held, row, strict=True):
                    c.append(x)
                size += len(row[8])
        if held[0]:
            yield fold_and_sort(held)

    return dealt.select("anchor", "low", "high", "head", "tail", "place", "members", "distance", "segment").mapInArrow(run, "head long, tail long, place long, size long")


def block_of(place: str) -> Column:
    return F.shiftrightunsigned(place, 32)


def at_of(place: str) -> Column:
    return F.col(place).bitwiseAND((1 << 32) - 1)


def count_of(shape: str) -> Column:
    return F.col(shape).bitwiseAND((1 << 20) - 1)


def split_parts(whole: bytes, at: int, count: int, distance: int, step: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """A segment cut where the distances of its strings are multiples of step: per part the digest of what all its possible strings cover, which replaces the anchor, that of its bytes, its first string's start and its shape."""
    middle, least = at + distance, distance - count + 1
    for part in range(least // step, distance // step + 1):
        far, near = min(distance, part * step + step - 1), max(least, part * step)
        common = whole[middle - part * step : middle - part * step - step + 1 + WIDTH]
        key = hashlib.blake2b(common, digest_size=8, salt=(step << 20 | part).to_bytes(8, "little"))
        own = hashlib.blake2b(whole[middle - far : middle - near + WIDTH], digest_size=16)
        yield key.digest(), own.digest(), middle - far, (far - near + 1) | far << 20


def part_rows(crowded: DataFrame, pieces: DataFrame, step: int) -> DataFrame:
    """The parts of one member of each crowded class, as rows of segments."""
    asked = crowded.select(block_of("first").alias("block"), at_of("first").alias("at"), count_of("shape").alias("count"), F.shiftright("shape", 20).alias("distance"))

    def split(asked: pa.Table, held: pa.Table) -> pa.Table:
        whole, out = block_bytes(held) if asked.num_rows else b"", []
        for at, count, distance in zip(*(asked[c].to_pylist() for c in ("at", "count", "distance")), strict=True):
            out += split_parts(whole, at, count, distance, step)
        keys, digests, starts, shapes = zip(*out, strict=True) if out else [()] * 4
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        # A cogroup has rows of one block; pieces alone are asked for nothing.
        place = np.array(starts, np.int64) | (asked["block"][0].as_py() << 32 if out else 0)
        return pa.table({"place": place, "anchor": np.frombuffer(b"".join(keys), np.int64), "head": halves[:, 0], "tail": halves[:, 1], "shape": np.array(shapes, np.int64)})

    return asked.groupBy("block").cogroup(pieces.select("block", "start", "texts").groupBy("block")).applyInArrow(split, "place long, anchor long, head long, tail long, shape long")


def remove_repeats(docs: DataFrame, tile: int = TILE, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the remaining bytes) per row of docs.

    Null texts are empty. Strings never cross texts; repeats inside one text count; rows that repeat an id are texts of
    their own. Other columns are left out; an empty table gives none. A text is held whole by one task; places are of 64
    bits: a partition of up to 4,096 blocks, a text of up to 4 GiB (a cell holds 2).
    """
    pieces = bucketed(reduce_texts(docs), "block", max(8, docs.rdd.getNumPartitions()), "suffix-pieces")
    rows = pieces.select("block", F.explode(F.arrays_zip("anchors", "heads", "tails", "lows", "shapes")).alias("s"))
    rows = rows.select(F.shiftleft("block", 32).bitwiseOR(F.col("s.lows")).alias("place"), F.col("s.anchors").alias("anchor"), F.col("s.heads").alias("head"), F.col("s.tails").alias("tail"), F.col("s.shapes").alias("shape"))
    levels, every, wanted, total = [], [], [], 0
    for step in (0, *STEPS):
        if step:
            rows = cut(part_rows(crowded, pieces, step), "suffix-parts")
        # Equal bytes have one anchor and one shape; equal anchors at unequal distances may still share strings.
        classes = cut(rows.groupBy("head", "tail").agg(F.count("*").alias("members"), F.min("place").alias("first"), F.max("place").alias("last"), F.min("anchor").alias("anchor"), F.min("shape").alias("shape")), "suffix-classes")
        total = max(total, count := classes.agg(F.sum("members")).first()[0] or 0)
        # The last step's strings of equal keys are equal.
        about = cut(classes.groupBy("anchor").agg(F.count("*").alias("_n"), F.max("members").alias("most")).filter("_n > 1 OR most > 1").select("anchor", "_n", (F.col("_n") > tile if step != STEPS[-1] else F.lit(False)).alias("split")), "suffix-anchors")
        levels.append(rows)
        every.append(classes.filter("members > 1"))
        # Of a split anchor's classes those of two members and more are folded by themselves; what else their strings repeat, parts show.
        key = [F.when(F.col("split"), F.col(c)).otherwise(0) for c in ("head", "tail")]
        chosen = join_skewed(classes, about, ["anchor"], count).filter("NOT split OR members > 1")
        wanted.append(chosen.select("anchor", key[0].alias("low"), key[1].alias("high"), "head", "tail", "members", count_of("shape").alias("count"), F.shiftright("shape", 20).alias("distance"), F.explode(F.when(F.col("members") > 1, F.array("first", "last")).otherwise(F.array("first"))).alias("place")))
        split = about.filter("split")
        if split.isEmpty():
            break
        crowded = join_skewed(classes, split, ["anchor"], count)
    rows, several, wanted = reduce(DataFrame.unionByName, levels), reduce(DataFrame.unionByName, every), reduce(DataFrame.unionByName, wanted)
    wanted = wanted.withColumn("block", block_of("place")).groupBy("block").cogroup(pieces.select("block", "start", "texts").groupBy("block"))
    passed = ("anchor", "low", "high", "head", "tail", "place", "members", "distance")

    def fetch(asked: pa.Table, held: pa.Table) -> pa.Table:
        whole = block_bytes(held) if asked.num_rows else b""
        at, n = (np.asarray(asked["place"]) & 0xFFFFFFFF).tolist(), asked["count"].to_pylist()
        return pa.table({**{c: asked[c] for c in passed}, "segment": pa.array([whole[a : a + k - 1 + WIDTH] for a, k in zip(at, n, strict=True)], pa.binary())})

    fetched = wanted.applyInArrow(fetch, "anchor long, low long, high long, head long, tail long, place long, members long, distance long, segment binary")
    found = cut(sort_segments(fetched), "suffix-found")
    alone = found.filter("place IS NOT NULL").select(block_of("place").alias("block"), at_of("place").alias("low_at"), (at_of("place") + F.col("size")).alias("high_at"))
    equal = found.filter("place IS NULL").select("head", "tail").distinct().join(several.groupBy("head", "tail").agg(F.sum("members").alias("_n")), ["head", "tail"])
    shared = join_skewed(rows, cut(equal, "suffix-equal"), ["head", "tail"], total)
    shared = shared.select(block_of("place").alias("block"), at_of("place").alias("low_at"), (at_of("place") + count_of("shape") - 1 + WIDTH).alias("high_at"))
    spans = alone.unionByName(shared).groupBy("block").cogroup(pieces.select("block", "start", "ids", "lengths", "texts").groupBy("block"))
    kind = pieces.schema["ids"].dataType.elementType.simpleString()

    def remove(found: pa.Table, held: pa.Table) -> pa.Table:
        lows, highs = np.asarray(found["low_at"]), np.asarray(found["high_at"])
        order = np.argsort(lows, kind="stable")
        lows, highs = lows[order], highs[order]
        ids, out = [], []
        for start, names, lengths, packed in zip(held["start"].to_pylist(), held["ids"], held["lengths"], held["texts"], strict=True):
            whole, ids = zstandard.decompress(packed.as_py()), ids + names.as_py()
            depth = np.zeros(len(whole) + 1, np.int32)
            mine = slice(*np.searchsorted(lows, (start, start + len(whole))))
            np.add.at(depth, lows[mine] - start, 1)
            np.add.at(depth, highs[mine] - start, -1)
            gone, raw, at = np.cumsum(depth[:-1], dtype=np.int32) > 0, np.frombuffer(whole, np.uint8), 0
            for length in lengths.as_py():
                a, b, at = at, at + length, at + length
                mask = gone[a:b]
                n = int(np.count_nonzero(mask))
                kept = raw[a:b][~mask].tobytes() if n else whole[a:b]
                out.append((length, n, int(mask[0]) + int(np.count_nonzero(mask[1:] & ~mask[:-1])) if n else 0, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        columns = {"doc_id": pa.array(ids, held.schema.field("ids").type.value_type), "n_bytes": pa.array([x[0] for x in out], pa.int64()), "n_removed": pa.array([x[1] for x in out], pa.int64()), "n_spans": pa.array([x[2] for x in out], pa.int64()), "kept_sha256": pa.array([x[3] for x in out], pa.string())}
        return pa.table(columns | ({"kept": pa.array([x[4] for x in out], pa.binary())} if with_text else {}))

    return spans.applyInArrow(remove, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
