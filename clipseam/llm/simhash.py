"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits lie on a ring of segments. If two differ in at most t bits, there is a segment of the m from which
every chain of l consecutive segments differs in at most l * t / m bits. For up to 3 bits there are six segments: six less t of them agree
whole, and every choice of so many is a key of the search, of about 32 bits for 3 bits, so that few fingerprints meet by chance. Those that meet must have a
segment whose chains of two and three stay in their budgets before all bits are compared. Copies fall together first: the search is over
distinct fingerprints. A key that many fingerprints share is dealt as pairs of tiles of bounded size, each to a task of its
own, and a tile gives back a spanning forest of its links, never the pairs.

From 4 to 7 bits there are four segments; the first of some chain differs in one bit at most, and a key is a segment without one of its
bits, for each of the 16; from there chains of two, three and four stay in their budgets. Such links also need a second, wide fingerprint of five-word shingles to agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, held, join_skewed, small_side, table, text_bytes
from .components import components, forest

SHINGLE, BITS, SEGMENTS, SEED = 3, 3, 4, 42
TILE = 2048
#: Near copies, where a caller asks for them: at most so many bits, of which those beyond BITS need WIDE_BITS of WIDE_WORDS * 64 at most to differ in the wide fingerprint.
#: Five-word shingle sets of one size and similarity 0.8 have the cosine 8 / 9, at which acos(8 / 9) / pi * 256 = 38.8 bits are expected to differ.
NEAR_BITS, WIDE_BITS, WIDE_SHINGLE, WIDE_WORDS = 7, 38, 5, 4
WIDE = tuple(f"w{i}" for i in range(WIDE_WORDS))
#: Keys of one of the four segments: without one of its 16 bits.
FORMS = 16
#: The six segments for few bits, from the highest bit.
RING = tuple(((1 << width) - 1) << shift for width, shift in zip((11, 11, 11, 11, 10, 10), (53, 42, 31, 20, 10, 0), strict=True))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    words = text.translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), SEED)
    if shingle == 3:
        hashes = [digest(b"%b %b %b" % x, SEED) for x in zip(words, words[1:], words[2:], strict=False)]
    else:
        hashes = [digest(b" ".join(words[i : i + shingle]), SEED) for i in range(len(words) - shingle + 1)]
    raw = np.array(hashes, ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(raw), 1 << 16):
        ones += np.unpackbits(raw[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(raw)).tobytes(), "big")


def wide_fingerprint(text: bytes, shingle: int = WIDE_SHINGLE) -> np.ndarray:
    """Four words of 64 bits, each bit set if it is in over half of the shingles' 256-bit hashes; without words all zero."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(WIDE_WORDS, np.int64)
    digest, ones, n = xxhash.xxh3_128_digest, np.zeros(64 * WIDE_WORDS, np.int64), max(1, len(words) - shingle + 1)
    for at in range(0, n, 1 << 14):
        joined = [b" ".join(words[i : i + shingle]) for i in range(at, min(n, at + (1 << 14)))]
        raw = np.frombuffer(b"".join([digest(x, SEED) + digest(x, SEED + 1) for x in joined]), np.uint8)
        ones += np.unpackbits(raw.reshape(len(joined), -1), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).view(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, near: bool = False) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) per row of docs, near: and the wide fingerprint; texts without words (null too) have zero."""
    chosen = docs.select("doc_id", text_bytes().alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash", dict)  # lets go of another operator's memory
        for batch in batches:
            fp = np.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], np.uint64).view(np.int64)
            wide = np.array([wide_fingerprint(x.as_py()) for x in batch.column(1)], np.int64).reshape(-1, WIDE_WORDS).T if near else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), *map(pa.array, wide)], names=["doc_id", "fp", *(WIDE if near else ())])

    more = "".join(f", {w} long" for w in WIDE) if near else ""
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, fp long{more}")


def chained(x: np.ndarray, bits: int) -> np.ndarray:
    """Of differences of fingerprints, those of at most ``bits``: first chains of up to three segments must stay in their budgets from some segment on, then all bits count."""
    counts = np.stack([np.bitwise_count(x & np.uint64(m)).astype(np.int64) for m in RING])
    ok, n = np.zeros(len(x), bool), len(RING)
    for start in range(n):
        inside, sums = np.ones(len(x), bool), np.zeros(len(x), np.int64)
        for chain in (1, 2, 3):
            sums = sums + counts[(start + chain - 1) % n]
            inside &= sums * n <= bits * chain
        ok |= inside
    ok[ok] = np.bitwise_count(x[ok]) <= bits
    return ok


def chained_from(x: np.ndarray, i: np.ndarray, bits: int) -> np.ndarray:
    """The same for keys of one of four segments: chains from the key's segment, as far as all four."""
    shift = (16 * (i // FORMS)).astype(np.uint64)
    ring = np.where(i >= FORMS, (x << shift) | (x >> ((np.uint64(64) - shift) % np.uint64(64))), x)
    ok = np.ones(len(x), bool)
    for segments in range(2, SEGMENTS + 1):
        ok &= np.bitwise_count(ring >> np.uint64(64 - 16 * segments)) * SEGMENTS <= bits * segments
    return ok


def linked(key: np.ndarray, i: np.ndarray, fp: np.ndarray, tile: np.ndarray, split: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked pairs. Rows are sorted by key; i: the key's form; split: rows of two tiles, to be compared across only."""
    left, right = [], []
    at, d = np.arange(len(key)), 0
    while len(at):
        d += 1
        at = at[at < len(key) - d]
        at = at[key[at] == key[at + d]]
        met = at[~split[at] | (tile[at] != tile[at + d])]
        x = fp[met] ^ fp[met + d]
        met = met[chained(x, bits) if bits <= BITS else chained_from(x, i[met], bits)]
        left.append(met)
        right.append(met + d)
    return np.concatenate(left or [at]), np.concatenate(right or [at])


def segment_keys(bits: int) -> Column:
    """An array of i, the form of a key, and seg, the key: two fingerprints that differ in at most ``bits`` bits share a key.

    Up to BITS: the segments of a choice of six less bits of RING. Beyond: a quarter without one of its bits (i = quarter * FORMS + the bit).
    """
    if bits <= BITS:
        masks = [sum(chosen) for chosen in combinations(RING, len(RING) - bits)]
    else:
        masks = [(0xFFFF & ~(1 << m)) << (48 - 16 * i) for i in range(SEGMENTS) for m in range(FORMS)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    return F.array(*[F.struct(F.lit(i).alias("i"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("seg")) for i, m in enumerate(signed)])


def link_fingerprints(distinct: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """distinct: fp, each once. Edges a, b (long): a spanning forest, tile by tile, of all pairs with at most ``bits`` (below 8) differing bits.

    With the wide fingerprint in distinct (then each fp with each of its wide ones), pairs of more than BITS bits must also differ in WIDE_BITS bits of it at most.
    """
    if not 0 <= bits < 2 * SEGMENTS:
        raise ValueError("one bit of a segment may differ: bits must be under twice the number of segments")
    wide = [w for w in WIDE if w in distinct.columns]
    parts = distinct.select("fp", *wide, F.explode(segment_keys(bits)).alias("k")).select("fp", *wide, "k.i", "k.seg")
    crowded = parts.groupBy("i", "seg").agg(F.count("*").alias("n")).filter(F.col("n") > tile).select(F.col("i").alias("_i"), F.col("seg").alias("_seg"), F.ceil(F.col("n") / tile).cast("int").alias("tiles"))
    crowded = small_side(cut(crowded, "crowded"))
    dealt = parts.join(crowded, (F.col("i") == F.col("_i")) & (F.col("seg") == F.col("_seg")), "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("i", "seg", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "fp", *wide)
    dealt = dealt.repartition("i", "seg", "low", "high").sortWithinPartitions("i", "seg", "low", "high", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: list[np.ndarray]) -> pa.RecordBatch:
            i, seg, low, high, tile_, fp, *more = rows
            new = np.zeros(len(i), bool)
            for x in (i, seg, low, high):
                new[1:] |= x[1:] != x[:-1]
            bits_ = fp.view(np.uint64)
            a, b = linked(np.cumsum(new), i, bits_, tile_, low != high, bits)
            if more:
                apart = sum(np.bitwise_count(w.view(np.uint64)[a] ^ w.view(np.uint64)[b]).astype(np.int64) for w in more)
                near = (np.bitwise_count(bits_[a] ^ bits_[b]) <= BITS) | (apart <= WIDE_BITS)
                a, b = a[near], b[near]
            node, root = forest(fp[a], fp[b])
            move = node != root
            return pa.RecordBatch.from_arrays([pa.array(root[move]), pa.array(node[move])], names=["a", "b"])

        rest: list[np.ndarray] | None = None
        for batch in batches:
            rows = [np.asarray(c) for c in batch.columns]
            rows = rows if rest is None else [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            # The last key may go on in the next batch.
            last = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in rows[:4]])) if len(rows[0]) else []
            end = int(last[-1]) + 1 if len(last) else 0
            rest = [x[end:] for x in rows]
            if end:
                yield edges([x[:end] for x in rows])
        if rest is not None and len(rest[0]):
            yield edges(rest)

    return dealt.mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, near: bool = False) -> DataFrame:
    """doc_id, fp, component_id per row of docs: fingerprints link at ``bits`` or fewer differing bits; component_id is the smallest doc_id reachable.

    near: also at NEAR_BITS or fewer, if the wide fingerprints of five-word shingles differ in WIDE_BITS or fewer.
    Null and empty texts share the fingerprint zero and link like any other; null doc_ids stay out of the minimum;
    repeated rows fall together; a text is hashed whole in one task, which holds its words and their hashes (some hundred bytes a word);
    other columns are left out; an empty table gives an empty result.
    """
    marked = cut(fingerprints(docs, shingle, near), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("_rows"))
    searched = marked.select("fp", *WIDE).distinct() if near else distinct.select("fp")
    found = components(link_fingerprints(searched, NEAR_BITS if near else bits))
    grouped = distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "first", "_rows", F.coalesce("component", "fp").alias("component"))
    grouped = cut(grouped, "groups")
    first = grouped.groupBy("component").agg(F.min("first").alias("component_id"), F.count("*").alias("_n"))
    by_fp = join_skewed(grouped.select("fp", "_rows", "component"), first, ["component"], grouped.count()).select("fp", F.col("_rows").alias("_n"), "component_id")
    return join_skewed(marked.select("doc_id", "fp"), cut(by_fp, "by-fingerprint"), ["fp"], marked.count()).select("doc_id", "fp", "component_id")


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
