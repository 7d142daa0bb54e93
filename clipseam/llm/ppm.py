"""Language-model scoring by prediction by partial matching (PPM) over bytes.

The model is a trie of byte contexts of up to five bytes, trained on the whole training part of the corpus. A symbol
that its longest context has not seen escapes to the next shorter one, where the symbols already ruled out are excluded
from the counts; the escape's share is estimated from the number of distinct symbols (DISCOUNT of a count each). Counts of the
longest contexts are occurrences; a shorter context counts in how many longer ones it saw a symbol. Texts are their
lower-cased UTF-8 bytes and an end mark.

What the probability of a symbol after five bytes needs of the trie is decided by those six bytes alone, so the work
splits by six-byte grams: (1) each task reduces its texts to blocks of distinct grams and words with counts; (2) all
blocks' entries meet by the last three context bytes, which hold the contexts of five, four and three bytes entirely,
while the shorter ones are a table of at most 256**3 entries; each gram gets its code length and each word its count;
(3) these return to their blocks, and each text adds up its own. No model is collected or broadcast whole; a task holds
one block of texts or one bucket of entries. Words are told apart by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, fold_of, mix64, table, text_bytes, word_hashes

ORDER, DISCOUNT = 5, 0.3
#: Bytes that UTF-8 never has: before a text and at its end.
BEFORE, END = 0xFF, 0xFE
#: Bytes of text in a block, and in a piece of a block that is worked on at once.
BLOCK, PIECE = 48 << 20, 2 << 20
#: Fixed key of the end token among the word hashes.
END_WORD = np.uint64(0x5EED5EED5EED5EED)
#: Each pass knows how many blocks there are from the input's partitions; buckets per partition, 16 in all at least.
BUCKETS = 2


def pack(x: np.ndarray) -> bytes:
    """Ascending 64-bit values, as compressed differences laid out by byte."""
    gaps = np.diff(x, prepend=x.dtype.type(0))
    return zstandard.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    return np.cumsum(np.ascontiguousarray(raw.reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Lookup:
    """Values by key: a direct table for most keys, binary search for those that share a slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.bits = keys, values, max(8, int(len(keys)).bit_length() + 2)
        self.slots = np.zeros(1 << self.bits, np.int32)
        self.slots[self.slot(keys)] = np.arange(len(keys))

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, all of which are held."""
        at = self.slots[self.slot(keys)]
        other = np.flatnonzero(self.keys[at] != keys)
        at[other] = np.searchsorted(self.keys, keys[other])
        return self.values[at]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in a row, each with its marks, and where each starts."""
    before, end = bytes([BEFORE]) * ORDER, bytes([END])
    raw = np.frombuffer(b"".join([x for t in texts for x in (before, t.translate(LOWER), end)]), np.uint8)
    return raw, np.cumsum([0, *[len(t) + ORDER + 1 for t in texts]])[:-1]


def grams(raw: np.ndarray) -> np.ndarray:
    """At each byte, it and the five before it as one number; the first five places are left out."""
    wide = raw.astype(np.uint64)
    out = wide[: len(raw) - ORDER]
    for k in range(1, ORDER + 1):
        out = (out << np.uint64(8)) | wide[k : len(raw) - ORDER + k]
    return out


def words_of(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and starts; marks part words, as white space does."""
    return word_hashes(np.where(raw >= END, 0x20, raw).astype(np.uint8))


def pieces(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= PIECE):
            size += len(texts[to])
            to += 1
        yield at, to
        at = to


class Level:
    """Contexts of one length: grams (context and symbol) with counts, and per context the total, the distinct symbols, and what they take of the next shorter context."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shorter: Level | None):
        self.keys, self.counts = keys, counts.astype(float)
        context = keys >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(keys) else np.zeros(0, int)
        self.contexts = context[first]
        self.total = np.add.reduceat(self.counts, first) if len(keys) else np.zeros(0)
        self.distinct = np.diff(np.append(first, len(keys))).astype(float)
        self.taken = np.zeros(len(first))
        if shorter is not None and len(keys):
            self.taken = np.add.reduceat(shorter.counts[np.searchsorted(shorter.keys, suffix(keys, shorter))], first)


def suffix(keys: np.ndarray, shorter: Level) -> np.ndarray:
    return keys & np.uint64(shorter.mask)


def levels_of(keys: np.ndarray, counts: np.ndarray, top: int, low: list[Level]) -> list[Level]:
    """Levels low (orders 0 upward) with the longer ones up to top, from the grams of order top."""
    found = {top: (keys, counts)}
    for k in range(top - 1, len(low) - 1, -1):
        found[k] = np.unique(found[k + 1][0] & np.uint64((1 << 8 * (k + 1)) - 1), return_counts=True)
    out = list(low)
    for k in range(len(low), top + 1):
        level = Level(*found[k], out[-1] if out else None)
        level.mask = (1 << 8 * (k + 1)) - 1
        out.append(level)
    return out


def at_keys(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), int), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def log_probability(keys: np.ndarray, levels: list[Level]) -> np.ndarray:
    """log10 of each gram's symbol after its context, by escape and exclusion."""
    score, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    out_total, out_distinct = np.zeros(len(keys)), np.zeros(len(keys))
    for level in reversed(levels):
        own = keys & np.uint64(level.mask)
        c, known = at_keys(level.contexts, own >> np.uint64(8))
        g, seen = at_keys(level.keys, own)
        total = np.where(known, level.total[c] if len(level.contexts) else 0, 0) - out_total
        distinct = np.where(known, level.distinct[c] if len(level.contexts) else 0, 0) - out_distinct
        hit, miss = open_ & known & seen, open_ & known & ~seen & (distinct > 0)
        score[hit] += np.log10((level.counts[g[hit]] - DISCOUNT) / total[hit])
        score[miss] += np.log10(DISCOUNT * distinct[miss] / total[miss])
        open_ &= ~hit
        out_total = np.where(known, level.taken[c] if len(level.contexts) else 0, 0)
        out_distinct = np.where(known, level.distinct[c] if len(level.contexts) else 0, 0)
    score[open_] -= np.log10(np.maximum(256 - out_distinct[open_], 1))
    return score


def reduce_blocks(docs: DataFrame, train: Column, buckets: int) -> DataFrame:
    """Pass 1. Rows of three kinds: a piece of a block's texts (bucket -1), a bucket of its grams (0 to buckets - 1), a bucket of its words (from buckets on)."""
    chosen = docs.select(F.col("doc_id"), train.alias("_train"), text_bytes().alias("_text"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    schema = f"block long, bucket int, keys binary, counts binary, fours array<long>, ids array<{kind}>, trains binary, lengths binary, texts binary"
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(chosen.schema["doc_id"].dataType)
    out = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("fours", pa.list_(pa.int64())), ("ids", pa.list_(id_type)), ("trains", pa.binary()), ("lengths", pa.binary()), ("texts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 20
        gram_parts, word_parts, size = [], [], 0

        def row(**columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([columns.get(f.name)], f.type) for f in out], schema=out)

        def close() -> Iterator[pa.RecordBatch]:
            g, n = summed(np.concatenate([x for x, _ in gram_parts]), np.concatenate([x for _, x in gram_parts]))
            w, m = summed(np.concatenate([x for x, _ in word_parts]), np.concatenate([x for _, x in word_parts]))
            context = (g >> np.uint64(8)) & np.uint64(0xFFFFFF)
            fours = np.unique(g[n > 0] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            for at, (keys, counts, where) in enumerate(((g, n, mix64(context)), (w, m, mix64(w)))):
                where = (where % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                edges = np.searchsorted(where[order], np.arange(buckets + 1))
                for b in range(buckets):
                    mine = order[edges[b] : edges[b + 1]]
                    if len(mine):
                        yield row(block=block, bucket=b + at * buckets, keys=pack(keys[mine]), counts=zstandard.compress(counts[mine].astype(np.uint64).tobytes(), 1), fours=fours if not at and b == where[order[0]] else None)

        for batch in batches:
            ids, trains, texts = batch.column(0), np.asarray(batch.column(1).to_pylist(), bool), batch.column(2).to_pylist()
            for a, b in pieces(texts):
                raw, starts = joined(texts[a:b])
                learn = np.repeat(trains[a:b], np.diff(np.append(starts, len(raw))))
                g, keep = grams(raw), raw[ORDER:] != BEFORE
                for of, one in ((True, 1), (False, 0)):
                    keys, n = np.unique(g[keep & (learn[ORDER:] == of)], return_counts=True)
                    gram_parts.append((keys, n.astype(np.int64) * one))
                w, at = words_of(raw)
                for of, one in ((True, 1), (False, 0)):
                    keys, n = np.unique(np.concatenate([w[learn[at] == of], np.repeat(END_WORD, (trains[a:b] == of).sum())]), return_counts=True)
                    word_parts.append((keys, n.astype(np.int64) * one))
                yield row(block=block, bucket=-1, ids=ids.slice(a, b - a).to_pylist(), trains=trains[a:b].tobytes(), lengths=np.array([len(t) for t in texts[a:b]], np.int64).tobytes(), texts=zstandard.compress(b"".join(texts[a:b]), 3))
                size += len(raw)
                if len(gram_parts) >= 16:  # what is held stays near the block's distinct entries
                    gram_parts = [summed(np.concatenate([x for x, _ in gram_parts]), np.concatenate([x for _, x in gram_parts]))]
                    word_parts = [summed(np.concatenate([x for x, _ in word_parts]), np.concatenate([x for _, x in word_parts]))]
                if size >= BLOCK:
                    yield from close()
                    gram_parts, word_parts, size, block = [], [], 0, block + 1
        if gram_parts:
            yield from close()

    return chosen.mapInArrow(run, schema)


def short_levels(fours: np.ndarray, counts: np.ndarray) -> list[Level]:
    """Orders 0 to 2 from the three-byte grams and the number of four-byte grams that end in each."""
    return levels_of(fours.astype(np.uint64), counts, 2, [])


def ppm_scores(docs: DataFrame, train: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of docs; train: a condition on doc_id, null as false.

    Null texts are empty and score their end mark. Without training rows every count is zero: scores are those of
    uniform bytes, base_score that of an empty vocabulary. Repeated rows give repeated rows; other columns are left
    out; an empty table gives none. A text is held whole by one task.
    """
    spark = docs.sparkSession
    buckets = max(16, BUCKETS * docs.rdd.getNumPartitions())
    blocks = cut(reduce_blocks(docs, F.coalesce(train, F.lit(False)), buckets), "ppm-blocks")
    three = F.col("four").bitwiseAND(0xFFFFFF)
    low = blocks.filter(F.col("fours").isNotNull()).select(F.explode("fours").alias("four")).distinct().groupBy(three.alias("three")).count().orderBy("three").toPandas()  # 256**3 rows at most
    sent = spark.sparkContext.broadcast((low["three"].to_numpy(np.int64), low["count"].to_numpy(np.int64)))

    def rate(group: pa.Table) -> pa.Table:
        keys = [unpack(x.as_py()) for x in group["keys"]]
        counts = [np.frombuffer(zstandard.decompress(x.as_py()), np.uint64) for x in group["counts"]]
        all_keys, all_counts = summed(np.concatenate(keys), np.concatenate(counts))
        bucket = group["bucket"][0].as_py()
        blocks_ = group["block"].to_pylist()
        total = distinct = 0
        if bucket < buckets:
            seen = all_counts > 0
            values = log_probability(all_keys, levels_of(all_keys[seen], all_counts[seen], ORDER, short_levels(*sent.value))).astype(np.float32)
        else:
            values = all_counts
            total, distinct = int(all_counts.sum()), int((all_counts > 0).sum())
        back = [zstandard.compress(values[np.searchsorted(all_keys, k)].tobytes(), 1) for k in keys]
        n = len(keys)
        return pa.table({"block": pa.array(blocks_, pa.int64()), "bucket": pa.array([bucket] * n, pa.int32()), "keys": group["keys"], "values": pa.array(back, pa.binary()), "total": pa.array([total] + [0] * (n - 1), pa.int64()), "distinct": pa.array([distinct] + [0] * (n - 1), pa.int64())})

    entries = blocks.filter("bucket >= 0").select("block", "bucket", "keys", "counts")
    rated = cut(entries.groupBy("bucket").applyInArrow(rate, "block long, bucket int, keys binary, values binary, total long, distinct long"), "ppm-rated")
    sums = rated.agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    n_train, n_distinct = int(sums["n"]), int(sums["v"])
    texts = blocks.filter("bucket = -1").select("block", "ids", "trains", "lengths", "texts")
    id_type = blocks.schema["ids"].dataType.elementType
    from pyspark.sql.pandas.types import to_arrow_type

    arrow_id = to_arrow_type(id_type)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        def lookup(of_words: bool) -> Lookup:
            rows = [(unpack(k.as_py()), zstandard.decompress(v.as_py())) for b, k, v in zip(right["bucket"], right["keys"], right["values"], strict=True) if (b.as_py() >= buckets) == of_words]
            keys, values = np.concatenate([k for k, _ in rows]), np.concatenate([np.frombuffer(v, np.uint64 if of_words else np.float32) for _, v in rows])
            order = np.argsort(keys)
            return Lookup(keys[order], values[order])

        gram_value, word_count = lookup(False), lookup(True)
        ids, columns = [], []
        end_count = int(word_count(np.array([END_WORD]))[0])
        for i, t, n, x in zip(left["ids"], left["trains"], left["lengths"], left["texts"], strict=True):
            lengths, whole = np.frombuffer(n.as_py(), np.int64), zstandard.decompress(x.as_py())
            ends = np.cumsum(lengths)
            raw, starts = joined([whole[e - k : e] for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)])
            value = np.zeros(len(raw))
            place = np.flatnonzero(raw[ORDER:] != BEFORE)
            value[place + ORDER] = gram_value(grams(raw)[place])
            words, at = words_of(raw)
            c = word_count(words).astype(float)
            doc = np.searchsorted(starts, at, "right") - 1
            base = np.bincount(doc, np.log10((c + 0.5) / (n_train + 0.5 * (n_distinct + 1))), len(starts)) + np.log10((end_count + 0.5) / (n_train + 0.5 * (n_distinct + 1)))
            known = np.bincount(doc, c > 0, len(starts)).astype(np.int64) + (end_count > 0)
            ids += i.as_py()
            columns.append((~np.frombuffer(t.as_py(), bool), np.bincount(doc, minlength=len(starts)) + 1, known, base, np.add.reduceat(value, starts)))
        held, tokens, known, base, total = (np.concatenate(x) for x in zip(*columns, strict=True))
        return pa.table({"doc_id": pa.array(ids, arrow_id), "held_out": pa.array(held), "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(ids), n_train, np.int64)), "base_score": pa.array(base), "score": pa.array(total)})

    return texts.groupBy("block").cogroup(rated.select("block", "bucket", "keys", "values").groupBy("block")).applyInArrow(score, f"doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_ppm_scores(spark, sf_dir: str) -> DataFrame:
    return ppm_scores(table(spark, sf_dir, "documents"), fold_of() != 1)
