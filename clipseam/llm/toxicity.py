"""Toxicity from the nearest labelled examples.

Terms are words, and the first STEMS letters of longer words, told apart by whether a text has them once, twice, three or
five times. Every term of the examples is indexed. A text is a TF-IDF vector over these terms; a term's idf is raised by
how far it stands in more toxic training rows than chance explains (the signed root of its log-likelihood ratio), and
no term's weight is zero (plain idf is an option). The index is inverted, with the examples in blocks and each term's largest weight per block: a
query bounds every block's cosine from above, visits blocks from the highest bound down, and stops when the next bound
cannot reach its k-th best; so the k nearest are exact. Ties at the k-th place all vote. Votes weigh by closeness and by
the rows that an example of its label stands for, are smoothed by the base rate, and a logistic curve fitted on
leave-one-out votes calibrates them. The nearest examples' ids are the evidence.

The classifier is fitted on a bounded sample: the SAMPLE labelled training rows of the lowest hashed ids give the terms'
statistics, near copies among them counted once, and EXAMPLES rows of each label the index.
"""

from __future__ import annotations

import math
import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_carry, cut, fit_curve, fold_of, held, table

NEIGHBOURS, SAMPLE, EXAMPLES, BLOCK = 9, 24_000, 512, 256
STEMS, LEVELS = (4, 6), (1, 2, 3, 5)
#: Of indexes larger than four blocks: examples in a block. A visit's own cost is what counts in small ones; in larger ones only smaller blocks have bounds that let them be passed over.
FINE = 64
#: The part of the idf that every term has; deviations from equal shares that chance explains; blocks of BLOCK examples visited at a time.
FLOOR, CHANCE, VISIT = 0.02, 3.0, 2
#: Words that a process remembers.
WORDS = 120_000
FIND = re.compile(r"[^\W\d_]+").findall


def terms_of(text: str) -> dict[str, int]:
    """All terms of a text: words with their counts; stems as 'stem*level', once each."""
    words = Counter(FIND(text.lower()))
    stems: Counter = Counter()
    for w, n in words.items():
        for k in STEMS:
            if len(w) > k:
                stems[w[:k]] += n
    return dict(words) | {f"{s}*{level}": 1 for s, n in stems.items() for level in LEVELS if n >= level}


def copy_key(text: str) -> int:
    """The smallest hash of two words in a row; near copies mostly share it."""
    words = FIND(text.lower())
    return min((zlib.crc32(f"{a} {b}".encode()) for a, b in {*zip(words, words[1:], strict=False)}), default=zlib.crc32(" ".join(words).encode()))


def term_weights(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int, lean: bool = True) -> np.ndarray:
    """Of terms in so many toxic and clean rows: the idf, with lean raised by the root of the log-likelihood ratio beyond CHANCE where the term leans to toxic rows."""
    n, rows = n_toxic + n_clean, toxic + clean
    if not lean:
        return np.log((1 + n) / (1 + rows)) + 1

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))

    ratio = 2 * (part(toxic, rows * n_toxic / n) + part(clean, rows * n_clean / n) + part(n_toxic - toxic, (n - rows) * n_toxic / n) + part(n_clean - clean, (n - rows) * n_clean / n))
    raised = np.where(toxic * n_clean > clean * n_toxic, np.sqrt(np.maximum(ratio, 0)), 0)
    return (np.log((1 + n) / (1 + rows)) + 1) * (FLOOR + np.maximum(raised - CHANCE, 0))


class TermFinder(dict):
    """The terms of texts as numbers; as a dict it remembers the numbers of each word met and of its stems, within bounds."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = terms
        self.stems: dict[str, int] = {}
        rows: list[list[int]] = []
        for t, i in terms.items():
            stem, star, level = t.partition("*")
            if star:
                if stem not in self.stems:
                    self.stems[stem] = len(rows)
                    rows.append([-1] * len(LEVELS))
                rows[self.stems[stem]][LEVELS.index(int(level))] = i
        self.levels = np.array(rows, np.int64).reshape(-1, len(LEVELS))
        self.numbers = np.zeros((WORDS, 1 + len(STEMS)), np.int32)

    def __missing__(self, word: str) -> int:
        """The word's row in numbers: its own term, then its stems; -1 for none."""
        row = len(self)
        self.numbers[row] = [self.terms.get(word, -1), *[self.stems.get(word[:k], -1) if len(word) > k else -1 for k in STEMS]]
        self[word] = row
        return row

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The known terms of a text, and 1 + log of their counts."""
        words = Counter(FIND(text.lower()))
        if len(self) + len(words) > len(self.numbers):
            self.clear()
            if len(words) > len(self.numbers):
                self.numbers = np.zeros((2 * len(words), 1 + len(STEMS)), np.int32)
        found = self.numbers[np.fromiter(map(self.__getitem__, words), np.int64, len(words))]
        n = np.fromiter(words.values(), float, len(words))
        known, stems = found[:, 0] >= 0, found[:, 1:] >= 0
        which, inverse = np.unique(found[:, 1:][stems], return_inverse=True)
        times = np.bincount(inverse, np.broadcast_to(n[:, None], stems.shape)[stems], len(which))
        levels = self.levels[which]
        levels = levels[(levels >= 0) & (times[:, None] >= np.array(LEVELS))]
        return np.concatenate([found[known, 0], levels]), np.concatenate([1 + np.log(n[known]), np.ones(len(levels))])


@dataclass
class NearestExamples:
    """The k nearest of weighted sparse vectors, by block-max search. vectors: term numbers and values of each example; share: rows that an example stands for."""

    ids: list
    labels: np.ndarray
    vectors: list[tuple[np.ndarray, np.ndarray]]
    terms: dict[str, int]
    weights: np.ndarray
    base: float = 0.0
    share: np.ndarray | None = None
    curve: tuple[float, float] | None = None
    k: int = NEIGHBOURS
    memory: dict = field(default_factory=dict)
    visited: int = 0

    def __post_init__(self):
        # Examples with the same leading terms stand near each other, so that blocks have tight bounds.
        lead = [tuple(t[np.lexsort((t, -w))[:3]].tolist()) for t, w in self.vectors]
        order = sorted(range(len(self.vectors)), key=lambda i: (lead[i], str(self.ids[i])))
        self.ids, self.labels, self.vectors = [self.ids[i] for i in order], self.labels[order], [self.vectors[i] for i in order]
        self.share = np.ones(len(order)) if self.share is None else self.share[order]
        self.size = BLOCK if len(order) <= 4 * BLOCK else FINE
        self.blocks = -(-len(order) // self.size)
        self.open()

    def open(self) -> None:
        """The inverted index: postings by block and term, and each term's largest weight per block."""
        lengths = [len(t) for t, _ in self.vectors]
        example = np.repeat(np.arange(len(lengths)), lengths)
        term = np.concatenate([np.zeros(0, np.int64), *[t for t, _ in self.vectors]])
        value = np.concatenate([np.zeros(0), *[w for _, w in self.vectors]])
        slot = (example // self.size) * len(self.terms) + term
        order = np.argsort(slot, kind="stable")
        self.place, self.value = example[order], value[order]
        self.begin = np.searchsorted(slot[order], np.arange(self.blocks * len(self.terms) + 1)).astype(np.int32)
        self.top = np.zeros((len(self.terms), self.blocks), np.float32)
        np.maximum.at(self.top, (term, example // self.size), np.nextafter(value.astype(np.float32), np.float32(2)))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("place", "value", "begin", "top", "finder")} | {"memory": {}}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.open()

    def nearest(self, terms: np.ndarray, values: np.ndarray, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest with a common term, ties at the end included; without: an example to leave out."""
        bound = (values[:, None] * self.top[terms]).sum(0) * (1 + 1e-6)
        order, at, cos, least = np.argsort(-bound, kind="stable"), np.zeros(0, np.int64), np.zeros(0), 0.0
        visit = VISIT * BLOCK // self.size
        for k in range(0, len(order), visit):
            chosen = order[k : k + visit]
            chosen = chosen[(bound[chosen] > 0) & (bound[chosen] >= least - 1e-9)]
            if not len(chosen):
                break
            self.visited += len(chosen)
            slots = (chosen[:, None] * len(self.terms) + terms).ravel()
            first = self.begin[slots]
            n = self.begin[slots + 1] - first
            own = np.flatnonzero(n)
            first, n = first[own], n[own]
            posting = np.repeat(first - np.cumsum(n) + n, n)
            posting += np.arange(len(posting), dtype=posting.dtype)
            sums = np.bincount(self.place[posting], np.repeat(values[own % len(values)], n) * self.value[posting], len(self.ids))
            if without >= 0:
                sums[without] = 0
            hit = np.flatnonzero(sums > 0)
            at, cos = np.append(at, hit), np.append(cos, sums[hit])
            if len(cos) >= self.k:
                least = float(np.partition(cos, len(cos) - self.k)[len(cos) - self.k])
        keep = cos >= least - 1e-9
        at, cos = at[keep], cos[keep]
        order = np.lexsort((at, -cos.round(9)))
        return at[order], cos[order]

    def vote(self, terms: np.ndarray, values: np.ndarray, without: int = -1) -> tuple[float, np.ndarray]:
        at, cos = self.nearest(terms, values, without)
        weight = self.share[at] / (1.05 - np.minimum(cos, 1))
        return (float((weight * self.labels[at]).sum()) + self.base) / (float(weight.sum()) + 1), at

    def calibrate(self) -> None:
        """Fits the curve on what each of the (at most two times EXAMPLES) examples' votes are without itself; needs both labels."""
        if len({*self.labels.tolist()}) < 2:
            return
        votes = np.array([self.vote(*v, i)[0] for i, v in enumerate(self.vectors)]).clip(1e-6, 1 - 1e-6)
        self.curve = fit_curve(np.log(votes / (1 - votes)), self.labels, self.share)

    def unit(self, terms: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = times * self.weights[terms]
        return terms, values / math.sqrt(float(values @ values))

    def score(self, text: str) -> tuple[float, list]:
        """A text's calibrated score, and the ids of its three nearest examples; the base rate for a text without a term of theirs."""
        if "finder" not in self.__dict__:
            self.finder = TermFinder(self.terms)
        terms, times = self.finder.counts(text)
        if not len(terms):
            return self.base, []
        key = hash((terms.tobytes(), times.tobytes()))
        if key not in self.memory:
            if len(self.memory) > 5_000:
                self.memory.clear()
            vote, at = self.vote(*self.unit(terms, times))
            if self.curve:
                vote = min(max(vote, 1e-6), 1 - 1e-6)
                vote = 1 / (1 + math.exp(-max(-50.0, min(50.0, self.curve[0] * math.log(vote / (1 - vote)) + self.curve[1]))))
            self.memory[key] = (vote, [self.ids[i] for i in at[:3]])
        return self.memory[key]


def fit(docs: DataFrame, labels: DataFrame, train: Column, lean: bool = True) -> NearestExamples:
    """docs: doc_id, text; labels: doc_id, toxic (0 or 1; rows with null are left out). train: a condition on doc_id. lean: term_weights() learn from labels; without, neighbours are those of plain TF-IDF.

    A document with several labels counts once for each; of rows that repeat an id and label one counts, that of the smallest text. What reaches the
    driver: SAMPLE ids, and the terms of the examples with their statistics.
    """
    spark = docs.sparkSession
    marked = labels.filter(train & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    marked = marked.join(docs.select(F.col("doc_id").alias("_d")).distinct(), F.col("_id") == F.col("_d"), "left_semi")
    drawn = marked.orderBy(F.xxhash64("_id"), "_id", "toxic").limit(SAMPLE).collect()
    marked = F.broadcast(spark.createDataFrame(sorted({(r["_id"], r["toxic"]) for r in drawn}), marked.schema))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(marked, F.col("doc_id") == F.col("_id"))
    rows = rows.groupBy(F.col("doc_id").cast("string").alias("doc_id"), "toxic").agg(F.min("text").alias("text"))  # SAMPLE rows at most

    def mark_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([copy_key(t.as_py()) for t in batch.column(2)], pa.int64())], names=["doc_id", "toxic", "text", "copy"])

    rows = cut(rows.mapInArrow(mark_copies, "doc_id string, toxic int, text string, copy long"), "labelled")
    # One of near copies: the others would make all its words look significant.
    first = F.struct(F.xxhash64("doc_id").alias("hash"), "doc_id")
    chosen = rows.groupBy("toxic", "copy").agg(F.min(first).alias("f")).select("toxic", F.col("copy").alias("_copy"), F.col("f.hash").alias("hash"), F.col("f.doc_id").alias("_doc"))
    chosen = cut(chosen, "chosen")
    n = {r["toxic"]: r["count"] for r in chosen.groupBy("toxic").count().collect()}
    n_toxic, n_clean = n.get(1, 0), n.get(0, 0)
    base = n_toxic / max(1, n_toxic + n_clean)
    if not n_toxic or not n_clean:
        return NearestExamples([], np.zeros(0), [], {}, np.zeros(0), base)
    indexed = [r["_doc"] + f" {y}" for y in (0, 1) for r in chosen.filter(F.col("toxic") == y).orderBy("hash", "_doc", "_copy").limit(EXAMPLES).collect()]
    # Rows of one id and label that differ in text share a copy key only as near copies; repeated ones fall together.
    alone = rows.join(F.broadcast(chosen.select(F.col("toxic").alias("_toxic"), "_copy", "_doc")), (F.col("toxic") == F.col("_toxic")) & (F.col("copy") == F.col("_copy")) & (F.col("doc_id") == F.col("_doc")))
    alone = alone.groupBy("toxic", "copy").agg(F.min("doc_id").alias("doc_id"), F.min("text").alias("text")).select("doc_id", "toxic", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([n * (k[1] == 1) for k, n in found.items()], pa.int64()), pa.array([n * (k[1] == 0) for k, n in found.items()], pa.int64())], names=["term", "a", "b"])

        for batch in batches:
            for label, text in zip(batch.column(1), batch.column(2), strict=True):
                y = label.as_py()
                found.update((t, y) for t in terms_of(text.as_py()))
                if len(found) > 200_000:
                    yield flush()
                    found.clear()
        yield flush()

    alone = cut(alone, "examples")
    terms = alone.mapInArrow(count, "term string, a long, b long").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))

    def vectors_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [terms_of(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([[*c] for c in found], pa.list_(pa.string())), pa.array([[*c.values()] for c in found], pa.list_(pa.int64()))], names=["doc_id", "toxic", "terms", "counts"])

    picked = alone.filter(F.concat_ws(" ", "doc_id", "toxic").isin(indexed)).mapInArrow(vectors_of, "doc_id string, toxic int, terms array<string>, counts array<long>")
    taken = sorted(picked.collect(), key=lambda r: (r["toxic"], r["doc_id"]))
    counts = [dict(zip(r["terms"], r["counts"], strict=True)) for r in taken]
    held_terms = spark.createDataFrame(pa.table({"_term": pa.array(sorted({t for c in counts for t in c}), pa.string())}))
    known = terms.join(held_terms, F.col("term") == F.col("_term")).select("term", "a", "b").toArrow().sort_by("term")
    names = {t: i for i, t in enumerate(known["term"].to_pylist())}
    weights = term_weights(np.asarray(known["a"], float), np.asarray(known["b"], float), n_toxic, n_clean, lean)
    labels_ = np.array([r["toxic"] for r in taken], float)
    share = np.where(labels_ > 0, n_toxic / max(1, labels_.sum()), n_clean / max(1, (1 - labels_).sum()))
    vectors, keep = [], []
    for i, c in enumerate(counts):
        if c:
            at, times = np.array([names[t] for t in c], np.int64), np.array([1 + math.log(k) for k in c.values()])
            values = times * weights[at]
            vectors.append((at, values / math.sqrt(float(values @ values))))
            keep.append(i)
    model = NearestExamples([taken[i]["doc_id"] for i in keep], labels_[keep], vectors, names, weights, base, share[keep] / share[keep].mean() if keep else None)
    model.calibrate()
    return model


def score_toxicity(docs: DataFrame, model: NearestExamples, threshold: float = 0.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: doc_id, score (0 to 1), predicted (1 if score >= threshold), evidence, the columns in carry.

    Null and empty texts, and texts without any term of the examples, get the base rate of the training rows, as every text does
    without both labels in training. A text of any length is scored whole. Repeated rows give repeated rows; extra columns
    are left out unless carried; an empty table gives none.
    """
    check_carry(carry, ("doc_id", "score", "predicted", "evidence"))
    token = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(model)  # twice EXAMPLES vectors at most
    # The text travels once, also when it is carried.
    chosen = docs.select("doc_id", *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry) if c != "text"], F.col("text").alias("_text"))
    kept = [f for f in chosen.schema.fields if f.name != "_text" or "text" in carry]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "score double, predicted int, evidence array<string>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = held(("toxicity", token), lambda: sent.value)
        for batch in batches:
            found = [work.score(t.as_py() or "") for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= threshold) for s, _ in found], pa.int32()), pa.array([e for _, e in found], pa.list_(pa.string()))], names=[*[f.name for f in kept], "score", "predicted", "evidence"])

    return chosen.mapInArrow(run, schema).select("doc_id", *[F.col("_text" if c == "text" else f"_carry_{i}").alias(c) for i, c in enumerate(carry)], "score", "predicted", "evidence")


def toxic_nearest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fits on the labelled rows whose fold isn't 0 and scores every row of docs; adds held_out (fold 0)."""
    model = fit(docs, labels, fold_of() != 0)
    return score_toxicity(docs, model).select("doc_id", (fold_of() == 0).alias("held_out"), "score", "predicted", "evidence")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxic_nearest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
