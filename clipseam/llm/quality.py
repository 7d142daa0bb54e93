"""Quality rules: fixed counts of a text, and a hashed n-gram logistic regression with calibrated probability.

Features are hashed counts of words, word pairs and character 3- and 4-grams, taken as a unit vector. The regression is fitted on a
bounded sample of the labelled rows (SAMPLE of each label, those of the lowest hashed ids), each label weighing as all
its rows do; a quarter of the sample is kept apart to calibrate the probability by a logistic curve. Scoring runs in
Arrow batches; the thresholds are fixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fit_curve, mix64, table, text_bytes, word_hashes

DIMENSIONS, SAMPLE = 1 << 14, 1500
KEEP_FROM = 0.5
LEAST_WORDS, MOST_REPEATED = 50, 50
#: The symbols that are counted.
SYMBOLS = b"#*$%&|<>"


def features(text: bytes) -> np.ndarray:
    """Hashed counts of words, word pairs and character 3- and 4-grams, scaled to a unit vector; zero for an empty text."""
    raw = np.frombuffer(text, np.uint8)
    words = word_hashes(raw)[0]
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    pairs = mix64(words[:-1] * np.uint64(3) + words[1:])
    slots = [(words >> shift).astype(np.int64), (pairs >> shift).astype(np.int64)]
    wide = raw.astype(np.uint32) if text.isascii() else np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
    if len(wide) >= 4:
        # Grams as polynomials modulo 2**32 in the code points, of which the upper bits are taken.
        odd = np.uint32(0x9E3779B1)
        three = (wide[:-2] * odd + wide[1:-1]) * odd + wide[2:]
        four = three[:-1] * odd + wide[3:]
        small = np.uint32(32 - DIMENSIONS.bit_length() + 1)
        slots += [((three * np.uint32(0x85EBCA6B)) >> small).astype(np.int64), ((four * np.uint32(0xC2B2AE35)) >> small).astype(np.int64)]
    counts = np.sqrt(np.bincount(np.concatenate(slots), minlength=DIMENSIONS).astype(np.float32))
    norm = np.sqrt((counts * counts).sum())
    return counts / norm if norm else counts


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.split()
    raw = np.frombuffer(text, np.uint8)
    chars = int(np.count_nonzero(((raw & 0xC0) != 0x80) & ~SPACE[raw]))
    lines = [x for x in text.split(b"\n") if x.split()]
    repeated = 0
    if len(words) >= 4:
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)[1] if len(numbers) >= 1 << 21 else ids[:-1] * len(numbers) + ids[1:]
        _, inverse, times = np.unique(pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
        often = times[inverse] > 1
        covered = np.zeros(len(words), bool)
        for d in range(3):
            covered[d : len(often) + d] |= often
        repeated = int(covered.sum())
    return len(words), chars, sum(text.count(bytes([c])) for c in SYMBOLS), len(lines) - len(set(lines)), repeated


@dataclass
class QualityModel:
    """Weights over DIMENSIONS hashed features, a bias, and the curve that calibrates; without weights nothing is judged."""

    weights: np.ndarray | None = None
    bias: float = 0.0
    curve: tuple[float, float] = (1.0, 0.0)

    def probability(self, text: bytes) -> float | None:
        if self.weights is None:
            return None
        z = self.curve[0] * (float(features(text) @ self.weights) + self.bias) + self.curve[1]
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by accelerated gradient steps; rows of x are unit vectors, weights have mean one."""
    w, v, b, c = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 0.0, 0.0
    step = 1 / (0.5 * float(weight.max()) + penalty)
    for k in range(1, rounds + 1):
        error = (weight * (1 / (1 + np.exp(-(x @ v + c))) - y)).astype(np.float32)
        new_w, new_b = v - step * (x.T @ error / len(y) + penalty * v), c - step * float(error.mean())
        momentum = (k - 1) / (k + 2)
        v, c = new_w + momentum * (new_w - w), new_b + momentum * (new_b - b)
        w, b = new_w, new_b
    return w, b


def fit(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """docs: doc_id, text; labels: doc_id, quality (0 or 1; null is left out). At most 2 * SAMPLE feature rows reach the driver.

    With one label only there is no model. Of rows that repeat an id and label one counts, that of the smallest text.
    """
    spark = docs.sparkSession
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") > 0).cast("int").alias("quality")).distinct()
    totals = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    if len(totals) < 2:
        return QualityModel()
    sample = [known.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect() for q in (0, 1)]
    chosen = spark.createDataFrame([(r["doc_id"], r["quality"]) for rows in sample for r in rows], known.select(F.col("doc_id").alias("_id"), "quality").schema)
    picked = docs.select("doc_id", text_bytes().alias("_text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    picked = picked.groupBy("doc_id", "quality").agg(F.min("_text").alias("_text")).select("quality", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(4)).cast("int").alias("fold"), F.xxhash64("doc_id").alias("order"), "_text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [features(t.as_py()) for t in batch.column(3)]
            slots = [np.flatnonzero(v) for v in vectors]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([s.astype(np.uint16).tobytes() for s in slots], pa.binary()), pa.array([v[s].tobytes() for v, s in zip(vectors, slots, strict=True)], pa.binary())], names=["quality", "fold", "order", "slots", "values"])

    rows = sorted(picked.mapInArrow(extract, "quality int, fold int, order long, slots binary, values binary").collect(), key=lambda r: (r["order"], r["quality"], r["slots"], r["values"]))
    if len({r["quality"] for r in rows}) < 2:
        return QualityModel()
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(r["slots"], np.uint16)] = np.frombuffer(r["values"], np.float32)
    y, fold = np.array([r["quality"] for r in rows], float), np.array([r["fold"] for r in rows])
    share = {q: totals[q] / max(1, (y == q).sum()) for q in (0, 1)}
    weight = np.where(y == 1, share[1], share[0])
    weight /= weight.mean()
    held = fold == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    del rows
    w, b = fit_logistic(x[~held] if held.any() else x, y[~held], weight[~held])
    model = QualityModel(w, b)
    if held.any():
        model.curve = fit_curve((x[held] @ w + b).astype(float), y[held], weight[held])
    return model


def judge_quality(docs: DataFrame, model: QualityModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """A row per row of docs: doc_id, the counts, base_failed, probability (of label 1; null without a model) and kept.

    Null text: empty, so no words, and base_failed. A text of any length is counted and scored whole. Repeated rows give repeated rows; other columns are left out; an
    empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers
    chosen = docs.select("doc_id", text_bytes().alias("_text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = sent.value
        for batch in batches:
            found, failed, likely = [], [], []
            for text in batch.column(1):
                text = text.as_py()
                found.append(counts(text))
                failed.append(found[-1][0] < LEAST_WORDS or 100 * found[-1][4] > MOST_REPEATED * found[-1][0])
                likely.append(work.probability(text))
            kept = [not f and (p is None or p >= keep_from) for f, p in zip(failed, likely, strict=True)]
            columns = np.array(found, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(columns[:, i]) for i in range(5)], pa.array(failed, pa.bool_()), pa.array(likely, pa.float64()), pa.array(kept, pa.bool_())], names=["doc_id", *names, "base_failed", "probability", "kept"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{n} long' for n in names)}, base_failed boolean, probability double, kept boolean")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, fit(docs, table(spark, sf_dir, "labels")))
