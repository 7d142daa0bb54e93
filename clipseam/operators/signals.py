"""Signals of a case: appearance, structure and motion at the boundary, and distances of latent tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cases import TOTAL, check_horizon

PAIRS, SPATIAL, TUBELET = 4, 256, 2
NAMES = ("prediction_error", "encoder_distance", "histogram_distance", "ssim_distance", "flow_discontinuity")


def boundary_pairs(cases: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """case_id, pair, left_path, right_path: the i-th of the last k context frames with the i-th of the first k target frames; cases with an empty side are left out."""
    k = F.least(F.lit(pairs), F.size("context_paths"), F.size("target_paths"))
    zipped = F.arrays_zip(F.slice("context_paths", -k, k).alias("left"), F.slice("target_paths", F.lit(1), k).alias("right"))
    rows = cases.filter((F.size("context_paths") > 0) & (F.size("target_paths") > 0)).select("case_id", F.posexplode(zipped).alias("pair", "z"))
    return rows.select("case_id", "pair", F.col("z.left").alias("left_path"), F.col("z.right").alias("right_path"))


def histogram_distance(left: DataFrame, right: DataFrame) -> DataFrame:
    """pair_id, histogram_distance between two histograms (pair_id, bin, weight) by Bhattacharyya; scale-free; pairs that lack a side are left out, empty weights are no distance."""
    sums = lambda x, name: x.groupBy("pair_id").agg(F.sum(F.col("weight").cast("double")).alias(name))
    shared = left.select("pair_id", "bin", F.col("weight").alias("p")).join(right.select("pair_id", "bin", F.col("weight").alias("q")), ["pair_id", "bin"])
    shared = shared.groupBy("pair_id").agg(F.sum(F.sqrt(F.col("p").cast("double") * F.col("q"))).alias("common"))
    both = sums(left, "p").join(sums(right, "q"), "pair_id").join(shared, "pair_id", "left")
    return both.select("pair_id", F.sqrt(F.greatest(1 - F.coalesce(F.try_divide(F.coalesce("common", F.lit(0.0)), F.sqrt(F.col("p") * F.col("q"))), F.lit(1.0)), F.lit(0.0))).alias("histogram_distance"))


def array_histogram_distance(p: Column, q: Column) -> Column:
    """The same for two arrays of bins in one row."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    return F.sqrt(F.greatest(1 - total(F.zip_with(p, q, lambda a, b: F.sqrt(a * b))) / F.sqrt(total(p) * total(q)), F.lit(0.0)))


def median(values: Column) -> Column:
    s, n = F.array_sort(values), F.size(values)
    return (F.element_at(s, F.floor((n + 1) / 2).cast("int")) + F.element_at(s, F.floor((n + 2) / 2).cast("int"))) / 2


def flow_discontinuity(magnitudes: Column, boundary: Column) -> Column:
    """abs(boundary - median of the others) / (median + 1e-6); without others the boundary is its own baseline. boundary: a 0-based place."""
    at = F.element_at(magnitudes, boundary.cast("int") + 1)
    others = F.filter(magnitudes, lambda x, i: i != boundary.cast("int"))
    base = F.when(F.size(others) > 0, median(others)).otherwise(at)
    return F.abs(at - base) / (base + 1e-6)


def proxy_scores(signals: DataFrame) -> DataFrame:
    """Deterministic stand-ins from the cheap signals: prediction_error, encoder_distance, and one tubelet error per two target frames."""
    h, s = F.col("histogram_distance"), F.col("ssim_distance")
    score = 0.75 * h + 0.75 * s + 0.05 * F.least(F.col("flow_discontinuity"), F.lit(10.0))
    out = signals.withColumns({"prediction_error": score, "encoder_distance": 0.65 * h + 0.35 * s})
    return out.withColumn("tubelet_errors", F.array_repeat("prediction_error", F.greatest(F.lit(1), F.floor(F.col("horizon") / TUBELET).cast("int"))))


def token_masks(horizons: DataFrame, spatial: int = SPATIAL) -> DataFrame:
    """horizon, role, token_id: context tokens come first, target tokens follow; a bad horizon is an error."""
    for r in horizons.select("horizon").distinct().limit(TOTAL).collect():
        check_horizon(r["horizon"])
    end, total = (F.floor((TOTAL - F.col("horizon")) / TUBELET) * spatial).cast("int"), TOTAL // TUBELET * spatial
    roles = F.array(F.struct(F.lit("context").alias("role"), F.sequence(F.lit(0), end - 1).alias("t")), F.struct(F.lit("target").alias("role"), F.sequence(end, F.lit(total - 1)).alias("t")))
    return horizons.select("horizon").distinct().select("horizon", F.explode(roles).alias("r")).select("horizon", "r.role", F.explode("r.t").alias("token_id"))


def once(value: Column, use) -> Column:
    """use(value) with value computed once per row, also where lambdas inside refer to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalised_error(predicted: Column, target: Column, eps: float = 1e-5) -> Column:
    """Sum of absolute differences between predicted and the layer-normalised target (population variance)."""
    n = F.size(target).cast("double")
    add = lambda x, f: F.aggregate(x, F.lit(0.0), lambda s, v: s + f(v))

    def with_mean(mean: Column) -> Column:
        deviation = F.sqrt(add(target, lambda v: (v - mean) * (v - mean)) / n + eps)
        return once(deviation, lambda sd: add(F.zip_with(predicted, target, lambda a, b: F.abs(a - (b - mean) / sd)), lambda v: v))

    return once(add(target, lambda v: v) / n, with_mean)


def token_errors(latents: DataFrame) -> DataFrame:
    """case_id, token_id, error (sum of absolute differences to the layer-normalised target), width; unequal widths are an error."""
    checked = latents.withColumn("_ok", F.when(F.size("predicted") == F.size("target"), True).otherwise(F.raise_error(F.lit("predicted and target differ in width")).cast("boolean")))
    error = normalised_error(F.col("predicted"), F.col("target"))
    return checked.filter("_ok").select("case_id", "token_id", error.alias("error"), F.size("predicted").alias("width"))


def latent_error(latents: DataFrame) -> DataFrame:
    """case_id, latent_error: mean over tokens and dimensions."""
    return token_errors(latents).groupBy("case_id").agg((F.sum("error") / F.sum("width")).alias("latent_error"))


def tubelet_errors(latents: DataFrame, per_block: int = SPATIAL) -> DataFrame:
    """case_id, block (0-based), error: the same mean per temporal block of target tokens."""
    block = F.floor(F.col("token_id") / per_block).cast("int")
    return token_errors(latents).groupBy("case_id", block.alias("block")).agg((F.sum("error") / F.sum("width")).alias("error"))


def mean_vectors(vectors: DataFrame) -> DataFrame:
    """case_id, mean: the element-wise mean of vectors (case_id, vector: array of doubles, equal in width within a case); null vectors count nowhere.

    A batch of rows gives one row of sums and counts per case; only these are shuffled.
    """
    kind = vectors.schema["case_id"].dataType.simpleString()

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).dictionary_encode()
            width = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            flat, code = batch.column(1).flatten().to_numpy(zero_copy_only=False), ids.indices.to_numpy(zero_copy_only=False)
            begin = np.cumsum(width) - width
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                at = at[np.argsort(code[at], kind="stable")]
                start = np.flatnonzero(np.append(True, np.diff(code[at]) != 0))
                total = np.add.reduceat(flat[begin[at][:, None] + np.arange(w)], start, axis=0)
                yield pa.RecordBatch.from_pydict({"case_id": ids.dictionary.take(pa.array(code[at][start])), "total": pa.array(list(total), pa.list_(pa.float64())), "n": np.diff(np.append(start, len(at)))})

    def whole(group: pa.Table) -> pa.Table:
        widths = set(pc.list_value_length(group["total"]).to_pylist())
        if len(widths) > 1:
            raise ValueError(f"vectors of one case differ in width: {sorted(widths)}")
        mean = np.stack(group["total"].to_numpy()).sum(0) / np.asarray(group["n"]).sum()
        return pa.table({"case_id": group["case_id"][:1], "mean": pa.array([mean], pa.list_(pa.float64()))})

    held = vectors.filter("case_id IS NOT NULL AND vector IS NOT NULL").select("case_id", F.col("vector").cast("array<double>").alias("vector"))
    parts = held.mapInArrow(sums, f"case_id {kind}, total array<double>, n long")
    return parts.groupBy("case_id").applyInArrow(whole, f"case_id {kind}, mean array<double>")


def encoder_distance(context: DataFrame, target: DataFrame) -> DataFrame:
    """case_id, encoder_distance: 1 - cosine of the mean token vectors of two tables (case_id, vector); null where a mean is zero, an error where widths differ."""
    both = mean_vectors(context).withColumnRenamed("mean", "a").join(mean_vectors(target).withColumnRenamed("mean", "b"), "case_id")
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    checked = F.when(F.size("a") == F.size("b"), F.try_divide(dot("a", "b"), F.sqrt(dot("a", "a") * dot("b", "b")))).otherwise(F.raise_error(F.lit("context and target differ in width")).cast("double"))
    return both.select("case_id", (1 - checked).alias("encoder_distance"))


#: The review text of each signal, in order.
DIRECTIONS = {
    "prediction_error": "higher: the target was predicted worse",
    "encoder_distance": "higher: the two sides lie further apart",
    "histogram_distance": "higher: colours differ more",
    "ssim_distance": "higher: structure differs more",
    "flow_discontinuity": "higher: motion breaks more",
}


def signal_table(scored: DataFrame) -> DataFrame:
    """case_id, place (0 to 4), signal, value, direction: one review row per signal."""
    rows = [F.struct(F.lit(i).alias("place"), F.lit(n).alias("signal"), F.col(n).alias("value"), F.lit(DIRECTIONS[n]).alias("direction")) for i, n in enumerate(NAMES)]
    return scored.select("case_id", F.explode(F.array(*rows)).alias("r")).select("case_id", "r.*")


def tubelet_curve(scored: DataFrame) -> DataFrame:
    """case_id, block (from 1), error."""
    return scored.select("case_id", F.posexplode("tubelet_errors").alias("_b", "error")).select("case_id", (F.col("_b") + 1).alias("block"), "error")
