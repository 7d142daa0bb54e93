"""Frames of decoded clips: stamps, limits, fixed-rate sampling, windows around a boundary."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cases import TOTAL

FRAME_LIMIT, SAMPLE_FPS, NEAR = 12_000, 4.0, 1e-9


def dedupe_pts(decoded: DataFrame) -> DataFrame:
    """The first frame of each stamp in a clip; a missing stamp is the ordinal."""
    first = W.partitionBy("clip_id", F.coalesce("pts", F.col("ordinal").cast("long"))).orderBy("ordinal")
    return decoded.withColumn("_r", F.row_number().over(first)).filter("_r = 1").drop("_r")


def fallback_time(decoded: DataFrame, sample_fps: float = SAMPLE_FPS) -> DataFrame:
    """time_s filled with (ordinal - 1) / rate, the clip's average rate or else the sampling rate."""
    return decoded.withColumn("time_s", F.coalesce("time_s", (F.col("ordinal") - 1) / F.coalesce("avg_rate", F.lit(sample_fps))))


def frame_limit(decoded: DataFrame, limit: int = FRAME_LIMIT, strict: bool = False) -> DataFrame:
    """clip_id, n (frames with duplicates), rejected; strict: a clip over the limit is an error."""
    counts = decoded.groupBy("clip_id").agg(F.count("*").alias("n")).withColumn("rejected", F.col("n") > limit)
    if strict and (bad := counts.filter("rejected").limit(5).collect()):
        raise ValueError(f"clips over {limit} frames: {[r['clip_id'] for r in bad]}")
    return counts


def fixed_rate_sample(timed: DataFrame, sample_fps: float = SAMPLE_FPS) -> DataFrame:
    """clip_id, tick, ordinal: for each tick k the first frame not yet taken whose time reaches k / rate.

    With f(k) frames before tick k, that is frame k + max over j <= k of f(j) - j, so two running windows replace the
    frame-by-frame loop. Times must not fall inside a clip; a clip is as long as the frame limit allows.
    """
    order = W.partitionBy("clip_id").orderBy("ordinal")
    rows = timed.select("clip_id", "ordinal", "time_s", (F.row_number().over(order) - 1).alias("at"))
    last = rows.groupBy("clip_id").agg(F.max("time_s").alias("t"), F.count("*").alias("n"))
    ticks = last.filter("t >= 0").select("clip_id", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.floor((F.col("t") + NEAR) * sample_fps), F.col("n") - 1))).alias("tick"))
    both = ticks.select("clip_id", (F.col("tick") / F.lit(sample_fps)).alias("v"), F.lit(0).alias("frame"), "tick").unionByName(rows.select("clip_id", (F.col("time_s") + NEAR).alias("v"), F.lit(1).alias("frame"), F.lit(None).cast("long").alias("tick")))
    before = F.sum("frame").over(W.partitionBy("clip_id").orderBy("v", "frame", "tick").rowsBetween(W.unboundedPreceding, 0))
    counted = both.withColumn("f", before).filter("tick IS NOT NULL")
    ahead = F.max(F.col("f") - F.col("tick")).over(W.partitionBy("clip_id").orderBy("tick").rowsBetween(W.unboundedPreceding, 0))
    taken = counted.select("clip_id", "tick", (F.col("tick") + ahead).alias("at"))
    return taken.join(rows.select("clip_id", "at", "ordinal"), ["clip_id", "at"]).select("clip_id", "tick", "ordinal")


def sample_in_any_order(timed: DataFrame, sample_fps: float = SAMPLE_FPS) -> DataFrame:
    """fixed_rate_sample() for clips whose times may fall: frames in order of ordinal, each taken if its time reaches the next tick. A clip is one task's work, as long as the frame limit allows."""
    kind = timed.schema["clip_id"].dataType.simpleString()

    def take(group: pa.Table) -> pa.Table:
        group = group.sort_by("ordinal")
        times, at = group["time_s"].to_pylist(), []
        following = 0.0
        for i, t in enumerate(times):
            if t is not None and t + NEAR >= following:
                at.append(i)
                following += 1 / sample_fps
        kept = group.take(pa.array(at, pa.int64()))
        return pa.table({"clip_id": kept["clip_id"], "tick": pa.array(range(len(at)), pa.int64()), "ordinal": kept["ordinal"].cast(pa.int64())})

    return timed.select("clip_id", "ordinal", "time_s").groupBy("clip_id").applyInArrow(take, f"clip_id {kind}, tick long, ordinal long")


def sampled_clips(decoded: DataFrame, sample_fps: float = SAMPLE_FPS, limit: int = FRAME_LIMIT) -> tuple[DataFrame, DataFrame]:
    """Sampled frames (clip_id, tick, ordinal) of the clips within the frame limit, and all clips' counts (clip_id, n, rejected).

    Frames are counted with duplicates, missing times are filled, repeated stamps are dropped, and what is left is sampled.
    """
    counts = frame_limit(decoded, limit)
    kept = decoded.join(counts.filter("rejected").select("clip_id"), "clip_id", "left_anti")
    return sample_in_any_order(dedupe_pts(fallback_time(kept, sample_fps)), sample_fps), counts


def clip_pair_window(sampled: DataFrame, pairs: DataFrame, horizon: int) -> DataFrame:
    """pair_id, role, position, ordinal: the last 16 - horizon frames of clip_a, the first horizon of clip_b; pairs with a clip too short are left out."""
    need = {"context": TOTAL - horizon, "target": horizon}
    by = W.partitionBy("pair_id")
    sides = []
    for role, clip in (("context", "clip_a"), ("target", "clip_b")):
        rows = pairs.select("pair_id", F.col(clip).alias("clip_id")).join(sampled.select("clip_id", "tick", "ordinal"), "clip_id")
        rows = rows.withColumn("_n", F.count("*").over(by)).withColumn("_r", F.row_number().over(by.orderBy("tick")) - 1)
        first = F.col("_n") - need[role] if role == "context" else F.lit(0)
        kept = rows.filter(F.col("_n") >= need[role]).filter((F.col("_r") >= first) & (F.col("_r") < first + need[role]))
        sides.append(kept.select("pair_id", F.lit(role).alias("role"), (F.col("_r") - first).cast("int").alias("position"), "ordinal"))
    rows = sides[0].unionByName(sides[1])
    return rows.withColumn("_n", F.count("*").over(by)).filter(F.col("_n") == TOTAL).drop("_n")


def boundary_frames(cases: DataFrame, each: int = 4) -> DataFrame:
    """case_id, side, position, frame_path: the last ``each`` context frames and the first ``each`` target frames."""
    k, m = F.least(F.lit(each), F.size("context_paths")), F.least(F.lit(each), F.size("target_paths"))
    left = cases.filter(F.size("context_paths") > 0).select("case_id", F.lit("context").alias("side"), F.posexplode(F.slice("context_paths", -k, k)).alias("position", "frame_path"))
    right = cases.filter(F.size("target_paths") > 0).select("case_id", F.lit("target").alias("side"), F.posexplode(F.slice("target_paths", F.lit(1), m)).alias("position", "frame_path"))
    return left.unionByName(right)
