"""Boundary cases from ordered frames: anchors, context windows, continuous and corrupted targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .nearest import cross_match

__all__ = ["cross_match"]

TOTAL = 16
HORIZONS = (2, 4, 8)


def check_horizon(horizon: int) -> None:
    if horizon <= 0 or horizon >= TOTAL or horizon % 2:
        raise ValueError(f"the horizon must be even, over 0 and under {TOTAL}: {horizon}")


def order_frames(frames: DataFrame, *order: str) -> DataFrame:
    """frame_index (0-based) and n (frames of the source), in an order made unique by its last column."""
    by = W.partitionBy("source_id")
    return frames.withColumns({"frame_index": F.row_number().over(by.orderBy(*order)) - 1, "n": F.count("*").over(by)})


def source_sizes(frames: DataFrame) -> DataFrame:
    return frames.groupBy("source_id", "split").agg(F.count("*").alias("n"))


def anchors(sizes: DataFrame, horizon: int, count: int = 3) -> DataFrame:
    """source_id, split, n, ordinal, anchor: evenly spaced, half-even rounding, distinct before numbering; none for short sources."""
    check_horizon(horizon)
    first, last = F.lit(TOTAL - horizon), F.col("n") - max(horizon, 2) - horizon
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.rint(first + i * (last - first) / F.lit(float(max(count - 1, 1)))).cast("int"))
    spots = spread if count > 1 else F.array(first)
    kept = sizes.filter(last >= first).withColumn("_a", F.array_sort(F.array_distinct(spots)))
    return kept.select("source_id", "split", "n", F.posexplode("_a").alias("ordinal", "anchor"))


def short_sources(sizes: DataFrame, horizon: int, strict: bool = False) -> DataFrame:
    """Sources without room for one anchor; strict: any such source is an error."""
    check_horizon(horizon)
    short = sizes.filter(F.col("n") < TOTAL + max(horizon, 2)).select("source_id", "split", "n")
    if strict and (bad := short.limit(5).collect()):
        raise ValueError(f"sources too short for horizon {horizon}: {[r['source_id'] for r in bad]}")
    return short


def reorder_index(horizon: int) -> list[int]:
    """Blocks of two, from the last to the first; a single block is turned round."""
    return [1, 0] if horizon == 2 else [horizon - 2 - 2 * (j // 2) + j % 2 for j in range(horizon)]


def context_index(horizon: int) -> Column:
    return F.sequence(F.col("anchor") - (TOTAL - horizon), F.col("anchor") - 1)


def target_index(kind: str, horizon: int, other_n: Column | None = None) -> Column:
    """Frame indexes of a target; cross: in a matched source of other_n frames, at the same relative place."""
    if kind == "continuous":
        start = F.col("anchor")
    elif kind == "skip":
        start = F.col("anchor") + max(horizon, 2)
    elif kind == "reorder":
        return F.array(*[F.col("anchor") + i for i in reorder_index(horizon)])
    else:
        relative = F.col("anchor") / F.greatest(F.lit(1.0), F.col("n") - F.lit(1.0))
        start = F.least(F.greatest(F.rint(relative * other_n).cast("int"), F.lit(0)), (other_n - horizon).cast("int"))
    return F.sequence(start.cast("int"), (start + horizon - 1).cast("int"))


KINDS = (("continuous", 0, "continuous", "primary"), ("skip", 1, "temporal_skip", "primary"), ("reorder", 1, "block_reorder", "primary"))


def plan_cases(frames: DataFrame, horizon: int, count: int = 3, matches: DataFrame | None = None) -> DataFrame:
    """A row per case with the indexes of its context and target frames; with matches, cross cases too."""
    sizes = source_sizes(frames)
    spots = anchors(sizes, horizon, count)
    kinds = [F.struct(F.lit(suffix).alias("suffix"), F.lit(label).alias("discontinuous"), F.lit(corruption).alias("corruption"), F.lit(lane).alias("lane"), F.col("source_id").alias("target_source"), target_index(suffix, horizon).alias("target")) for suffix, label, corruption, lane in KINDS]
    if matches is not None:
        other = sizes.select(F.col("source_id").alias("target_source_id"), F.col("n").alias("other_n"))
        spots = spots.join(matches.select("source_id", "target_source_id"), "source_id").join(other, "target_source_id")
        kinds.append(F.struct(F.lit("cross").alias("suffix"), F.lit(1).alias("discontinuous"), F.lit("cross_video_splice").alias("corruption"), F.lit("secondary").alias("lane"), F.col("target_source_id").alias("target_source"), target_index("cross", horizon, F.col("other_n")).alias("target")))
    rows = spots.withColumn("case", F.explode(F.array(*kinds))).withColumn("context", context_index(horizon))
    name = F.format_string(f"%s-%s-%02d-h{horizon}-%s", "split", F.col("source_id").cast("string"), "ordinal", "case.suffix")
    own = F.when(F.col("case.lane") == "secondary", F.col("case.target_source"))
    return rows.select(name.alias("case_id"), "source_id", "split", "case.discontinuous", "case.corruption", "case.lane", F.lit(horizon).alias("horizon"), "anchor", "context", "case.target", F.col("case.target_source").alias("target_source"), own.alias("target_source_id"))


def build_cases(frames: DataFrame, horizon: int, count: int = 3, matches: DataFrame | None = None) -> DataFrame:
    """The case table: frame paths replace indexes. Positions join to frames by (source, index); no source is gathered."""
    plan = plan_cases(frames, horizon, count, matches)
    spots = plan.select("case_id", F.explode(F.concat(
        F.transform("context", lambda x, i: F.struct(F.lit(0).alias("side"), i.alias("at"), F.col("source_id").alias("s"), x.cast("int").alias("f"))),
        F.transform("target", lambda x, i: F.struct(F.lit(1).alias("side"), i.alias("at"), F.col("target_source").alias("s"), x.cast("int").alias("f"))),
    )).alias("p")).select("case_id", "p.*")
    found = spots.join(frames.select(F.col("source_id").alias("s"), F.col("frame_index").alias("f"), "frame_path"), ["s", "f"])
    paths = found.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("side", "at", "frame_path"))).alias("p"))
    side = lambda k: F.transform(F.filter("p", lambda x: x["side"] == k), lambda x: x["frame_path"])
    paths = paths.select("case_id", side(0).alias("context_paths"), side(1).alias("target_paths"))
    columns = ["case_id", "source_id", "split", "discontinuous", "corruption", "lane", "horizon", "context_paths", "target_paths", "target_source_id"]
    return plan.join(paths, "case_id").select(*columns)


def split_overlap(cases: DataFrame, strict: bool = False) -> DataFrame:
    """Context sources that stand in more than one split; strict: any such source is an error."""
    both = cases.select("source_id", "split").distinct().groupBy("source_id").agg(F.count("*").alias("splits")).filter("splits > 1")
    if strict and (bad := both.limit(5).collect()):
        raise ValueError(f"sources in several splits: {[r['source_id'] for r in bad]}")
    return both


def expected_counts(cases: DataFrame, rows: int | None = None, groups: int | None = None) -> DataFrame:
    """rows and groups of a case table; given expectations that fail are an error."""
    found = cases.agg(F.count("*").alias("rows"), F.countDistinct("source_id").alias("groups"))
    if rows is not None or groups is not None:
        got = found.first()
        if (rows, groups) != (got["rows"] if rows is not None else None, got["groups"] if groups is not None else None):
            raise ValueError(f"expected {rows} rows of {groups} groups, found {got['rows']} of {got['groups']}")
    return found
