"""Ranking and summary metrics of scored cases.

Ranking metrics and quantiles never order all rows in one task: rows are first counted per distinct score, the counts
are written in ranges of scores, ranges are summed, and running totals are taken inside a range and offset by the ranges
above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranges import RANGE_ROWS, ranged
from ..functions.storage import cut
from .signals import NAMES

CORRUPTIONS = ("continuous", "temporal_skip", "block_reorder", "cross_video_splice")


def primary_lane(rows: DataFrame) -> DataFrame:
    return rows.filter("lane = 'primary'")


def long_signals(rows: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """signal, score, discontinuous: a row per case and signal."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("score")) for n in names]))
    return rows.select("discontinuous", each.alias("s")).select("s.signal", "s.score", "discontinuous")


def ranked_counts(rows: DataFrame) -> DataFrame:
    """signal, score, positives, n per distinct score; rows without score or label are left out."""
    held = rows.filter(F.col("score").isNotNull() & ~F.isnan("score") & F.col("discontinuous").isNotNull())
    return held.groupBy("signal", "score").agg(F.sum("discontinuous").cast("long").alias("positives"), F.count("*").alias("n"))


def running_totals(counts: DataFrame, keys: tuple[str, ...] = ("signal",), rows: int = RANGE_ROWS, written: int | None = None) -> DataFrame:
    """tp and k (positives and rows at or above the score), all_positives and all_n, per distinct score of each key. written: the rows of counts, where it is a written table."""
    placed = ranged(counts, *keys, "score", rows=rows, count=written)
    by = W.partitionBy(*keys)
    parts = placed.groupBy(*keys, "_range").agg(F.sum("positives").alias("_p"), F.sum("n").alias("_n"))
    above = by.orderBy(F.desc("_range")).rowsBetween(W.unboundedPreceding, -1)  # a row per range
    parts = parts.select(*keys, "_range", F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp"), F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_k"), F.sum("_p").over(by).alias("all_positives"), F.sum("_n").over(by).alias("all_n"))
    inside = W.partitionBy(*keys, "_range").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    met = placed.join(parts, [*keys, "_range"])
    return met.withColumns({"tp": F.col("_tp") + F.sum("positives").over(inside), "k": F.col("_k") + F.sum("n").over(inside)}).drop("_range", "_tp", "_k")


def average_precision(rows: DataFrame) -> DataFrame:
    """signal, average_precision: tied scores move together; null with one label only."""
    total = running_totals(ranked_counts(rows))
    step = F.try_divide(F.col("positives"), F.col("all_positives")) * F.col("tp") / F.col("k")
    both = (F.first("all_positives") > 0) & (F.first("all_positives") < F.first("all_n"))
    return total.groupBy("signal").agg(F.when(both, F.sum(step)).alias("average_precision"))


def auroc(rows: DataFrame) -> DataFrame:
    """signal, auroc: positives over negatives, ties half; null with one label only."""
    total = running_totals(ranked_counts(rows))
    tied = F.col("n") - F.col("positives")
    below = F.col("all_n") - F.col("all_positives") - (F.col("k") - F.col("tp"))
    both = (F.first("all_positives") > 0) & (F.first("all_positives") < F.first("all_n"))
    area = F.try_divide(F.sum(F.col("positives") * (below + tied / 2.0)), F.first("all_positives").cast("double") * (F.first("all_n") - F.first("all_positives")))
    return total.groupBy("signal").agg(F.when(both, area).alias("auroc"))


def ranking_metrics(rows: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """signal, average_precision, auroc from one pass."""
    total = running_totals(ranked_counts(long_signals(rows, names)))
    positives, n = F.first("all_positives"), F.first("all_n")
    both = (positives > 0) & (positives < n)
    step = F.try_divide(F.col("positives"), F.col("all_positives")) * F.col("tp") / F.col("k")
    below = F.col("all_n") - F.col("all_positives") - (F.col("k") - F.col("tp"))
    area = F.try_divide(F.sum(F.col("positives") * (below + (F.col("n") - F.col("positives")) / 2.0)), positives.cast("double") * (n - positives))
    return total.groupBy("signal").agg(F.when(both, F.sum(step)).alias("average_precision"), F.when(both, area).alias("auroc"))


def balanced_accuracy(rows: DataFrame, threshold: float, risk: str = "risk") -> DataFrame:
    """The mean of both labels' recalls at the threshold; null with one label only."""
    flagged = (F.col(risk) >= threshold).cast("double")
    recall = lambda label, hit: F.avg(F.when(F.col("discontinuous") == label, hit))
    return rows.agg(((recall(1, flagged) + recall(0, 1 - flagged)) / 2).alias("balanced_accuracy"))


def recall_by_corruption(rows: DataFrame, threshold: float, risk: str = "risk") -> DataFrame:
    """corruption, n, recall of the primary lane's discontinuous cases."""
    return primary_lane(rows).filter("discontinuous = 1").groupBy("corruption").agg(F.count("*").alias("n"), F.avg((F.col(risk) >= threshold).cast("double")).alias("recall"))


def summary_metrics(rows: DataFrame) -> DataFrame:
    """One row over the primary lane; a missing timing counts as zero."""
    return primary_lane(rows).agg(
        F.count("*").alias("rows"), F.countDistinct("source_id").alias("groups"), F.avg("discontinuous").alias("prevalence"),
        F.avg(F.coalesce("cheap_ms", F.lit(0.0))).alias("mean_cheap_ms"), F.avg(F.coalesce("model_ms", F.lit(0.0))).alias("mean_model_ms"), F.max("peak_vram_mb").alias("peak_vram_mb"))


def quantiles(counts: DataFrame, keys: tuple[str, ...], at: tuple[float, ...], rows: int = RANGE_ROWS, written: int | None = None) -> DataFrame:
    """keys and q: the linearly interpolated quantiles of counted scores (keys, score, n), taken from running totals; exact."""
    total = running_totals(counts.withColumn("positives", F.lit(0)), keys, rows, written)
    first, last = F.col("all_n") - F.col("k"), F.col("all_n") - F.col("k") + F.col("n") - 1
    place = lambda q: F.lit(q) * (F.col("all_n") - 1)
    holds = lambda i: F.max(F.when((first <= i) & (i <= last), F.col("score")))
    found = total.groupBy(*keys).agg(F.first("all_n").alias("all_n"), *[holds(f(place(q))).alias(f"{side}{j}") for j, q in enumerate(at) for side, f in (("low", F.floor), ("high", F.ceil))])
    between = [F.col(f"low{j}") + (F.col(f"high{j}") - F.col(f"low{j}")) * (place(q) - F.floor(place(q))) for j, q in enumerate(at)]
    return found.select(*keys, F.array(*between).alias("q"))


def box_stats(rows: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """signal, corruption, q1, median, q3, low, high: quartiles over counted values; whiskers at the last values within 1.5 of the quartile range."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).cast("double").alias("score")) for n in names]))
    long = rows.select("corruption", each.alias("s")).select("corruption", "s.*").filter("score IS NOT NULL AND corruption IS NOT NULL")
    counts = cut(long.groupBy("signal", "corruption", "score").agg(F.count("*").alias("n")), "values")
    quart = quantiles(counts, ("signal", "corruption"), (0.25, 0.5, 0.75), written=counts.count())
    reach = 1.5 * (F.col("q")[2] - F.col("q")[0])
    kept = counts.join(quart, ["signal", "corruption"]).filter((F.col("score") >= F.col("q")[0] - reach) & (F.col("score") <= F.col("q")[2] + reach))
    return kept.groupBy("signal", "corruption").agg(F.first(F.col("q")[0]).alias("q1"), F.first(F.col("q")[1]).alias("median"), F.first(F.col("q")[2]).alias("q3"), F.min("score").alias("low"), F.max("score").alias("high"))


def condition_means(rows: DataFrame, labels: tuple[str, ...] = CORRUPTIONS, names: tuple[str, ...] = NAMES) -> DataFrame:
    """place, corruption and the means of five signals (6 digits), a row per label even where it has no case."""
    order = rows.sparkSession.createDataFrame(list(enumerate(labels)), "place int, corruption string")
    means = rows.groupBy("corruption").agg(*[F.round(F.avg(n), 6).alias(n) for n in names])
    return order.join(means, "corruption", "left").select("place", "corruption", *names)


def directional_hits(rows: DataFrame, names: tuple[str, ...] = NAMES, order: str = "case_id") -> DataFrame:
    """signal, hits, comparisons: discontinuous cases strictly above their own source's first continuous case; sources without one are left out."""
    first = rows.filter("corruption = 'continuous'").groupBy("source_id").agg(*[F.min_by(n, order).alias(f"base_{n}") for n in names])
    both = rows.filter("corruption <> 'continuous'").join(first, "source_id")
    sums = both.agg(F.count("*").alias("n"), *[F.coalesce(F.sum((F.col(n) > F.col(f"base_{n}")).cast("long")), F.lit(0)).alias(n) for n in names])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("signal"), F.col(n).alias("hits"), F.col("n").alias("comparisons")) for n in names])).alias("r")).select("r.*")


def alert_rates(rows: DataFrame) -> DataFrame:
    """recall on discontinuous cases, false alerts on continuous ones, and the flags; null if any case lacks a flag."""
    whole = F.count("flagged") == F.count("*")
    rate = lambda label: F.when(whole, F.avg(F.when(F.col("discontinuous") == label, F.col("flagged"))))
    return rows.agg(rate(1).alias("recall"), rate(0).alias("false_alert_rate"), F.when(whole, F.sum("flagged")).alias("flags"))


def walkthrough_summary(rows: DataFrame, good: str = "continuous") -> DataFrame:
    """One row over demo pairs whose condition is the second part of the case id."""
    condition = F.element_at(F.split("case_id", "-", 2), 2)
    whole, is_good = F.count("flagged") == F.count("*"), condition == good
    count = lambda c: F.sum(c.cast("long"))
    return rows.agg(F.count("*").alias("pairs"), count(is_good).alias("known_good"), count(~is_good).alias("known_bad"), F.avg("cheap_ms").alias("mean_cheap_ms"), F.avg("model_ms").alias("mean_model_ms"),
        F.when(whole, F.sum(F.when(~is_good, F.col("flagged")))).alias("bad_flagged"), F.when(whole, F.sum(F.when(is_good, F.col("flagged")))).alias("good_flagged"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded: sums of doubles depend on the order of rows."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


#: What an interval above zero, below zero or around it is called.
OUTCOMES = ("predictor_adds_evidence", "cheap_signals_outperform", "inconclusive_at_this_sample_size")


def outcome(low: Column, high: Column) -> Column:
    return F.when(low > 0, OUTCOMES[0]).when(high < 0, OUTCOMES[1]).otherwise(OUTCOMES[2])
