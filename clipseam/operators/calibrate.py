"""Standardised logistic calibration, thresholds and the choice of a horizon."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.storage import cut
from .metrics import average_precision, ranked_counts, running_totals

CHEAP = ("histogram_distance", "ssim_distance", "flow_discontinuity")
HYBRID = (*CHEAP, "prediction_error")
DEFAULT_HORIZON = 4
#: Newton steps and halvings of a step at most, and the step that ends them.
STEPS, HALVINGS, CLOSE = 50, 30, 1e-9


@dataclass(frozen=True)
class Calibrator:
    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def risk(self) -> Column:
        """The probability as a column; a scale of about zero counts as one; stable on both sides."""
        z = F.lit(self.intercept)
        for f, m, s, c in zip(self.features, self.mean, self.scale, self.coefficients, strict=True):
            z = z + F.lit(c) * (F.col(f) - F.lit(m)) / F.lit(1.0 if abs(s) <= 1e-12 else s)
        return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def standardize(rows: DataFrame, features: tuple[str, ...] = CHEAP) -> DataFrame:
    """feature, mean, scale: population deviation, zero counts as one."""
    stats = rows.agg(*[x for f in features for x in (F.avg(f).alias(f"m_{f}"), F.stddev_pop(f).alias(f"s_{f}"))])
    each = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}")).alias("scale")) for f in features]))
    return stats.select(each.alias("r")).select("r.*")


def class_weights(rows: DataFrame) -> DataFrame:
    """discontinuous, n, weight: all rows over twice the label's."""
    counts = rows.groupBy("discontinuous").agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.sum("n").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) / (2.0 * F.col("n")))


def fit_calibrator(rows: DataFrame, features: tuple[str, ...] = CHEAP, c: float = 1.0) -> Calibrator:
    """Class-balanced logistic regression with an L2 penalty of 1 / C over standardised features of the primary lane; the intercept is free.

    Newton steps, halved until they help, on normal equations that Spark sums over a written narrow table; a step brings some twenty numbers to
    the driver. Rows with a null are left out; one label only is an error.
    """
    primary = rows.filter("lane = 'primary'").select("discontinuous", *[F.col(f).cast("double").alias(f) for f in features]).na.drop()
    stats = {r["feature"]: r for r in standardize(primary, features).collect()}
    weights = {r["discontinuous"]: r["weight"] for r in class_weights(primary).collect()}
    if len(weights) < 2:
        raise ValueError("a calibrator needs both labels")
    weight = F.when(F.col("discontinuous") == 1, F.lit(float(weights[1]))).otherwise(F.lit(float(weights[0])))
    scaled = [((F.col(f) - stats[f]["mean"]) / stats[f]["scale"]).alias(f"x{i}") for i, f in enumerate(features)]
    data = cut(primary.select(F.col("discontinuous").cast("double").alias("y"), weight.alias("w"), *scaled), "calibration")
    k = len(features) + 1
    penalty = np.array([1 / c] * len(features) + [0.0])

    def sums(beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The penalised loss, its gradient and its Hessian at beta (intercept last)."""
        x = [*[F.col(f"x{i}") for i in range(k - 1)], F.lit(1.0)]
        z = F.lit(float(beta[-1]))
        for b, v in zip(beta[:-1], x[:-1], strict=True):
            z = z + F.lit(float(b)) * v
        placed = data.withColumn("z", z).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
        loss = F.greatest("z", F.lit(0.0)) - F.col("y") * F.col("z") + F.log1p(F.exp(-F.abs("z")))
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        found = placed.agg(
            F.sum(F.col("w") * loss), *[F.sum(F.col("w") * (F.col("p") - F.col("y")) * v) for v in x],
            *[F.sum(F.col("w") * F.col("p") * (1 - F.col("p")) * x[i] * x[j]) for i, j in pairs]).first()
        hessian = np.zeros((k, k))
        for (i, j), v in zip(pairs, found[1 + k :], strict=True):
            hessian[i, j] = hessian[j, i] = v
        return found[0] + (penalty * beta**2).sum() / 2, np.array(found[1 : 1 + k]) + penalty * beta, hessian + np.diag(penalty)

    beta = np.zeros(k)
    loss, gradient, hessian = sums(beta)
    for _ in range(STEPS):
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if abs(step).max() < CLOSE:
            break
        for _ in range(HALVINGS):
            tried = sums(beta - step)
            if tried[0] <= loss + 1e-12 * abs(loss):
                break
            step = step / 2
        beta, (loss, gradient, hessian) = beta - step, tried
    return Calibrator(tuple(features), tuple(stats[f]["mean"] for f in features), tuple(stats[f]["scale"] for f in features), tuple(float(b) for b in beta[:-1]), float(beta[-1]))


def apply_calibrator(rows: DataFrame, calibrator: Calibrator, name: str = "risk") -> DataFrame:
    return rows.withColumn(name, calibrator.risk())


def flag_cases(rows: DataFrame, threshold: float, risk: str = "risk") -> DataFrame:
    """flagged: 1 at or above the threshold, null where there is no risk."""
    return rows.withColumn("flagged", (F.col(risk) >= threshold).cast("int"))


def f1_curve(rows: DataFrame, probability: str = "risk") -> DataFrame:
    """threshold, precision, recall, f1 for each distinct probability and 0 and 1, predicting p >= threshold."""
    spark = rows.sparkSession
    extra = spark.createDataFrame([(0.0, 0, 0), (1.0, 0, 0)], "score double, positives long, n long")
    labelled = rows.select(F.lit("risk").alias("signal"), F.col(probability).alias("score"), "discontinuous")
    counts = ranked_counts(labelled).select("score", "positives", "n").unionByName(extra).groupBy("score").agg(F.sum("positives").alias("positives"), F.sum("n").alias("n"))
    total = running_totals(counts.withColumn("signal", F.lit("risk")))
    precision = F.col("tp") / F.greatest(F.lit(1), F.col("k"))
    recall = F.col("tp") / F.greatest(F.lit(1), F.col("all_positives"))
    return total.select(F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))).alias("f1"))


def f1_threshold(rows: DataFrame, probability: str = "risk") -> DataFrame:
    """The row of the best F1; ties to the higher recall, then the lower threshold."""
    return f1_curve(rows, probability).orderBy(F.desc("f1"), F.desc("recall"), "threshold").limit(1)


def select_horizon(scored: DataFrame, signal: str = "prediction_error") -> DataFrame:
    """horizon, auprc, selected: of the horizons within 1e-8 + 1e-5 * best of the best average precision, 4 if it is one, else the smallest."""
    rows = scored.filter("lane = 'primary'").select(F.col("horizon").cast("string").alias("signal"), F.col(signal).alias("score"), "discontinuous")
    found = average_precision(rows).select(F.col("signal").cast("int").alias("horizon"), F.col("average_precision").alias("auprc"))
    best = F.max("auprc").over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))  # a row per horizon
    near = found.withColumn("_near", F.abs(F.col("auprc") - best) <= 1e-8 + 1e-5 * F.abs(best))
    first = F.row_number().over(W.orderBy(F.desc(F.coalesce("_near", F.lit(False))), F.desc(F.col("horizon") == DEFAULT_HORIZON), "horizon"))
    return near.select("horizon", "auprc", (F.coalesce(F.col("_near"), F.lit(False)) & (first == 1)).alias("selected"))
