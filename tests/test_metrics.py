from __future__ import annotations

import numpy as np
import pytest

from clipseam.functions.ranges import numbered
from clipseam.operators import bootstrap, calibrate, metrics

SCHEMA = "signal string, score double, discontinuous int"


def plain_ap(y, s, w=None):
    w = np.ones(len(y)) if w is None else w
    total, area, tp, k = (w * y).sum(), 0.0, 0.0, 0.0
    if total == 0 or total == w.sum():
        return None
    for t in sorted(set(s), reverse=True):
        hit = s == t
        tp, k = tp + (w * y)[hit].sum(), k + w[hit].sum()
        area += (w * y)[hit].sum() / total * tp / k if k else 0.0
    return area


def plain_auroc(y, s):
    p, n = s[y == 1], s[y == 0]
    return None if not len(p) or not len(n) else float(((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n)))


def test_ranking_metrics_equal_plain_loops(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for k in range(12):
        n = int(rng.integers(1, 600))
        y, s = rng.integers(0, 2, n), rng.choice([rng.normal(size=n), rng.integers(0, 4, n).astype(float)])
        y = np.ones(n, int) if k == 0 else np.zeros(n, int) if k == 1 else y
        s = np.zeros(n) if k == 2 else s
        want[f"s{k}"] = (plain_ap(y, s), plain_auroc(y, s))
        rows += [(f"s{k}", float(a), int(b)) for a, b in zip(s, y, strict=True)]
    df = spark.createDataFrame(rows, SCHEMA)
    ap = {r["signal"]: r["average_precision"] for r in metrics.average_precision(df).collect()}
    au = {r["signal"]: r["auroc"] for r in metrics.auroc(df).collect()}
    for k, (a, b) in want.items():
        assert ap[k] == (None if a is None else pytest.approx(a)) and au[k] == (None if b is None else pytest.approx(b))


def test_f1_threshold_equals_a_scan(spark):
    rng = np.random.default_rng(6)
    for n in (1, 30, 400):
        y, p = rng.integers(0, 2, n), rng.integers(0, 11, n) / 10
        best = None
        for t in sorted({*p.tolist(), 0.0, 1.0}):
            hit = p >= t
            precision, recall = (y[hit]).sum() / max(1, hit.sum()), y[hit].sum() / max(1, y.sum())
            key = (2 * precision * recall / max(1e-12, precision + recall), recall, -t)
            best = max(best, key) if best else key
        got = calibrate.f1_threshold(spark.createDataFrame([*zip(p.tolist(), y.tolist(), strict=True)], "risk double, discontinuous int")).first()
        assert (got["f1"], got["recall"], -got["threshold"]) == pytest.approx(best)


def test_bootstrap_equals_weighted_copies(spark):
    rng = np.random.default_rng(7)
    rows = [(f"g{i % 7}", int(rng.integers(0, 2)), *[float(x) for x in rng.integers(0, 9, 3)]) for i in range(200)]
    df = spark.createDataFrame(rows, "source_id string, discontinuous int, a double, b double, c double")
    draws = bootstrap.bootstrap_draws(df.select("source_id").distinct(), 15).collect()
    per = {r: sum(d["times"] for d in draws if d["replicate"] == r) for r in range(15)}
    assert set(per.values()) == {7}
    names = {"x": "a", "y": "b", "z": "c"}
    found = {r["replicate"]: r for r in bootstrap.grouped_bootstrap(df, names, 15).collect()}
    one = bootstrap.grouped_bootstrap(df.filter("discontinuous = 1"), names, 3).first()
    assert one["x_auprc"] is None and one["delta_x_minus_y"] is None
    y = np.array([r[1] for r in rows])
    for k in range(15):
        times = {d["source_id"]: d["times"] for d in draws if d["replicate"] == k}
        w = np.array([times.get(r[0], 0) for r in rows], float)
        aps = [plain_ap(y, np.array([r[2 + j] for r in rows]), w) for j in range(3)]
        assert [found[k][c] for c in ("x_auprc", "y_auprc", "z_auprc")] == pytest.approx(aps)
        assert found[k]["delta_x_minus_y"] == pytest.approx(aps[0] - aps[1])


def test_interval_and_outcome(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 101)] + [(None,)], "d double")
    r = bootstrap.bootstrap_interval(df, "d").first()
    assert (r["low"], r["median"], r["high"]) == pytest.approx(np.quantile(np.arange(1, 101), [0.025, 0.5, 0.975])) and r["outcome"] == "predictor_adds_evidence"
    assert bootstrap.bootstrap_interval(df.selectExpr("-d AS d"), "d").first()["outcome"] == "cheap_signals_outperform"


def test_summaries_by_hand(spark):
    rows = [("a-x-1", "s", "continuous", 0, "primary", 1.0, 0), ("a-x-2", "s", "temporal_skip", 1, "primary", 2.0, 1), ("a-x-3", "s", "block_reorder", 1, "primary", 1.0, 0), ("b-x-1", "t", "temporal_skip", 1, "secondary", 9.0, 1)]
    df = spark.createDataFrame(rows, "case_id string, source_id string, corruption string, discontinuous int, lane string, v double, flagged int")
    hit = metrics.directional_hits(df, ("v",)).first()
    assert (hit["hits"], hit["comparisons"]) == (1, 2)  # t has no continuous case
    rates = metrics.alert_rates(df).first()
    assert (rates["recall"], rates["false_alert_rate"], rates["flags"]) == (pytest.approx(2 / 3), 0.0, 2)
    assert metrics.alert_rates(df.selectExpr("discontinuous", "nullif(flagged, 1) AS flagged")).first()["recall"] is None
    assert {r["corruption"]: r["recall"] for r in metrics.recall_by_corruption(df.withColumnRenamed("v", "risk"), 1.5).collect()} == {"temporal_skip": 1.0, "block_reorder": 0.0}
    assert [r["v"] for r in metrics.condition_means(df, names=("v",)).orderBy("place").collect()] == [1.0, 5.5, 1.0, None]


def test_running_totals_and_quantiles_over_many_ranges(spark):
    rng = np.random.default_rng(21)
    rows = [(k, float(s), int(rng.integers(0, 2))) for k, n in (("a", 900), ("b", 7), ("c", 1)) for s in rng.integers(-150, 150, n)]
    counts = metrics.ranked_counts(spark.createDataFrame(rows, "signal string, score double, discontinuous int"))
    found = metrics.running_totals(counts, rows=40).collect()
    assert len(found) == counts.count()
    for r in found:
        mine = [(s, d) for k, s, d in rows if k == r["signal"]]
        assert (r["tp"], r["k"]) == (sum(d for s, d in mine if s >= r["score"]), sum(s >= r["score"] for s, d in mine))
        assert (r["all_positives"], r["all_n"]) == (sum(d for _, d in mine), len(mine))
    at = (0.0, 0.1, 0.25, 0.5, 0.75, 1.0)
    for r in metrics.quantiles(counts, ("signal",), at, rows=40).collect():
        assert r["q"] == pytest.approx(np.quantile([s for k, s, _ in rows if k == r["signal"]], at))


def test_rows_are_numbered_over_ranges(spark):
    names = [f"g{i:03d}" for i in np.random.default_rng(3).permutation(100)]
    found = numbered(spark.createDataFrame([(n,) for n in names], "name string"), "name", rows=9).collect()
    assert {r["name"]: r["at"] for r in found} == {n: i for i, n in enumerate(sorted(names))}
    assert numbered(spark.createDataFrame([], "name string"), "name").count() == 0
