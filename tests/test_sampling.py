from __future__ import annotations

import numpy as np

from clipseam.operators import sampling

SCHEMA = "clip_id long, ordinal int, pts long, time_s double, avg_rate double"


def greedy(times: list[float], fps: float) -> list[int]:
    taken, tick = [], 0.0
    for i, t in enumerate(times):
        if t + 1e-9 >= tick / fps:
            taken.append(i)
            tick += 1
    return taken


def test_fixed_rate_equals_the_greedy_loop(spark):
    rng = np.random.default_rng(3)
    clips = {c: np.sort(np.concatenate([[0.0], np.cumsum(rng.choice([0.0, 0.01, 0.1, 0.25, 3.0], n))])).tolist() for c, n in enumerate(rng.integers(0, 40, 60))}
    rows = [(c, i + 1, None, t, None) for c, ts in clips.items() for i, t in enumerate(ts)]
    found: dict = {}
    for r in sampling.fixed_rate_sample(spark.createDataFrame(rows, SCHEMA), 4.0).orderBy("clip_id", "tick").collect():
        found.setdefault(r["clip_id"], []).append(r["ordinal"] - 1)
    assert found == {c: greedy(ts, 4.0) for c, ts in clips.items()}


def test_stamps_and_times(spark):
    rows = spark.createDataFrame([(1, 1, 5, None, 2.0), (1, 2, 5, 0.5, 2.0), (1, 3, None, None, 2.0), (2, 1, None, None, None), (2, 2, None, None, None)], SCHEMA)
    assert {(r["clip_id"], r["ordinal"]) for r in sampling.dedupe_pts(rows).collect()} == {(1, 1), (1, 3), (2, 1), (2, 2)}
    assert [r["time_s"] for r in sampling.fallback_time(rows).orderBy("clip_id", "ordinal").collect()] == [0.0, 0.5, 1.0, 0.0, 0.25]
    assert {r["clip_id"]: r["rejected"] for r in sampling.frame_limit(rows, 2).collect()} == {1: True, 2: False}


def test_clip_pairs(spark):
    rows = [(c, t, 100 * c + t) for c, n in ((1, 16), (2, 8), (3, 3)) for t in range(n)]
    sampled = spark.createDataFrame(rows, "clip_id long, tick long, ordinal int")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 2, 1)], "pair_id long, clip_a long, clip_b long")
    found = sampling.clip_pair_window(sampled, pairs, 4).orderBy("pair_id", "role", "position").collect()
    assert [r["ordinal"] for r in found] == [*range(104, 116), *range(200, 204)]  # the others are too short
