from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipseam.operators import cases


def frames(spark, sizes: dict[str, int]):
    rows = [(s, "dev" if s[0] == "d" else "test", i, f"{s}/{i:05d}") for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "source_id string, split string, frame_index int, frame_path string")


def expected_anchors(n: int, h: int, count: int) -> list[int]:
    first, last = 16 - h, n - max(h, 2) - h
    return [] if last < first else [first] if count == 1 else sorted({int(round(float(x))) for x in np.linspace(first, last, count)})


@pytest.mark.parametrize("horizon", [2, 4, 8])
@pytest.mark.parametrize("count", [1, 3, 5])
def test_anchors_equal_a_plain_loop(spark, horizon, count):
    sizes = {f"d{n}": n for n in range(14, 45)}
    found = cases.anchors(cases.source_sizes(frames(spark, sizes)), horizon, count).collect()
    got: dict = {}
    for r in sorted(found, key=lambda r: r["ordinal"]):
        got.setdefault(r["source_id"], []).append(r["anchor"])
    assert got == {s: a for s, n in sizes.items() if (a := expected_anchors(n, horizon, count))}


def test_corpus_of_five_sources(spark):
    rows = frames(spark, {"dev-a": 40, "dev-b": 40, "dev-c": 40, "test-a": 40, "test-b": 40})
    colours = spark.createDataFrame([("dev-a", "dev", [0.25, 0.0]), ("dev-b", "dev", [0.5, 0.0]), ("dev-c", "dev", [0.75, 0.0]), ("test-a", "test", [0.1, 0.0]), ("test-b", "test", [0.9, 0.0])], "source_id string, split string, colour array<double>")
    built = cases.build_cases(rows, 4, 3, cases.cross_match(colours)).collect()
    again = cases.build_cases(rows, 4, 3, cases.cross_match(colours)).collect()
    assert sorted(map(str, built)) == sorted(map(str, again))
    assert len([r for r in built if r["split"] == "dev"]) == 36 and len(built) == 60
    by = {r["case_id"]: r for r in built}
    assert all(len(r["context_paths"]) == 12 and len(r["target_paths"]) == 4 for r in built)
    first = by["dev-dev-a-00-h4-reorder"]
    assert first["target_paths"] == [f"dev-a/{i:05d}" for i in (14, 15, 12, 13)]
    assert by["dev-dev-a-00-h4-skip"]["target_paths"] == [f"dev-a/{i:05d}" for i in range(16, 20)]
    assert by["dev-dev-a-00-h4-continuous"]["context_paths"] == [f"dev-a/{i:05d}" for i in range(12)]
    # dev-b is as far from dev-a as from dev-c: the smaller name wins.
    assert {r["target_source_id"] for r in built if r["source_id"] == "dev-b" and r["lane"] == "secondary"} == {"dev-a"}
    assert {r["target_source_id"] for r in built if r["split"] == "test" and r["lane"] == "secondary"} == {"test-a", "test-b"}
    start = min(max(0, round(32 / 39 * 40)), 36)
    assert by["dev-dev-a-02-h4-cross"]["target_paths"] == [f"dev-b/{i:05d}" for i in range(start, start + 4)]


def test_reorder_indexes():
    assert cases.reorder_index(2) == [1, 0] and cases.reorder_index(4) == [2, 3, 0, 1] and cases.reorder_index(8) == [6, 7, 4, 5, 2, 3, 0, 1]


def test_cross_match_over_blocks(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "dev" if i % 2 else "test", rng.integers(0, 4, 2).astype(float).tolist()) for i in range(60)]
    found = {r["source_id"]: r["target_source_id"] for r in cases.cross_match(spark.createDataFrame(rows, "source_id long, split string, colour array<double>"), block=7).collect()}
    for i, split, c in rows:
        assert found[i] == min((float(np.linalg.norm(np.subtract(c, d))), j) for j, s, d in rows if s == split and j != i)[1]


@pytest.mark.parametrize("horizon", [0, -2, 3, 16])
def test_bad_horizons(spark, horizon):
    with pytest.raises(ValueError):
        cases.anchors(cases.source_sizes(frames(spark, {"d": 40})), horizon)


def test_gates(spark):
    rows = frames(spark, {"d1": 19, "d2": 20})
    assert [r["source_id"] for r in cases.short_sources(cases.source_sizes(rows), 4).collect()] == ["d1"]
    with pytest.raises(ValueError):
        cases.short_sources(cases.source_sizes(rows), 4, strict=True)
    mixed = rows.withColumn("split", F.when(F.col("frame_index") % 2 == 0, "dev").otherwise("test"))
    with pytest.raises(ValueError):
        cases.split_overlap(mixed, strict=True)
    assert cases.split_overlap(rows, strict=True).count() == 0
    assert cases.expected_counts(rows, 39, 2).first()["rows"] == 39
    with pytest.raises(ValueError):
        cases.expected_counts(rows, 40, 2)
    assert cases.build_cases(rows.limit(0), 4).count() == 0
