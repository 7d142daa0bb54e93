from __future__ import annotations

import numpy as np
import pytest

from clipseam.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, links string, tile int, node long, m int"


def brute(rows, threshold=embeddings.THRESHOLD):
    good = []
    for k, (i, v, label, *_) in enumerate(rows):
        if i is None or label is None or not v or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good.append((k, np.array(v, np.float32).astype(float), label))
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, (a, u, p) in enumerate(good):
        for b, v, q in good[:x]:
            if p == q and len(u) == len(v) and u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least: dict = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(r[0], least.get(find(k), r[0]))
    return sorted((str(r[0]), links[k], least.get(find(k)) if r[0] is not None else None) for k, r in enumerate(rows))


@pytest.mark.parametrize("tile", [16, 8192])
def test_links_equal_brute_force(spark, tile):
    rng = np.random.default_rng(tile)
    centres = rng.normal(size=(12, 16))
    rows = []
    for i in range(260):
        v = (centres[i % 12] * rng.choice([1.0, 7.0]) + rng.choice([0.0, 0.1, 0.25, 0.6]) * rng.normal(size=16)).astype(np.float32)
        rows.append((i, v.tolist(), int(i % 12 % 2)))
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (301, rows[0][1], 0), (302, rows[0][1], 1), (303, rows[0][1], None), (304, None, 0), (305, [], 0), (306, [0.0] * 16, 0), (307, [float("nan")] * 16, 0), (308, [float("inf")] + [0.0] * 15, 0), (309, [None] + [1.0] * 15, 0), (310, rows[0][1][:8], 0), (311, rows[0][1][:8], 0), (None, rows[0][1], 0), (312, [1e-30] * 16, 0), (313, [1e30] * 16, 0)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    found = embeddings.near_embeddings(df, tile=tile).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in found) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found)
    assert embeddings.near_embeddings(df.limit(0)).count() == 0


def test_bounds_hold_for_wide_and_uneven_vectors():
    rng = np.random.default_rng(3)
    for width in (3, 64, 1500):
        x = rng.normal(size=(200, width)) ** 3
        x[::5] = x[0] + 0.05 * rng.normal(size=(40, width))
        a = embeddings.Tile(x)
        pairs = {(int(i), int(j)) for u, v in embeddings.tile_links(a, a, 0.93, True) for i, j in zip(u, v, strict=True)}
        full = a.unit @ a.unit.T
        assert pairs == {(i, j) for i in range(200) for j in range(i + 1, 200) if full[i, j] >= 0.93}


def test_ids_may_repeat_or_be_strings(spark):
    rows = [("b", [1.0, 0.0], 1), ("a", [1.0, 0.01], 1), ("c", [0.0, 1.0], 1), ("c", [-1.0, 0.0], 1), ("d", [0.0, 1.0], 2)]
    found = embeddings.near_embeddings(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int"), tile=1).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found) == [("a", 1, "a", True), ("b", 1, "a", False), ("c", 0, "c", True), ("c", 0, "c", True), ("d", 0, "d", True)]
    same_id = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.01], 1)]
    found = embeddings.near_embeddings(spark.createDataFrame(same_id, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in found) == [(1, 0), (1, 1), (2, 1)]
