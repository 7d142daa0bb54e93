from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clipseam.functions import pixels as px
from clipseam.operators import fingerprint, scoring
from clipseam.operators import signals as sig
from clipseam.operators.calibrate import Calibrator
from clipseam.sources import frames as files
from clipseam.streaming.score import score_stream, with_scores


def disc(x: int, y: int = 120, r: int = 16, side: int = 256) -> np.ndarray:
    image = np.zeros((side, side, 3), np.uint8)
    image[:] = (24, 28, 39)
    row, col = np.mgrid[:side, :side]
    image[(row - y) ** 2 + (col - x) ** 2 <= r * r] = (45, 212, 191)
    return image


def texture(shift: int = 0) -> np.ndarray:
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 80 + 16))
    for _ in range(4):
        x = (x + np.roll(x, 1, 0) + np.roll(x, 1, 1) + np.roll(x, -1, 0) + np.roll(x, -1, 1)) / 5
    x = (x - x.min()) / (x.max() - x.min()) * 255
    return x[:, 8 - shift : 88 - shift]


def test_pixel_helpers():
    a, b = disc(100), disc(140)
    assert px.resize_area(a, 256, 256) == pytest.approx(a) and px.resize_area(np.full((7, 5, 3), 9.0), 3, 4) == pytest.approx(9.0)
    assert px.resize_area(a, 192, 192).mean() == pytest.approx(a.mean())
    assert px.ssim(px.grey(a), px.grey(a)) == pytest.approx(1.0) and px.ssim(px.grey(a), px.grey(b)) < 0.99
    h = px.hue_saturation_histogram(a)
    assert h.sum() == 256 * 256 and px.bhattacharyya(h, h) == pytest.approx(0, abs=1e-7) and 0 < px.bhattacharyya(h, px.hue_saturation_histogram(np.full_like(a, 200))) <= 1
    assert px.representative_colour(np.full((48, 64, 3), 51, np.uint8)) == pytest.approx([0.2] * 3)


def test_motion_finds_a_shift():
    assert px.motion_magnitude(texture(), texture()) == pytest.approx(0, abs=1e-9)
    for shift in (1, 2, 3):
        assert px.motion_magnitude(texture(), texture(shift)) == pytest.approx(shift, rel=0.25)


CASE = "case_id string, source_id string, target_source_id string, split string, discontinuous int, corruption string, lane string, horizon int, context_paths array<string>, target_paths array<string>"


def test_scores_from_pixels(spark):
    rows = [(f"f{i}", 64, 64, disc(10 + 2 * i, 30, 6, 64).tobytes()) for i in range(20)] + [("odd", 40, 90, np.full((40, 90, 3), 200, np.uint8).tobytes())]
    images = spark.createDataFrame(rows, "frame_path string, height int, width int, rgb binary")
    names = [f"f{i}" for i in range(20)]
    cases = spark.createDataFrame([("go", "s", None, "dev", 0, "continuous", "primary", 4, names[:12], names[12:16]), ("jump", "s", None, "dev", 1, "temporal_skip", "primary", 4, names[:12], ["odd"] * 4), ("short", "s", None, "dev", 0, "continuous", "primary", 2, ["f0"], ["f1"]), ("none", "s", None, "dev", 0, "continuous", "primary", 4, [], names[:4])], CASE)
    signatures = scoring.frame_signature(images, 48)
    found = {r["case_id"]: r for r in scoring.score_cases(cases, signatures, motion_side=24).collect()}
    assert set(found) == {"go", "jump", "short"} and len(found["go"]) == 17
    for name in ("histogram_distance", "ssim_distance", "prediction_error", "encoder_distance"):
        assert found["jump"][name] > found["go"][name] >= 0
    assert found["short"]["flow_discontinuity"] == 0.0 and len(found["go"]["tubelet_errors"]) == 2 and len(found["short"]["tubelet_errors"]) == 1

    def own(batches):
        for pdf in batches:
            yield pd.DataFrame({"case_id": pdf["case_id"], "prediction_error": 1.5, "encoder_distance": pdf["ssim_distance"], "tubelet_errors": [[1.0]] * len(pdf), "model_ms": None, "peak_vram_mb": 7.0})

    plugged = scoring.score_cases(cases, signatures, own, motion_side=24).collect()
    assert all(r["prediction_error"] == 1.5 and r["model_ms"] == 0.0 and r["peak_vram_mb"] == 7.0 for r in plugged)


def test_boundary_pairs_are_positional(spark):
    cases = spark.createDataFrame([("a", ["c0", "c1", "c2", "c3", "c4"], ["t0", "t1", "t2", "t3", "t4"]), ("b", ["c0"], ["t0", "t1"]), ("c", [], ["t0"])], "case_id string, context_paths array<string>, target_paths array<string>")
    found = [(r["case_id"], r["left_path"], r["right_path"]) for r in sig.boundary_pairs(cases).orderBy("case_id", "pair").collect()]
    assert found == [("a", "c1", "t0"), ("a", "c2", "t1"), ("a", "c3", "t2"), ("a", "c4", "t3"), ("b", "c0", "t0")]


def test_masks_are_disjoint_ordered_and_complete(spark):
    for h in (2, 4, 8):
        rows = sig.token_masks(spark.createDataFrame([(h,)], "horizon int")).orderBy("token_id").collect()
        assert [r["token_id"] for r in rows] == list(range(2048))
        assert [r["role"] for r in rows] == ["context"] * ((16 - h) // 2 * 256) + ["target"] * (h // 2 * 256)
    with pytest.raises(ValueError):
        sig.token_masks(spark.createDataFrame([(3,)], "horizon int"))


@pytest.mark.parametrize("horizon", [2, 4, 8])
def test_latent_errors(spark, horizon):
    rng = np.random.default_rng(horizon)
    n, d = horizon // 2 * 4, 8
    p, t = rng.normal(size=(n, d)), rng.normal(size=(n, d))
    df = spark.createDataFrame([("x", i, p[i].tolist(), t[i].tolist()) for i in range(n)], "case_id string, token_id int, predicted array<double>, target array<double>")
    z = (t - t.mean(1, keepdims=True)) / np.sqrt(t.var(1, keepdims=True) + 1e-5)
    assert sig.latent_error(df).first()["latent_error"] == pytest.approx(np.abs(p - z).mean())
    blocks = [r["error"] for r in sig.tubelet_errors(df, 4).orderBy("block").collect()]
    assert blocks == pytest.approx(np.abs(p - z).reshape(-1, 4 * d).mean(1).tolist()) and len(blocks) == horizon // 2
    bad = df.withColumn("predicted", F.slice("predicted", 1, d - 1))
    with pytest.raises(Exception, match="width"):
        sig.latent_error(bad).collect()


def test_array_histogram_distance(spark):
    p, q = [1.0, 2.0, 3.0], [30.0, 20.0, 10.0]
    got = spark.createDataFrame([(p, q)], "p array<double>, q array<double>").select(sig.array_histogram_distance(F.col("p"), F.col("q")).alias("d")).first()["d"]
    assert got == pytest.approx(px.bhattacharyya(np.array(p), np.array(q)))


def png(image: np.ndarray) -> bytes:
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + row.tobytes() for row in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_files(spark, tmp_path):
    for source, n in (("a", 3), ("b", 2)):
        (tmp_path / "img" / source).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "img" / source / f"{i:03d}.png").write_bytes(png(np.full((4, 6, 3), (10, 20, 30 + i), np.uint8)))
    found = files.read_frames(spark, f"file://{tmp_path}/img", ["a", "b"]).orderBy("source_id", "frame_index").collect()
    assert [(r["source_id"], r["frame_index"], bytes(r["rgb"][:3])) for r in found] == [("a", i, bytes([10, 20, 30 + i])) for i in range(3)] + [("b", i, bytes([10, 20, 30 + i])) for i in range(2)]
    (tmp_path / "img" / "c").mkdir()
    with pytest.raises(ValueError):
        files.read_frames(spark, f"file://{tmp_path}/img", ["a", "c"])
    (tmp_path / "train.txt").write_text(" a \n\nb\n")
    (tmp_path / "val.txt").write_text("c\n")
    assert {(r["split"], r["source_id"]) for r in files.read_splits(spark, f"file://{tmp_path}").collect()} == {("dev", "a"), ("dev", "b"), ("test", "c")}
    cases = spark.createDataFrame([("x", "s", "dev", 1, "continuous", "primary", 4, ["p"], ["q"], None), ("y", "s", "dev", 1, "cross_video_splice", "secondary", 4, ["p"], ["q"], "t")], files.CASE_SCHEMA)
    files.write_cases(cases, f"file://{tmp_path}/cases")
    assert sorted(files.read_cases(spark, f"file://{tmp_path}/cases").collect()) == sorted(cases.collect())
    files.write_metrics(spark.createDataFrame([(1, 0.5)], "b long, a double"), f"file://{tmp_path}/metrics")
    assert spark.read.text(f"file://{tmp_path}/metrics").first()["value"] == '{"a":0.5,"b":1}'


def test_fingerprints(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 1, "x"), ("é", 2, "x")], "name string, n int, content string")
    prints = [r["f"] for r in df.select(fingerprint.row_fingerprint(df, ["name", "n", "content"]).alias("f")).collect()]
    assert len(set(prints)) == 3
    tricky = spark.createDataFrame([("x',b='y", "z"), ("x", "y',b='z")], "a string, b string")
    assert len({r["f"] for r in tricky.select(fingerprint.row_fingerprint(tricky, ["a", "b"]).alias("f")).collect()}) == 2
    whole = [fingerprint.table_fingerprint(x, ["name", "n"]) for x in (df, df.repartition(3), df.filter("n = 2"), df.filter("n > 2"))]
    assert whole[0] == whole[1] and len(set(whole)) == 3
    same = df.select("content", "n", "name")
    assert [r["f"] for r in same.select(fingerprint.row_fingerprint(same, ["n", "content", "name"]).alias("f")).collect()] == prints
    import hashlib

    got = fingerprint.json_fingerprint(df, ["name", "n"]).collect()
    assert got[2]["fingerprint"] == hashlib.sha256('{"n":2,"name":"é"}'.encode()).hexdigest()
    trees = [fingerprint.tree_fingerprint(x).first()["tree_sha256"] for x in (df.filter("n = 2"), df.filter("n = 2").withColumn("content", F.lit("y")), df.filter("content = 'x'"), df.filter("content = 'x'").orderBy(F.desc("name")))]
    assert len(set(trees[:3])) == 3 and trees[2] == trees[3]
    with pytest.raises(ValueError):
        fingerprint.corpus_manifest(spark.createDataFrame([("dev", "a"), ("test", "a")], "split string, source_id string"))
    assert fingerprint.corpus_manifest(spark.createDataFrame([("dev", "a"), ("dev", "b")], "split string, source_id string"), {"dev": 2}).first()["n"] == 2


def plain_digest(lines: list[str], leaf: int) -> str:
    import hashlib
    from collections import Counter

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    entries = [f"{n}:{line}" for line, n in Counter(lines).items()]
    depth = sum(len(entries) > leaf * 16**d for d in range(fingerprint.DEEPEST))

    def node(prefix: str, own: list[str]) -> str:
        if len(prefix) == depth:
            return sha("\n".join(sorted(own)))
        children: dict = {}
        for e in own:
            children.setdefault(sha(e)[: len(prefix) + 1], []).append(e)
        return sha("\n".join(f"{k}:{node(k, v)}" for k, v in sorted(children.items())))

    return node("", entries)


@pytest.mark.parametrize(("leaf", "depth"), [(1_000, 1), (1, 4), (3, 3), (20_000, 0)])
def test_digest_trees_by_hand(spark, monkeypatch, leaf, depth):
    monkeypatch.setattr(fingerprint, "LEAF", leaf)
    assert sum(9000 > leaf * 16**d for d in range(fingerprint.DEEPEST)) == depth
    lines = [("a", f"name-{i}") for i in range(9000)] + [("a", "name-7")] * 5000 + [("b", "é"), ("b", "x")]
    sizes = []
    cut = fingerprint.cut
    monkeypatch.setattr(fingerprint, "cut", lambda df, tag: sizes.append((tag, cut(df, tag))) or sizes[-1][1])
    found = fingerprint.digest_lines(spark.createDataFrame(lines, "k string, line string").repartition(3), ("k",), "n", "digest").collect()
    assert {(r["k"], r["n"], r["digest"]) for r in found} == {("a", 14000, plain_digest([v for k, v in lines if k == "a"], leaf)), ("b", 2, plain_digest(["é", "x"], leaf))}
    entries = dict(sizes)["entries"].filter("k = 'a'")
    largest = entries.groupBy(F.expr(f"substring(_sha, 1, {depth})")).count().agg(F.max("count")).first()[0]
    assert largest <= max(2 * leaf, 20)  # repeated lines are one entry


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i) / 10, None if i == 7 else 1.0) for i in range(50)], "case_id long, x double, y double")
    rows.repartition(5).write.parquet(f"file://{tmp_path}/in")
    c = Calibrator(("x", "y"), (2.0, 0.5), (1.0, 2.0), (1.0, -1.0), 0.1)
    score_stream(spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in"), c, 0.5, f"file://{tmp_path}/out", f"file://{tmp_path}/check").awaitTermination()
    assert sorted(map(str, spark.read.parquet(f"file://{tmp_path}/out").collect())) == sorted(map(str, with_scores(rows, c, 0.5).collect()))


def test_plane_signals_equal_the_pixel_functions(spark):
    from clipseam.operators import scoring

    rng = np.random.default_rng(3)
    planes = {f"f{i}": rng.integers(0, 256, (24, 24)).astype(np.uint8) for i in range(6)}
    signatures = spark.createDataFrame([(k, v.tobytes(), [1.0]) for k, v in planes.items()], scoring.SIGNATURE)
    cases = spark.createDataFrame([("x", ["f0", "f1", "f2"], ["f3", "f4"]), ("y", ["f1", "f2"], ["f3", "f4", "f5"]), ("none", [], ["f1"])], "case_id string, context_paths array<string>, target_paths array<string>")
    at = {k: v.astype(float) for k, v in planes.items()}
    found = {r["case_id"]: r["ssim_distance"] for r in scoring.ssim_distance(cases, signatures).collect()}
    assert found == {k: pytest.approx(np.mean([1 - px.ssim(at["f1"], at["f3"]), 1 - px.ssim(at["f2"], at["f4"])])) for k in ("x", "y")}
    found = {(r["case_id"], r["place"]): r["flow_magnitude"] for r in scoring.flow_magnitude(cases, signatures, motion=lambda a, b: float(abs(a - b).sum())).collect()}
    steps = [("f1", "f2"), ("f2", "f3"), ("f3", "f4")]
    assert found == {(k, i): float(abs(at[a] - at[b]).sum()) for k in ("x", "y") for i, (a, b) in enumerate(steps)}


def test_frames_and_splits_are_written_as_they_are_read(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(s, i, 4, 6, rng.integers(0, 256, (4, 6, 3)).astype(np.uint8).tobytes()) for s in (1, 2) for i in range(12)]
    root = f"file://{tmp_path}/frames"
    files.write_frames(spark.createDataFrame(rows, "source_id long, frame_index int, height int, width int, rgb binary"), root)
    assert {(int(r["source_id"]), r["frame_index"], r["height"], r["width"], bytes(r["rgb"])) for r in files.read_frames(spark, root).collect()} == set(rows)
    files.write_splits(spark.createDataFrame([("dev", 1), ("dev", 1), ("test", 2)], "split string, source_id long"), f"file://{tmp_path}/lists")
    assert {(r["split"], r["source_id"]) for r in files.read_splits(spark, f"file://{tmp_path}/lists").collect()} == {("dev", "1"), ("test", "2")}


def test_shared_folder_is_asked_for(monkeypatch):
    from types import SimpleNamespace

    from clipseam.functions import storage

    spark = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="x"))
    with pytest.raises(ValueError):
        storage.shared_folder(spark)


def test_mean_vectors_send_sums_only(spark):
    rng = np.random.default_rng(5)
    rows = [(f"c{i % 3}", rng.normal(size=4).tolist()) for i in range(3000)] + [("c0", None), (None, [1.0] * 4), ("w", [1.0, 3.0]), ("w", [3.0, 5.0])]
    df = spark.createDataFrame(rows, "case_id string, vector array<double>").repartition(4)
    found = sig.mean_vectors(df)
    got = {r["case_id"]: r["mean"] for r in found.collect()}
    want = {c: np.mean([v for k, v in rows if k == c and v], axis=0) for c in ("c0", "c1", "c2", "w")}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k].tolist()) for k in want)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    mixed = spark.createDataFrame([("a", [1.0]), ("a", [1.0, 2.0])], "case_id string, vector array<double>")
    with pytest.raises(Exception, match="width"):
        sig.mean_vectors(mixed).collect()
    zero = spark.createDataFrame([("a", [0.0, 0.0])], "case_id string, vector array<double>")
    assert sig.encoder_distance(zero, zero).first()["encoder_distance"] is None
    assert sig.encoder_distance(df.limit(0), df).count() == 0
