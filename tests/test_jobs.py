"""Jobs from frames and clips, composed by hand or against loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipseam import queries_jobs
from clipseam.jobs import evaluation as ev
from clipseam.operators import sampling
from clipseam.operators.calibrate import HYBRID, Calibrator

DECODED = "clip_id string, ordinal int, pts long, time_s double, avg_rate double, frame_path string"


def loop(rows: list, fps: float, limit: int) -> list[int] | None:
    """Sampled ordinals of one clip (rows of ordinal, pts, time, rate), frame by frame; None over the limit."""
    seen, taken, following, decoded = set(), [], 0.0, 0
    for ordinal, pts, time, rate in rows:
        decoded += 1
        if decoded > limit:
            return None
        stamp = pts if pts is not None else decoded
        if stamp in seen:
            continue
        seen.add(stamp)
        t = time if time is not None else (decoded - 1) / (rate or fps)
        if t + 1e-9 < following:
            continue
        taken.append(ordinal)
        following += 1 / fps
    return taken


def clips_of(n: int, seed: int) -> list[tuple]:
    """Clips with repeated and missing stamps, missing times, times that fall, and gaps."""
    rng, out = random.Random(seed), []
    for c in range(n):
        at, rate = 0.0, rng.choice([None, 4.0, 7.5])
        for i in range(rng.choice([3, 20, 40, 90])):
            at += rng.choice([0.05, 0.1, 0.25, 0.25, 3.0, -0.2])
            pts = None if rng.random() < 0.2 else int(at * 4)
            out.append((f"c{c}", i + 1, pts, None if rng.random() < 0.3 else max(0.0, at), rate, f"c{c}/{i}"))
    return out


def test_sampling_of_any_clip_equals_the_loop(spark):
    rows = clips_of(60, 1)
    sampled, counts = sampling.sampled_clips(spark.createDataFrame(rows, DECODED).repartition(5), 4.0, 60)
    found: dict = {}
    for r in sampled.orderBy("clip_id", "tick").collect():
        found.setdefault(r["clip_id"], []).append(r["ordinal"])
    over = {r["clip_id"] for r in counts.filter("rejected").collect()}
    for c in {r[0] for r in rows}:
        want = loop([r[1:5] for r in rows if r[0] == c], 4.0, 60)
        assert (c in over) == (want is None)
        assert found.get(c) == want, c


def test_both_samplers_agree_where_times_rise(spark):
    rng = random.Random(2)
    rows = [(f"c{c}", i, t) for c in range(20) for i, t in enumerate(np.cumsum([rng.choice([0.05, 0.2, 0.25, 2.0]) for _ in range(50)]).tolist(), 1)]
    timed = spark.createDataFrame(rows, "clip_id string, ordinal int, time_s double")
    found = [sorted(map(tuple, f(timed).collect())) for f in (sampling.fixed_rate_sample, sampling.sample_in_any_order)]
    assert found[0] == found[1]


@pytest.fixture(scope="module")
def clips(spark):
    """Four good clips, one of too few frames, one over the limit; drawn as planes of a clip's own grey."""
    rows = [(c, i + 1, i, i / 4, 4.0, f"{c}/{i:03d}") for c, n in (("a", 30), ("b", 30), ("c", 24), ("d", 20), ("short", 6), ("long", 70)) for i in range(n)]
    drawn = []

    def load(needed):
        drawn.append(needed)
        grey = F.pmod(F.xxhash64(F.split("frame_path", "/")[0]), F.lit(200)).cast("int") + F.split("frame_path", "/")[1].cast("int")
        return needed.select("frame_path", F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.repeat(F.lpad(F.hex(grey), 2, "0"), 192)).alias("rgb"))

    return spark.createDataFrame(rows, DECODED), load, drawn


def test_review_of_clips(spark, clips):
    decoded, load, drawn = clips
    pairs = [("1-continuous", "a", "a", 0, "continuous"), ("2-cut", "a", "b", 1, "cut"), ("3-cut", "c", "d", 1, "cut"), ("4-cut", "short", "a", 1, "cut"), ("5-cut", "a", "long", 1, "cut"), ("6-cut", "a", "gone", 1, "cut"), ("7-continuous", "b", "short", 0, "continuous")]
    pairs = spark.createDataFrame(pairs, "pair_id string, clip_a string, clip_b string, discontinuous int, corruption string")
    spec = ev.FrozenSpec(4, Calibrator(HYBRID[:3], (0.0,) * 3, (1.0,) * 3, (1.0,) * 3, 0.0), Calibrator(HYBRID, (0.0,) * 4, (1.0,) * 4, (5.0, 5.0, 0.0, 0.0), -1.0), 0.5)
    spec = ev.replace(spec, fingerprint=spec.digest())
    drawn.clear()
    found = ev.review_clips(decoded, pairs, load, spec, limit=60, motion_side=8)
    assert {(r["pair_id"], r["reason"]) for r in found["rejected"].collect()} == {("4-cut", "too few sampled frames"), ("5-cut", "over the frame limit"), ("6-cut", "no decodable frames")}
    review = found["review"].collect()
    assert {r["case_id"] for r in review} == {"1-continuous", "2-cut", "3-cut", "7-continuous"} and len(review) == 4 * 5
    summary, alerts = found["summary"].first(), found["alerts"].first()
    assert (summary["pairs"], summary["known_good"], summary["known_bad"]) == (4, 2, 2)
    flags = {r["case_id"]: r["flagged"] for r in review}
    assert alerts["flags"] == sum(flags.values()) == summary["bad_flagged"] + summary["good_flagged"]
    assert alerts["recall"] == (flags["2-cut"] + flags["3-cut"]) / 2
    # Only the eight frames around each boundary are loaded, each once.
    loaded = [r["frame_path"] for d in drawn for r in d.collect()]
    near = {f"a/{i:03d}" for i in (26, 27, 28, 29, 0, 1, 2, 3)} | {f"b/{i:03d}" for i in (0, 1, 2, 3, 26, 27, 28, 29)} | {f"c/{i:03d}" for i in range(20, 24)} | {f"d/{i:03d}" for i in range(4)} | {f"short/{i:03d}" for i in range(4)}
    assert sorted(loaded) == sorted(near)
    bare = ev.review_clips(decoded, pairs, load, None, limit=60, motion_side=8)
    assert bare["alerts"].first()["recall"] is None and bare["review"].filter("display_score IS NOT NULL").count() == 0


def images_of(spark, sources: dict[str, str]):
    rows = []
    for number, (source, split) in enumerate(sources.items()):
        for i in range(40):
            x = np.zeros((12, 16, 3), np.uint8)
            x[..., 0], x[..., 1] = 30 + 25 * number, 5 * i % 255
            at = min(14, 2 + i // 3)
            x[4:8, max(0, at - 2) : at, 2] = 255
            rows.append((source, split, i, f"{source}/{i:05d}", 12, 16, bytearray(x.tobytes())))
    return spark.createDataFrame(rows, "source_id string, split string, frame_index int, frame_path string, height int, width int, rgb binary")


def test_horizons_share_frames_and_pairs(spark, monkeypatch, tmp_path):
    images = images_of(spark, {"dev-a": "dev", "dev-b": "dev", "dev-c": "dev", "test-a": "test", "test-b": "test"})
    asked, new = [], []
    pair_signals, frame_signature = ev.pair_signals, ev.frame_signature
    monkeypatch.setattr(ev, "pair_signals", lambda *a, known=None, **k: new.append((known, pair_signals(*a, known=known, **k))) or new[-1][1])
    monkeypatch.setattr(ev, "frame_signature", lambda x: asked.append(x) or frame_signature(x))
    spec = ev.develop_frames(images, f"file://{tmp_path}/spec", motion_side=12)
    paths = [r["frame_path"] for x in asked for r in x.select("frame_path").collect()]
    assert len(asked) == 2 and len(paths) == len(set(paths)) and all(p.startswith("dev") for p in paths)
    (none, first), (known, second) = new
    assert none is None and known is first and second.count() == second.select("a", "b").distinct().count()
    both = {(r["a"], r["b"]): r["still_ms"] for r in first.collect()}
    kept = {(r["a"], r["b"]): r["still_ms"] for r in second.collect()}
    assert all(kept[k] == v for k, v in both.items() if v is not None)  # the very values, not computed again
    # The same spec from the operators one by one.
    pixels = ev.Pixels.of(images, motion_side=12)
    dev = pixels.frames.filter("split = 'dev'")
    chosen = ev.select_horizon(pixels.score(ev.cases_of(dev, (2, 4, 8), 1))).filter("selected").first()["horizon"]
    matches = ev.cut(ev.cross_match(pixels.colours()))
    scored = pixels.score(ev.cases_of(dev, (chosen,), 3, matches))
    again = ev.freeze(scored, test=ev.cases_of(pixels.frames.filter("split = 'test'"), (chosen,), 3, matches).drop("context_paths", "target_paths"), horizon=chosen)
    assert (again.horizon, again.dev_cases, again.test_cases) == (spec.horizon, spec.dev_cases, spec.test_cases)
    assert again.threshold == pytest.approx(spec.threshold) and again.hybrid.coefficients == pytest.approx(spec.hybrid.coefficients)


def test_image_jobs_are_registered():
    assert {"develop_from_frames", "hold_out_from_frames", "review_batch"} <= set(queries_jobs.QUERIES)
