"""End-to-end jobs: development, held-out evaluation, diagnostics, batch review."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import cut
from ..operators.bootstrap import RESAMPLES, bootstrap_interval, grouped_bootstrap
from ..operators.calibrate import CHEAP, HYBRID, Calibrator, apply_calibrator, f1_threshold, fit_calibrator, flag_cases, select_horizon
from ..operators.cases import HORIZONS, build_cases, cross_match, expected_counts, split_overlap
from ..operators.fingerprint import table_fingerprint
from ..operators.metrics import alert_rates, balanced_accuracy, condition_means, directional_hits, primary_lane, ranking_metrics, recall_by_corruption, summary_metrics, walkthrough_summary
from ..operators.sampling import FRAME_LIMIT, SAMPLE_FPS, boundary_frames, clip_pair_window, sampled_clips
from ..operators.scoring import Scorer, colours_of, frame_signature, middle_frames, pair_signals, score_cases
from ..operators.signals import signal_table

SIGNALS = {"predictor": "prediction_error", "cheap": "cheap_probability", "hybrid": "hybrid_probability"}


@dataclass(frozen=True)
class FrozenSpec:
    """All that held-out evaluation may use, with the digest of its canonical JSON."""

    horizon: int
    cheap: Calibrator
    hybrid: Calibrator
    threshold: float
    mode: str = "proxy"
    dev_cases: str = ""
    test_cases: str = ""
    fingerprint: str = ""

    def digest(self) -> str:
        body = {k: v for k, v in asdict(self).items() if k != "fingerprint"}
        return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()

    def json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def read(text: str) -> FrozenSpec:
        x = json.loads(text)
        turn = lambda c: Calibrator(**{k: tuple(v) if isinstance(v, list) else v for k, v in c.items()})
        return FrozenSpec(x["horizon"], turn(x["cheap"]), turn(x["hybrid"]), x["threshold"], x["mode"], x.get("dev_cases", ""), x.get("test_cases", ""), x["fingerprint"])


#: What makes a case, whatever its scores; of these, a table's own columns are digested.
CASE_COLUMNS = ("case_id", "source_id", "split", "discontinuous", "corruption", "lane", "horizon", "context_paths", "target_paths", "target_source_id")


def case_digest(cases: DataFrame) -> str:
    """One digest of a case table's rows, in any order."""
    kinds = dict(cases.dtypes)
    own = [c for c in CASE_COLUMNS if c in kinds]
    return table_fingerprint(cases.select(*[F.to_json(c).alias(c) if kinds[c].startswith("array") else F.col(c) for c in own]), own)


def verify_spec(spec: FrozenSpec, mode: str | None = None, dev: DataFrame | None = None, test: DataFrame | None = None) -> None:
    """An altered spec, one of another mode, or one frozen with other case tables than those given is an error."""
    if spec.digest() != spec.fingerprint:
        raise ValueError("the frozen spec was altered")
    if mode is not None and spec.mode != mode:
        raise ValueError(f"the spec was frozen in mode {spec.mode}, not {mode}")
    for name, cases, frozen in (("development", dev, spec.dev_cases), ("held-out", test, spec.test_cases)):
        if cases is not None and case_digest(cases) != frozen:
            raise ValueError(f"the {name} cases are not those that the spec was frozen with")


def with_risks(rows: DataFrame, spec: FrozenSpec) -> DataFrame:
    return apply_calibrator(apply_calibrator(rows, spec.cheap, "cheap_probability"), spec.hybrid, "hybrid_probability")


def freeze(scored: DataFrame, mode: str = "proxy", test: DataFrame | None = None, horizon: int | None = None) -> FrozenSpec:
    """Horizon (if not given), both calibrators and the threshold from scored development cases (one table with a horizon column).

    test: the held-out cases, whose sources must not be among the development ones. The spec keeps a digest of either case
    table. Only coefficients, the horizon, the threshold and digests reach the driver.
    """
    if test is not None:
        split_overlap(scored.select("source_id", F.lit("dev").alias("split")).unionByName(test.select("source_id", F.lit("test").alias("split"))), strict=True)
    if horizon is None:
        horizon = select_horizon(scored).filter("selected").first()["horizon"]
    rows = cut(scored.filter(F.col("horizon") == horizon), "development")
    cheap, hybrid = fit_calibrator(rows, CHEAP), fit_calibrator(rows, HYBRID)
    risks = apply_calibrator(primary_lane(rows), hybrid, "hybrid_probability")
    digests = case_digest(scored), case_digest(test) if test is not None else ""
    spec = FrozenSpec(horizon, cheap, hybrid, f1_threshold(risks, "hybrid_probability").first()["threshold"], mode, *digests)
    return replace(spec, fingerprint=spec.digest())


def evaluate(scored: DataFrame, spec: FrozenSpec, resamples: int = RESAMPLES, rows: int | None = None, groups: int | None = None) -> dict[str, DataFrame]:
    """Tables of held-out cases under a verified spec: predictions, summary, ranking, accuracy, recall, replicates, intervals.

    A spec frozen with held-out cases takes these only.
    """
    verify_spec(spec, test=scored if spec.test_cases else None)
    chosen = scored.filter(F.col("horizon") == spec.horizon)
    if rows is not None or groups is not None:
        expected_counts(chosen, rows, groups)
    predictions = cut(with_risks(chosen, spec), "held-out")
    primary = primary_lane(predictions)
    replicates = cut(grouped_bootstrap(primary, SIGNALS, resamples), "replicates")
    deltas = [bootstrap_interval(replicates, c) for c in replicates.columns if c.startswith("delta_")]
    return {
        "predictions": predictions,
        "summary": summary_metrics(predictions),
        "ranking": ranking_metrics(primary, ("prediction_error", "encoder_distance", "cheap_probability", "hybrid_probability")),
        "accuracy": balanced_accuracy(primary, spec.threshold, "hybrid_probability"),
        "recall": recall_by_corruption(predictions, spec.threshold, "hybrid_probability"),
        "replicates": replicates,
        "intervals": deltas[0].unionByName(deltas[1]),
    }


#: Gives height, width and rgb to rows of frame_path.
Loader = Callable[[DataFrame], DataFrame]


@dataclass
class Pixels:
    """Frames by index, a way to load the pixels of some of them, and what was computed from pixels so far: each frame is reduced once and each pair of frames met once, whichever horizons ask."""

    frames: DataFrame
    load: Loader
    motion_side: int | None = None
    signatures: DataFrame | None = None
    signals: DataFrame | None = None

    @staticmethod
    def of(images: DataFrame, load: Loader | None = None, motion_side: int | None = None) -> Pixels:
        """images: source_id, split, frame_index, frame_path, and without a loader height, width, rgb too."""
        return Pixels(images.select("source_id", "split", "frame_index", "frame_path"), load or (lambda needed: images.join(needed.select("frame_path"), "frame_path", "left_semi")), motion_side)

    def colours(self) -> DataFrame:
        """source_id, split, colour of each source's middle frame; only these are loaded."""
        middle = cut(middle_frames(self.frames), "middle")
        pixels = self.load(middle.select("frame_path")).select("frame_path", "height", "width", "rgb")
        return colours_of(middle.join(pixels, "frame_path"))

    def score(self, cases: DataFrame, scorer: Scorer | None = None) -> DataFrame:
        """score_cases() of a written case table; only frames near its boundaries that were not reduced before are loaded."""
        near = boundary_frames(cases).select("frame_path").distinct()
        if self.signatures is not None:
            near = near.join(self.signatures.select("frame_path"), "frame_path", "left_anti")
        found = cut(frame_signature(self.load(cut(near, "near"))), "signatures")
        self.signatures = found if self.signatures is None else self.signatures.unionByName(found)
        self.signals = pair_signals(cases, self.signatures, motion_side=self.motion_side, known=self.signals)
        return cut(score_cases(cases, self.signatures, scorer, signals=self.signals), "scored")


def cases_of(frames: DataFrame, horizons: tuple[int, ...], count: int, matches: DataFrame | None = None) -> DataFrame:
    """The written case tables of several horizons in one; sources too short for a horizon have no case there."""
    cases = build_cases(frames, horizons[0], count, matches)
    for h in horizons[1:]:
        cases = cases.unionByName(build_cases(frames, h, count, matches))
    return cut(cases, "cases")


def develop_frames(images: DataFrame, path: str, mode: str = "proxy", force: bool = False, held_out: str | None = None, horizons: tuple[int, ...] = HORIZONS, count: int = 3, scorer: Scorer | None = None, motion_side: int | None = None, load: Loader | None = None) -> FrozenSpec:
    """Development from frames of the splits dev and test, the spec written to path.

    The horizon is chosen on one anchor of each development source without cross cases; for it, cases of ``count`` anchors with cross matches inside the split are
    built and scored, reusing every frame and pair of frames that the choice met. The test split's cases are built to be isolated and digested, not
    scored. An existing spec is an error unless forced, and held-out results at held_out always are.
    """
    spark = images.sparkSession
    if held_out is not None and exists(spark, held_out):
        raise ValueError(f"held-out results exist at {held_out}: what was tested is not frozen anew")
    pixels = Pixels.of(images, load, motion_side)
    development = pixels.frames.filter("split = 'dev'")
    horizon = select_horizon(pixels.score(cases_of(development, horizons, 1), scorer)).filter("selected").first()["horizon"]
    matches = cut(cross_match(pixels.colours()), "matches")
    scored = pixels.score(cases_of(development, (horizon,), count, matches), scorer)
    test = cases_of(pixels.frames.filter("split = 'test'"), (horizon,), count, matches).drop("context_paths", "target_paths")  # as scored tables are
    return write_spec(freeze(scored, mode, test, horizon), spark, path, force)


def hold_out_frames(images: DataFrame, spec_path: str, path: str, resamples: int = RESAMPLES, count: int = 3, scorer: Scorer | None = None, motion_side: int | None = None, load: Loader | None = None) -> dict[str, DataFrame]:
    """run_holdout() from frames of the test split at the frozen horizon, with the scoring that development had."""
    horizon = read_spec(images.sparkSession, spec_path).horizon
    pixels = Pixels.of(images.filter("split = 'test'"), load, motion_side)
    matches = cut(cross_match(pixels.colours()), "matches")
    return run_holdout(pixels.score(cases_of(pixels.frames, (horizon,), count, matches), scorer), spec_path, path, resamples)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def run_development(scored: DataFrame, path: str, mode: str = "proxy", force: bool = False, test: DataFrame | None = None, held_out: str | None = None) -> FrozenSpec:
    """freeze(), written to path; an existing spec is an error unless forced, and held-out results at held_out always are."""
    if held_out is not None and exists(scored.sparkSession, held_out):
        raise ValueError(f"held-out results exist at {held_out}: what was tested is not frozen anew")
    return write_spec(freeze(scored, mode, test), scored.sparkSession, path, force)


def write_spec(spec: FrozenSpec, spark: SparkSession, path: str, force: bool = False) -> FrozenSpec:
    spark.createDataFrame([(spec.json(),)], "value string").coalesce(1).write.mode("overwrite" if force else "errorifexists").text(path)
    return spec


def read_spec(spark: SparkSession, path: str) -> FrozenSpec:
    return FrozenSpec.read("".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def run_holdout(scored: DataFrame, spec_path: str, path: str, resamples: int = RESAMPLES) -> dict[str, DataFrame]:
    """evaluate() under the spec at spec_path, each table written under path; an earlier result is an error."""
    spark = scored.sparkSession
    found = evaluate(scored, read_spec(spark, spec_path), resamples)
    for name, table in found.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")
    return {name: spark.read.parquet(f"{path}/{name}") for name in found}


def diagnostics(scored: DataFrame, spec: FrozenSpec, rows: int | None = None) -> dict[str, DataFrame]:
    """Means per condition, directional hits and alert rates of diagnostic cases; cases of another horizon than the frozen one, or more or fewer than rows, are an error."""
    verify_spec(spec)
    if not scored.filter(~F.col("horizon").eqNullSafe(F.lit(spec.horizon))).isEmpty():
        raise ValueError(f"diagnostic cases must all have the frozen horizon {spec.horizon}")
    if rows is not None:
        expected_counts(scored, rows, None)
    flagged = flag_cases(with_risks(scored, spec), spec.threshold, "hybrid_probability")
    return {"means": condition_means(flagged), "hits": directional_hits(flagged), "alerts": alert_rates(flagged)}


def review(scored: DataFrame, spec: FrozenSpec | None) -> DataFrame:
    """Review rows of scored cases: five signals each, with display_score (rint of 100 * risk) and flag, both null without a spec."""
    if spec is None:
        rows = scored.withColumns({"display_score": F.lit(None).cast("int"), "flagged": F.lit(None).cast("int")})
    else:
        verify_spec(spec)
        rows = flag_cases(with_risks(scored, spec), spec.threshold, "hybrid_probability").withColumn("display_score", F.rint(100 * F.col("hybrid_probability")).cast("int"))
    return signal_table(rows).join(rows.select("case_id", "display_score", "flagged"), "case_id")


def review_clips(decoded: DataFrame, pairs: DataFrame, load: Loader, spec: FrozenSpec | None, horizon: int = 4, sample_fps: float = SAMPLE_FPS, limit: int = FRAME_LIMIT, scorer: Scorer | None = None, motion_side: int | None = None) -> dict[str, DataFrame]:
    """Batch review from decoded clips: review rows, alert rates and walkthrough summary of the pairs that can be scored, and the rejected ones with a reason.

    decoded: clip_id, ordinal, pts, time_s, avg_rate, frame_path; pairs: pair_id (string, its condition after the first hyphen), clip_a, clip_b, discontinuous, corruption. Clips over
    the frame limit are set aside, missing times filled, repeated stamps dropped, frames sampled at a fixed rate; a pair with
    a clip that is set aside, absent or too short is rejected, never padded. Only frames near a boundary are loaded.
    """
    sampled, counts = sampled_clips(decoded, sample_fps, limit)
    sampled, counts = cut(sampled, "sampled"), cut(counts, "clips")
    windows = cut(clip_pair_window(sampled, pairs, horizon), "windows")
    clip = F.when(F.col("role") == "context", F.col("clip_a")).otherwise(F.col("clip_b"))
    met = windows.join(pairs, "pair_id").withColumn("clip_id", clip).join(decoded.select("clip_id", "ordinal", "frame_path"), ["clip_id", "ordinal"])
    side = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("position", "frame_path")))), lambda x: x["frame_path"])
    paths = met.groupBy("pair_id").agg(side("context").alias("context_paths"), side("target").alias("target_paths"))
    cases = pairs.join(paths, "pair_id").select(F.col("pair_id").alias("case_id"), F.col("clip_a").alias("source_id"), F.lit("review").alias("split"), "discontinuous", "corruption", F.lit("primary").alias("lane"), F.lit(horizon).alias("horizon"), "context_paths", "target_paths", F.col("clip_b").alias("target_source_id"))
    cases = cut(cases, "cases")
    pixels = Pixels(decoded.select("frame_path"), load, motion_side)
    scored = pixels.score(cases, scorer)
    if spec is None:
        flagged = scored.withColumn("flagged", F.lit(None).cast("int"))
    else:
        verify_spec(spec)
        flagged = flag_cases(with_risks(scored, spec), spec.threshold, "hybrid_probability")
    taken = sampled.groupBy("clip_id").agg(F.count("*").alias("sampled"))
    known = counts.join(taken, "clip_id", "left").select("clip_id", "rejected", F.coalesce("sampled", F.lit(0)).alias("sampled"))
    of = lambda name: known.select(F.col("clip_id").alias(name), F.col("rejected").alias(f"_over_{name}"), F.col("sampled").alias(f"sampled_{name[-1]}"))
    lost = pairs.join(windows.select("pair_id").distinct(), "pair_id", "left_anti").join(of("clip_a"), "clip_a", "left").join(of("clip_b"), "clip_b", "left")
    over, absent = F.coalesce("_over_clip_a", F.lit(False)) | F.coalesce("_over_clip_b", F.lit(False)), F.col("sampled_a").isNull() | F.col("sampled_b").isNull()
    reason = F.when(absent, "no decodable frames").when(over, "over the frame limit").otherwise("too few sampled frames")
    return {"review": review(scored, spec), "rejected": lost.select("pair_id", reason.alias("reason"), "sampled_a", "sampled_b"), "alerts": alert_rates(flagged), "summary": walkthrough_summary(flagged)}
