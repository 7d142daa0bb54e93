"""Every operator applied to the driver's tables, with the same result as DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import calibrate, cases, fingerprint, metrics, sampling
from .operators import bootstrap as boot
from .operators import signals as sig
from .operators.metrics import rounded
from .sources import testmap as tm

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

HALF_DAY = 1 / 43_200
RISK = calibrate.Calibrator(calibrate.HYBRID, (25.5, 0.05, 0.04, 38_000.0), (14.43, 0.0316, 0.0, 23_300.0), (0.02, 0.5, -3.0, 0.4), 0.55)
CHEAP_RISK = calibrate.Calibrator(calibrate.CHEAP, (25.5, 0.05, 0.04), (14.43, 0.0316, 0.0258), (0.3, -0.2, 0.1), -0.1)
THRESHOLD, RESAMPLES = 0.6, boot.RESAMPLES


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def risk_sql(c: calibrate.Calibrator) -> str:
    z = f"CAST({c.intercept} AS DOUBLE)" + "".join(f" + CAST({k} AS DOUBLE) * ({f} - CAST({m} AS DOUBLE)) / CAST({1.0 if abs(s) <= 1e-12 else s} AS DOUBLE)" for f, m, s, k in zip(c.features, c.mean, c.scale, c.coefficients, strict=True))
    return f"(CASE WHEN ({z}) >= 0 THEN 1 / (1 + exp(-({z}))) ELSE exp({z}) / (1 + exp({z})) END)"


SIZES = "sizes AS (SELECT source_id, split, count(*) AS n FROM frames GROUP BY ALL)"
RISKS = f"risks AS (SELECT *, round({risk_sql(RISK)}, 9) AS risk FROM signals)"


def anchor_sql(horizon: int, count: int = 3, sizes: str = "sizes") -> str:
    last = f"(n - {max(horizon, 2)} - {horizon})"
    first = 16 - horizon
    return f"""SELECT source_id, split, n, {horizon} AS horizon, CAST(row_number() OVER (PARTITION BY source_id ORDER BY anchor) - 1 AS INTEGER) AS ordinal, anchor
      FROM (SELECT DISTINCT source_id, split, n, CAST(round_even({first} + i * ({last} - {first}) / CAST({max(count - 1, 1)} AS DOUBLE), 0) AS INTEGER) AS anchor
            FROM {sizes}, range({count}) t(i) WHERE {last} >= {first})"""


def risks(spark: SparkSession, folder: str) -> DataFrame:
    return calibrate.apply_calibrator(tm.signals(spark, folder), RISK).withColumn("risk", F.round("risk", 9))


# Fingerprints and manifests


def digest_sql(lines: str, key: str, count: str, name: str, levels: int = 4) -> str:
    """A tree of at most ``levels`` levels above the leaves, as digest_lines builds it."""
    depth = " + ".join(f"CAST(m > {fingerprint.LEAF * 16**d} AS INTEGER)" for d in range(levels))
    raised = "".join(
        f"""
  level{d - 1} AS (SELECT {key}, substr(node, 1, {d - 1}) AS node, sha256(string_agg(node || ':' || digest, chr(10) ORDER BY node)) AS digest FROM level{d} WHERE length(node) = {d} GROUP BY 1, 2
    UNION ALL SELECT * FROM level{d} WHERE length(node) < {d}),"""
        for d in range(levels, 0, -1)
    )
    return f"""entries AS (SELECT {key}, count(*) AS times, CAST(count(*) AS VARCHAR) || ':' || line AS entry FROM ({lines}) GROUP BY {key}, line),
  placed AS (SELECT *, substr(sha256(entry), 1, {depth}) AS node FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS m FROM entries)),
  level{levels} AS (SELECT {key}, node, sha256(string_agg(entry, chr(10) ORDER BY entry)) AS digest FROM placed GROUP BY 1, 2),{raised}
  totals AS (SELECT {key}, CAST(sum(times) AS BIGINT) AS {count} FROM entries GROUP BY 1)
  SELECT {key}, {count}, digest AS {name} FROM totals JOIN level0 USING ({key})"""


NAME_LINES = "SELECT DISTINCT split, CAST(source_id AS VARCHAR) AS line FROM frames"
TEXT_LINES = "SELECT source, CAST(doc_id AS VARCHAR) || ':' || sha256(text) AS line FROM documents"


@query(f"WITH {tm.FRAMES}, {digest_sql(NAME_LINES, 'split', 'n', 'names_sha256')}")
def corpus_manifest(spark, folder):
    return fingerprint.corpus_manifest(tm.frames(spark, folder))


@query(f"""WITH {tm.FRAMES} SELECT frame_id, sha256('frame_index=''' || frame_index || ''',frame_path=''' || frame_path || ''',source_id=''' || source_id || ''',split=''' || split || '''') AS fingerprint FROM frames""")
def row_fingerprint(spark, folder):
    rows = tm.frames(spark, folder)
    return rows.select("frame_id", fingerprint.row_fingerprint(rows, ["split", "source_id", "frame_path", "frame_index"]).alias("fingerprint"))


@query()
def json_fingerprint(spark, folder):
    rows = tm.table(spark, folder, "events").select("event_id", "user_id", "event_type", "props")
    return fingerprint.json_fingerprint(rows, ["user_id", "event_type", "props"]).select("event_id", "fingerprint")


@query(f"WITH {digest_sql(TEXT_LINES, 'source', 'files', 'tree_sha256')}")
def tree_fingerprint(spark, folder):
    docs = tm.table(spark, folder, "documents").select("source", F.col("doc_id").cast("string").alias("name"), F.col("text").alias("content"))
    return fingerprint.tree_fingerprint(docs, "source")


# Case construction

CASE_KEYS = ("case_id", "corruption", "discontinuous", "horizon", "lane", "source_id", "split")
CASE_LINES = "SELECT split, sha256(" + " || ',' || ".join(f"'{c}=''' || replace(CAST({c} AS VARCHAR), '''', '''''') || ''''" for c in CASE_KEYS) + ") AS line FROM signals"


@query(f"WITH {tm.SIGNALS}, {digest_sql(CASE_LINES, 'split', 'n', 'cases_sha256')}")
def case_fingerprint(spark, folder):
    """One digest of each split's case table, as a frozen spec keeps it."""
    rows = tm.signals(spark, folder)
    return fingerprint.digest_lines(rows.select("split", fingerprint.row_fingerprint(rows, [*CASE_KEYS]).alias("line")), ("split",), "n", "cases_sha256")



@query(f"WITH {tm.FRAMES} SELECT source_id, frame_id, frame_index, count(*) OVER (PARTITION BY source_id) AS n FROM frames")
def frame_index(spark, folder):
    events = tm.table(spark, folder, "events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("source_id"), F.col("event_id").alias("frame_id"), "ts")
    return cases.order_frames(events, "ts", "frame_id").select("source_id", "frame_id", "frame_index", "n")


@query(f"WITH {tm.FRAMES}, {SIZES} {' UNION ALL '.join(anchor_sql(h) for h in cases.HORIZONS)}")
def anchors(spark, folder):
    sizes = cases.source_sizes(tm.frames(spark, folder))
    parts = [cases.anchors(sizes, h).withColumn("horizon", F.lit(h)) for h in cases.HORIZONS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


SHORT = "typed AS (SELECT CAST(user_id AS VARCHAR) || '-' || event_type AS source_id, 'dev' AS split FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL)"


@query(f"WITH {SHORT} SELECT source_id, split, count(*) AS n FROM typed GROUP BY ALL HAVING count(*) < 24")
def short_sources(spark, folder):
    typed = tm.table(spark, folder, "events").filter("user_id IS NOT NULL AND event_type IS NOT NULL").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("source_id"), F.lit("dev").alias("split"))
    return cases.short_sources(cases.source_sizes(typed), 8)


HORIZON = 4
ANCHORS4 = f"anchors AS ({anchor_sql(HORIZON)})"


def placed(spark: SparkSession, folder: str, index) -> DataFrame:
    rows = tm.frames(spark, folder)
    spots = cases.anchors(cases.source_sizes(rows), HORIZON).select("source_id", "ordinal", F.posexplode(index).alias("position", "frame_index"))
    return spots.join(rows.select("source_id", "frame_index", "frame_path"), ["source_id", "frame_index"]).select("source_id", "ordinal", "position", "frame_index", "frame_path")


def placed_sql(index: str, length: int) -> str:
    return f"""WITH {tm.FRAMES}, {SIZES}, {ANCHORS4} SELECT a.source_id, a.ordinal, CAST(j AS INTEGER) AS position, f.frame_index, f.frame_path
      FROM anchors a, range({length}) t(j), frames f WHERE f.source_id = a.source_id AND f.frame_index = {index}"""


@query(placed_sql(f"a.anchor - {16 - HORIZON} + j", 16 - HORIZON))
def context_window(spark, folder):
    return placed(spark, folder, cases.context_index(HORIZON))


@query(placed_sql("a.anchor + j", HORIZON))
def target_continuous(spark, folder):
    return placed(spark, folder, cases.target_index("continuous", HORIZON))


@query(placed_sql(f"a.anchor + {max(HORIZON, 2)} + j", HORIZON))
def target_skip(spark, folder):
    return placed(spark, folder, cases.target_index("skip", HORIZON))


@query(placed_sql(f"a.anchor + {HORIZON - 2} - 2 * (j // 2) + j % 2", HORIZON))
def target_reorder(spark, folder):
    return placed(spark, folder, cases.target_index("reorder", HORIZON))


MATCHES = """matches AS (SELECT source_id, target_source_id, distance FROM (SELECT a.source_id, b.source_id AS target_source_id, sqrt((a.c1 - b.c1) * (a.c1 - b.c1) + (a.c2 - b.c2) * (a.c2 - b.c2)) AS distance
  FROM colours a JOIN colours b ON a.split = b.split AND a.source_id <> b.source_id)
  QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY distance, target_source_id) = 1)"""


@query(f"WITH {tm.FRAMES}, {tm.COLOURS}, {MATCHES} SELECT source_id, target_source_id, round(distance, 6) AS distance FROM matches")
def cross_match(spark, folder):
    return rounded(cases.cross_match(tm.colours(spark, folder)))


CROSS = f"""crossed AS (SELECT a.source_id, a.split, a.ordinal, m.target_source_id, least(greatest(CAST(round_even(a.anchor / CAST(greatest(1, a.n - 1) AS DOUBLE) * o.n, 0) AS INTEGER), 0), o.n - {HORIZON}) AS start
  FROM anchors a JOIN matches m USING (source_id) JOIN sizes o ON o.source_id = m.target_source_id)"""


def matched_cases(spark: SparkSession, folder: str) -> DataFrame:
    return cases.build_cases(tm.frames(spark, folder), HORIZON, 3, cases.cross_match(tm.colours(spark, folder)))


@query(f"""WITH {tm.FRAMES}, {SIZES}, {ANCHORS4}, {tm.COLOURS}, {MATCHES}, {CROSS} SELECT c.source_id, c.ordinal, c.target_source_id, CAST(j AS INTEGER) AS position, f.frame_path
  FROM crossed c, range({HORIZON}) t(j), frames f WHERE f.source_id = c.target_source_id AND f.frame_index = c.start + j""")
def target_cross(spark, folder):
    rows = matched_cases(spark, folder).filter("lane = 'secondary'")
    return rows.select("source_id", F.element_at(F.split("case_id", "-"), 3).cast("int").alias("ordinal"), "target_source_id", F.posexplode("target_paths").alias("position", "frame_path"))


KIND_ROWS = "(VALUES ('continuous', 0, 'continuous'), ('skip', 1, 'temporal_skip'), ('reorder', 1, 'block_reorder')) k(suffix, discontinuous, corruption)"
CASES = f"""cases AS (
  SELECT split || '-' || source_id || '-' || lpad(CAST(ordinal AS VARCHAR), 2, '0') || '-h{HORIZON}-' || suffix AS case_id, *, list_transform(range(anchor - {16 - HORIZON}, anchor), lambda i: i) AS context,
    CASE suffix WHEN 'continuous' THEN range(anchor, anchor + {HORIZON}) WHEN 'skip' THEN range(anchor + {HORIZON}, anchor + 2 * {HORIZON}) WHEN 'cross' THEN range(start, start + {HORIZON})
      ELSE [anchor + 2, anchor + 3, anchor, anchor + 1] END AS target
  FROM (SELECT a.source_id, a.split, a.ordinal, a.anchor, suffix, discontinuous, corruption, 'primary' AS lane, a.source_id AS target_source, CAST(NULL AS BIGINT) AS target_source_id, 0 AS start FROM anchors a, {KIND_ROWS}
    UNION ALL SELECT c.source_id, c.split, c.ordinal, a.anchor, 'cross', 1, 'cross_video_splice', 'secondary', c.target_source_id, c.target_source_id, c.start FROM crossed c JOIN anchors a ON a.source_id = c.source_id AND a.ordinal = c.ordinal))"""
PATHS = """paths AS (SELECT c.case_id, string_agg(f.frame_path, ',' ORDER BY f.frame_index) AS context_paths FROM cases c JOIN frames f ON f.source_id = c.source_id AND list_contains(c.context, f.frame_index) GROUP BY 1),
 goals AS (SELECT c.case_id, string_agg(f.frame_path, ',' ORDER BY list_position(c.target, f.frame_index)) AS target_paths FROM cases c JOIN frames f ON f.source_id = c.target_source AND list_contains(c.target, f.frame_index) GROUP BY 1)"""
ALL_CASES = f"WITH {tm.FRAMES}, {SIZES}, {ANCHORS4}, {tm.COLOURS}, {MATCHES}, {CROSS}, {CASES}, {PATHS}"


@query(f"""{ALL_CASES} SELECT case_id, source_id, split, CAST(discontinuous AS INTEGER) AS discontinuous, corruption, lane, {HORIZON} AS horizon, context_paths, target_paths, target_source_id
  FROM cases JOIN paths USING (case_id) JOIN goals USING (case_id)""")
def build_cases(spark, folder):
    rows = matched_cases(spark, folder)
    return rows.withColumns({c: F.array_join(c, ",") for c in ("context_paths", "target_paths")})


@query("""SELECT source_id, count(*) AS splits FROM (SELECT DISTINCT l_suppkey AS source_id, l_orderkey % 97 = 0 AS split FROM lineitem) GROUP BY 1 HAVING count(*) > 1""")
def split_isolation(spark, folder):
    rows = tm.table(spark, folder, "lineitem").select(F.col("l_suppkey").alias("source_id"), (F.col("l_orderkey") % 97 == 0).alias("split"))
    return cases.split_overlap(rows)


@query(f"WITH {tm.SIGNALS} SELECT count(*) AS rows, count(DISTINCT source_id) AS groups FROM signals WHERE lane = 'primary'")
def expected_counts(spark, folder):
    return cases.expected_counts(metrics.primary_lane(tm.signals(spark, folder)))


# Clip sampling

DEDUPED = "deduped AS (SELECT * FROM decoded QUALIFY row_number() OVER (PARTITION BY clip_id, coalesce(pts, CAST(ordinal AS BIGINT)) ORDER BY ordinal) = 1)"
TIMED = f"timed AS (SELECT clip_id, ordinal, coalesce(time_s, (ordinal - 1) / coalesce(avg_rate, CAST({HALF_DAY!r} AS DOUBLE))) AS time_s FROM decoded)"


@query(f"WITH {tm.DECODED}, {DEDUPED} SELECT clip_id, ordinal, pts FROM deduped")
def dedupe_pts(spark, folder):
    return sampling.dedupe_pts(tm.decoded(spark, folder)).select("clip_id", "ordinal", "pts")


@query(f"WITH {tm.DECODED}, {TIMED} SELECT clip_id, ordinal, round(time_s, 3) AS time_s FROM timed")
def fallback_time(spark, folder):
    return rounded(sampling.fallback_time(tm.decoded(spark, folder), HALF_DAY).select("clip_id", "ordinal", "time_s"), 3)


@query(f"WITH {tm.DECODED} SELECT clip_id, count(*) AS n, count(*) > 80 AS rejected FROM decoded GROUP BY clip_id")
def frame_limit(spark, folder):
    return sampling.frame_limit(tm.decoded(spark, folder), 80)


CLOCK = """clock AS (SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS ordinal,
  (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / CAST(1e6 AS DOUBLE) AS time_s FROM events WHERE user_id IS NOT NULL)"""
SAMPLED = f"""{CLOCK}, spot AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY ordinal) - 1 AS pos FROM clock),
 ends AS (SELECT clip_id, max(time_s) AS t, count(*) AS n FROM clock GROUP BY 1),
 ticks AS (SELECT clip_id, unnest(range(CAST(least(floor((t + 1e-9) * CAST({HALF_DAY!r} AS DOUBLE)), n - 1) AS BIGINT) + 1)) AS k FROM ends WHERE t >= 0),
 before AS (SELECT t.clip_id, k, (SELECT count(*) FROM spot s WHERE s.clip_id = t.clip_id AND s.time_s + 1e-9 < k / CAST({HALF_DAY!r} AS DOUBLE)) AS f FROM ticks t),
 taken AS (SELECT clip_id, k, k + max(f - k) OVER (PARTITION BY clip_id ORDER BY k) AS pos FROM before),
 sampled AS (SELECT clip_id, CAST(k AS BIGINT) AS tick, ordinal FROM taken JOIN spot USING (clip_id, pos))"""


def clock(spark: SparkSession, folder: str) -> DataFrame:
    """The decoded clips with all their times."""
    from pyspark.sql import Window as W

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    by = W.partitionBy("user_id")
    rows = tm.table(spark, folder, "events").filter("user_id IS NOT NULL")
    return rows.select(F.col("user_id").alias("clip_id"), F.row_number().over(by.orderBy("ts", "event_id")).alias("ordinal"), ((micros - F.min(micros).over(by)) / F.lit(1e6)).alias("time_s"))


@query(f"WITH {SAMPLED} SELECT * FROM sampled")
def fixed_rate_sample(spark, folder):
    return sampling.fixed_rate_sample(clock(spark, folder), HALF_DAY)


PAIRED = f"""{SAMPLED}, clips AS (SELECT DISTINCT clip_id FROM sampled), pairs AS (SELECT a.clip_id AS pair_id, a.clip_id AS clip_a, b.clip_id AS clip_b FROM clips a JOIN clips b ON b.clip_id = a.clip_id + 1),
 a AS (SELECT pair_id, ordinal, row_number() OVER (PARTITION BY pair_id ORDER BY tick DESC) AS r FROM pairs JOIN sampled ON clip_id = clip_a),
 b AS (SELECT pair_id, ordinal, row_number() OVER (PARTITION BY pair_id ORDER BY tick) AS r FROM pairs JOIN sampled ON clip_id = clip_b),
 both_ AS (SELECT pair_id, 'context' AS role, CAST({16 - HORIZON} - r AS INTEGER) AS position, ordinal FROM a WHERE r <= {16 - HORIZON} UNION ALL SELECT pair_id, 'target', CAST(r - 1 AS INTEGER), ordinal FROM b WHERE r <= {HORIZON})"""


def clip_pairs(spark: SparkSession, folder: str) -> DataFrame:
    sampled = sampling.fixed_rate_sample(clock(spark, folder), HALF_DAY)
    clips = sampled.select("clip_id").distinct()
    pairs = clips.select(F.col("clip_id").alias("pair_id"), F.col("clip_id").alias("clip_a"), (F.col("clip_id") + 1).alias("clip_b"))
    return sampling.clip_pair_window(sampled, pairs, HORIZON)


@query(f"WITH {PAIRED} SELECT * FROM both_ QUALIFY count(*) OVER (PARTITION BY pair_id) = 16")
def clip_pair_window(spark, folder):
    return clip_pairs(spark, folder)


@query(f"""{ALL_CASES}, long AS (SELECT case_id, 'context' AS side, CAST(i AS INTEGER) AS position, split_part(context_paths, ',', CAST(i + {16 - HORIZON - 3} AS INTEGER)) AS frame_path FROM paths, range(4) t(i)
  UNION ALL SELECT case_id, 'target', CAST(i AS INTEGER), split_part(target_paths, ',', CAST(i + 1 AS INTEGER)) FROM goals, range(4) t(i)) SELECT * FROM long""")
def boundary_frames(spark, folder):
    return sampling.boundary_frames(matched_cases(spark, folder))


# Signals


@query(f"""{ALL_CASES} SELECT case_id, CAST(i AS INTEGER) AS pair, split_part(context_paths, ',', CAST(i + {16 - HORIZON - 3} AS INTEGER)) AS left_path, split_part(target_paths, ',', CAST(i + 1 AS INTEGER)) AS right_path
  FROM paths JOIN goals USING (case_id), range(4) t(i)""")
def boundary_pairs(spark, folder):
    return sig.boundary_pairs(matched_cases(spark, folder))


BINS = f"{tm.FRAMES}, bins AS (SELECT source_id, frame_index // 10 AS w, CAST(floor(value / 16) AS BIGINT) AS bin, count(*) AS weight FROM frames GROUP BY ALL)"


@query(f"""WITH {BINS}, t AS (SELECT source_id, w, sum(weight) AS total FROM bins GROUP BY ALL),
  c AS (SELECT p.source_id, p.w, sum(sqrt(CAST(p.weight AS DOUBLE) * q.weight)) AS common FROM bins p JOIN bins q ON p.source_id = q.source_id AND q.w = p.w + 1 AND p.bin IS NOT DISTINCT FROM q.bin GROUP BY ALL)
  SELECT a.source_id || ':' || a.w AS pair_id, round(sqrt(greatest(1 - coalesce(common, 0) / sqrt(CAST(a.total AS DOUBLE) * b.total), 0)), 6) AS histogram_distance
  FROM t a JOIN t b ON a.source_id = b.source_id AND b.w = a.w + 1 LEFT JOIN c ON c.source_id = a.source_id AND c.w = a.w""")
def histogram_distance(spark, folder):
    rows = tm.frames(spark, folder).groupBy("source_id", F.floor(F.col("frame_index") / 10).alias("w"), F.floor(F.col("value") / 16).alias("bin")).agg(F.count("*").alias("weight"))
    side = lambda shift: rows.select(F.concat_ws(":", F.col("source_id").cast("string"), (F.col("w") - shift).cast("string")).alias("pair_id"), "bin", "weight")
    return rounded(sig.histogram_distance(side(0), side(1)))


@query(f"""WITH {tm.FRAMES}, moves AS (SELECT source_id, frame_index // 8 AS w, frame_index % 8 AS i, abs(value - lag(value) OVER (PARTITION BY source_id ORDER BY frame_index)) AS m FROM frames),
  whole AS (SELECT source_id, w, max(m) FILTER (i = 4) AS b, median(m) FILTER (i <> 4) AS base FROM moves WHERE i > 0 GROUP BY ALL HAVING count(m) = 7)
  SELECT source_id, CAST(w AS BIGINT) AS w, round(abs(b - base) / (base + 1e-6), 6) AS flow_discontinuity FROM whole""")
def flow_discontinuity(spark, folder):
    from pyspark.sql import Window as W

    before = F.lag("value").over(W.partitionBy("source_id").orderBy("frame_index"))
    moves = tm.frames(spark, folder).select("source_id", F.floor(F.col("frame_index") / 8).alias("w"), (F.col("frame_index") % 8).alias("i"), F.abs(F.col("value") - before).alias("m")).filter("i > 0 AND m IS NOT NULL")
    whole = moves.groupBy("source_id", "w").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("s")).filter(F.size("s") == 7)
    return rounded(whole.select("source_id", "w", sig.flow_discontinuity(F.transform("s", lambda x: x["m"]), F.lit(3)).alias("flow_discontinuity")))


PROXY = "0.75 * histogram_distance + 0.75 * ssim_distance + 0.05 * least(flow_discontinuity, 10)"


@query(f"""WITH {tm.SIGNALS} SELECT case_id, round({PROXY}, 6) AS prediction_error, round(0.65 * histogram_distance + 0.35 * ssim_distance, 6) AS encoder_distance, CAST(greatest(1, horizon // 2) AS INTEGER) AS tubelets FROM signals""")
def proxy_scores(spark, folder):
    return rounded(sig.proxy_scores(tm.signals(spark, folder)).select("case_id", "prediction_error", "encoder_distance", F.size("tubelet_errors").alias("tubelets")))


@query(f"""WITH {tm.SIGNALS}, h AS (SELECT DISTINCT horizon FROM signals)
  SELECT horizon, CASE WHEN t < (16 - horizon) // 2 * 256 THEN 'context' ELSE 'target' END AS role, CAST(t AS INTEGER) AS token_id FROM h, range(2048) r(t)""")
def token_masks(spark, folder):
    return sig.token_masks(tm.signals(spark, folder).select("horizon"))


ERRORS = """norm AS (SELECT *, list_sum(target) / len(target) AS mean FROM latents),
  spread AS (SELECT *, sqrt(list_sum(list_transform(target, lambda x: (x - mean) * (x - mean))) / len(target) + 1e-5) AS sd FROM norm),
  errors AS (SELECT case_id, token_id, list_sum(list_transform(list_zip(predicted, target), lambda z: abs(z[1] - (z[2] - mean) / sd))) AS error, len(target) AS width FROM spread)"""


@query(f"WITH {tm.LATENTS}, {ERRORS} SELECT case_id, round(sum(error) / sum(width), 6) AS latent_error FROM errors GROUP BY 1")
def latent_error(spark, folder):
    return rounded(sig.latent_error(tm.latents(spark, folder)))


@query(f"WITH {tm.LATENTS}, {ERRORS} SELECT case_id, CAST(token_id // 16 AS INTEGER) AS block, round(sum(error) / sum(width), 6) AS error FROM errors GROUP BY 1, 2")
def tubelet_errors(spark, folder):
    return rounded(sig.tubelet_errors(tm.latents(spark, folder), 16))


SIDE = 16


@query(f"""WITH tokens AS (SELECT CAST(label AS BIGINT) AS label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // {SIDE} AS block, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings),
  long AS (SELECT label, block, unnest(vector) AS v, generate_subscripts(vector, 1) AS dim FROM tokens),
  pooled AS (SELECT label, block, dim, avg(v) AS m FROM long GROUP BY ALL)
  SELECT concat_ws('-', CAST(a.label AS VARCHAR), CAST(a.block AS VARCHAR)) AS case_id, round(1 - sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)), 6) AS encoder_distance
  FROM pooled a JOIN pooled b ON b.label = a.label AND b.block = a.block + 1 AND b.dim = a.dim GROUP BY a.label, a.block""")
def encoder_distance(spark, folder):
    """Each block of a label's ordered vectors as context against the next one as target; the last block may be short."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1
    tokens = tm.table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("label"), F.floor(at / SIDE).alias("block"), F.col("embedding").cast("array<double>").alias("vector"))
    side = lambda shift: tokens.filter(F.col("block") >= shift).select(F.concat_ws("-", F.col("label").cast("string"), (F.col("block") - shift).cast("string")).alias("case_id"), "vector")
    return rounded(sig.encoder_distance(side(0), side(1)))


@query(f"WITH {tm.SIGNALS} " + " UNION ALL ".join(f"SELECT case_id, {i} AS place, '{n}' AS signal, {n} AS value, '{sig.DIRECTIONS[n]}' AS direction FROM signals" for i, n in enumerate(sig.NAMES)))
def signal_table(spark, folder):
    return sig.signal_table(tm.signals(spark, folder))


@query(f"WITH {tm.SIGNALS} SELECT case_id, CAST(i + 1 AS INTEGER) AS block, round({PROXY}, 6) AS error FROM signals, range(4) t(i) WHERE i < greatest(1, horizon // 2)")
def tubelet_curve(spark, folder):
    return rounded(sig.tubelet_curve(sig.proxy_scores(tm.signals(spark, folder))))


# Calibration


@query(f"WITH {tm.SIGNALS} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END, 6) AS scale FROM signals WHERE lane = 'primary'" for f in calibrate.HYBRID))
def standardize(spark, folder):
    return rounded(calibrate.standardize(metrics.primary_lane(tm.signals(spark, folder)), calibrate.HYBRID))


@query(f"WITH {tm.SIGNALS} SELECT discontinuous, count(*) AS n, round(sum(count(*)) OVER () / CAST(2 * count(*) AS DOUBLE), 6) AS weight FROM signals WHERE lane = 'primary' GROUP BY 1")
def class_weights(spark, folder):
    return rounded(calibrate.class_weights(metrics.primary_lane(tm.signals(spark, folder))))


#: Steps of the SQL's plain descent, and the curvature that bounds it per row of the standardised features.
DESCENT, CURVATURE = 1_200, 0.55
FEATURES = calibrate.HYBRID
FIT_STATS = ", ".join(f"avg({f}) AS m{i}, CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END AS s{i}" for i, f in enumerate(FEATURES))
FIT_Z = "b" + "".join(f" + b{i} * x{i}" for i in range(len(FEATURES)))
FIT_STEP = ", ".join(f"any_value(b{i}) - (sum(g * x{i}) + any_value(b{i})) / ({CURVATURE} * count(*) + 1)" for i in range(len(FEATURES)))


@query(f"""WITH RECURSIVE {tm.SIGNALS}, kept AS (SELECT discontinuous AS y, {", ".join(FEATURES)} FROM signals WHERE lane = 'primary' AND {" AND ".join(f"{f} IS NOT NULL" for f in FEATURES)}),
  stats AS (SELECT count(*) AS n, sum(y) AS ones, {FIT_STATS} FROM kept),
  scaled AS MATERIALIZED (SELECT y, CASE WHEN y = 1 THEN n / CAST(2 * ones AS DOUBLE) ELSE n / CAST(2 * (n - ones) AS DOUBLE) END AS w, {", ".join(f"({f} - m{i}) / s{i} AS x{i}" for i, f in enumerate(FEATURES))} FROM kept, stats),
  descent(k, b, {", ".join(f"b{i}" for i in range(len(FEATURES)))}) AS (SELECT 0, {", ".join(["CAST(0 AS DOUBLE)"] * (len(FEATURES) + 1))}
    UNION ALL SELECT k + 1, any_value(b) - sum(g) / ({CURVATURE} * count(*)), {FIT_STEP}
      FROM (SELECT *, w * (1 / (1 + exp(-({FIT_Z}))) - y) AS g FROM descent, scaled WHERE k < {DESCENT}) GROUP BY k),
  last_ AS (SELECT * FROM descent WHERE k = {DESCENT})
  {" UNION ALL ".join(f"SELECT '{f}' AS feature, round(b{i}, 6) AS coefficient FROM last_" for i, f in enumerate(FEATURES))} UNION ALL SELECT 'intercept', round(b, 6) FROM last_""")
def fit_calibrator(spark, folder):
    found = calibrate.fit_calibrator(tm.signals(spark, folder), calibrate.HYBRID)
    rows = [*zip(found.features, found.coefficients, strict=True), ("intercept", found.intercept)]
    return rounded(spark.createDataFrame(rows, "feature string, coefficient double"))


@query(f"WITH {tm.SIGNALS}, {RISKS} SELECT case_id, risk FROM risks")
def apply_calibrator(spark, folder):
    return risks(spark, folder).select("case_id", "risk")


@query(f"""WITH {tm.SIGNALS}, {RISKS}, r AS (SELECT * FROM risks WHERE lane = 'primary'),
  g AS (SELECT score, sum(p) AS p, sum(n) AS n FROM (SELECT risk AS score, sum(discontinuous) AS p, count(*) AS n FROM r GROUP BY 1 UNION ALL VALUES (CAST(0 AS DOUBLE), 0, 0), (CAST(1 AS DOUBLE), 0, 0)) GROUP BY 1),
  c AS (SELECT score, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER () AS all_p FROM g WINDOW w AS (ORDER BY score DESC)),
  q AS (SELECT score AS threshold, CAST(tp AS DOUBLE) / greatest(1, k) AS precision, CAST(tp AS DOUBLE) / greatest(1, all_p) AS recall FROM c),
  f AS (SELECT *, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM q)
  SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f ORDER BY f.f1 DESC, f.recall DESC, f.threshold LIMIT 1""")
def f1_threshold(spark, folder):
    return rounded(calibrate.f1_threshold(metrics.primary_lane(risks(spark, folder))))


@query(f"WITH {tm.SIGNALS}, {RISKS} SELECT case_id, CAST(risk >= {THRESHOLD} AS INTEGER) AS flagged FROM risks")
def flag_cases(spark, folder):
    return calibrate.flag_cases(risks(spark, folder), THRESHOLD).select("case_id", "flagged")


def ap_sql(rows: str) -> str:
    return f"""g AS (SELECT signal, score, sum(discontinuous) AS p, count(*) AS n FROM ({rows}) WHERE score IS NOT NULL GROUP BY 1, 2),
  c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY signal) AS all_p, sum(n) OVER (PARTITION BY signal) AS all_n FROM g WINDOW w AS (PARTITION BY signal ORDER BY score DESC)),
  m AS (SELECT signal, CASE WHEN max(all_p) > 0 AND max(all_p) < max(all_n) THEN sum(CAST(p AS DOUBLE) / all_p * tp / k) END AS average_precision,
    CASE WHEN max(all_p) > 0 AND max(all_p) < max(all_n) THEN sum(p * ((all_n - all_p) - (k - tp) + (n - p) / CAST(2 AS DOUBLE))) / (CAST(max(all_p) AS DOUBLE) * (max(all_n) - max(all_p))) END AS auroc FROM c GROUP BY 1)"""


LONG = " UNION ALL ".join(f"SELECT '{n}' AS signal, {n} AS score, discontinuous FROM signals WHERE lane = 'primary'" for n in sig.NAMES)


@query(f"""WITH {tm.SIGNALS}, {ap_sql("SELECT horizon AS signal, prediction_error AS score, discontinuous FROM signals WHERE lane = 'primary'")},
  b AS (SELECT signal AS horizon, average_precision AS auprc, abs(average_precision - max(average_precision) OVER ()) <= 1e-8 + 1e-5 * abs(max(average_precision) OVER ()) AS near FROM m)
  SELECT CAST(horizon AS INTEGER) AS horizon, round(auprc, 6) AS auprc, near AND row_number() OVER (ORDER BY near DESC, horizon = 4 DESC, horizon) = 1 AS selected FROM b""")
def select_horizon(spark, folder):
    return rounded(calibrate.select_horizon(tm.signals(spark, folder)))


# Metrics


@query(f"WITH {tm.SIGNALS}, {ap_sql(LONG)} SELECT signal, round(average_precision, 6) AS average_precision FROM m")
def average_precision(spark, folder):
    return rounded(metrics.average_precision(metrics.long_signals(metrics.primary_lane(tm.signals(spark, folder)))))


@query(f"WITH {tm.SIGNALS}, {ap_sql(LONG)} SELECT signal, round(auroc, 6) AS auroc FROM m")
def auroc(spark, folder):
    return rounded(metrics.auroc(metrics.long_signals(metrics.primary_lane(tm.signals(spark, folder)))))


@query(f"WITH {tm.SIGNALS}, {ap_sql(LONG)} SELECT signal, round(average_precision, 6) AS average_precision, round(auroc, 6) AS auroc FROM m")
def ranking_metrics(spark, folder):
    return rounded(metrics.ranking_metrics(metrics.primary_lane(tm.signals(spark, folder))))


@query(f"""WITH {tm.SIGNALS}, {RISKS} SELECT round((avg(CASE WHEN discontinuous = 1 THEN CAST(risk >= {THRESHOLD} AS DOUBLE) END) + avg(CASE WHEN discontinuous = 0 THEN 1 - CAST(risk >= {THRESHOLD} AS DOUBLE) END)) / 2, 6) AS balanced_accuracy FROM risks WHERE lane = 'primary'""")
def balanced_accuracy(spark, folder):
    return rounded(metrics.balanced_accuracy(metrics.primary_lane(risks(spark, folder)), THRESHOLD))


@query(f"WITH {tm.SIGNALS}, {RISKS} SELECT corruption, count(*) AS n, round(avg(CAST(risk >= {THRESHOLD} AS DOUBLE)), 6) AS recall FROM risks WHERE lane = 'primary' AND discontinuous = 1 GROUP BY 1")
def recall_by_corruption(spark, folder):
    return rounded(metrics.recall_by_corruption(risks(spark, folder), THRESHOLD))


@query(f"""WITH {tm.SIGNALS} SELECT count(*) AS rows, count(DISTINCT source_id) AS groups, round(avg(CAST(discontinuous AS DOUBLE)), 6) AS prevalence, round(avg(coalesce(cheap_ms, 0)), 6) AS mean_cheap_ms,
  round(avg(coalesce(model_ms, 0)), 6) AS mean_model_ms, round(max(peak_vram_mb), 6) AS peak_vram_mb FROM signals WHERE lane = 'primary'""")
def summary_metrics(spark, folder):
    return rounded(metrics.summary_metrics(tm.signals(spark, folder)))


@query(f"WITH {tm.SIGNALS} SELECT case_id, source_id, corruption FROM signals WHERE lane = 'primary'")
def primary_lane(spark, folder):
    return metrics.primary_lane(tm.signals(spark, folder)).select("case_id", "source_id", "corruption")


GROUPS = "ranked AS (SELECT source_id, row_number() OVER (ORDER BY source_id) - 1 AS pos, count(*) OVER () AS g FROM (SELECT DISTINCT source_id FROM signals WHERE lane = 'primary'))"
DRAWS = f"""{GROUPS}, drawn AS (SELECT r, CAST('0x' || substr(md5('{boot.SEED}:' || r || ':' || pos), 1, 8) AS BIGINT) % g AS pos FROM ranked, range({RESAMPLES}) t(r)),
  draws AS (SELECT CAST(r AS INTEGER) AS replicate, source_id, times FROM (SELECT r, pos, count(*) AS times FROM drawn GROUP BY 1, 2) JOIN ranked USING (pos))"""


def draws(spark: SparkSession, folder: str) -> DataFrame:
    return boot.bootstrap_draws(metrics.primary_lane(tm.signals(spark, folder)).select("source_id").distinct(), RESAMPLES)


@query(f"WITH {tm.SIGNALS}, {DRAWS} SELECT replicate, source_id, times FROM draws")
def bootstrap_draws(spark, folder):
    return draws(spark, folder)


BOOT_NAMES = {"predictor": "prediction_error", "cheap": "histogram_distance", "hybrid": "ssim_distance"}
REPLICATES = f"""{DRAWS}, s AS ({" UNION ALL ".join(f"SELECT source_id, '{k}' AS signal, {c} AS score, discontinuous FROM signals WHERE lane = 'primary'" for k, c in BOOT_NAMES.items())}),
  gs AS (SELECT source_id, signal, score, sum(discontinuous) AS p, count(*) AS n FROM s GROUP BY ALL),
  met AS (SELECT replicate, signal, score, sum(times * p) AS p, sum(times * n) AS n FROM draws JOIN gs USING (source_id) GROUP BY ALL),
  cum AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS k, sum(p) OVER (PARTITION BY replicate, signal) AS all_p FROM met WINDOW w AS (PARTITION BY replicate, signal ORDER BY score DESC)),
  ap AS (SELECT replicate, signal, sum(CAST(p AS DOUBLE) / all_p * tp / k) AS ap FROM cum GROUP BY ALL),
  wide AS (SELECT replicate, max(ap) FILTER (signal = 'predictor') AS predictor_auprc, max(ap) FILTER (signal = 'cheap') AS cheap_auprc, max(ap) FILTER (signal = 'hybrid') AS hybrid_auprc FROM ap GROUP BY 1),
  reps AS (SELECT *, predictor_auprc - cheap_auprc AS delta_predictor_minus_cheap, hybrid_auprc - cheap_auprc AS delta_hybrid_minus_cheap FROM wide)"""


DELTAS = ("delta_predictor_minus_cheap", "delta_hybrid_minus_cheap")


def replicates(spark: SparkSession, folder: str) -> DataFrame:
    return boot.grouped_bootstrap(metrics.primary_lane(tm.signals(spark, folder)), BOOT_NAMES, RESAMPLES)


@query(f"WITH {tm.SIGNALS}, {REPLICATES} SELECT replicate, {', '.join(f'round({c}, 6) AS {c}' for c in ('predictor_auprc', 'cheap_auprc', 'hybrid_auprc', *DELTAS))} FROM reps")
def grouped_bootstrap(spark, folder):
    return rounded(replicates(spark, folder))


QUANTILES = " UNION ALL ".join(f"SELECT '{d}' AS delta, quantile_cont({d}, 0.025) AS low, quantile_cont({d}, 0.5) AS median, quantile_cont({d}, 0.975) AS high FROM reps" for d in DELTAS)


@query(f"WITH {tm.SIGNALS}, {REPLICATES}, q AS ({QUANTILES}) SELECT delta, round(low, 6) AS low, round(median, 6) AS median, round(high, 6) AS high FROM q")
def bootstrap_interval(spark, folder):
    rows = replicates(spark, folder)
    parts = [boot.bootstrap_interval(rows, d) for d in DELTAS]
    return rounded(parts[0].unionByName(parts[1])).drop("outcome")


@query(f"WITH {tm.SIGNALS}, {REPLICATES}, q AS ({QUANTILES}) SELECT delta, CASE WHEN low > 0 THEN 'predictor_adds_evidence' WHEN high < 0 THEN 'cheap_signals_outperform' ELSE 'inconclusive_at_this_sample_size' END AS outcome FROM q")
def interpret_interval(spark, folder):
    rows = replicates(spark, folder)
    parts = [boot.bootstrap_interval(rows, d) for d in DELTAS]
    return parts[0].unionByName(parts[1]).select("delta", "outcome")


LONG_ALL = " UNION ALL ".join(f"SELECT '{n}' AS signal, corruption, {n} AS value FROM signals" for n in sig.NAMES)


@query(f"""WITH {tm.SIGNALS}, l AS ({LONG_ALL}), q AS (SELECT signal, corruption, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM l GROUP BY 1, 2)
  SELECT signal, corruption, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(value), 6) AS low, round(max(value), 6) AS high
  FROM l JOIN q USING (signal, corruption) WHERE value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY signal, corruption, q1, median, q3""")
def box_stats(spark, folder):
    return rounded(metrics.box_stats(tm.signals(spark, folder)))


@query(f"""WITH {tm.SIGNALS}, labels_(place, corruption) AS (VALUES {', '.join(f"({i}, '{c}')" for i, c in enumerate(metrics.CORRUPTIONS))})
  SELECT place, corruption, {', '.join(f'round(avg({n}), 6) AS {n}' for n in sig.NAMES)} FROM labels_ LEFT JOIN signals USING (corruption) GROUP BY 1, 2""")
def condition_means(spark, folder):
    return metrics.condition_means(tm.signals(spark, folder))


HITS = """first_ AS (SELECT * FROM signals WHERE corruption = 'continuous' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY case_id) = 1)"""


@query(f"WITH {tm.SIGNALS}, {HITS} " + " UNION ALL ".join(f"SELECT '{n}' AS signal, CAST(coalesce(sum(CAST(s.{n} > f.{n} AS BIGINT)), 0) AS BIGINT) AS hits, count(*) AS comparisons FROM signals s JOIN first_ f USING (source_id) WHERE s.corruption <> 'continuous'" for n in sig.NAMES))
def directional_hits(spark, folder):
    return metrics.directional_hits(tm.signals(spark, folder))


FLAGS = f"{RISKS}, flags AS (SELECT *, CAST(risk >= {THRESHOLD} AS INTEGER) AS flagged FROM risks)"


@query(f"""WITH {tm.SIGNALS}, {FLAGS} SELECT round(avg(CASE WHEN discontinuous = 1 THEN CAST(flagged AS DOUBLE) END), 6) AS recall, round(avg(CASE WHEN discontinuous = 0 THEN CAST(flagged AS DOUBLE) END), 6) AS false_alert_rate, CAST(sum(flagged) AS BIGINT) AS flags FROM flags""")
def alert_rates(spark, folder):
    return rounded(metrics.alert_rates(calibrate.flag_cases(risks(spark, folder), THRESHOLD)))


@query(f"""WITH {tm.SIGNALS}, {FLAGS}, w AS (SELECT *, corruption = 'continuous' AS good FROM flags)
  SELECT count(*) AS pairs, CAST(sum(CAST(good AS BIGINT)) AS BIGINT) AS known_good, CAST(sum(CAST(NOT good AS BIGINT)) AS BIGINT) AS known_bad, round(avg(cheap_ms), 6) AS mean_cheap_ms, round(avg(model_ms), 6) AS mean_model_ms,
    CAST(sum(CASE WHEN NOT good THEN flagged END) AS BIGINT) AS bad_flagged, CAST(sum(CASE WHEN good THEN flagged END) AS BIGINT) AS good_flagged FROM w""")
def walkthrough_summary(spark, folder):
    rows = calibrate.flag_cases(risks(spark, folder), THRESHOLD)
    return rounded(metrics.walkthrough_summary(rows.withColumn("case_id", F.concat_ws("-", F.col("source_id").cast("string"), "corruption"))))
