"""The library's logical tables, mapped from generic event, order and vector tables; each with the same mapping as SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """source_id, split, frame_index (0-based), frame_id, frame_path, value: a user's events in order of time."""
    events = table(spark, folder, "events").filter("user_id IS NOT NULL")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("source_id"),
        F.when(F.col("user_id") % 3 == 0, "test").otherwise("dev").alias("split"),
        (F.row_number().over(order) - 1).alias("frame_index"),
        F.col("event_id").alias("frame_id"),
        F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("frame_path"),
        "value",
    )


FRAMES = """frames AS (SELECT user_id AS source_id, CASE WHEN user_id % 3 = 0 THEN 'test' ELSE 'dev' END AS split,
  CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame_index, event_id AS frame_id,
  'f' || CAST(event_id AS VARCHAR) AS frame_path, value FROM events WHERE user_id IS NOT NULL)"""


def decoded(spark: SparkSession, folder: str) -> DataFrame:
    """clip_id, ordinal (from 1, duplicates count), pts (every fifth is missing), time_s (every third is missing), avg_rate."""
    events = table(spark, folder, "events").filter("user_id IS NOT NULL")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    seconds = (F.unix_micros(F.col("ts").cast("timestamp")) - F.min(F.unix_micros(F.col("ts").cast("timestamp"))).over(W.partitionBy("user_id"))) / F.lit(1e6)
    rows = events.select(F.col("user_id").alias("clip_id"), F.row_number().over(order).alias("ordinal"), seconds.alias("seconds"))
    return rows.select(
        "clip_id",
        "ordinal",
        F.when(F.col("ordinal") % 5 != 0, F.floor(F.col("seconds") / 3600)).alias("pts"),
        F.when(F.col("ordinal") % 3 != 0, F.col("seconds")).alias("time_s"),
        F.when(F.col("clip_id") % 2 == 0, F.lit(0.0005)).alias("avg_rate"),
    )


DECODED = """decoded AS (SELECT clip_id, ordinal, CASE WHEN ordinal % 5 <> 0 THEN CAST(floor(seconds / 3600) AS BIGINT) END AS pts,
  CASE WHEN ordinal % 3 <> 0 THEN seconds END AS time_s, CASE WHEN clip_id % 2 = 0 THEN CAST(0.0005 AS DOUBLE) END AS avg_rate
  FROM (SELECT user_id AS clip_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS ordinal,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / CAST(1e6 AS DOUBLE) AS seconds FROM events WHERE user_id IS NOT NULL))"""

#: Order flags as corruptions: two rows in three are discontinuous.
CORRUPTIONS = {"N": "continuous", "A": "temporal_skip", "R": "block_reorder"}


def signals(spark: SparkSession, folder: str) -> DataFrame:
    return signals_of(table(spark, folder, "lineitem"))


def signals_of(items: DataFrame) -> DataFrame:
    """Scored cases: ids, labels, lane, horizon, five signals, timings."""
    corruption = F.when(F.col("l_returnflag") == "N", "continuous").when(F.col("l_returnflag") == "A", "temporal_skip").otherwise("block_reorder")
    return items.select(
        F.concat_ws("-", F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("case_id"),
        F.col("l_suppkey").alias("source_id"),
        F.when(F.col("l_suppkey") % 3 == 0, "test").otherwise("dev").alias("split"),
        (F.col("l_returnflag") != "N").cast("int").alias("discontinuous"),
        corruption.alias("corruption"),
        F.when(F.col("l_linenumber") % 4 == 0, "secondary").otherwise("primary").alias("lane"),
        F.element_at(F.array(F.lit(2), F.lit(4), F.lit(8)), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("horizon"),
        F.col("l_extendedprice").cast("double").alias("prediction_error"),
        (F.col("l_extendedprice").cast("double") / F.col("l_quantity").cast("double")).alias("encoder_distance"),
        F.col("l_quantity").cast("double").alias("histogram_distance"),
        F.col("l_discount").cast("double").alias("ssim_distance"),
        F.col("l_tax").cast("double").alias("flow_discontinuity"),
        (F.col("l_quantity").cast("double") / 2).alias("cheap_ms"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_extendedprice").cast("double") / 100).alias("model_ms"),
        F.col("l_partkey").cast("double").alias("peak_vram_mb"),
    )


SIGNALS = """signals AS (SELECT concat_ws('-', CAST(l_suppkey AS VARCHAR), CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS case_id, l_suppkey AS source_id,
  CASE WHEN l_suppkey % 3 = 0 THEN 'test' ELSE 'dev' END AS split, CAST(l_returnflag <> 'N' AS INTEGER) AS discontinuous,
  CASE l_returnflag WHEN 'N' THEN 'continuous' WHEN 'A' THEN 'temporal_skip' ELSE 'block_reorder' END AS corruption,
  CASE WHEN l_linenumber % 4 = 0 THEN 'secondary' ELSE 'primary' END AS lane, CAST([2, 4, 8][l_orderkey % 3 + 1] AS INTEGER) AS horizon,
  CAST(l_extendedprice AS DOUBLE) AS prediction_error, CAST(l_extendedprice AS DOUBLE) / CAST(l_quantity AS DOUBLE) AS encoder_distance,
  CAST(l_quantity AS DOUBLE) AS histogram_distance, CAST(l_discount AS DOUBLE) AS ssim_distance, CAST(l_tax AS DOUBLE) AS flow_discontinuity,
  CAST(l_quantity AS DOUBLE) / 2 AS cheap_ms, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_extendedprice AS DOUBLE) / 100 END AS model_ms,
  CAST(l_partkey AS DOUBLE) AS peak_vram_mb FROM lineitem)"""


def colours(spark: SparkSession, folder: str) -> DataFrame:
    """source_id, split, colour: the middle frame's value and its square root as a two-vector."""
    rows = frames(spark, folder).withColumn("n", F.count("*").over(W.partitionBy("source_id")))
    middle = rows.filter(F.col("frame_index") == F.floor(F.col("n") / 2))
    return middle.select("source_id", "split", F.array("value", F.sqrt(F.abs("value"))).alias("colour"))


COLOURS = """colours AS (SELECT source_id, split, value AS c1, sqrt(abs(value)) AS c2 FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS n FROM frames) WHERE frame_index = n // 2)"""


def latents(spark: SparkSession, folder: str) -> DataFrame:
    """case_id, token_id, predicted, target: vectors of a label in order, each against the next one."""
    order = W.partitionBy("label").orderBy("vec_id")
    rows = table(spark, folder, "embeddings").select(F.col("label").cast("long").alias("case_id"), (F.row_number().over(order) - 1).alias("token_id"), F.col("embedding").cast("array<double>").alias("predicted"), F.lead(F.col("embedding").cast("array<double>")).over(order).alias("target"))
    return rows.filter("target IS NOT NULL")


LATENTS = """latents AS (SELECT * FROM (SELECT CAST(label AS BIGINT) AS case_id, CAST(row_number() OVER o - 1 AS INTEGER) AS token_id,
  list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS predicted, list_transform(lead(embedding) OVER o, lambda x: CAST(x AS DOUBLE)) AS target
  FROM embeddings WINDOW o AS (PARTITION BY label ORDER BY vec_id)) WHERE target IS NOT NULL)"""


HEIGHT, WIDTH = 24, 32


#: Frames that a task draws.
DRAWN = 256


def images(spark: SparkSession, folder: str, needed: DataFrame | None = None) -> DataFrame:
    """source_id, split, frame_index, frame_path, height, width, rgb: each event as a small raster; needed: the frame_path of those to draw, else all.

    The source gives red, the event's value green, and a blue block moves with the frame index.
    """
    rows = frames(spark, folder).select("source_id", "split", "frame_index", "frame_path", F.coalesce("value", F.lit(0.0)).alias("value"))
    if needed is not None:
        rows = rows.join(needed, "frame_path", "left_semi").select(*rows.columns)
    rows = rows.repartition(max(1, -(-rows.count() // DRAWN)), "frame_path")

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                x = np.zeros((HEIGHT, WIDTH, 3), np.uint8)
                x[..., 0], x[..., 1] = 30 + 25 * (r.source_id % 8), int(abs(r.value) * 7) % 255
                at = r.frame_index % (WIDTH - 6)
                x[8:14, at : at + 6, 2] = 255
                out.append(x.tobytes())
            yield pdf.drop(columns="value").assign(height=HEIGHT, width=WIDTH, rgb=out)

    kind = rows.schema["source_id"].dataType.simpleString()
    return rows.mapInPandas(draw, f"source_id {kind}, split string, frame_index int, frame_path string, height int, width int, rgb binary")
