"""New signal rows scored as they arrive, by the same expressions as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calibrate import Calibrator, apply_calibrator, flag_cases


def with_scores(rows: DataFrame, calibrator: Calibrator, threshold: float) -> DataFrame:
    """risk, flagged and display_score; stateless, so it serves streams and tables alike."""
    return flag_cases(apply_calibrator(rows, calibrator), threshold).withColumn("display_score", F.rint(100 * F.col("risk")).cast("int"))


def score_stream(rows: DataFrame, calibrator: Calibrator, threshold: float, path: str, checkpoint: str):
    """Starts the query that appends scored rows to path and ends when what is there has been read."""
    return with_scores(rows, calibrator, threshold).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
