"""What the operators share: reading tables, cutting lineage, Arrow batches, word rules."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import bucketed, cut

__all__ = ["bucketed", "cut"]

#: A word: a run of characters that are none of these six.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows above which a small side is no longer broadcast but shuffled.
BROADCAST_ROWS = 100_000
#: A key is hot with more than this many rows, and more than this part of all rows; so no more than HOT_SHARE keys are.
HOT_ROWS, HOT_SHARE = 1_000, 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_side(df: DataFrame) -> DataFrame:
    """df marked for broadcast if its counted rows allow it, else df, to be shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def join_skewed(rows: DataFrame, keyed: DataFrame, on: list[str], total: int) -> DataFrame:
    """rows joined to keyed, which has a row per key with the key's rows in _n; total: all rows.

    Keys of more than a HOT_SHARE-th of all rows, at most HOT_SHARE, are broadcast, so that no task gets a hot key's rows; the others are shuffled.
    """
    limit = max(HOT_ROWS, total // HOT_SHARE)
    hot = keyed.filter(F.col("_n") > limit)
    if hot.isEmpty():
        return rows.join(keyed, on)
    return rows.join(F.broadcast(hot), on).unionByName(rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(keyed.filter(F.col("_n") <= limit), on))


def text_bytes(column: str = "text") -> Column:
    """A text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")


def check_carry(carry: tuple[str, ...], own: tuple[str, ...]) -> None:
    """A carried column must not have the name of a result column."""
    if clash := set(carry) & set(own):
        raise ValueError(f"carried columns clash with the result's: {sorted(clash)}")


def fold_of(column: str = "doc_id") -> Column:
    """crc32(id as text) mod 5; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5


#: What this worker process holds between tasks; one operator's at a time, as workers serve one stage after another.
_HELD: dict = {}


def held(key, make):
    """make()'s value, kept while tasks of the same key follow each other in this process."""
    if key not in _HELD:
        let_go()
        _HELD[key] = make()
    return _HELD[key]


def let_go() -> None:
    """Gives what this worker process held, and memory that it no longer uses, back to the machine."""
    _HELD.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def small_batches(spark: SparkSession, rows: int = 1_000) -> None:
    """Documents are long: from now on the session sends its Python workers at most ``rows`` rows at a time, which bounds what both sides of a task hold."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def lower_table() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


LOWER = lower_table()


def mix64(x: np.ndarray) -> np.ndarray:
    """A full-avalanche mix of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of the logistic curve that calibrates the log-odds x to y, with a weak prior at the identity; Newton steps are halved until they help."""
    w = np.ones(len(x)) if weight is None else weight

    def cost(a: float, b: float) -> float:
        z = a * x + b
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.5 * ((a - 1) ** 2 + b * b))

    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -50, 50)))
        g = np.array([(w * (p - y) * x).sum() + a - 1, (w * (p - y)).sum() + b])
        v = w * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 1]])
        step = np.linalg.solve(h, g)
        scale, now = 1.0, cost(a, b)
        while scale > 1e-9 and cost(a - scale * step[0], b - scale * step[1]) > now:
            scale /= 2
        a, b = a - scale * step[0], b - scale * step[1]
        if scale <= 1e-9 or abs(step).max() * scale < 1e-9:
            break
    return max(float(a), 0.0), float(b)


#: The bytes between words.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def power_table(n: int) -> np.ndarray:
    out = np.full(n, np.uint64(0x9E3779B97F4A7C15))
    out[0] = 1
    return np.multiply.accumulate(out)


BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))
STEP, BACK = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of the bytes, and where each word starts."""
    inside = np.concatenate([[False], ~SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    powers = power_table(len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUE[raw] * powers)])
    # The powers up to the word's start are divided out.
    back = np.full(len(raw), BACK)
    back[0] = 1
    return mix64((sums[ends] - sums[starts]) * np.multiply.accumulate(back)[starts]), starts
