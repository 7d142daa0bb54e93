"""Importance resampling towards a target corpus by hashed word n-grams.

In each task DuckDB unnests the words of a slice of texts, builds n-grams by windows and hashes distinct ones by a
registered zlib CRC; a partition's bucket counts are spilled to Parquet in the shared folder. Spark merges the counts of both corpora into a gain per
bucket, tasks sum the gains of each document's features in the same SQL, and documents are drawn without
replacement by the largest sums of weight and Gumbel noise, ranked over ranges of scores.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

GRAMS, BUCKETS, PERCENT, LEAST, SEED = 1, 10_000, 10, 20, "2024"
#: Bytes of text that DuckDB takes at a time, its memory, and scores of a range.
CHUNK, MEMORY, RANGE = 6_000_000, "400MB", 200_000
#: A word, before A to Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Grams:
    """A task's DuckDB, with SQL over slices of texts."""

    def __init__(self, grams: int, buckets: int):
        import duckdb

        self.spill = tempfile.TemporaryDirectory(prefix="grams-")  # for texts whose words exceed MEMORY; gone with the task
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": self.spill.name})
        self.db.create_function("crc", lambda x: pa.array([zlib.crc32(v) for v in x.cast(pa.binary()).to_pylist()], pa.int64()), ["VARCHAR"], "BIGINT", type="arrow")
        lead = [f"lead(w, {k}) OVER (PARTITION BY doc ORDER BY place)" for k in range(1, grams)]
        runs = ["SELECT doc, 1 AS size, w AS gram FROM words"]
        for k in range(2, grams + 1):
            runs.append(f"SELECT doc, {k} AS size, gram FROM (SELECT doc, concat_ws(' ', w, {', '.join(lead[: k - 1])}) AS gram, {lead[k - 2]} AS last FROM words) WHERE last IS NOT NULL")
        self.features = f"""WITH words AS (SELECT doc, unnest(w) AS w, generate_subscripts(w, 1) AS place FROM (SELECT doc, regexp_extract_all(text, '{WORD}') AS w FROM texts)),
          grams AS MATERIALIZED ({" UNION ALL ".join(runs)}),
          hashed AS (SELECT gram, crc(translate(gram, '{UPPER}', '{LOWER}')) % {buckets} AS bucket FROM (SELECT DISTINCT gram FROM grams))"""

    def slices(self, texts: pa.Array) -> Iterator[tuple[int, int]]:
        """Start and length of slices of about CHUNK bytes; a longer text stands alone."""
        size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(size) - size) // CHUNK
        for k in np.unique(part):
            mine = np.flatnonzero(part == k)
            yield int(mine[0]), len(mine)

    def ask(self, texts: pa.Array, sql: str) -> dict[str, np.ndarray]:
        self.db.register("texts", pa.table({"doc": pa.array(np.arange(len(texts))), "text": texts}))
        found = self.db.sql(f"{self.features} {sql}").fetchnumpy()
        self.db.unregister("texts")
        return found

    def close(self) -> None:
        self.db.close()
        self.spill.cleanup()


def bucket_counts(docs: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: all features of the texts, repeats counted, of the buckets that have any; each partition's counts are written before they are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, total = Grams(grams, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for low, n in work.slices(batch.column(0)):
                found = work.ask(batch.column(0).slice(low, n), "SELECT bucket, count(*) AS n FROM grams JOIN hashed USING (gram) GROUP BY 1")
                np.add.at(total, found["bucket"].astype(np.int64), found["n"].astype(np.int64))
        work.close()
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})

    parts = cut(docs.select(F.coalesce("text", F.lit("")).alias("_text")).mapInArrow(run, "bucket long, n long"), "grams")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: 1,000 times the log of how much likelier the bucket is in the target than in docs, with one added to each count; a row per bucket."""
    count = lambda df, name: bucket_counts(df, grams, buckets).withColumnRenamed("n", name)
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(count(docs, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left").fillna(0, ["s", "t"])
    both = cut(both, "buckets")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    ratio = (F.col("t").cast("double") + 1) * (all_s + buckets) / ((F.col("s").cast("double") + 1) * (all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def document_weights(docs: DataFrame, gains: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_features, weight (sum of the gains of its features). gains: a row per bucket, which all tasks get."""
    rows = gains.orderBy("bucket").toPandas()  # as many as there are buckets
    if rows["bucket"].tolist() != list(range(buckets)):
        raise ValueError(f"gains need one row for each of {buckets} buckets")
    gain = rows["gain"].to_numpy(np.int64)
    sql = "SELECT doc, count(*) FILTER (size = 1) AS n_words, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM grams JOIN hashed USING (gram) JOIN gains USING (bucket) GROUP BY doc"
    names = ("n_words", "n_features", "weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Grams(grams, buckets)
        work.db.register("gains", pa.table({"bucket": np.arange(buckets), "gain": gain}))
        for batch in batches:
            for low, n in work.slices(batch.column(1)):
                found, out = work.ask(batch.column(1).slice(low, n), sql), np.zeros((3, n), np.int64)
                for c, v in zip(names, out, strict=True):
                    v[found["doc"].astype(np.int64)] = found[c].astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, n), *map(pa.array, out)], names=["doc_id", *names])
        work.close()

    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    return chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, grams: int = GRAMS, buckets: int = BUCKETS, percent: int = PERCENT, least: int = LEAST, seed: str = SEED) -> DataFrame:
    """A row per row of docs: doc_id, n_words, n_features, weight, score, and rank from 1 for the percent of documents of at least ``least`` words that are drawn, else null.

    docs: doc_id, text; target: text. Features are all runs of 1 to ``grams`` words; gains and scores are whole thousandths. Null and empty texts
    have no features and weight 0; a text's words meet in one task, beyond MEMORY on its disk; a null id is hashed as the
    empty string and comes last among equal scores; rows that repeat an id have their scores each, and ties stand in the order of the written
    table. Other columns are left out; an empty table gives none, an empty target gives gains by rarity alone.
    """
    weights = document_weights(docs, bucket_gains(docs, target, grams, buckets), grams, buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = cut(weights.withColumns({"score": F.col("weight") + noise, "_row": F.monotonically_increasing_id()}), "scored")
    large = F.col("n_words") >= least
    n = scored.filter(large).count()
    order = (F.desc("score"), F.col("doc_id").asc_nulls_last(), F.col("_row"))
    ranges = cut(scored.filter(large).repartitionByRange(max(1, -(-n // RANGE)), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = F.coalesce(F.sum("_n").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row per range
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy("_range").orderBy(*order))
    ranked = ranges.join(F.broadcast(sizes), "_range").withColumn("_place", place)
    columns = ("doc_id", "n_words", "n_features", "weight", "score")
    drawn = ranked.select(*columns, F.when(F.col("_place") <= percent * n // 100, F.col("_place")).cast("long").alias("rank"))
    return drawn.unionByName(scored.filter(~large).select(*columns, F.lit(None).cast("long").alias("rank")))


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def counted(name: str, source: str) -> str:
    return f"""{name}_words AS (SELECT {source}, list_transform(regexp_extract_all(coalesce(text, ''), '{WORD}'), lambda w: translate(w, '{UPPER}', '{LOWER}')) AS w FROM {name}),
 {name}_long AS (SELECT {source}, unnest(w) AS w FROM {name}_words)"""


OP12_SQL = rf"""WITH RECURSIVE steps(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
 crcs AS (SELECT list(c ORDER BY i) AS crcs FROM steps WHERE k = 8),
 {counted("documents", "doc_id")}, {counted("benchmark", "item_id")},
 vocabulary AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM documents_long UNION SELECT w FROM benchmark_long)),
 hashed AS (SELECT w, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)), lambda c, b: xor(c >> 8, crcs[xor(c & 255, b) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket FROM vocabulary, crcs),
 s AS (SELECT bucket, count(*) AS s FROM documents_long JOIN hashed USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM benchmark_long JOIN hashed USING (w) GROUP BY 1),
 both_ AS (SELECT b AS bucket, CAST(coalesce(s, 0) AS DOUBLE) AS s, CAST(coalesce(t, 0) AS DOUBLE) AS t FROM range({BUCKETS}) r(b) LEFT JOIN s ON s.bucket = b LEFT JOIN t ON t.bucket = b),
 gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + {BUCKETS}) / ((s + 1) * (sum(t) OVER () + {BUCKETS})))) AS BIGINT) AS gain FROM both_),
 weights AS (SELECT doc_id, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM documents_long JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY 1),
 scored AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST(CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296))) AS BIGINT) AS score FROM documents_words LEFT JOIN weights USING (doc_id)),
 placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {LEAST})
 SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM scored LEFT JOIN placed USING (doc_id)"""
