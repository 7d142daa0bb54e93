"""A corpus from raw documents to token ids, a stage at a time: each stage's rows are written and read by the next.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents; columns beyond these are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipseam.llm import toxicity
from clipseam.llm.bpe import encode_documents
from clipseam.llm.common import cut, fold_of, small_batches, small_side, table
from clipseam.llm.mixing import mix_sources
from clipseam.llm.secrets import redact_secrets
from clipseam.llm.simhash import simhash_groups

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score, by nearest labelled examples among docs, is below one half.

    Null and empty texts have the base rate of the labelled rows and stay as long as that is below one half. A text of any
    length is scored whole; repeated rows fare alike; an empty table gives none.
    """
    small_batches(spark)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold_of() != 0)
    return toxicity.score_toxicity(docs, model, carry=COLUMNS[1:]).filter("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one row: that of the smallest id, or without ids the first.

    Groups are linked by near copies: 3 bits, or up to 7 where five-word shingles have a similarity of about 0.8 or more.
    Rows are told apart by their place in the table that docs is read from, so that repeated rows, repeated ids and rows
    without an id lose all but one row of their group too. Null and empty texts are one group. A text of any length has one
    fingerprint; an empty table gives none.
    """
    small_batches(spark)
    placed = docs.select(*COLUMNS, F.monotonically_increasing_id().alias("_row"))
    groups = simhash_groups(placed.select(F.col("_row").alias("doc_id"), "text"), near=True).select(F.col("doc_id").alias("_member"), "component_id")
    marked = cut(placed.select("_row", "doc_id").join(groups, F.col("_row") == F.col("_member")).select("_row", "doc_id", "component_id"), "marked")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("first")
    stays = marked.groupBy("component_id").agg(first).select(F.col("first._row").alias("_first"))
    gone = cut(marked.join(stays, F.col("_row") == F.col("_first"), "left_anti").select(F.col("_row").alias("_gone")), "gone")
    return placed.join(small_side(gone), F.col("_row") == F.col("_gone"), "left_anti").select(*COLUMNS)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each found secret replaced by a mark and n_chars counted anew where the text changed.

    Null and empty texts stay as they are; a text of any length is scanned whole; repeated rows stay; an empty table gives none.
    """
    small_batches(spark)
    before = docs.select(*COLUMNS)
    after = redact_secrets(before.withColumn("_was", F.length("text")))
    return after.withColumn("n_chars", F.when(F.length("text") != F.col("_was"), F.length("text").cast(before.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, so that sources stand near their target weights.

    Null texts and texts without words have no size and come in the source's whole copies only. A long text is taken
    whole or not at all; repeated rows tie and are taken one by one; an empty table gives none.
    """
    mixed = mix_sources(docs, carry=("text", "lang", "n_chars"))
    return mixed.filter("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the number of tokens, digests of ids and decoded text, and the ids, per row.

    Null and empty texts have no tokens; the leaves of very long texts are encoded in tasks of their own; repeated rows
    give repeated rows; an empty table gives none.
    """
    small_batches(spark)
    return encode_documents(docs, carry=("lang", "source"), with_ids=True)


STAGES = [
    ("toxicity", reject_toxic),
    ("SimHash near-dedup", drop_near_copies),
    ("secret scans", redact),
    ("mixing sources", mix),
    ("BPE encoding", encode),
]
#: Learned scores, fingerprints and merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage-{k}")
    return docs
