"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Each source's target is its weighted share of the wanted total, at most ``max_repeats`` times its size; what
exceeds that is shared out again by weight. A document is expected in ``target * w / sum(w * size)`` copies by its own weight w: the
whole part is certain, the fraction is its inclusion probability. Where documents have no weights of their own, all
have one fraction f, and inclusion leans to longer documents: p = f + min(f, 1 - f) * (g - mean of g by words), with
g = size / (size + LEAN), which leaves the expected words as they are and p between 0 and 1. Documents rank by their
odds u/(1-u) of a uniform hash over the inclusion odds p/(1-p), and each source takes from the front of that ranking
until the words that remain of its target are filled. The fixed size of the sample is counted in words, the unit of the
targets: the front ends before the first document that doesn't fit, and what stays open is filled in the same way from the
ranking behind it, by the documents that fit, FILLS times; the last time a document is taken if that brings the source
nearer to its target.

No source is gathered anywhere. The ranking is cut by two histograms over the key (1,024 buckets each); only the
millionth part of a source in which the cut falls is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, WORD, check_carry, cut, table

WEIGHTS = (5, 2, 1)
SEED = "mix-1"
BUCKETS = 1024
#: Words at which g is one half; further rounds of filling.
LEAN, FILLS = 256, 2


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: str) -> Column:
    """52 hashed bits of id and text in (0, 1); copies of a text under other ids differ."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52))


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int) -> DataFrame:
    """sources: source, source_size, weighted_size, leaning_size, a row each; adds target.

    Sorted by cap over weight, the sources that reach their cap are a prefix; the rest share what is left by weight.
    """
    ranked = sources.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int")))
    everything, sized = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), F.col("_cap") > 0
    ranked = ranked.withColumn("_cap", F.lit(float(max_repeats)) * F.col("source_size"))
    order = W.orderBy((F.col("_cap") / F.when(F.col("_w") > 0, F.col("_w"))).asc_nulls_last(), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(everything).cast("double") * F.lit(share)
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    ranked = ranked.withColumns({"_left": total - before("_cap"), "_left_w": F.sum("_w").over(everything) - before("_w")})
    ranked = ranked.withColumn("_full", (F.col("_w") > 0) & (F.col("_cap") * F.col("_left_w") <= F.col("_left") * F.col("_w")))
    first = lambda c: F.min_by(c, F.when(~F.col("_full"), F.struct((F.col("_cap") / F.when(F.col("_w") > 0, F.col("_w"))).isNull(), F.col("_cap") / F.when(F.col("_w") > 0, F.col("_w")), F.col("source").isNull(), F.col("source")))).over(everything)
    target = F.when(F.col("_full"), F.col("_cap")).when(sized & (F.col("_w") > 0), F.least(F.col("_cap"), F.greatest(first("_left"), F.lit(0.0)) * F.col("_w") / first("_left_w"))).otherwise(F.lit(0.0))
    return ranked.select("source", "source_size", "weighted_size", "leaning_size", target.alias("target"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = 3, weight_col: str | None = None, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row per row of docs: doc_id, source, size, source_size, target, copies, taken, and the columns in carry.

    docs: doc_id, text, source; other columns are left out unless carried. weight_col: a document's own weight
    (null or negative: 0), else inclusion leans to longer documents. Null text: size 0, in zero copies beyond the certain
    ones. A text of any length counts whole. A null source is a source of its own, last in order. Rows that repeat id and
    text tie; which of them is taken makes no difference to the result. An empty table gives an empty result.
    """
    check_carry(carry, ("doc_id", "source", "size", "source_size", "target", "copies", "taken"))
    weight = F.greatest(F.coalesce(F.col(weight_col).cast("double"), F.lit(0.0)), F.lit(0.0)) if weight_col else F.lit(1.0)
    kept = [F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)]
    # Rows are numbered once, where they are written: the last tie-breaker.
    rows = cut(docs.select("doc_id", "source", word_count().alias("size"), uniform(seed).alias("_u"), weight.alias("_weight"), F.monotonically_increasing_id().alias("_row"), *kept), "mix")
    long = F.col("size") / (F.col("size") + F.lit(float(LEAN)))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * F.col("_weight")).alias("weighted_size"), F.sum(F.col("size") * long).alias("leaning_size"))
    plan = cut(source_targets(sources, weights, share, max_repeats), "mix-targets")
    few = plan.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    hint = F.broadcast if few else lambda x: x

    def with_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
        right = right.withColumnRenamed("source", "_source")
        return left.join(hint(right), left["source"].eqNullSafe(right["_source"]), how).drop("_source")

    expected = F.when(F.col("weighted_size") > 0, F.least(F.col("target") * F.col("_weight") / F.col("weighted_size"), F.lit(float(max_repeats)))).otherwise(F.lit(0.0))
    planned = with_source(rows, plan).withColumn("_e", expected).withColumn("_base", F.floor("_e")).withColumn("_f", F.col("_e") - F.col("_base"))
    leaning = F.col("_f") if weight_col else F.col("_f") + F.least(F.col("_f"), 1 - F.col("_f")) * (long - F.col("leaning_size") / F.col("source_size"))
    planned = planned.withColumn("_p", F.when(F.col("size") > 0, leaning))
    key = F.when(F.col("_p") < 1, (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))).otherwise(0.0)
    planned = planned.withColumn("_key", F.when((F.col("_p") > 0) & (F.col("_f") > 0), key))
    spot = F.col("_key") / (1 + F.col("_key")) * BUCKETS
    planned = planned.withColumn("_b1", F.least(F.floor(spot), F.lit(BUCKETS - 1))).withColumn("_b2", F.least(F.floor((spot - F.col("_b1")) * BUCKETS), F.lit(BUCKETS - 1)))
    certain = planned.groupBy("source").agg(F.sum(F.col("_base") * F.col("size")).alias("_certain"))
    rest = cut(with_source(plan.select("source", "target"), certain).select("source", (F.col("target") - F.col("_certain")).alias("_rest")), "mix-rest")
    order = ("_key", "doc_id", "size", "_row")
    place = F.struct(*order)

    def crossing(ranked: DataFrame, limits: DataFrame, bucket: str) -> DataFrame:
        """The bucket of each source in which its cut falls, with the words before it; none if all fit."""
        filled = ranked.groupBy("source", bucket).agg(F.sum("size").alias("_words"))
        upto = F.sum("_words").over(W.partitionBy("source").orderBy(bucket))
        filled = with_source(filled.withColumn("_upto", upto), limits)
        filled = filled.filter(F.col("_before") + F.col("_upto") > F.col("_rest"))
        at = filled.groupBy("source").agg(F.min(F.struct(bucket, (F.col("_before") + F.col("_upto") - F.col("_words")).alias("_b"))).alias("_at"), F.first("_rest").alias("_rest"))
        return at.select("source", F.col(f"_at.{bucket}").alias(f"_cut{bucket}"), F.col("_at._b").alias("_before"), "_rest")

    def front(ranked: DataFrame, limits: DataFrame, over: float) -> DataFrame:
        """Of each source that isn't taken whole: the buckets of the cut, the last row taken in them, and the words taken; over: the part of a document that may be beyond the limit."""
        first = cut(crossing(ranked, limits.withColumn("_before", F.lit(0).cast("long")), "_b1"), "mix-cut")
        inside = with_source(ranked, first.select("source", "_cut_b1")).filter(F.col("_b1") == F.col("_cut_b1"))
        second = with_source(first.select("source", "_cut_b1"), crossing(inside, first.select("source", "_before", "_rest"), "_b2"))
        edge = with_source(inside.drop("_cut_b1"), second).filter(F.col("_b2") == F.col("_cut_b2"))
        upto = F.sum("size").over(W.partitionBy("source").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
        edge = edge.withColumn("_words", upto).filter(F.col("_before") + F.col("_words") - F.col("size") * over <= F.col("_rest"))
        edge = edge.groupBy("source").agg(F.max(place).alias("_last"), F.max("_words").alias("_words"))
        return with_source(second.select("source", "_cut_b1", "_cut_b2", "_before"), edge, "left").select("source", "_cut_b1", "_cut_b2", "_last", (F.col("_before") + F.coalesce("_words", F.lit(0))).alias("_taken"))

    def within(k: str | int = "") -> Column:
        """Whether a row stands before the cut of a round."""
        b1, b2, last = F.col(f"_cut_b1{k}"), F.col(f"_cut_b2{k}"), F.col(f"_last{k}")
        return b1.isNull() | (F.col("_b1") < b1) | ((F.col("_b1") == b1) & ((F.col("_b2") < b2) | ((F.col("_b2") == b2) & F.coalesce(place <= last, F.lit(False)))))

    # Narrow rows are written for the first round, and the fewer that are left and fit for each further one.
    ranked, limits, rules = cut(planned.filter(F.col("_key").isNotNull()).select("source", "_b1", "_b2", *order), "mix-ranked"), rest, rest.select("source")
    for k in range(1 + FILLS):
        cuts = cut(with_source(limits, front(ranked, limits, 0.5 if k == FILLS else 0.0), "left"), "mix-front")
        rules = with_source(rules, cuts.select("source", *[F.col(c).alias(f"{c}{k}") for c in ("_rest", "_cut_b1", "_cut_b2", "_last")]), "left")
        if k < FILLS:
            limits = cuts.select("source", (F.col("_rest") - F.col("_taken")).alias("_rest")).filter("_rest > 0")
            fits = F.col("size") * (0.5 if k + 1 == FILLS else 1.0)
            behind = with_source(with_source(ranked, cuts.drop("_rest", "_taken")).filter(~within()).select(*ranked.columns), limits)
            ranked = cut(behind.filter(fits <= F.col("_rest")).drop("_rest"), "mix-ranked")
    marked = with_source(planned, cut(rules, "mix-rules"), "left")
    taken, fits = F.lit(False), F.lit(True)
    for k in range(1 + FILLS):
        if k:
            fits = fits & (F.col("size") * (0.5 if k == FILLS else 1.0) <= F.col(f"_rest{k}"))
        taken = taken | (F.col(f"_rest{k}").isNotNull() & fits & within(k))
    marked = marked.withColumn("_extra", F.coalesce(F.col("_key").isNotNull() & taken, F.lit(False)).cast("int"))
    copies = (F.col("_base") + F.col("_extra")).cast("int")
    return marked.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)])


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP1_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size,
         (CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
g AS (SELECT *, CAST(size AS DOUBLE) / (CAST(size AS DOUBLE) + {LEAN}) AS g FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, sum(size * g) AS leaning_size FROM g GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap FROM s),
o AS (SELECT *, CAST(sum(source_size) OVER () AS DOUBLE)
               - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_w FROM w),
f AS (SELECT *, cap * rest_w <= rest * w AS filled FROM o),
c AS (SELECT rest AS r, rest_w AS rw FROM f WHERE NOT filled ORDER BY cap / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, source_size, leaning_size, CASE WHEN filled THEN cap WHEN cap > 0 THEN least(cap, greatest(r, 0) * w / rw) ELSE 0 END AS target FROM f LEFT JOIN c ON true),
e AS (SELECT g.*, source_size, leaning_size, target, CASE WHEN source_size > 0 THEN least(target * CAST(1 AS DOUBLE) / CAST(source_size AS DOUBLE), 3) ELSE 0 END AS e
      FROM g JOIN t ON g.source IS NOT DISTINCT FROM t.source),
p0 AS (SELECT *, CAST(floor(e) AS BIGINT) AS base, e - floor(e) AS f FROM e),
p AS (SELECT *, CASE WHEN size > 0 THEN f + least(f, 1 - f) * (g - leaning_size / source_size) END AS p FROM p0),
r AS (SELECT *, target - sum(base * size) OVER (PARTITION BY source) AS rest,
        CASE WHEN p > 0 AND f > 0 THEN CASE WHEN p < 1 THEN (u / (1 - u)) / (p / (1 - p)) ELSE 0 END END AS key FROM p),
x0 AS (SELECT *, key IS NOT NULL AND sum(CASE WHEN key IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY key NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS x0 FROM r),
""" + "".join(
    f"""y{k} AS (SELECT *, rest - sum(CASE WHEN {' OR '.join(f'x{i}' for i in range(k))} THEN size ELSE 0 END) OVER (PARTITION BY source) AS open{k} FROM x{k - 1}),
z{k} AS (SELECT *, key IS NOT NULL AND NOT ({' OR '.join(f'x{i}' for i in range(k))}) AND open{k} > 0{f' AND fits{k - 1}' if k > 1 else ''} AND size * {0.5 if k == FILLS else 1} <= open{k} AS fits{k} FROM y{k}),
x{k} AS (SELECT *, fits{k} AND sum(CASE WHEN fits{k} THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY key NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) - CAST(size AS DOUBLE) * {0.5 if k == FILLS else 0} <= open{k} AS x{k} FROM z{k}),
"""
    for k in range(1, FILLS + 1)
) + f"""q AS (SELECT *, base + CAST({' OR '.join(f'x{i}' for i in range(FILLS + 1))} AS BIGINT) AS n FROM x{FILLS})
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(n * size AS BIGINT) AS taken, CAST(n AS INT) AS copies FROM q
"""
