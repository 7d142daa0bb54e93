"""Near-duplicate embeddings by int8 tile products with error bounds.

Each unit vector x is held as a scaled int8 vector plus a remainder whose length e is known. For two vectors
|x.y - x'.y'| <= |x'| e_y + e_x |y'| + e_x e_y, so the integer product of two tiles bounds every cosine from both sides:
pairs that stay below the threshold are done, pairs surely above are links, and only those between are computed in
double precision. Integer products are exact in float32 as long as 127 * 127 * dimensions is below 2**24; wider vectors
take float64.

Equal vectors of a label fall together first. A label's distinct vectors are dealt by hash to tiles of a bounded size, and each
pair of tiles is a task of its own: memory per task is bounded whatever a label's share, and a task gives back link counts
and a spanning forest, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, small_side, table
from .components import components, forest

THRESHOLD, TILE, ROWS = 0.93, 8192, 512
#: Slack for float32 rounding of scaled integer products, and of double-precision sums.
SLACK32, SLACK64 = 1e-5, 1e-12


class Tile:
    """Unit vectors of some rows, with their int8 form, scales and remainders."""

    def __init__(self, vectors: np.ndarray):
        x = vectors.astype(np.float64)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
        self.unit = x / np.sqrt((x * x).sum(1, keepdims=True))
        self.scale = np.abs(self.unit).max(1) / 127
        self.int8 = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        near = self.int8 * self.scale[:, None]
        self.error = np.sqrt(((self.unit - near) ** 2).sum(1)) + SLACK64
        self.length = np.sqrt((near * near).sum(1)) + SLACK64


def tile_links(a: Tile, b: Tile, threshold: float, same: bool):
    """Yields (rows of a, rows of b) with cosine >= threshold; same: a is b, each pair once."""
    wide = np.float32 if 127 * 127 * a.int8.shape[1] < 1 << 24 else np.float64
    right = b.int8.T.astype(wide)
    for at in range(0, len(a.unit), ROWS):
        part = slice(at, at + ROWS)
        near = (a.int8[part].astype(wide) @ right) * a.scale[part, None].astype(wide) * b.scale.astype(wide)
        reach = a.length[part, None].astype(wide) * b.error.astype(wide) + a.error[part, None].astype(wide) * (b.length + b.error).astype(wide) + wide(SLACK32)
        i, j = np.nonzero(near + reach >= threshold)
        if same:
            i, j = i[j > i + at], j[j > i + at]
        sure = (near - reach)[i, j] >= threshold
        for k in range(0, len(i), 1 << 18):
            x, y, s = i[k : k + (1 << 18)] + at, j[k : k + (1 << 18)], sure[k : k + (1 << 18)].copy()
            doubt = np.flatnonzero(~s)
            s[doubt] = np.einsum("ij,ij->i", a.unit[x[doubt]], b.unit[y[doubt]]) >= threshold
            yield x[s], y[s]


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of vectors (vec_id, embedding, label).

    vec_id may be of any type that has an order. Vectors link when their labels are equal and not null and their cosine is at least threshold (over 0). Vectors that are null, empty,
    zero or hold null or non-finite components, rows without label or vec_id, and vectors of unequal length, link with
    nothing: n_links 0, component_id their own id, kept. Repeated rows are vectors of their own. Extra columns are left
    out; an empty table gives none.
    """
    # Floats travel as floats; tiles compute in double precision.
    given = vectors.schema["embedding"].dataType.simpleString()
    rows = vectors.select("vec_id", "label", F.col("embedding").cast(given if given == "array<float>" else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    valid = F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite, F.lit(False))
    rows = cut(rows.withColumn("ok", valid), "vectors")
    classes = rows.filter("ok").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"))
    # Classes are numbered once, where they are written.
    classes = cut(classes.select("label", F.size("v").alias("width"), "v", "rep", "m", F.monotonically_increasing_id().alias("number")), "classes")
    sizes = classes.groupBy("label", "width").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    sizes = small_side(cut(sizes, "tiles")).select(F.col("label").alias("_label"), F.col("width").alias("_width"), "tiles")
    dealt = classes.join(sizes, (F.col("label") == F.col("_label")) & (F.col("width") == F.col("_width")))
    dealt = dealt.withColumn("tile", F.pmod(F.xxhash64("number"), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select("label", "width", F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"), "tile", "number", "m", "v")

    def run(group: pa.Table) -> pa.Table:
        ids, m, at = np.asarray(group["number"]), np.asarray(group["m"]), np.asarray(group["tile"])
        v = group["v"].combine_chunks()
        v = np.asarray(v.flatten()).reshape(len(ids), -1)
        same = group["low"][0].as_py() == group["high"][0].as_py()
        first = at == group["low"][0].as_py()
        left = np.flatnonzero(first) if not same else np.arange(len(ids))
        right = np.flatnonzero(~first) if not same else left
        links, nodes, roots = np.zeros(len(ids), np.int64), np.arange(len(ids)), np.arange(len(ids))
        if len(left) and len(right):
            a = Tile(v[left])
            for x, y in tile_links(a, a if same else Tile(v[right]), threshold, same):
                x, y = left[x], right[y]
                np.add.at(links, x, m[y])
                np.add.at(links, y, m[x])
                node, root = forest(np.concatenate([nodes, x]), np.concatenate([roots, y]))
                roots[node] = root
        smallest = ids.copy()
        np.minimum.at(smallest, roots, ids)
        linked = links > 0
        return pa.table({"node": ids[linked], "root": smallest[roots][linked], "links": links[linked]})

    found = cut(dealt.groupBy("label", "width", "low", "high").applyInArrow(run, "node long, root long, links long"), "links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "_node")
    groups = components(found.select(F.col("root").alias("a"), F.col("node").alias("b")))
    about = classes.join(counts, F.col("number") == F.col("_node"), "left").join(groups, F.col("number") == F.col("node"), "left")
    about = cut(about.select(F.col("label").alias("_label"), F.col("v").alias("_v"), "rep", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "number").alias("component")), "about")
    first = about.groupBy("component").agg(F.min("rep").alias("component_id")).withColumnRenamed("component", "_component")
    about = about.join(first, F.col("component") == F.col("_component"))
    linked = rows.filter("ok").join(about, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v"))).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
      WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN l ON l.a = vec_id
"""
