"""License scans by ordered signature rules, in DataFrame functions only.

A text becomes its lower-case words, each with a space of its own on either side, so that a rule's matches and what lies
between them are whole words, and places are counted in words. One pass finds which keywords occur; only rules of
these keywords run. Detections are then rows: running sums place them, and a detection falls if it lies inside one of a
level as sure or surer (of equal intervals the surer, then the earlier rule stays). Texts are never shuffled.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table
from .license_rules import rules

#: What is no word, before lower-casing; letters beyond ASCII make words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: How sure a label is by its surest level.
SURE = {1: 0.99, 2: 0.95, 3: 0.9, 4: 0.8, 5: 0.5}
RULE = "array<struct<rule:int,label:string,level:int,keyword:string,pattern:string,base:boolean>>"


def spaced_words(text: str | Column) -> Column:
    """The words of a text, each between two spaces of its own; letters keep their case."""
    return F.regexp_replace(F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BETWEEN, "  ")), F.lit(" ")), "^  $", "")


def words_in(spaced: Column) -> Column:
    return ((F.length(spaced) - F.length(F.replace(spaced, F.lit(" ")))) / 2).cast("int")


def rule_matches(docs: DataFrame, signatures: list[tuple[str, int, str, str, bool]]) -> DataFrame:
    """doc_id, n_words and, per rule that matches, the words of its matches and of the gaps before them."""
    keywords = "|".join(sorted({r[2] for r in signatures}, key=lambda k: (-len(k), k)))
    known = F.from_json(F.lit(json.dumps([dict(zip(("rule", "label", "level", "keyword", "pattern", "base"), (i, *r), strict=True)) for i, r in enumerate(signatures)])), RULE)
    rows = docs.select("doc_id", spaced_words(F.col("text")).alias("_spaced"))
    rows = rows.withColumn("_keys", F.array_distinct(F.regexp_extract_all("_spaced", F.lit(f"(?i) ({keywords}) "), F.lit(1))))
    rows = rows.withColumn("_lower", F.when(F.size("_keys") > 0, F.translate("_spaced", UPPER, LOWER)))
    rows = rows.withColumn("_keys", F.transform("_keys", F.lower))

    def spots(r: Column) -> Column:
        found = F.transform(F.regexp_extract_all(F.col("_lower"), r["pattern"], F.lit(0)), words_in)
        gaps = F.transform(F.split(F.col("_lower"), r["pattern"], -1), words_in)
        return F.struct(*[r[c].alias(c) for c in ("rule", "label", "level", "base")], found.alias("found"), gaps.alias("gaps"))

    matches = F.when(F.size("_keys") > 0, F.filter(F.transform(F.filter(known, lambda r: F.array_contains("_keys", r["keyword"])), spots), lambda s: F.size(s["found"]) > 0))
    return rows.select("doc_id", words_in(F.col("_spaced")).cast("long").alias("n_words"), matches.alias("_matches"))


def detections(matches: DataFrame) -> DataFrame:
    """_row, rule, label, level, base, start, end (words, end exclusive), kept, of a written table of rule_matches() with _row."""
    each = matches.filter("size(_matches) > 0").select("_row", F.explode("_matches").alias("m"))
    each = each.select("_row", "m.rule", "m.label", "m.level", "m.base", F.posexplode(F.arrays_zip(F.col("m.found").alias("found"), F.slice("m.gaps", F.lit(1), F.size("m.found")).alias("gap"))).alias("_at", "_z"))
    before = W.partitionBy("_row", "rule").orderBy("_at")
    end = F.sum(F.col("_z.found") + F.col("_z.gap")).over(before)
    placed = each.select("_row", "rule", "label", "level", "base", (end - F.col("_z.found")).alias("start"), end.alias("end"))
    # Whatever holds an interval stands before it in this order; levels as sure or surer count.
    order = W.partitionBy("_row").orderBy("start", F.desc("end"), "level", "rule").rowsBetween(W.unboundedPreceding, -1)
    reach = lambda level: F.when(F.col("level") >= level, F.coalesce(F.max(F.when(F.col("level") == level, F.col("end"))).over(order), F.lit(-1)))
    return placed.withColumn("kept", F.col("base") | (F.greatest(*[reach(k) for k in SURE]) < F.col("end")))


def scan_licenses(docs: DataFrame, signatures: list[tuple[str, int, str, str, bool]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents (_row, doc_id, n_words, a row per row of docs) and detections (_row, rule, label, level, base, start, end, kept).

    signatures: label, level (1 to 5), keyword, pattern over spaced lower-case words, and whether it is never suppressed; by default those
    of license_rules. Null and empty texts have no words; a text of any length is scanned whole; doc_id may be null,
    repeated or of any type, as rows are told apart by _row; other columns are left out; an empty table gives none.
    """
    written = cut(rule_matches(docs, signatures or rules()).withColumn("_row", F.monotonically_increasing_id()), "licenses")
    return written.select("_row", "doc_id", "n_words"), detections(written)


def summarise(documents: DataFrame, found: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score: one minus the product of what each distinct kept label leaves open by its surest level; no label: 0.
    """
    base = lambda c: F.when(F.col("base"), F.col(c))
    by_label = found.filter("kept").groupBy("_row", "label").agg(
        F.min("level").alias("level"), F.max("base").alias("base"), F.count(base("start")).alias("n_base"), F.min(base("start")).alias("first_word"), F.max(base("start")).alias("last_word"))
    sure = F.element_at(F.array(*[F.lit(SURE[k]) for k in sorted(SURE)]), F.col("level"))
    by_doc = by_label.groupBy("_row").agg(
        F.sum("n_base").alias("n_base"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word"),
        F.array_sort(F.collect_set(base("label"))).alias("_base"), F.array_sort(F.collect_set("label")).alias("_labels"), F.array_sort(F.collect_list(sure)).alias("_sure"))
    open_ = F.aggregate("_sure", F.lit(1.0), lambda s, c: s * (1 - c))
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return documents.join(by_doc, "_row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        joined("_base").alias("base_labels"), joined("_labels").alias("labels"), F.coalesce(F.round(1 - open_, 6), F.lit(0.0)).alias("score"))


def op13_license_scan(spark, sf_dir: str) -> DataFrame:
    return summarise(*scan_licenses(table(spark, sf_dir, "documents")))


def rule_rows() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    return ", ".join(f"({i}, {quote(label)}, {level}, {quote(keyword)}, {quote(pattern)}, {base})" for i, (label, level, keyword, pattern, base) in enumerate(rules()))


LEFT_OPEN = reduce(lambda text, k: f"{text} WHEN {k} THEN {1 - SURE[k]!r}", SURE, "CASE level") + " END"
OP13_SQL = rf"""WITH rules(rule, label, level, keyword, pattern, base) AS (VALUES {rule_rows()}),
 plain AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{BETWEEN}', '  ', 'g'), ' ') AS t FROM documents),
 texts AS (SELECT doc_id, CASE WHEN t = '' THEN '' ELSE ' ' || t || ' ' END AS t FROM plain),
 hits AS (SELECT doc_id, rules.*, regexp_extract_all(t, pattern) AS m, string_split_regex(t, pattern) AS g FROM texts JOIN rules ON contains(t, ' ' || keyword || ' ')),
 counts AS (SELECT * EXCLUDE (m, g), list_transform(m, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS m, list_transform(g, lambda x: (length(x) - length(replace(x, ' ', ''))) // 2) AS g FROM hits WHERE len(m) > 0),
 spans AS (SELECT * EXCLUDE (m, g, i), CAST(list_sum(g[1:i]) + coalesce(list_sum(m[1:i - 1]), 0) AS BIGINT) AS a, CAST(list_sum(g[1:i]) + list_sum(m[1:i]) AS BIGINT) AS b FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM counts)),
 kept AS (SELECT * FROM spans s WHERE base OR NOT EXISTS (SELECT 1 FROM spans o WHERE o.doc_id = s.doc_id AND o.a <= s.a AND o.b >= s.b AND o.level <= s.level AND (o.a, -o.b, o.level, o.rule) < (s.a, -s.b, s.level, s.rule))),
 by_label AS (SELECT doc_id, label, min(level) AS level, bool_or(base) AS base FROM kept GROUP BY ALL),
 found AS (SELECT doc_id, string_agg(CASE WHEN base THEN label END, ',' ORDER BY label) AS base_labels, string_agg(label, ',' ORDER BY label) AS labels, round(1 - product({LEFT_OPEN}), 6) AS score FROM by_label GROUP BY 1),
 places AS (SELECT doc_id, count(*) AS n_base, min(a) AS first_word, max(a) AS last_word FROM kept WHERE base GROUP BY 1)
 SELECT doc_id, CAST((length(t) - length(replace(t, ' ', ''))) // 2 AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
 FROM texts LEFT JOIN found USING (doc_id) LEFT JOIN places USING (doc_id)"""
