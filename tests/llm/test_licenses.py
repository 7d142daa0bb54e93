from __future__ import annotations

import re
from collections import Counter

import pytest

from clipseam.llm import licenses as lic
from clipseam.llm.license_rules import rules
from clipseam.llm.registry import QUERIES

TEXTS = [
    "Released under the MIT License.\nAll rights reserved.\nAll rights reserved", "Licensed under CC BY-NC 4.0, or cc-by/CC BY", "SPDX-License-Identifier: Apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.", "cc", "cc by", "accc by", "cc byé cc by", "the GNU Lesser General Public License general public license",
    "https://www.apache.org/licenses/LICENSE-2.0 and GPLv2 or MIT license mit license", "ſpdx license identifier mit", "copyright (c) 2020-2024 Example. ALL RIGHTS RESERVED!",
    "cc by cc by " * 3000, "licensed under the\n\n * apache license,\n * version 2.0 " * 40,
]


def plain(text: str | None) -> dict:
    """The result by Python's own regular expressions and the rule of suppression as it is written."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    spaced = "".join(f" {w} " for w in words)
    known = set(words)
    spans = []
    for i, (label, level, keyword, pattern, base) in enumerate(rules()):
        if keyword in known:
            spans += [(spaced.count(" ", 0, m.start()) // 2, spaced.count(" ", 0, m.end()) // 2, level, i, label, base) for m in re.finditer(pattern, spaced)]
    order = lambda s: (s[0], -s[1], s[2], s[3])
    kept, ends = [], {}
    for s in sorted(spans, key=order):
        if s[5] or all(ends.get(k, -1) < s[1] for k in range(1, s[2] + 1)):
            kept.append(s)
        ends[s[2]] = max(s[1], ends.get(s[2], -1))
    base = [s for s in kept if s[5]]
    sure: dict[str, int] = {}
    for s in kept:
        sure[s[4]] = min(s[2], sure.get(s[4], 9))
    left = 1.0
    for label in sorted(sure):
        left *= 1 - lic.SURE[sure[label]]
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min((s[0] for s in base), default=None), "last_word": max((s[0] for s in base), default=None),
        "base_labels": ",".join(sorted({s[4] for s in base})), "labels": ",".join(sorted(sure)), "score": pytest.approx(1 - left, abs=2e-6),
    }


def example(pattern: str, longest: bool) -> str:
    """One string that the pattern matches: of alternatives the first or last, of optional parts none or all."""
    import re._parser as sre

    def make(parts) -> str:
        out = []
        for op, value in parts:
            name = str(op)
            if name == "LITERAL":
                out.append(chr(value))
            elif name == "IN":
                kind, one = value[-1 if longest else 0]
                out.append(chr(one[0] if str(kind) == "RANGE" else one))
            elif name == "MAX_REPEAT":
                out.append(make(value[2]) * (value[1] if longest else value[0]))
            elif name == "BRANCH":
                out.append(make(value[1][-1 if longest else 0]))
            else:
                out.append(make(value[3]))
        return "".join(out)

    return make(sre.parse(pattern))


def test_every_match_has_its_keyword_and_whole_words():
    assert len(rules()) > 200
    for label, level, keyword, pattern, _ in rules():
        assert level in lic.SURE and re.fullmatch(r"[a-z0-9.-]+", label)
        for longest in (False, True):
            text = example(pattern, longest)
            assert f" {keyword} " in text, pattern
            assert re.fullmatch(r"(?: [a-z0-9]+ )+", text), text
        inner = re.sub(r"\(\?:[^()]*\)\?", "", pattern)  # what may be absent can't hold the keyword
        assert keyword in inner, pattern
    assert not [r for r, n in Counter((r[0], r[3], r[4]) for r in rules()).items() if n > 1]


def test_every_rule_is_found(spark):
    texts = [(i, example(r[3], longest).strip()) for i, r in enumerate(rules()) for longest in (False, True)]
    found = lic.scan_licenses(spark.createDataFrame(texts, "doc_id long, text string"))
    rows, spots = found
    got = {(r["doc_id"], r["rule"]) for r in spots.join(rows, "_row").select("doc_id", "rule").collect()}
    assert got >= {(i, i) for i in range(len(rules()))}


def test_equals_plain_python(spark, edge_rows):
    texts = [*TEXTS, *[r[1] for r in edge_rows]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for r in lic.summarise(*lic.scan_licenses(docs)).collect():
        assert {k: v for k, v in r.asDict().items() if k != "doc_id"} == plain(texts[r["doc_id"]]), texts[r["doc_id"]][:80]


def test_suppression_keeps_the_surer(spark):
    docs = spark.createDataFrame([(1, "Licensed under the Apache License, Version 2.0")], "doc_id long, text string")
    _, spots = lic.scan_licenses(docs)
    rows = spots.collect()
    assert {r["label"] for r in rows} == {"apache-2.0", "apache"}
    assert [(r["label"], r["level"], r["start"], r["end"]) for r in rows if r["kept"]] == [("apache-2.0", 2, 0, 8)]


def test_own_rules(spark):
    docs = spark.createDataFrame([(1, "open sesame open")], "doc_id long, text string")
    rows, spots = lic.scan_licenses(docs, [("door", 3, "open", " open ", False)])
    assert [(r["start"], r["end"]) for r in spots.orderBy("start").collect()] == [(0, 1), (2, 3)]
    assert rows.first()["n_words"] == 3


def test_edges(spark, edge_docs, edge_rows, no_docs, tmp_path):
    folder = f"file://{tmp_path}"
    edge_docs.write.parquet(f"{folder}/documents.parquet")
    found = [r.asDict() for r in QUERIES["op13_license_scan"](spark, folder).collect()]
    assert len(found) == len(edge_rows)
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in found) == sorted((str(r[0]), plain(r[1])["n_words"]) for r in edge_rows)
    assert lic.summarise(*lic.scan_licenses(no_docs)).count() == 0


def test_no_python_on_the_main_path(spark, small_folder):
    rows, spots = lic.scan_licenses(spark.read.parquet(f"{small_folder}/documents.parquet"))
    for df in (lic.rule_matches(spark.read.parquet(f"{small_folder}/documents.parquet"), rules()), lic.summarise(rows, spots)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Arrow|Pandas|CartesianProduct|BroadcastNestedLoop", plan)
