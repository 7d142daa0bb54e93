from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from clipseam.llm import importance as im


def grams_of(text: str | None, grams: int) -> tuple[int, list[int]]:
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, grams + 1) for i in range(len(words) - k + 1)]


def plain(docs: list, target: list, grams: int = 1, buckets: int = 10_000, percent: int = 10, least: int = 20) -> list[dict]:
    s, t = (Counter(h % buckets for x in texts for h in grams_of(x, grams)[1]) for texts in ([d[1] for d in docs], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, hashes = grams_of(text, grams)
        weight = sum(gain[h % buckets] for h in hashes)
        u = (int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        out.append({"doc_id": i, "n_words": n, "n_features": len(hashes), "weight": weight, "score": weight + math.floor(-1000 * math.log(-math.log(u)))})
    large = sorted((r for r in out if r["n_words"] >= least), key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0))
    for r in out:
        r["rank"] = None
    for k, r in enumerate(large[: percent * len(large) // 100]):
        r["rank"] = k + 1
    return out


def key(r: dict) -> str:
    return repr(sorted(r.items()))


@pytest.fixture(scope="module")
def corpus(spark, small_folder):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small_folder}/documents.parquet").select("doc_id", "text").collect()]
    return docs, [docs[i][1][:300] for i in range(0, 60, 3)]


@pytest.mark.parametrize(("grams", "buckets", "percent", "least"), [(1, 10_000, 10, 20), (3, 257, 35, 90)])
def test_equals_brute_force(spark, corpus, grams, buckets, percent, least):
    docs, target = corpus
    found = im.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), grams, buckets, percent, least).collect()
    assert sorted(key(r.asDict()) for r in found) == sorted(map(key, plain(docs, target, grams, buckets, percent, least)))


def test_ranks_over_many_ranges(spark, corpus, monkeypatch):
    docs, target = corpus
    monkeypatch.setattr(im, "RANGE", 40)
    monkeypatch.setattr(im, "CHUNK", 2_000)
    found = im.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert sorted(key(r.asDict()) for r in found) == sorted(map(key, plain(docs, target)))


def test_counts_are_spilled_before_they_are_merged(spark, corpus):
    docs, _ = corpus
    found = im.bucket_counts(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), buckets=64)
    plan = found._jdf.queryExecution().toString()
    assert "parquet" in plan.lower() and "MapInArrow" not in plan
    want = Counter(h % 64 for _, text in docs for h in grams_of(text, 1)[1])
    assert {r["bucket"]: r["n"] for r in found.collect()} == dict(want)


def test_edges(spark, edge_docs, edge_rows, no_docs):
    texts = [(r[0], r[1]) for r in edge_rows]
    target = [None, "", "one two words", "don't <|endoftext|> we'll"]
    want = plain(texts, target)
    found = [r.asDict() for r in im.resample(edge_docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()]
    bare = lambda rows: sorted(key({k: v for k, v in r.items() if k != "rank"}) for r in rows)
    assert bare(found) == bare(want)
    assert sorted(r["rank"] for r in found if r["rank"]) == sorted(r["rank"] for r in want if r["rank"])
    assert im.resample(no_docs, no_docs).count() == 0
    alone = [r.asDict() for r in im.resample(edge_docs, no_docs).collect()]
    assert bare(alone) == bare(plain(texts, []))


def test_repeated_rows_have_ranks_of_their_own(spark):
    docs = [(7, "same words " * 20)] * 30
    found = im.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("same",)], "text string")).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == [1, 2, 3]


def test_gains_must_be_whole(spark, corpus):
    docs = spark.createDataFrame(corpus[0], "doc_id long, text string")
    with pytest.raises(ValueError, match="one row for each"):
        im.document_weights(docs, spark.createDataFrame([(0, 5)], "bucket long, gain long"))
