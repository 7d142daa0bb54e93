from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest

from clipseam.llm import runs as rn
from clipseam.llm.registry import QUERIES


def brute(words: list, least: int = 6, powers: int = 4) -> list[tuple[int, int, int]]:
    """Start, length and period of every run, by looking at each period alone."""
    n, found = len(words), {}
    for p in range(1, n // powers + 1):
        same = [words[i] == words[i + p] for i in range(n - p)]
        i = 0
        while i < len(same):
            if same[i]:
                j = i
                while j < len(same) and same[j]:
                    j += 1
                if j + p - i >= 2 * p:
                    found.setdefault((i, j + p), p)  # smaller periods come first
                i = j
            i += 1
    return sorted((a, e - a, p) for (a, e), p in found.items() if e - a >= max(least, powers * p))


def contract(doc_id, text: str | None) -> dict:
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    gone = {i for s, m, p in runs for i in range(s + p, s + m)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    s, m, p = best or (None, None, None)
    return {"doc_id": doc_id, "n_runs": len(runs), "start": s, "length": m, "period": p, "exponent_milli": best and 1000 * m // p, "runs_sha256": hashlib.sha256(lines.encode()).hexdigest(), "collapsed_sha256": hashlib.sha256(kept).hexdigest()}


def pieces(rng: random.Random, letters: str) -> list[str]:
    """A text of runs of several periods, nested ones too, between random words."""
    out: list[str] = []
    for _ in range(rng.randint(1, 5)):
        unit = [rng.choice(letters) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.4:
            unit = unit * rng.randint(2, 5) + [rng.choice(letters) for _ in range(rng.randint(0, 3))]
        many = unit * rng.randint(1, 9)
        out += many[: len(many) - rng.randrange(len(unit))] + [rng.choice(letters) for _ in range(rng.randint(0, 5))]
    return out


@pytest.mark.parametrize(("least", "powers"), [(6, 4), (2, 2), (5, 3)])
def test_runs_equal_brute_force(least, powers):
    rng = random.Random(least)
    texts = [pieces(rng, rng.choice(["ab", "abc", "abcdefgh"])) for _ in range(400)] + [["a"] * 300, list("ab" * 200), [], ["a"]]
    texts.append(list(("ab" * 4 + "c") * 12 + "ab" * 9))
    found = rn.search([" ".join(t).encode() for t in texts], least, powers)
    for text, (words, runs) in zip(texts, found, strict=True):
        assert [w.decode() for w in words] == text
        assert runs == brute(text, least, powers), text


def test_search_needs_the_tree(monkeypatch):
    monkeypatch.setattr(rn, "small_children", lambda lcp, deepest: np.zeros((0, 5), np.int64))
    assert rn.search([b"a b " * 20], 6, 4)[0][1] == []


def test_leaves_are_listed_in_parts(monkeypatch):
    text = [pieces(random.Random(5), "ab") for _ in range(30)]
    raw = [" ".join(t).encode() for t in text]
    whole = rn.search(raw, 6, 4)
    monkeypatch.setattr(rn, "LEAVES", 7)
    assert rn.search(raw, 6, 4) == whole


def test_long_runs_stay_cheap():
    raw = [b"a " * 30_000, b"a b c " * 20_000 + b"d"]
    assert [r for _, r in rn.search(raw, 6, 4)] == [[(0, 30_000, 1)], [(0, 60_000, 3)]]


def test_query_equals_brute_force(spark, small_folder):
    found = {r["doc_id"]: r.asDict() for r in QUERIES["op11_periodic_runs"](spark, small_folder).collect()}
    docs = spark.read.parquet(f"{small_folder}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        assert found[d["doc_id"]] == contract(d["doc_id"], d["text"])
    assert sum(r["n_runs"] for r in found.values()) > 0


def test_edges(spark, edge_docs, edge_rows, no_docs, tmp_path):
    folder = f"file://{tmp_path}"
    edge_docs.write.parquet(f"{folder}/documents.parquet")
    key = lambda r: str(sorted(r.items(), key=str))
    found = [r.asDict() for r in QUERIES["op11_periodic_runs"](spark, folder).collect()]
    assert sorted(map(key, found)) == sorted(key(contract(r[0], r[1])) for r in edge_rows)
    assert rn.find_runs(no_docs).count() == 0
    rows = rn.find_runs(edge_docs).collect()
    assert len(rows) == len(edge_rows)
    with pytest.raises(ValueError, match="two periods"):
        rn.find_runs(edge_docs, powers=1)
