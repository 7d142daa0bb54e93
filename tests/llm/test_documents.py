"""Operators over documents, each against a plain form of its contract."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter as Bag

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clipseam.llm import mixing, ppm, quality, secrets, simhash, suffix_dedup, toxicity
from clipseam.llm.common import fold_of
from clipseam.llm.components import components, forest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


# Mixing


def plain_targets(sizes, weights, share, cap):
    total, left = sum(sizes.values()) * share, dict(sizes)
    names = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out = {}
    while left:
        rest, all_w = total - sum(out.values()), sum(w[s] for s in left)
        over = [s for s in left if rest * w[s] / all_w >= cap * sizes[s]]
        if not over:
            return out | {s: rest * w[s] / all_w for s in left}
        for s in over:
            out[s] = cap * sizes[s]
            del left[s]
    return out


@pytest.mark.parametrize("share", [0.3, 1.0, 2.5, 5.0])
def test_mix_reaches_its_targets(spark, share):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), None if i % 11 == 0 else f"s{min(i % 29, 6)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix_sources(docs, share=share).collect()
    sizes: Bag = Bag()
    for _, text, s in rows:
        sizes[s] += len(WORD.findall(text))
    want, taken = plain_targets(sizes, mixing.WEIGHTS, share, 3), Bag()
    largest = 200
    for r in found:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
        taken[r["source"]] += r["taken"]
    assert len(found) == len(rows)
    assert all(abs(taken[s] - want[s]) <= largest / 2 for s in sizes)
    assert sorted(found) == sorted(mixing.mix_sources(docs.repartition(7), share=share).collect())


def test_mix_takes_its_pareto_front(spark):
    """One source under its cap: what is taken is the front of the ranking and then what fits behind it, by a plain sort."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * (1 + rng.choice([i % 7, i % 90]))), s) for i in range(400) for s in ("a", "b")]
    found = [r for r in mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=0.4).collect() if r["source"] == "b"]
    target, size = found[0]["target"], found[0]["source_size"]
    f = target / size
    own = [(i, t, len(t.split())) for i, t, s in rows if s == "b"]
    mean = sum(n * n / (n + 256) for *_, n in own) / size

    def key(i, text, n):
        u = (int(hashlib.md5(f"{mixing.SEED}:{i}:{text}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        p = f + min(f, 1 - f) * (n / (n + 256) - mean)
        return (u / (1 - u)) / (p / (1 - p))

    order, want, gap = sorted((key(*x), x[0], x[2]) for x in own), set(), target
    for over in (0, 0, 0.5):
        before = 0
        for _, i, n in order:
            if i not in want and n * (1 - over) <= gap:
                before += n
                if before - n * over > gap:
                    before -= n
                    break
                want.add(i)
        gap -= before
    assert {r["doc_id"] for r in found if r["copies"]} == want
    assert abs(gap) < 0.01 * target
    p = [f + min(f, 1 - f) * (n / (n + 256) - mean) for *_, n in own]
    assert min(p) < 0.9 * max(p) and sum(x * n for x, (*_, n) in zip(p, own, strict=True)) == pytest.approx(target)


def test_mix_weights_documents(spark):
    rows = [(i, "w w w w", "a", float(i % 2)) for i in range(1000)]
    found = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, weight double"), share=0.25, weight_col="weight").collect()
    assert sum(r["taken"] for r in found) == pytest.approx(1000, abs=2) and all(r["copies"] == 0 for r in found if r["doc_id"] % 2 == 0)


def test_mix_edges(edge_docs, edge_rows, no_docs):
    found = mixing.mix_sources(edge_docs, carry=("text", "score")).collect()
    assert len(found) == len(edge_rows) and {r["score"] for r in found} == {"clash"}
    with pytest.raises(ValueError):
        mixing.mix_sources(edge_docs, carry=("size",))
    assert all(r["taken"] == 0 for r in found if not r["text"])
    assert mixing.mix_sources(no_docs).count() == 0


# SimHash and components


def plain_fingerprint(text):
    w = lower(text).split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(values, linked):
    root = list(range(len(values)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(values)):
        for b in range(a):
            if linked(values[a], values[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(a) for a in range(len(values))]


def test_simhash_groups_equal_brute_force(edge_docs, edge_rows, no_docs):
    prints = [plain_fingerprint(r[1]) for r in edge_rows]
    root = plain_groups(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, *_), g in zip(edge_rows, root, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = Bag((r[0], p, least.get(g)) for r, p, g in zip(edge_rows, prints, root, strict=True))
    found = simhash.simhash_groups(edge_docs).collect()
    assert Bag((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in found) == want
    assert simhash.simhash_groups(no_docs).count() == 0


@pytest.mark.parametrize(("tile", "bits"), [(4, 3), (2048, 3), (16, 7), (2048, 7), (64, 5)])
def test_links_of_crowded_keys(spark, tile, bits):
    """Random prints around a few centres: many share segments, so keys are split to tiles."""
    rng = random.Random(tile)
    centres = [rng.getrandbits(64) for _ in range(4)] + [0, 2**64 - 1]
    prints = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 1 + bits))) for c in centres for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"), bits, tile)
    assert all(((r["a"] ^ r["b"]) % 2**64).bit_count() <= 64 for r in edges.collect())
    got = {r["node"]: r["component"] for r in components(edges).collect()}
    root = plain_groups(prints, lambda a, b: (a ^ b).bit_count() <= bits)
    members: dict = {}
    for s, g in zip(signed, root, strict=True):
        members.setdefault(g, []).append(s)
    assert {s: got.get(s, s) for s in signed} == {s: min(m) for m in members.values() for s in m}


def edited(rng, base, part):
    return " ".join(f"new{rng.randrange(10**6)}" if rng.random() < part else w for w in base.split())


def test_near_copies_equal_brute_force(spark):
    """Edited copies of a few texts, and texts that only share a passage, by both fingerprints against all pairs."""
    rng = random.Random(31)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    bases, passage = [text(n) for n in (40, 120, 400)], text(60)
    texts = [edited(rng, b, part) for b in bases for part in (0.002, 0.01, 0.02, 0.05) for _ in range(8)] + [f"{text(40)} {passage}" for _ in range(12)] + ["", None, "one", "one two"]
    prints = [simhash.fingerprint((t or "").encode()) for t in texts]
    wide = [int.from_bytes(simhash.wide_fingerprint((t or "").encode()).tobytes(), "big") for t in texts]
    place = list(range(len(texts)))
    root = plain_groups(place, lambda a, b: (d := (prints[a] ^ prints[b]).bit_count()) <= 3 or d <= 7 and (wide[a] ^ wide[b]).bit_count() <= 38)
    least = {}
    for i, g in enumerate(root):
        least[g] = min(i, least.get(g, i))
    found = simhash.simhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), near=True).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: least[g] for i, g in enumerate(root)}
    strict = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert len(set(strict.values())) > len(set(least.values()))
    assert len({least[root[i]] for i in range(96, 108)}) == 12  # a shared passage alone links nothing


def test_wide_fingerprint_by_hand():
    import xxhash

    words = "A b c d e f g".split()
    hashes = [xxhash.xxh3_128_digest(x, 42) + xxhash.xxh3_128_digest(x, 43) for x in (" ".join(words[i : i + 5]).lower().encode() for i in range(3))]
    bits = ["".join(f"{b:08b}" for b in h) for h in hashes]
    want = "".join("1" if sum(b[i] == "1" for b in bits) >= 2 else "0" for i in range(256))
    assert "".join(f"{b:08b}" for b in simhash.wide_fingerprint(" ".join(words).encode()).tobytes()) == want
    assert not simhash.wide_fingerprint(b" ").any()


def test_components_of_long_paths(spark):
    rng = random.Random(8)
    nodes = rng.sample(range(10**6), 300)
    edges = [*zip(nodes[:100], nodes[1:100]), *[(nodes[100], x) for x in nodes[101:250]], *[(nodes[260], nodes[261]), (nodes[261], nodes[260]), (nodes[5], nodes[5])]]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: min(g) for g in (nodes[:100], nodes[100:250], nodes[260:262]) for n in g}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    ids, root = forest(np.array([5, 9, 2]), np.array([9, 7, 3]))
    assert dict(zip(ids.tolist(), root.tolist(), strict=True)) == {2: 2, 3: 2, 5: 5, 7: 5, 9: 5}


# Secrets


def plain_spans(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(secrets.BASE[k], a, b) for a, k, b in sorted(found)]


def test_secret_spans_equal_regexes(spark, edge_docs, edge_rows, no_docs):
    rng = random.Random(4)
    parts = ["token", "secret", "API_KEY", "apikey", "Password", "passwd", "=", ":", " ", "  ", '"', "'", "é", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "x", "\n", "tok", "AKIAAKIA", "abc", "日"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + ["secret=token: abcdef", "secret=token: token=abcdefg", "token==abcdef", "password" * 50 + "=abcdef"]
    found = secrets.find_secrets(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    for r in found:
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in secrets.BASE] == plain_spans(texts[r["doc_id"]])
    edge = secrets.find_secrets(edge_docs).collect()
    assert Bag((r["doc_id"], str([(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in secrets.BASE])) for r in edge) == Bag((r[0], str(plain_spans(r[1]))) for r in edge_rows)
    assert secrets.find_secrets(no_docs).count() == 0


def test_issued_forms_and_redaction(spark, edge_docs):
    key = "-----BEGIN RSA PRIVATE KEY-----"
    forge, web = "ghp_" + "a1B2" * 9, "eyJhbGciOi.eyJzdWIiOiIx.abc-def_0123456789abcdefgh"
    docs = spark.createDataFrame([(1, f"é {key} {forge} x"), (2, web), (3, None), (4, "clean text"), (5, "token = abcdef0123456789abcdef0123")], "doc_id long, text string")
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in secrets.find_secrets(docs).collect()}
    assert kinds == {1: ["private_key", "forge_token"], 2: ["web_token"], 3: [], 4: [], 5: ["assign", "hex"]}
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs).collect()}
    assert clean == {1: "é [secret] [secret] x", 2: "[secret]", 3: None, 4: "clean text", 5: "[secret]"}
    assert secrets.redact_secrets(edge_docs).columns == edge_docs.columns


def test_scans_are_linear_in_the_text():
    scan = secrets.Scanner(secrets.RULES)
    web = b"eyJaaaaaaaaaaaaaaaaaaaaaaa.eyJbbbbbbbbbbbbbbbbb.cccccccc"
    began = time.monotonic()
    for text in (b"eyJ" * 350_000 + b" " + web, b"eyJ" * 350_000 + b".eyJa.x", b"token" * 200_000 + b"=abcdef", b"-----BEGIN " * 90_000 + b"PRIVATE KEY-----"):
        assert scan.spans(text)
    assert time.monotonic() - began < 20
    with pytest.raises(ValueError):
        secrets.compile_rules(["a*"], True)


# Quality


def plain_counts(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Bag(zip(w, w[1:], w[2:]))
    covered = {k + d for k in range(len(w) - 2) if windows[w[k], w[k + 1], w[k + 2]] > 1 for d in range(3)}
    seen, repeats = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeats += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeats, len(covered)


def test_quality_counts_and_edges(edge_docs, edge_rows, no_docs):
    found = quality.judge_quality(edge_docs, quality.QualityModel()).collect()
    want = Bag((r[0], *(c := plain_counts(r[1])), c[0] < 50 or 100 * c[4] > 50 * c[0]) for r in edge_rows)
    assert Bag((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found) == want
    assert all(r["kept"] == (not r["base_failed"]) and r["probability"] is None for r in found)
    assert quality.judge_quality(no_docs, quality.QualityModel()).count() == 0


def test_quality_is_learned_on_rows_it_did_not_see(spark, small_folder):
    docs, labels = spark.read.parquet(f"{small_folder}/documents.parquet"), spark.read.parquet(f"{small_folder}/labels.parquet")
    train = labels.filter("doc_id % 4 = 0")
    found = quality.judge_quality(docs, quality.fit(docs, train)).join(labels.filter("doc_id % 4 <> 0"), "doc_id").filter("not base_failed").collect()
    assert np.mean([r["kept"] == bool(r["quality"]) for r in found]) > 0.95
    assert quality.fit(docs, labels.filter("quality = 1")).weights is None and quality.fit(docs, labels.limit(0)).weights is None
    named = quality.fit(docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")), labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    assert named.weights is not None
    nulls = labels.select("doc_id", F.lit(None).cast("int").alias("quality"))
    assert quality.fit(docs, nulls).weights is None


# Toxicity


def test_nearest_is_exact():
    rng = np.random.default_rng(5)
    terms = {f"t{i}": i for i in range(40)}

    def unit():
        t, w = np.sort(rng.choice(40, 4, replace=False)), rng.random(4) + 0.1
        return t, w / np.sqrt((w * w).sum())

    model = toxicity.NearestExamples([*range(3000)], rng.integers(0, 2, 3000).astype(float), [unit() for _ in range(3000)], terms, np.ones(40), k=10)
    dense = np.zeros((3000, 40))
    for i, (t, w) in enumerate(model.vectors):
        dense[i, t] = w
    for _ in range(50):
        t, w = unit()
        full = dense[:, t] @ w
        at, cos = model.nearest(t, w)
        bar = np.sort(full)[-10]
        assert set(at.tolist()) == set(np.flatnonzero(full >= bar - 1e-9).tolist()) and cos == pytest.approx(full[at])
        assert int(at[0]) not in model.nearest(t, w, int(at[0]))[0]
    assert model.visited < 100 * model.blocks  # blocks were passed over


@pytest.mark.parametrize("n", [0, 1, 1024, 1025, 1600])
def test_nearest_is_exact_in_blocks_of_either_size(n):
    rng = np.random.default_rng(n)
    vectors = []
    for _ in range(n + 10):
        t, w = np.sort(rng.choice(300, 3, replace=False)), rng.random(3) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum())))
    model = toxicity.NearestExamples([*range(n)], np.zeros(n), vectors[:n], {f"t{i}": i for i in range(300)}, np.ones(300), k=3)
    assert model.blocks == -(-n // (256 if n <= 1024 else 64))
    dense = np.zeros((n, 300))
    for i, (t, w) in enumerate(model.vectors):
        dense[i, t] = w
    for t, w in vectors[n:]:
        full = dense[:, t] @ w
        bar = max(np.sort(full)[-3:][0] if n > 2 else 0, 1e-9)
        at, cos = model.nearest(t, w)
        assert set(at.tolist()) == set(np.flatnonzero(full >= bar - 1e-9).tolist()) - set(np.flatnonzero(full == 0).tolist()) and cos == pytest.approx(full[at])
    assert n <= 1024 or model.visited < 10 * model.blocks


def test_terms_are_found_as_they_are_counted():
    rng = random.Random(9)
    texts = [" ".join(rng.choice(["abcdefg", "abcde", "abcdx", "ab", "réeuxment", "réeuxa", "x1y", "B"]) for _ in range(rng.randint(0, 12))) for _ in range(50)]
    names = sorted({t for x in texts for t in toxicity.terms_of(x)})
    finder = toxicity.TermFinder({t: i for i, t in enumerate(names)})
    finder.numbers = finder.numbers[:5]  # forgets again and again
    for x in [*texts, " ".join(f"w{chr(97 + i % 26)}{'z' * i}" for i in range(40))]:
        at, times = finder.counts(x)
        assert {names[i]: round(math.exp(t - 1)) for i, t in zip(at, times, strict=True)} == {t: n for t, n in toxicity.terms_of(x).items() if t in finder.terms}


def test_weights_rise_with_the_evidence_and_none_is_zero():
    w = toxicity.term_weights(np.array([50.0, 1, 10, 0]), np.array([0.0, 0, 90, 50]), 100, 900)
    assert (w > 0).all() and w[0] > 100 * w[2] and w[1] < w[0] / 50


def test_toxicity_on_rows_it_did_not_see(spark, small_folder, edge_docs, edge_rows, no_docs):
    docs, labels = spark.read.parquet(f"{small_folder}/documents.parquet"), spark.read.parquet(f"{small_folder}/labels.parquet")
    found = toxicity.toxic_nearest(docs, labels).join(labels, "doc_id").collect()
    for held in (True, False):
        part = [r for r in found if r["held_out"] == held]
        assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in part)
        assert np.mean([r["predicted"] == r["toxic"] for r in part]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert all(r["evidence"] for r in found)
    model = toxicity.fit(docs, labels, fold_of() != 0)
    assert {"idiot", "moron", "trash"} <= set(model.terms)
    edge = toxicity.score_toxicity(edge_docs, model, carry=("size", "text")).collect()
    assert Bag(r["text"] for r in edge) == Bag(r[1] for r in edge_rows) and {r["size"] for r in edge} == {"clash"}
    assert len(edge) == len(edge_rows) and all(r["predicted"] == 0 for r in edge)
    assert toxicity.score_toxicity(no_docs, model).count() == 0
    one = toxicity.toxic_nearest(docs, labels.filter("toxic = 0")).agg(F.max("score"), F.min("score")).first()
    assert tuple(one) == (0.0, 0.0)
    assert toxicity.toxic_nearest(docs, labels.limit(0)).filter("score = 0").count() == docs.count()


# PPM


def test_ppm_base_and_scores(spark, edge_docs, edge_rows, no_docs):
    found = ppm.ppm_scores(edge_docs, fold_of() != 1).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    tokens = [[*lower(r[1]).split(), None] for r in edge_rows]
    c = Bag(t for r, ts in zip(edge_rows, tokens, strict=True) if not held(r[0]) for t in ts)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), held(r[0]), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts), 6)) for r, ts in zip(edge_rows, tokens, strict=True))
    got = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in found)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == pytest.approx([w[5] for w in want], rel=1e-6)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in found)
    assert ppm.ppm_scores(no_docs, fold_of() != 1).count() == 0
    assert ppm.ppm_scores(edge_docs, F.lit(False)).filter("train_tokens = 0 AND n_known = 0").count() == len(edge_rows)


def plain_ppm(train, text, order=ppm.ORDER):
    """Escape and exclusion, a symbol at a time, over dictionaries."""
    top: Bag = Bag()
    stream = lambda t: bytes([ppm.BEFORE]) * order + t + bytes([ppm.END])
    for t in train:
        s = stream(t)
        top.update(s[i - order : i + 1] for i in range(order, len(s)))
    levels = {order: top}
    for k in range(order - 1, -1, -1):
        levels[k] = Bag(g[1:] for g in levels[k + 1])
    contexts = {k: {} for k in levels}
    for k, grams in levels.items():
        for g, n in grams.items():
            contexts[k].setdefault(g[:-1], {})[g[-1]] = n
    s, total = stream(text), 0.0
    for i in range(order, len(s)):
        out: set = set()
        for k in range(order, -1, -1):
            seen = contexts[k].get(s[i - k : i])
            if seen is None:
                continue
            open_ = {x: n for x, n in seen.items() if x not in out}
            n = sum(open_.values())
            if s[i] in open_:
                total += math.log10((open_[s[i]] - ppm.DISCOUNT) / n)
                break
            if open_:
                total += math.log10(ppm.DISCOUNT * len(open_) / n)
            out |= set(seen)
        else:
            total -= math.log10(max(256 - len(out), 1))
    return total


def test_ppm_equals_a_plain_model(spark):
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd e") for _ in range(rng.randint(0, 80))) for _ in range(60)] + ["zebra", "", "ab" * 50]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r["score"] for r in ppm.ppm_scores(docs, F.col("doc_id") % 3 != 0).collect()}
    train = [lower(t) for i, t in enumerate(texts) if i % 3]
    for i, t in enumerate(texts):
        assert found[i] == pytest.approx(plain_ppm(train, lower(t)), rel=1e-5)


def test_ppm_is_a_distribution():
    keys, n = np.unique(ppm.grams(ppm.joined([b"abracadabra", b"abba", b"cab"])[0]), return_counts=True)
    levels = ppm.levels_of(keys, n, ppm.ORDER, [])
    for context in (0xFFFFFFFFFF, int.from_bytes(b"abrac", "big"), int.from_bytes(b"zzzab", "big"), int.from_bytes(b"zzzzz", "big")):
        every = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** ppm.log_probability(every, levels)).sum() == pytest.approx(1)


# Suffix sort


def plain_removal(texts, width=suffix_dedup.WIDTH):
    seen: Bag = Bag()
    for t in texts:
        seen.update(t[p : p + width] for p in range(len(t) - width + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - width + 1):
            if seen[t[p : p + width]] > 1:
                gone[p : p + width] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((len(t), int(gone.sum()), int((np.diff(np.append(0, gone.astype(int))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("tile", [2, 1024])
def test_removal_equals_brute_force(spark, tile):
    rng = random.Random(tile)
    passages = ["".join(rng.choice("abcdefgh é\n") for _ in range(n)) for n in (399, 400, 401, 700, 1500, 90)]
    texts = []
    for _ in range(80):
        texts.append("".join(rng.choice(passages) if rng.random() < 0.4 else "".join(rng.choice("abc xyz") for _ in range(rng.randint(1, 300))) for _ in range(rng.randint(1, 6))))
    texts += ["ab" * 700, "a" * 900, "a" * 400, "b" * 401]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs, tile).collect()}
    assert [found[i] for i in range(len(texts))] == plain_removal([t.encode() for t in texts])


def test_work_for_a_common_short_passage_follows_its_texts(spark, monkeypatch):
    rng = random.Random(8)
    passage, copied = ("".join(rng.choice("abcdefgh \n") for _ in range(n)) for n in (300, 90))
    texts = ["".join(rng.choice("abc xyz") for _ in range(380)) + passage + "".join(rng.choice("abc xyz") for _ in range(380)) for _ in range(60)]
    # Pairs that share strings around the passage, of 400 bytes and more and of fewer.
    texts += [copied + passage + copied[:9] + "r", copied + passage + copied[:9] + "s", copied + passage + copied[:10], "t" + copied + passage + copied[:11], copied[1:] + passage + copied[:10]]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").repartition(5)
    sorted_rows, sort_segments = [], suffix_dedup.sort_segments

    def count_rows(wanted):
        sorted_rows.append(wanted.count())
        return sort_segments(wanted)

    monkeypatch.setattr(suffix_dedup, "sort_segments", count_rows)
    found = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.remove_repeats(docs, 4).collect()}
    want = plain_removal([t.encode() for t in texts])
    assert [found[i] for i in range(len(texts))] == want and sum(x[1] > 0 for x in want) == 2
    assert sorted_rows[0] < 2 * len(texts)  # pairs of tiles of 4 would be 60 * 15 and more


def test_parts_hold_each_string_once_and_equal_strings_in_equal_parts():
    rng = np.random.default_rng(9)
    text = rng.integers(97, 101, 1000).astype(np.uint8).tobytes()
    for step in suffix_dedup.STEPS:
        parts: dict = {}
        # The anchor at 500; a segment of all its strings, and one of some of them in other surroundings.
        for whole, at, count, distance in ((text, 164, 337, 336), (b"x" * 50 + text[210:800], 50, 150, 290)):
            for key, _, low, shape in suffix_dedup.split_parts(whole, at, count, distance, step):
                for k in range(shape & ((1 << 20) - 1)):
                    start = low + k + (160 if whole is not text else 0)
                    assert (shape >> 20) - k == 500 - start
                    parts.setdefault(start, []).append(key)
        assert sorted(parts) == [*range(164, 501)]
        assert all(len(parts[x]) == 1 + (210 <= x < 360) and len({*parts[x]}) == 1 for x in parts)


def test_removal_edges(edge_docs, edge_rows, no_docs):
    want = Bag((r[0], *x) for r, x in zip(edge_rows, plain_removal([(r[1] or "").encode() for r in edge_rows]), strict=True))
    found = suffix_dedup.remove_repeats(edge_docs, with_text=True).collect()
    assert Bag((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in found) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in found)
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_suffixes_sort_as_bytes():
    rng = np.random.default_rng(2)
    raw = np.concatenate([np.tile(rng.integers(97, 99, 450), 4), rng.integers(97, 99, 600)]).astype(np.uint8)
    sorter = suffix_dedup.SuffixSorter(raw)
    suffixes, sets = np.arange(len(raw) - 400), np.sort(rng.integers(0, 5, len(raw) - 400))
    got = sorter.sort(suffixes, sets)
    text = raw.tobytes()
    for s in range(5):
        want = sorted(suffixes[sets == s].tolist(), key=lambda p: text[p : p + 400])
        assert [text[p : p + 400] for p in got[sets == s].tolist()] == [text[p : p + 400] for p in want]


def mixed_segments(rng):
    """Three segments of one anchor and distance, the outer two of which share their first string."""
    x, y = rng.integers(65, 91, (2, suffix_dedup.WIDTH)).astype(np.uint8)
    return [x.tobytes() + b"pp", y.tobytes() + b"qq", x.tobytes() + b"rr"], np.zeros(3, np.int64), np.zeros(3, np.int64)


def test_the_suffix_sort_decides_what_repeats(monkeypatch):
    rng = np.random.default_rng(3)
    texts, anchors, distances = mixed_segments(rng)
    assert [x.tolist() for x in suffix_dedup.repeated(texts, anchors, distances)] == [[0], [], [0]]
    assert [x.tolist() for x in suffix_dedup.repeated(texts, anchors, distances, np.array([False, True, False]))] == [[0], [0, 1, 2], [0]]
    monkeypatch.setattr(suffix_dedup.SuffixSorter, "sort", lambda self, suffixes, sets: suffixes)
    assert [x.tolist() for x in suffix_dedup.repeated(texts, anchors, distances)] == [[], [], []]


def test_hashes_that_collide_remove_nothing_and_hide_nothing(monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(suffix_dedup.PrefixHash, "of", lambda self, at, length: np.zeros(len(at), np.uint64))
    texts, anchors, distances = mixed_segments(rng)
    assert [x.tolist() for x in suffix_dedup.repeated(texts, anchors, distances)] == [[0], [], [0]]


def test_digests_that_collide_fold_nothing():
    rng = np.random.default_rng(5)
    texts = [rng.integers(65, 91, suffix_dedup.WIDTH + 3).astype(np.uint8).tobytes() for _ in range(2)]
    rows = [[7, 7], [0, 0], [0, 0], [1, 1], [2, 2], [0, 5000], [2, 2], [0, 0], texts]
    assert suffix_dedup.fold_and_sort(rows).num_rows == 0
    rows[-1] = [texts[0], texts[0]]
    assert suffix_dedup.fold_and_sort(rows).to_pylist() == [{"head": 1, "tail": 2, "place": None, "size": None}]


def test_segments_hold_each_string_once_in_chunks_of_any_size(monkeypatch):
    rng = np.random.default_rng(6)
    lengths = np.array([0, 5000, 399, 400, 0, 3000])
    raw = rng.integers(97, 101, lengths.sum()).astype(np.uint8)

    def by_start():
        anchors, _, _, lows, shapes = suffix_dedup.segments(raw, lengths)
        return {int(low) + k: (int(a), int(shape >> 20) - k) for a, low, shape in zip(anchors, lows, shapes, strict=True) for k in range(int(shape & ((1 << 20) - 1)))}

    whole = by_start()
    assert len(whole) == (lengths - 399).clip(0).sum()
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    assert by_start() == whole


def test_models_take_one_row_of_each_id_and_label(spark, small_folder):
    """Repeated rows of a labelled document, and repeated labels, change neither model; no text reaches the driver."""
    docs, labels = (spark.read.parquet(f"{small_folder}/{n}.parquet") for n in ("documents", "labels"))
    some = docs.filter("doc_id % 4 = 0")
    more = docs.unionByName(some).unionByName(some)
    again = labels.unionByName(labels.filter("doc_id % 3 = 0"))
    once, twice = toxicity.fit(docs, labels, toxicity.fold_of() != 0), toxicity.fit(more, again, toxicity.fold_of() != 0)
    assert once.ids == twice.ids and once.terms == twice.terms and np.allclose(once.weights, twice.weights) and once.curve == pytest.approx(twice.curve)
    a, b = quality.fit(docs, labels), quality.fit(more, again)
    assert np.allclose(a.weights, b.weights) and a.bias == pytest.approx(b.bias)


def test_plain_idf_is_an_option(spark, small_folder):
    docs, labels = (spark.read.parquet(f"{small_folder}/{n}.parquet") for n in ("documents", "labels"))
    plain = toxicity.fit(docs, labels, toxicity.fold_of() != 0, lean=False)
    rows = np.array([2.0, 30.0])
    assert toxicity.term_weights(rows, rows, 50, 70, lean=False) == pytest.approx(np.log(121 / (1 + 2 * rows)) + 1)
    assert plain.weights.min() >= 1  # labels raise or lower nothing
