from __future__ import annotations

import hashlib
import random
from collections import Counter as Bag

import numpy as np
import pytest

from clipseam.llm import bpe, token_counts

tokenizers = pytest.importorskip("tokenizers")


def library(name):
    return tokenizers.Tokenizer.from_str(bpe.tokenizer_json(name))


def test_codec_equals_the_library(edge_docs, edge_rows, no_docs):
    t = library(bpe.TOKENIZER)
    want = Bag()
    for i, text, *_ in edge_rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    found = bpe.encode_documents(edge_docs, leaf=256, with_ids=True, carry=("source",)).collect()
    assert Bag((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == want
    assert all(hashlib.sha256(np.array(r["ids"], "<u4").tobytes()).hexdigest() == r["ids_sha256"] for r in found)
    assert bpe.encode_documents(no_docs).count() == 0


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop'", "the ion's re'll ", "aé日!?'s 1\n", "<|endoftx>"])
def test_tree_concatenation_is_exact(alphabet):
    rng = random.Random(alphabet)
    work, t = bpe.TreeEncoder(bpe.tokenizer_json(bpe.TOKENIZER), leaf=64, window=8), library(bpe.TOKENIZER)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 3000))) for _ in range(40)] + ["<|endoftext|>" * 200, "<|endoftext" * 300]
    for text, ids in zip(texts, work.encode(texts), strict=True):
        want = t.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert work.decode(ids).decode() == t.decode(want, skip_special_tokens=False)
    assert work.rejoined > 100


def expected_codec(rows):
    t, out = library(bpe.TOKENIZER), Bag()
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        out[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    return out


def found_codec(docs, **options):
    return Bag((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(docs, **options).collect())


@pytest.mark.parametrize("rows", [[(1, None), (2, "")], [(i, "the same words again") for i in range(1300)]])
def test_batches_without_new_runs(spark, rows):
    assert found_codec(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == expected_codec(rows)


def test_long_texts_are_dealt_by_leaves_and_joined_exactly(spark):
    rng = random.Random(8)
    han = "".join(chr(rng.randint(0x4E00, 0x5000)) for _ in range(9000))
    long = ["".join(rng.choice("the ion's re'll é日!\n") for _ in range(7000)), han, "x" * 5000, "привет мир " * 600, "é" * 3000]
    rows = [*enumerate([*long, "short", None, ""]), (0, long[0]), (None, long[1]), (77, han)]
    docs = spark.createDataFrame([(*r, "clash", "s") for r in rows], "doc_id long, text string, _key string, source string").repartition(3)
    assert found_codec(docs, leaf=256, spread=2000) == expected_codec(rows)
    found = bpe.encode_documents(docs, leaf=256, spread=2000, carry=("source", "text"), with_ids=True).collect()
    assert all(r["source"] == "s" and len(r["ids"]) == r["n_tokens"] for r in found) and len(found) == len(rows)
    work = bpe.TreeEncoder(bpe.tokenizer_json(bpe.TOKENIZER), leaf=256)
    assert max(map(len, work.pieces(han))) <= 256


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.TreeEncoder(bpe.tokenizer_json(token_counts.TOKENIZER))


def test_counts_equal_the_library(edge_docs, edge_rows, no_docs):
    t = library(token_counts.TOKENIZER)
    want = Bag((i, len((x or "").encode()), n := len(t.encode(x or "", add_special_tokens=False).ids), n > 512) for i, x, *_ in edge_rows)
    found = token_counts.count_tokens(edge_docs).collect()
    assert Bag((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found) == want
    assert token_counts.count_tokens(no_docs).count() == 0


def test_counts_of_other_scripts_equal_the_library():
    rng, t = random.Random(12), library(token_counts.TOKENIZER)
    spec = bpe.tokenizer_json(token_counts.TOKENIZER)
    counter = token_counts.Counter(spec, token_counts.prove_whole(spec))
    parts = ["привет", "мир", "日本語", "the", "don't", " ", "  ", "\n", "\u3000", "\u00a0", "\u180e", "\x1c", "\x85", "é", "12", "٣", "!?", "😀", "<|endoftext|>", "ß", "\u200b", "\ufeff", "x"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert counter.count(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    assert " мир" in counter.known


def test_proven_strings_are_single_tokens():
    t = library(token_counts.TOKENIZER)
    whole = token_counts.prove_whole(bpe.tokenizer_json(token_counts.TOKENIZER))
    assert len(whole) > 40_000
    assert all(len(e.ids) == 1 for e in t.encode_batch([*whole], add_special_tokens=False))
    rng = random.Random(9)
    counter = token_counts.Counter(bpe.tokenizer_json(token_counts.TOKENIZER), whole)
    texts = ["".join(rng.choice("ab 's'll\n\t 12é!?\r\x1c\xa0") for _ in range(rng.randint(0, 300))) for _ in range(300)]
    assert counter.count(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]


def test_letter_classes_agree_below_the_rare_range():
    regex = pytest.importorskip("regex")
    from tokenizers import Regex, pre_tokenizers

    chars = [chr(c) for c in range(0x3000) if not regex.search(token_counts.RARE, chr(c))]
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        split = pre_tokenizers.Split(Regex(kind), "isolated")
        for c in chars:
            pieces = [p for p, _ in split.pre_tokenize_str(f"\x01{c}\x01")]
            assert (len(pieces) == 3) == bool(regex.fullmatch(kind, c)) or c == "\x01"
