"""BPE encoding and decoding of whole texts, long ones by tree concatenation.

A text longer than a leaf is halved again and again; the leaves are encoded on their own, then each pair of halves is
joined: a window around the join is encoded anew and widened until it shares a token with the left half and one with
the right half, at the same place and with the same id. Every pair of neighbouring tokens of the joined row then stands
in a valid encoding (of the left half, the window or the right half), and a row of tokens all of whose neighbouring
pairs are valid is the encoding of its text. Halves meet between two characters of scripts whose letters stand alone
(SAFE), where normalisation can't reach across.

The leaves of a text beyond SPREAD characters are rows of their own, dealt over all tasks and encoded there in parallel;
their text's tree is then joined in one task, where little is encoded anew. Copies of such a text are encoded once.

Leaves look up each run without spaces in a bounded per-process memory, as no token of a tokenizer that drops white
space crosses a space; runs that are new are encoded by the library in one call.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_carry, cut, held, join_skewed, table

TOKENIZER = "word_bpe_49k.json"
LEAF = 8192
#: Characters from which a text's leaves are dealt over tasks.
SPREAD = 1 << 16
#: ASCII, and letters of Hebrew, Cyrillic, Arabic, Devanagari, Thai, kana, Han and Hangul that neither compose with what precedes them nor change with it.
SAFE = re.compile("[\x00-\x7f\u05d0-\u05ea\u0410-\u044f\u0621-\u064a\u0905-\u0939\u0e01-\u0e30\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]{2}")
#: Runs held in a process's memory, and the longest that is held.
MEMORY, LONGEST = 500_000, 60


def tokenizer_json(name: str) -> str:
    """The tokenizer's file as text, read where the job starts and sent to the tasks; its size is fixed."""
    import public_tokenizers

    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


class TreeEncoder:
    """Encodes and decodes as the library does; only for tokenizers that drop white space, mark word ends and have no decoder."""

    def __init__(self, text: str, leaf: int = LEAF, window: int = 64):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        spec = json.loads(text)
        if spec["decoder"] is not None or not spec["model"]["end_of_word_suffix"]:
            raise ValueError("tree concatenation is proven here for tokenizers with word ends and no decoder")
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.leaf, self.window = leaf, window
        end = spec["model"]["end_of_word_suffix"]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        added = {x["id"] for x in spec["added_tokens"]}
        self.token = [""] * (max(vocabulary.values()) + 1)
        for word, i in vocabulary.items():
            self.token[i] = word
        self.length = [len(w.encode()) if i in added else len(w.removesuffix(end)) for i, w in enumerate(self.token)]
        self.utf8 = [w.encode() for w in self.token]
        self.special = max((len(x["content"].encode()) for x in spec["added_tokens"]), default=0)
        self.known: dict[str, bytes] = {"": b""}
        self.rejoined = 0

    def direct(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def leaves(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece as little-endian bytes."""
        runs = [x.replace("\n", " ").split(" ") for x in pieces]
        known = self.known
        if len(known) > MEMORY:
            known.clear()
            known[""] = b""
        new = [*{w for run in runs for w in run if w not in known}]
        fresh = [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
        flat = np.fromiter(chain.from_iterable(fresh), "<u4").tobytes()
        ends = [0, *np.cumsum([4 * len(x) for x in fresh]).tolist()]
        known.update((w, flat[a:b]) for w, a, b in zip(new, ends, ends[1:], strict=False))
        out = [b"".join(map(known.__getitem__, run)) for run in runs]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        return out

    def cut_points(self, text: str) -> list[int]:
        """Where the text is halved, down to leaves: between two safe characters near each middle; none if there are none."""
        points: list[int] = []
        todo = [(0, len(text))]
        while todo:
            low, high = todo.pop()
            if high - low <= self.leaf:
                continue
            middle, reach = (low + high) // 2, self.leaf // 4
            after = SAFE.search(text, middle - 1, min(high, middle + reach))
            before = None if after else SAFE.search(text, max(low, middle - reach), middle + 1)
            if found := after or before:
                points.append(found.start() + 1)
                todo += [(low, found.start() + 1), (found.start() + 1, high)]
        return sorted(points)

    def pieces(self, text: str) -> list[str]:
        """The leaves of a text."""
        points = [0, *self.cut_points(text), len(text)] if len(text) > self.leaf else [0, len(text)]
        return [text[a:b] for a, b in zip(points, points[1:], strict=False)]

    def measure(self, text: str) -> int:
        """UTF-8 bytes of the text as tokens cover it: normalised and without white space."""
        return len(re.sub(r"\s+", "", self.library.normalizer.normalize_str(text)).encode())

    def join(self, text: str, low: int, at: int, high: int, left: bytes, right: bytes) -> bytes:
        """The ids of text[low:high] from those of its halves."""
        self.rejoined += 1
        width, length = self.window, self.length
        while True:
            a, b = max(low, at - width), min(high, at + width)
            if a == low and b == high:
                return np.array(self.direct(text[low:high]), "<u4").tobytes()
            fresh = self.direct(text[a:b])
            seam = self.measure(text[a:at])
            starts, n = [], -seam
            for i in fresh:
                starts.append(n)
                n += length[i]
            # Near its ends the window may hold a part of a special string; what stands there is not shared.
            sure = [s + seam >= self.special and n - s - length[i] >= self.special for s, i in zip(starts, fresh, strict=True)]
            before = {(s, i): k for k, (s, i) in enumerate(zip(starts, fresh, strict=True)) if k and s + length[i] <= 0 and (sure[k] or b == high and s + seam >= self.special)}
            after = {(s, i): k for k, (s, i) in enumerate(zip(starts, fresh, strict=True)) if k < len(fresh) - 1 and s >= 0 and (sure[k] or a == low and n - s - length[i] >= self.special)}
            tail = np.frombuffer(left[-4 * width - 16 :] if a > low else left, "<u4").tolist()
            head = np.frombuffer(right[: 4 * width + 16] if b < high else right, "<u4").tolist()
            # The nearest shared token on either side; at an outer end of the text the window itself is right.
            cut_left, n = ((0, 0) if a == low else None), 0
            for k in range(len(tail) - 1, -1, -1):
                n -= length[tail[k]]
                if a > low and (n, tail[k]) in before and k < len(tail) - 1:
                    cut_left = (len(left) // 4 - len(tail) + k, before[n, tail[k]])
                    break
            cut_right, n = ((len(right) // 4, len(fresh)) if b == high else None), 0
            for k, i in enumerate(head):
                if b < high and k and (n, i) in after:
                    cut_right = (k, after[n, i])
                    break
                n += length[i]
            if cut_left is not None and cut_right is not None and cut_left[1] <= cut_right[1]:
                return left[: 4 * cut_left[0]] + np.array(fresh[cut_left[1] : cut_right[1]], "<u4").tobytes() + right[4 * cut_right[0] :]
            width *= 2

    def join_tree(self, pieces: list[str], done: list[bytes]) -> bytes:
        """The ids of a text from those of its leaves: neighbours are joined level by level."""
        text, ends = "".join(pieces), np.cumsum([len(x) for x in pieces]).tolist()
        parts = [*zip([0, *ends[:-1]], ends, done, strict=True)]
        while len(parts) > 1:
            joined = [(x[0], y[1], self.join(text, x[0], x[1], y[1], x[2], y[2])) for x, y in zip(parts[::2], parts[1::2], strict=False)]
            parts = joined + ([parts[-1]] if len(parts) % 2 else [])
        return parts[0][2]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers; all leaves of all texts are encoded together."""
        pieces = [self.pieces(text) for text in texts]
        done, out, at = self.leaves([*chain.from_iterable(pieces)]), [], 0
        for own in pieces:
            out.append(self.join_tree(own, done[at : at + len(own)]))
            at += len(own)
        return out

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the text that the library's decode gives for these ids, special tokens included."""
        utf8 = self.utf8
        return b" ".join([utf8[i] for i in np.frombuffer(ids, "<u4").tolist()])


def encoder(text: str, leaf: int = LEAF) -> TreeEncoder:
    """This process's encoder for a tokenizer, with what it remembers."""
    return held(("bpe", leaf, hash(text)), lambda: TreeEncoder(text, leaf))


def encode_documents(docs: DataFrame, tokenizer: str | None = None, leaf: int = LEAF, carry: tuple[str, ...] = (), with_ids: bool = False, spread: int = SPREAD) -> DataFrame:
    """A row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, the columns in carry, and ids if asked for.

    tokenizer: the JSON text of a tokenizer. Null and empty texts have no tokens. The leaves of texts beyond spread
    characters are encoded in tasks of their own; the ids of one text are held by one task. Extra columns are left out
    unless carried; repeated rows give repeated rows; an empty table gives none.
    """
    own = ["n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    check_carry(carry, ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"))
    sent = docs.sparkSession.sparkContext.broadcast(tokenizer or tokenizer_json(TOKENIZER))
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    text = F.coalesce("text", F.lit(""))
    chosen = docs.select("doc_id", *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)], text.alias("_text"))
    kept = chosen.columns[:-1]

    def results(work: TreeEncoder, ids: list[bytes]) -> list[pa.Array]:
        columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(work.decode(x)).hexdigest() for x in ids], pa.string())]
        if with_ids:
            columns.append(pa.ListArray.from_arrays(np.cumsum([0, *[len(x) // 4 for x in ids]]).astype(np.int32), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())))
        return columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(sent.value, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *results(work, work.encode(part.column(part.num_columns - 1).to_pylist()))], names=[*kept, *own])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(sent.value, leaf)
        for batch in batches:
            for key, whole in zip(batch.column(0), batch.column(1), strict=True):
                pieces = work.pieces(whole.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(pieces)), pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.string())], names=["_key", "leaf", "piece"])

    def encode_leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = encoder(sent.value, leaf)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(work.leaves(batch.column(2).to_pylist()), pa.binary())], names=["_key", "leaf", "piece", "done"])

    def join_leaves(group: pa.Table) -> pa.Table:
        work = encoder(sent.value, leaf)
        order = np.argsort(np.asarray(group["leaf"])).tolist()
        pieces, done = group["piece"].to_pylist(), group["done"].to_pylist()
        return pa.table([group["_key"][:1].combine_chunks(), *results(work, [work.join_tree([pieces[i] for i in order], [done[i] for i in order])])], names=["_key", *own])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    is_long = F.length("_text") > spread
    short = chosen.filter(~is_long).mapInArrow(run, f"{plain}, {kinds}")
    long = chosen.filter(is_long).withColumn("_key", F.sha2("_text", 256))
    # Few and long: each distinct one is read once more, counted, and cut there.
    texts = cut(long.groupBy("_key").agg(F.count("*").alias("_n"), F.first("_text").alias("_text")), "long-texts")
    total = texts.agg(F.sum("_n")).first()[0]
    if total:
        leaves = texts.select("_key", "_text").mapInArrow(deal, "_key string, leaf int, piece string").repartition("_key", "leaf")
        joined = leaves.mapInArrow(encode_leaves, "_key string, leaf int, piece string, done binary").groupBy("_key").applyInArrow(join_leaves, f"_key string, {kinds}")
        known = cut(joined, "long-ids").join(texts.select("_key", "_n"), "_key")
        short = short.unionByName(join_skewed(long.select(*kept, "_key"), known, ["_key"], total).select(*kept, *own))
    return short.select("doc_id", *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)], *own)


def op2_bpe_codec(spark, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
