"""Token counts by the whole-token shortcut.

Offline, once per job, each vocabulary string is proven or not: it must be one pre-token of the tokenizer's own rule
and encode alone as exactly its own id. Pre-tokens of a text that are in the proven set count one without any merging;
only the rest are merged by the library, each distinct one once while a bounded memory holds it. Letter classes differ
between Unicode versions, so what stands between two spaces and has characters beyond Latin and general punctuation is
no pre-token here but goes to the library as it is, and is remembered likewise.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import tokenizer_json
from .common import held, table

TOKENIZER, LIMIT = "byte_bpe_50k.json", 512
#: Fixed value: the pre-token rule of the byte-level vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Below U+0250 and in the general punctuation, every library agrees on letters and numbers.
RARE = "[^\\x00-\\u024f\\u2000-\\u206f]"
#: No pre-token reaches from what is no space in any library to an ASCII space or line end after it.
SEAM = "(?<=[^\\s\\x1c-\\x1f\\x85\\u180e\\u200b\\ufeff])(?=[ \\n])"
#: Parts held in a process's memory, and the longest that is held.
MEMORY, LONGEST = 400_000, 60


def prove_whole(tokenizer: str) -> set[str]:
    """The vocabulary strings that encode alone as their one token."""
    import regex
    from tokenizers import Tokenizer

    library = Tokenizer.from_str(tokenizer)
    rule, rare = regex.compile(PRE_TOKEN), regex.compile(RARE)
    strings = {i: library.decode([i], skip_special_tokens=False) for i in library.get_vocab(with_added_tokens=False).values()}
    held = [(i, s) for i, s in strings.items() if s and "�" not in s and not rare.search(s) and rule.fullmatch(s) and rule.findall(s) == [s]]
    return {s for (i, s), e in zip(held, library.encode_batch_fast([s for _, s in held], add_special_tokens=False), strict=True) if e.ids == [i]}


class Counter:
    def __init__(self, tokenizer: str, whole: set[str]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(tokenizer)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in json.loads(tokenizer)["added_tokens"]) or r"(?!)")
        self.pre_tokens, self.rare, self.seam = regex.compile(PRE_TOKEN).findall, regex.compile(RARE).search, re.compile(SEAM)
        self.whole = dict.fromkeys(whole, 1)
        self.known = dict(self.whole)

    def split(self, text: str) -> list[str]:
        """Parts of a text that encode alone as they do in it: pre-tokens, and whole stretches with rare characters."""
        if not self.rare(text):
            return self.pre_tokens(text)
        return [*chain.from_iterable([part] if self.rare(part) else self.pre_tokens(part) for part in self.seam.split(text))]

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text; special strings count one each, as the library has it by default."""
        if len(self.known) > MEMORY:
            self.known = dict(self.whole)
        known, parts = self.known, []
        for text in texts:
            if self.special.search(text):
                pieces = self.special.split(text)
                parts.append((len(pieces) - 1, [*chain.from_iterable(map(self.split, pieces))]))
            else:
                parts.append((0, self.split(text)))
        new = [*{p for x in parts for p in x[1] if p not in known}]
        known.update(zip(new, (len(e.ids) for e in self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        out = [n + sum(map(known.__getitem__, own)) for n, own in parts]
        for p in new:
            if len(p) > LONGEST:
                del known[p]
        return out


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """A row per row of docs: doc_id, n_bytes, n_tokens, over_limit.

    Null text: empty, 0 tokens. A text of any length is counted whole in one task, which holds all its pre-tokens. tokenizer: JSON text of a tokenizer with this pre-token rule. Other columns are left
    out; repeated rows give repeated rows; an empty table gives none.
    """
    spec = tokenizer or tokenizer_json(TOKENIZER)
    sent = docs.sparkSession.sparkContext.broadcast((spec, prove_whole(spec)))  # at most the vocabulary
    key = hash(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = held(("counts", key), lambda: Counter(*sent.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                tokens = np.array(work.count(part.column(1).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(tokens), pa.array(tokens > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    text = F.coalesce("text", F.lit(""))
    chosen = docs.select("doc_id", text.alias("_text"), F.octet_length(text).cast("long").alias("_bytes"))
    kind = chosen.schema["doc_id"].dataType.simpleString()
    return chosen.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
