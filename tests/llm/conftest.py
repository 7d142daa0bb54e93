from __future__ import annotations

import random

import pytest

#: Columns that clash with names used inside the operators.
EXTRA = ", ".join(f"{c} string" for c in ("size", "block", "fp", "copies", "n_tokens", "_text", "tile", "anchor", "keys", "score", "toxic", "quality", "key"))
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abdeiklmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(n))


def edge_texts() -> list[str | None]:
    rng = random.Random(11)
    prose = words(rng, 400)
    return [
        None, "", " \t\n\r\x0b\x0c", "one", "two words", prose, prose, prose + " changed", words(rng, 3000), "x" * 20_000,
        "".join(rng.choice("abcdefghij'!?") for _ in range(30_000)), "don't <|endoftext|> we'll<|startoftext|>ok", "Ünïcode ß İ ſ Å é 　x \x1c y", "日本語の文章です。" * 300, "a\n\nb\n a\nb\nb\n", "😀" * 3000, "é" * 4000, "A" * 400, "A" * 401, ("ab " * 5000).strip(), "token = 'abc' token=abcdef012345",
    ]


@pytest.fixture(scope="session")
def edge_rows():
    texts = edge_texts()
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(None, "no id here", None, None, None), (None, None, None, None, None), rows[5], rows[5], (7, "another text of id seven", "en", "s0", 1)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame([(*r, *["clash"] * 13) for r in edge_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small_folder(spark, tmp_path_factory):
    """A folder of tables like the driver's, a few hundred short documents with copies, near copies and labels."""
    rng = random.Random(3)
    bad = ["idiot", "moron", "trash"]
    docs, labels = [], []
    for i in range(500):
        text = words(rng, rng.randint(60, 160))
        toxic = i % 9 == 0
        if toxic:
            parts = text.split(" ")
            for _ in range(4):
                parts.insert(rng.randrange(len(parts)), rng.choice(bad))
            text = " ".join(parts)
        if i % 17 == 3:
            text = docs[i - 3][1]
        low = i % 8 == 5
        if low:
            text = " ".join(f"{w}***" for w in text.split(" "))
        if i % 50 == 7:
            text += ' password = "hunter2hunter2"'
        docs.append((i, text, "en", f"s{i % 5}" if i % 2 else "s0", len(text)))
        if i % 2 == 0 or toxic:
            labels.append((i, 0 if low else 1, int(toxic)))
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder
