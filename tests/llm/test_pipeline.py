from __future__ import annotations

from collections import Counter as Bag

import corpus_pipeline as pipeline
from clipseam.llm.common import cut, table
from clipseam.llm.simhash import fingerprint, wide_fingerprint


def first_of_groups(rows):
    """The smallest id of each group of near copies, by all pairs."""
    root = {r["doc_id"]: r["doc_id"] for r in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    prints = [(r["doc_id"], fingerprint((r["text"] or "").encode()), int.from_bytes(wide_fingerprint((r["text"] or "").encode()).tobytes(), "big")) for r in rows]
    for i, (a, p, w) in enumerate(prints):
        for b, q, v in prints[:i]:
            d = (p ^ q).bit_count()
            if d <= 3 or d <= 7 and (w ^ v).bit_count() <= 38:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {a for a in root if root[a] == a}


def test_stages_take_effect(spark, small_folder):
    docs = table(spark, small_folder, "documents")
    labels = {r["doc_id"]: r["toxic"] for r in table(spark, small_folder, "labels").collect()}
    kept = [docs]
    for name, stage in pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], small_folder), "test"))
    ids = [{r["doc_id"] for r in x.select("doc_id").collect()} for x in kept]
    assert all(x.columns == list(pipeline.COLUMNS) for x in kept[:5])
    gone = ids[0] - ids[1]
    assert sum(labels.get(i, 0) for i in gone) > 0.9 * sum(labels.values()) and sum(1 - labels.get(i, 1) for i in gone) <= 2
    texts = Bag(r["text"] for r in kept[2].select("text").collect())
    assert max(texts.values()) == 1 and ids[2] == first_of_groups(kept[1].select("doc_id", "text").collect())
    assert ids[2] == ids[3] and kept[3].filter("text LIKE '%hunter2%'").count() == 0
    assert kept[3].filter("text LIKE '%[secret]%'").filter("n_chars <> length(text)").count() == 0
    assert max(Bag(r["doc_id"] for r in kept[4].select("doc_id").collect()).values()) <= 3
    assert kept[5].count() == kept[4].count()
    assert Bag(r["doc_id"] for r in pipeline.run(spark, small_folder).select("doc_id").collect()) == Bag(r["doc_id"] for r in kept[5].select("doc_id").collect())


def test_stages_stand_edges(spark, small_folder, edge_docs, no_docs, tmp_path):
    """Each stage on rows with null ids and texts, white space, very long texts, repeated rows and extra columns: what comes out of it."""
    path = f"file://{tmp_path}/edges"
    edge_docs.write.parquet(path)
    docs = spark.read.parquet(path)
    given = Bag((r["doc_id"], r["text"]) for r in docs.collect())
    out = {name: cut(stage(spark, docs, small_folder), "edge") for name, stage in pipeline.STAGES}
    rows = {name: Bag((r["doc_id"], r["text"]) for r in out[name].collect()) for name in list(out)[:-1]}
    assert all(df.columns == list(pipeline.COLUMNS) for df in list(out.values())[:-1])
    wordless = lambda text: not (text or "").encode().split()

    toxic = rows["toxicity"]  # rows stay or go whole: repeated ones alike, and so do texts without words
    assert all(toxic[k] in (0, n) for k, n in given.items())
    assert len({toxic[k] > 0 for k in given if not k[1]}) == 1

    near = rows["SimHash near-dedup"]  # one row of each group, of the rows that were given
    assert not near - given and sum(n for (_, text), n in near.items() if wordless(text)) == 1
    assert all(sum(n for (_, t), n in near.items() if t == text) <= 1 for _, text in given)

    redacted = rows["secret scans"]  # every row stays, null texts stay null, texts without secrets stay as they are
    assert sum(redacted.values()) == sum(given.values())
    assert sum(n for (_, text), n in redacted.items() if text is None) == sum(n for (_, text), n in given.items() if text is None)
    changed = given - redacted
    assert changed and all("abcdef012345" in text for _, text in changed) and all("[secret]" in text for _, text in redacted - given)

    mixed = rows["mixing sources"]  # up to three copies of a row, no other rows
    assert set(mixed) <= set(given) and all(n <= 3 * given[k] for k, n in mixed.items()) and sum(mixed.values()) > 0

    encoded = out["BPE encoding"].collect()  # a row per row; repeated rows alike; without words no tokens
    assert Bag(r["doc_id"] for r in encoded) == Bag(k[0] for k in given.elements())
    tokens: dict = {}
    for r in encoded:
        tokens.setdefault(r["doc_id"], Bag())[r["n_tokens"]] += 1
    assert tokens[0] == tokens[1] == tokens[2] == Bag([0])  # null, empty, white space
    assert 3 in tokens[5].values()  # the row that stands three times

    for _, stage in pipeline.STAGES:
        assert stage(spark, no_docs, small_folder).count() == 0


def test_one_row_of_each_group_stays(spark, edge_docs, tmp_path):
    path = f"file://{tmp_path}/docs"
    edge_docs.unionByName(edge_docs).write.parquet(path)
    docs = spark.read.parquet(path)
    kept = pipeline.drop_near_copies(spark, docs, "").collect()
    prints = [fingerprint((r["text"] or "").encode()) for r in kept]
    every = {fingerprint((r["text"] or "").encode()) for r in docs.collect()}
    assert len(prints) == len(set(prints)) and all(any((a ^ b).bit_count() <= 3 for b in prints) for a in every)
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[:i])
    assert sum(not (r["text"] or "").split() for r in kept) == 1
