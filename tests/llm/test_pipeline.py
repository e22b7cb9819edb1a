"""The stages against brute force on a small corpus, each on what its predecessor kept."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from quern.llm import shard


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(12)
    d = str(tmp_path_factory.mktemp("corpus"))
    word = lambda: "".join(rng.choice(["ta", "ri", "mon", "el", "sha", "ven", "do", "ku"]) for _ in range(rng.randrange(1, 4)))
    prose = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(prose(35))) for i in range(5)]
    docs, kind = [], {}
    for i in range(400):
        w = prose(rng.randrange(40, 120))
        k = ("junk", "leak", "copy", "clean", "clean", "clean", "clean", "clean")[i % 8]
        if k == "junk":
            w = [x.upper() + "!!" for x in w]
        elif k == "leak":
            w += items[i % 5][1].split() + prose(5)
        elif k == "copy" and i > 8:
            w = [*docs[i - 7][1].split()[:-1], "changed"]
            k = kind[i - 7]
            k = f"copy of {i - 7}" if k == "clean" else k
        docs.append((i, " ".join(w), "en", f"s{i % 4}", 1))
        kind[i] = k
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(k != "junk"), 0) for i, k in kind.items()], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, kind


def test_stages(spark, corpus):
    d, kind = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, d))
        kept[name] = Counter(r["doc_id"] for r in docs.collect())
        if name != "sharding":
            assert docs.columns == columns
    good = {i for i, k in kind.items() if k != "junk"}
    assert set(kept["quality"]) == good
    assert set(kept["near_duplicates"]) == {i for i in good if not kind[i].startswith("copy of")}
    assert set(kept["decontamination"]) == {i for i in kept["near_duplicates"] if kind[i] != "leak"}
    assert set(kept["mixing"]) <= set(kept["decontamination"]) and max(kept["mixing"].values()) <= 3
    assert kept["sharding"] == kept["mixing"]
    rows = docs.select("doc_id", "shard").distinct().collect()
    assert len({r["doc_id"] for r in rows}) == len(rows) and all(0 <= r["shard"] < corpus_pipeline.SHARDS for r in rows)


def test_empty_corpus(spark, corpus):
    d, _ = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.settle(stage(spark, docs, d))
    assert docs.count() == 0 and "shard" in docs.columns


def test_five_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert shard.MULTIPLIER % 2


def test_odd_rows_go_through(spark, tmp_path):
    """Nulls, blanks, a very long text, repeats, null ids and columns with the names that operators use."""
    d = str(tmp_path)
    rows = [(1, None, "a"), (2, "", None), (3, " \n\t", "a"), (None, "a text without an id at all", "b"), (None, "a text without an id at all", "b"), (4, " ".join(f"w{i}" for i in range(40_000)), "b")]
    rows += [(5, "the same seven words in three rows", "a"), (5, "the same seven words in three rows", "a"), (6, "the same seven words in three rows", None), (7, "ünï cödé \U0001f600 text that stands alone", "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, shard string, rk string, _copies int, size int"
    full = [(i, t, "en", s, 0, "x", "y", 1, 2) for i, t, s in rows]
    docs = spark.createDataFrame(full, schema)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    runs = [corpus_pipeline.run(spark, d) for _ in range(2)]
    assert [sorted(c) for c in (r.columns for r in runs)] == [sorted(docs.columns)] * 2
    one, two = (Counter((r["doc_id"], r["text"], r["shard"]) for r in x.collect()) for x in runs)
    assert one == two and {(i, t) for i, t, _ in one} <= {(i, t) for i, t, _ in rows if i != 6}
    assert all(0 <= s < 16 for _, _, s in one) and max(one.values()) <= 3 and any(i == 4 for i, _, _ in one)
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, kept, d)
        assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({(i, t): 1 for i, t, _ in rows if i != 6})
