"""Near copies against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest

from quartzite.llm import nearcopies

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def groups(texts, width=5, least=0.8):
    """For each text the first of its group, by all pairs."""
    sets, root = [nearcopies.shingles(t.encode(), width) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            small, large = sorted((len(sets[i]), len(sets[j])))
            if small >= least * large and nearcopies.jaccard(sets[i], sets[j]) >= least:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(r, words, n):
    words = list(words)
    for i in r.sample(range(len(words)), n):
        words[i] = f"new{r.random()}"
    return " ".join(words)


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in enumerate(texts)], DOCS)


def kept(spark, docs):
    return sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").select("doc_id").collect())


def test_stage_equals_brute_force_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    table = docs.select("doc_id", "text").toPandas().sort_values("doc_id")
    first = groups(table.text.tolist())
    ids = table.doc_id.tolist()
    assert kept(spark, docs) == sorted({ids[i] for i in first})


@pytest.mark.parametrize("copies, changes", [(5, 3), (120, 2), (120, 4), (400, 4)])
def test_edited_copies_in_small_and_large_groups(spark, copies, changes):
    r = random.Random(3)
    base = [f"w{r.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(base)] + [edited(r, base, changes) for _ in range(copies)] + [edited(r, base, 60) for _ in range(5)] + ["a b", "A  b", "a c"]
    assert kept(spark, frame(spark, texts)) == sorted(set(groups(texts)))


@pytest.mark.parametrize("few, pivots", [(16, 4), (2, 1)])
def test_drifting_copies_that_no_pivot_connects(spark, monkeypatch, few, pivots):
    """Each text differs a little from the one before it, so the ends have little in common; two such chains from
    one original, and repeated rows, rows without an id and texts without words."""
    monkeypatch.setattr(nearcopies, "FEW", few)
    monkeypatch.setattr(nearcopies, "PIVOTS", pivots)
    monkeypatch.setattr(nearcopies, "BLOCK", 8)
    r = random.Random(11)
    texts = []
    for words in ([f"w{r.randrange(5000)}" for _ in range(200)],) * 2:
        words = list(words)
        for i in range(60):
            texts.append(" ".join(words))
            for at in r.sample(range(len(words)), 1 + i % 3):
                words[at] = f"new{r.random()}"
    assert kept(spark, frame(spark, texts)) == sorted(set(groups(texts)))


def test_stage_on_edge_rows(spark):
    rows = [(5, "one two three four five six", "a"), (5, "one two three four five six", "a"), (None, "one two three four five six", "b"), (5, "quite another text of seven words", "a"), (None, "no id here at all", "a"), (None, "no id here at all", "c"), (7, None, "a"), (8, "", "a"), (9, " \n", "b"), (10, "word " * 30_000, "a")]
    docs = spark.createDataFrame([(i, t, "en", s, None, 1, t) for i, t, s in rows], DOCS + ", place int, tag string")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    want = [(5, "one two three four five six"), (5, "quite another text of seven words"), (None, "no id here at all"), (7, None), (10, "word " * 30_000)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").columns == docs.columns
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0


def test_bitmaps_bound_the_similarity_from_above():
    r = random.Random(2)
    sets = [{b"%d" % r.randrange(60 + 40 * k) for _ in range(r.randrange(120))} for k in range(40)] + [set()]
    hashes = [nearcopies.hashes_of(s) for s in sets]
    bits = np.array([np.frombuffer(nearcopies.bitmap(h), np.uint64) for h in hashes])
    for i, a in enumerate(sets):
        bound = nearcopies.most_alike(np.array([len(a)] * len(sets)), np.array([len(b) for b in sets]), bits[[i] * len(sets)], bits)
        real = np.array([nearcopies.jaccard(a, b) for b in sets])
        assert (bound >= real - 1e-12).all() and bound[i] == 1.0
        assert (bound <= real + 0.15).all()
