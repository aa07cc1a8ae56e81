"""Near-duplicate embeddings against plain products."""

import inspect

import numpy as np
import pytest

from quartzite.llm import embeddup
from quartzite.llm import queries as q

SF = "/root/testdata/sf0.001"


def clusters(seed, groups=30, noise=900, d=24):
    """Groups of near copies of growing size, chains whose ends are far apart, exact copies, and noise."""
    r = np.random.default_rng(seed)
    out = [r.normal(size=(noise, d))]
    for g in range(groups):
        centre = r.normal(size=d)
        out.append(centre * r.uniform(0.5, 3) + r.normal(size=(2 + 6 * g, d)) * 0.12)
    a, b = r.normal(size=(2, d))
    out.append(np.array([np.cos(t) * a + np.sin(t) * b for t in np.linspace(0, 1.5, 12)]))
    out += [np.repeat(out[3][:1], 40, 0), np.repeat(out[0][:2], 3, 0)]
    return np.concatenate(out)


def plain(ids, x):
    """(n_links, component) of each row; all rows usable."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    while True:
        lower = np.array([min(label[i], label[near[i]].min(initial=len(x))) for i in range(len(x))])
        if (lower == label).all():
            break
        label = lower
    return near.sum(1), np.array([min(ids[label == label[i]]) for i in range(len(x))])


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), v.tolist(), 1, 2) for i, v in zip(ids, x)], "vec_id long, embedding array<double>, n int, node int")


def test_links_and_components_against_products(spark):
    x = clusters(1)
    ids = np.random.default_rng(2).permutation(len(x)) + 5
    got = {r.vec_id: r for r in embeddup.near_duplicates(frame(spark, ids, x), shard_rows=700).collect()}
    links, component = plain(ids, x)
    assert len(got) == len(x)
    assert sum(got[i].n_links for i in ids) >= 0.99 * links.sum()
    assert all(got[i].n_links <= n for i, n in zip(ids, links))
    assert np.mean([got[i].component_id == c for i, c in zip(ids, component)]) > 0.99
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


@pytest.mark.parametrize("shard_rows", [5000, 900, 480])
def test_every_shard_count_meets_all_pairs(spark, shard_rows):
    """A beam of the whole shard leaves nothing to the graph: all pairs of 1, 2, 4 and more shards must meet, once."""
    x = clusters(3, groups=12, noise=400)
    ids = np.arange(len(x))
    got = sorted(embeddup.near_duplicates(frame(spark, ids, x), shard_rows=shard_rows, ef=5000, wanted=0).collect())
    links, component = plain(ids, x)
    assert [(r.n_links, r.component_id) for r in got] == list(zip(links.tolist(), component.tolist()))


def test_audit_widens_the_beam(spark):
    x = clusters(4, groups=20, noise=3000)
    nodes = embeddup.settled(frame(spark, np.arange(len(x)), x).selectExpr("vec_id as node", "embedding as vec", "1L as n"), "test-nodes")
    nodes = nodes.dropDuplicates(["vec"])
    index = embeddup.settled(embeddup.build_index(nodes, 4000, 3, 4)[0], "test-index")
    sample = nodes.orderBy("node").limit(4000).collect()
    poor = embeddup.audited_recall(index, sample, 0.9, 2)
    assert poor < 0.999
    ef = embeddup.audited_width(index, nodes, 0.9, 2, 0.999, 4000)
    assert ef > 2 and embeddup.audited_recall(index, sample, 0.9, ef) >= 0.999


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (None, [0.0, -0.0]),
        (7, [1.0, 0.0]), (7, [1.0, 0.0]), (8, [2e200, 1e199]), (9, [-1.0, 0.0]), (10, [1.0, 0.0, 0.0]), (None, [3.0, 0.1]), (None, [0.0, 0.0, 5.0]), (12, [0.0, 1e-200, 0.0]), (11, [0.0, 1.0, 0.0]),
    ]
    t = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, vec string, k1 int")
    got = sorted(map(tuple, embeddup.near_duplicates(t).collect()), key=str)
    want = [(i, 0, i, True) for i in (1, 2, 3, 4, 5, 6, 9, 10)] + [(None, 0, None, True)] * 2
    want += [(7, 3, 7, True), (7, 3, 7, True), (8, 3, 7, False), (None, 3, 7, False), (12, 1, 11, False), (11, 1, 11, True)]
    assert got == sorted(want, key=str)
    assert embeddup.near_duplicates(t.filter("false")).count() == 0


def test_query_has_a_row_per_vector(spark):
    got = q.op11_embedding_dedup(spark, SF).toPandas()
    assert got.columns.tolist() == ["vec_id", "n_links", "component_id", "kept"]
    assert got.vec_id.is_unique and len(got) == spark.read.parquet(f"{SF}/embeddings.parquet").count()


def test_searches_of_fifty_thousand_nodes(spark, monkeypatch):
    """A node is searched for in its own shard and in half of the others: at most 1.5 searches a node up to 65,536 nodes."""

    class Many:
        def count(self):
            return 51_282

        def withColumns(self, *_):  # noqa: N802
            return self

        groupBy = applyInPandas = withColumns  # noqa: N815

    size = inspect.signature(embeddup.near_duplicates).parameters["shard_rows"].default
    _, shards = embeddup.build_index(Many(), size, 16, 48)
    assert (shards + 1) / 2 <= 1.5 and size * size / 8 <= 1 << 27
