"""Periodic runs against plain loops, and the filter audit against SQL and plain Python."""

import hashlib
import itertools
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pandas as pd
import pytest

from quartzite.llm import filteraudit, periodic
from quartzite.llm import queries as q

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard long, n long, code int, failed int"


def plain_runs(w):
    out, n = [], len(w)
    for p in range(1, n // 3 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            length = j - i + p
            if length >= max(24, 3 * p):
                s = w[i : i + length]
                if not any(s[d:] == s[: length - d] for d in range(1, p)):
                    out.append((i, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            a = (h // 10) % len(w)
            p = 1 + (len(w) - a) // (3 + (h // 10) % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def mosaics(seed, n):
    r = random.Random(seed)
    for _ in range(n):
        w = []
        for _ in range(r.randint(0, 6)):
            p, kinds = r.choice([1, 2, 5, 8, 16, 17, 18, 23, 24, 25, 36, 37, 54, 55, 80]), r.choice([1, 2, 3, 50])
            b = [r.randrange(kinds) for _ in range(p)]
            if r.random() < 0.3 and p > 8:
                b = (b[: p // 3] * 3)[: p - 1] + [77]
            w += (b * 8)[: int(p * r.uniform(0.5, 5))] + [r.randrange(60) for _ in range(r.choice([0, 0, 1, 5, 20]))]
            if w and r.random() < 0.2:
                w[r.randrange(len(w))] = 99
        yield w


def test_runs_equal_loops_on_mosaics():
    texts = list(mosaics(3, 250))
    for lo in range(0, len(texts), 5):
        part = texts[lo : lo + 5]
        starts = np.cumsum([0] + [len(t) for t in part])
        assert periodic.block_runs(np.array(sum(part, []), np.int32), starts) == [plain_runs(t) for t in part]


def test_runs_survive_colliding_hashes(monkeypatch):
    """With hashes of three bits the first seeds must collide; the result may not change."""
    calls, mix = [0], periodic.mix

    def poor(x):
        calls[0] += 1
        return mix(x) % np.uint64(8) if calls[0] < 40 else mix(x)

    monkeypatch.setattr(periodic, "mix", poor)
    r = random.Random(5)
    w = [r.randrange(50) for _ in range(70)] * 4 + [r.randrange(1000) for _ in range(900)]
    assert periodic.block_runs(np.array(w), np.array([0, len(w)])) == [plain_runs(w)]
    assert calls[0] > 40


def test_minimizers_are_the_minima_of_windows():
    x = np.random.default_rng(1).integers(0, 9, 200).astype(np.uint64)
    for w in (1, 2, 7, 50, 200, 201):
        want = sorted({i for a in range(len(x) - w + 1) for i in range(a, a + w) if x[i] == x[a : a + w].min()})
        assert periodic.minimizers(x, w).tolist() == want


def test_op12_equals_plain_python(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    got = {r[0]: tuple(r) for r in q.op12_periodic_runs(spark, SF).collect()}
    small = docs[docs.text.str.split().str.len() < 300]
    assert len(got) == len(docs) and len(small) > 100
    for doc_id, text in zip(small.doc_id, small.text):
        assert got[doc_id] == plain_row(doc_id, text)
    assert any(r[1] for r in got.values())


def edge_docs(spark):
    poor = " ".join(["a b"] * 120)
    rows = [
        (1, None, "a"), (2, "", None), (3, poor, "a"), (3, poor, "a"), (4, poor, "b"), (None, poor, None), (None, "x y z " * 30, None), (6, "w " * 90_000, "b"),
        (7, " ".join(f"w{i}" for i in range(250)), "c"), (8, "ABC é b\vc", "c"), (9, "d|e", ""), (10, " \t\n\v\f\r ", "a"), (12, "", "c"),
    ]
    return spark.createDataFrame([(i, t, "en", s, 1, 5, 6, 7, 8) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("planted", [False, True])
def test_periodic_edges(spark, planted):
    docs = edge_docs(spark)
    short = docs.filter("text is null or length(text) < 10000")
    got = sorted((tuple(r)[:8] for r in periodic.periodic_runs(short, planted=planted, limit=600).collect()), key=str)
    want = sorted((plain_row(r.doc_id if planted else None, r.text) if planted else (r.doc_id, *plain_row(None, r.text)[1:]) for r in short.collect()), key=str)
    assert got == want
    long = periodic.periodic_runs(docs.filter("doc_id = 6")).first()
    assert (long.n_runs, long.start, long.length, long.period, long.runs[0].period) == (1, 0, 90_000, 1, 1)
    assert long.collapsed_sha256 == hashlib.sha256(b"w").hexdigest()
    assert periodic.periodic_runs(docs.filter("false")).count() == 0


def plain_audit(docs, labels):
    rows = [(i, t or "", s or "") for i, t, s in docs]
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t] = min(least.get(t, i), i)
    facts = []
    for i, t, s in rows:
        w = t.encode().split()
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        facts.append((s, {f for f in fails if fails[f]}, any(d == i and x == 1 for d, x, _ in labels), any(d == i and y == 1 for d, _, y in labels)))
    out = set()
    for part in {s for s, *_ in facts}:
        own = [f[1:] for f in facts if f[0] == part]
        shapley = {f: 0 for f in "ABCDE"}
        for o in itertools.permutations("ABCDE"):
            for fails, *_ in own:
                if fails:
                    shapley[min(fails, key=o.index)] += 1
        for o in itertools.permutations("ABCDE"):
            for k, f in enumerate(o):
                before = set(o[:k])
                here = [x for x in own if f in x[0] and not x[0] & before]
                out.add((part, "".join(o), k + 1, sum(not x[0] & (before | {f}) for x in own), len(here), sum(f in x[0] and bool(x[0] & before) for x in own), sum(x[0] == {f} for x in own), sum(x[1] for x in here), sum(x[2] for x in here), shapley[f]))
    return out


def test_audit_edges_equal_plain_python(spark):
    docs = edge_docs(spark)
    labels = [(3, 1, 0), (3, None, 1), (4, 0, 1), (None, 1, 1), (7, 1, None), (12, 1, 1)]
    table = spark.createDataFrame([(*x, 1) for x in labels], "doc_id long, quality int, toxic int, part int")
    want = plain_audit([(r.doc_id, r.text, r.source) for r in docs.collect()], [x for x in labels if x[0] is not None])
    for limit in (300, 8 << 20):
        assert {tuple(r) for r in filteraudit.audit(docs, table, limit).collect()} == want
    assert filteraudit.audit(docs.filter("false"), table).count() == 0
    assert filteraudit.audit(docs, table.filter("false")).count() == len(want)


def test_matrix_holds_the_words_of_each_text(spark):
    docs = edge_docs(spark)
    shards = filteraudit.settled(filteraudit.local_shards(docs, 300), "test-shards")
    numbers = filteraudit.numbered_words(shards, 40)
    words = {r.number: bytes(r.word) for r in numbers.collect()}
    assert len(words) == len(set(words.values())) and shards.count() > 3
    got = []
    for r in filteraudit.csr_shards(shards, numbers).collect():
        nnz = filteraudit.unpacked(r["nnz"], np.int32, len(r.docs))
        columns, counts = filteraudit.unpacked(r["columns"], np.int64, r["size"]), filteraudit.unpacked(r["counts"], np.int32, r["size"])
        for d, lo, hi in zip(r.docs, np.cumsum(nnz) - nnz, np.cumsum(nnz)):
            got.append((d.doc_id, tuple(sorted((words[c], int(n)) for c, n in zip(columns[lo:hi], counts[lo:hi])))))
    want = []
    for r in docs.collect():
        w = (r.text or "").encode().split()
        want.append((r.doc_id, tuple(sorted((x, w.count(x)) for x in set(w)))))
    assert sorted(got, key=str) == sorted(want, key=str)


def test_op13_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(q.ORACLE_SQL["op13_filter_audit"]).df()
    got = q.op13_filter_audit(spark, SF).toPandas()
    assert list(got.columns) == list(want.columns) and len(got) == 600 * 20
    by = ["part", "filter_order", "step"]
    pd.testing.assert_frame_equal(got.sort_values(by).reset_index(drop=True), want.sort_values(by).reset_index(drop=True), check_dtype=False)
