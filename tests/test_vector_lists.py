"""Nearest vectors by lists against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import retrieve, vector_lists


def gathered(n, dim, centres, seed=3, spread=0.08):
    rng = np.random.RandomState(seed)
    base = rng.standard_normal((centres, dim))
    return base[rng.randint(centres, size=n)] + spread * rng.standard_normal((n, dim))


def slow(rows, asks, k):
    out = {}
    for q, v in asks:
        v = np.asarray(v, float)
        own = []
        for i, w in rows:
            if w is not None and len(w) == len(v) and all(x is not None and np.isfinite(x) for x in w):
                w = np.asarray(w, float)
                norm = np.linalg.norm(v) * np.linalg.norm(w)
                own.append((-round((1 + (v @ w / norm if norm else 0.0)) / 2, 12), i))
        out |= {(q, r): i for r, (_, i) in enumerate(sorted(own)[:k], 1)}
    return out


@pytest.fixture
def pairs_formed(spark, monkeypatch):
    """Counts the products that tasks form."""
    total = spark.sparkContext.accumulator(0)
    plain = vector_lists.best_pairs

    def counting(unit, floor, docs, k):
        total.add(len(unit) * len(docs))
        return plain(unit, floor, docs, k)

    monkeypatch.setitem(vector_lists.meet.__globals__, "best_pairs", counting)
    return total


def tables(spark, rows, asks):
    return spark.createDataFrame(asks, "query_id long, vector array<double>"), spark.createDataFrame(rows, "doc_id long, vector array<double>")


def test_lists_equal_all_pairs_and_form_few(spark, pairs_formed):
    m = gathered(4000, 8, 25)
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(5000 + k, m[0].tolist()) for k in range(300)]  # a hot vector
    rows += [(7000, [0.0] * 8), (7001, [0.0] * 8), (7002, None), (7003, [1.0, None] * 4), (7004, [float("nan")] * 8), (7005, []), (7006, [1.0, 2.0]), (7007, [2.0, 1.0])]
    asks = [(k, m[k].tolist()) for k in range(0, 4000, 50)] + [(9000, [0.0] * 8), (9001, [1.0, 1.0]), (9002, [1.0, 1.0, 1.0])]
    q, d = tables(spark, rows, asks)
    got = {(r.query_id, r.rank): r.doc_id for r in retrieve.knn(q, d, k=7, part=100).collect()}
    assert got == slow(rows, asks, 7)
    assert 0 < pairs_formed.value < len(asks) * len(rows) / 3


def test_lists_equal_all_pairs_without_any_order(spark):
    """Vectors in all directions: hardly a cell can be left out, and nothing is lost."""
    m = np.random.RandomState(5).standard_normal((1500, 6))
    rows, asks = [(k, v.tolist()) for k, v in enumerate(m)], [(k, (m[k] * 3).tolist()) for k in range(0, 1500, 60)]
    q, d = tables(spark, rows, asks)
    for part in (40, 4096):
        assert {(r.query_id, r.rank): r.doc_id for r in retrieve.knn(q, d, k=5, part=part).collect()} == slow(rows, asks, 5)
    empty = retrieve.knn(q, d.limit(0), k=5)
    assert empty.count() == 0 and retrieve.knn(q.limit(0), d, k=5).count() == 0 and empty.columns == ["query_id", "doc_id", "score", "rank"]


def test_few_probes_find_nine_of_ten(spark, pairs_formed):
    m = gathered(5000, 12, 40, spread=0.3)
    rows, asks = [(k, v.tolist()) for k, v in enumerate(m)], [(k, m[k].tolist()) for k in range(0, 5000, 50)]
    q, d = tables(spark, rows, asks)
    got = {(r.query_id, r.doc_id) for r in retrieve.knn(q, d, k=10, part=200, probes=8).collect()}
    want = slow(rows, asks, 10)
    assert len(got & {(q, i) for (q, _), i in want.items()}) / len(want) >= 0.9
    assert 0 < pairs_formed.value < len(asks) * len(rows) / 2


def test_documents_shuffle_once_and_blocks_are_bounded(spark, monkeypatch):
    m = gathered(6000, 4, 12)
    rows = [(k, v.tolist()) for k, v in enumerate(m)] + [(7000 + k, m[0].tolist()) for k in range(3000)]
    q, d = tables(spark, rows, [(k, m[k].tolist()) for k in range(0, 6000, 3)])
    seen, plain = [], vector_lists.meet
    monkeypatch.setattr(vector_lists, "meet", lambda dealt, *more: seen.append(dealt) or plain(dealt, *more))
    retrieve.knn(q, d, k=3, part=250)
    docs = seen[0].filter("not asks")
    assert docs.count() == 9000 and docs.select("doc_id").distinct().count() == 9000
    assert docs.groupBy("dim", "cell", "part").count().agg(F.max("count")).first()[0] < 500
