"""Ranges of documents that follow the bytes of text."""

import hashlib

import numpy as np
from tracewright.llm import edit_fingerprint, shared


def test_ranges_follow_bytes_and_neighbours_meet_over_their_bounds(spark, monkeypatch):
    rng = np.random.RandomState(5)
    texts = ["".join(rng.choice(list("abcdé "), int(n))) for n in rng.randint(0, 400, 600)]
    texts[100] = "long " * 20_000
    rows = [(7 * k, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    keyed = docs.selectExpr(f"coalesce(doc_id, {edit_fingerprint.FIRST}) AS key", "text")
    monkeypatch.setattr(edit_fingerprint.range_bounds, "__defaults__", (4096,))
    bounds = edit_fingerprint.range_bounds(keyed)
    assert bounds[0] == edit_fingerprint.FIRST and 30 < len(bounds) < 180
    assert (bounds == edit_fingerprint.range_bounds(keyed.repartition(7))).all()
    sizes = np.zeros(len(bounds), int)
    for k, t in rows:
        sizes[np.searchsorted(bounds, k, "right") - 1] += len(t.encode()) + 256
    assert np.sort(sizes)[-2] < 12 * 4096 and sizes.max() < 100_000 + 12 * 4096
    got = {r.doc_id: (r.n_chars, r.edited_sha256) for r in edit_fingerprint.half_edits(docs).collect()}
    order = [(None, ""), *rows]
    for (k, t), (_, after) in zip(order, [*order[1:], order[0]], strict=True):
        want = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[k] == (len(t), hashlib.sha256(want.encode()).hexdigest()), k


def test_no_rows_are_one_empty_range(spark):
    empty = spark.createDataFrame([], "key long, text string")
    assert edit_fingerprint.range_bounds(empty).tolist() == [edit_fingerprint.FIRST]


def test_bands_miss_few_pairs_at_any_number_of_texts():
    for n in (2, 10**5, 10**7, 10**11):
        plan = edit_fingerprint.band_plan(n, 0.8)
        assert n / 8 ** plan.shape[1] < 1 / 8
        assert (1 - (0.8 + 0.2 / 16) ** plan.shape[1]) ** len(plan) <= 1e-4
    values = np.random.RandomState(1).randint(0, 16, (50, edit_fingerprint.SLOTS)).astype(np.uint8)
    plan = edit_fingerprint.band_plan(50, 0.8)
    keys = edit_fingerprint.band_keys(plan, np.concatenate([values, values]))
    assert (keys[:50] == keys[50:]).all() and len(np.unique(keys)) > 49 * len(plan)
    assert ((keys & np.uint64(0xFFFF)) == np.arange(len(plan), dtype=np.uint64)).all()


def test_ranges_of_hashes_are_exact_and_cost_no_more_with_more_of_them():
    rng = np.random.RandomState(3)
    keys = np.sort(np.concatenate([rng.randint(0, 2**63, 500, np.uint64) * np.uint64(2) + rng.randint(0, 2, 500, np.uint64), np.array([0, 1, 2**32 - 1, 2**32, 2**63, 2**64 - 1], np.uint64)]))
    for buckets in (1, 3, 64, 12_345, 125_001, 2**32 - 1):
        want = [int(k) * buckets >> 64 for k in keys]
        assert shared.range_of(keys, buckets).tolist() == want
        got = list(shared.touched(keys, buckets))
        assert len(got) == len(set(want)) <= len(keys)
        assert [k for k, a, b in got for _ in range(a, b)] == want and got[0][1] == 0 and got[-1][2] == len(keys)
        assert all(a[2] == b[1] for a, b in zip(got, got[1:]))
    assert list(shared.touched(np.empty(0, np.uint64), 7)) == []
