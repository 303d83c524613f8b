"""Exact dedup, clustering and lexical search, held against brute force on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import lexical_tree
from tracewright.llm.exact_dedup import exact_duplicates
from tracewright.llm.itq_links import link_vectors
from tracewright.llm.lexical_tree import climb, cut_paths, plant, rank_documents, weigh_terms
from tracewright.llm.threshold_kmeans import cluster_vectors, nearest, sorted_lists
from tracewright.llm.url_filters import judge_urls

BLANK = re.compile(r"[\x20\x09-\x0D]")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("words", [2, 1 << 18])  # a filter that lets all rows pass, and the usual one
def test_exact_duplicates(spark, words):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab c\n\té字") for _ in range(rng.randrange(0, 30))) for _ in range(40)]
    head = "h" * 64
    rows = [(k, rng.choice(base)) for k in range(120)] + [(500, None), (501, ""), (502, " \t\n"), (503, "x" * 100_000), (504, "x" * 50_000 + "\v" + "x" * 50_000), (505, "x" * 100_000)]
    rows += [(600, head + "ab"), (601, head + "ba"), (602, head + "a b"), (603, " "), (604, "  ")]  # a common beginning; other white space stays
    rows += [(7, "twice"), (7, "twice"), (None, "null id"), (None, "null id"), (8, "null id")]
    df = spark.createDataFrame([(*r, "s", 1.5, "k") for r in rows], "doc_id long, text string, size string, rid double, kept string")
    got = exact_duplicates(df, words=words).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "size", "rid", "keep_id", "group_size", "kept"}
    groups = collections.defaultdict(list)
    for k, t in rows:
        groups[BLANK.sub("", t or "")].append((-len(t or ""), k is None, k))
    for r in got:
        own = groups[BLANK.sub("", r.text or "")]
        best = min(own, key=lambda x: (x[0], x[1], x[2] or 0))
        assert (r.keep_id, r.group_size) == (best[2], len(own)) and (not r.kept or (-len(r.text or ""), r.doc_id) == (best[0], best[2]))
        assert r.size == "s" and r.rid == 1.5
    kept = collections.Counter(BLANK.sub("", r.text or "") for r in got if r.kept)
    assert kept == dict.fromkeys(groups, 1)
    assert exact_duplicates(df.limit(0)).count() == 0 and "text" not in exact_duplicates(df.limit(0), texts=False).columns


def test_one_hot_group_of_copies(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same  text' WHEN id % 3 = 1 THEN concat('own ', id) ELSE 'thesametext' END AS text")
    got = exact_duplicates(df, texts=False)
    assert got.filter("kept").count() == 1001 and got.filter("kept and group_size = 2000 and doc_id = 0 and keep_id = 0").count() == 1


def slow_means(rows, k, rounds, dims, scale=1024):
    kept = [(i, [min(max(math.floor(scale * float(np.float32(x))), -(2**28)), 2**28) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [v for _, v in named[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(cents))

    for _ in range(rounds):
        own = collections.defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        for n, vs in own.items():
            cents[n] = [sum(col) // len(vs) for col in zip(*vs, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], cents


def test_clusters_equal_slow_means(spark):
    rng = np.random.RandomState(4)
    rows = [(k, (rng.randint(-3, 4, 5) / 8 + rng.choice([0, 0.01], 5)).tolist()) for k in range(150)]
    rows += [(200 + k, rows[0][1]) for k in range(80)]  # a hot vector
    rows += [(3, rows[9][1]), (4, rows[4][1]), (None, rows[7][1]), (300, None), (301, [1.0, None, 1.0, 1.0, 1.0]), (302, [float("nan")] * 5), (303, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (304, [1.0] * 4), (305, []), (306, [3e38, -3e38, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, embedding array<float>, cells string, CLUSTER string")
    want, cents = slow_means(rows, 8, 10, 5)
    got = cluster_vectors(df, dims=5).collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.cluster, r.distance) for r in got) == sorted((i is None, i or 0, c, d) for i, c, d in want)
    assert {r.cluster: r.centroid for r in got} == {c: cents[c] for _, c, _ in want} and all(r.cells == "a" for r in got)
    assert {r.inertia for r in got} == {sum(d for *_, d in want)} and all(r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) for r in got)
    few = df.filter("vec_id in (1, 2, 300)")
    assert sorted(r.distance for r in cluster_vectors(few, dims=5).collect()) == [0, 0]
    assert cluster_vectors(df.limit(0), dims=5).count() == 0 and cluster_vectors(df.limit(0), dims=5).columns == cluster_vectors(few, dims=5).columns


@pytest.mark.parametrize("seed", range(6))
def test_walked_lists_find_the_nearest_and_stop_early(seed):
    rng = np.random.RandomState(seed)
    spread = seed % 2 == 0
    cents = rng.randint(-5000, 5000, (60, 6)) if spread else rng.randint(-2, 3, (60, 6))  # the latter tie a lot
    rows = cents[rng.randint(60, size=500)] + rng.randint(-30, 31, (500, 6)) if spread else rng.randint(-3, 4, (500, 6))
    best, far, taken = nearest(rows.astype(np.int64), sorted_lists(cents.astype(np.int64)))
    d = ((rows[:, None, :] - cents[None]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (far == d.min(1)).all()
    assert not spread or taken < d.size / 2


def slow_ranks(items, docs, k):
    terms = lambda t: [w.translate({c: c + 32 for c in range(65, 91)}) for w in TERM.findall(t or "")]
    have = [(i, collections.Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(have), sum(sum(c.values()) for _, c in have)
    df = collections.Counter(w for _, c in have for w in c)
    out = set()
    asked = collections.defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    for i, words in asked.items():
        got = []
        for d, c in have:
            m = 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in words if w in c)
            if s > 0:
                got.append((-s, d is None, d or 0))
        out |= {(i, r, None if none else d, -s) for r, (s, none, d) in enumerate(sorted(got)[:k], 1)}
    return out


def corpus(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["Été", "字字", "ÀB", "the", "The"]
    text = lambda n: "".join(rng.choice(words[: rng.choice([5, 20, 65])]) + rng.choice([" ", "-", "\x7f", "\n", "_"]) for _ in range(n))
    docs = [(k, text(rng.randrange(0, 60))) for k in range(400)]
    docs += [(1000 + k, docs[3][1]) for k in range(70)] + [(2000 + k, docs[5][1] + " extra") for k in range(30)]
    docs += [(3000, None), (3001, ""), (3002, "..."), (None, docs[9][1]), (3003, docs[9][1]), (5, docs[5][1]), (3004, "w1 " * 30_000)]
    items = [(k, text(rng.randrange(1, 12))) for k in range(30)] + [(50, None), (51, ""), (52, "absent"), (53, docs[3][1]), (1, "w9 w9"), (None, "w3 the")]
    return items, docs


@pytest.mark.parametrize(("pairs", "seeds", "held"), [(1 << 18, 1 << 20, 1 << 21), (40, 1, 300)])
def test_ranks_equal_brute_force(spark, monkeypatch, pairs, seeds, held):
    monkeypatch.setattr(lexical_tree, "POSTINGS", held)  # many small trees in a task
    items, docs = corpus()
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id int, text string, rank string")
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, score string").repartition(3)
    got = rank_documents(i, d, 50, pairs, seeds).collect()
    assert {tuple(r) for r in got} == slow_ranks(items, docs, 50) and len(got) == len({(r.item_id, r.rank) for r in got})
    for a, b in ((i.limit(0), d), (i, d.limit(0)), (i, d.filter("doc_id = 3000"))):
        empty = rank_documents(a, b)
        assert empty.count() == 0 and empty.columns == ["item_id", "rank", "doc_id", "score"]


def test_bounds_spare_leaves(monkeypatch):
    """The best of an item are those of a full scan, and most leaves are never scored."""
    rng = np.random.RandomState(7)
    n_docs, n_terms, k = 6000, 300, 10
    chance = 1 / np.arange(2, n_terms + 2)
    held = rng.rand(n_docs, n_terms) < chance
    held[:, 0] = True
    held[:1500] = held[0]  # copies
    doc, rank = np.nonzero(held)
    tf = rng.randint(1, 6, len(doc))
    tf[doc < 1500] = np.tile(tf[doc == 0], 1500)
    size, n = held.sum(1), np.maximum(held.sum(1) * 3, 1)
    w = weigh_terms(held.sum(0).astype(np.int64), n_docs, int(n.sum()))
    tree, names = plant(pa.array(np.arange(n_docs)), n, size, w.rank[rank], tf, w)
    whole, lent = np.zeros((n_docs, n_terms), np.int64), np.zeros(n_terms, np.int64)
    m = 50 + 50 * n * n_docs // n.sum()
    whole[doc, w.rank[rank]] = 10**9 * tf // (1000 * tf + 20 * m[doc])
    for terms in (np.array([0, 150, 290]), np.array([200, 210, 280]), np.array([0]), np.arange(0, 300, 17)):
        docs, scores, looked = climb(tree, terms, w, lent, k, 0)
        s = (whole[:, terms] * w.weight[terms]).sum(1)
        best = [d for d in np.lexsort((np.arange(n_docs), -s))[:k] if s[d] > 0]
        assert sorted(zip(scores, np.asarray(names)[docs], strict=True)) == sorted(zip(s[best], best, strict=True)) and not lent.any()
        assert len(terms) > 3 or looked < (len(tree.leaf) - 1) / 2


def test_runs_are_cut_into_a_shallow_tree():
    for common in (np.zeros(1000, int), np.full(1000, 7), np.arange(1000) % 50, np.concatenate([[0], np.arange(999)])):
        first, children = cut_paths(common, 16)
        ends = np.append(first, len(common))
        assert first[0] == 0 and (np.diff(ends) > 0).all() and (np.diff(ends) <= 16).all()
        depth = {}
        for k, own in enumerate(children, len(first)):
            depth[k] = 1 + max(depth.get(c, 0) for c in own)
        assert sorted(c for own in children for c in own) == list(range(len(first) + len(children) - 1)) and max(depth.values()) <= 8


def test_an_id_with_several_vectors_links_by_each(spark):
    a, b, c = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.1, 0.0], [0.0, 0.0, 1.0, 0.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(5, a, "x"), (5, b, "x"), (7, near(a), "x"), (9, near(b), "x"), (3, a, "x"), (5, a, "x"), (11, c, "x"), (11, c, "y"), (12, near(c), "y"), (13, near(c), "z"), (11, b, "w")]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")).collect()}
    assert got == {3: (2, 3, True), 5: (3, 3, False), 7: (2, 3, False), 9: (1, 3, False), 11: (1, 11, True), 12: (1, 11, False), 13: (0, 13, True)}


def test_a_host_of_many_labels_is_cheap(spark):
    rules = spark.createDataFrame([("net/", "block"), ("a.b.c.net/x", "allow"), ("net./", "block")], "rule string, action string")
    long_ = "a." * 40_000 + "b.c.net"
    urls = [(1, f"http://{long_}/x"), (2, f"http://{long_}/y"), (3, "http://net./"), (4, "http://b.c.net/x"), (5, "http://a.b.c.net/x"), (6, "http://.net/"), (7, "http://cnet/")]
    got = {r.page_id: (r.rule, r.verdict) for r in judge_urls(spark.createDataFrame(urls, "page_id long, url string"), rules).collect()}
    assert got == {1: ("a.b.c.net/x", "allow"), 2: ("net/", "block"), 3: ("net./", "block"), 4: ("net/", "block"), 5: ("a.b.c.net/x", "allow"), 6: ("net/", "block"), 7: (None, "allow")}
