"""Pruned lexical search against scores of all documents."""

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.operators import retrieve, word_search

WORDS = re.compile(r"\w+")


def slow(queries, docs, fields, k):
    """docs: (id, {field: text})"""
    out, held = {}, {f: {i: WORDS.findall((t.get(f) or "").lower()) for i, t in docs} for f, _ in fields}
    for q, text in queries:
        best = {}
        for f, boost in fields:
            own = {i: collections.Counter(ws) for i, ws in held[f].items() if ws}
            if not own:
                continue
            mean = sum(sum(c.values()) for c in own.values()) / len(own)
            for w in set(WORDS.findall((text or "").lower())):
                df = sum(w in c for c in own.values())
                idf = math.log(1 + (len(own) - df + 0.5) / (df + 0.5))
                for i, c in own.items():
                    if w in c:
                        n = sum(c.values())
                        best.setdefault(i, {}).setdefault(f, []).append(boost * idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * n / mean)))
        ranked = sorted((-round(max(sum(x) for x in per.values()), 9), i) for i, per in best.items())
        out |= {(q, r): (i, round(-s, 6)) for r, (s, i) in enumerate(ranked[:k], 1)}
    return out


def corpus(n=700, seed=2):
    rng = random.Random(seed)
    rare = [f"r{k}" for k in range(150)]
    text = lambda m: " ".join(["the"] + [rng.choice(rare) if rng.random() < 0.4 else rng.choice(["of", "and", "a", "code"]) for _ in range(m)])
    docs = [(k, {"raw_text": text(rng.randrange(1, 40)), "summary": text(rng.randrange(0, 6))}) for k in range(n)]
    docs += [(n + k, dict(docs[5][1])) for k in range(60)] + [(2000, {"raw_text": None, "summary": ""}), (2001, {"raw_text": "the", "summary": None})]
    queries = [(k, f"the {rng.choice(rare)} of {rng.choice(rare)}, and THE {rng.choice(rare)}?") for k in range(25)]
    return [*queries, (50, "the"), (51, "the and of a"), (52, None), (53, "absent"), (54, "absent r1")], docs


def tables(spark, queries, docs):
    return spark.createDataFrame(queries, "query_id long, text string"), spark.createDataFrame([(i, t["raw_text"], t["summary"]) for i, t in docs], "doc_id long, raw_text string, summary string")


@pytest.mark.parametrize(("k", "block"), [(5, 1024), (5, 16), (40, 16), (10_000, 1024)])
def test_ranks_equal_those_over_all_documents(spark, k, block):
    queries, docs = corpus()
    fields = (("raw_text", 1.0), ("summary", 2.0))
    q, d = tables(spark, queries, docs)
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in word_search.best_words(q, d, fields, k, block=block).collect()}
    want = slow(queries, docs, fields, k)
    assert {x: i for x, (i, _) in got.items()} == {x: i for x, (i, _) in want.items()} and all(abs(s - want[x][1]) < 1e-5 for x, (_, s) in got.items())
    assert retrieve.bm25(q.limit(0), d, fields).count() == 0 and retrieve.bm25(q, d.limit(0), fields).count() == 0


def test_a_word_that_all_documents_hold_scores_few(spark):
    n = 20_000
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("the common words of text r"), F.col("id") % 400, F.lit(" s"), F.col("id") % 37).alias("raw_text"))
    queries = spark.range(40).select(F.col("id").alias("query_id"), F.concat(F.lit("the common words of r"), F.col("id") * 7, F.lit(" s"), F.col("id") % 37).alias("text"))
    asked = queries.select("query_id", F.explode(F.array_distinct(word_search.tokens(F.col("text")))).alias("token"))
    posts = word_search.weighted_postings(asked.select("token").distinct(), docs, (("raw_text", 1.0),))
    terms = word_search.split_terms(asked, posts, 10)
    scored, unpruned = word_search.scored_postings(terms, posts).count(), asked.join(posts, "token").count()
    assert unpruned > 40 * n * 4 and scored < unpruned / 20
    assert terms.filter("token in ('the', 'common', 'words', 'of') and essential").count() == 0


def test_sums_of_a_block_leave_what_can_reach_its_ranks(monkeypatch):
    monkeypatch.setattr(word_search, "SLICE", 300)  # queries then fall into several parts
    rng = random.Random(5)
    rows = sorted({(f"t{rng.randrange(12)}", rng.randrange(40)) for _ in range(250)})
    weight = {r: rng.randrange(1, 60) / 16 for r in rows}
    p = word_search.by_token(pa.array([t for t, _ in rows]), pa.array([d * 10 for _, d in rows]), np.array([weight[r] for r in rows]))
    lists = [[f"t{x}" for x in rng.sample(range(15), rng.randrange(0, 6))] for _ in range(30)] + [["t14"], []]
    floor, rest = np.array([rng.choice([-math.inf, 2.0, 6.0]) for _ in lists]), np.array([rng.choice([0.0, 1.0]) for _ in lists])
    got = {(int(i), p.docs[int(j)].as_py()): s for part in word_search.reaching(p, pa.array(lists, pa.list_(pa.string())), floor, rest, 4) for i, j, s in zip(*part, strict=True)}
    want = {}
    for q, tokens in enumerate(lists):
        total = {}
        for t, d in rows:
            if t in tokens:
                total[d] = total.get(d, 0) + weight[t, d]
        ranked = sorted(total.values(), reverse=True)
        least = max(floor[q], ranked[3] if len(ranked) >= 4 else -math.inf)
        want |= {(q, d * 10): s for d, s in total.items() if s + rest[q] >= least}
    assert got == want and 30 < len(want) < 400
