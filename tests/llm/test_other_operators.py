"""URL filters, embeddings, toxicity, WARC, mixing, the pipeline and the registry."""

import base64
import gzip
import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tracewright.llm import queries, toxicity, warc
from tracewright.llm.itq_links import at_floor, fit_itq, link_vectors, recall
from tracewright.llm.mixing import apportion, mix_sources, source_targets
from tracewright.llm.url_filters import judge_urls


def test_urls(spark):
    rules = spark.sql(f"SELECT * FROM {queries.RULES} AS t(rule, action)")
    cases = {
        "http://a.example.net/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://EXAMPLE.NET/de": ("example.net", "/de", "net/", "block"),
        "http://example.net": ("example.net", "", None, "allow"), "x": ("", "", None, "allow"), None: ("", "", None, "allow"), "http://badexample.com/de/": ("badexample.com", "/de/", None, "allow"),
        "http://m.example.com/de/": ("m.example.com", "/de/", "example.com/de/", "block"), "http://q.org/fr/a": ("q.org", "/fr/a", "org/fr/", "allow"), "": ("", "", None, "allow"),
        "a\nb://c.net/\nd": ("c.net", "/\nd", "net/", "block"), "http://net/": ("net", "/", "net/", "block"), "http://x.NET?/en/": ("x.net", "", None, "allow"), "http://" + "a." * 500 + "net/" + "p" * 5000: ("a." * 500 + "net", "/" + "p" * 5000, "net/", "block"),
    }
    pages = spark.createDataFrame([(k % 5, u, "h") for k, u in enumerate(cases)] + [(0, None, "h")], "page_id long, url string, host string")
    got = judge_urls(pages, rules).collect()
    assert len(got) == len(cases) + 1
    assert all((r.host, r.path, r.rule, r.verdict) == cases[r.url] for r in got)
    assert judge_urls(pages, rules.limit(0)).filter("verdict = 'block'").count() == 0
    assert judge_urls(pages.limit(0), rules).count() == 0
    odd = spark.createDataFrame([("a.net/e", "allow"), ("a.net/", "block"), (None, "block"), ("/x", "block"), ("a.net/e", "block")], "rule string, action string")
    assert judge_urls(spark.createDataFrame([(1, "h://a.net/en")], "page_id long, url string"), odd).first().verdict == "block"


def vectors(n=400, seed=1):
    rng = np.random.RandomState(seed)
    base = rng.standard_normal((40, 16))
    out = []
    for k in range(n):
        v = base[rng.randint(40)] + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.05, 0.2])
        out.append((k, v.tolist(), int(rng.randint(3)) if k % 50 else None))
    same = base[0].tolist()
    out += [(n + k, same, 1) for k in range(60)]
    return [*out, (900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0] * 3, 1), (None, same, 1)]


def test_vector_links_equal_brute_force(spark):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = [(k, np.array(np.array(v, np.float32), np.float64), y) for k, v, y in rows if k is not None and y is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {k: set() for k, *_ in rows if k is not None}
    for k, v, y in good:
        for j, w, z in good:
            if k != j and y == z and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[k].add(j)
    least = {}
    for k in links:
        seen, todo = {k}, [k]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least[k] = min(seen)
    got = {r.vec_id: r for r in link_vectors(df).collect() if r.vec_id is not None}
    found = sum(got[k].n_links for k in links)
    assert found <= sum(map(len, links.values())) and found >= 0.98 * sum(map(len, links.values()))
    assert np.mean([got[k].component_id == least[k] for k in links]) > 0.97
    assert all(got[k].n_links == 0 for k in range(900, 905))
    assert link_vectors(df.limit(0)).count() == 0


def test_vectors_of_each_length_link_among_themselves(spark):
    rows = [(k, [float(k % 7 == j) + 0.5 for j in range(8)], 1) for k in range(300)]
    long = [(1000 + k, [1.0] * 9, 1) for k in range(2)]
    got = {r.vec_id: r for r in link_vectors(spark.createDataFrame([*rows, *long], "vec_id long, embedding array<float>, label int")).collect()}
    assert all(got[k].n_links == sum(j % 7 == k % 7 for j in range(300)) - 1 and got[k].component_id == k % 7 for k in range(300))
    assert all(r.n_links == 1 and r.component_id == 1000 for k, r in got.items() if k >= 1000)


def cone(n, dim, mean_cosine, rng):
    """Unit vectors whose cosine with one direction is about the root of ``mean_cosine``."""
    v = rng.standard_normal((n, dim)) * np.sqrt((1 - mean_cosine) / dim)
    v[:, 0] += np.sqrt(mean_cosine)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_tables_find_links_on_and_off_centre():
    rng = np.random.RandomState(6)
    for mean_cosine in (0.0, 0.5, 0.8, 0.9, 0.97):
        codes = fit_itq(cone(6000, 64, mean_cosine, rng), 14, 0.98)
        fresh = cone(3000, 64, mean_cosine, rng)
        assert recall(codes, fresh, at_floor(fresh, 0.98, 9)) >= 0.99, mean_cosine
    assert fit_itq(np.zeros((0, 4)), 8, 0.98).width == 0


def test_links_off_centre_equal_brute_force(spark):
    rng = np.random.RandomState(7)
    base = cone(300, 16, 0.9, rng)
    v = np.concatenate([base, at_floor(base, 0.981, 1), at_floor(base, 0.985, 2)]).astype(np.float32)
    label = np.tile(np.arange(300) % 4, 3)
    rows = [(k, x.tolist(), int(y)) for k, (x, y) in enumerate(zip(v, label, strict=True))]
    u = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = {r.vec_id: r.n_links for r in link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    found = sum(got.values())
    assert near.sum() >= found >= 0.99 * near.sum() and all(got[k] <= near[k].sum() for k in got)


def toxic_rows(n=900, seed=3):
    rng = random.Random(seed)
    words, bad = [f"w{k}" for k in range(400)], ["nasty", "vile", "grim"]
    rows = []
    for k in range(n):
        ws = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        if k % 8 == 0:
            for _ in range(2):
                ws[rng.randrange(len(ws))] = rng.choice(bad)
        rows.append((k, " ".join(ws), int(k % 8 == 0)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows()
    docs = spark.createDataFrame([(k, t, 1.5) for k, t, _ in rows] + [(5000, None, 0.0), (5001, "", 0.0), (None, "nasty", 0.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows if k % 2 == 0] + [(None, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(docs, model).collect()}
    held = [(got[k], y) for k, _, y in rows if __import__("zlib").crc32(str(k).encode()) % 3 == 1]
    hit = [s >= 0.7 for s, y in held if y]
    false = [s >= 0.7 for s, y in held if not y]
    assert np.mean(hit) > 0.8 and np.mean(false) < 0.02
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[5000] == got[5001]
    assert toxicity.train(docs, labels.limit(0)) is None
    assert toxicity.score_toxicity(docs, None).agg({"score": "max"}).first()[0] == 0


def test_risk_equals_a_slow_version():
    rng = np.random.RandomState(2)
    for prior, shift in ((0.1, 0.0), (0.6, 0.0), (0.8, -4.0)):
        p, u = rng.standard_normal(7) * 2 + 1, rng.standard_normal(11) + shift
        loss = lambda z: np.log(1 + np.exp(-z))
        on_positive, on_negative = toxicity.risk(p, u, prior)
        assert on_positive == pytest.approx(prior * sum(loss(z) for z in p) / 7)
        assert on_negative == pytest.approx(sum(loss(-z) for z in u) / 11 - prior * sum(loss(-z) for z in p) / 7)
        whole = lambda x: sum(toxicity.risk(x[:7], x[7:], prior)) if on_negative >= 0 else -toxicity.risk(x[:7], x[7:], prior)[1]
        x = np.concatenate([p, u])
        slow = [(whole(x + 1e-6 * e) - whole(x - 1e-6 * e)) / 2e-6 for e in np.eye(18)]
        assert toxicity.pull(p, u, prior) == pytest.approx(slow, abs=1e-7)
    assert toxicity.risk(np.ones(3), np.full(3, -9.0), 0.8)[1] < 0  # the bracket that the method cuts off


def test_scale_fits_chances():
    """Values of two overlapping classes: chances from the scale are those that the counts show."""
    rng = np.random.RandomState(4)
    toxic, clean, prior = rng.standard_normal(4000) + 2, rng.standard_normal(36000) - 2, 0.1
    unlabelled = np.concatenate([toxic[:2000], clean[:18000]])
    slope, shift = toxicity.scale(3 * toxic[2000:] + 1, 3 * unlabelled + 1, prior)
    raw = 3 * np.concatenate([toxic, clean]) + 1
    chance = toxicity.Model(np.empty(0), np.empty(0), 0.0, prior, slope, shift).score(raw)
    for low in (0.2, 0.5, 0.7):
        at = (chance >= low) & (chance < low + 0.2)
        assert np.mean(np.arange(40000)[at] < 4000) == pytest.approx(low + 0.1, abs=0.12)


def pages(spark):
    rows = [(1, "u", "aa"), (2, "u\r\nX: y", "aa"), (3, None, None), (4, "u", ""), (5, "u", "b" * 100_000 + "é"), (6, "u", "\r\n\r\nWARC/1.1\r\n"), (2, "u", "aa"), (None, "n", "aa"), (7, "u", "zz")]
    return spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, kind string"), rows


def test_archive_round_trip(spark):
    df, rows = pages(spark)
    got = warc.archive_round_trip(df).collect()
    assert len(got) == len(rows) and not [r for r in got if r.kind == "gap"]
    best = {}
    for k, _, h in rows:
        if k is not None:
            best[h or ""] = max(best.get(h or "", k), k)
    want = []
    for k, _, h in rows:
        raw = (h or "").encode()
        refers = best[h or ""] if k is not None and best[h or ""] != k else None
        want.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if refers is None else "revisit", refers))
    assert sorted(map(str, want)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.kind, r.refers_to)) for r in got)
    assert {r.kind for r in warc.archive_round_trip(df, min_bytes=10**9).collect()} == {"response"}
    assert warc.archive_round_trip(df.limit(0)).count() == 0


def test_salvage_recovers_later_records():
    made = [warc.record(k, "u", f"payload {k}".encode() * 50, None, warc.base32_sha1(f"payload {k}".encode() * 50), "d") for k in range(6)]
    broken = bytearray(made[1])
    broken[len(broken) // 2] ^= 0xFF
    raw = b"".join([made[0], bytes(broken), made[2], b"junk", made[3], made[4][:-9], made[5]])
    parts = list(warc.salvage(raw))
    ids = [warc.RECORD.search(h[b"warc-record-id"])[1] for *_, records in parts for h, _ in records]
    assert ids == [b"0", b"2", b"3", b"5"]
    assert sum(n for _, n, *_ in parts) == len(raw)
    gaps = [(a, n) for a, n, _, records in parts if not records]
    assert gaps == [(len(made[0]), len(broken)), (len(made[0]) + len(broken) + len(made[2]), 4), (len(raw) - len(made[5]) - len(made[4]) + 9, len(made[4]) - 9)]
    plain = gzip.decompress(made[0]) + b"WARC/1.1\r\nbad" + gzip.decompress(made[2])
    assert [len(r) for *_, r in warc.salvage(plain)] == [1, 0, 1]
    # one member with many records: a bad one, bytes that can't be inflated, a cut end
    inner = [gzip.decompress(m) for m in made]
    bad = inner[1].replace(b"payload 1", b"payload x", 1)
    id_of = lambda got: [warc.RECORD.search(h[b"warc-record-id"])[1] for h, _ in got]
    whole = gzip.compress(b"".join([inner[0], bad, inner[2]])) + made[3]
    assert [(r, id_of(got)) for _, _, r, got in warc.salvage(whole)] == [("block digest differs", [b"0", b"2"]), ("", [b"3"])]
    rng = random.Random(1)
    noise = [gzip.decompress(warc.record(k, "u", rng.randbytes(40_000), None, "x", "d")) for k in range(6)]
    one = gzip.compress(b"".join(noise))
    hit = bytearray(one)
    hit[len(one) // 2] ^= 0xFF
    for raw in (bytes(hit), one[: len(one) // 2 + 9]):
        got = list(warc.salvage(raw + made[3]))
        assert id_of(got[0][3])[:2] == [b"0", b"1"] and got[0][2] and id_of(got[-1][3]) == [b"3"]
        assert sum(n for _, n, *_ in got) == len(raw) + len(made[3])
    assert list(warc.salvage(b"")) == [] and [r for *_, r in warc.salvage(b"nothing here")] == [[]]


def test_mixing_targets_and_quotas(spark):
    rng = random.Random(5)
    rows = [(k, " ".join("x" * rng.randrange(1, 5) for _ in range(rng.randrange(0, 200))), rng.choice(["a", "b", "c", "d", "e", None, "é"]) if k % 3 else "a") for k in range(1500)]
    rows += [(5000, None, "z"), (5001, "", "z"), (1, "x y", "b"), (1, "x y", "b"), (None, "p q", None)]
    df = spark.createDataFrame([(*r, 9) for r in rows], "doc_id long, text string, source string, size int")
    got = mix_sources(df).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    target, open_, left = {}, {s for s in sizes if sizes[s]}, sum(sizes.values())
    while True:
        rate = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if rate * weight[s] > 3 * sizes[s]]
        if not over:
            target |= {s: rate * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    taken = {}
    for r in got:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 3 * r.size
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target.get(r.source, 0.0))
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= 0.01 * t + 64, s
    again = {(r.doc_id, r.text, r.taken) for r in mix_sources(df.repartition(7)).collect()}
    assert again == {(r.doc_id, r.text, r.taken) for r in got}
    assert mix_sources(df.limit(0)).count() == 0
    one = source_targets(spark.createDataFrame([("a", 10), ("b", 0)], "source string, source_size long")).collect()
    assert {r.source: r.target for r in one} == {"a": 10.0, "b": 0.0}


def test_pipeline_stages(spark, tmp_path):
    rows = toxic_rows(900)
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t)) for k, t, _ in rows] + [(2000, rows[1][1], "en", "s1", 5), (2001, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, at, str(tmp_path))
        if k < 4:
            assert after.schema == at.schema
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        if k == 0:
            assert 2001 in ids and len(ids & {k for k, _, y in rows if y}) < 8 and len(ids) > 770
        if k == 1:
            assert 2000 not in ids and 1 in ids
        if k == 3:
            assert 2001 not in ids
        at = after
    assert at.filter("n_tokens > 0").count() == at.count() > 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == at.count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    tables = Path("/root/testdata/sf0.001")
    if not tables.is_dir():
        pytest.skip("no tables")
    c = duckdb.connect()
    for f in tables.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = c.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    at = [[d[0] for d in want.description].index(x) for x in columns]
    expected = sorted(str([r[k] for k in at]) for r in want.fetchall())
    assert sorted(str([r[x] for x in columns]) for r in queries.QUERIES[name](spark, str(tables)).collect()) == expected and expected


def test_seats_are_those_of_the_highest_quotients(spark):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(12):
        m, seats = rng.randrange(1, 9), rng.choice([0, 1, 2, 7, 40, 1000])
        weights = [rng.choice([0.0, 1.0, 1.0, 2.5, rng.random() * 100]) for _ in range(m)]
        bids = sorted((-w / (2 * k + 1), i, k) for i, w in enumerate(weights) if w for k in range(seats))[:seats]
        for i, w in enumerate(weights):
            rows.append((g, i, w, seats))
            if w:
                want[g, i] = sum(j == i for _, j, _ in bids)
    got = apportion(spark.createDataFrame(rows, "g int, i int, w double, seats long"), ["g"], ["i"], "w", "seats").collect()
    assert {(r.g, r.i): r.won for r in got} == want
