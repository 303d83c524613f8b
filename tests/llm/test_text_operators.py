"""Operators on texts, held against brute force on small tables with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tracewright.llm import edit_fingerprint, kneser_ney, sentencepiece_bpe, shared, weighted_minhash
from tracewright.llm.edit_fingerprint import fingerprint_texts, half_edits, similar_texts
from tracewright.llm.kneser_ney import perplexity
from tracewright.llm.mixing import mix_sources
from tracewright.llm.sentencepiece_bpe import encode_pieces
from tracewright.llm.substring_dedup import cut_repeats
from tracewright.llm.weighted_minhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, kept string, target string"


def texts(n=60, seed=0):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    passage = [rng.choice(words) for _ in range(20)]
    out = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(n)]
    for k in range(0, n, 7):
        out[k] = f"{out[k]}\n{' '.join(passage)}\t{out[(k * 3) % n][:200]}"
    return [*out, out[5], out[5], "", None, "  \t", "one", "é ñ 字 \u00a0x", out[8], " ".join(passage * 40)]


def table(spark, rows, extra=True):
    data = [(k, t, None if k % 2 else "en", "x", "y") for k, t in enumerate(rows)]
    if extra:
        data += [(None, rows[0], None, None, None), (3, rows[3], None, None, None)]
    return spark.createDataFrame(data, SCHEMA)


def test_words_are_those_of_the_pattern():
    rows = [t or "" for t in texts()]
    data, offsets = shared.buffers(pa.array(rows))
    starts, ends, doc = shared.word_spans(data, offsets)
    raw = data.tobytes()
    got = [(d, raw[a:b].decode()) for a, b, d in zip(starts, ends, doc, strict=True)]
    assert got == [(k, w) for k, t in enumerate(rows) for w in WORD.findall(t)]
    h = shared.hash_spans(data, starts, ends)
    assert len(set(h.tolist())) == len({w for _, w in got})
    assert len(set(zip(h.tolist(), (w for _, w in got), strict=True))) == len(set(h.tolist()))


def test_long_spans_hash_alike_wherever_they_stand():
    word = b"ab" * 700_000
    data = np.frombuffer(word + b" x " + word, np.uint8)
    starts, ends, _ = shared.word_spans(data, np.array([0, len(data)]))
    h = shared.hash_spans(data, starts, ends)
    assert h[0] == h[2] != h[1]


def cut_by_hand(rows, size=13):
    least = {}
    for k, ws in rows:
        for i in range(len(ws) - size + 1):
            w = tuple(ws[i : i + size])
            least[w] = min(least.get(w, k), k)
    out = []
    for k, ws in rows:
        gone = {i + j for i in range(len(ws) - size + 1) if least[tuple(ws[i : i + size])] < k for j in range(size)}
        out.append((k, len(ws), len(gone), hashlib.sha256(" ".join(w for i, w in enumerate(ws) if i not in gone).encode()).hexdigest()))
    return out


def test_repeats_are_cut_as_by_hand(spark):
    df = table(spark, texts())
    got = cut_repeats(df).collect()
    want = cut_by_hand([(k, WORD.findall(t or "")) for k, t in [*enumerate(texts()), (3, texts()[3])]])
    assert sorted((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got if r.doc_id is not None) == sorted(want)
    assert all(sum(s.past - s.first for s in r.removed) == r.n_removed for r in got)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert cut_repeats(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def model():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library(spark, model):
    processor = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)
    rng = random.Random(2)
    odd = ["".join(rng.choice("ab eé ▁\n\t字ñ😀ß.,1aaaa   \u0000Ω") for _ in range(rng.randrange(50))) for _ in range(200)]
    rows = [*texts(), *odd, " ", "   ", "a" * 500, "<s></s><0x0A><unk>", "abcabc" * 50, "▁▁ x", "th" * 1500, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(6000)), "".join(rng.choice("ethaonr") for _ in range(3000)), "ааа" * 100, "é߀😀\U00020000" * 30]
    got = {(r.doc_id, r.text): r for r in encode_pieces(table(spark, rows, False), model).collect()}
    for k, t in enumerate(rows):
        want = processor.encode(t or "")
        assert got[k, t].ids == want, t
        assert got[k, t].decoded == processor.decode(want)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        sentencepiece_bpe.load_model(b"")


def kneser_ney_by_hand(rows):
    """Probabilities from the formulas, with dictionaries."""
    train = [[*ws, None] for k, ws in rows if k is None or zlib.crc32(str(k).encode()) % 5 != 1]
    c1 = collections.Counter(w for ws in train for w in ws)
    pairs = collections.Counter(p for ws in train for p in zip([0, *ws[:-1]], ws, strict=True))

    def discounts(counts):
        n = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [1 - 2 * y * n[1] / n[0] if n[0] else 0.5, 2 - 3 * y * n[2] / n[1] if n[1] else None, 3 - 4 * y * n[3] / n[2] if n[2] else None]
        d[1] = d[0] if d[1] is None else d[1]
        d[2] = d[1] if d[2] is None else d[2]
        return [0, *np.clip(d, 0.05, [0.95, 1.9, 2.85])]

    left = collections.Counter(w for _, w in pairs)
    d, e = discounts(pairs.values()), discounts(left.values())
    total = sum(left.values())
    gamma = sum(e[min(c, 3)] for c in left.values()) / total if total else 1.0
    low = lambda w: ((left[w] - e[min(left[w], 3)]) / total if left[w] else 0.0) + gamma / (len(c1) + 1)
    tot, back = collections.Counter(), collections.Counter()
    for (v, _), c in pairs.items():
        tot[v] += c
        back[v] += d[min(c, 3)]
    n = sum(c1.values())
    out = []
    for k, ws in rows:
        ts = [*ws, None]
        base = sum(math.log10((c1[w] + 0.5) / (n + 0.5 * (len(c1) + 1))) for w in ts)
        score = 0.0
        for v, w in zip([0, *ts[:-1]], ts, strict=True):
            c = pairs[v, w]
            high = (c - d[min(c, 3)]) / tot[v] if c else 0.0
            score += math.log10(high + (back[v] / tot[v] if tot[v] else 1.0) * low(w))
        out.append((k, len(ts), sum(c1[w] > 0 for w in ts), n, base, score))
    return out


def test_language_model_equals_the_formulas(spark):
    rows = [(k, [w.lower() for w in WORD.findall(t or "")]) for k, t in enumerate(texts())]
    got = {r.doc_id: r for r in perplexity(table(spark, texts(), False)).collect()}
    for k, n, known, train, base, score in kneser_ney_by_hand(rows):
        r = got[k]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert r.base_score == pytest.approx(base, abs=1e-6) and r.score == pytest.approx(score, abs=1e-6)
        assert r.held_out == (zlib.crc32(str(k).encode()) % 5 == 1)


def test_language_model_without_training_rows(spark):
    df = spark.createDataFrame([(k, "a b") for k in range(30) if zlib.crc32(str(k).encode()) % 5 == 1], "doc_id long, text string")
    rows = perplexity(df).collect()
    assert rows and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in rows)
    assert perplexity(df.limit(0)).count() == 0


def test_lost_arrays_of_a_model_are_an_error(spark):
    df = table(spark, texts(), False).select("doc_id", "text")
    model = kneser_ney.train(df)
    assert model.written and kneser_ney.score_texts(df, model).count() == df.count()
    folder = Path(shared.local_path(model.path))
    for f in folder.glob("pairs-*"):
        f.unlink()
    shared.mapped.cache_clear()
    with pytest.raises(FileNotFoundError):
        kneser_ney.score_batch(model, pa.array([t for t in texts() if t]))


def test_half_edits(spark):
    rows = texts()
    got = {r.doc_id: r for r in half_edits(table(spark, rows, False)).collect()}
    for k, t in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)] or ""
        want = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(want.encode()).hexdigest()), k
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == want:
            assert r.near_edited == 1
    long = [k for k, t in enumerate(rows) if len(t or "") > 300 and len(rows[(k + 1) % len(rows)] or "") > 300]
    assert np.mean([got[k].near_edited for k in long]) > np.mean([got[k].near_next for k in long]) + 0.2
    plain = {r.doc_id: r.fingerprint for r in fingerprint_texts(table(spark, rows, False)).collect()}
    assert all(plain[k] == got[k].fingerprint for k in plain)
    one = half_edits(table(spark, ["abcd"], False)).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abab").hexdigest()
    assert half_edits(table(spark, ["a"], False).limit(0)).count() == 0


def test_small_edits_stay_near(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(800)) for _ in range(12)]
    edited = [t[:400] + "xy" + t[400:-1] for t in base]
    found = {r.doc_id: r.class_id for r in similar_texts(table(spark, base + edited, False), floor=0.7).collect()}
    assert sum(found[k + 12] == k for k in range(12)) >= 10
    assert all(c in (k, k - 12) for k, c in found.items())


def test_walk_equals_a_slow_walk():
    rng = random.Random(11)
    texts_ = ["".join(rng.choice("ab é字") for _ in range(n)) for n in (0, 1, 2, 5, 40, 300)]
    bits, _, _, value = edit_fingerprint._random(1)
    got = edit_fingerprint.walk(texts_)
    for t, row in zip(texts_, got, strict=True):
        code = [max(1, (ord(c) * 2654435761 % 2**32) >> 24) for c in t]
        seen, at = [], 0
        for step in range(2 * len(t)):
            seen.append(code[at] if at < len(t) else 0)
            at += int(bits[step % edit_fingerprint.PERIOD, code[at]]) if at < len(t) else 0
        places = edit_fingerprint.sampled_places(np.array([2 * len(t)]), 1)[0]
        assert row.tolist() == [int(value[k, seen[p] if seen else 0]) for k, p in enumerate(places)], t


def test_classes_of_fingerprints_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(edit_fingerprint, "MEET", 4)  # buckets of several blocks
    rng = np.random.RandomState(3)
    base = rng.randint(0, 16, (30, 256)).astype(np.uint8)
    rows = []
    for k in range(200):
        v = base[k % 30 if k % 3 else 0].copy()
        at = rng.permutation(256)[: rng.randint(0, 70)]
        v[at] = rng.randint(0, 16, len(at))
        rows.append(v)
    rows += [rows[5]] * 20
    values = np.array(rows)
    near = np.stack([edit_fingerprint.likeness(values, v[None, :]) >= 0.8 for v in values])
    label = np.arange(len(rows))
    while (label != (new := np.array([label[n].min() for n in near]))).any():
        label = new
    data = [(k, t) for k, t in enumerate(edit_fingerprint.to_hex(values))]
    got = {r.doc_id: r.class_id for r in edit_fingerprint.similar_prints(spark.createDataFrame([*data, (None, data[0][1])], "doc_id long, fingerprint string")).collect()}
    assert [got[k] for k in range(len(rows))] == label.tolist() and len(got) == len(rows)
    assert edit_fingerprint.similar_prints(spark.createDataFrame([], "doc_id long, fingerprint string")).count() == 0


def jaccard_by_hand(rows, size=5):
    sets = {}
    for k, t in rows:
        ws = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        ws = WORD.findall(ws)
        sets[k] = collections.Counter(tuple(ws[i : i + size]) for i in range(len(ws) - size + 1)) if len(ws) >= size else collections.Counter([tuple(ws)] if ws else [])
    df = collections.Counter(s for c in sets.values() for s in c)
    n = sum(bool(c) for c in sets.values())
    weigh = lambda s: math.log((1 + n) / (1 + df[s])) + 1

    def similar(a, b):
        least = sum(min(sets[a][s], sets[b][s]) * weigh(s) for s in sets[a] if s in sets[b])
        whole = sum(c * weigh(s) for x in (a, b) for s, c in sets[x].items()) - least
        return least / whole if whole else 0.0

    return sets, similar


def near_rows():
    rng = random.Random(9)
    words = [f"v{k}" for k in range(4000)]
    rows = []
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 400))]
        rows.append(" ".join(base))
        for _ in range(rng.randrange(4)):
            edit = list(base)
            for _ in range(rng.randrange(1, 6)):
                edit[rng.randrange(len(edit))] = rng.choice(words)
            rows.append(" ".join(edit))
    rng.shuffle(rows)
    return [*rows, rows[0].upper(), rows[1], rows[1], "a b", "A b", "", None, " "]


def test_near_duplicates_equal_brute_force(spark):
    rows = near_rows()
    sets, similar = jaccard_by_hand(list(enumerate(rows)))
    label = {k: k for k in range(len(rows))}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if similar(a, b) >= 0.8:
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in near_duplicates(table(spark, rows, False)).collect()}
    assert {k: got[k].component_id for k in got} == {k: find(k) for k in range(len(rows))}
    assert all(got[k].kept == (got[k].component_id == k) for k in got)
    odd = near_duplicates(table(spark, rows)).filter("doc_id is null").collect()
    assert [r.kept for r in odd] == [True]
    assert near_duplicates(table(spark, rows).limit(0)).count() == 0


def test_texts_that_share_nothing(spark):
    rows = [" ".join(f"{k}w{j}" for j in range(12)) for k in range(5)]
    assert all(r.kept for r in near_duplicates(table(spark, rows, False)).collect())


def test_rest_of_a_bucket_is_compared_exactly():
    """A chain whose ends are unlike: what leaders don't confirm is still linked through the middle."""
    def feature(lo):
        return np.arange(lo, lo + 100, dtype=np.uint64), np.ones(100), 0.0
    ids = [1, 2, 3, 4]
    feats = [feature(0), feature(8), feature(16), feature(500)]
    bands = np.tile(np.arange(weighted_minhash.BANDS), (4, 1))
    rows = [(k, h) for h in (0, 1) for k in range(4)]
    t = pa.table({
        "doc_id": pa.array([ids[k] for k, _ in rows]), "part": pa.array([0] * 8), "component": pa.array([ids[k] for k, _ in rows]), "bucket": pa.array([7] * 8),
        "half": pa.array([h for _, h in rows]), "band": pa.array([0] * 8), "bands": pa.array([bands[k].tolist() for k, _ in rows]),
        "keys": pa.array([feats[k][0].tobytes() for k, _ in rows]), "weights": pa.array([feats[k][1].tobytes() for k, _ in rows]), "private": pa.array([0.0] * 8),
    })
    got = weighted_minhash.rest_links(0.8)(t).to_pylist()
    assert {tuple(sorted(r.values())) for r in got} == {(1, 2), (2, 3)}


def test_one_bridge_joins_two_families(spark):
    """Each family is confirmed by a leader of its own; the only pair that joins them has the largest ids."""
    rows, of = [], {}
    for g in range(5):
        head = [f"g{g}h{k}" for k in range(300)]
        for bridge in (False, True):
            for m in range(1 if bridge else 12):
                for side in "ab":
                    tail = [f"g{g}{side}{k}" for k in range(28)] + [f"g{g}{side}{m}z{k}" for k in range(0 if bridge else 8)]
                    of[len(rows) + (1000 if bridge else 0)] = g
                    rows.append((len(rows) + (1000 if bridge else 0), " ".join([*head, *tail])))
    rows += [(5000 + k, " ".join(f"f{k}w{j}" for j in range(8))) for k in range(200)]
    _, similar = jaccard_by_hand(rows)
    assert similar(24 + 1000, 25 + 1000) > 0.8 and similar(0, 1) < 0.78 and similar(24 + 1000, 1) < 0.795 and similar(0, 2) > 0.85
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id < 5000").collect()
    assert {r.doc_id: r.component_id for r in got} == {k: min(j for j in of if of[j] == g) for k, g in of.items()}


def test_samples_agree_as_often_as_the_similarity():
    rng = np.random.RandomState(0)
    keys = rng.randint(0, 2**62, 400).astype(np.uint64)
    a, b = rng.rand(400) + 0.1, rng.rand(400) + 0.1
    got = weighted_minhash.icws(np.concatenate([keys, keys]), np.concatenate([a, b]), np.array([0, 400]), 2000)
    assert (got[0] == got[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_rows_that_share_an_id_link_by_each_text(spark):
    a, b = (" ".join(f"{s}{k}" for k in range(60)) for s in "ab")
    for ids in ((1, 1), (1, 5)):
        rows = [(ids[0], a), (ids[1], b), (2, f"{a} z"), (3, f"{b} z"), *((k, " ".join(f"f{k}w{j}" for j in range(9))) for k in range(10, 60))]
        got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).filter("doc_id < 10").collect()
        want = {1: 1, 2: 1, 3: 1} if ids == (1, 1) else {1: 1, 2: 1, 3: 3, 5: 3}
        assert {(r.doc_id, r.component_id) for r in got} == set(want.items()) and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_columns_named_like_helpers_survive(spark):
    names = ["target", "target_", "found_id", "several", "own", "n", "d1", "head", "label", "place", "shard", "quota", "cell_size", "q_shard", "shards", "upto", "Seats", "s_source", "times", "block", "key"]
    rows = [(k, f"{t} {k}", "s", *(f"{c}{k}" for c in names)) for k, t in enumerate(["a b c d e f"] * 3 + ["g " * 20] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    for made in (cut_repeats(df), near_duplicates(df), mix_sources(df), perplexity(df), fingerprint_texts(df)):
        got = made.collect()
        mine = [c for c in names if c != "target" or made.columns[-1] != "taken"]  # a column that the mix adds
        assert len(got) == len(rows) and [c for c in made.columns if c in df.columns and (c in mine or c not in names)] == [c for c in df.columns if c in mine or c not in names]
        assert all(r[c] == f"{c}{r['doc_id']}" for r in got for c in mine)


def test_near_copies_of_a_large_group_stay_together(spark):
    """What a large group shares is frequent; its copies are as alike as in a small one."""
    base = [f"b{k}" for k in range(120)]
    edit = lambda k: [*base[: 20 + k % 80], f"e{k}", *base[21 + k % 80 :]]
    rows = [(k, " ".join(base)) for k in range(400)] + [(400 + k, " ".join([*edit(k), *(f"t{k}z{j}" for j in range(12))])) for k in range(40)]
    rows += [(1000 + k, " ".join(f"f{k}w{j}" for j in range(9))) for k in range(400)]
    _, similar = jaccard_by_hand(rows)
    assert all(similar(0, 400 + k) < 0.7 for k in range(40))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in got.filter("doc_id < 1000").collect()} == {0} and got.filter("doc_id >= 1000 and not kept").count() == 0
