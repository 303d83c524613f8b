"""The jobs on small literal tables, edges included."""

import hashlib
import hmac
import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from tracewright.functions import clean, extract, identity
from tracewright.operators import evaluate, graph, history, merge, model_output, retrieve, segment, sync
from tracewright.operators.documents import build_documents
from tracewright.schemas import MESSAGES
from tracewright.settings import Settings
from tracewright.sources import chat, index, trackers
from tracewright.sources import messages as message_store
from tracewright.streaming import streams

T0 = 1_758_304_234_000_000


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


def messages(spark, rows):
    """(channel, user, text, seconds after T0, thread seconds or None, reactions)"""
    data = [(f"C{c}", c, 2, u, u, t, T0 + int(s * 1_000_000), None if th is None else T0 + int(th * 1_000_000), list(r)) for c, u, t, s, th, r in rows]
    return spark.createDataFrame(data, MESSAGES)


def one(spark, text, *columns):
    return spark.createDataFrame([(text,)], "t string").select(*[c(F.col("t")) for c in columns]).first()


def test_references(spark):
    text = "see https://github.com/acme/app/pull/4821 and (#4821) then #5012 in webhooks/delivery.py ENG-4821 WEBHOOK-184 abcdef1234 1234567 `retry_x` RETRY_MAX RetryPolicy é_x.py"
    prs, shas, tickets, paths, symbols = one(spark, text, extract.pr_refs, extract.commit_shas, extract.ticket_refs, extract.file_paths, extract.symbols)
    assert prs == [4821, 5012] and shas == ["abcdef1"] and tickets == ["ENG-4821", "WEBHOOK-184"]
    assert paths == ["webhooks/delivery.py", "é_x.py"] and symbols == ["retry_x", "RETRY_MAX", "RetryPolicy"]
    assert one(spark, "lunch at #12", extract.pr_refs)[0] == []
    assert one(spark, "", extract.pr_refs, extract.symbols) == ([], [])


def test_symbol_lists(spark):
    row = spark.createDataFrame([(["Ab", "aB", "c_d", "e.f", "Word", "xY12"],)], "s array<string>").select(extract.first_spellings(F.col("s")), extract.distinctive_symbols(F.col("s"))).first()
    assert row[0] == ["Ab", "c_d", "e.f", "Word", "xY12"] and row[1] == ["xY12"]
    code = "import a.b\ndef run_all(self):\n    return load_it('some text')\nclass Thing:\n  MAX_N = 1"
    assert one(spark, code, extract.code_symbols, extract.enclosing_symbol) == (["run_all", "MAX_N", "Thing", "load_it", "a.b", "some text"], "run_all")
    s = spark.createDataFrame([("Did it.\nSYMBOLS: a_b, none, C", "raw"), ("__ERROR__ x", "raw"), (None, "raw"), ("SYMBOLS: x", "raw")], "o string, r string")
    got = s.select(*extract.parse_summary(F.col("o"), F.col("r"))).collect()
    assert [tuple(g) for g in got] == [("Did it.", ["a_b", "C"]), ("raw", []), ("raw", []), ("raw", ["x"])]


def test_declarations(spark):
    code = "def a():\n    x\n\n    y\nz = 1\nclass B:\n  pass\n"
    got = extract.declarations(spark.createDataFrame([("f", code), ("g", "")], "file_path string, code string")).collect()
    assert sorted((r.name, r.line_start, r.line_end) for r in got) == [("B", 5, 6), ("a", 0, 3)]


def test_cleaning(spark):
    names = spark.createDataFrame([("U1", "Ann $1")], "id string, name string")
    rows = [("message", None, "U1", None, None, "hi <@U1> <@U9|x> <https://a.b/c|l> <#C1|gen> &amp;lt; ", "1758304234.123456", None, None), ("message", "channel_join", "U1", None, None, "x", "1", None, None),
            ("message", None, "", "B1", "bot", "beep", "2", "", None), ("message", None, None, None, None, "  ", "3", None, None), ("file", None, "U1", None, None, "x", "4", None, None)]
    raw = spark.createDataFrame([(*r, "C", "c", 1) for r in rows], "type string, subtype string, user string, bot_id string, username string, text string, ts string, thread_ts string, reactions array<struct<name:string,count:int,users:array<string>>>, channel_id string, channel_name string, channel_tier int")
    got = {r.ts_us: r for r in clean.to_messages(raw, names).collect()}
    assert set(got) == {1758304234123456, 2000000}
    assert got[1758304234123456].text == "hi @Ann $1 @someone https://a.b/c #gen <" and got[1758304234123456].user_name == "Ann $1"
    assert (got[2000000].user_id, got[2000000].user_name, got[2000000].thread_us) == ("B1", "bot", None)
    link = one(spark, "https://acme.slack.com/archives/C1/p1758304234123456?thread_ts=1758304230.000001", *[lambda c, k=k: clean.parse_permalink(c)[k] for k in range(3)])
    assert tuple(link) == ("C1", 1758304234123456, 1758304230000001)


def test_identity(spark):
    row = one(spark, "C1/1.5", identity.uuid5, identity.content_hash, lambda c: identity.hmac_sha256(b"key", c), lambda c: identity.unseal(identity.seal(c, b"k" * 16, F.lit("id")), b"k" * 16, F.lit("id")), lambda c: identity.unseal(identity.seal(c, b"k" * 16, F.lit("id")), b"k" * 16, F.lit("other")))
    assert row[0] == str(uuid.uuid5(uuid.NAMESPACE_URL, "C1/1.5")) and row[1] == hashlib.sha256(b"C1/1.5").hexdigest()
    assert row[2] == hmac.new(b"key", b"C1/1.5", hashlib.sha256).hexdigest() and row[3] == "C1/1.5" and row[4] is None


def test_bursts_and_windows(spark):
    rows = [("a", "u", "x", 0, None, ()), ("a", "v", "y", 2700, None, ()), ("a", "u", "z", 5401, None, ("warning",)), ("a", "w", "late", 86_400 * 3, None, ())]
    rows += [("b", "u", f"m{k:03}", k, 0, ()) for k in range(121)]
    m = messages(spark, rows)
    units = segment.aggregate_units(segment.unit_messages(m)).collect()
    assert sorted((u.channel_name, u.kind, u.message_count) for u in units) == [("a", "burst", 1), ("a", "burst", 1), ("a", "burst", 2), ("b", "thread", 1), ("b", "thread", 60), ("b", "thread", 60)]
    kept = segment.segment(m).collect()
    assert sorted((u.channel_name, u.message_count, u.is_bookmarked) for u in kept) == [("a", 1, True), ("b", 60, False), ("b", 60, False)]
    solo = segment.segment(m.filter("channel_name = 'a'"), Settings(trust_time=False)).count()
    assert solo == 1
    assert segment.segment(m.limit(0)).count() == 0
    midnight = messages(spark, [("c", "u", "x", 86_400 - T0 / 1e6 % 86_400 + d, None, ()) for d in (-60, 60, 120)])
    assert [u.message_count for u in segment.segment(midnight).collect()] == [3]


def test_gap_report(spark):
    m = messages(spark, [("a", "u", "x", s, None, ()) for s in (0, 1, 3, 6, 10)] + [("b", "u", "x", 0, 0, ())])
    got = {r.channel_name: r for r in segment.gap_report(m).collect()}
    assert (got["a"].loose_messages, got["a"].p50_gap, got["a"].p90_gap, got["a"].max_gap, got["a"].degenerate) == (5, 2.0, 4.0, 4.0, True)
    assert (got["b"].loose_messages, got["b"].max_gap, got["b"].degenerate) == (0, 0.0, False)


def test_sync_modes(spark):
    rows = [("a", "u", f"t{k}", k * 60, None, ()) for k in range(4)] + [("b", "u", f"r{k}", k * 100, 0, ()) for k in range(5)]
    m = messages(spark, rows)
    full, cp = sync.backfill(m)
    first, cp1 = sync.backfill(m.filter(F.col("ts_us") <= T0 + 300_000_000))
    after, docs, cp2 = sync.incremental(m, first, cp1)
    key = lambda df: sorted((r.doc_id, r.content_hash) for r in df.collect())
    assert key(after) == key(full) and docs.count() == 1
    assert {r.status for r in sync.reconcile(full, after).collect()} == {"same"}
    stale = full.limit(1).withColumn("doc_id", F.lit("gone")).unionByName(full.withColumn("content_hash", F.lit("x")).limit(1))
    report = sync.reconcile(full, stale)
    assert sorted(r.status for r in report.collect()) == ["changed", "missing", "stale"]
    assert key(sync.apply_reconcile(stale, full, report)) == key(full)
    written = sync.index_requested(m, m.filter("text = 'r1'").select("channel_id", "ts_us"), first)[1].collect()
    assert [(d.message_count, d.is_bookmarked) for d in written] == [(5, True)]
    assert sync.read_from(cp.limit(0)).first().from_us == 0


def test_index_files(spark, tmp_path):
    path = str(tmp_path / "index")
    docs = sync.backfill(messages(spark, [(c, "u", f"t{k}", k, None, ()) for c in "abc" for k in range(3)]))[0]
    index.write_documents(docs, path)
    index.write_documents(docs.limit(1).withColumn("summary", F.lit("new")), path)
    got = index.read_index(spark, path)
    assert got.count() == 3 and got.filter("summary = 'new'").count() == 1
    assert index.read_index(spark, str(tmp_path / "none")).count() == 0
    cp = spark.createDataFrame([("a", 5)], "channel_name string, last_us long")
    index.write_checkpoint(cp, str(tmp_path / "cp"))
    index.write_checkpoint(cp.withColumn("last_us", F.lit(3).cast("long")), str(tmp_path / "cp"))
    assert index.read_checkpoint(spark, str(tmp_path / "cp")).collect()[0].last_us == 5
    meta = index.stamp(spark, "e", 3, "s")
    index.guard(meta, "e", "s")
    with pytest.raises(index.IndexMismatch):
        index.guard(meta, "other", "s")
    status = index.index_status(got, cp).collect()
    assert {r.channel_name for r in status} == {"a", "b", "c"} and {r.total for r in status} == {3}


def test_exports(spark, tmp_path):
    (tmp_path / "general").mkdir()
    (tmp_path / "general" / "2024-01-01.json").write_text(json.dumps([{"type": "message", "user": "U1", "text": "x", "ts": "1.5"}, {"type": "message", "user": "U2", "text": "y", "ts": "2.5"}]))
    (tmp_path / "general" / "2024-01-02.json").write_text('[{"type": "message", "text": "cut')
    (tmp_path / "users.json").write_text(json.dumps([{"id": "U1", "name": "n", "profile": {"display_name": "", "real_name": "R"}}, {"id": "U2"}]))
    (tmp_path / "channels.json").write_text(json.dumps([{"id": "C1", "name": "general"}]))
    (tmp_path / "channel_tiers.json").write_text(json.dumps({"general": 1}))
    raw, bad = chat.read_export(spark, str(tmp_path))
    assert raw.count() == 2 and bad.count() == 1
    users, channels, tiers = chat.read_directory(spark, str(tmp_path))
    assert {(r.id, r.name) for r in users.collect()} == {("U1", "R"), ("U2", "U2")}
    assert {(r.channel_id, r.channel_tier) for r in chat.with_channels(raw, channels, tiers).collect()} == {("C1", 1)}
    assert [t.count() for t in trackers.read_trackers(spark, str(tmp_path))] == [0, 0, 0]
    pr = spark.createDataFrame([(json.dumps({"number": 3, "title": "t", "user": {"login": "l"}, "commits": [{"sha": "abcdef123"}]}),), ("{}",)], "json string")
    assert [(r.number, r.author, r.commit_shas) for r in trackers.normalize_prs(pr).collect()] == [(3, "l", ["abcdef1"])]


def test_blame(spark):
    a, b, z = "a" * 40, "b" * 40, "0" * 40
    dump = [f"{a} 1 1 2", "author Ann", "author-time 100", "summary Fix (#7)", "\tcode", f"{a} 2 2", f"{b} 3 3 1", "author Bob", "author-time 50", "summary Merge pull request #9 from x", f"{z} 4 4 1", "author Not Yet"]
    lines = spark.createDataFrame([(1, k, x) for k, x in enumerate(dump)], "selection_id long, line_no long, line string")
    commits = history.resolve_prs(history.blame_commits(history.parse_blame(lines)))
    log = spark.createDataFrame([(1, 0, "\0" + "\0".join(["c" * 40, "20", "Cy", "old"])), (1, 1, "\0short")], "selection_id long, line_no long, line string")
    s = history.blame_summary(history.resolve_prs(history.with_history(history.blame_commits(history.parse_blame(lines)), history.parse_history(log)))).first()
    assert s.authors == ["Ann", "Bob"] and s.dominant_sha == a[:7] and s.pr_numbers == [9, 7] and s.uncommitted and s.commit_date == "1970-01-01"
    assert [c.sha for c in s.commits] == ["ccccccc", b[:7], a[:7]] and commits.count() == 2
    edges = graph.supersede_edges(graph.commit_rows(spark.createDataFrame([s]))).collect()
    assert [(e.source, e.target) for e in edges] == [(f"commit:{b[:7]}", "commit:ccccccc")]


def test_merge_ancestry(spark):
    # base <- m1 (first parent base, second x); y joins by m2
    edges = spark.createDataFrame([("x", "base", 0), ("m1", "base", 0), ("m1", "x", 1), ("y", "m1", 0), ("m2", "m1", 0), ("m2", "y", 1)], "sha string, parent string, place int")
    log = spark.createDataFrame([("m1", "Merge pull request #1", 10.0), ("m2", "Merge pull request #2", 20.0)], "sha string, subject string, ts double")
    asked = spark.createDataFrame([("x",), ("y",), ("base",)], "sha string")
    assert {(r.sha, r.merge_pr) for r in history.pr_from_merges(asked, edges, log).collect()} == {("x", 1), ("y", 2)}


def test_vectors_and_fusion(spark):
    docs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, None)], "doc_id long, vector array<float>")
    got = retrieve.knn(spark.createDataFrame([(7, [3.0, 0.0])], "query_id long, vector array<float>"), docs).orderBy("rank").collect()
    assert [(r.doc_id, round(r.score, 6)) for r in got] == [(1, 1.0), (2, 0.5), (3, 0.5)]
    ranked = "query_id long, doc_id long, score double, rank int"
    fused = retrieve.rrf(spark.createDataFrame([(1, 1, 0.9, 1), (1, 2, 0.8, 2)], ranked), spark.createDataFrame([(1, 2, 5.0, 1), (1, 3, 4.0, 2)], ranked)).orderBy("rank").collect()
    assert [(r.doc_id, r.dense_score) for r in fused] == [(2, 0.8), (1, 0.9), (3, 0.0)]
    hits = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.71), (1, 3, 0.5)], "selection_id long, doc_id long, dense_score double")
    assert retrieve.semantic_floor(hits).count() == 1
    assert evaluate.calibrate(spark.createDataFrame([(True, 0.5), (False, 0.8)], "is_null boolean, best_dense double")).first().threshold == pytest.approx(0.65)


def test_bm25_prefers_the_better_field(spark):
    docs = spark.createDataFrame([(1, "retry", "x", ["y"]), (2, "other", "retry retry word", ["y"]), (3, "", "", [])], "doc_id long, summary string, raw_text string, symbols array<string>")
    got = retrieve.bm25(spark.createDataFrame([(9, "Retry?")], "query_id long, text string"), docs).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2]


def test_model_answers(spark):
    hits = spark.createDataFrame([(1, k, f"d{k}", "exact" if k == 1 else "semantic", 3 if k == 1 else 0) for k in range(1, 5)], "selection_id long, citation int, doc_id string, match_type string, exact_strength int")
    said = spark.createDataFrame([(1, json.dumps({"items": [{"index": 3, "why": "b"}, {"index": 2, "relevant": False}, {"index": 9}, {"index": 1, "relevant": False}]}))], "selection_id long, json string")
    got = model_output.apply_verdicts(hits, said).orderBy("place").collect()
    assert [(r.doc_id, r.why) for r in got] == [("d1", "mentions the path of the file"), ("d3", "b"), ("d4", "")]
    broken = model_output.apply_verdicts(hits, said.withColumn("json", F.lit("no"))).orderBy("place").collect()
    assert [r.doc_id for r in broken] == ["d1", "d2", "d3", "d4"]


def test_fused_planes(spark):
    shape = "selection_id long, citation int, doc_id string, match_type string, permalink string, channel_name string, scope string"
    one = spark.createDataFrame([(1, 1, "a", "exact", "p1", "c", "shared"), (1, 2, "b", "semantic", "p2", "c", "shared")], shape)
    two = spark.createDataFrame([(1, 1, "x", "exact", "p9", "c", "user_private"), (1, 2, "y", "semantic", "p2", "c", "user_private")], shape)
    got = merge.fuse_results(one, two).orderBy("citation")
    assert [(r.doc_id, r.old) for r in got.collect()] == [("a", 1), ("x", 1), ("b", 2)]
    text = merge.remap_text(spark.createDataFrame([(1, "[1] [2] [7]")], "selection_id long, synthesis string"), merge.citation_map(got))
    assert text.first().synthesis == "[1] [3] [7]"
    pair = merge.remap_conflicts(spark.createDataFrame([(1, 1, 2, "conflict")], "selection_id long, a int, b int, kind string"), merge.citation_map(got)).first()
    assert (pair.a, pair.b) == (1, 3)


def test_graph_of_a_thread_that_brings_a_request(spark):
    commit = {"sha": "abc1234", "author": "Ann", "ts": 10.0, "date": "1970-01-01", "lines": 3, "pr_number": 1, "dominant": True, "current": True}
    blame = spark.createDataFrame([(5, [commit])], "selection_id long, commits array<struct<sha:string,author:string,ts:double,date:string,lines:long,pr_number:int,dominant:boolean,current:boolean>>")
    rows = [(5, 1, "exact", "C", "1.0", "c", 50, "s", [1, 2, 9], [], ["ENG-1", "INC-1"]), (5, 2, "semantic", "C", "2.0", "c", 60, "s", [2], ["abc1234"], []), (5, 3, "semantic", "C", "3.0", "c", 70, "s", [], [], [])]
    hits = spark.createDataFrame(rows, "selection_id long, citation int, match_type string, channel_id string, thread_id string, channel_name string, ts_start long, summary string, pr_refs array<int>, commit_shas array<string>, ticket_refs array<string>")
    prs = spark.createDataFrame([(1, "one", "2020-01-01T00:00:00Z"), (2, "two", None)], "number int, title string, merged_at string")
    tickets = spark.createDataFrame([("ENG-1", "t", 1)], "key string, title string, pr_number int")
    incidents = spark.createDataFrame([("INC-1", "i", "2021-01-01", 2)], "id string, title string, first_seen string, pr_number int")
    nodes, edges = graph.resolve_graph(blame, hits, prs, tickets, incidents)
    got = {(e.source, e.target, e.type, e.confidence) for e in edges.collect()}
    t = [f"slack:C/{k}.0" for k in (1, 2, 3)]
    assert got == {
        ("code", "commit:abc1234", "CREATED_BY", "exact"), ("commit:abc1234", "person:Ann", "AUTHORED_BY", "exact"), ("commit:abc1234", "pr:1", "PART_OF", "exact"), ("pr:1", t[0], "DISCUSSED_IN", "exact"), (t[0], "pr:2", "REFERENCES", "exact"),
        ("pr:2", t[1], "DISCUSSED_IN", "exact"), (t[1], "commit:abc1234", "REFERENCES", "exact"), (t[0], "ticket:ENG-1", "REFERENCES", "exact"), (t[0], "sentry:INC-1", "REFERENCES", "exact"), ("pr:1", "ticket:ENG-1", "TRACKED_BY", "exact"), ("pr:2", "sentry:INC-1", "RELATED_TO", "exact"), ("code", t[2], "DISCUSSED_IN", "llm-flagged"),
    }
    assert [n.id for n in nodes.orderBy("place").collect()][:2] == ["code", "commit:abc1234"]
    assert graph.reachable(nodes, edges).filter("not linked").count() == 0
    rows, links = graph.timeline_rows(nodes, edges)
    assert rows.filter("type in ('Person', 'Ticket')").count() == 0 and links.count() > 0


def test_streamed_sync_equals_batch(spark, tmp_path):
    m = messages(spark, [("a", "u", f"t{k}", k * 60, None, ()) for k in range(5)] + [("b", "u", f"r{k}", k * 100, 0, ()) for k in range(4)])
    source, store, at, cp = (str(tmp_path / n) for n in ("source", "store", "index", "cp"))
    for part in (m.filter("text in ('t0', 't1', 't2', 'r0', 'r1')"), m.filter("text not in ('t0', 't1', 't2', 'r0', 'r1')")):
        part.coalesce(1).write.mode("append").parquet(source)
        streams.stream_sync(spark.readStream.schema(MESSAGES).parquet(source), store, at, cp).awaitTermination()
    key = lambda df: sorted((r.doc_id, r.content_hash) for r in df.collect())
    assert key(index.read_index(spark, at)) == key(build_documents(segment.segment(m)))
    seen = []
    streams.run_once(streams.stream_dedupe(spark.readStream.schema(MESSAGES).parquet(source)), lambda df, _: seen.extend(df.collect()), str(tmp_path / "cp2"))
    assert len(seen) == 9
    fresh = []
    for late in (m, m.filter("text = 't0'").withColumn("text", F.lit("again")), messages(spark, [("b", "u", "first", -90 * 86_400, None, ())])):
        late.coalesce(1).write.mode("append").parquet(source)
        streams.stream_unique(spark.readStream.schema(MESSAGES).parquet(source), str(tmp_path / "keys"), lambda df, _: fresh.extend(r.text for r in df.collect()), str(tmp_path / "cp4"))
    assert sorted(fresh) == sorted([*(f"t{k}" for k in range(5)), *(f"r{k}" for k in range(4)), "first"])


def test_a_repeated_batch_gives_its_rows_again(spark, tmp_path):
    """A batch that died after its keys were written: its rows are no duplicates of themselves; another's are."""
    m = messages(spark, [("a", "u", f"t{k}", k * 60, None, ()) for k in range(5)])
    seen, keys = [], str(tmp_path / "keys")
    sink = lambda df, _: seen.append(sorted(r.text for r in df.collect()))
    streams.pass_unseen(m.limit(3), 4, keys, sink)
    streams.pass_unseen(m.limit(3), 4, keys, sink)
    streams.pass_unseen(m, 5, keys, sink)
    assert seen == [["t0", "t1", "t2"], ["t0", "t1", "t2"], ["t3", "t4"]]


def test_only_touched_days_are_read(spark, tmp_path):
    store, day = str(tmp_path / "store"), 86_400
    rows = [("a", "ann", f"m{k}", k * day, None, []) for k in range(100)] + [("a", "bob", "reply", 60 * day, 3 * day, []), ("a", "bob", "root", 3 * day, 3 * day, [])]
    new = messages(spark, [("a", "cy", "late reply", 99 * day, 3 * day, []), ("a", "cy", "loose", 80 * day + 60, None, [])])
    for part in (messages(spark, rows), new, new):
        message_store.append_slots(part, store)
    message_store.append_messages(messages(spark, rows), store)
    got = message_store.read_touched(spark, store, new)
    assert {r.text for r in got.collect()} == {"reply", "root", "m80"}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert len({r.f for r in got.select(F.input_file_name().alias("f")).collect()}) < 8


def test_a_burst_longer_than_the_lookback_is_read_whole(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = messages(spark, [("a", "u", f"m{k}", k * 2500, None, []) for k in range(800)] + [("a", "u", f"x{k}", 800 * 2500 + 10_000 + k, None, []) for k in range(3)] + [("b", "u", "other", 5, None, [])])
    new = messages(spark, [("a", "u", "bridge", 800 * 2500 + 200, None, [])])
    for part in (rows, new):
        message_store.append_slots(part, store)
    message_store.append_messages(rows, store)
    got = {r.text for r in message_store.read_touched(spark, store, new).collect()}
    assert got == {f"m{k}" for k in range(800)}  # 23 days; the burst after the gap and the other channel aren't read


@pytest.mark.parametrize("seed", range(3))
def test_slots_cut_bursts_where_gaps_do(spark, seed):
    rng = random.Random(seed)
    times, at = [], 0
    for _ in range(300):
        at += rng.choice([0, 1, 900_000_000, 2_699_999_999, 2_700_000_000, 2_700_000_001, 9_000_000_000])
        times.append(at)
    m = spark.createDataFrame([("Ca", "a", 2, "u", "u", f"m{k}", T0 + t, None, []) for k, t in enumerate(times)], MESSAGES)
    roots, want = {r.text: r.root_us - T0 for r in segment.burst_units(m).collect()}, {}
    for k, t in enumerate(times):
        root = t if not k or t - times[k - 1] > 2_700_000_000 else root
        want[f"m{k}"] = root
    assert roots == want
    gaps = [b - a for a, b in zip(times, times[1:], strict=False)]
    row = segment.gap_report(m).first()
    rank = lambda f: sorted(gaps)[max(int(round(f * len(gaps))), 1) - 1] / 1_000_000
    assert (row.p50_gap, row.p90_gap, row.max_gap) == (rank(0.5), rank(0.9), max(gaps) / 1_000_000)
    asked = spark.createDataFrame([("Ca", T0 + times[150])], "channel_id string, ts_us long")
    pool = sync.requested_messages(m, asked)
    assert {r.text for r in pool.collect()} == {k for k, v in want.items() if v == want["m150"]} - {f"m{k}" for k, t in enumerate(times) if k and t == times[k - 1]}
    if seed == 0:
        plan = pool._jdf.queryExecution().analyzed().toString()
        assert plan.index("Window [row_number()") < plan.index("LeftSemi")  # windows stand above the semi-joins


def test_quantiles_of_gaps_take_digits(spark):
    rng = random.Random(9)
    values = {"a": [rng.randrange(1 << 40) for _ in range(500)], "b": [7] * 300 + [1 << 45], "c": [0]}
    gaps = spark.createDataFrame([(c, g) for c, own in values.items() for g in own], "channel_name string, gap long")
    got = {r.channel_name: (r.p50, r.p90, r.largest) for r in segment.quantile_gaps(gaps, {"p50": 0.5, "p90": 0.9}).collect()}
    rank = lambda own, f: sorted(own)[max(int(round(f * len(own))), 1) - 1]
    assert got == {c: (rank(own, 0.5), rank(own, 0.9), max(own)) for c, own in values.items()}
    assert segment.quantile_gaps(gaps.limit(0), {"p50": 0.5}).count() == 0


def test_cases_that_must_be_null_or_show_a_conflict(spark):
    cases = spark.createDataFrame([("null",), ("found",)], "case_id string")
    results = spark.createDataFrame([("found", 1)], "case_id string, rank int")
    assert {tuple(r) for r in evaluate.null_cases(cases, results).collect()} == {("null", True), ("found", False)}
    assert {tuple(r) for r in evaluate.conflict_cases(cases, results).collect()} == {("null", False), ("found", True)}


def test_long_lines_and_rings_of_a_graph(spark, monkeypatch):
    line = [("s", "code" if not k else f"n{k - 1}", f"n{k}") for k in range(100)] + [("s", "n50", "n20"), ("s", "n99", "code")]
    ring = [("s", f"r{k}", f"r{(k + 1) % 3}") for k in range(3)] + [("s", "r0", "tail"), ("t", "x", "y"), ("t", "code", "z"), ("t", "y", "w"), ("t", "z", "w")]
    edges = spark.createDataFrame([*line, *ring], "selection_id string, source string, target string")
    ids = {(s, n) for s, a, b in [*line, *ring] for n in (a, b)}
    rounds, plain = [], graph.checkpointed
    monkeypatch.setattr(graph, "checkpointed", lambda df: rounds.append(0) or plain(df))
    got = {(r.selection_id, r.id) for r in graph.reachable(spark.createDataFrame(sorted(ids), "selection_id string, id string"), edges).filter("linked").collect()}
    assert got == {("s", "code"), ("t", "code"), ("t", "z"), ("t", "w"), *(("s", f"n{k}") for k in range(100))} and len(rounds) < 30


def test_hot_terms_join_only_their_newest_documents(spark):
    rows = [(f"d{k}", k, "symbol", "HOT_NAME") for k in range(500)] + [("old", -5, "pr", "7"), ("old", -5, "symbol", "HOT_NAME"), ("older", -6, "path", "a/b.py")]
    posts = spark.createDataFrame(rows, "doc_id string, ts_end long, kind string, term string")
    terms = spark.createDataFrame([(s, k, t, v) for s in range(40) for k, t, v in (("symbol", "HOT_NAME", 1), ("path", "a/b.py", 3), *((("pr", "7", 5),) if s == 3 else ()))], "selection_id int, kind string, term string, strength int")
    got = {}
    for r in retrieve.exact_tier(terms, posts).collect():
        got.setdefault(r.selection_id, {})[r.rank] = (r.doc_id, r.strength)
    assert got[3] == {1: ("old", 5), 2: ("older", 3), 3: ("d499", 1)}
    assert all(got[s] == {1: ("older", 3), 2: ("d499", 1), 3: ("d498", 1)} for s in range(40) if s != 3)


def test_payloads_of_trackers(spark, tmp_path):
    one_column = lambda *rows: spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "json string")
    prs = trackers.normalize_prs(one_column({"number": 7, "title": "t", "user": {"login": "ann"}, "merged_at": None, "merge_commit_sha": "abc", "files": [{"filename": "a.py"}], "commits": [{"sha": "0123456789"}]}, "{broken", {"title": "none"})).collect()
    assert [(r.number, r.author, r.files, r.commit_shas) for r in prs] == [(7, "ann", ["a.py"], ["0123456"])]
    tickets = one_column({"key": "ENG-1", "fields": {"summary": "s", "status": {"name": "Open"}, "assignee": None}}, {"fields": {}}).withColumn("pr_number", F.lit(7))
    assert [tuple(r) for r in trackers.normalize_tickets(tickets).collect()] == [("ENG-1", "s", "Open", None, 7)]
    incidents = trackers.normalize_incidents(one_column({"id": "9", "shortId": "", "title": "x", "firstSeen": "2024-01-01", "status": "open", "firstRelease": {"version": "v1"}}, {"id": "8", "shortId": "APP-8", "permalink": "p"}, {}), "acme").collect()
    assert [(r.id, r.url, r.first_release) for r in incidents] == [("9", "https://sentry.io/organizations/acme/issues/9/", "v1"), ("APP-8", "p", None)]
    (tmp_path / "tickets.json").write_text(json.dumps([{"key": "ENG-2", "title": "u", "status": "s", "assignee": "a", "pr_number": 3}]))
    (tmp_path / "github_prs.json").write_text("[{broken")
    prs, tickets, incidents = trackers.read_trackers(spark, str(tmp_path))
    assert [r.key for r in tickets.collect()] == ["ENG-2"] and prs.count() == 0 and incidents.count() == 0


def test_corrupt_checkpoint_is_empty_and_other_faults_are_not(spark, tmp_path):
    path = tmp_path / "checkpoint"
    index.write_checkpoint(spark.createDataFrame([("a", 5)], "channel_name string, last_us long"), str(path))
    assert index.read_checkpoint(spark, str(path)).collect() == [("a", 5)]
    for f in path.glob("part-*"):
        f.write_bytes(b"no parquet")
    for f in path.glob(".*.crc"):
        f.unlink()
    assert index.read_checkpoint(spark, str(path)).count() == 0
    with pytest.raises(Exception):  # noqa: B017  an unreadable index is no empty index
        index.read_index(spark, str(path)).collect()


def test_export_of_tables_reads_back(spark, tmp_path):
    """Channel folders and day files, one of them malformed."""
    for channel in ("general", "ops"):
        (tmp_path / channel).mkdir()
        for day in range(3):
            rows = [{"type": "message", "user": f"U{k}", "text": f"{channel} {day} {k}", "ts": f"{1_758_304_234 + 86_400 * day + k}.000100"} for k in range(4)]
            (tmp_path / channel / f"2025-09-1{day}.json").write_text(json.dumps(rows))
    (tmp_path / "ops" / "2025-09-13.json").write_text('[{"type": "message", "ts": ')
    (tmp_path / "users.json").write_text(json.dumps([{"id": "U1", "name": "u", "profile": {"display_name": "", "real_name": "Ann"}}, {"id": "U2", "name": "bob"}, {"id": "U3"}]))
    (tmp_path / "channels.json").write_text(json.dumps([{"id": "C1", "name": "general"}]))
    (tmp_path / "channel_tiers.json").write_text(json.dumps({"general": 1}))
    raw, bad = chat.read_export(spark, str(tmp_path))
    users, channels, tiers = chat.read_directory(spark, str(tmp_path))
    assert raw.count() == 24 and [r.path.rsplit("/", 1)[1] for r in bad.collect()] == ["2025-09-13.json"]
    assert {(r.id, r.name) for r in users.collect()} == {("U1", "Ann"), ("U2", "bob"), ("U3", "U3")}
    got = clean.to_messages(chat.with_channels(raw, channels, tiers), users)
    assert {(r.channel_id, r.channel_tier) for r in got.collect()} == {("C1", 1), ("ops", 2)}
    assert {r.user_name for r in got.collect()} == {"U0", "Ann", "bob", "U3"}
