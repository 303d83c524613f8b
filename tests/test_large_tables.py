"""What only tables larger than the given ones show: several messages at one time, characters without a capital."""

import numpy as np
from pyspark.sql import functions as F

from tracewright.checkpoints import checkpointed
from tracewright.functions import clean
from tracewright.operators import evaluate, graph, history, retrieve, sync
from tracewright.plans import answers
from tracewright.sources import chat

MESSAGE = "message_id string, channel_id string, channel_name string, user_id string, text string, ts_us long, thread_us long"


def test_messages_of_one_time_stay_apart(spark):
    rows = [("1", "C", "c", "u", "lol", 5, None), ("2", "C", "c", "u", "lol", 5, None), ("2", "C", "c", "u", "~lol", 5, None), ("3", "C", "c", "v", "x", 5, 5)]
    m = spark.createDataFrame(rows, MESSAGE)
    assert sorted((r.message_id, r.text) for r in sync.dedupe_messages(m).collect()) == [("1", "lol"), ("2", "lol"), ("3", "x")]
    assert sync.dedupe_messages(m.drop("message_id")).count() == 1
    asked = m.filter("message_id = '1'").select("channel_id", "ts_us")
    assert sync.requested_messages(m, asked).count() == 3


def test_replies_of_one_time_stay_apart(spark):
    rows = lambda *ids: spark.createDataFrame([("c", "5", i, "u", f"t{i}") for i in ids], "channel_name string, ts string, client_msg_id string, user string, text string")
    got = chat.merge_history_and_replies(rows("1", "2"), rows("2", "3").withColumn("text", F.lit("reply")))
    assert sorted(r.text for r in got.collect()) == ["reply", "t1", "t2"]


def test_capitals_stand_for_one_character_each(spark):
    words = spark.createDataFrame([("Straße",), ("éﬁx",), ("",)], "w string").select(clean.upper(F.col("w")).alias("u"), F.lower(clean.upper(F.col("w"))).alias("l")).collect()
    assert [tuple(w) for w in words] == [("STRAẞE", "straße"), ("ÉﬁX", "éﬁx"), ("", "")]
    results = spark.createDataFrame([(1, 4, "c", "", "die straße hier")], "case_id int, rank int, channel_name string, summary string, raw_text string")
    wanted = spark.createDataFrame([(1, "c", "Straße")], "case_id int, channel_name string, marker string").withColumn("marker", clean.upper(F.col("marker")))
    assert evaluate.eval_ranks(results, wanted).first()["rank"] == 4


COMMITS = "selection_id long, commits array<struct<sha:string,author:string,ts:double,date:string,lines:long,pr_number:int,dominant:boolean,current:boolean>>"


def test_steps_are_kept_as_columns(spark):
    got = checkpointed(spark.range(10).withColumn("t", F.lit("x")))
    assert got.count() == 10 and got.inputFiles() and all(f.endswith(".zstd.parquet") for f in got.inputFiles())


def test_edges_of_commits_are_told_once_without_meeting(spark):
    c = lambda sha, author, pr: {"sha": sha, "author": author, "ts": 1.0, "date": "d", "lines": 1, "pr_number": pr, "dominant": False, "current": True}
    blame = spark.createDataFrame([(1, [c("a", "x", 7), c("b", "x", 7), c("a", "x", None), c("c", None, None)])], COMMITS)
    tickets = spark.createDataFrame([("T-1", 7), ("T-1", 7)], "key string, pr_number int")
    incidents = spark.createDataFrame([], "id string, pr_number int")
    got = sorted((e.source, e.target) for e in graph.commit_chain(blame, None, tickets, incidents).collect())
    assert got == [("code", "commit:a"), ("code", "commit:b"), ("code", "commit:c"), ("commit:a", "person:x"), ("commit:a", "pr:7"), ("commit:b", "person:x"), ("commit:b", "pr:7"), ("pr:7", "ticket:T-1")]
    assert "Exchange" not in str(graph._commit_edges(graph.commit_rows(blame).filter("lone"))._jdf.queryExecution().executedPlan())


def test_requests_of_the_forge_come_to_where_commits_are(spark):
    rows = [(s, f"{k:040x}", 1, k, "ann", 1.0, "misc" if k % 2 else "Fix (#5)") for s in (1, 2) for k in (17, 18, 19)]
    owned = spark.createDataFrame(rows, "selection_id long, sha string, lines long, first_line long, author string, ts double, summary string").repartition("selection_id")
    prs = spark.createDataFrame([(3, None, [f"{17:040x}"]), (4, "then", [f"{17:040x}"]), (9, None, [f"{18:040x}"])], "number int, merged_at string, commit_shas array<string>")
    forge = history.pr_from_forge(owned, prs, ("selection_id",))
    assert sorted((r.selection_id, int(r.sha, 16), r.forge_pr) for r in forge.collect()) == [(1, 17, 4), (1, 18, 9), (2, 17, 4), (2, 18, 9)]
    assert sorted((int(r.sha, 16), r.forge_pr) for r in history.pr_from_forge(owned, prs).collect()) == [(17, 4), (18, 9)]
    commits = history.resolve_prs(history.blame_commits(owned), None, forge)
    assert sorted((r.selection_id, int(r.sha, 16), r.pr_number) for r in commits.collect()) == [(s, k, p) for s in (1, 2) for k, p in ((17, 4), (18, 5), (19, None))]


def test_answers_of_many_selections_equal_those_of_each(spark):
    """Selections that ask the same share one search; their hits are those of a search of their own."""
    rng = np.random.RandomState(3)
    vectors = {v: rng.rand(6).tolist() for v in range(5)}
    docs = spark.createDataFrame(
        [(f"d{k:02}", k % 5, k * 86_400, k * 86_400 + 9, [f"u{k % 4}"], k % 3 + 1, k % 7 == 0, [k % 9], [], [], [], [], f"alpha w{k % 6} beta" if k % 2 else "gamma", f"w{k % 4}") for k in range(70)],
        "doc_id string, v long, ts_start long, ts_end long, participants array<string>, channel_tier int, is_bookmarked boolean, pr_refs array<int>, commit_shas array<string>, file_paths array<string>, file_basenames array<string>, symbols array<string>, summary string, raw_text string")
    asked = spark.createDataFrame([(s, "", [f"w{s % 3}"], s % 5) for s in range(23)], "selection_id long, file_path string, symbols array<string>, v long").withColumn("text", F.array_join("symbols", " "))
    blame = spark.createDataFrame([(s, [f"u{s % 4}"], s * 86_400.0, [s], []) for s in range(20)], "selection_id long, authors array<string>, commit_ts double, pr_numbers array<int>, all_shas array<string>")
    vector = spark.createDataFrame(list(vectors.items()), "v long, vector array<double>")
    fields = ("selection_id", "doc_id", "match_type", "exact_strength", "citation")
    ask = lambda key: asked.join(vector, "v").select(F.col(key).alias("query_id"), "vector").distinct()
    words = lambda key: retrieve.bm25(asked.select(F.col(key).alias("query_id"), "text").distinct(), docs)
    each, _ = retrieve.retrieve(asked, blame, docs, retrieve.knn(ask("selection_id"), docs.join(vector, "v").select("doc_id", "vector")), words("selection_id"))
    few = retrieve.first_of_equals(docs.select("doc_id", "v"), "v", 30).join(vector, "v").select("doc_id", "vector")
    lists = retrieve.question_lists(asked.select("v", "text").distinct(), retrieve.knn(ask("v"), few), words("text"), docs)
    terms = retrieve.selection_terms(asked.join(blame.select("selection_id", "pr_numbers", "all_shas"), "selection_id", "left"))
    all_ = retrieve.answer_rows(asked.select("selection_id", "v", "text"), lists, retrieve.exact_tier(terms, retrieve.postings(docs)), blame)
    rows = lambda t: sorted((*(r[c] for c in fields), round(r.score, 9)) for r in t.collect())
    want = rows(each)
    assert rows(all_) == want and len({r[0] for r in want}) == 23 and {r[2] for r in want} == {"exact", "semantic"}


def test_every_selection_is_answered():
    assert "selection_id % 100 " not in answers.ORACLES["answers"] and "selection_id % 100 = 0" in answers.ORACLES["answer_prompts"]
