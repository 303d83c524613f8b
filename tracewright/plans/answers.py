"""Queries over whole answers: history, merges, graphs with conflicts, identities, sealed payloads; and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import clean, extract, identity
from ..operators import graph, history, merge, model_output, retrieve, segment, sync
from ..settings import DEFAULTS
from . import harness as h
from .oracles import BLAME, GRAPH, MESSAGES, REFS, SELECTIONS, UNITS, WORDS
from .queries import blame, exact, graph_hits, joined, lexical, whole_graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
KEY = b"k" * 32
ZERO = "0" * 40


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def untrusted_units(spark, d):
    """Units where times can't be trusted: threads, and lone messages that say something."""
    units = segment.segment(h.messages(spark, d), replace(DEFAULTS, trust_time=False))
    return units.groupBy("channel_name", "kind").agg(F.count("*").alias("n"))


@query
def identities(spark, d):
    value = F.concat(F.lit(" Path/"), F.col("thread_id"), F.lit(" "))
    return h.documents(spark, d).select(
        "channel_name", "thread_id", "ts_end", "doc_id", identity.term_key(KEY, F.lit("path"), value).alias("term_key"), identity.channel_key(KEY, F.col("channel_name")).alias("channel_key"))


@query
def sealed_texts(spark, d):
    """Texts sealed under their id and opened again; under another id they stay shut."""
    docs = h.table(spark, d, "documents").select("doc_id", "text")
    own = F.col("doc_id").cast("string")
    sealed = docs.withColumn("sealed", identity.seal(F.col("text"), KEY, own))
    wrong = identity.unseal(F.col("sealed"), KEY, F.concat(own, F.lit("x")))
    return sealed.select("doc_id", F.sha2(identity.unseal(F.col("sealed"), KEY, own), 256).alias("sha256"), wrong.isNull().alias("shut"))


@query
def code_questions(spark, d):
    s = h.selections(spark, d).withColumn("description", clean.description_fallback(F.col("file_path"), F.col("symbols")))
    return s.select("selection_id", F.sha2(clean.query_text(F.col("symbols"), F.col("description")), 256).alias("query_sha256"), clean.truncate_code(F.col("code"), replace(DEFAULTS, code_chars=40)).alias("code"))


@query
def hooks(spark, d):
    return h.documents(spark, d).select("channel_name", "thread_id", "ts_end", F.array_join(extract.exact_hooks(), "|").alias("hooks"))


def commit_graph(spark, d) -> tuple[DataFrame, DataFrame]:
    """(edges, history) of orders as commits: repositories of 64, in which every eighth merges the seven before
    it into the main line. The first merge of a repository has its first commit as first parent."""
    o = h.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    sha = lambda c: F.sha1(F.concat(c.cast("string"), F.lit("-c")).cast("binary"))
    k, merges = F.col("k"), F.col("k") % 8 == 7
    first = F.when(merges & (k % 64 == 7), k - 7).when(merges, k - 8).when(k % 64 != 0, k - 1)
    parents = F.array_compact(F.array(F.when(first.isNotNull(), F.struct(F.lit(0).alias("place"), first.alias("p"))), F.when(merges, F.struct(F.lit(1).alias("place"), (k - 1).alias("p")))))
    edges = o.select(sha(k).alias("sha"), F.explode(parents).alias("e")).select("sha", sha(F.col("e.p")).alias("parent"), "e.place")
    subject = F.when(merges, F.concat(F.lit("Merge pull request #"), k.cast("string"), F.lit(" from x"))).otherwise("work")
    return edges, o.select(sha(k).alias("sha"), subject.alias("subject"), (k * 60).cast("double").alias("ts"))


@query
def merged_prs(spark, d):
    edges, past = commit_graph(spark, d)
    return history.pr_from_merges(past.select("sha"), edges, past)


@query
def resolved_prs(spark, d):
    """Requests of all commits: by their subject, then by merges, then by the forge, which knows the first commit of
    each repository; every third is no longer current and isn't asked for there."""
    edges, past = commit_graph(spark, d)
    first = F.sha1(F.concat(F.col("o_orderkey").cast("string"), F.lit("-c")).cast("binary"))
    forge = h.table(spark, d, "orders").filter("o_orderkey % 64 = 0").select(F.col("o_orderkey").cast("int").alias("number"), F.lit("then").alias("merged_at"), F.array(F.substring(first, 1, 12)).alias("commit_shas"))
    commits = past.select("sha", F.col("subject").alias("summary"), ((F.col("ts") / 60) % 3 != 0).alias("current"))
    merged = history.pr_from_merges(commits, edges, past)
    return history.resolve_prs(commits, merged, history.pr_from_forge(commits, forge)).select("sha", "pr_number")


def history_lines(spark, d) -> DataFrame:
    """A log dump of each part: its line items' commits, and before each an older one; some rows are cut short."""
    li = h.table(spark, d, "lineitem")
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    at, n = F.unix_seconds(F.col("l_shipdate").cast("timestamp")), (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 3
    row = lambda k, ts: F.concat_ws("\u0000", F.lit("c"), F.sha1(k.cast("binary")), ts.cast("string"), F.concat(F.lit("user"), F.col("l_suppkey").cast("string")), F.lit("said so"))
    rows = F.array(row(key, at), row(F.concat(key, F.lit("-old")), at - 2_592_000), F.concat_ws("\u0000", F.lit("c"), F.lit("short")))
    return li.select(F.col("l_partkey").alias("selection_id"), n.alias("n"), F.posexplode(rows).alias("k", "line")).select("selection_id", (F.col("n") + F.col("k")).alias("line_no"), "line")


@query
def superseded(spark, d):
    """Commits of the history that no longer own a line, and what came after each."""
    commits = history.with_history(history.blame_commits(h.owned_lines(spark, d)), history.parse_history(history_lines(spark, d)))
    rows = graph.commit_rows(checkpointed(history.blame_summary(history.resolve_prs(commits))))
    return graph.supersede_edges(rows).select("selection_id", "source", "target", "type")


@query
def conflict_links(spark, d):
    hits = checkpointed(graph_hits(spark, d))
    said = hits.select("selection_id").distinct().withColumn("json", F.lit('{"conflicts":[{"a":1,"b":2},{"a":1,"b":9}],"supersedes":[{"a":2,"b":1}]}'))
    pairs = model_output.parse_conflicts(said, hits.groupBy("selection_id").agg(F.count("*").alias("n")))
    return graph.conflict_edges(pairs, hits).select("selection_id", "source", "target", "type", "confidence")


@query
def edge_rows(spark, d):
    return whole_graph(spark, d)[1]


def linked_nodes(spark, d) -> DataFrame:
    b = graph.written_blame(blame(spark, d))
    nodes, edges = whole_graph(spark, d, placed=False, b=b)
    return graph.reachable(nodes.select("selection_id", "id", "type"), edges, large=graph.large_selections(b))


@query
def unlinked_nodes(spark, d):
    return linked_nodes(spark, d).groupBy("type", "linked").agg(F.count("*").alias("n"))


@query
def node_rows(spark, d):
    """Every node of every graph, and whether the code leads there."""
    return linked_nodes(spark, d).select("selection_id", "id", "type", "linked")


@query
def requested_rows(spark, d):
    """The documents of every unit that one of every fifty message times asks for."""
    m = h.messages(spark, d)
    _, docs = sync.index_requested(m, m.filter("pmod(ts_us, 50) = 0").select("channel_id", "ts_us"), h.documents(spark, d))
    return docs.select("channel_name", "thread_id", "message_count", "is_bookmarked", F.sha2("raw_text", 256).alias("sha256"))


@query
def fused_graphs(spark, d):
    """The graph beside a private copy of it in which commits have other names and one kind of edge another type."""
    nodes, edges = whole_graph(spark, d, placed=False)
    # both planes come from the same rows, which are dealt once and told twice where they arrive
    planes = lambda t, *copies: t.repartition("selection_id").select("selection_id", F.explode(F.array(*[F.struct(F.lit(k).alias("plane"), *c) for k, c in enumerate(copies)])).alias("r")).select("selection_id", "r.*")
    other = F.when(F.col("type") == "Commit", F.concat("id", F.lit("~"))).otherwise(F.col("id")).alias("id")
    own = F.when(F.col("type") == "PART_OF", "WITHIN").otherwise(F.col("type")).alias("type")
    n, e = merge.fuse_planes(
        planes(nodes.select("selection_id", "id", "type", "scope"), ("id", "type", "scope"), (other, "type", F.lit("user_private").alias("scope"))),
        planes(edges, ("source", "target", "type", "confidence"), ("source", "target", own, F.lit("z").alias("confidence"))))
    return n.select(F.concat(F.lit("node "), "type").alias("what"), "scope").unionByName(e.select(F.concat(F.lit("edge "), "type").alias("what"), F.col("confidence").alias("scope"))).groupBy("what", "scope").agg(F.count("*").alias("n"))


def answered(spark, d, which: str = "true") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(hits, documents, selections) of the whole answer: for the selections of ``which``, exact, dense and lexical hits of all
    documents, fused, weighted, floored and gated. Vectors and texts that several selections ask with are searched for once."""
    b = checkpointed(blame(spark, d).filter(which).select("selection_id", "authors", "commit_ts", "pr_numbers", "all_shas"))
    asked = h.selections(spark, d).filter(which)
    met, docs = exact(spark, d, b, known=asked)
    vectors = lambda: h.table(spark, d, "embeddings").select(F.col("vec_id").alias("v"), F.col("embedding").alias("vector"))
    n = vectors().count()
    ask = asked.select("selection_id", (F.col("selection_id") % n).alias("v"), F.array_join("symbols", " ").alias("text"))
    has = retrieve.first_of_equals(docs.select("doc_id", (F.col("ts_start") % n).alias("v")), "v", DEFAULTS.prefetch)
    near = checkpointed(retrieve.knn(ask.select("v").distinct().join(vectors(), "v").select(F.col("v").alias("query_id"), "vector"), has.join(vectors(), "v").select("doc_id", "vector")))
    words = checkpointed(retrieve.bm25(ask.select(F.col("text").alias("query_id"), "text").distinct(), docs))
    lists = checkpointed(retrieve.question_lists(ask.select("v", "text").distinct(), near, words, docs))
    return retrieve.answer_rows(ask, lists, met, b), docs, asked


@query
def answers(spark, d):
    """The whole answer of every selection, a row for each hit."""
    hits, _, _ = answered(spark, d)
    return hits.select("selection_id", F.col("citation").cast("long").alias("citation"), "doc_id", "match_type", "exact_strength", (F.round(F.col("score") * 1_000_000) / 1_000_000).alias("score"))


@query
def answer_prompts(spark, d):
    """What models are asked about each answer: which candidates matter, and what the evidence says."""
    hits, docs, asked = answered(spark, d, "selection_id % 100 = 0")
    shown = hits.select("selection_id", "citation", "doc_id").join(docs.select("doc_id", "channel_name", "summary", "raw_text", F.date_format(F.timestamp_seconds("ts_start"), "yyyy-MM-dd").alias("date")), "doc_id")
    shown = checkpointed(shown)
    said = asked.select("selection_id", clean.description_fallback(F.col("file_path"), F.col("symbols")).alias("description"))
    digest = lambda t, name: t.select("selection_id", F.sha2("prompt", 256).alias(name))
    return digest(model_output.rerank_prompt(shown, said), "rerank_sha256").join(digest(model_output.synthesis_prompt(shown, said), "synthesis_sha256"), "selection_id")


@query
def summary_prompts(spark, d):
    return h.units(spark, d).select("channel_name", "thread_id", "end_us", F.sha2(model_output.summary_prompt(F.col("channel_name"), F.col("raw_text")), 256).alias("sha256"))


@query
def words_weighted(spark, d):
    """The lexical list ranked by weights before any fusion."""
    got = retrieve.lexical_weighted(checkpointed(lexical(spark, d)), h.doc_facts(spark, d), h.query_facts(spark, d))
    return got.select("query_id", "doc_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def _hmac(message: str) -> str:
    inner, outer = (bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


NAMED = """(SELECT *, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || ['8', '9', 'a', 'b'][(strpos('0123456789abcdef', h[17:17]) - 1) % 4 + 1] || h[18:20] || '-' || h[21:32] AS doc_id
    FROM (SELECT *, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(channel_id || '/' || thread_id)) AS h FROM {0}))"""

CODE = """'def retry_limit_' || (p_partkey % 30) || '(self):' || chr(10) || '    return RETRY_LIMIT_MAX + load_part(' || p_partkey || ')' || chr(10) || 'class PartHandler:' || chr(10) || '    pass' || chr(10)"""
PATH = "CASE WHEN p_partkey % 2 = 0 THEN 'webhooks/delivery' || (p_partkey % 40) || '.py' ELSE 'lib/file' || (p_partkey % 60) || '.ts' END"

NODES = """nodes AS (
    SELECT selection_id, 'code' AS id, 'Code' AS type FROM (SELECT selection_id FROM cm UNION SELECT selection_id FROM g)
    UNION SELECT selection_id, 'commit:' || sha7, 'Commit' FROM cm UNION SELECT selection_id, 'person:' || author, 'Person' FROM cm
    UNION SELECT selection_id, 'pr:' || pr_number, 'PullRequest' FROM allprs UNION SELECT selection_id, 'ticket:' || key, 'Ticket' FROM allprs JOIN tk USING (pr_number)
    UNION SELECT selection_id, 'sentry:' || id, 'SentryIssue' FROM allprs JOIN inc USING (pr_number) UNION SELECT selection_id, thread, 'SlackThread' FROM g
    UNION SELECT selection_id, 'ticket:' || key, 'Ticket' FROM tref WHERE key IN (SELECT key FROM tk) UNION SELECT selection_id, 'sentry:' || key, 'SentryIssue' FROM tref WHERE key IN (SELECT id FROM inc) AND key NOT IN (SELECT key FROM tk))"""

EVERY = "q AS (SELECT * FROM sel)"
ASKED = "q AS (SELECT * FROM sel WHERE selection_id % 100 = 0)"
ANSWER = rf"""WITH {REFS},{BLAME}{SELECTIONS},
        {ASKED},
        dd AS (SELECT *, substring(raw_text, 1, 600) AS summary FROM {NAMED.format("docs")}),
        nv AS (SELECT count(*) AS n FROM embeddings),
        qv AS (SELECT selection_id, embedding::DOUBLE[] AS v FROM q, nv, embeddings WHERE vec_id = selection_id % n),
        dv AS (SELECT doc_id, embedding::DOUBLE[] AS v FROM dd, nv, embeddings WHERE vec_id = ts_start % n),
        knn AS (SELECT * FROM (SELECT selection_id, doc_id, score, row_number() OVER (PARTITION BY selection_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM (SELECT selection_id, doc_id, (1 + list_cosine_similarity(qv.v, dv.v)) / 2 AS score FROM qv, dv)) WHERE rank <= 30),
        ask AS (SELECT selection_id, unnest(list_distinct(regexp_extract_all(lower(array_to_string(wanted, ' ')), '[\p{{L}}\p{{N}}_]+'))) AS token FROM q),
        fld AS (SELECT doc_id, 'summary' AS field, 2.0 AS boost, regexp_extract_all(lower(summary), '[\p{{L}}\p{{N}}_]+') AS toks FROM dd
                UNION ALL SELECT doc_id, 'raw_text', 1.0, regexp_extract_all(lower(raw_text), '[\p{{L}}\p{{N}}_]+') FROM dd UNION ALL SELECT doc_id, 'symbols', 1.5, regexp_extract_all(lower(array_to_string(symbols, ' ')), '[\p{{L}}\p{{N}}_]+') FROM dd),
        tot AS (SELECT field, count(*) AS n, avg(len(toks)) AS avg_len FROM fld WHERE len(toks) > 0 GROUP BY 1),
        tf AS (SELECT doc_id, field, boost, length, token, count(*) AS tf FROM (SELECT doc_id, field, boost, len(toks) AS length, unnest(toks) AS token FROM fld) WHERE token IN (SELECT token FROM ask) GROUP BY ALL),
        df AS (SELECT field, token, count(*) AS df FROM tf GROUP BY 1, 2),
        w AS (SELECT doc_id, field, token, boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len)) AS w FROM tf JOIN df USING (field, token) JOIN tot USING (field)),
        s1 AS (SELECT selection_id, doc_id, field, sum(w) AS s FROM ask JOIN w USING (token) GROUP BY 1, 2, 3),
        words AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM (SELECT selection_id, doc_id, max(s) AS score FROM s1 GROUP BY 1, 2)) WHERE rank <= 30),
        u0 AS (SELECT selection_id, doc_id, rank AS dr, score AS ds, NULL::BIGINT AS lr FROM knn UNION ALL SELECT selection_id, doc_id, NULL, NULL, rank FROM words),
        u1 AS (SELECT selection_id, doc_id, min(dr) AS dr, max(ds) AS ds, min(lr) AS lr FROM u0 GROUP BY 1, 2),
        u2 AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0) AS fused_score, coalesce(ds, 0) AS dense_score FROM u1),
        fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY round(fused_score, 12) DESC, dr NULLS LAST, lr NULLS LAST, doc_id) AS rank FROM u2) WHERE rank <= 20),
        dom AS (SELECT selection_id, max(CASE WHEN rank = 1 THEN ts END) AS commit_ts FROM commits GROUP BY 1),
        wt AS (SELECT f.selection_id, f.doc_id, f.dense_score, f.fused_score * (CASE WHEN coalesce(commit_ts, 0) = 0 THEN 1.0 ELSE greatest(0.3, exp(-((ts_start - commit_ts) ** 2) / (2 * (60 * 86400.0) ** 2))) END)
               * (CASE WHEN len(list_intersect(people, coalesce(authors0, []))) > 0 THEN 1.25 ELSE 1.0 END) * (CASE channel_tier WHEN 1 THEN 1.5 WHEN 3 THEN 0.7 ELSE 1.0 END) * (CASE WHEN is_bookmarked THEN 1.2 ELSE 1.0 END) AS score
               FROM fu f JOIN dd USING (doc_id) LEFT JOIN blame USING (selection_id) LEFT JOIN dom USING (selection_id)),
        near AS (SELECT * FROM (SELECT *, max(dense_score) OVER (PARTITION BY selection_id) AS best FROM wt) WHERE dense_score >= least(best * 0.85, 0.7121)),
        ex AS (SELECT e.selection_id, dd.doc_id, e.strength, e.rank FROM exact e JOIN q USING (selection_id) JOIN dd ON dd.channel_name = e.channel_name AND dd.thread_id = e.thread_id AND dd.ts_end = e.ts_end),
        h0 AS (SELECT selection_id, doc_id, 'exact' AS match_type, strength AS exact_strength, 0.0::DOUBLE AS score, rank AS place FROM ex
               UNION ALL SELECT n.selection_id, n.doc_id, 'semantic', 0, n.score, 1000000 FROM near n ANTI JOIN ex USING (selection_id, doc_id)),
        shut AS (SELECT selection_id FROM (SELECT selection_id, max(dense_score) AS best FROM fu GROUP BY 1) WHERE best < 0.7121 AND selection_id NOT IN (SELECT selection_id FROM ex)),
        hits AS (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY place, round(score, 12) DESC, doc_id) AS citation FROM h0)"""

ORACLES: dict[str, str] = {
    "untrusted_units": f"""WITH {UNITS} SELECT channel_name, 'thread' AS kind, count(*) AS n FROM units WHERE kind = 'thread' GROUP BY 1
        UNION ALL SELECT channel_name, 'solo', count(*) FROM messages WHERE thread_us IS NULL AND (event_id % 12 NOT IN (2, 7) OR len(list_intersect(reactions, ['bookmark', 'warning'])) > 0) GROUP BY 1""",
    "identities": f"""WITH {UNITS} SELECT channel_name, thread_id, ts_end, doc_id, {_hmac("'term.path:path/' || thread_id")} AS term_key, {_hmac("'channel:' || channel_name")} AS channel_key FROM {NAMED.format("units")}""",
    "sealed_texts": "SELECT doc_id, sha256(text) AS sha256, true AS shut FROM documents",
    "code_questions": f"""SELECT p_partkey AS selection_id, sha256('retry_limit_' || (p_partkey % 30) || ' RETRY_LIMIT_MAX PartHandler load_part' || chr(10) || {PATH} || ' (names: retry_limit_' || (p_partkey % 30) || ', RETRY_LIMIT_MAX, PartHandler, load_part)') AS query_sha256,
        substring({CODE}, 1, 40) AS code FROM part""",
    "hooks": f"WITH {REFS} SELECT channel_name, thread_id, ts_end, array_to_string(list_concat(list_transform(pr_refs, lambda x: '#' || x), commit_shas, file_paths), '|') AS hooks FROM docs",
    "merged_prs": """SELECT sha1(o_orderkey || '-c') AS sha, (o_orderkey // 8 * 8 + 7)::INT AS merge_pr FROM orders
        WHERE o_orderkey % 8 <> 7 AND o_orderkey % 64 <> 0 AND o_orderkey // 8 * 8 + 7 IN (SELECT o_orderkey FROM orders)""",
    "resolved_prs": """WITH k AS (SELECT o_orderkey AS k, o_orderkey // 8 * 8 + 7 AS m FROM orders)
        SELECT sha1(k || '-c') AS sha, (CASE WHEN k % 8 = 7 THEN k WHEN k % 64 <> 0 THEN m2.o_orderkey WHEN k % 3 <> 0 THEN k END)::INT AS pr_number FROM k LEFT JOIN orders m2 ON m2.o_orderkey = k.m""",
    "superseded": f"""WITH {BLAME},
        dump AS (SELECT l_partkey AS selection_id, (l_orderkey * 10 + l_linenumber) * 3 AS line_no, sha1(l_orderkey || '-' || l_linenumber)[1:7] AS sha7, epoch(l_shipdate)::BIGINT::DOUBLE AS ts FROM lineitem
                 UNION ALL SELECT l_partkey, (l_orderkey * 10 + l_linenumber) * 3 + 1, sha1(l_orderkey || '-' || l_linenumber || '-old')[1:7], epoch(l_shipdate)::BIGINT::DOUBLE - 2592000 FROM lineitem),
        recent AS (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY line_no) AS place FROM dump),
        past AS (SELECT * FROM recent r WHERE place <= 25 AND selection_id IN (SELECT selection_id FROM commits0) AND NOT EXISTS (SELECT 1 FROM commits0 c WHERE c.selection_id = r.selection_id AND c.sha7 = r.sha7)),
        both_ AS (SELECT selection_id, sha7, ts, rank, true AS current FROM commits0 UNION ALL SELECT selection_id, sha7, ts, 1000000 + place, false FROM past),
        next_ AS (SELECT *, lead(sha7) OVER (PARTITION BY selection_id ORDER BY ts NULLS LAST, rank) AS after FROM both_)
        SELECT selection_id, 'commit:' || after AS source, 'commit:' || sha7 AS target, 'SUPERSEDES' AS type FROM next_ WHERE NOT current AND after IS NOT NULL""",
    "conflict_links": f"""WITH {GRAPH}, p AS (SELECT a.selection_id, a.thread AS x, b.thread AS y FROM g a JOIN g b USING (selection_id) WHERE a.citation = 1 AND b.citation = 2)
        SELECT selection_id, x AS source, y AS target, 'CONFLICTS_WITH' AS type, 'llm-flagged' AS confidence FROM p UNION ALL SELECT selection_id, y, x, 'SUPERSEDES', 'llm-flagged' FROM p""",
    "edge_rows": f"WITH {GRAPH} SELECT * FROM edges",
    "unlinked_nodes": f"""WITH RECURSIVE {GRAPH}, {NODES},
        reach AS (SELECT selection_id, 'code' AS id FROM nodes WHERE id = 'code' UNION SELECT e.selection_id, e.target FROM reach r JOIN edges e ON e.selection_id = r.selection_id AND e.source = r.id)
        SELECT type, r.id IS NOT NULL AS linked, count(*) AS n FROM nodes n LEFT JOIN reach r USING (selection_id, id) GROUP BY 1, 2""",
    "node_rows": f"""WITH RECURSIVE {GRAPH}, {NODES},
        reach AS (SELECT selection_id, 'code' AS id FROM nodes WHERE id = 'code' UNION SELECT e.selection_id, e.target FROM reach r JOIN edges e ON e.selection_id = r.selection_id AND e.source = r.id)
        SELECT selection_id, id, type, r.id IS NOT NULL AS linked FROM nodes n LEFT JOIN reach r USING (selection_id, id)""",
    "requested_rows": f"""WITH {UNITS}, k AS (SELECT DISTINCT channel_name, kind, root_us FROM parts WHERE ts_us % 50 = 0)
        SELECT channel_name, thread_id, message_count::BIGINT AS message_count, true AS is_bookmarked, sha256(raw_text) AS sha256 FROM allunits SEMI JOIN k USING (channel_name, kind, root_us)""",
    "fused_graphs": f"""WITH {GRAPH}, {NODES}
        SELECT 'node ' || type AS what, 'shared' AS scope, count(*) AS n FROM nodes GROUP BY 1 UNION ALL SELECT 'node Commit', 'user_private', count(*) FROM nodes WHERE type = 'Commit' HAVING count(*) > 0
        UNION ALL SELECT 'edge ' || type, confidence, count(*) FROM edges GROUP BY 1, 2 UNION ALL SELECT 'edge WITHIN', 'z', count(*) FROM edges WHERE type = 'PART_OF' HAVING count(*) > 0""",
    "answers": f"{ANSWER.replace(ASKED, EVERY)} SELECT selection_id, citation, doc_id, match_type, exact_strength::INT AS exact_strength, round(score, 6) AS score FROM hits ANTI JOIN shut USING (selection_id) WHERE citation <= 20",
    "answer_prompts": rf"""{ANSWER},
        shown AS (SELECT *, strftime(make_timestamp(ts_start * 1000000), '%Y-%m-%d') AS date FROM hits ANTI JOIN shut USING (selection_id) JOIN dd USING (doc_id) WHERE citation <= 20),
        lists AS (SELECT selection_id, string_agg('[' || citation || '] #' || channel_name || ' ' || date || chr(10) || '    ' || substring(summary, 1, 500), chr(10) ORDER BY citation) AS a,
                  string_agg('[' || citation || '] #' || channel_name || ' ' || date || chr(10) || '    ' || substring(raw_text, 1, 900), chr(10) ORDER BY citation) AS b FROM shown GROUP BY 1),
        told AS (SELECT p_partkey AS selection_id, {PATH} || ' (names: retry_limit_' || (p_partkey % 30) || ', RETRY_LIMIT_MAX, PartHandler, load_part)' AS description FROM part)
        SELECT selection_id, sha256(description || chr(10) || chr(10) || 'Candidates:' || chr(10) || a) AS rerank_sha256, sha256(description || chr(10) || chr(10) || 'Evidence:' || chr(10) || b) AS synthesis_sha256 FROM lists JOIN told USING (selection_id)""",
    "summary_prompts": f"WITH {UNITS} SELECT channel_name, thread_id, end_us, sha256('Conversation in #' || channel_name || ':' || chr(10) || chr(10) || raw_text) AS sha256 FROM units",
    "words_weighted": f"""WITH {WORDS}, z AS (SELECT query_id, doc_id, words.score * (CASE WHEN coalesce(commit_ts, 0) = 0 THEN 1.0 ELSE exp(ln(0.3) * ((ts_start - commit_ts) ** 2) / ((60 * 86400.0) ** 2)) END)
           * (CASE WHEN person = author THEN 1.25 ELSE 1.0 END) * (CASE tier WHEN 1 THEN 1.5 WHEN 3 THEN 0.7 ELSE 1.0 END) * (CASE WHEN marked THEN 1.2 ELSE 1.0 END) AS score FROM words JOIN facts USING (doc_id) LEFT JOIN qf ON qf.selection_id = query_id)
        SELECT query_id, doc_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM z""",
}
