"""DuckDB SQL for the registered queries."""

from __future__ import annotations

MESSAGES = r"""
ev AS (SELECT event_id, epoch_us(ts) AS ts_us, user_id, event_type, value, user_id % 10 AS ch, epoch_us(ts) // 86400000000 AS day, event_type IN ('click', 'purchase') AS threaded FROM events),
raw AS (
    SELECT *, CASE WHEN threaded THEN min(ts_us) OVER (PARTITION BY ch, day, user_id % 3, threaded) END AS root,
           event_id % 40 = 3 AS bot FROM ev),
messages AS (
    SELECT event_id, 'C' || ch AS channel_id, 'ch' || ch AS channel_name, (ch % 3 + 1)::INT AS channel_tier,
           CASE WHEN bot THEN 'B' || (user_id % 5) ELSE 'U' || user_id END AS user_id,
           CASE WHEN bot THEN 'bot' || (user_id % 5) ELSE 'user' || user_id END AS user_name,
           CASE event_id % 12
               WHEN 0 THEN 'please look at https://github.com/acme/app/pull/' || (event_id % 1000000) || ' before release'
               WHEN 1 THEN 'merged PR and #' || (event_id % 1000000) || ' into the branch'
               WHEN 2 THEN 'lunch at #' || (event_id % 50)
               WHEN 3 THEN 'commit ' || substring(sha1(event_id || '-1'), 1, 9) || ' broke webhooks/delivery' || (event_id % 40) || '.py'
               WHEN 4 THEN 'ticket ENG-' || (event_id // 12 % 100000) || ' and OPS-' || (event_id % 20) || ' are open'
               WHEN 5 THEN 'see `retry_limit_' || (event_id % 30) || '` and RETRY_LIMIT_MAX in services/file' || (event_id % 60) || '.ts'
               WHEN 6 THEN 'WebhookRetryPolicy is wrong in RetryHandler'
               WHEN 7 THEN 'lol'
               WHEN 8 THEN 'ok thanks @user' || user_id || ' & all'
               WHEN 9 THEN 'docs at https://example.com/x in #general <'
               WHEN 10 THEN 'incident INC-' || (event_id // 12 % 100000) || ' caused by abcdef1'
               ELSE 'a plain message about nothing ' || event_id END AS text,
           ts_us, root AS thread_us,
           CASE WHEN event_type = 'purchase' AND value > 100 THEN ['bookmark'] WHEN event_type = 'error' AND value > 50 THEN ['warning', 'eyes']
                WHEN event_type = 'view' AND value > 10 THEN ['eyes'] ELSE []::VARCHAR[] END AS reactions
    FROM raw WHERE event_id % 97 <> 5 AND event_id % 50 <> 7)"""

UNITS = MESSAGES + r""",
loose AS (SELECT *, lag(ts_us) OVER (PARTITION BY channel_name ORDER BY ts_us, user_id, text) AS prev_us FROM messages WHERE thread_us IS NULL),
burst AS (SELECT * EXCLUDE (prev_us), max(CASE WHEN prev_us IS NULL OR ts_us - prev_us > 2700000000 THEN ts_us END) OVER (PARTITION BY channel_name ORDER BY ts_us, user_id, text) AS root_us, 'burst' AS kind FROM loose),
keyed AS (SELECT *, thread_us AS root_us, 'thread' AS kind FROM messages WHERE thread_us IS NOT NULL UNION ALL SELECT * FROM burst),
pieces AS (SELECT *, (row_number() OVER (PARTITION BY channel_name, kind, root_us ORDER BY ts_us, user_id, text) - 1) // 60 AS piece FROM keyed),
parts AS (SELECT *, min(ts_us) OVER (PARTITION BY channel_name, kind, root_us, piece) AS first_us FROM pieces),
allunits AS (
    SELECT channel_name, min(channel_id) AS channel_id, min(channel_tier) AS channel_tier, kind, root_us, piece, (first_us // 1000000) || '.' || lpad((first_us % 1000000)::VARCHAR, 6, '0') AS thread_id,
           min(ts_us) AS start_us, max(ts_us) AS end_us, count(*) AS message_count, list(DISTINCT user_name) AS people, list(user_name ORDER BY ts_us, user_id, text) AS ordered_people,
           string_agg(user_name || ': ' || text, chr(10) ORDER BY ts_us, user_id, text) AS raw_text, flatten(list(reactions ORDER BY ts_us, user_id, text)) AS reactions
    FROM parts GROUP BY channel_name, kind, root_us, piece, first_us),
units AS (
    SELECT *, len(list_intersect(reactions, ['bookmark', 'pushpin', 'memo', 'warning', 'fire', 'rotating_light'])) > 0 AS is_bookmarked,
           'https://acme.slack.com/archives/' || channel_id || '/p' || replace(thread_id, '.', '') AS permalink, start_us // 1000000 AS ts_start, end_us // 1000000 AS ts_end
    FROM allunits WHERE message_count >= 3 OR len(list_intersect(reactions, ['bookmark', 'pushpin', 'memo', 'warning', 'fire', 'rotating_light'])) > 0)"""


def firsts(expr: str) -> str:
    """A list without repeats, in order of first appearance."""
    return f"list_filter({expr}, lambda x, i: list_position({expr}, x) = i)"


PR_URLS = r"regexp_extract_all(raw_text, 'github\.com/[\w.-]+/[\w.-]+/pull/(\d+)', 1)"
PR_BARE = r"CASE WHEN regexp_matches(raw_text, '(?i)(github\.com|\.py\b|\.ts\b|\.go\b|\brepo\b|\bPR\b|\bpull request\b|\bmerge[d]?\b|\bcommit\b|\bbranch\b|\bdiff\b)') THEN regexp_extract_all(raw_text, '(?:^|\s)#(\d{1,6})\b', 1) ELSE []::VARCHAR[] END"
REFS = UNITS + rf""",
found AS (
    SELECT *, list_transform(list_concat({PR_URLS}, {PR_BARE}), lambda x: x::INT) AS prs0,
           list_transform(list_filter(regexp_extract_all(raw_text, '\b([0-9a-f]{{7,40}})\b', 1), lambda x: regexp_matches(x, '[a-f]')), lambda x: x[1:7]) AS shas0,
           regexp_extract_all(raw_text, '\b([A-Z]{{2,8}}-\d{{1,5}})\b', 1) AS tickets0, regexp_extract_all(raw_text, '\b([\w./-]+\.(?:py|rb|ts|tsx|js|go|java|sql))\b', 1) AS paths0,
           list_concat(regexp_extract_all(raw_text, '`([A-Za-z_][A-Za-z0-9_]{{2,}})`', 1), regexp_extract_all(raw_text, '\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b', 1), regexp_extract_all(raw_text, '\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b', 1)) AS symbols0
    FROM units),
refs AS (
    SELECT * EXCLUDE (prs0, shas0, tickets0, paths0, symbols0), {firsts('prs0')} AS pr_refs, {firsts('shas0')} AS commit_shas, {firsts('tickets0')} AS ticket_refs, {firsts('paths0')} AS file_paths, {firsts('symbols0')} AS symbols0
    FROM found),
docs AS (
    SELECT * EXCLUDE (symbols0), list_transform(file_paths, lambda p: split_part(p, '/', -1)) AS file_basenames, symbols0 AS raw_symbols,
           list_filter(symbols0, lambda x, i: list_position(list_transform(symbols0, lambda y: lower(y)), lower(x)) = i) AS symbols FROM refs)"""

CHECKPOINT = r""",
checkpoint AS (SELECT channel_name, min(ts_us) + ((max(ts_us) - min(ts_us)) * 9) // 10 AS last_us FROM messages WHERE channel_name <> 'ch9' GROUP BY 1)"""

BLAME = r"""
li AS (SELECT l_partkey AS selection_id, CASE WHEN l_orderkey % 20 = 3 AND l_linenumber = 2 THEN repeat('0', 40) ELSE sha1(l_orderkey || '-' || l_linenumber) END AS sha, l_quantity::BIGINT AS lines,
              l_orderkey * 10 + l_linenumber AS first_line, 'user' || l_suppkey AS author, epoch(l_shipdate)::DOUBLE AS ts,
              CASE l_returnflag WHEN 'A' THEN 'Fix it (#' || (l_orderkey % 1000000) || ')' WHEN 'N' THEN 'Merge pull request #' || (l_orderkey % 1000000) || ' from x' ELSE 'misc' END AS summary FROM lineitem),
owned AS (SELECT selection_id, sha, sum(lines)::BIGINT AS lines, min(first_line) AS first_line, min(author) AS author, min(ts) AS ts, min(summary) AS summary FROM li GROUP BY 1, 2),
flagged AS (SELECT *, max((sha = repeat('0', 40))::INT) OVER (PARTITION BY selection_id) = 1 AS uncommitted FROM owned),
commits0 AS (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY lines DESC, first_line) AS rank, sha[1:7] AS sha7 FROM flagged WHERE sha <> repeat('0', 40)),
prs AS (SELECT o_orderkey::INT AS number, 'user' || o_custkey AS author, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS merged_at, CASE WHEN o_orderkey % 2 = 0 THEN sha1(o_orderkey || '-1')[1:7] ELSE sha1(o_orderkey || '-1') END AS listed,
               CASE WHEN o_orderstatus <> 'O' THEN sha1(o_orderkey || '-1') END AS merge_commit_sha FROM orders),
forge AS (SELECT sha, number AS forge_pr FROM (SELECT o.sha, p.number, row_number() OVER (PARTITION BY o.sha ORDER BY (p.merged_at IS NOT NULL) DESC, p.number) AS k FROM (SELECT DISTINCT sha FROM owned) o JOIN prs p ON o.sha[1:7] = p.listed[1:7] AND (starts_with(o.sha, p.listed) OR starts_with(p.listed, o.sha))) WHERE k = 1),
commits AS (SELECT c.*, coalesce(CASE WHEN starts_with(summary, 'Fix it (#') THEN regexp_extract(summary, '\(#(\d+)\)', 1)::INT WHEN starts_with(summary, 'Merge') THEN regexp_extract(summary, '#(\d+)', 1)::INT END, forge_pr) AS pr_number FROM commits0 c LEFT JOIN forge USING (sha)),
blame AS (
    SELECT selection_id, list(author ORDER BY rank) AS authors0, max(CASE WHEN rank = 1 THEN sha7 END) AS dominant_sha, list(sha7 ORDER BY ts, rank) AS all_shas, max(CASE WHEN rank = 1 THEN pr_number END) AS pr_number,
           list(pr_number ORDER BY ts, rank) FILTER (pr_number IS NOT NULL) AS prs0, strftime(make_timestamp((max(CASE WHEN rank = 1 THEN ts END) * 1000000)::BIGINT), '%Y-%m-%d') AS commit_date, bool_or(uncommitted) AS uncommitted, count(*) AS n_commits
    FROM commits GROUP BY 1)"""

SELECTIONS = r""",
sel AS (SELECT p_partkey AS selection_id, CASE WHEN p_partkey % 2 = 0 THEN 'webhooks/delivery' || (p_partkey % 40) || '.py' ELSE 'lib/file' || (p_partkey % 60) || '.ts' END AS file_path, ['retry_limit_' || (p_partkey % 30), 'RETRY_LIMIT_MAX', 'PartHandler', 'load_part'] AS wanted FROM part),
terms AS (
    SELECT DISTINCT * FROM (
        SELECT selection_id, 'pr' AS kind, unnest(prs0)::VARCHAR AS term, 5 AS strength FROM blame JOIN sel USING (selection_id)
        UNION ALL SELECT selection_id, 'sha', unnest(all_shas), 4 FROM blame JOIN sel USING (selection_id)
        UNION ALL SELECT selection_id, 'path', file_path, 3 FROM sel UNION ALL SELECT selection_id, 'basename', split_part(file_path, '/', -1), 2 FROM sel
        UNION ALL SELECT selection_id, 'symbol', unnest(wanted), 1 FROM sel)),
posts AS (
    SELECT DISTINCT * FROM (
        SELECT channel_name, kind AS ukind, thread_id, ts_end, 'pr' AS kind, unnest(pr_refs)::VARCHAR AS term FROM docs UNION ALL SELECT channel_name, kind, thread_id, ts_end, 'sha', unnest(commit_shas) FROM docs
        UNION ALL SELECT channel_name, kind, thread_id, ts_end, 'path', unnest(file_paths) FROM docs UNION ALL SELECT channel_name, kind, thread_id, ts_end, 'basename', unnest(file_basenames) FROM docs
        UNION ALL SELECT channel_name, kind, thread_id, ts_end, 'symbol', unnest(symbols) FROM docs)),
strongest AS (SELECT selection_id, channel_name, thread_id, max(strength) AS strength, max(ts_end) AS ts_end FROM terms JOIN posts USING (kind, term) GROUP BY 1, 2, 3),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY strength DESC, ts_end DESC) AS rank FROM strongest) WHERE rank <= 3)"""

QUERYSET = r"""
qv AS (SELECT vec_id AS query_id, embedding FROM embeddings WHERE vec_id % 100 = 0),
knn0 AS (SELECT q.query_id, e.vec_id AS doc_id, (1 + list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) / 2 AS score FROM qv q, embeddings e),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, doc_id) AS rank FROM knn0) WHERE rank <= 30)"""

WORDS = QUERYSET + r""",
qt AS (SELECT item_id * 100 AS query_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS toks FROM benchmark),
asked AS (SELECT query_id, unnest(toks) AS token FROM qt),
fld AS (
    SELECT doc_id, 'raw_text' AS field, 1.0 AS boost, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS toks FROM documents
    UNION ALL SELECT doc_id, 'summary', 2.0, regexp_extract_all(lower(coalesce(source, '')), '[\p{L}\p{N}_]+') FROM documents),
tot AS (SELECT field, count(*) AS n, avg(len(toks)) AS avg_len FROM fld WHERE len(toks) > 0 GROUP BY 1),
tf AS (SELECT doc_id, field, boost, length, token, count(*) AS tf FROM (SELECT doc_id, field, boost, len(toks) AS length, unnest(toks) AS token FROM fld) WHERE token IN (SELECT token FROM asked) GROUP BY ALL),
df AS (SELECT field, token, count(*) AS df FROM tf GROUP BY 1, 2),
w AS (SELECT doc_id, field, token, boost * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_len)) AS w FROM tf JOIN df USING (field, token) JOIN tot USING (field)),
s1 AS (SELECT query_id, doc_id, field, sum(w) AS s FROM asked JOIN w USING (token) GROUP BY 1, 2, 3),
s2 AS (SELECT query_id, doc_id, max(s) AS score FROM s1 GROUP BY 1, 2),
words AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s2) WHERE rank <= 30),
both0 AS (SELECT query_id AS selection_id, doc_id, rank AS dr, score AS ds, NULL::BIGINT AS lr FROM knn UNION ALL SELECT query_id, doc_id, NULL, NULL, rank FROM words),
both1 AS (SELECT selection_id, doc_id, min(dr) AS dr, max(ds) AS ds, min(lr) AS lr FROM both0 GROUP BY 1, 2),
both2 AS (SELECT *, coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0) AS fused_score, coalesce(ds, 0) AS dense_score FROM both1),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY round(fused_score, 12) DESC, dr NULLS LAST, lr NULLS LAST, doc_id) AS rank FROM both2) WHERE rank <= 20),
facts AS (SELECT doc_id, doc_id * 86400 AS ts_start, doc_id * 86400 + 60 AS ts_end, 'user' || (doc_id % 7) AS person, doc_id % 3 + 1 AS tier, doc_id % 5 = 0 AS marked, source, lang FROM documents),
sels AS (SELECT query_id AS selection_id FROM qv UNION SELECT query_id FROM qt),
qf AS (SELECT selection_id, 'user' || (selection_id % 7) AS author, CASE WHEN selection_id % 300 <> 0 THEN (selection_id * 86400)::DOUBLE END AS commit_ts FROM sels),
wt AS (
    SELECT f.selection_id, f.doc_id, f.dense_score, f.fused_score * (CASE WHEN coalesce(commit_ts, 0) = 0 THEN 1.0 ELSE greatest(0.3, exp(-((ts_start - commit_ts) ** 2) / (2 * (60 * 86400.0) ** 2))) END)
           * (CASE WHEN person = author THEN 1.25 ELSE 1.0 END) * (CASE tier WHEN 1 THEN 1.5 WHEN 3 THEN 0.7 ELSE 1.0 END) * (CASE WHEN marked THEN 1.2 ELSE 1.0 END) AS score
    FROM fused f JOIN facts USING (doc_id) LEFT JOIN qf USING (selection_id)),
near AS (SELECT * FROM (SELECT *, max(dense_score) OVER (PARTITION BY selection_id) AS best_dense FROM wt) WHERE dense_score >= least(best_dense * 0.85, 0.7121)),
ex AS (SELECT selection_id, d.doc_id, (floor(selection_id / 100.0)::INT % 5 + 1)::INT AS strength FROM sels JOIN documents d ON d.doc_id = selection_id + 1),
hits0 AS (
    SELECT ex.selection_id, ex.doc_id, 'exact' AS match_type, strength AS exact_strength, 0.0::DOUBLE AS score, 1 AS place FROM ex
    UNION ALL SELECT n.selection_id, n.doc_id, 'semantic', 0, n.score, 1000000 FROM near n ANTI JOIN ex USING (selection_id, doc_id)),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY place, round(score, 12) DESC, doc_id) AS citation FROM hits0) WHERE citation <= 20),
gate AS (
    SELECT selection_id, coalesce(best_dense, 0)::DOUBLE AS best_dense, ex.selection_id IS NOT NULL AS has_exact, ex.selection_id IS NULL AND coalesce(best_dense, 0) < 0.7121 AS is_null
    FROM (SELECT selection_id, max(dense_score) AS best_dense FROM fused GROUP BY 1) b FULL JOIN (SELECT DISTINCT selection_id FROM ex) ex USING (selection_id))"""

GRAPH = REFS + "," + BLAME + SELECTIONS + r""",
g AS (SELECT e.selection_id, e.rank AS citation, 'slack:' || d.channel_id || '/' || d.thread_id AS thread, d.ts_start, d.pr_refs, d.commit_shas, d.ticket_refs FROM exact e JOIN docs d USING (channel_name, thread_id)),
tk AS (SELECT 'ENG-' || c_custkey AS key, (c_custkey * 2)::INT AS pr_number FROM customer),
inc AS (SELECT 'INC-' || s_suppkey AS id, (s_suppkey * 3)::INT AS pr_number, sha1((s_suppkey * 2) || '-1') AS first_release FROM supplier),
cm AS (SELECT selection_id, sha7, author, pr_number, ts FROM commits),
onmap AS (SELECT DISTINCT selection_id, pr_number FROM cm WHERE pr_number IS NOT NULL),
pref AS (SELECT DISTINCT selection_id, citation, thread, ts_start, unnest(pr_refs) AS pr_number FROM g),
pk AS (SELECT p.*, m.pr_number IS NOT NULL AS mapped, row_number() OVER (PARTITION BY p.selection_id, p.pr_number ORDER BY citation) AS rn FROM pref p LEFT JOIN onmap m USING (selection_id, pr_number) WHERE m.pr_number IS NOT NULL OR p.pr_number IN (SELECT number FROM prs)),
brought AS (SELECT selection_id, pr_number, ts_start FROM pk WHERE NOT mapped AND rn = 1),
allprs AS (SELECT selection_id, pr_number FROM onmap UNION SELECT selection_id, pr_number FROM brought),
sref AS (SELECT DISTINCT selection_id, thread, unnest(commit_shas) AS sha7 FROM g),
tref AS (SELECT DISTINCT selection_id, citation, thread, unnest(ticket_refs) AS key FROM g),
tedge AS (SELECT selection_id, thread, CASE WHEN key IN (SELECT key FROM tk) THEN 'ticket:' || key ELSE 'sentry:' || key END AS node FROM tref WHERE key IN (SELECT key FROM tk) OR key IN (SELECT id FROM inc)),
anchored AS (
    SELECT selection_id, 'pr:' || pr_number AS source, thread AS target, 'DISCUSSED_IN' AS type, 'exact' AS confidence FROM pk WHERE mapped OR rn > 1
    UNION SELECT selection_id, thread, 'pr:' || pr_number, 'REFERENCES', 'exact' FROM pk WHERE NOT mapped AND rn = 1
    UNION SELECT s.selection_id, thread, 'commit:' || s.sha7, 'REFERENCES', 'exact' FROM sref s SEMI JOIN cm USING (selection_id, sha7)
    UNION SELECT selection_id, thread, node, 'REFERENCES', 'exact' FROM tedge),
chain AS (
    SELECT selection_id, 'code' AS source, 'commit:' || sha7 AS target, 'CREATED_BY' AS type, 'exact' AS confidence FROM cm
    UNION SELECT selection_id, 'commit:' || sha7, 'person:' || author, 'AUTHORED_BY', 'exact' FROM cm
    UNION SELECT selection_id, 'commit:' || sha7, 'pr:' || pr_number, 'PART_OF', 'exact' FROM cm WHERE pr_number IS NOT NULL),
context AS (
    SELECT selection_id, 'pr:' || pr_number AS source, 'ticket:' || key AS target, 'TRACKED_BY' AS type, 'exact' AS confidence FROM allprs JOIN tk USING (pr_number)
    UNION SELECT selection_id, 'pr:' || pr_number, 'sentry:' || id, 'RELATED_TO', 'exact' FROM allprs JOIN inc USING (pr_number)),
ties AS (SELECT selection_id, source AS thread FROM anchored UNION SELECT selection_id, target FROM anchored),
looseg AS (SELECT selection_id, 'code' AS source, thread AS target, 'DISCUSSED_IN' AS type, 'exact' AS confidence FROM g ANTI JOIN ties USING (selection_id, thread)),
coded AS (SELECT selection_id FROM chain UNION SELECT selection_id FROM looseg),
edges AS (SELECT * FROM anchored UNION SELECT * FROM chain UNION SELECT * FROM context UNION SELECT * FROM looseg UNION SELECT selection_id, 'code', thread, 'DISCUSSED_IN', 'exact' FROM g ANTI JOIN coded USING (selection_id))"""

TIMELINE = GRAPH + r""",
posn AS (SELECT selection_id, sha7, author, pr_number, ts, row_number() OVER (PARTITION BY selection_id ORDER BY ts NULLS LAST, rank) - 1 AS pos FROM commits),
mergedat AS (SELECT o_orderkey::INT AS pr_number, CASE WHEN o_orderstatus <> 'O' THEN epoch(o_orderdate)::DOUBLE END AS merged_ts FROM orders),
n0 AS (
    SELECT selection_id, 0 AS stage, 0 AS sub, 'code' AS id, 'Code' AS type, NULL::DOUBLE AS ts FROM (SELECT selection_id FROM posn UNION SELECT selection_id FROM g)
    UNION ALL SELECT selection_id, 1, pos, 'commit:' || sha7, 'Commit', ts FROM posn UNION ALL SELECT selection_id, 2, pos, 'person:' || author, 'Person', NULL FROM posn
    UNION ALL SELECT selection_id, 3, pos, 'pr:' || pr_number, 'PullRequest', coalesce(merged_ts, ts) FROM posn LEFT JOIN mergedat USING (pr_number) WHERE pr_number IS NOT NULL
    UNION ALL SELECT selection_id, 4, pr_number, 'ticket:' || key, 'Ticket', NULL FROM allprs JOIN tk USING (pr_number)
    UNION ALL SELECT selection_id, 5, pr_number, 'sentry:' || id, 'SentryIssue', (id[5:]::BIGINT * 1000000) // 86400 * 86400 FROM allprs JOIN inc USING (pr_number)
    UNION ALL SELECT selection_id, 6, citation, thread, 'SlackThread', ts_start FROM g
    UNION ALL SELECT selection_id, 7, citation, 'pr:' || pr_number, 'PullRequest', coalesce(merged_ts, ts_start) FROM pk LEFT JOIN mergedat USING (pr_number) WHERE NOT mapped AND rn = 1
    UNION ALL SELECT selection_id, 8, citation, 'ticket:' || key, 'Ticket', NULL FROM tref WHERE key IN (SELECT key FROM tk)
    UNION ALL SELECT selection_id, 9, citation, 'sentry:' || key, 'SentryIssue', NULL FROM tref WHERE key IN (SELECT id FROM inc) AND key NOT IN (SELECT key FROM tk)),
n1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY selection_id, id ORDER BY stage, sub) AS first FROM n0) WHERE first = 1),
n2 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY id <> 'code', ts NULLS LAST, stage, sub, id) AS place FROM n1),
sides AS (SELECT selection_id, source AS id, target AS near FROM edges UNION SELECT selection_id, target, source FROM edges),
beside AS MATERIALIZED (SELECT s.selection_id, s.id, s.near, n.type AS near_type, n.ts AS near_ts, n.place AS near_place FROM sides s JOIN n2 n ON n.selection_id = s.selection_id AND n.id = s.near),
folds AS (SELECT b.selection_id, b.id, arg_min(near, near_place) AS parent FROM beside b JOIN n2 n USING (selection_id, id) WHERE n.type IN ('Person', 'Ticket') AND near_type NOT IN ('Person', 'Ticket') GROUP BY 1, 2),
lent AS (SELECT selection_id, id, min(near_ts) AS borrowed FROM beside GROUP BY 1, 2),
placed AS MATERIALIZED (SELECT n2.*, parent, coalesce(ts, borrowed) AS row_ts FROM n2 LEFT JOIN folds USING (selection_id, id) LEFT JOIN lent USING (selection_id, id))"""

PLANES = WORDS + r""",
one AS (SELECT selection_id, citation AS old, doc_id, match_type, 0 AS plane, 'shared' AS scope FROM hits WHERE citation <= 6),
two AS (SELECT selection_id, citation - 4 AS old, doc_id, match_type, 1 AS plane, 'user_private' AS scope FROM hits WHERE citation > 6),
ranked AS (SELECT *, CASE WHEN match_type = 'exact' THEN 0 ELSE 1 END AS tier, row_number() OVER (PARTITION BY selection_id, plane, match_type = 'exact' ORDER BY old) AS r FROM (SELECT * FROM one UNION ALL SELECT * FROM two)),
planes AS (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY tier, r, plane) AS citation FROM ranked)"""

ORACLES: dict[str, str] = {
    "clean_messages": f"WITH {MESSAGES} SELECT channel_id, channel_tier, user_id, user_name, text, ts_us, thread_us::VARCHAR AS thread_us, array_to_string(reactions, '|') AS reactions FROM messages",
    "harvested_names": f"""WITH {MESSAGES}, ids AS (
        SELECT CASE WHEN bot THEN 'B' || (user_id % 5) ELSE 'U' || user_id END AS id, CASE WHEN bot THEN 'bot' || (user_id % 5) WHEN user_id::VARCHAR LIKE '%7' THEN 'U' || user_id ELSE 'user' || user_id END AS name FROM raw
        UNION SELECT 'U' || user_id, CASE WHEN user_id::VARCHAR LIKE '%7' THEN 'U' || user_id ELSE 'user' || user_id END FROM raw WHERE event_id % 12 = 8)
        SELECT DISTINCT id, name FROM ids""",
    "merged_history": f"WITH {MESSAGES} SELECT 'ch' || ch AS channel_name, count(*) AS n, sum((event_id % 3 = 0)::BIGINT)::BIGINT AS replies FROM raw GROUP BY 1",
    "tiers": f"WITH {MESSAGES} SELECT channel_name, CASE channel_name WHEN 'ch0' THEN 3 WHEN 'ch1' THEN 2 WHEN 'ch2' THEN 1 ELSE 2 END::INT AS channel_tier, count(*) AS n FROM messages GROUP BY 1",
    "shared_plane": f"WITH {MESSAGES} SELECT channel_id, count(*) AS n FROM messages WHERE channel_tier <> 2 AND channel_id NOT IN ('C0', 'C3') GROUP BY 1",
    "allowed_channels": f"WITH {MESSAGES} SELECT channel_id, count(*) AS n FROM messages WHERE channel_id IN ('C1', 'C4') GROUP BY 1",
    "parsed_permalinks": f"""WITH {MESSAGES} SELECT 'https://acme.slack.com/archives/' || channel_id || '/p' || ts_us || CASE WHEN thread_us IS NULL THEN '' ELSE '?thread_ts=' || (thread_us // 1000000) || '.' || lpad((thread_us % 1000000)::VARCHAR, 6, '0') END AS url, channel_id, ts_us, thread_us::VARCHAR AS thread_us FROM messages""",
    "bursts": f"WITH {UNITS} SELECT channel_name, root_us, count(*) AS n, max(ts_us) AS end_us FROM burst GROUP BY 1, 2",
    "thread_sizes": f"WITH {MESSAGES} SELECT channel_name, thread_us AS root_us, count(*) AS n FROM messages WHERE thread_us IS NOT NULL GROUP BY 1, 2",
    "kept_units": f"WITH {UNITS} SELECT channel_name, kind, thread_id, start_us, end_us, message_count, len(people)::BIGINT AS n_participants, is_bookmarked, permalink, sha256(raw_text) AS text_sha256 FROM units",
    "windowed_turns": r"""WITH t AS (SELECT conv_id, turn, role, text, (conv_id * 10000 + turn) * 60000000 AS ts_us FROM conversations WHERE trim(coalesce(text, '')) <> ''),
        p AS (SELECT *, ((row_number() OVER (PARTITION BY conv_id ORDER BY ts_us, role, text) - 1) // 3)::INT AS piece FROM t)
        SELECT conv_id * 600000000000 AS root_us, piece, count(*) AS n, (min(ts_us) // 1000000) || '.000000' AS thread_id FROM p GROUP BY conv_id, piece""",
    "signal": f"WITH {MESSAGES} SELECT NOT (event_id % 12 IN (2, 7)) OR (event_id % 12 = 2 AND false) AS carries, count(*) AS n FROM messages GROUP BY 1",
    "gap_report": f"""WITH {MESSAGES}, g AS (SELECT channel_name, ts_us - lag(ts_us) OVER (PARTITION BY channel_name ORDER BY ts_us) AS gap FROM messages WHERE thread_us IS NULL),
        r AS (SELECT channel_name, gap, row_number() OVER (PARTITION BY channel_name ORDER BY gap) AS k, count(*) OVER (PARTITION BY channel_name) AS n FROM g WHERE gap IS NOT NULL),
        s AS (SELECT channel_name, max(CASE WHEN k = least(n, greatest(round_even(0.5 * n, 0)::BIGINT, 1)) THEN gap END) / 1e6 AS p50_gap, max(CASE WHEN k = least(n, greatest(round_even(0.9 * n, 0)::BIGINT, 1)) THEN gap END) / 1e6 AS p90_gap, max(gap) / 1e6 AS max_gap FROM r GROUP BY 1),
        c AS (SELECT channel_name, sum((thread_us IS NULL)::BIGINT)::BIGINT AS loose_messages FROM messages GROUP BY 1)
        SELECT channel_name, loose_messages, coalesce(p50_gap, 0) AS p50_gap, coalesce(p90_gap, 0) AS p90_gap, coalesce(max_gap, 0) AS max_gap, loose_messages > 3 AND coalesce(p90_gap, 0) < 120 AS degenerate FROM c LEFT JOIN s USING (channel_name)""",
    "recent_units": f"""WITH {UNITS}, par AS (SELECT channel_name, ts_us AS start_us, any_value(ts_us % 3) AS reply_count, any_value(ts_us + 1) AS latest_us FROM messages WHERE thread_us = ts_us GROUP BY 1, 2),
        c AS (SELECT u.channel_name, u.thread_id, message_count + coalesce(reply_count, 0) AS size, greatest(end_us, coalesce(latest_us, end_us)) AS last_us, coalesce(reply_count, 0) > 0 AS is_thread FROM allunits u LEFT JOIN par USING (channel_name, start_us)),
        r AS (SELECT *, row_number() OVER (PARTITION BY channel_name ORDER BY last_us DESC, thread_id)::INT AS rank FROM c) SELECT channel_name, rank, thread_id, size, last_us, is_thread FROM r WHERE rank <= 5""",
    "references": f"""WITH {REFS} SELECT channel_name, thread_id, kind, array_to_string(pr_refs, '|') AS pr_refs, array_to_string(commit_shas, '|') AS commit_shas, array_to_string(ticket_refs, '|') AS ticket_refs,
        array_to_string(file_paths, '|') AS file_paths, array_to_string({firsts('file_basenames')}, '|') AS file_basenames, array_to_string(raw_symbols, '|') AS symbols FROM docs""",
    "distinctive": f"WITH {REFS}, s AS (SELECT unnest(raw_symbols) AS symbol FROM docs) SELECT symbol, count(*) AS n FROM s WHERE length(symbol) >= 4 AND regexp_matches(symbol, '_|\\.|[a-z][A-Z]') GROUP BY 1",
    "selection_symbols": r"""SELECT p_partkey AS selection_id, 'retry_limit_' || (p_partkey % 30) || '|RETRY_LIMIT_MAX|PartHandler|load_part' AS symbols, 'retry_limit_' || (p_partkey % 30) AS enclosing,
        CASE WHEN p_partkey % 2 = 0 THEN 'webhooks/delivery' || (p_partkey % 40) || '.py' ELSE 'lib/file' || (p_partkey % 60) || '.ts' END || ' (names: retry_limit_' || (p_partkey % 30) || ', RETRY_LIMIT_MAX, PartHandler, load_part)' AS description FROM part""",
    "declared": r"""WITH p AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'webhooks/delivery' || (p_partkey % 40) || '.py' ELSE 'lib/file' || (p_partkey % 60) || '.ts' END || '#' || p_partkey AS file_path, p_partkey FROM part)
        SELECT file_path, 'retry_limit_' || (p_partkey % 30) AS name, 0::INT AS line_start, 1::INT AS line_end FROM p UNION ALL SELECT file_path, 'PartHandler', 2, 3 FROM p""",
    "parsed_summaries": r"""SELECT doc_id, sha256(CASE doc_id % 4 WHEN 1 THEN 'Summary ' || doc_id WHEN 3 THEN 'Only text' ELSE substring(coalesce(text, ''), 1, 600) END) AS summary_sha256, CASE WHEN doc_id % 4 = 1 THEN 'a_b|C' ELSE '' END AS symbols FROM documents""",
    "document_hashes": f"WITH {UNITS} SELECT channel_name, thread_id, sha256(raw_text) AS content_hash, sha256('p|T|' || channel_id || '|' || thread_id)[1:40] AS private_id, ts_start, ts_end, substring(raw_text, 1, 40) AS summary FROM units",
    "new_messages": f"WITH {MESSAGES}{CHECKPOINT} SELECT m.channel_name, count(*) AS n, min(ts_us) AS first_us FROM messages m LEFT JOIN checkpoint c USING (channel_name) WHERE ts_us > coalesce(last_us, 0) GROUP BY 1",
    "read_bound": f"WITH {MESSAGES}{CHECKPOINT} SELECT greatest(coalesce(min(last_us) - (2700 + 14 * 86400) * 1000000::BIGINT, 0), 0)::BIGINT AS from_us FROM checkpoint",
    "affected": f"""WITH {UNITS}{CHECKPOINT}, nw AS (SELECT m.* FROM messages m LEFT JOIN checkpoint c USING (channel_name) WHERE ts_us > coalesce(last_us, 0)),
        b AS (SELECT * FROM burst SEMI JOIN (SELECT DISTINCT channel_name, root_us FROM burst SEMI JOIN nw USING (channel_name, ts_us)) USING (channel_name, root_us)),
        a AS (SELECT channel_name, thread_us, ts_us FROM b UNION ALL SELECT channel_name, thread_us, ts_us FROM messages SEMI JOIN nw USING (channel_name, thread_us) WHERE thread_us IS NOT NULL)
        SELECT channel_name, thread_us IS NOT NULL AS threaded, count(*) AS n, sum(ts_us % 1009)::BIGINT AS checksum FROM a GROUP BY 1, 2""",
    "deduped": f"""WITH {MESSAGES} SELECT channel_id, count(*) AS n, 0::BIGINT AS second FROM messages GROUP BY 1""",
    "backfill_checkpoint": f"WITH {UNITS} SELECT channel_name, max(end_us) AS last_us FROM units GROUP BY 1",
    "incremental_sync": f"WITH {UNITS} SELECT channel_name, count(*) AS n, sum(message_count)::BIGINT AS messages FROM units GROUP BY 1",
    "reconcile_report": f"""WITH {UNITS}, n AS (SELECT ts_start % 10 AS r FROM units) SELECT CASE r WHEN 0 THEN 'missing' WHEN 1 THEN 'changed' ELSE 'same' END AS status, count(*) AS n FROM n GROUP BY 1 UNION ALL SELECT 'stale', count(*) FROM n WHERE r = 2 HAVING count(*) > 0""",
    "reconciled": f"WITH {UNITS} SELECT 'same' AS status, count(*) AS n FROM units",
    "channel_documents": f"WITH {UNITS} SELECT thread_id, ts_start, message_count FROM units WHERE channel_name = 'ch1' AND ts_start >= 1705000000",
    "requested_units": f"""WITH {UNITS}, k AS (SELECT DISTINCT channel_name, kind, root_us FROM parts WHERE ts_us % 50 = 0) SELECT channel_name, true AS is_bookmarked, count(*) AS n, sum(message_count)::BIGINT AS messages FROM allunits SEMI JOIN k USING (channel_name, kind, root_us) GROUP BY 1""",
    "found_units": f"""WITH {UNITS}, a AS (SELECT DISTINCT channel_id, ts_us, channel_name, kind, root_us, piece AS own FROM parts WHERE ts_us % 50 = 0), p AS (SELECT DISTINCT channel_name, kind, root_us, piece FROM parts)
        SELECT channel_id, count(*) AS pieces, sum((piece = own)::BIGINT)::BIGINT AS holding FROM a JOIN p USING (channel_name, kind, root_us) GROUP BY 1""",
    "upserted": f"WITH {UNITS} SELECT channel_name, count(*) AS n, sum((ts_start % 3 = 0)::BIGINT)::BIGINT AS fresh FROM units GROUP BY 1",
    "after_deletes": f"WITH {UNITS} SELECT channel_name, count(*) AS n FROM units WHERE ts_start % 4 <> 0 AND channel_name <> 'ch2' GROUP BY 1",
    "status": f"WITH {UNITS}{CHECKPOINT} SELECT channel_name, count(*) AS documents, (SELECT count(*) FROM units) AS total, (SELECT min(last_us) FROM checkpoint) AS covered_us, (SELECT count(*) = 0 FROM checkpoint) AS never_run FROM units GROUP BY 1",
    "blame_dump": f"WITH {BLAME} SELECT selection_id, sha, lines, author, ts, summary FROM owned WHERE lines > 0",
    "dominant_commits": f"WITH {BLAME} SELECT selection_id, sha7, lines, uncommitted, CASE WHEN summary = 'misc' THEN NULL ELSE regexp_extract(summary, '#(\\d+)', 1)::INT::VARCHAR END AS pr_number FROM commits0 WHERE rank = 1",
    "forge_prs": f"WITH {BLAME} SELECT sha, forge_pr FROM forge",
    "blame_summaries": f"WITH {BLAME} SELECT selection_id, len(list_distinct(authors0))::BIGINT AS n_authors, dominant_sha, n_commits, pr_number::VARCHAR AS pr_number, coalesce(array_to_string({firsts('prs0')}, '|'), '') AS pr_numbers, commit_date, uncommitted FROM blame",
    "exact_hits": f"WITH {REFS},{BLAME}{SELECTIONS} SELECT selection_id, rank::INT AS rank, strength::INT AS strength, ts_end, channel_name, thread_id FROM exact",
    "nearest": f"WITH {QUERYSET} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM knn",
    "unit_vectors": "WITH v AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]])) AS n FROM embeddings) SELECT doc_id, round(list_sum([(x / n) ** 2 FOR x IN v]), 6) AS norm, round(v[1] / n, 6) AS first FROM v",
    "best_words": f"WITH {WORDS} SELECT query_id, doc_id, round(score, 5) AS score, rank FROM words",
    "fused": f"WITH {WORDS} SELECT selection_id, doc_id, round(fused_score, 6) AS fused_score, round(dense_score, 6) AS dense_score, rank FROM fused",
    "weighted": f"WITH {WORDS} SELECT selection_id, doc_id, round(score, 6) AS score FROM wt",
    "floored": f"WITH {WORDS} SELECT selection_id, count(*) AS n, round(max(best_dense), 6) AS best_dense FROM near GROUP BY 1",
    "assembled": f"WITH {WORDS} SELECT selection_id, doc_id, match_type, exact_strength, round(score, 6) AS score, citation FROM hits",
    "gated": f"WITH {WORDS} SELECT selection_id, round(best_dense, 6) AS best_dense, has_exact, is_null FROM gate",
    "hit_counts": f"""WITH {WORDS}, n AS (SELECT selection_id, count(*) AS n, bool_or(match_type = 'exact') AS e FROM hits GROUP BY 1)
        SELECT selection_id, CASE WHEN coalesce(is_null, true) THEN 0 ELSE coalesce(n, 0) END::BIGINT AS n, NOT coalesce(is_null, true) AND coalesce(e, false) AS has_exact FROM sels LEFT JOIN n USING (selection_id) LEFT JOIN gate USING (selection_id)""",
    "result_rows": f"WITH {WORDS} SELECT selection_id, citation::INT AS citation, doc_id, match_type, source AS channel_name, 'p' || doc_id AS permalink, strftime(make_timestamp(ts_start * 1000000), '%Y-%m-%d') AS date, marked AS is_bookmarked, round(score, 6) AS score FROM hits JOIN facts USING (doc_id)",
    "private_hits": f"""WITH {WORDS}, pw AS (SELECT k.query_id AS selection_id, k.doc_id, k.score AS dense_score FROM knn k JOIN facts USING (doc_id)),
        pn AS (SELECT * FROM (SELECT *, max(dense_score) OVER (PARTITION BY selection_id) AS b FROM pw) WHERE dense_score >= least(b * 0.85, 0.7121)),
        a AS (SELECT selection_id, doc_id, 1 AS e FROM ex UNION ALL SELECT selection_id, doc_id, 0 FROM pn ANTI JOIN ex USING (selection_id, doc_id))
        SELECT selection_id, least(count(*), 5) AS n, sum(e)::BIGINT AS exact FROM a GROUP BY 1""",
    "reasons": f"""WITH {REFS},{BLAME}{SELECTIONS},
        h AS (SELECT e.*, d.pr_refs, d.commit_shas, d.file_paths, d.file_basenames, d.people, b.prs0, b.all_shas, b.authors0, s.file_path, split_part(s.file_path, '/', -1) AS base
              FROM exact e JOIN docs d ON e.channel_name = d.channel_name AND e.thread_id = d.thread_id AND e.ts_end = d.ts_end JOIN sel s USING (selection_id) LEFT JOIN blame b USING (selection_id))
        SELECT selection_id, rank, coalesce('mentions pull request ' || list_min(list_intersect(pr_refs, prs0)), 'mentions commit ' || list_min(list_intersect(commit_shas, all_shas)), CASE WHEN list_contains(file_paths, file_path) THEN 'mentions path ' || file_path END,
                   CASE WHEN list_contains(file_basenames, base) THEN 'mentions file ' || base END, 'has a message by the author ' || list_min(list_intersect(people, authors0)), 'close in meaning') AS reason,
               ['mentions a name from the code', 'mentions the file by its name', 'mentions the path of the file', 'mentions a commit behind the code', 'mentions a pull request behind the code'][strength] AS match FROM h""",
    "verdicts": f"""WITH {WORDS}, v(citation, ord, rel, said) AS (VALUES (3, 0, true, 'good'), (2, 1, false, ''), (99, 2, true, ''), (1, 3, true, 'first')),
        h AS (SELECT h.*, floor(h.selection_id / 100)::BIGINT % 4 <> 3 AS readable FROM hits h),
        j AS (SELECT h.*, v.ord, coalesce(v.rel, true) AS rel, coalesce(v.said, '') AS said FROM h LEFT JOIN v ON h.readable AND h.citation = v.citation),
        o AS (SELECT *, row_number() OVER (PARTITION BY selection_id ORDER BY (match_type <> 'exact')::INT, CASE WHEN match_type = 'exact' THEN -exact_strength ELSE 0 END, CASE WHEN match_type = 'exact' THEN 0 ELSE coalesce(ord, 1000000) END, citation) AS pos FROM j WHERE match_type = 'exact' OR rel)
        SELECT selection_id, pos AS place, doc_id, CASE WHEN match_type = 'exact' THEN ['mentions a name from the code', 'mentions the file by its name', 'mentions the path of the file', 'mentions a commit behind the code', 'mentions a pull request behind the code'][exact_strength] ELSE said END AS why FROM o WHERE pos <= 5""",
    "conflict_pairs": f"WITH {WORDS}, n AS (SELECT selection_id, count(*) AS n FROM hits GROUP BY 1 HAVING count(*) >= 2) SELECT selection_id, 1 AS a, 2 AS b, 'conflict' AS kind FROM n UNION ALL SELECT selection_id, 2, 1, 'supersede' FROM n",
    "prompts": f"""WITH {WORDS} SELECT selection_id, sha256(string_agg('[' || citation || '] #' || coalesce(source, '?') || ' ' || strftime(make_timestamp(ts_start * 1000000), '%Y-%m-%d') || chr(10) || '    ' || substring(coalesce(lang, ''), 1, 500), chr(10) ORDER BY citation)) AS sha256 FROM hits JOIN facts USING (doc_id) GROUP BY 1""",
    "graph_edges": f"WITH {GRAPH} SELECT type, confidence, count(*) AS n FROM edges GROUP BY 1, 2",
    "timelines": f"WITH {TIMELINE} SELECT selection_id, row_number() OVER (PARTITION BY selection_id ORDER BY id <> 'code', row_ts NULLS LAST, place) AS row, id, type, row_ts FROM placed WHERE parent IS NULL",
    "timeline_links": f"""WITH {TIMELINE}, ends AS (SELECT e.selection_id, coalesce(x.parent, x.id) AS p, coalesce(y.parent, y.id) AS q, e.type FROM edges e JOIN placed x ON x.selection_id = e.selection_id AND x.id = e.source JOIN placed y ON y.selection_id = e.selection_id AND y.id = e.target)
        SELECT DISTINCT selection_id, least(p, q) AS a, greatest(p, q) AS b, type FROM ends WHERE p <> q""",
    "graph_nodes": f"""WITH {GRAPH}, nodes AS (
        SELECT selection_id, 'code' AS id, 'Code' AS type, false AS dated FROM (SELECT selection_id FROM cm UNION SELECT selection_id FROM g)
        UNION SELECT selection_id, 'commit:' || sha7, 'Commit', true FROM cm UNION SELECT selection_id, 'person:' || author, 'Person', false FROM cm
        UNION SELECT selection_id, 'pr:' || pr_number, 'PullRequest', true FROM allprs UNION SELECT selection_id, 'ticket:' || key, 'Ticket', false FROM allprs JOIN tk USING (pr_number)
        UNION SELECT selection_id, 'slack', 'SlackThread' || thread, true FROM g UNION SELECT selection_id, 'ticket:' || key, 'Ticket', false FROM tref WHERE key IN (SELECT key FROM tk)),
        s AS (SELECT selection_id, id, max(dated) AS dated FROM (SELECT selection_id, 'sentry:' || id AS id, 1 AS dated FROM allprs JOIN inc USING (pr_number) UNION ALL SELECT selection_id, 'sentry:' || key, 0 FROM tref WHERE key IN (SELECT id FROM inc) AND key NOT IN (SELECT key FROM tk)) GROUP BY 1, 2)
        SELECT CASE WHEN id = 'slack' THEN 'SlackThread' ELSE type END AS type, count(*) AS n, sum(dated::BIGINT)::BIGINT AS dated FROM nodes GROUP BY 1 UNION ALL SELECT 'SentryIssue', count(*), sum(dated)::BIGINT FROM s HAVING count(*) > 0""",
    "commit_chains": f"WITH {GRAPH}, e AS (SELECT * FROM chain UNION SELECT selection_id, 'pr:' || pr_number, 'ticket:' || key, 'TRACKED_BY', 'exact' FROM onmap JOIN tk USING (pr_number) UNION SELECT selection_id, 'pr:' || pr_number, 'sentry:' || id, 'RELATED_TO', 'exact' FROM onmap JOIN inc USING (pr_number)) SELECT type, count(*) AS n FROM e GROUP BY 1",
    "release_incidents": f"WITH {GRAPH} SELECT number AS pr_number, id FROM inc JOIN prs ON merge_commit_sha = first_release",
    "fused_planes": f"WITH {PLANES} SELECT selection_id, citation, doc_id, scope, old FROM planes",
    "remapped_text": f"""WITH {PLANES}, m AS (SELECT selection_id, max(CASE WHEN old = 1 THEN citation END) AS a, max(CASE WHEN old = 2 THEN citation END) AS b, max(CASE WHEN old = 3 THEN citation END) AS c FROM planes WHERE plane = 0 GROUP BY 1)
        SELECT DISTINCT selection_id, 'see [' || coalesce(a, 1) || '] and [' || coalesce(b, 2) || '], then [' || coalesce(c, 3) || '][99]' AS synthesis FROM planes LEFT JOIN m USING (selection_id)""",
    "plane_counts": f"WITH {PLANES} SELECT selection_id, sum((plane = 0)::BIGINT)::BIGINT AS workspace, sum((plane = 1)::BIGINT)::BIGINT AS private FROM planes GROUP BY 1",
    "marker_ranks": f"""WITH {WORDS}, wanted AS (SELECT item_id * 100 AS case_id, upper(split_part(text, ' ', 1)) AS marker FROM benchmark),
        r AS (SELECT h.selection_id AS case_id, marker, min(citation) AS rank FROM hits h JOIN documents d USING (doc_id) JOIN wanted w ON w.case_id = h.selection_id WHERE d.source = 'src3' AND contains(lower(' ' || d.text), lower(marker)) GROUP BY 1, 2)
        SELECT w.case_id, w.marker, rank::VARCHAR AS rank, rank IS NOT NULL AS passed FROM wanted w LEFT JOIN r USING (case_id, marker)""",
    "calibration": f"""WITH {WORDS}, c AS (SELECT max(CASE WHEN selection_id % 300 = 0 THEN best_dense END) AS best_null, min(CASE WHEN selection_id % 300 <> 0 THEN best_dense END) AS worst_hit FROM gate)
        SELECT best_null, worst_hit, CASE WHEN best_null < worst_hit THEN (best_null + worst_hit) / 2 END AS threshold FROM c""",
}
