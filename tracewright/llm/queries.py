"""The registered queries of this subpackage: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .edit_fingerprint import half_edits, similar_prints
from .exact_dedup import bare, exact_duplicates
from .itq_links import link_vectors
from .kneser_ney import perplexity
from .lexical_tree import rank_documents
from .mixing import mix_sources
from .sentencepiece_bpe import encode_pieces
from .shared import settle
from .substring_dedup import cut_repeats
from .threshold_kmeans import cluster_vectors
from .url_filters import judge_urls
from .warc import archive_round_trip
from .weighted_minhash import near_duplicates

RULES = "VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM {RULES} AS t(rule, action)")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op2_itq_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(table(spark, sf_dir, "embeddings")).select("vec_id", "n_links", "component_id", "kept")


def piece_model() -> str:
    """The path of the public SentencePiece model: a parameter of the installation."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model())
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "component_id", "kept")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html")).filter("kind in ('response', 'revisit')")
    return rows.select("page_id", "payload_bytes", "payload_digest", F.col("kind").alias("record_type"), "refers_to")


def op7_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = settle(half_edits(table(spark, sf_dir, "documents").select("doc_id", "text")), "edits")
    classes = similar_prints(out.select("doc_id", "fingerprint")).withColumnRenamed("doc_id", "id")
    return out.join(classes, out.doc_id == classes.id, "left").drop("id")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = perplexity(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_threshold_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ",").cast("binary"), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op12_lexical_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(bare(F.col("text")), 256).alias("text_sha256"))
    return exact_duplicates(docs, texts=False).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filters": op1_url_filters,
    "op2_itq_links": op2_itq_links,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_minhash": op4_minhash,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_edit_fingerprint": op7_edit_fingerprint,
    "op8_mixing": op8_mixing,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_threshold_kmeans": op11_threshold_kmeans,
    "op12_lexical_tree": op12_lexical_tree,
    "op13_exact_dedup": op13_exact_dedup,
}



def _kmeans_sql(rounds: int = 10) -> str:
    near = """a{r} AS MATERIALIZED (SELECT vec_id, n, v, best.d AS d, best.c AS c FROM (
            SELECT e.vec_id, e.n, any_value(e.v) AS v, min({{'d': list_sum([(e.v[i] - k.v[i]) * (e.v[i] - k.v[i]) FOR i IN range(1, 65)])::BIGINT, 'c': k.c}}) AS best FROM e, k{r} AS k GROUP BY e.vec_id, e.n))"""
    moved = """s{r} AS (SELECT c, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{r}, unnest(range(1, 65)) AS u(i) GROUP BY c, i),
        g{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{r} GROUP BY c),
        k{q} AS MATERIALIZED (SELECT k.c, coalesce(g.v, k.v) AS v FROM k{r} AS k LEFT JOIN g{r} AS g USING (c))"""
    steps = ",\n        ".join(x for r in range(rounds) for x in (near.format(r=r), moved.format(r=r, q=r + 1)))
    return f"""
        WITH e AS MATERIALIZED (
            SELECT vec_id, row_number() OVER () AS n, [floor(1024 * x)::BIGINT FOR x IN embedding::DOUBLE[]] AS v FROM embeddings
            WHERE len(embedding) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
        k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM e WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT 8)),
        {steps},
        {near.format(r=rounds)},
        t AS (SELECT c, sum(d)::BIGINT AS own FROM a{rounds} GROUP BY c)
        SELECT vec_id, c::INT AS cluster, d AS distance, own AS cluster_inertia, (SELECT sum(own)::BIGINT FROM t) AS inertia, sha256(array_to_string(k.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN t USING (c) JOIN k{rounds} AS k USING (c)"""


ORACLES: dict[str, str] = {
    "op1_url_filters": r"""
        WITH p AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)\A.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)\A.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        r(rule, rh, rp, action) AS (VALUES ('net/', 'net', '/', 'block'), ('example.net/en/', 'example.net', '/en/', 'allow'),
                                           ('example.com/de/', 'example.com', '/de/', 'block'), ('org/fr/', 'org', '/fr/', 'allow')),
        j AS (
            SELECT p.*, r.rule, r.action, row_number() OVER (PARTITION BY page_id, host, path ORDER BY length(r.rule) DESC NULLS LAST) AS k
            FROM p LEFT JOIN r ON (p.host = r.rh OR ends_with(p.host, '.' || r.rh)) AND starts_with(p.path, r.rp))
        SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM j WHERE k = 1""",
    "op2_itq_links": """
        WITH RECURSIVE e AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
            WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding]) AND list_sum([x * x FOR x IN embedding::DOUBLE[]]) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98),
        r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
        c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(c.least, vec_id))::BIGINT AS component_id, vec_id = least(vec_id, coalesce(c.least, vec_id)) AS kept
        FROM embeddings LEFT JOIN n ON n.a = vec_id LEFT JOIN c ON c.a = vec_id""",
    "op9_substring_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        w AS (SELECT doc_id, i, ws[i:i + 12] AS win FROM t, unnest(range(1, greatest(1, len(ws) - 11))) AS u(i)),
        m AS (SELECT win, min(doc_id) AS least FROM w GROUP BY win),
        bad AS (SELECT w.doc_id, w.i FROM w JOIN m USING (win) WHERE m.least < w.doc_id),
        gone AS (SELECT DISTINCT doc_id, i + k AS i FROM bad, unnest(range(0, 13)) AS u(k)),
        per AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
        SELECT t.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(per.gone), 0)::BIGINT AS n_removed,
               sha256(coalesce(array_to_string([ws[i] FOR i IN range(1, len(ws) + 1) IF per.gone IS NULL OR NOT list_contains(per.gone, i)], ' '), '')) AS kept_sha256
        FROM t LEFT JOIN per USING (doc_id)""",
    "op11_threshold_kmeans": _kmeans_sql(),
    "op12_lexical_tree": r"""
        WITH w AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
        d AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
        t AS (SELECT count(*) AS dn, sum(n)::BIGINT AS dl FROM d),
        q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
        p AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term IN (SELECT term FROM q) GROUP BY doc_id, term),
        f AS (SELECT term, floor(1000 * ln((2 * dn + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), t),
        m AS (SELECT doc_id, 50 + (50 * n * dn) // dl AS m FROM d, t),
        s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN p USING (term) JOIN f USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
        r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50""",
    "op13_exact_dedup": r"""
        WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
        g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g""",
}
