"""Views that project general tables (orders, events, documents ...) onto the shapes the jobs read, by
plain deterministic expressions, so that every job can run over tables of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions.clean import to_messages
from ..functions.extract import code_symbols
from ..operators.documents import build_documents
from ..operators.segment import segment, unit_messages
from ..schemas import REACTIONS
from ..settings import DEFAULTS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEXTS = """
    CASE event_id % 12
        WHEN 0 THEN concat('please look at https://github.com/acme/app/pull/', event_id % 1000000, ' before release')
        WHEN 1 THEN concat('merged PR and #', event_id % 1000000, ' into the branch')
        WHEN 2 THEN concat('lunch at #', event_id % 50)
        WHEN 3 THEN concat('commit ', substring(sha1(concat(event_id, '-1')), 1, 9), ' broke webhooks/delivery', event_id % 40, '.py')
        WHEN 4 THEN concat('ticket ENG-', div(event_id, 12) % 100000, ' and OPS-', event_id % 20, ' are open')
        WHEN 5 THEN concat('see `retry_limit_', event_id % 30, '` and RETRY_LIMIT_MAX in services/file', event_id % 60, '.ts')
        WHEN 6 THEN 'WebhookRetryPolicy is wrong in RetryHandler'
        WHEN 7 THEN 'lol'
        WHEN 8 THEN concat('ok thanks <@U', user_id, '> &amp; all')
        WHEN 9 THEN 'docs at <https://example.com/x|label> in <#C1|general> &amp;lt;'
        WHEN 10 THEN concat('incident INC-', div(event_id, 12) % 100000, ' caused by abcdef1')
        ELSE concat('a plain message about nothing ', event_id)
    END"""


def raw_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw chat messages: ten channels, threads of clicks and purchases by day, the rest loose."""
    e = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "user_id", "event_type", "value")
    e = e.withColumn("ch", F.col("user_id") % 10).withColumn("threaded", F.col("event_type").isin("click", "purchase"))
    day = F.floor(F.col("ts_us") / 86_400_000_000)
    root = F.min("ts_us").over(Window.partitionBy("ch", day, F.col("user_id") % 3, "threaded"))
    seconds = lambda c: F.concat((c / 1_000_000).cast("long").cast("string"), F.lit("."), F.lpad((c % 1_000_000).cast("string"), 6, "0"))
    names = F.when((F.col("event_type") == "purchase") & (F.col("value") > 100), F.array(F.lit("bookmark"))).when((F.col("event_type") == "error") & (F.col("value") > 50), F.array(F.lit("warning"), F.lit("eyes"))).when((F.col("event_type") == "view") & (F.col("value") > 10), F.array(F.lit("eyes"))).otherwise(F.array().cast("array<string>"))
    reactions = F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(1).alias("count"), F.array().cast("array<string>").alias("users"))).cast(REACTIONS)
    bot = F.col("event_id") % 40 == 3
    return e.withColumn("root", F.when(F.col("threaded"), root)).select(
        "event_id", F.col("event_id").cast("string").alias("client_msg_id"), F.when(F.col("event_id") % 97 == 5, "file").otherwise("message").alias("type"), F.when(F.col("event_id") % 50 == 7, "channel_join").alias("subtype"),
        F.when(~bot, F.concat(F.lit("U"), F.col("user_id").cast("string"))).alias("user"), F.when(bot, F.concat(F.lit("B"), (F.col("user_id") % 5).cast("string"))).alias("bot_id"),
        F.when(bot, F.concat(F.lit("bot"), (F.col("user_id") % 5).cast("string"))).alias("username"), F.expr(TEXTS).alias("text"), seconds(F.col("ts_us")).alias("ts"), seconds(F.col("root")).alias("thread_ts"),
        reactions.alias("reactions"), F.concat(F.lit("C"), F.col("ch").cast("string")).alias("channel_id"), F.concat(F.lit("ch"), F.col("ch").cast("string")).alias("channel_name"), (F.col("ch") % 3 + 1).cast("int").alias("channel_tier"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    return u.select(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id"), F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("name"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted (memory, then disk): jobs read them several times, as they would read a table."""
    return to_messages(raw_messages(spark, sf_dir), users(spark, sf_dir)).persist()


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_messages(messages(spark, sf_dir))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segment(messages(spark, sf_dir)).persist()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build_documents(units(spark, sf_dir)).persist()


def written_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a table; neither they nor their units are kept beside it."""
    m = messages(spark, sf_dir)
    out = checkpointed(build_documents(segment(m)))
    m.unpersist()
    return out


def line_commits(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Line items as commits that own lines of a part's file; a commit may come in several rows. ``dealt``: shuffled by
    file, before hashes and texts are made of their numbers."""
    li = table(spark, sf_dir, "lineitem")
    li = li.repartition("l_partkey") if dealt else li
    key = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    sha = F.when((F.col("l_orderkey") % 20 == 3) & (F.col("l_linenumber") == 2), F.lit("0" * 40)).otherwise(F.sha1(key.cast("binary")))
    n = (F.col("l_orderkey") % 1_000_000).cast("string")
    subject = F.when(F.col("l_returnflag") == "A", F.concat(F.lit("Fix it (#"), n, F.lit(")"))).when(F.col("l_returnflag") == "N", F.concat(F.lit("Merge pull request #"), n, F.lit(" from x"))).otherwise(F.lit("misc"))
    return li.select(F.col("l_partkey").alias("selection_id"), sha.alias("sha"), F.col("l_quantity").cast("long").alias("lines"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first_line"),
        F.concat(F.lit("user"), F.col("l_suppkey").cast("string")).alias("author"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).cast("double").alias("ts"), subject.alias("summary"))


def owned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commits of each part's file, once each; dealt by file, as all that follows needs them."""
    return line_commits(spark, sf_dir, dealt=True).groupBy("selection_id", "sha").agg(F.sum("lines").alias("lines"), *[F.min(c).alias(c) for c in ("first_line", "author", "ts", "summary")])


def prs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pull requests; open ones aren't merged. Some list a commit of a line item."""
    o = table(spark, sf_dir, "orders")
    sha = F.sha1(F.concat(F.col("o_orderkey").cast("string"), F.lit("-1")).cast("binary"))
    merged = F.when(F.col("o_orderstatus") != "O", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return o.select(
        F.col("o_orderkey").cast("int").alias("number"), F.concat(F.lit("Change "), F.col("o_orderkey").cast("string")).alias("title"), F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("author"),
        merged.alias("merged_at"), F.array(F.when(F.col("o_orderkey") % 2 == 0, F.substring(sha, 1, 7)).otherwise(sha)).alias("commit_shas"), F.when(F.col("o_orderstatus") != "O", sha).alias("merge_commit_sha"))


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.concat(F.lit("ENG-"), F.col("c_custkey").cast("string")).alias("key"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("status"), F.lit("x").alias("assignee"), (F.col("c_custkey") * 2).cast("int").alias("pr_number"))


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.concat(F.lit("INC-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"), F.date_format(F.timestamp_seconds(F.col("s_suppkey") * 1_000_000), "yyyy-MM-dd").alias("first_seen"), F.lit("open").alias("status"),
        (F.col("s_suppkey") * 3).cast("int").alias("pr_number"), F.lit(None).cast("string").alias("url"), F.sha1(F.concat((F.col("s_suppkey") * 2).cast("string"), F.lit("-1")).cast("binary")).alias("first_release"))


CODE = "concat('def retry_limit_', p_partkey % 30, '(self):\\n    return RETRY_LIMIT_MAX + load_part(', p_partkey, ')\\nclass PartHandler:\\n    pass\\n')"


def selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    path = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("webhooks/delivery"), (F.col("p_partkey") % 40).cast("string"), F.lit(".py"))).otherwise(F.concat(F.lit("lib/file"), (F.col("p_partkey") % 60).cast("string"), F.lit(".ts")))
    code = F.expr(CODE)
    return p.select(F.col("p_partkey").alias("selection_id"), path.alias("file_path"), code.alias("code")).withColumn("symbols", code_symbols(F.col("code")))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 asks, against all."""
    return table(spark, sf_dir, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def query_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") * 100).alias("query_id"), "text")


def lexical_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("raw_text"), F.col("source").alias("summary"), F.col("lang").alias("symbols"))


def doc_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", (F.col("doc_id") * 86_400).alias("ts_start"), (F.col("doc_id") * 86_400 + 60).alias("ts_end"), F.array(F.concat(F.lit("user"), (F.col("doc_id") % 7).cast("string"))).alias("participants"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("channel_tier"), (F.col("doc_id") % 5 == 0).alias("is_bookmarked"), F.col("source").alias("channel_name"), F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("permalink"), F.col("lang").alias("summary"), F.lit(1).cast("long").alias("message_count"))


def query_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = query_vectors(spark, sf_dir).select(F.col("query_id").alias("selection_id")).unionByName(query_texts(spark, sf_dir).select(F.col("query_id").alias("selection_id"))).distinct()
    return q.select("selection_id", F.array(F.concat(F.lit("user"), (F.col("selection_id") % 7).cast("string"))).alias("authors"), F.when(F.col("selection_id") % 300 != 0, (F.col("selection_id") * 86_400).cast("double")).alias("commit_ts"))


def exact_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact hits of the query set: the document with a selection's own number, by its remainder's kind."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    q = query_facts(spark, sf_dir).select("selection_id")
    return q.join(d, F.col("doc_id") == F.col("selection_id") + 1).select("selection_id", "doc_id", (F.col("selection_id") / 100 % 5 + 1).cast("int").alias("strength"), (F.col("doc_id") * 86_400 + 60).alias("ts_end"), F.lit(1).alias("rank"))


def turn_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as threads of one channel for each role's first letter, a turn a minute."""
    c = table(spark, sf_dir, "conversations")
    at = (F.col("conv_id") * 10_000 + F.col("turn")) * 60_000_000
    return c.filter("trim(coalesce(text, '')) <> ''").select(F.lit("CT").alias("channel_id"), F.lit("turns").alias("channel_name"), F.lit(DEFAULTS.default_tier).alias("channel_tier"), F.col("role").alias("user_id"), F.col("role").alias("user_name"), "text", at.alias("ts_us"), (F.col("conv_id") * 600_000_000_000).alias("thread_us"), F.array().cast("array<string>").alias("reactions"))
