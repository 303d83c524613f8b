"""Lexical search that scores only documents which can reach the first ranks: weighted postings, a lower bound
for each query, and terms and blocks of documents that can't get there by themselves."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..checkpoints import written
from ..settings import DEFAULTS, Settings

BLOCK = 8192  # documents that share a bound and are scored together
SLACK = 1e-6  # beyond the rounding of sums
SLICE = 1 << 21  # postings, and sums, held at a time


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def weighted_postings(words: DataFrame, docs: DataFrame, fields: tuple[tuple[str, float], ...], settings: Settings = DEFAULTS, block: int = BLOCK) -> DataFrame:
    """(field, token, block, doc_id, w): what each of ``words`` (token) adds to the score of a field that holds it.

    Only these tokens are counted: a semi-join prunes postings before the counts. Texts are read once, their
    lengths among the counts as those of an empty token; counts, then weights, are tables in the shared folder,
    and so is how many documents hold each token: where that is small, counts meet it without a shuffle."""
    k1, b = settings.bm25_k1, settings.bm25_b
    kind = dict(docs.dtypes)
    text = lambda f: F.array_join(f, " ") if kind[f].startswith("array") else F.col(f)
    fielded = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(w).alias("boost"), tokens(text(f)).alias("toks")) for f, w in fields])).alias("f"))
    fielded = fielded.select("doc_id", "f.field", "f.boost", F.size("f.toks").alias("len"), F.concat("f.toks", F.array(F.lit(""))).alias("toks")).filter("len > 0")
    wanted = words.select("token").unionByName(words.sparkSession.range(1).select(F.lit("").alias("token")))
    tf = written(fielded.select("doc_id", "field", "boost", "len", F.explode("toks").alias("token")).join(wanted, "token", "left_semi").groupBy("doc_id", "field", "boost", "len", "token").agg(F.count("*").alias("tf")))
    totals = tf.filter("token = ''").groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    tf = tf.filter("token <> ''")
    df = tf.groupBy("field", "token").agg(F.count("*").alias("df"))
    known = written(df.join(F.broadcast(totals), "field"))  # a row for each field
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = F.col("boost") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.lit(1))
    return written(tf.join(known, ["field", "token"]).select("field", "token", F.pmod(F.xxhash64("doc_id"), blocks).alias("block"), "doc_id", weight.alias("w")))


def lower_bounds(asked: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): what the ``k``-th score reaches at least, of queries for which that is known. The ``k``
    heaviest postings of each term and field are added up for the documents that they name; the ``k`` documents
    of the largest sums then have all their terms added, and the smallest of these scores is the floor."""
    heaviest = F.row_number().over(Window.partitionBy("field", "token").orderBy(F.col("w").desc(), "doc_id"))
    named = asked.join(posts.withColumn("r", heaviest).filter(F.col("r") <= k), "token").groupBy("query_id", "doc_id", "field").agg(F.sum("w").alias("s"))
    per = named.groupBy("query_id", "doc_id").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("s").desc(), "doc_id"))
    first = written(per.withColumn("r", rank).filter(F.col("r") <= k).select("query_id", "doc_id").join(asked, "query_id"))
    whole = first.join(posts, ["token", "doc_id"]).groupBy("query_id", "doc_id", "field").agg(F.sum("w").alias("s")).groupBy("query_id", "doc_id").agg(F.max("s").alias("s"))
    return whole.groupBy("query_id").agg(F.count("*").alias("n"), F.min("s").alias("floor")).filter(F.col("n") == k).select("query_id", "floor")


def split_terms(asked: DataFrame, posts: DataFrame, k: int) -> DataFrame:
    """(query_id, field, token, most, floor, essential, rest): each query's terms by field. The terms of smallest
    ``most`` (the largest weight) that add up to less than the floor aren't essential: a document with
    none but them falls short in that field. ``rest``: the sum of theirs."""
    most = posts.groupBy("field", "token").agg(F.max("w").alias("most"))
    own = Window.partitionBy("query_id", "field")
    upto = F.sum("most").over(own.orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0))
    rows = asked.join(most, "token").join(lower_bounds(asked, posts, k), "query_id", "left")
    rows = rows.withColumn("essential", F.col("floor").isNull() | (upto >= F.col("floor") - SLACK))
    return rows.withColumn("rest", F.sum(F.when(~F.col("essential"), F.col("most")).otherwise(0.0)).over(own))


def open_blocks(terms: DataFrame, posts: DataFrame) -> DataFrame:
    """(query_id, field, block): where the heaviest postings of a block could add up to the floor."""
    heaviest = posts.groupBy("field", "token", "block").agg(F.max("w").alias("most_here"))
    total = terms.join(heaviest, ["field", "token"]).groupBy("query_id", "field", "block").agg(F.sum("most_here").alias("bound"), F.max("floor").alias("floor"), F.max("essential").alias("any"))
    return total.filter(F.col("any") & (F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - SLACK))).select("query_id", "field", "block")


def scored_postings(terms: DataFrame, posts: DataFrame) -> DataFrame:
    """(query_id, field, doc_id, w, floor, rest): postings of essential terms in open blocks, which are what
    :func:`block_sums` adds up, as rows."""
    asked = terms.filter("essential").select("query_id", "field", "token", "floor", "rest").join(open_blocks(terms, posts), ["query_id", "field"])
    return asked.join(posts, ["field", "token", "block"]).select("query_id", "field", "doc_id", "w", "floor", "rest")


class Postings(NamedTuple):
    """A block's postings by token: those of ``words[t]`` are ``start[t]`` up to ``start[t + 1]``."""

    words: pa.Array
    start: np.ndarray
    docs: pa.Array
    doc: np.ndarray
    w: np.ndarray


def by_token(token: pa.Array, doc_id: pa.Array, w: np.ndarray) -> Postings:
    words, docs = token.dictionary_encode(), doc_id.dictionary_encode()
    code = np.asarray(words.indices)
    order = np.argsort(code, kind="stable")
    start = np.searchsorted(code[order], np.arange(len(words.dictionary) + 1))
    return Postings(words.dictionary, start, docs.dictionary, np.asarray(docs.indices, np.int64)[order], w[order])


def reaching(p: Postings, tokens: pa.ListArray, floor: np.ndarray, rest: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, document, sum) of the documents that hold one of a query's tokens and whose sum, with what other
    terms could add, reaches both its floor and the block's own ``k``-th sum. Queries are taken so many at a
    time that a bounded number of postings and sums is held (one query at least)."""
    code = np.asarray(pc.fill_null(pc.index_in(tokens.flatten(), value_set=p.words), -1), np.int64)
    row = np.repeat(np.arange(len(tokens)), np.asarray(tokens.value_lengths()))[code >= 0]
    code = code[code >= 0]
    size = p.start[code + 1] - p.start[code]
    edge = np.searchsorted(row, np.arange(len(tokens) + 1))
    upto = np.concatenate([[0], np.cumsum(size)])[edge]
    n, a = len(p.docs), 0
    while a < len(tokens):
        b = max(a + 1, min(a + SLICE // n, int(np.searchsorted(upto, upto[a] + SLICE, "right")) - 1))
        part = slice(edge[a], edge[b])
        long = size[part]
        at = np.arange(long.sum()) + np.repeat(p.start[code[part]] - (np.cumsum(long) - long), long)
        cell = np.repeat(row[part] - a, long) * n + p.doc[at]
        total = np.bincount(cell, p.w[at], (b - a) * n).astype(float).reshape(b - a, n)  # whole numbers where nothing is held
        held = np.zeros(total.size, bool)
        held[cell] = True
        total[~held.reshape(total.shape)] = -np.inf
        least = floor[a:b]
        if n >= k:
            least = np.maximum(least, np.partition(total, n - k, axis=1)[:, n - k])
        i, j = np.nonzero(held.reshape(total.shape) & (total + rest[a:b, None] >= least[:, None] - SLACK))
        yield a + i, j, total[i, j]
        a = b


def block_sums(terms: DataFrame, posts: DataFrame, fields: tuple[str, ...], k: int) -> DataFrame:
    """(query_id, field, doc_id, s, floor, rest): the sums of essential terms of the documents that can reach the
    first ``k``. Postings are shuffled once, by block and field; a task holds those of one while the queries
    to which it is open pass by in batches, and returns what :func:`reaching` leaves, so that sums which fall
    short of their own block's ``k``-th are never shuffled. Rows are put in order by one number."""
    named = terms.filter("essential").groupBy("query_id", "field").agg(F.collect_list("token").alias("tokens"), F.max("floor").alias("floor"), F.max("rest").alias("rest"))
    group = (F.col("block") * len(fields) + F.array_position(F.array(*map(F.lit, fields)), F.col("field")) - 1).alias("group")
    q = open_blocks(terms, posts).join(named, ["query_id", "field"]).select(group, F.lit(True).alias("asks"), "query_id", "tokens", "floor", "rest")
    d = posts.join(terms.filter("essential").select("field", "token").distinct(), ["field", "token"], "left_semi").select(group, F.lit(False).alias("asks"), "doc_id", "token", "w")
    kinds = [terms.schema["query_id"].dataType, posts.schema["doc_id"].dataType]
    query_type, doc_type = (to_arrow_type(t) for t in kinds)
    rows = d.unionByName(q, allowMissingColumns=True).withColumn("turn", F.col("group") * 2 + F.col("asks").cast("long"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, whole = None, [], None
        for batch in batches:
            turns = np.asarray(batch.column("turn"))
            first = np.flatnonzero(np.diff(turns, prepend=-1))
            for a, b in zip(first.tolist(), np.append(first[1:], len(turns)).tolist(), strict=True):
                part, own = batch.slice(a, b - a), int(turns[a]) // 2
                if at != own:
                    at, held, whole = own, [], None
                if not turns[a] % 2:
                    held.append(part.select(["doc_id", "token", "w"]))
                    continue
                if held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    whole, held = by_token(t.column("token").combine_chunks(), t.column("doc_id").combine_chunks(), np.asarray(t.column("w"))), []
                if whole is None:
                    continue
                floor, rest = np.asarray(part.column("floor").fill_null(-np.inf)), np.asarray(part.column("rest"))
                for i, j, s in reaching(whole, part.column("tokens"), floor, rest, k):
                    row = pa.array(i)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("query_id").take(row).cast(query_type), pa.array([fields[own % len(fields)]] * len(i), pa.string()), whole.docs.take(pa.array(j)).cast(doc_type), pa.array(s), part.column("floor").take(row), part.column("rest").take(row)],
                        ["query_id", "field", "doc_id", "s", "floor", "rest"])

    ordered = rows.repartition("group").sortWithinPartitions("turn")
    return ordered.mapInArrow(task, f"query_id {kinds[0].simpleString()}, field string, doc_id {kinds[1].simpleString()}, s double, floor double, rest double")


def best_words(queries: DataFrame, docs: DataFrame, fields: tuple[tuple[str, float], ...], k: int, settings: Settings = DEFAULTS, block: int = BLOCK) -> DataFrame:
    """(query_id, doc_id, score, rank): best-field match, the largest over fields of boost times BM25, terms
    joined by or. ``queries``: (query_id, text); array fields count as joined text; null texts hold nothing.

    Documents that can reach the ``k``-th score in a field have an essential term of it (see ``split_terms``) and
    lie in an open block. The sums of essential terms that these have raise the floor once more; of the
    documents only those whose sum and what other terms could add reach it have the others added. So a
    term that most documents hold costs a query no more than its candidates, and ranks equal those over all documents."""
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("token"))
    posts = weighted_postings(asked.select("token").distinct(), docs, fields, settings, block)
    terms = written(split_terms(asked, posts, k))
    part = written(block_sums(terms, posts, tuple(f for f, _ in fields), k))
    place = F.row_number().over(Window.partitionBy("query_id", "field").orderBy(F.col("s").desc()))
    raised = part.withColumn("r", place).filter(F.col("r") <= k).filter(F.col("r") == k).groupBy("query_id").agg(F.max("s").alias("raised"))
    floor = F.coalesce(F.greatest("floor", "raised"), F.lit(0.0))
    left = written(part.join(raised, "query_id", "left").filter(F.col("s") + F.col("rest") >= floor - SLACK).select("query_id", "field", "doc_id", "s"))
    others = terms.filter("not essential").select("query_id", "field", "token")
    lacking = written(left.select("query_id", "field", "doc_id").join(others, ["query_id", "field"]))
    added = lacking.join(posts, ["field", "token", "doc_id"]).select("query_id", "field", "doc_id", F.col("w").alias("s"))
    per_field = left.unionByName(added).groupBy("query_id", "doc_id", "field").agg(F.sum("s").alias("s"))
    best = per_field.groupBy("query_id", "doc_id").agg(F.max("s").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= k)
