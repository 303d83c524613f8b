"""References and symbols in text and code, as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..settings import DEFAULTS, Settings
from .clean import strip, summary_fallback

# What counts as a reference. (?U) gives \w, \b, \d and \s their Unicode meaning.
PR_URL = r"(?U)github\.com/[\w.-]+/[\w.-]+/pull/(\d+)"
PR_HASH = r"(?U)(?:^|\s)#(\d{1,6})\b"
SHA = r"(?U)\b([0-9a-f]{7,40})\b"
TICKET = r"(?U)\b([A-Z]{2,8}-\d{1,5})\b"
PATH = r"(?U)\b([\w./-]+\.(?:py|rb|ts|tsx|js|go|java|sql))\b"
BACKTICKED = r"`([A-Za-z_][A-Za-z0-9_]{2,})`"
SCREAMING = r"(?U)\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)\b"
CAMEL = r"(?U)\b([A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+)\b"
CODE_CONTEXT = r"(?iU)(github\.com|\.py\b|\.ts\b|\.go\b|\brepo\b|\bPR\b|\bpull request\b|\bmerge[d]?\b|\bcommit\b|\bbranch\b|\bdiff\b)"
CODE_PATTERNS = (
    r"(?U)(?:^|\s)(?:def|function|func|fn)\s+([A-Za-z_][A-Za-z0-9_]*)",
    SCREAMING,
    r"(?U)\b([A-Z][a-zA-Z0-9]{3,})\b",
    r"(?U)\b([a-z_][a-z0-9_]{3,})\s*\(",
    r"(?U)(?:^|\n)\s*(?:import|from|require)\s+([\w./]+)",
    r"""['"]([^'"\n]{5,60})['"]""",
)
CODE_STOPWORDS = (
    "self", "this", "return", "print", "range", "super", "None", "True", "False",
    "else", "elif", "raise", "while", "async", "await", "class", "yield", "assert",
)
ENCLOSING = r"(?U)(?:^|\n)\s*(?:def|class|function|func|fn)\s+([A-Za-z_][A-Za-z0-9_]*)"
DECLARATION = r"^(?:export\s+)?(?:async\s+)?(?:def|class|function|func|fn|const|let|var|interface|type|struct|impl)\s+([A-Za-z_][A-Za-z0-9_]*)"
IDENTIFIER_SHAPE = r"_|\.|[a-z][A-Z]"
SYMBOLS_LINE = r"(?imU)^\s*SYMBOLS\s*:\s*(.*)$"
NO_SYMBOLS = ("none", "n/a", "na", "empty", "-", "(none)", "none.")


def every(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def pr_refs(text: Column) -> Column:
    """Numbers in pull request addresses, then bare ``#n`` where the text is about code."""
    urls = every(text, PR_URL)
    bare = F.when(text.rlike(CODE_CONTEXT), every(text, PR_HASH)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(F.concat(urls, bare), lambda n: n.try_cast("int")), lambda n: n.isNotNull()))


def commit_shas(text: Column) -> Column:
    """First seven digits of hashes that hold a letter."""
    return F.array_distinct(F.transform(F.filter(every(text, SHA), lambda s: s.rlike("[a-f]")), lambda s: F.substring(s, 1, 7)))


def ticket_refs(text: Column) -> Column:
    return F.array_distinct(every(text, TICKET))


def file_paths(text: Column) -> Column:
    return F.array_distinct(every(text, PATH))


def basenames(paths: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(paths, lambda p: F.element_at(F.split(p, "/"), -1)), lambda b: b != ""))


def symbols(text: Column) -> Column:
    """Backticked identifiers, then SCREAMING_CASE, then CamelCase."""
    return F.array_distinct(F.concat(every(text, BACKTICKED), every(text, SCREAMING), every(text, CAMEL)))


def first_spellings(items: Column) -> Column:
    """Without repeats in other case; the first spelling stays."""
    # bound as one element, so that the list is computed once and not again for each of its items
    bound = F.transform(F.array(items), lambda it: F.filter(it, lambda s, i: F.array_position(F.transform(it, F.lower), F.lower(s)) == i + 1))
    return bound[0]


def merge_symbols(found: Column, extra: Column) -> Column:
    return first_spellings(F.concat(found, extra))


def distinctive_symbols(items: Column, settings: Settings = DEFAULTS) -> Column:
    """Symbols that look like identifiers."""
    return F.filter(items, lambda s: (F.length(s) >= settings.symbol_min_chars) & s.rlike(IDENTIFIER_SHAPE))


def code_symbols(code: Column) -> Column:
    """Definitions, constants, classes, calls, imports and strings of a piece of code: the first 40."""
    found = F.transform(F.concat(*[every(code, p) for p in CODE_PATTERNS]), strip)
    kept = F.filter(found, lambda s: (s != "") & ~s.isin(*CODE_STOPWORDS))
    return F.slice(first_spellings(kept), 1, 40)


def enclosing_symbol(code: Column) -> Column:
    return F.nullif(F.regexp_extract(code, ENCLOSING, 1), F.lit(""))


def parse_summary(raw: Column, raw_text: Column, settings: Settings = DEFAULTS) -> tuple[Column, Column]:
    """(summary, symbols) of model output; without a usable one the text's beginning and no symbols."""
    bad = raw.isNull() | (raw == "") | raw.startswith("__ERROR__")
    listed = F.transform(F.split(F.regexp_extract(raw, SYMBOLS_LINE, 1), ","), strip)
    found = F.filter(listed, lambda s: (s != "") & ~F.lower(s).isin(*NO_SYMBOLS))
    body = strip(F.regexp_replace(raw, r"(?imsU)^\s*SYMBOLS\s*:.*\z", ""))
    none = F.array().cast("array<string>")
    fallback = summary_fallback(raw_text, settings)
    return F.when(bad | (body == ""), fallback).otherwise(body), F.when(bad, none).otherwise(found)


def exact_hooks() -> Column:
    """What ties a document to code by identity: ``#n``, hashes and paths; none means by meaning only."""
    return F.concat(F.transform("pr_refs", lambda n: F.concat(F.lit("#"), n.cast("string"))), F.col("commit_shas"), F.col("file_paths"))


def carries_signal(text: Column, settings: Settings = DEFAULTS) -> Column:
    """Whether a lone message is worth a document: enough words, an address, or any reference."""
    words = F.size(F.filter(F.split(strip(text), r"(?U)\s+"), lambda w: w != ""))
    refs = F.concat(commit_shas(text), ticket_refs(text), file_paths(text), symbols(text))
    return (words >= settings.solo_min_words) | text.contains("http") | (F.size(refs) > 0) | (F.size(pr_refs(text)) > 0)


def with_references(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """Adds pr_refs, commit_shas, ticket_refs, file_paths, file_basenames, symbols."""
    c = F.col(text)
    df = df.withColumns({"pr_refs": pr_refs(c), "commit_shas": commit_shas(c), "ticket_refs": ticket_refs(c), "file_paths": file_paths(c), "symbols": symbols(c)})
    return df.withColumn("file_basenames", basenames(F.col("file_paths")))


def declarations(files: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Top-level declarations of files (file_path, code): name, line_start, line_end (both from 0). A body
    ends before the next unindented line, after at most ``body_lines`` lines; blank lines don't count."""
    lines = files.select("file_path", F.posexplode(F.split("code", r"\r\n|\n|\r")).alias("line", "content"))
    text = lines.filter(F.trim("content") != "").withColumn("top", ~F.col("content").rlike(r"^\s"))
    order = Window.partitionBy("file_path").orderBy("line")
    text = text.withColumn("head", F.sum(F.col("top").cast("int")).over(order))
    first = Window.partitionBy("file_path", "head")
    text = text.withColumn("begin", F.min(F.when(F.col("top"), F.col("line"))).over(first))
    body = text.filter(F.col("line") <= F.col("begin") + settings.body_lines)
    out = body.groupBy("file_path", "head").agg(F.min("begin").alias("line_start"), F.max("line").alias("line_end"), F.min_by("content", "line").alias("content"))
    name = F.regexp_extract("content", DECLARATION, 1)
    return out.filter(name != "").select("file_path", name.alias("name"), "line_start", "line_end")
