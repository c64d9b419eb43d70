"""Operator 2: secret scans behind a trigram inverted index, in DataFrame functions only.

1. Each rule's regular expression gives a Boolean trigram query (``trigrams.query``): clauses of trigrams that must all occur.
2. One pass over the texts writes, for each document, which of the trigrams that the rules ask for it has (the inverted index, by document), and the
   spans of the rules without mandatory trigrams (``hex``), which scan every text.
3. Per clause the postings are intersected: a document is a candidate of a rule if all trigrams of one of its clauses list it.
4. Only the texts of candidates are read again, and verified by the regular expressions themselves. Few candidates (``broadcast_bytes`` at most) are sent to
   the texts; more are joined by doc_id. The other documents have their result from the first pass: their texts never move.

Spans are in code points, end exclusive; matches are leftmost and non-overlapping per kind, failing ones are dropped without a retry.

Defined results: a null or empty text has no spans; a null doc_id cannot be looked up in the index and is scanned fully; rows that
repeat a doc_id share their candidates, which only adds verification; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.llm import trigrams
from voltledger.llm.shared import saved
from voltledger.llm.spans import SPAN, re_spans


@dataclass(frozen=True)
class Rule:
    """``keep`` tests a match (a Column of its text); ``ignore_case`` tells that the pattern's literals match in either case."""

    kind: str
    pattern: str
    keep: Callable[[Column], Column] | None = None
    ignore_case: bool = False


_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Base rules first (their order is that of the kinds), then the rules that the method adds.
BASE = (
    Rule("assign", _ASSIGN, lambda m: F.length(F.regexp_extract(m, _ASSIGN, 2)) >= 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----"),
)


#: Candidates below so many bytes are broadcast; a row counts as CANDIDATE_BYTES.
BROADCAST_BYTES, CANDIDATE_BYTES = 32 << 20, 128


def _grams(rules: tuple[Rule, ...]) -> tuple[list[tuple[int, bool, frozenset[str]]], list[tuple[str, bool]]]:
    """(rule, whether it is looked up in lower case, trigrams) of all clauses, and all trigrams that they ask for."""
    clauses = [(k, r.ignore_case, clause) for k, r in enumerate(rules) for clause in trigrams.query(r.pattern, r.ignore_case) or ()]
    return clauses, sorted({(g, low) for _, low, clause in clauses for g in clause})


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, grams array<int> (places of the trigrams that the text has), spans of the rules that scan every text: one row per row with a doc_id."""
    _, grams = _grams(rules)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.lower("text").alias("low")).where("doc_id is not null")
    have = F.array_compact(F.array(*(F.when(F.contains("low" if low else "text", F.lit(g)), F.lit(i)) for i, (g, low) in enumerate(grams)))).cast("array<int>")
    own = [_spans_of(k, r, F.col("text").rlike(r.pattern)) for k, r in enumerate(rules) if trigrams.query(r.pattern, r.ignore_case) is None]
    return texts.select("doc_id", have.alias("grams"), F.sort_array(F.concat(*own) if own else F.array()).cast(SPAN).alias("spans"))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, rules array<int>: the indexed rules whose trigram query the document satisfies. index: as from ``scanned``."""
    spark = index.sparkSession
    clauses, grams = _grams(rules)
    if not grams:
        return spark.createDataFrame([], "doc_id bigint, rules array<int>")
    wanted = [(n, k, len(clause), grams.index((g, low))) for n, (k, low, clause) in enumerate(clauses) for g in clause]
    asked = spark.createDataFrame(wanted, "clause int, rule int, needed int, gram int")
    postings = index.select("doc_id", F.explode("grams").alias("gram"))
    met = postings.join(F.broadcast(asked), "gram").groupBy("doc_id", "clause", "rule", "needed").agg(F.countDistinct("gram").alias("n"))
    return met.where("n = needed").groupBy("doc_id").agg(F.collect_set("rule").alias("rules"))


def _spans_of(k: int, r: Rule, gate: Column) -> Column:
    return _kept(re_spans(F.col("text"), r.pattern, k, gate), r.keep)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc_id, spans array<struct<start, kind, end, value>> sorted by start, then kind (place in ``rules``): one row per input row."""
    first = saved(scanned(docs, rules))
    found = saved(candidates(first, rules))
    if found.count() * CANDIDATE_BYTES <= broadcast_bytes:
        found = F.broadcast(found)
    others = first.join(found, "doc_id", "left_anti").select("doc_id", "spans")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    again = texts.join(found, "doc_id").union(texts.where("doc_id is null").withColumn("rules", F.sequence(F.lit(0), F.lit(len(rules) - 1))))
    parts = []
    for k, r in enumerate(rules):
        indexed = trigrams.query(r.pattern, r.ignore_case) is not None
        parts.append(_spans_of(k, r, F.array_contains("rules", F.lit(k)) if indexed else F.col("text").rlike(r.pattern)))
    return again.select("doc_id", F.sort_array(F.concat(*parts)).cast(SPAN).alias("spans")).union(others)


def _kept(spans: Column, keep: Callable[[Column], Column] | None) -> Column:
    return spans if keep is None else F.filter(spans, lambda s: keep(s["value"]))
