"""Operator 9: personal data by patterns and bootstrapped contexts, in DataFrame functions only.

Base patterns (email, ip, card, phone) give the seeds. Every word with a digit or an @ is an *instance* of a loose type: ``mail`` (has an @),
``number`` (digits without letters) or ``code``. Its *lexical patterns* are its type with the word before it, with the two and the three words
before it, with the word after it, and with both neighbours; words are whole, however far they stand, and lower-cased. A neighbour that is itself
a word with a digit or an @ counts as its type, and nothing is looked up beyond it. A base span is one instance, by its whole value: its
first word carries the patterns of the left, its last word those of the right. Patterns and instances form a
bipartite graph. Each round scores all of it: a pattern's score is the sum of its instances' scores over that sum, ``DOUBT`` times what they lack to 1 (an
unknown instance is no counterexample) and ``SMOOTH``; its support the number of different instances that are seeds or score ``MIN_SCORE`` or more; it is confident with a score of ``MIN_SCORE`` and a support
of ``MIN_SEEDS`` or more. An instance that is no seed scores 1 - product of (1 - score) over its confident patterns, so what one
pattern found supports others in the next round. The patterns that are confident in the last round mark their other instances as
identifiers of kind ``context``. The counts cover all documents.

The base patterns are written so that no text makes them backtrack (possessive, and entered at the start of a run or at the end of the
last match only); they match what the plain patterns match.

Defined results: a null or empty text has no spans; a null doc_id gets its base spans, but no context spans; repeated rows give equal
rows; rows that repeat a doc_id should carry one text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltledger.llm.shared import saved
from voltledger.llm.spans import SPAN, let, re_spans

KINDS = ("email", "ip", "card", "phone", "context")
ROUNDS, SMOOTH, DOUBT, MIN_SCORE, MIN_SEEDS = 3, 2, 0.5, 0.8, 5

#: The base patterns, in the order of the kinds.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A word with a digit or an @.
WORD = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"

#: Up to three words at the end of the text before such a word, and the first word of the text after it, found in one pass.
BEFORE = r"(?<![^\x20\x09-\x0D])((?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){1,3})\z"
AFTER = r"\A[\x20\x09-\x0D]++([^\x20\x09-\x0D]++)"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _ip_ok(x: Column) -> Column:
    part = lambda p: F.ltrim(p, F.lit("0"))
    return F.forall(F.split(x, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def _luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass the check sum; doubled digits lose 9 if above 9."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda d, i: (lambda v: F.when(i % 2 == 1, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v))(F.coalesce(d.try_cast("int"), F.lit(0))))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


def _card_ok(x: Column) -> Column:
    d = _digits(x)
    return (F.length(x) <= 37) & F.length(d).between(12, 19) & _luhn(d)


def _phone_ok(x: Column) -> Column:
    return F.length(_digits(x)).between(9, 15)


def base_spans(text: Column) -> Column:
    """Spans of the base kinds, sorted by start, then kind."""
    digit = text.rlike("[0-9]")
    ip = F.filter(re_spans(text, IP, 1, digit), lambda s: _ip_ok(s["value"]))
    card = F.filter(re_spans(text, CARD, 2, digit), lambda s: _card_ok(s["value"]))
    phone = F.filter(re_spans(text, PHONE, 3, F.contains(text, F.lit("+"))), lambda s: _phone_ok(s["value"]))
    return F.sort_array(F.concat(re_spans(text, EMAIL, 0, F.contains(text, F.lit("@"))), ip, card, phone)).cast(SPAN)


def _type(word: Column) -> Column:
    """The loose type of a word with a digit or an @, empty for none. The tab keeps it apart from words."""
    kind = F.when(F.contains(word, F.lit("@")), "\tmail").when(word.rlike("[A-Za-z]"), "\tcode").otherwise("\tnumber")
    return F.when(word == "", "").otherwise(kind)


def _words(text: Column) -> Column:
    """array<struct<start, end, stop, instance, left, right>> of the words with a digit or an @, and their patterns by hash.

    ``end`` is that of the word without the punctuation behind it, ``stop`` that of the whole word. ``left`` holds the patterns of the words
    before, ``right`` those with the word after.
    """
    gate = text.rlike("[0-9@]")
    nothing = F.array().cast("array<string>")

    def one(s, gap, gap_after, last, following):
        core = F.regexp_replace(s["value"], r"[^A-Za-z0-9]++$", "")
        words = F.split(F.lower(F.rtrim(F.regexp_extract(gap, BEFORE, 1))), r"[\x20\x09-\x0D]++")
        words = F.filter(F.concat(F.array(_type(last)), words), lambda w: w != "")
        after = F.lower(F.regexp_extract(gap_after, AFTER, 1))
        after = F.when(after != "", after).otherwise(_type(following))
        kind = _type(s["value"])

        def patterns(words):
            n = F.size(words)
            left = F.transform(F.sequence(F.lit(0), F.least(n, F.lit(3))), lambda k: F.xxhash64(kind, k, F.array_join(F.slice(words, n - k + 1, k), " ")))
            near = F.when(n > 0, F.element_at(words, -1)).otherwise("")
            right = F.when(after == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(kind, F.lit(-1), after), F.xxhash64(kind, F.lit(-2), near, after)))
            return F.struct(s["start"].alias("start"), (s["start"] + F.length(core)).alias("end"), s["end"].alias("stop"), core.alias("instance"), F.slice(left, F.lit(2), F.lit(3)).alias("left"), right.alias("right"))

        return let(words, patterns)

    def each(found, gaps):
        values = F.transform(found, lambda s: s["value"])
        last = F.concat(F.array(F.lit("")), values)
        following = F.concat(F.slice(values, F.lit(2), F.greatest(F.size(values), F.lit(1))), F.array(F.lit("")))
        sides = F.arrays_zip(found.alias("s"), F.slice(gaps, F.lit(1), F.size(found)).alias("gap"), F.slice(gaps, F.lit(2), F.size(found)).alias("after"), F.slice(last, F.lit(1), F.size(found)).alias("last"), following.alias("next"))
        return F.transform(sides, lambda x: one(*(x[k] for k in ("s", "gap", "after", "last", "next"))))

    between = F.when(gate, F.split(text, WORD, -1)).otherwise(nothing)
    return let(re_spans(text, WORD, 0, gate), lambda found: let(between, lambda gaps: F.when(F.size(found) > 0, each(found, gaps)).otherwise(each(F.slice(found, F.lit(1), F.lit(0)), nothing))))


def found_patterns(edges: DataFrame, rounds: int = ROUNDS, smooth: int = SMOOTH, doubt: float = DOUBT, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """pattern: those of high confidence. edges: distinct pattern, instance, seed."""
    edges = saved(edges)
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for r in range(rounds):
        scores = scored.groupBy("pattern").agg((F.sum("score") / (F.sum("score") + doubt * F.sum(1 - F.col("score")) + smooth)).alias("of_pattern"), F.count_if(F.col("score") >= min_score).alias("support"))
        patterns = saved(scores.where((F.col("of_pattern") >= min_score) & (F.col("support") >= min_seeds)))
        if r == rounds - 1:
            break
        guesses = edges.where("not seed").join(patterns, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.least("of_pattern", F.lit(0.999)))))).alias("guess"))
        scored = edges.join(saved(guesses), "instance", "left").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("guess", F.lit(0.0))).alias("score"))
    return patterns.select("pattern")


def find(docs: DataFrame, rounds: int = ROUNDS, smooth: int = SMOOTH, doubt: float = DOUBT, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """doc_id, spans array<struct<start, kind, end, value>> sorted by start, then kind (place in ``KINDS``): one row per input row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", base_spans(F.col("text")).alias("base"), _words(F.col("text")).alias("words"))
    rows = saved(rows)
    words = saved(_against_base(rows.where("doc_id is not null")))
    edges = words.select(F.explode("patterns").alias("pattern"), F.xxhash64("instance").alias("instance"), "seed").groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    good = saved(found_patterns(edges, rounds, smooth, doubt, min_score, min_seeds))
    unseen = words.where("not seed").select("doc_id", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    more = unseen.join(good, "pattern", "left_semi").groupBy("doc_id").agg(F.collect_set(F.struct("start", F.lit(4).alias("kind"), "end", F.col("instance").alias("value"))).cast(SPAN).alias("more"))
    joined = rows.select("doc_id", "base").join(saved(more), "doc_id", "left")
    return joined.select("doc_id", F.sort_array(F.concat("base", F.coalesce("more", F.array().cast(SPAN)))).alias("spans"))


def _against_base(rows: DataFrame) -> DataFrame:
    """doc_id, start, end, instance, patterns, seed (a base span begins in it or reaches into it): words of all documents.

    Words and base spans of a document are compared by their order, so that long texts with many of both take no more than a sort.
    """
    words = rows.select("doc_id", F.inline("words")).where("end > start").select("*", F.lit(False).alias("base"))
    spans = rows.select("doc_id", F.inline("base")).select("doc_id", "start", "end", F.col("end").alias("stop"), F.col("value").alias("instance"), F.array().cast("array<bigint>").alias("left"), F.array().cast("array<bigint>").alias("right"), F.lit(True).alias("base"))
    by_doc = Window.partitionBy("doc_id")
    upto = (Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("base"), F.struct("end", "instance"))).over(by_doc.orderBy("start", "base").rowsBetween(*upto))
    coming = F.min(F.when(F.col("base"), F.struct("start", "end", "instance"))).over(by_doc.orderBy(F.desc("start"), F.desc("base")).rowsBetween(*upto))
    met = words.unionByName(spans).withColumns({"reach": reach, "coming": coming}).where("not base")
    seed = F.coalesce(F.col("coming.start") < F.col("end"), F.lit(False))
    inside = F.coalesce(F.col("reach.end") > F.col("start"), F.lit(False))
    longer = seed & (F.col("coming.end") > F.col("stop"))
    closing = inside & (F.col("reach.end") <= F.col("stop"))
    patterns = F.when(closing, F.col("right")).when(inside, F.array().cast("array<bigint>")).when(longer, F.col("left")).otherwise(F.concat("left", "right"))
    instance = F.when(closing, F.col("reach.instance")).when(seed, F.col("coming.instance")).otherwise(F.col("instance"))
    return met.select("doc_id", "start", "end", instance.alias("instance"), patterns.alias("patterns"), (seed | inside).alias("seed"))
