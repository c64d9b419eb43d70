"""Names whose letters are contained in a scrambled text, for a dictionary of any size: a set-containment join without a cross join.

A text is the multiset of its characters without spaces; counting each character's occurrences (a1, a2, ...) makes it a set, and a name is
contained if its set is a subset. Each name is filed under the one of its elements that the fewest texts have. A text can only contain names filed under its own
elements, so the join is by element, and sizes and the remaining elements are tested inside it. Texts and names are joined once
each, however often they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.schemas import quoted


def elements(text: Column) -> Column:
    """array<string>: the characters of a text but spaces, each with the number of its occurrence."""
    letters = F.array_sort(F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ""), lambda x: x != ""))
    numbered = lambda all_: F.transform(all_, lambda x, i: F.concat(x, (i + 2 - F.array_position(all_, x)).cast("string")))
    return F.transform(F.array(letters), numbered)[0]


def contains(outer: Column, inner: Column) -> Column:
    """Is each element of ``inner`` one of ``outer``? Both as from ``elements``."""
    return F.forall(inner, lambda e: F.array_contains(outer, e))


def longest_contained(texts: DataFrame, text: str, names: DataFrame, name: str, out: str, share: float = 0.5, when: Column | None = None) -> DataFrame:
    """texts and ``out``: the longest name whose letters the text holds and that has at least ``share`` of them; of names of equal length the least; null without one.

    ``when``: a further condition on ``__text`` and ``__name`` (a hint in the text that must agree, say). Null and empty texts and names match nothing. Other columns of names are ignored.
    """
    size = lambda c: F.length(F.replace(F.col(c), F.lit(" "), F.lit("")))
    sized = lambda df, column, as_, n: df.select(F.col(quoted(column)).alias(as_)).distinct().withColumn(n, size(as_)).where(F.col(n) > 0)
    given = sized(texts, text, "__text", "__n")
    filed = given.select("__text", "__n", F.explode(elements(F.col("__text"))).alias("__e"))
    common = filed.groupBy("__e").agg(F.count(F.lit(1)).alias("__c"))  # characters times occurrences: small whatever the texts
    known = sized(names, name, "__name", "__m").withColumn("__set", elements(F.col("__name")))
    rarest = known.select("__name", F.explode("__set").alias("__e")).join(common, "__e", "left").groupBy("__name").agg(F.min(F.struct(F.coalesce("__c", F.lit(0)).alias("c"), F.col("__e").alias("e"))).alias("__r"))
    # a name with an element that no text has is out
    under = known.join(rarest.where("__r.c > 0").select("__name", F.col("__r.e").alias("__e")), "__name")
    fits = (F.col("__m") <= F.col("__n")) & (F.col("__m") >= share * F.col("__n")) & contains(elements(F.col("__text")), F.col("__set"))
    pairs = filed.join(under, "__e").where(fits if when is None else fits & F.coalesce(when, F.lit(False)))
    best = pairs.groupBy("__text").agg(F.min(F.struct((-F.col("__m")).alias("m"), F.col("__name").alias("name"))).alias("__best"))
    found = best.select("__text", F.col("__best.name").alias(out))
    # a null text matches nothing; nulls are dealt over many keys, so that they don't meet in one task
    key = F.coalesce(F.col(quoted(text)), F.concat(F.lit("\0"), F.pmod(F.monotonically_increasing_id(), F.lit(4096)).cast("string")))
    return texts.withColumn("__key", key).join(found, F.col("__key") == F.col("__text"), "left").drop("__key", "__text")
