import random
from collections import Counter

from pyspark.sql import functions as F

from voltledger.operators.containment import longest_contained


def plain(text, names, share=0.5):
    if not text:
        return None
    letters = Counter(text.replace(" ", ""))
    fits = [n for n in names if n and n.strip() and not Counter(n.replace(" ", "")) - letters and len(n.replace(" ", "")) >= share * sum(letters.values())]
    return min(fits, key=lambda n: (-len(n.replace(" ", "")), n), default=None)


def test_longest_contained_name(spark):
    rnd = random.Random(4)
    word = lambda k: "".join(rnd.choice("abcdeé Z") for _ in range(k))
    names = [word(rnd.randint(1, 8)) for _ in range(120)] + ["", " ", None, "qqq", "ab", "ab"]
    texts = ["".join(rnd.sample(t, len(t))) for t in (word(rnd.randint(0, 14)) for _ in range(300))] + [None, "", "  ", "ab", "ab", "x"]
    left = spark.createDataFrame([(i, t, "n") for i, t in enumerate(texts)], "i int, text string, name string").repartition(3)
    right = spark.createDataFrame([(n, "t") for n in names], "name string, text string")
    got = {r.i: r.found for r in longest_contained(left, "text", right, "name", "found").collect()}
    assert got == {i: plain(t, names) for i, t in enumerate(texts)} and sum(v is not None for v in got.values()) > 50
    assert longest_contained(left.limit(0), "text", right, "name", "found").collect() == []
    assert {r.found for r in longest_contained(left, "text", right.limit(0), "name", "found").collect()} == {None}
    only = {r.i: r.found for r in longest_contained(left, "text", right, "name", "found", when=F.startswith("__name", F.lit("a"))).collect()}
    assert only == {i: plain(t, [n for n in names if n and n[0] == "a"]) for i, t in enumerate(texts)}
