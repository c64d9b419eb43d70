"""Operator 4 on items of every length: the recall that the operator states holds end to end."""

import random

import pytest

from voltledger.llm import decontaminate


def edit(rnd, words, k, fresh):
    out = list(words)
    for _ in range(k):
        at, kind = rnd.randrange(len(out)), rnd.randrange(3)
        out[at : at + (kind > 0)] = [next(fresh)] * (kind < 2)
    return out


@pytest.mark.parametrize(("size", "items"), [(4, 60), (17, 100), (50, 100), (61, 100), (300, 60), (800, 60), (2000, 60)])
def test_recall_with_all_edits_that_are_allowed(spark, size, items):
    rnd = random.Random(size)
    fresh = iter(f"x{i}" for i in range(10**9))
    common = [f"w{i}" for i in range(3000)]
    prose = lambda n: [rnd.choice(common) for _ in range(n)]
    bench = [(i, prose(size)) for i in range(items)]
    docs = [(1000 + i, prose(rnd.randint(0, 80)) + edit(rnd, w, size // 5, fresh) + prose(rnd.randint(0, 80))) for i, w in bench]
    clean = [(5000 + i, prose(size + 100)) for i in range(20)]
    beyond = [(9000 + i, edit(rnd, w, 2 * (size // 5) + size // 4 + 1, fresh)) for i, w in bench[:20]]  # mostly out of reach
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(w)) for i, w in rows], f"{name} bigint, text string")
    got = decontaminate.contamination(frame(docs + clean + beyond, "doc_id").repartition(4), frame(bench, "item_id")).collect()
    k = size // 5
    assert all(r.edits <= k and r.item_words == size for r in got)
    found = {(r.doc_id, r.item_id) for r in got}
    assert not {r.doc_id for r in got} & {i for i, _ in clean}
    assert len(found & {(1000 + i, i) for i, _ in bench}) >= 0.98 * items
    text = dict(docs + beyond)
    for r in got[:: max(1, len(got) // 6)]:  # the edits that are reported are the distance
        a, b = dict(bench)[r.item_id], text[r.doc_id][r.start_word : r.end_word]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, diagonal = [i, *row[1:]], row[0]
            for j, y in enumerate(b, 1):
                diagonal, row[j] = row[j], min(diagonal + (x != y), row[j] + 1, row[j - 1] + 1)
        assert row[-1] == r.edits


def test_a_very_long_document_and_an_item_in_it_twice(spark):
    rnd = random.Random(1)
    item = [f"q{rnd.randrange(500)}" for _ in range(130)]
    filler = [f"w{rnd.randrange(40_000)}" for _ in range(400_000)]
    words = filler[:200_000] + edit(rnd, item, 26, iter(f"x{i}" for i in range(99))) + filler[200_000:] + item
    (r,) = decontaminate.contamination(spark.createDataFrame([(1, " ".join(words))], "doc_id bigint, text string"), spark.createDataFrame([(2, " ".join(item))], "item_id bigint, text string")).collect()
    assert (r.doc_id, r.item_id, r.edits, r.end_word) == (1, 2, 0, len(words))


def test_parts_cover_the_item_and_share_its_edits():
    for n in (1, 4, 5, 59, 60, 61, 137, 800):
        k = n // 5
        parts = decontaminate.parts_of(n, k, (0.98, 8, 3))
        assert [a for a, _, _ in parts] == [sum(s for _, s, _ in parts[:i]) for i in range(len(parts))] and sum(s for _, s, _ in parts) == n
        assert sum(e + 1 for _, _, e in parts) > k and all(s <= decontaminate.PART_WORDS for _, s, _ in parts)
    exact = decontaminate.parts_of(40, 8, (1.1, 8, 3))  # a recall that no number of walks reaches: exact parts
    assert all(e == 0 for _, _, e in exact) and len(exact) == 10  # of 8 edits
