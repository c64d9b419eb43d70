"""Operators 11 to 13 against plain versions: nulls, empty and long texts, ties, repeated rows, clashing extra columns, empty tables."""

import functools
import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ROWS, empty, frame

from voltledger.llm import ball_kmeans, fingerprints, periodic_runs, queries

# ---- 11


@functools.cache
def plain_fingerprint(text, window=fingerprints.WINDOW):
    """Spans hashed one by one, without prefix arrays."""
    b, prime, base = text.encode(), (1 << 61) - 1, int(fingerprints.flat._P)
    powers = [pow(base, i, prime) for i in range(len(b))]
    residue = lambda s: sum((v + 1) * p for v, p in zip(s, powers, strict=False)) % prime
    spans = {b[i : i + window] for i in range(max(1, len(b) - window + 1))} if b else set()
    slots = [fingerprints._NONE] * fingerprints.SLOTS
    for s in spans:
        h = int(fingerprints.flat.mix(np.array([residue(s)], np.uint64), 11)[0])
        slots[h >> 58] = min(slots[h >> 58], h >> 26 & fingerprints._NONE, fingerprints._NONE - 1)
    return f"{len(b)}.{residue(b):016x}." + "".join(f"{v:08x}" for v in slots)


def plain_likeness(a, b):
    if a == b:
        return 1.0
    x, y = ([f[-512:][i : i + 8] for i in range(0, 512, 8)] for f in (a, b))
    used = [(p, q) for p, q in zip(x, y, strict=True) if (p, q) != ("f" * 8, "f" * 8)]
    same = sum(p == q for p, q in used)
    return 2 * same / (2 * same + len(used) - same)


def plain_edited(rows):
    """rows (doc_id, text); repeated rows follow each other in the order of their texts, null first."""
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1] is not None, r[1] or ""))
    for i, (doc, text) in enumerate(order):
        text, behind = text or "", order[(i + 1) % len(order)][1] or ""
        third = len(text) // 3
        new = text[: len(text) - third] + behind[:third]
        shared = next((k for k, (p, q) in enumerate(zip(text, new, strict=False)) if p != q), min(len(text), len(new)))
        yield doc, len(text), hashlib.sha256(new.encode()).hexdigest(), text, new, behind, shared


@pytest.mark.parametrize("piece", [fingerprints.PIECE, 700])
def test_fingerprints_of_documents_edited_and_next_texts(spark, monkeypatch, piece):
    monkeypatch.setattr(fingerprints, "PIECE", piece)
    rows = [r for r in ROWS[20:] if len(r[1] or "") < 3000]
    got = fingerprints.edited(frame(spark, rows))
    got = got.withColumns({"near": fingerprints.likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "next": fingerprints.likeness(F.col("fingerprint"), F.col("next_fingerprint"))}).collect()
    want = Counter()
    for doc, n, sha, text, new, behind, shared in plain_edited([*rows, rows[0]]):
        f, e, b = (plain_fingerprint(t) for t in (text, new, behind))
        want[doc, n, sha, f, e, b, shared, plain_likeness(f, e), plain_likeness(f, b)] += 1
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == want
    (lone,) = (r for r in got if r.doc_id is None)
    assert lone.n_chars == len("null id " * 30) and lone.edited_sha256 is lone.next_fingerprint is lone.near is None
    assert lone.fingerprint == plain_fingerprint("null id " * 30)
    by_doc = {r.doc_id: r.fingerprint for r in got}
    assert {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprints(frame(spark, rows)).collect()} == set(by_doc.items())


def test_fingerprints_empty_single_and_hot_id(spark):
    assert fingerprints.edited(empty(spark)).collect() == [] == fingerprints.fingerprints(empty(spark)).collect()
    (r,) = fingerprints.edited(spark.createDataFrame([(5, "abcdef")], "doc_id bigint, text string")).collect()
    assert (r.edited_sha256, r.fingerprint, r.common_chars) == (hashlib.sha256(b"abcdab").hexdigest(), r.next_fingerprint, 4)
    rows = [(7, f"t {i:03d} " * 9) for i in range(300)] + [(i, str(i) * 40) for i in range(20)]
    got = fingerprints.edited(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)).collect()
    assert Counter((r.doc_id, r.edited_sha256) for r in got) == Counter((x[0], x[2]) for x in plain_edited(rows))


def test_prefix_hashes_answer_spans_and_extensions():
    rnd = random.Random(3)
    data = np.array([rnd.choice(b"ab") for _ in range(3000)], np.uint8)
    data[1500:1900] = data[200:600]
    p = fingerprints.Prefixes(data)
    a, b = np.array([200, 0, 1500, 2999, 250]), np.array([1500, 1, 200, 3, 1550])
    most = 3000 - np.maximum(a, b)
    plain = [next((k for k in range(m) if data[x + k] != data[y + k]), m) for x, y, m in zip(a.tolist(), b.tolist(), most.tolist(), strict=True)]
    assert p.extension(a, b, most).tolist() == plain and plain[0] >= 400
    assert (p.residue(a[:1], a[:1] + 400) == p.residue(b[:1], b[:1] + 400)).all()


# ---- 12


def plain_runs(words, least=24, repeats=3):
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if len(part) >= max(least, repeats * q) and not any(all(part[k] == part[k + p] for k in range(len(part) - p)) for p in range(1, q)):
                out.append((i, len(part), q))
            i = j
    return sorted(out)


def random_words(rnd, n):
    kinds = rnd.choice([2, 3, 30])
    w = [b"w%d" % rnd.randrange(kinds) for _ in range(n)]
    for _ in range(rnd.randint(0, 4)):
        p, at, size = rnd.randint(1, max(1, n // 4)), rnd.randrange(n), rnd.randint(1, n)
        cell = [b"c%d" % rnd.randrange(rnd.choice([2, 50])) for _ in range(p)]
        w[at : at + size] = [cell[i % p] for i in range(len(w[at : at + size]))]
    return w


@pytest.mark.parametrize("dense", [10_000, 0])
def test_runs_of_random_words(dense):
    rnd = random.Random(5)
    for _ in range(250):
        w = random_words(rnd, rnd.randint(1, 150))
        assert periodic_runs.runs(w, dense=dense) == plain_runs(w)
    w = [b"a"] * 40
    assert periodic_runs.runs(w, dense=dense) == [(0, 40, 1)]
    assert periodic_runs.runs([b"a"] * 23, dense=dense) == [] == periodic_runs.runs([], dense=dense)


def test_runs_of_a_very_long_text_find_only_lags_of_recurrences():
    rnd = random.Random(8)
    w = [b"%d" % rnd.randrange(30_000) for _ in range(300_000)]
    w[50_000:170_000] = w[:40_000] * 3
    w[200_000:200_900] = w[7:16] * 100
    assert {(50_000, 120_000, 40_000), (200_000, 900, 9)} == set(periodic_runs.runs(w))


def plain_op12(doc, text):
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    milli = math.floor(1000 * best[1] / best[2]) if found else None
    return len(found), *best, milli, hashlib.sha256("".join(f"{s},{length},{q}\n" for s, length, q in found).encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


def test_op12_query(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, t) for i, t in ROWS if len(t or "") < 3000]
    rows += [(i, b" ".join(random_words(rnd, rnd.randint(20, 200))).decode()) for i in range(1000, 1200)] + [(None, "x " * 30), (10, rows[0][1]), (2000, "a b c\x1c " * 30)]
    spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id bigint, text string, words string, __h int").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_periodic_runs(spark, str(tmp_path)).collect()
    assert Counter(tuple(r) for r in got) == Counter((i, *plain_op12(i, t)) for i, t in rows)
    assert sum(r.n_runs > 0 for r in got) > 50 and any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)
    assert periodic_runs.periodic_runs(empty(spark)).collect() == []


# ---- 13


def plain_kmeans(rows, k=8, rounds=10, dims=64, salt="3:"):
    kept = [(i, [min(max(math.floor(1024 * float(v)), -ball_kmeans.LIMIT), ball_kmeans.LIMIT) for v in x], x) for i, x in rows if x is not None and len(x) == dims and all(v is not None and math.isfinite(v) for v in x)]
    seeds = sorted((hashlib.sha256(f"{salt}{i}".encode()).hexdigest(), x, v) for i, v, x in kept if i is not None)[:k]
    c = [v for _, _, v in seeds]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, w, strict=True)), j) for j, w in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v, _ in kept:
            of[near(v)[1]].append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j], strict=True)] if of[j] else c[j] for j in range(len(c))]
    last = [(i, *near(v)) for i, v, _ in kept]
    total = Counter()
    for _, d, j in last:
        total[j] += d
    return Counter((i, j, d, total[j], sum(total.values()), ",".join(map(str, c[j]))) for i, d, j in last)


def balls(spark, rows, **how):
    df = spark.createDataFrame([(i, x, 1, "s") for i, x in rows], "vec_id bigint, embedding array<float>, cluster int, v string")
    return Counter((*r[:5], ",".join(map(str, r[5]))) for r in ball_kmeans.ball_kmeans(df.repartition(3), **how).collect())


@pytest.mark.parametrize("stale", [0.0, 0.1, 1.0])
def test_ball_kmeans(spark, stale):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (5, 64))
    x = (centres[rng.integers(0, 5, 240)] + rng.normal(0, 0.4, (240, 64))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += rows[:30]  # repeated rows
    rows += [(500, None), (501, []), (502, [1.0] * 63), (503, [1.0] * 63 + [None]), (504, [float("nan")] + [0.0] * 63), (505, [float("inf")] * 64), (None, [0.5] * 64), (506, [0.0] * 64), (507, [-0.0] * 64)]
    assert balls(spark, rows, stale=stale) == plain_kmeans(rows)


def test_ball_kmeans_ties_few_vectors_and_extremes(spark):
    grid = [(i, [float(i % 3 - 1), float(i // 3 % 3 - 1)]) for i in range(36)]  # many equal distances and equal centroids
    assert balls(spark, grid, dims=2, k=6, rounds=5) == plain_kmeans(grid, dims=2, k=6, rounds=5)
    few = [(1, [3e38, -3e38]), (2, [0.1, 0.2]), (3, [0.1, 0.2])]
    assert balls(spark, few, dims=2) == plain_kmeans(few, dims=2)
    assert balls(spark, [(1, [0.0] * 3)]) == Counter()
    assert sum(balls(spark, [(None, [0.5] * 64)] * 2).values()) == 2


def test_balls_compare_only_relevant_centroids():
    c = np.array([[0, 0], [10, 0], [1000, 0]], np.int64)
    near = ball_kmeans.neighbours(c, [6, 6, 6])
    assert [j.tolist() for _, j in near] == [[1], [0], []] and near[0][0].tolist() == [25]
    x = np.array([[4, 0], [5, 0], [6, 0]], np.int32)
    label, best, own = ball_kmeans.assign(x, np.zeros(3, np.int32), c, near)
    assert label.tolist() == [0, 0, 1] and best.tolist() == [16, 25, 16] and own.tolist() == [16, 25, 36]
