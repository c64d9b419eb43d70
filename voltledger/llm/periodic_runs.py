"""Operator 12: runs of words that repeat with a period, by bit-parallel comparison at every lag.

The words of a text are numbered by first occurrence; bit b of all numbers, one big integer, is a bit plane. For a lag q the planes are XORed
with themselves shifted by q and the mismatches ORed: zero bits are words equal to the word q further on. A run of period q and n words is
a stretch of n - q such zeros, and ANDs with shifts that double find where at least that many stand together. They run after each plane, so
that most lags end at the first plane or two.

Lags are taken in ascending order: a stretch inside a run whose period divides the lag has that smaller period and is left out. (A run of three periods
of q or more that also has a smaller period has one that divides q.)

Texts of more than ``DENSE`` words would need a third of as many lags. Theirs are found first: a run of period q, 2**k <= q < 2**(k + 1),
starts with a sequence of 2**(k + 1) words that occurs next exactly q words later, so only distances of next occurrences can be periods. Sequences are
ranked by doubling, exactly. Results are the same either way.

Work is by document and needs no shuffle. Defined results: a null or empty text has no words and no runs; a null doc_id is treated as any other;
repeated rows give repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

MIN_WORDS, MIN_REPEATS = 24, 3
DENSE = 4096
_FLUSH = 1 << 20


def _lags(ids: np.ndarray, most: int, dense: int) -> Iterable[int]:
    """All lags that can be periods, ascending."""
    if len(ids) <= dense:
        return range(1, most + 1)
    found: set[int] = set()
    rank, w = ids, 1  # rank[i]: number of the sequence of w words at i
    while w <= most:
        size = int(rank.max()) + 1
        _, rank = np.unique(rank[:-w] * size + rank[w:], return_inverse=True)
        order = np.argsort(rank, kind="stable")
        apart = np.diff(order)[rank[order[1:]] == rank[order[:-1]]]
        if not len(apart):
            break
        found.update(np.unique(apart[(apart >= w) & (apart < 2 * w) & (apart <= most)]).tolist())
        w *= 2
    return sorted(found)


def _together(bits: int, n: int) -> int:
    """Bits at which n ones begin."""
    k = 1
    while k < n and bits:
        step = min(k, n - k)
        bits &= bits >> step
        k += step
    return bits


def runs(words: list[bytes], min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS, dense: int = DENSE) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and period; ``min_repeats`` is 3 or more."""
    n = len(words)
    if n < min_words:
        return []
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    planes = [int.from_bytes(np.packbits((ids >> b) & 1 > 0, bitorder="little").tobytes(), "little") for b in range(max(1, (len(numbers) - 1).bit_length()))]
    found: dict[int, list[tuple[int, int]]] = {}  # by period: starts and ends, ascending
    for q in _lags(ids, n // min_repeats, dense):
        need = max(min_words - q, (min_repeats - 1) * q)
        same = (1 << (n - q)) - 1
        for plane in planes:
            same &= ~(plane ^ (plane >> q))
            begins = _together(same, need)
            if not begins:
                break
        while begins:
            start = (begins & -begins).bit_length() - 1
            rest = begins >> start
            ones = (~rest & (rest + 1)).bit_length() - 1
            end = start + ones - 1 + need + q
            begins = (rest >> ones) << (start + ones)
            if not any(q % p == 0 and (at := bisect_right(own, (start, n))) and own[at - 1][1] >= end for p, own in found.items() if p < q):
                found.setdefault(q, []).append((start, end))
    return sorted((s, e - s, q) for q, own in found.items() for s, e in own)


def periodic_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_repeats: int = MIN_REPEATS) -> DataFrame:
    """doc_id, n_words, runs array of (start, length, period), collapsed: the words but those behind the first period of a run, joined by one space."""
    fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["doc_id", "n_words", "runs", "collapsed"]

    def find(batches):
        for batch in batches:
            out, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()  # bytes split at \x20 and \x09-\x0D
                every = runs(words, min_words, min_repeats)
                if every:
                    gone = np.zeros(len(words), bool)
                    for s, length, q in every:
                        gone[s + q : s + length] = True
                    kept = b" ".join([words[i] for i in np.flatnonzero(~gone).tolist()])
                else:
                    kept = b" ".join(words)
                out.append((doc.as_py(), len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in every], kept))
                held += len(kept) + 48 * len(every)
                if held > _FLUSH:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    def _batch(rows):
        doc, n, every, kept = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(every, pa.list_(fields)), pa.array(kept, pa.binary()).cast(pa.string())], names)

    return docs.select("doc_id", "text").mapInArrow(find, "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")
