"""Merged partition sketches: which hashes may occur more than once.

A count-min sketch of ``rows`` rows and ``2**bits`` saturating counters (0, 1, 2 or more). Each map task turns its
hashes into cells and sends, for each block of 65536 cells, the low halves of the cells it hit (a sparse partial
sketch); the reducers add them up and return one bit a cell: hit twice or more. Estimates are never too low, so what
the sketch calls single is single, and what it calls repeated is decided by an exact pass afterwards.

The result has ``rows * 2**bits / 8`` bytes, which go to the driver and to every executor. ``doublings`` sizes sketches by the bytes of
text, up to ``MOST_BITS`` (256 MB a row): a full sketch lets every single hash through to the exact pass, which then carries the whole corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.llm.flat import mix

_BLOCK = 1 << 16
_TOGETHER = 32
MOST_BITS = 31


def doublings(texts: DataFrame, bits: int, bytes_a_cell: int) -> int:
    """How often sketches made for 2**bits cells have to be doubled, so that the texts have ``bytes_a_cell`` bytes a cell at most. One sum over the texts."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min((max(1, -(-size // (bytes_a_cell << bits))) - 1).bit_length(), max(0, MOST_BITS - bits))


def cells(hashes: np.ndarray, bits: int, row: int) -> np.ndarray:
    return (mix(hashes, 101 + row) >> np.uint64(64 - bits)).astype(np.uint32)


def _partials(found: list[np.ndarray], row: int) -> pa.RecordBatch:
    at = np.sort(np.concatenate(found))
    more = np.ones(len(at), bool)  # of a cell no more than two hits count
    more[2:] = at[2:] != at[:-2]
    at = at[more]
    block = at >> np.uint32(16)
    cuts = np.concatenate(([0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(at)])).astype(np.int64)
    low = (at & np.uint32(0xFFFF)).astype("<u2")
    binary = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts * 2), pa.py_buffer(low)])
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts) - 1, row, np.int32)), pa.array(block[cuts[:-1]].astype(np.int32)), binary.cast(pa.binary())], ["row", "block", "hits"])


def repeated(df: DataFrame, hashes: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int, rows: int = 1) -> np.ndarray:
    """uint8[rows, 2**bits / 8]: packed bits of the cells hit at least twice by ``hashes`` over all batches of df."""

    flush = 1 << max(20, bits - 9)  # so many hits that a block's are more than the row that carries them

    def scan(batches):
        found: list[list[np.ndarray]] = [[] for _ in range(rows)]
        held = 0
        for batch in batches:
            for h in hashes(batch):
                if len(h):
                    held += len(h)
                    for r in range(rows):
                        found[r].append(cells(h, bits, r))
                if held > flush:
                    for r in range(rows):
                        yield _partials(found[r], r)
                        found[r] = []
                    held = 0
        if held:
            for r in range(rows):
                yield _partials(found[r], r)

    def bits_of(keys, count):
        found = [(int(k >> 32), int(k & 0xFFFFFFFF), c >= 2) for k, c in zip(keys, count, strict=True)]
        found = [{"row": r, "block": b, "bits": np.packbits(c, bitorder="little").tobytes()} for r, b, c in found if c.any()]
        return pa.RecordBatch.from_pylist(found, pa.schema([("row", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())]))

    def merge(batches):
        """Partial sketches come sorted by row and block, so that of all blocks only the last one stays open."""
        last = None  # the open block: its key and its counts
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy().astype(np.int64) << 32 | batch.column(1).to_numpy()
            hits = batch.column(2).cast(pa.large_binary())
            ends = np.frombuffer(hits.buffers()[1], np.int64)[hits.offset : hits.offset + len(hits) + 1]
            low = np.frombuffer(hits.buffers()[2], "<u2")
            lead = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            for i in range(0, len(lead) - 1, _TOGETHER):
                at = lead[i : i + _TOGETHER + 1]
                slot = np.repeat(np.arange(len(at) - 1), np.diff(ends[at]) // 2)
                count = np.bincount(slot << 16 | low[ends[at[0]] // 2 : ends[at[-1]] // 2], minlength=(len(at) - 1) * _BLOCK)
                count = np.minimum(count, 2).astype(np.uint8).reshape(-1, _BLOCK)
                keys = key[at[:-1]]
                if last is not None:
                    if last[0] == keys[0]:
                        count[0] = np.minimum(count[0] + last[1], 2)
                    else:
                        yield bits_of(last[0][None], last[1][None])
                if len(keys) > 1:
                    yield bits_of(keys[:-1], count[:-1])
                last = keys[-1], count[-1].copy()
        if last is not None:
            yield bits_of(last[0][None], last[1][None])

    parts = df.mapInArrow(scan, "row int, block int, hits binary").repartition("row", "block").sortWithinPartitions("row", "block").mapInArrow(merge, "row int, block int, bits binary")
    out = np.zeros((rows, (1 << bits) // 8), np.uint8)
    size = min(_BLOCK, 1 << bits) // 8
    for x in parts.collect():
        out[x["row"], x["block"] * size : (x["block"] + 1) * size] = np.frombuffer(x["bits"], np.uint8)[:size]
    return out


def maybe(sketch: np.ndarray, hashes: np.ndarray, bits: int) -> np.ndarray:
    """For each hash: may it occur twice or more?"""
    ok = np.ones(len(hashes), bool)
    for r in range(len(sketch)):
        at = cells(hashes, bits, r)
        ok &= (sketch[r][at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0
    return ok
