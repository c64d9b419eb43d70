"""Operator 10: lines held by many documents, by range partitions and a secondary sort.

Map tasks send (hash of the line's key, doc_id, line number). The rows are range-partitioned by hash, then document
(latest first) and position, so one hot line spreads over several partitions, and each partition is streamed in order, batch by batch: the
first document of a key keeps its lines, later ones lose theirs once the key has enough documents. What waits for that are the lines of less than
``min_docs`` documents. A key that crosses
partitions is settled by one small summary per partition (two keys each; their number is that of the partitions, not of
the rows). What goes back to the documents is a compressed bitmap per document, not text.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys are compared by a 64-bit hash.

Defined results: a null or empty text is one empty line and loses nothing; a null doc_id takes no part and is returned
whole; repeated rows of one doc_id are one document, and lose or keep their lines alike; other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.llm import flat
from voltledger.llm.shared import cut

MIN_CHARS, MIN_DOCS = 40, 5


def _keys(data: np.ndarray, offsets: np.ndarray, min_chars: int):
    """(text, line number, hash of the key) of every line whose key has min_chars code points."""
    of, number, starts, ends = flat.lines(data, offsets)
    solid = np.flatnonzero(~flat._BREAK[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    full = a < b
    of, number, a, b = of[full], number[full], solid[a[full]], solid[b[full] - 1] + 1
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    long = points[b] - points[a] >= min_chars
    of, number, a, b = of[long], number[long], a[long], b[long]
    return of, number, flat.Rolling(flat.lower(data))(a, b) if len(a) else np.zeros(0, np.uint64)


def _runs(*columns: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _arrays(batches):
    """(hash, document, line) of each batch with rows."""
    return ([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)] for b in batches if b.num_rows)


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, dropped binary: zlib-compressed bitmap (bit i of the little-endian bytes: line i goes)."""
    from pyspark import TaskContext

    def emit(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, data, offsets in flat.text_slices(batch):
                of, number, h = _keys(data, offsets, min_chars)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[rows][of]), pa.array(number)], ["h", "doc_id", "line"])

    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    order = ["h", F.desc("doc_id"), "line"]
    met = cut(texts.mapInArrow(emit, "h bigint, doc_id bigint, line bigint").repartitionByRange(*order).sortWithinPartitions(*order))

    names = ("part", "h0", "docs0", "top0", "low0", "h1", "docs1", "top1", "low1")

    def ends(batches):
        """One row a partition: its first and its last key, with their documents (how many, the first and the last of them)."""
        first, last = None, None  # [key, documents, largest, smallest so far]
        opening = True
        for h, doc, _ in _arrays(batches):
            new = _runs(h, doc)
            if last and (last[0], last[3]) == (h[0], doc[0]):
                new[0] = False
            first = first or [int(h[0]), 0, int(doc[0]), None]
            same = h == first[0]
            if opening and same.any():
                first[1], first[3] = first[1] + int(new[same].sum()), int(doc[same][-1])
            opening = opening and bool(same.all())
            same = h == h[-1]
            had = last if last and last[0] == h[-1] else [int(h[-1]), 0, int(doc[same][0]), None]
            last = [had[0], had[1] + int(new[same].sum()), had[2], int(doc[-1])]
        if first:
            yield pa.RecordBatch.from_pylist([dict(zip(names, (TaskContext.get().partitionId(), *first, *last), strict=True))])

    parts = sorted(met.mapInArrow(ends, ", ".join(f"{x} bigint" for x in names)).collect())
    before: dict[int, tuple] = {}  # by partition: (largest document of its first key, its documents so far, the last of them)
    after: dict[int, tuple] = {}  # by partition: (documents of its last key in later partitions, the first of them)
    open_key = None
    for p in parts:
        if open_key and open_key[0] == p.h0:
            before[p.part] = open_key[1:]
        if p.h0 == p.h1:
            had = before.get(p.part)
            open_key = (p.h1, had[0], had[1] + p.docs1 - (had[2] == p.top1), p.low1) if had else (p.h1, p.top1, p.docs1, p.low1)
        else:
            open_key = (p.h1, p.top1, p.docs1, p.low1)
    open_key = None
    for p in reversed(parts):
        if open_key and open_key[0] == p.h1:
            after[p.part] = open_key[1:]
        if p.h0 == p.h1 and p.part in after:
            n, top = after[p.part]
            open_key = (p.h0, n + p.docs0 - (p.low0 == top), p.top0)
        else:
            open_key = (p.h0, p.docs0, p.top0)

    def decide(batches):
        """Batch by batch. Of the open key only the rows that are still undecided stay: those of less than ``min_docs`` documents."""
        part = TaskContext.get().partitionId()
        rows = lambda doc, line: pa.RecordBatch.from_arrays([pa.array(doc), pa.array(line)], ["doc_id", "line"])
        state, held = None, []  # the open key: (hash, documents so far, the largest, the last)
        for h, doc, line in _arrays(batches):
            if state is None and part in before:
                top, n, low = before[part]
                state = (h[0], n, top, low)
            lead = np.flatnonzero(_runs(h))
            key = np.repeat(np.arange(len(lead)), np.diff(np.append(lead, len(h))))
            docs_of = np.add.reduceat(_runs(h, doc).astype(np.int64), lead)
            top = doc[lead].copy()
            if state and state[0] == h[0]:
                docs_of[0] += state[1] - (state[3] == doc[0])
                top[0] = state[2]
                if docs_of[0] >= min_docs:
                    yield from (rows(*x) for x in held)
                    held = []
            else:
                held = []
            gone = (docs_of[key] >= min_docs) & (doc != top[key])
            yield rows(doc[gone], line[gone])
            if len(lead) > 1:
                held = []
            if docs_of[-1] < min_docs:
                wait = (key == len(lead) - 1) & (doc != top[-1])
                held.append((doc[wait], line[wait]))
            state = (h[-1], docs_of[-1], top[-1], doc[-1])
        if held and part in after and state[1] + after[part][0] - (after[part][1] == state[3]) >= min_docs:
            yield from (rows(*x) for x in held)

    def pack(batches):
        for batch in batches:
            bits = []
            for lines in batch.column(1):
                at = lines.values.to_numpy(zero_copy_only=False)
                mask = np.zeros(int(at.max()) + 1, bool)
                mask[at] = True
                bits.append(zlib.compress(np.packbits(mask, bitorder="little").tobytes(), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["doc_id", "dropped"])

    gone = met.mapInArrow(decide, "doc_id bigint, line bigint").groupBy("doc_id").agg(F.collect_list("line").alias("lines"))
    return gone.mapInArrow(pack, "doc_id bigint, dropped binary")


def _stay(text: str | None, bits) -> tuple[list[str], int]:
    """The lines that stay, and how many there were."""
    lines = (text or "").split("\n")
    if not bits.is_valid:
        return lines, len(lines)
    mask = np.unpackbits(np.frombuffer(zlib.decompress(bits.as_py()), np.uint8), bitorder="little").tolist()
    return [x for i, x in enumerate(lines) if i >= len(mask) or not mask[i]], len(lines)


def remove_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, kept string (lines that stay, joined by \\n), n_lines, n_dropped: one row per input row."""

    def apply(batches):
        for batch in batches:
            done = [_stay(text.as_py(), bits) for text, bits in zip(batch.column(1), batch.column(2), strict=True)]
            columns = [pa.array(["\n".join(x) for x, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64()), pa.array([n - len(x) for x, n in done], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "kept", "n_lines", "n_dropped"])

    joined = docs.select("doc_id", "text").join(dropped_lines(docs, min_chars, min_docs), "doc_id", "left").select("doc_id", "text", "dropped")
    return joined.mapInArrow(apply, "doc_id bigint, kept string, n_lines bigint, n_dropped bigint")


def without_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs, all columns, with the dropped lines gone from text; a null text stays null."""
    at = docs.columns.index("text")
    doc_id, dropped = (f"__{uuid.uuid4().hex}" for _ in range(2))  # no column of docs
    bits = dropped_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias(doc_id), F.col("dropped").alias(dropped))

    def apply(batches):
        for batch in batches:
            text = pa.array(["\n".join(_stay(t.as_py(), b)[0]) if b.is_valid else t.as_py() for t, b in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True)], pa.string())
            columns = batch.columns[:-1]
            columns[at] = text
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    joined = docs.join(bits, docs["doc_id"] == F.col(doc_id), "left").drop(doc_id)
    return joined.mapInArrow(apply, docs.schema)
