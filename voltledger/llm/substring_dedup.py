"""Operator 8: repeated word windows, found by a count-min prefilter and one exact pass.

1. Every map task sketches the hashes of all its windows; merged, the sketch says which windows *may* occur twice.
2. A second sketch, with its own hash, counts only the windows that the first one let through.
3. Windows that both call repeated are grouped exactly, by one shuffle on the window's hash. A map task keeps one row
   (its earliest) of each hash and reports its other occurrences as decided, so a window held by a third of all
   documents costs a reducer no more rows than there are map tasks.

Nothing is lost: a count-min estimate is never below the count. Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.

Defined results: a null or empty text has no words and loses nothing; a text of fewer words than the window loses
nothing; a row with a null doc_id takes no part and is returned whole; equal rows (same doc_id and text) are one
occurrence, so none of them loses text to the other; columns other than doc_id and text are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.llm import flat, sketch

WINDOW = 20
#: Sketches: at least 2**bits cells, doubled for larger corpora until there is a cell for so many bytes of text.
FIRST_BITS, SECOND_BITS, BYTES_A_CELL = 28, 28, 5
_GATHER = 1 << 20


def _windows(batch: pa.RecordBatch, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row in the batch, word position in its text, hash) of all k-word windows."""
    for rows, data, offsets in flat.text_slices(batch):
        starts, ends, firsts = flat.words(data, offsets)
        at, h = flat.windows(flat.Rolling(data)(starts, ends), firsts, k)
        doc = np.searchsorted(firsts, at, "right") - 1
        yield doc + rows.start, at - firsts[doc], h


def _earliest(h, doc, pos) -> pa.RecordBatch:
    """One row of each hash, the earliest, to be compared with other tasks'; the others are decided."""
    order = np.lexsort((pos, doc, h))
    h, doc, pos = h[order], doc[order], pos[order]
    lead = np.ones(len(h), bool)
    lead[1:] = h[1:] != h[:-1]
    first = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
    decided = (doc != doc[first]) | (pos != pos[first])
    use = lead | decided
    key = np.where(decided, flat.mix(doc.view(np.uint64)), h)[use]
    return pa.RecordBatch.from_arrays([pa.array(decided[use]), pa.array(key.view(np.int64)), pa.array(doc[use]), pa.array(pos[use].astype(np.int32))], ["decided", "h", "doc_id", "pos"])


def repeated_starts(docs: DataFrame, window: int = WINDOW, first_bits: int | None = None, second_bits: int | None = None) -> DataFrame:
    """doc_id, starts array<int>: word positions where a window starts that also starts earlier."""
    spark = docs.sparkSession
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    more = sketch.doublings(texts, FIRST_BITS, BYTES_A_CELL) if first_bits is None or second_bits is None else 0
    first_bits, second_bits = FIRST_BITS + more if first_bits is None else first_bits, SECOND_BITS + more if second_bits is None else second_bits
    all_hashes = lambda batch: (h for _, _, h in _windows(batch, window))
    one = spark.sparkContext.broadcast(sketch.repeated(texts, all_hashes, first_bits))
    passed = lambda batch: (h[sketch.maybe(one.value, h, first_bits)] for h in all_hashes(batch))
    two = spark.sparkContext.broadcast(sketch.repeated(texts, lambda b: (flat.mix(h, 7) for h in passed(b)), second_bits))

    def emit(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, pos, h in _windows(batch, window):
                ok = sketch.maybe(one.value, h, first_bits)
                ok[ok] = sketch.maybe(two.value, flat.mix(h[ok], 7), second_bits)
                held.append((h[ok], ids[row[ok]], pos[ok]))
                n += len(held[-1][0])
                if n > _GATHER:
                    yield _earliest(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield _earliest(*map(np.concatenate, zip(*held, strict=True)))

    def decide(batches):
        h0, doc0, pos0 = None, 0, 0
        for batch in batches:
            known, h, doc, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if not len(h):
                continue
            lead = np.ones(len(h), bool)
            lead[1:] = (h[1:] != h[:-1]) | (known[1:] != known[:-1])
            first = np.maximum.accumulate(np.where(lead, np.arange(len(h)), 0))
            fd, fp = doc[first], pos[first]
            if h0 is not None and not known[0] and h[0] == h0:
                run = int(np.argmax(lead[1:])) + 1 if lead[1:].any() else len(h)
                fd[:run], fp[:run] = doc0, pos0
            gone = known | (doc != fd) | (pos != fp)
            h0, doc0, pos0 = (None if known[-1] else h[-1]), fd[-1], fp[-1]
            yield pa.RecordBatch.from_arrays([pa.array(doc[gone]), pa.array(pos[gone])], ["doc_id", "pos"])

    met = texts.mapInArrow(emit, "decided boolean, h bigint, doc_id bigint, pos int").repartition("h").sortWithinPartitions("decided", "h", "doc_id", "pos")
    return met.mapInArrow(decide, "doc_id bigint, pos int").groupBy("doc_id").agg(F.collect_set("pos").alias("starts"))


def remove_repeated_windows(docs: DataFrame, window: int = WINDOW, first_bits: int | None = None, second_bits: int | None = None) -> DataFrame:
    """doc_id, kept string (words that stay, joined by one space), n_words, n_removed: one row per input row.

    A word goes if it lies in a window whose word sequence also starts earlier: in a smaller doc_id, or earlier in the
    same document. ``first_bits`` and ``second_bits`` are the sizes of the sketches (2**bits bits each), by the texts where not given, and affect only speed.
    """
    starts = repeated_starts(docs, window, first_bits, second_bits)

    def apply(batches):
        for batch in batches:
            kept, n_words, n_removed = [], [], []
            for i, text in enumerate(batch.column(1)):
                found = (text.as_py() or "").encode().split()
                n_words.append(len(found))
                at = batch.column(2)[i]
                if at.is_valid:
                    at = np.unique(at.values.to_numpy(zero_copy_only=False))
                    gone = flat.covered(at[at + window <= len(found)], window, len(found))
                    n_removed.append(int(gone.sum()))
                    found = [w for w, g in zip(found, gone.tolist(), strict=True) if not g]
                else:
                    n_removed.append(0)
                kept.append(b" ".join(found).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], ["doc_id", "kept", "n_words", "n_removed"])

    joined = docs.select("doc_id", "text").join(starts, "doc_id", "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(apply, "doc_id bigint, kept string, n_words bigint, n_removed bigint")
