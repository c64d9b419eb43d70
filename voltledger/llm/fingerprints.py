"""Operator 11: document fingerprints from prefix polynomial hashes.

The polynomial hashes of all prefixes of a text (modulo the prime 2**61 - 1) give the hash of any span as a difference of two of them, so any
two spans are compared in constant time, and the longest common extension of two places is found by binary search over its length.

A fingerprint is the number of bytes, the hash of the whole text, and a sketch: the hashes of all spans of ``WINDOW`` bytes are dealt by
their highest bits to ``SLOTS`` slots, and each slot keeps its least hash (32 bits of it). A slot agrees in two texts with the probability
that a span of either is in both, J; the likeness is 2J / (1 + J), the share of spans that the texts have in common. Texts shorter than a window are
one span. Equal texts have equal fingerprints and likeness 1.

Texts are read in pieces of ``PIECE`` bytes (many short texts, or a part of a long one), so the prefix arrays are bounded whatever the length.

``fingerprints`` works by document, without a shuffle. ``edited`` needs the next document by descending doc_id: texts are exchanged once, by
ranges of doc_id taken from a sample (about ``SAMPLE`` ids a partition; it sets where partitions begin, and nothing else), sorted and streamed. The first
document of each range is sent to the range above as well, so the order has no seams; the last range gets the first document of all.

Defined results: a null text counts as empty; an empty text has an empty sketch, like nothing but another empty text; rows that repeat a doc_id
stand in the order of their texts, and each is followed by the next row; a null doc_id has no place in the order, so its edited columns are null; a
single document is followed by itself; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.llm import flat

WINDOW, SLOTS = 32, 64
PIECE = 1 << 16
SAMPLE = 100
_NONE = (1 << 32) - 1
_EMPTY = f"{_NONE:08x}"


class Prefixes(flat.Rolling):
    """Prefix hashes of ``values``: spans are compared by residues, places by extension."""

    def residue(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Sum of (value + 1) * base**i over each span, i from 0, modulo the prime."""
        whole = flat._mod(flat._mod(self.low[ends] - self.low[starts]) + flat._turn(flat._mod(self.high[ends] - self.high[starts])))
        return flat._times(whole, self.down[starts])

    def sliding(self, n: int) -> np.ndarray:
        """Residues of all spans of n values."""
        low, high = self.low[n:] - self.low[:-n], self.high[n:] - self.high[:-n]
        return flat._times(flat._mod(flat._mod(low) + flat._turn(flat._mod(high))), self.down[: len(low)])

    def extension(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length, up to ``most``, of the longest common extension of places a and b."""
        low, high = np.zeros(len(a), np.int64), most.astype(np.int64)
        while (low < high).any():
            half = (low + high + 1) >> 1
            equal = self.residue(a, a + half) == self.residue(b, b + half)
            low, high = np.where(equal, half, low), np.where(equal, high, half - 1)
        return low


def _keep(slots: np.ndarray, text: np.ndarray, spans: np.ndarray) -> None:
    """Put the hashes of spans into the slots of their texts."""
    h = flat.mix(spans, 11)
    np.minimum.at(slots, text * SLOTS + (h >> np.uint64(58)).astype(np.int64), np.minimum((h >> np.uint64(26)) & np.uint64(_NONE), np.uint64(_NONE - 1)))


def _scan(texts: list[bytes], window: int, pairs: np.ndarray) -> tuple[list[str], np.ndarray]:
    """Fingerprints of the texts, and the length in bytes of the longest common prefix of each pair (rows of two numbers of texts)."""
    n, size = len(texts), np.array([len(t) for t in texts], np.int64)
    whole, slots = np.zeros(n, np.uint64), np.full(n * SLOTS, _NONE, np.uint64)
    common, open_ = np.zeros(len(pairs), np.int64), np.ones(len(pairs), bool)
    for begin in range(0, max(1, int(size.max(initial=0))), PIECE):
        parts = [t[begin : begin + PIECE + window - 1] for t in texts]
        length = np.array([len(p) for p in parts], np.int64)
        at = np.concatenate(([0], np.cumsum(length)))
        data = np.frombuffer(b"".join(parts), np.uint8)
        if not len(data):
            break
        own = np.minimum(length, PIECE)  # the rest is only the reach of the last windows
        prefixes = Prefixes(data)
        whole = flat._mod(whole + flat._times(prefixes.residue(at[:-1], at[:-1] + own), np.full(n, pow(int(flat._P), begin, int(flat.PRIME)), np.uint64)))
        text = np.repeat(np.arange(n), length)
        if len(data) >= window:
            inside = text[: len(data) - window + 1] == text[window - 1 :]
            _keep(slots, text[: len(inside)][inside], prefixes.sliding(window)[inside])
        short = np.flatnonzero((size < window) & (length > 0))
        _keep(slots, short, prefixes.residue(at[short], at[short + 1]))
        if open_.any():
            x, y = pairs[open_, 0], pairs[open_, 1]
            most = np.minimum(own[x], own[y])
            got = prefixes.extension(at[x], at[y], most)
            common[open_] += got
            open_[open_] = (got == most) & (own[x] == PIECE) & (own[y] == PIECE)
    sketch = slots.astype(">u4").tobytes().hex()
    wide = 8 * SLOTS
    return [f"{s}.{h:016x}.{sketch[i * wide : (i + 1) * wide]}" for i, (s, h) in enumerate(zip(size.tolist(), whole.tolist(), strict=True))], common


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, of two fingerprints: the share of spans that their texts have in common; 1 if they are equal, null if one is null."""
    slots = lambda c: F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda i: F.substr(c, F.length(c) - F.lit(8 * SLOTS) + i * 8 + 1, F.lit(8)))
    score = lambda x, y: F.when(x != y, 1 << 16).when(x != _EMPTY, 1).otherwise(0)
    # slots that agree, and above bit 16 slots that differ
    total = F.aggregate(F.zip_with(slots(a), slots(b), score), F.lit(0), lambda n, v: n + v)
    share = F.transform(F.array(total), lambda n: 2 * n.bitwiseAND(0xFFFF) / (2 * n.bitwiseAND(0xFFFF) + F.shiftright(n, 16)))[0]
    return F.when(a == b, F.lit(1.0)).when(a != b, share)


def fingerprints(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_chars, fingerprint: one row per row of docs."""

    def emit(batches):
        for batch in batches:
            for rows in _groups([t or "" for t in batch.column(1).to_pylist()]):
                texts = [t for _, t in rows]
                found, _ = _scan([t.encode() for t in texts], window, np.zeros((0, 2), np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in rows])), pa.array([len(t) for t in texts], pa.int64()), pa.array(found)], ["doc_id", "n_chars", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(emit, "doc_id bigint, n_chars bigint, fingerprint string")


def _groups(texts: list[str]) -> Iterator[list[tuple[int, str]]]:
    """Numbered texts, in order, of about PIECE characters together; one at least."""
    rows, held = [], 0
    for i, t in enumerate(texts):
        if rows and held + len(t) > PIECE:
            yield rows
            rows, held = [], 0
        rows.append((i, t))
        held += len(t)
    if rows:
        yield rows


def _ranges(ids: DataFrame, partitions: int) -> np.ndarray:
    """Ascending doc_ids, each the largest of its range; the last is the largest of all."""
    seen = ids.agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("top")).first()
    if not seen.n:
        return np.zeros(0, np.int64)
    share = min(1.0, SAMPLE * partitions / seen.n)
    some = ids.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= int(share * (1 << 30))).toArrow()
    some = np.sort(some.column(0).to_numpy())
    at = (np.arange(1, partitions) * len(some)) // partitions
    return np.unique(np.append(some[at] if len(some) else np.zeros(0, np.int64), seen.top))


def edited(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Each document against itself with its last third replaced by the beginning of the next one, by descending doc_id.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint, common_chars: how many code points the text and the edited
    text share before they first differ.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tops = _ranges(docs.select("doc_id").where("doc_id is not null"), partitions)
    ranges = max(1, len(tops))

    def place(batches):
        """part; turn: 0 a document of the part, 1 a copy that only follows the last one, 2 one without doc_id."""
        dealt = 0
        for batch in batches:
            ids = batch.column(0)
            rows = np.flatnonzero(~np.asarray(ids.is_null()))
            have = ids.take(pa.array(rows)).to_numpy(zero_copy_only=False).astype(np.int64)
            part = np.searchsorted(tops, have, "left")
            again = np.flatnonzero(tops[part] == have) if len(have) else rows
            none = np.flatnonzero(np.asarray(ids.is_null()))
            spread = (np.arange(len(none)) + dealt) % ranges
            dealt += len(none)
            src = np.concatenate((rows, rows[again], none))
            parts = np.concatenate((part, (part[again] + 1) % ranges, spread)).astype(np.int32)
            turn = np.repeat(np.array([0, 1, 2], np.int32), [len(rows), len(again), len(none)])
            chosen = batch.take(pa.array(src))
            yield pa.RecordBatch.from_arrays([pa.array(parts), pa.array(turn), chosen.column(0), chosen.column(1)], ["part", "turn", "doc_id", "text"])

    def follow(batches):
        """Rows in order; each waits for the one behind it."""

        def ordered():
            for batch in batches:
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

        def followed():
            last = None
            for row in ordered():
                if last and last[1] == 0 and row[0] == last[0] and row[1] < 2:
                    yield last[2], last[3] or "", row[3] or ""
                if row[1] == 2:
                    yield None, row[3] or "", None
                last = row

        rows, held = [], 0
        for row in followed():
            if rows and held + len(row[1]) + len(row[2] or "") > PIECE:
                yield compare(rows)
                rows, held = [], 0
            rows.append(row)
            held += len(row[1])
        if rows:
            yield compare(rows)

    def compare(rows):
        """rows: doc_id, text, next text. In order, so that the next text is mostly the text of the next row."""
        texts: list[str] = []
        number: dict[int, int] = {}  # by row
        after: list[int | None] = []
        for i, (_, text, _) in enumerate(rows):
            number[i] = len(texts)
            texts.append(text)
        for i, (_, _, behind) in enumerate(rows):
            if behind is None or i + 1 < len(rows) and rows[i + 1][1] is behind:
                after.append(None if behind is None else number[i + 1])
            else:
                after.append(len(texts))
                texts.append(behind)
        encoded = [t.encode() for t in texts]
        mine, pairs = {}, []
        for i, (_, text, behind) in enumerate(rows):
            if behind is not None:
                third = len(text) // 3
                mine[i] = len(encoded)
                encoded.append((text[: len(text) - third] + behind[:third]).encode())
                pairs.append((number[i], mine[i]))
        found, common = _scan(encoded, window, np.array(pairs, np.int64).reshape(-1, 2))
        shared = {i: len(encoded[number[i]][:c].decode(errors="ignore")) for i, c in zip(mine, common.tolist(), strict=True)}
        hashed = {i: hashlib.sha256(encoded[k]).hexdigest() for i, k in mine.items()}
        get = lambda k: None if k is None else found[k]
        every = range(len(rows))
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(r[1]) for r in rows], pa.int64()), pa.array([hashed.get(i) for i in every], pa.string()), pa.array([found[number[i]] for i in every], pa.string()), pa.array([get(mine.get(i)) for i in every], pa.string()), pa.array([get(k) for k in after], pa.string()), pa.array([shared.get(i) for i in every], pa.int64())], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint", "common_chars"])

    dealt = docs.select("doc_id", "text").mapInArrow(place, "part int, turn int, doc_id bigint, text string")
    stream = dealt.repartitionById(ranges, "part").sortWithinPartitions("part", "turn", F.desc("doc_id"), "text")
    return stream.mapInArrow(follow, "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string, common_chars bigint")
