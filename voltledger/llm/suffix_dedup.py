"""Operator 7: repeated byte strings, by distributed prefix doubling on the positions that can matter.

Prefix doubling names every position by the pair (rank of its first half, name of its second half), sorts the pairs, reranks them and
drops what is unique, until the threshold length. Over all positions the first sort alone would move 8 bytes and a
place for every byte of text (20 times the input's disk), so the rounds below keep only positions that can still decide something:

* Reduction. A window of ``length`` bytes has an anchor: the least hash of the 16-byte strings at its first ``reach`` positions. Windows with
  one anchor form a run and share a *core*, the length - reach + 1 bytes from the anchor on. Equal windows have equal cores, so
  runs whose core is unique are out. That is estimated without a shuffle of positions by two merged sketches (never too low): one of the cores of
  windows of ``short`` bytes, which begin every core, then one of the whole cores that are left.
* Ends. Two remaining runs side by side have a *joint*: the last window of one and the first of the other, one string of length + 1 bytes;
  where a run has no such neighbour, its end is a window alone. Equal windows have equal anchors, so equal joints are joints in all their texts.
  Round 1 sorts all joints and ends by their prefix of length / 4 and the name of the next length / 4 bytes; Spark's sort ranks them, unique ones
  drop out. Round 2 sorts the others by that rank of the first half and the name of the second half. A run with both ends repeated
  has all its bytes covered and is done.
* Inside. Of the other runs (those at the ends of repeated passages) all windows are named and sorted alike, in one round: that their cores are
  repeated is known, so a shorter prefix would drop next to nothing. They are met by witnesses, one per map task and distinct
  window, from all runs with such a run's core.

Repeats of less than ``length`` bytes are not removed, but reported: ``n_shared`` counts the cores of windows of ``short`` bytes that another
document holds too. A passage of ``short`` bytes has one at least. (Those that the first sketch leaves are grouped exactly.)

Names are hashes of 64 bits, in a sort with 32 bits more of another one. A map task sends one witness of a string it saw often and reports its
occurrences as decided, so a hot string costs a reducer no more rows than there are map tasks.

Defined results: a null or empty text has 0 bytes and loses nothing, like any text shorter than ``length``; a null doc_id takes no part
and is returned whole; a repeated row repeats its strings, so both rows lose them (their ``n_shared`` counts the blocks of both), and rows that repeat a doc_id should carry one text; other columns are ignored; an empty
table gives an empty result. Matches never cross documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.llm import flat, sketch
from voltledger.llm.shared import saved

LENGTH, SHORT, REACH, GRAM = 400, 256, 48, 16
#: Sketches: at least 2**bits cells, doubled for larger corpora until there is a cell for so many bytes of text.
FIRST_BITS, SECOND_BITS, BYTES_A_CELL = 28, 27, 10
_GATHER, _SLICE = 1 << 18, 1 << 18


@dataclass
class Runs:
    """Runs of windows with one anchor: text, first and last window start (bytes, in the slice), anchor, hash of the core."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    anchor: np.ndarray
    core: np.ndarray
    roll: flat.Rolling


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A quick hash of every string of ``gram`` bytes (it only chooses anchors): strings of 1, 2, 4, ... bytes side by side."""
    whole, done, part, width = None, 0, data.astype(np.uint64) + np.uint64(1), 1
    while width <= gram:
        if gram & width:
            whole = part if whole is None else whole[: len(part) - done] * np.uint64(0xBF58476D1CE4E5B9) + part[done:]
            done += width
        part = part[: max(len(part) - width, 0)] * np.uint64(0x9E3779B97F4A7C15 + 2 * width) + part[width:]
        part ^= part >> np.uint64(29)
        width *= 2
    return (whole * np.uint64(0x94D049BB133111EB))[: max(len(data) - gram + 1, 0)]


def runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, reach: int = REACH, gram: int = GRAM) -> Runs:
    n = len(data)
    roll = flat.Rolling(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return Runs(none, none, none, none, none.view(np.uint64), roll)
    least = _grams(data, gram)
    least = least >> np.uint64(32) << np.uint64(32) | np.arange(len(least), dtype=np.uint64)
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    size = np.maximum(np.diff(offsets) - length + 1, 0)
    text = np.repeat(np.arange(len(size)), size)
    start = np.repeat(offsets[:-1] - (np.cumsum(size) - size), size) + np.arange(size.sum())
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    lead = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])) if len(anchor) else none
    tail = np.append(lead[1:], len(anchor)) - 1 if len(lead) else none
    return Runs(text[lead], start[lead], start[tail], anchor[lead], roll(anchor[lead], anchor[lead] + length - reach + 1), roll)


#: Rows of the rounds. state: 0 open, 1 decided (repeated), 2 unique. a, b: what is sorted. more: the name of the second half, for the next
#: round. pos: twice the place in the text, plus 1 for a joint; negative for a witness. cores: both runs', 32 bits each.
_ROW = "state int, a bigint, b int, more bigint, often boolean, doc_id bigint, pos bigint, cores bigint"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _rows(state, a, b, more, often, doc, pos, cores) -> pa.RecordBatch:
    kinds = (np.int32, np.int64, np.int32, np.int64, bool, np.int64, np.int64, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x).astype(k)) for x, k in zip((state, a, b, more, often, doc, pos, cores), kinds, strict=True)], _NAMES)


def _gathered(held: list[tuple]) -> pa.RecordBatch:
    """Rows of one flush. Of a string met more than once: its occurrences as decided, and one open row."""
    columns = [np.concatenate(x) for x in zip(*held, strict=True)]
    held.clear()
    order = np.lexsort((-columns[4], columns[2], columns[1], columns[0]))
    for i, x in enumerate(columns):
        columns[i] = x[order]
    a, b, more, doc, pos, cores = columns
    at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (more[1:] != more[:-1])))
    size = np.diff(np.append(at, len(a)))
    often = np.repeat(size > 1, size)
    lead = np.zeros(len(a), bool)
    lead[at] = True
    decided = often & ~lead
    key = np.where(decided, flat.mix(doc.view(np.uint64)), a).view(np.int64)
    zero = lambda x: np.where(decided, 0, x)
    use = lead | (pos >= 0)
    return _rows(*(x[use] for x in (decided, key, zero(b), zero(more.view(np.int64)), often, doc, pos, zero(cores))))


def _groups(batches):
    """Of rows sorted by state, a, b: (columns, first row of each group, whether the group has two rows or more, whether the first group continues the last one).

    A lone last row waits for the next batch, so that every group is known to be repeated or not when its first row comes.
    """
    known, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(len(_NAMES))]
        if held is not None:
            columns = [np.concatenate((h, c)) for h, c in zip(held, columns, strict=True)]
            held = None
        state, a, b, _, often = columns[:5]
        at = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (state[1:] != state[:-1])))
        twice = (np.diff(np.append(at, len(a))) > 1) | often[at]
        goes_on = known == (state[0], a[0], b[0])
        twice[0] |= goes_on
        known = (state[-1], a[-1], b[-1]) if twice[-1] else None
        if not twice[-1]:
            held = [c[-1:] for c in columns]
            columns, at, twice = [c[:-1] for c in columns], at[:-1], twice[:-1]
        if len(at):
            yield columns, at, twice, goes_on
    if held is not None:
        yield held, np.zeros(1, np.int64), np.zeros(1, bool), False


def _rerank(batches):
    """Round 1, of rows sorted by state, a, b: groups get ranks and go on by (rank, name of the second half); what is unique leaves its cores only."""
    from pyspark import TaskContext

    rank = TaskContext.get().partitionId() << 40  # ranks of a partition are numbered from here
    for (state, a, b, more, often, doc, pos, cores), at, twice, goes_on in _groups(batches):
        ranks = rank + np.cumsum(~np.append(goes_on, np.zeros(len(at) - 1, bool)))
        rank = int(ranks[-1])
        size = np.diff(np.append(at, len(a)))
        ranks, twice = np.repeat(ranks, size).astype(np.uint64), np.repeat(twice, size)
        second = more.view(np.uint64)
        pair, check = flat.mix(ranks * np.uint64(0x9E3779B97F4A7C15) + second, 12).view(np.int64), (flat.mix(second, 13) >> np.uint64(32)).astype(np.uint32).view(np.int32)
        goes = (state == 0) & twice
        key = np.where(goes, pair, np.where(state == 1, a, flat.mix(cores.view(np.uint64)).view(np.int64)))
        left = (state == 0) & ~twice
        yield _rows(np.where(left, 2, state), key, np.where(goes, check, 0), np.zeros(len(a)), often, np.where(left, 0, doc), np.where(left, -1, pos), cores)


def _decide(batches):
    """The last round, of rows sorted by state, a, b: the places of strings that occur twice or more, and the cores of the other rows."""
    for (state, a, _, _, _, doc, pos, cores), at, twice, _ in _groups(batches):
        twice = np.repeat(twice, np.diff(np.append(at, len(a)))) & (state != 2) | (state == 1)
        keep = (pos >= 0) | ~twice
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(pos[keep], mask=~twice[keep]), pa.array(cores[keep], mask=twice[keep])], ["doc_id", "pos", "cores"])


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("a", "b").sortWithinPartitions("state", "a", "b")


def _decided(rows: DataFrame) -> DataFrame:
    """doc_id, pos of the rows whose string occurs twice or more; null pos and the runs' cores for the other rows."""
    return _sorted(rows).mapInArrow(_decide, "doc_id bigint, pos bigint, cores bigint")


def _starts(ruled: DataFrame) -> DataFrame:
    return ruled.where("pos is not null").groupBy("doc_id").agg(F.collect_list("pos").alias("starts"))


def _blocks(core: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
    """Rows (state, core, doc_id, n, often) of one flush: n blocks of a document with a core. If two documents here hold the core, they are decided
    (state 1, summed by document), and one row stands for them elsewhere."""
    order = np.lexsort((doc, core))
    core, doc = core[order], doc[order]
    new = np.append(True, (core[1:] != core[:-1]) | (doc[1:] != doc[:-1]))
    n = np.diff(np.append(np.flatnonzero(new), len(core)))
    core, doc = core[new], doc[new]
    at = np.flatnonzero(np.append(True, core[1:] != core[:-1]))
    size = np.diff(np.append(at, len(core)))
    shared = np.repeat(size > 1, size)
    own, where = np.unique(doc[shared], return_inverse=True)
    sums = np.bincount(where, weights=n[shared], minlength=len(own)).astype(np.int64)
    lead, alone = at[size > 1], ~shared
    parts = (
        (np.full(len(own), 1), flat.mix(own.view(np.uint64)), own, sums, np.ones(len(own), bool)),
        (np.zeros(len(lead)), core[lead], doc[lead], np.zeros(len(lead)), np.ones(len(lead), bool)),
        (np.zeros(alone.sum()), core[alone], doc[alone], n[alone], np.zeros(alone.sum(), bool)),
    )
    state, core, doc, n, often = (np.concatenate(x) for x in zip(*parts, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(state.astype(np.int32)), pa.array(core.view(np.int64)), pa.array(doc), pa.array(n.astype(np.int64)), pa.array(often)], ["state", "core", "doc_id", "n", "often"])


def _counted(batches):
    """Of such rows sorted by state, core, doc_id: (doc_id, n) of the blocks that two documents or more hold."""
    known, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
        if held is not None:
            columns = [np.append(h, c) for h, c in zip(held, columns, strict=True)]
            held = None
        state, core, doc, n, often = columns
        at = np.flatnonzero(np.append(True, (core[1:] != core[:-1]) | (state[1:] != state[:-1])))
        end = np.append(at[1:], len(core)) - 1
        shared = (doc[at] != doc[end]) | np.logical_or.reduceat(often, at) | (state[at] == 1)
        shared[0] |= known == (state[0], core[0])
        known = (state[-1], core[-1]) if shared[-1] else None
        if not shared[-1]:  # rows of one document so far
            held = [state[-1:], core[-1:], doc[-1:], n[at[-1] :].sum(keepdims=True), often[-1:]]
        use = np.repeat(shared, end - at + 1) & (n > 0)
        yield pa.RecordBatch.from_arrays([pa.array(doc[use]), pa.array(n[use])], ["doc_id", "n"])


def _windows_of(pos: np.ndarray) -> np.ndarray:
    """Places of all windows that ``pos`` stands for: one, or two of a joint."""
    at = pos >> 1
    return np.concatenate((at, at[pos & 1 == 1] + 1))


def repeated_starts(docs: DataFrame, length: int = LENGTH, short: int = SHORT, reach: int = REACH, first_bits: int | None = None, second_bits: int | None = None) -> DataFrame:
    """doc_id, starts array<long>: windows that occur elsewhere too (see ``_windows_of``), enough of them to cover every such byte; n_shared."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    half = length // 2
    more = sketch.doublings(texts, FIRST_BITS, BYTES_A_CELL) if first_bits is None or second_bits is None else 0
    first_bits, second_bits = FIRST_BITS + more if first_bits is None else first_bits, SECOND_BITS + more if second_bits is None else second_bits

    short = min(short, length)
    gram, block = min(GRAM, short - reach), short - reach + 1

    def short_cores(batch):
        for _, data, offsets in flat.text_slices(batch, limit=_SLICE):
            yield runs(data, offsets, short, reach, gram).core

    one = sc.broadcast(sketch.repeated(texts, short_cores, first_bits))

    def begun(batch):
        """(rows, offsets, runs, whether the first sketch leaves them)."""
        for rows, data, offsets in flat.text_slices(batch, limit=_SLICE):
            found = runs(data, offsets, length, reach, gram)
            yield rows, offsets, found, sketch.maybe(one.value, found.roll(found.anchor, found.anchor + block), first_bits)

    two = sc.broadcast(sketch.repeated(texts, lambda batch: (flat.mix(found.core[ok], 5) for _, _, found, ok in begun(batch)), second_bits, 2))

    def alive(batch):
        """(rows, runs, start of each run's text, indices of the runs that both sketches leave)."""
        for rows, offsets, found, ok in begun(batch):
            ok[ok] = sketch.maybe(two.value, flat.mix(found.core[ok], 5), second_bits)
            yield rows, found, offsets[found.text], np.flatnonzero(ok)

    def blocks(batches):
        held, n = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, data, offsets in flat.text_slices(batch, limit=_SLICE):
                found = runs(data, offsets, short, reach, gram)
                ok = sketch.maybe(one.value, found.core, first_bits)
                held.append((found.core[ok], ids[rows][found.text[ok]]))
                n += len(held[-1][0])
                if n > _GATHER:
                    yield _blocks(*map(np.concatenate, zip(*held, strict=True)))
                    held, n = [], 0
        if n:
            yield _blocks(*map(np.concatenate, zip(*held, strict=True)))

    rows = texts.mapInArrow(blocks, "state int, core bigint, doc_id bigint, n bigint, often boolean")
    shared = rows.repartition("core").sortWithinPartitions("state", "core", "doc_id").mapInArrow(_counted, "doc_id bigint, n bigint")

    def named(batches, strings):
        held, n = [], 0
        for batch in batches:
            batch = batch.filter(pa.compute.is_valid(batch.column(0)))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for rows, found, zero, ok in alive(batch):
                for run, *names, pos, cores in strings(batch, rows, found, zero, ok):
                    if len(run):
                        held.append((*names, ids[rows][found.text[run]], pos, cores))
                        n += len(run)
                if n > _GATHER:
                    yield _gathered(held)
                    n = 0
        if n:
            yield _gathered(held)

    def high(h):
        return (h >> np.uint64(32)).astype(np.int64)

    def low(h):
        return (h >> np.uint64(32)).astype(np.uint32).view(np.int32)

    def both(core, other):
        return (high(core) << 32 | high(other)).astype(np.int64)

    quarter = half // 2

    def ends(batch, rows, found, zero, ok):
        """Joints, first and last windows of the remaining runs: their runs, first two quarters, second half, places and cores."""
        side = (ok[1:] == ok[:-1] + 1) & (found.text[ok[1:]] == found.text[ok[:-1]])
        lead, tail = ok[np.append(True, ~side)[: len(ok)]], ok[np.append(~side, True)[: len(ok)]]
        tail = tail[(found.first[tail] < found.last[tail]) | ~np.isin(tail, lead)]  # a run of one window has one end
        for run, start, other, joint in ((ok[:-1][side], found.last, ok[1:][side], 1), (lead, found.first, lead, 0), (tail, found.last, tail, 0)):
            p = start[run]
            names = found.roll(p, p + quarter, joint), low(found.roll(p + quarter, p + half, 9)), found.roll(p + half, p + length + joint, 10)
            yield run, *names, 2 * (p - zero[run]) + joint, both(found.core[run], found.core[other])

    def between(run, low, high):
        size = np.maximum(high - low, 0)
        of = np.repeat(run, size)
        return of, np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())

    at_ends = saved(_decided(_sorted(texts.mapInArrow(lambda batches: named(batches, ends), _ROW)).mapInArrow(_rerank, _ROW)))

    def cores_left(batch):
        cores = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        yield np.repeat(flat.mix(np.concatenate((cores >> np.uint64(32), cores & np.uint64(0xFFFFFFFF))), 6), 2)

    left = sc.broadcast(sketch.repeated(at_ends.where("pos is null").select("cores"), cores_left, second_bits))

    def inner(batch, rows, found, zero, ok):
        """All windows of the runs that are not done, and witnesses from those that are."""
        starts = batch.column(2).slice(rows.start, rows.stop - rows.start)
        span = np.int64(1) << 40
        sizes = pa.compute.fill_null(pa.compute.list_value_length(starts), 0).to_numpy(zero_copy_only=False)
        pos = starts.flatten().to_numpy(zero_copy_only=False)
        hit = (np.repeat(np.arange(len(sizes)) * span, sizes) + (pos >> 1)) * 2 + (pos & 1)
        hit = np.unique(_windows_of(hit))

        def has(at):
            return np.isin(found.text[ok] * span + at[ok] - zero[ok], hit)

        done = has(found.first) & has(found.last)
        rest, done = ok[~done], ok[done]
        done = done[sketch.maybe(left.value, flat.mix(found.core[done] >> np.uint64(32), 6), second_bits)]
        for runs_, mine in ((rest, True), (done, False)):
            run, p = between(runs_, found.first[runs_], found.last[runs_] + 1)
            first, second = found.roll(p, p + half), found.roll(p + half, p + length, 10)
            yield run, flat.mix(first * np.uint64(3) + second, 11), low(second), np.zeros(len(p), np.uint64), 2 * (p - zero[run]) if mine else np.full(len(p), -1), np.zeros(len(p), np.int64)

    # the same columns and join key as in remove_repeats, so that the texts' exchange is made once
    joined = docs.select("doc_id", "text").join(_starts(at_ends), "doc_id", "left").select("doc_id", "text", "starts")
    at_inner = _decided(joined.mapInArrow(lambda batches: named(batches, inner), _ROW))
    places = at_ends.union(at_inner).where("pos is not null").select("doc_id", "pos", F.lit(0).cast("bigint").alias("n"))
    every = places.union(shared.select("doc_id", F.lit(None).cast("bigint"), "n"))
    return every.groupBy("doc_id").agg(F.collect_list("pos").alias("starts"), F.sum("n").alias("n_shared"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, reach: int = REACH, first_bits: int | None = None, second_bits: int | None = None, short: int = SHORT) -> DataFrame:
    """doc_id, kept binary (the bytes that stay), n_bytes, n_removed, n_spans, n_shared (blocks held by another document too): one row per input row.

    A byte goes if it lies in a ``length``-byte string that also starts anywhere else, overlaps included.
    """
    starts = repeated_starts(docs, length, short, reach, first_bits, second_bits)

    def apply(batches):
        for batch in batches:
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, at in zip(batch.column(1), batch.column(2), strict=True):
                raw = (text.as_py() or "").encode()
                n_bytes.append(len(raw))
                gone = removed = 0
                if at.is_valid:
                    at = np.unique(_windows_of(at.values.to_numpy(zero_copy_only=False)))
                    mask = flat.covered(at[at + length <= len(raw)], length, len(raw))
                    removed = int(mask.sum())
                    gone = int((mask & ~np.append(False, mask[:-1])).sum())
                    raw = np.frombuffer(raw, np.uint8)[~mask].tobytes()
                kept.append(raw)
                n_removed.append(removed)
                n_spans.append(gone)
            numbers = (*(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans)), pa.compute.fill_null(batch.column(3), 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), *numbers], ["doc_id", "kept", "n_bytes", "n_removed", "n_spans", "n_shared"])

    joined = docs.select("doc_id", "text").join(starts, "doc_id", "left").select("doc_id", "text", "starts", "n_shared")
    return joined.mapInArrow(apply, "doc_id bigint, kept binary, n_bytes bigint, n_removed bigint, n_spans bigint, n_shared bigint")
