"""Operator 4: benchmark passages in documents, up to a share of edited words.

Texts are sequences of words: runs of letters, digits and non-ASCII characters, A-Z lower-cased. An item of n words is found where a
passage is within k = floor(``max_edits`` * n) word insertions, deletions or replacements of it.

1. Windows of the item's size are placed wherever the text has one of the item's 2k + 1 rarest word pairs, at that pair's place: k edits
   spoil at most 2k pairs, so nothing is lost, and most windows placed have nothing else in common with the item.
2. The CGK random walk embeds each window and each item of its size: step j writes the current word and moves on if a
   random bit of (j, word) is 1, so that a few edits leave most of the 2n written words equal (edit to Hamming distance; after 2n steps
   a walk has just about read its n words, and longer ones would compare the zeros behind them).
3. Bit-sampling LSH makes the candidates: each walk has ``samples`` tables, whose keys are ``width`` sampled places of the walk. A
   window and an item that agree in one table are candidates. Equal passages agree in all of them. The number of walks is chosen for each size of
   item, so that passages of that size with the most edits allowed reach ``recall``. That is measured on random passages, with windows placed as in 1, when the tables are built.
4. Candidates are verified by exact edit distance of the item against the window and its reach.

Longer items are cut into parts of ``PART_WORDS`` words at most, as many as it takes to reach the recall with ``MAX_WALKS`` walks: of k edits some part has no
more than its share by words, rounded down. Steps 1 to 3 look for the parts, step 4 verifies the whole item around each part found, so the recall of an item is
that of one part at least, whatever its length. Parts whose share is no edit are looked up by the hash of their whole word sequence, which misses nothing.

So are items that allow no edit (k = 0: fewer than five words at the usual share) and single words.

The benchmark is read in blocks of about ``block`` items and ``block_bytes`` of text at most, which bounds what is broadcast; each block meets all documents.

Defined results: null or empty texts, and texts without a word, match nothing; a null doc_id or item_id
takes no part; repeated documents or items give one row per (doc_id, item_id), of the best match (fewest edits, then first); other columns
are ignored; an empty table on either side gives no rows.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.llm import flat

MAX_EDITS = 0.2
RECALL, SAMPLES, WIDTH = 0.98, 8, 3
MAX_WALKS, TRIALS = 16, 300
PART_WORDS, GRID = 60, 10
WALK_CELLS = 1 << 21
BLOCK, BLOCK_BYTES = 20_000, 16 << 20

_BETWEEN = np.ones(256, bool)
_BETWEEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and per text the index of its first one (one more)."""
    data = np.where(_BETWEEN[data], 0x20, flat.lower(data)).astype(np.uint8)
    starts, ends, firsts = flat.words(data, offsets)
    return flat.Rolling(data)(starts, ends), firsts


def _pairs(w: np.ndarray) -> np.ndarray:
    return flat.mix(w[:-1] * np.uint64(3) + w[1:], 17)


def _walk(m: np.ndarray, sizes: np.ndarray, walks: int) -> np.ndarray:
    """Words written (steps, walks, rows) by the CGK walks over the rows of m, of which the first ``sizes`` words count; behind them stand zeros."""
    m = np.concatenate((np.where(np.arange(m.shape[1]) < sizes[:, None], m, np.uint64(0)), np.zeros((len(m), 1), np.uint64)), 1)
    steps = 2 * (m.shape[1] - 1)
    seed = flat.mix(np.arange(steps, dtype=np.uint64)[:, None] * np.uint64(MAX_WALKS) + np.arange(walks, dtype=np.uint64), 41)[:, :, None]
    walk = np.empty((steps, walks, len(m)), np.uint64)
    at, every = np.zeros((walks, len(m)), np.int64), np.arange(len(m))
    for j in range(steps):
        word = walk[j] = m[every, at]
        at += ((((word ^ seed[j]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(63)).astype(np.int64)) & (at < sizes)
    return walk


def _keys(walk: np.ndarray, n: int, walks: int, samples: int, width: int) -> np.ndarray:
    """Keys (rows, walks * samples) of passages of n words: a hash of ``width`` places, sampled for that size, of the first 2n words written."""
    rng = np.random.default_rng(n)
    places = np.stack([np.stack([rng.choice(2 * n, width, replace=False) for _ in range(samples)]) for _ in range(walks)])
    rows = walk.shape[2]
    table = np.broadcast_to(np.arange(1, walks * samples + 1, dtype=np.uint64).reshape(walks, samples, 1), (walks, samples, rows))
    for k in range(width):
        table = flat.mix(table * np.uint64(5) + walk[places[:, :, k], np.arange(walks)[:, None]], 23)
    return table.reshape(walks * samples, rows).T


def _walks(m: np.ndarray, walks: int, samples: int, width: int) -> np.ndarray:
    """Keys of rows that all have as many words as m has columns."""
    n = m.shape[1]
    parts = np.array_split(m, max(1, -(-len(m) * 2 * n * walks // WALK_CELLS)))
    return np.concatenate([_keys(_walk(x, np.full(len(x), n), walks), n, walks, samples, width) for x in parts])


def _edited(rng: np.random.Generator, item: list[int], k: int) -> tuple[list[int], list[int | None]]:
    """A random passage k edits from the item, and where in it each word of the item is."""
    words: list[tuple[int, int | None]] = [(w, i) for i, w in enumerate(item)]
    for at, kind in zip(rng.integers(0, len(item), k).tolist(), rng.integers(0, 3, k).tolist(), strict=True):
        words[at : at + (kind > 0)] = [(int(rng.integers(1, 1 << 60)), None)] * (kind < 2)  # insert, replace, delete
    place: list[int | None] = [None] * len(item)
    for at, (_, i) in enumerate(words):
        if i is not None:
            place[i] = at
    return [w for w, _ in words], place


@functools.cache
def _walks_reaching(n: int, k: int, recall: float, samples: int, width: int) -> int | None:
    """The least number of walks with which random items of n words are candidates of passages k edits away, often enough; None: not with MAX_WALKS.

    As in a document, windows stand where one of 2k + 1 word pairs of the item is left, and behind insertions and deletions they are shifted."""
    rng = np.random.default_rng(n * 31 + k)
    items = rng.integers(1, 1 << 60, (TRIALS, n)).astype(np.uint64)
    trial, texts = [], []
    for t, item in enumerate(items.tolist()):
        words, place = _edited(rng, item, k)
        before = rng.integers(1, 1 << 60, n).tolist()
        around = before + words + rng.integers(1, 1 << 60, 2 * n).tolist()
        pairs = rng.permutation(n - 1)[: 2 * k + 1].tolist()
        for start in {place[p] - p for p in pairs if place[p] is not None and place[p + 1] == place[p] + 1}:
            trial.append(t)
            texts.append(around[n + start : 2 * n + start])
    same = _walks(items, MAX_WALKS, samples, width)[trial] == _walks(np.array(texts, np.uint64).reshape(-1, n), MAX_WALKS, samples, width)
    hit = np.zeros((TRIALS, MAX_WALKS), bool)
    np.logical_or.at(hit, trial, same.reshape(-1, MAX_WALKS, samples).any(2))
    reached = np.maximum.accumulate(hit, 1).mean(0) >= recall
    return int(reached.argmax()) + 1 if reached.any() else None


def walks_needed(n: int, k: int, recall: float, samples: int, width: int) -> int | None:
    """As ``_walks_reaching`` for the next size that GRID divides, with the same share of edits or more."""
    size = -(-n // GRID) * GRID
    return _walks_reaching(size, -(-k * size // n), recall, samples, width)


def parts_of(n: int, k: int, lsh: tuple[float, int, int]) -> list[tuple[int, int, int]]:
    """(first word, words, edits) of the parts of an item of n words within k edits: as few as reach the recall."""
    for m in range(-(-n // PART_WORDS), n + 1):
        cuts = [i * n // m for i in range(m + 1)]
        parts = [(a, b - a, k * (b - a) // n) for a, b in zip(cuts, cuts[1:], strict=False)]
        if all(e == 0 or s > 1 and walks_needed(s, e, *lsh) for _, s, e in parts):
            return parts
    raise AssertionError("parts of one word allow no edit")


def _distances(items: np.ndarray, texts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row: fewest edits between an item and any passage of its text (``sizes`` words of it), and that passage's start and end; the first of equals."""
    rows, m = texts.shape
    idx = np.arange(m + 1)
    row, begin = np.zeros((rows, m + 1), np.int64), np.tile(idx, (rows, 1))
    for j in range(items.shape[1]):
        best, source = row + 1, begin.copy()
        take = row[:, :-1] + (texts != items[:, j : j + 1])
        better = take <= best[:, 1:]
        best[:, 1:] = np.where(better, take, best[:, 1:])
        source[:, 1:] = np.where(better, begin[:, :-1], source[:, 1:])
        spread = best - idx
        low = np.minimum.accumulate(spread, 1)
        at = np.maximum.accumulate(np.where(spread == low, idx, 0), 1)
        row, begin = low + idx, np.take_along_axis(source, at, 1)
    row = np.where(idx <= sizes[:, None], row, 1 << 30)
    end = row.argmin(1)
    every = np.arange(rows)
    return row[every, end], begin[every, end], end


class Items:
    """A block of benchmark items, cut into parts: the parts' word pairs, sizes and LSH tables, and the hashes of those that allow no edit."""

    def __init__(self, ids: list[int], texts: list[str], max_edits: float, lsh: tuple[float, int, int]):
        raw = [t.encode() for t in texts]
        offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw]))).astype(np.int64)
        w, firsts = tokens(np.frombuffer(b"".join(raw), np.uint8), offsets)
        use = [i for i in range(len(ids)) if firsts[i + 1] > firsts[i]]
        self.samples, self.width = lsh[1:]
        self.ids = [ids[i] for i in use]
        self.words = [w[firsts[i] : firsts[i + 1]] for i in use]
        self.size = np.array([len(x) for x in self.words], np.int64)
        self.edits = np.floor(max_edits * self.size + 1e-9).astype(np.int64)
        cut = functools.cache(lambda n, k: parts_of(n, k, lsh))
        parts = np.array([(i, *p) for i, (n, k) in enumerate(zip(self.size.tolist(), self.edits.tolist(), strict=True)) for p in cut(n, k)], np.int64).reshape(-1, 4)
        self.item, self.offset, self.part_size, self.part_edits = parts.T
        words = [self.words[i][a : a + n] for i, a, n, _ in parts.tolist()]
        near = np.flatnonzero((self.part_edits > 0) & (self.part_size > 1))
        pair = np.concatenate([_pairs(words[i]) for i in near]) if len(near) else np.zeros(0, np.uint64)
        owner = np.repeat(near, self.part_size[near] - 1)
        place = np.concatenate([np.arange(k - 1) for k in self.part_size[near]]) if len(near) else np.zeros(0, np.int64)
        # of each part the rarest pairs of this block: so many that one of them outlasts all edits
        _, no, count = np.unique(pair, return_inverse=True, return_counts=True)
        order = np.lexsort((place, count[no], owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        order = order[rank <= 2 * self.part_edits[owner[order]]]
        pair, owner, place = pair[order], owner[order], place[order]
        order = np.argsort(pair, kind="stable")
        self.pair, self.owner, self.place = pair[order], owner[order], place[order]
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.pair >> np.uint64(44)).astype(np.int64)] = True
        self.tables = {}
        for n in np.unique(self.part_size[near]).tolist():
            own = near[self.part_size[near] == n]
            walks = max(walks_needed(n, int(k), *lsh) for k in np.unique(self.part_edits[own]))
            keys = _walks(np.stack([words[i] for i in own]), walks, self.samples, self.width)
            self.tables[n] = (own, walks, keys, np.argsort(keys, axis=0, kind="stable"))
        exact = np.setdiff1d(np.arange(len(parts)), near)
        self.exact = {}
        for n in np.unique(self.part_size[exact]).tolist():
            own = exact[self.part_size[exact] == n]
            _, h = flat.windows(np.concatenate([words[i] for i in own]), np.arange(len(own) + 1) * n, n)
            order = np.argsort(h, kind="stable")
            self.exact[n] = (own[order], h[order])

    def windows(self, w: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Rows (text, first word of the window, size), each once."""
        if len(w) < 2 or not len(self.pair):
            return np.zeros((0, 3), np.int64)
        pair = _pairs(w)
        inside = np.ones(len(pair), bool)
        inside[firsts[(firsts > 0) & (firsts < len(w))] - 1] = False
        at = np.flatnonzero(self.bits[(pair >> np.uint64(44)).astype(np.int64)] & inside)
        lo, hi = np.searchsorted(self.pair, pair[at], "left"), np.searchsorted(self.pair, pair[at], "right")
        n = hi - lo
        src = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        at, part, place = np.repeat(at, n), self.owner[src], self.place[src]
        text = np.searchsorted(firsts, at, "right") - 1
        return np.unique(np.stack((text, np.maximum(at - place, firsts[text]), self.part_size[part]), 1), axis=0)

    def hits(self, w: np.ndarray, firsts: np.ndarray):
        """(text, item, start word, end word, edits) of every verified candidate, and of the first place of an item that allows no edit."""
        near = []  # rows (text, item, first word if nothing is inserted or deleted before the part)
        for n, (own, keys) in self.exact.items():
            at, h = flat.windows(w, firsts, n)
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            k = hi - lo
            part, at = own[np.repeat(lo - (np.cumsum(k) - k), k) + np.arange(k.sum())], np.repeat(at, k)
            text, item = np.searchsorted(firsts, at, "right") - 1, self.item[part]
            whole = self.edits[item] == 0
            _, once = np.unique((text * len(self.ids) + item)[whole], return_index=True)
            yield from ((int(text[x]), int(item[x]), int(at[x]), int(at[x]) + n, 0) for x in np.flatnonzero(whole)[once])
            near.append(np.stack((text, item, at - self.offset[part]), 1)[~whole])
        found = self.windows(w, firsts)
        found = found[np.argsort(found[:, 2], kind="stable")]
        walks = max((x[1] for x in self.tables.values()), default=1)
        low = 0
        while low < len(found):
            # as many windows, by size, as keep the walks below WALK_CELLS words; one at least
            cost = 2 * walks * found[low:, 2] * np.arange(1, len(found) - low + 1)
            high = low + max(1, int(np.searchsorted(cost, WALK_CELLS, "right")))
            near.append(self._candidates(w, firsts, found[low:high], walks))
            low = high
        near = np.unique(np.concatenate([np.zeros((0, 3), np.int64), *near]), axis=0)
        if len(near):
            yield from self._verified(w, firsts, near)

    def _candidates(self, w: np.ndarray, firsts: np.ndarray, found: np.ndarray, walks: int) -> np.ndarray:
        """Rows (text, item, first word) of the windows that agree with a part in one of their tables."""
        reach = found[:, 1][:, None] + np.arange(int(found[:, 2].max()))
        words = np.where(reach < firsts[found[:, 0] + 1][:, None], w[np.minimum(reach, len(w) - 1)], np.uint64(0))
        walk, out = _walk(words, found[:, 2], walks), []
        for n in np.unique(found[:, 2]).tolist():
            own, n_walks, keys, orders = self.tables[n]
            rows = np.flatnonzero(found[:, 2] == n)
            window = found[rows]
            mine = _keys(walk[:, :, rows], n, n_walks, self.samples, self.width)
            seen = []
            for t in range(keys.shape[1]):
                order = orders[:, t]
                a, b = np.searchsorted(keys[order, t], mine[:, t], "left"), np.searchsorted(keys[order, t], mine[:, t], "right")
                hits = b - a
                seen.append(np.repeat(np.arange(len(mine)), hits) * len(own) + order[np.repeat(a - (np.cumsum(hits) - hits), hits) + np.arange(hits.sum())])
            seen = np.unique(np.concatenate(seen))
            r, part = seen // len(own), own[seen % len(own)]
            out.append(np.stack((window[r, 0], self.item[part], window[r, 1] - self.offset[part]), 1))
        return np.concatenate(out)

    def _verified(self, w: np.ndarray, firsts: np.ndarray, near: np.ndarray):
        """Candidates within the edits of their item. Those of one item and text that stand close together are one passage to compare."""
        text, item, at = near.T
        k, n = self.edits[item], self.size[item]
        # a new passage where the item or the text changes, or behind a gap; no passage is longer than twice the item and its reach
        new = np.ones(len(near), bool)
        new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (at[1:] - at[:-1] > k[1:])
        group = np.cumsum(new) - 1
        far = (at - at[new][group]) // np.maximum(n, 1)
        new[1:] |= (group[1:] == group[:-1]) & (far[1:] != far[:-1])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(near)) - 1
        text, item, k, n = text[head], item[head], k[head], n[head]
        first = np.maximum(at[head] - k, firsts[text])
        size = np.minimum(at[last] + n + k, firsts[text + 1]) - first
        for words in np.unique(n).tolist():
            rows = np.flatnonzero((n == words) & (size >= words - k))
            rows = rows[np.argsort(size[rows], kind="stable")]
            for c in np.array_split(rows, max(1, -(-len(rows) * int(size[rows].max(initial=1)) // WALK_CELLS))):
                if not len(c):
                    continue
                reach = first[c][:, None] + np.arange(int(size[c].max()))
                passage = np.where(np.arange(reach.shape[1]) < size[c][:, None], w[np.minimum(reach, len(w) - 1)], np.uint64(0))
                edits, a, b = _distances(np.stack([self.words[x] for x in item[c]]), passage, size[c])
                for x in np.flatnonzero(edits <= k[c]).tolist():
                    yield int(text[c][x]), int(item[c][x]), int(first[c][x] + a[x]), int(first[c][x] + b[x]), int(edits[x])


def contamination(docs: DataFrame, benchmark: DataFrame, max_edits: float = MAX_EDITS, recall: float = RECALL, samples: int = SAMPLES, width: int = WIDTH, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, start_word, end_word, edits, item_words: one row per document and item found in it."""
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, start_word bigint, end_word bigint, edits bigint, item_words bigint"
    texts = docs.select("doc_id", "text").where("doc_id is not null and text is not null")
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size.n // block), -(-(size.bytes or 0) // block_bytes))
    parts = None
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows], max_edits, (recall, samples, width)))

        def find(batches, held=held):
            for batch in batches:
                out = []
                for rows, data, offsets in flat.text_slices(batch, limit=1 << 20):
                    w, firsts = tokens(data, offsets)
                    for text, item, start, end, edits in held.value.hits(w, firsts):
                        out.append((batch.column(0)[rows.start + text].as_py(), held.value.ids[item], int(start - firsts[text]), int(end - firsts[text]), edits, int(held.value.size[item])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "item_id", "start_word", "end_word", "edits", "item_words"])

        found = texts.mapInArrow(find, schema)
        parts = found if parts is None else parts.union(found)
    best = parts.groupBy("doc_id", "item_id").agg(F.min(F.struct("edits", "start_word", "end_word", "item_words")).alias("m"))
    return best.select("doc_id", "item_id", "m.start_word", "m.end_word", "m.edits", "m.item_words")
