"""Operator 3: quality rules by line sequence labelling.

A linear-chain conditional random field with two states, boilerplate (0) and content (1), labels the lines of each document;
Viterbi decoding finds the best sequence, and the share of words in content lines decides whether the document is kept.

The field is trained here, on the driver, from at most ``MAX_DOCS`` labelled documents of at most ``MAX_LINES`` lines with the smallest
hashes of doc_id. Labels are weak, and by line: the ``DEFAULT`` weights, and whether ``SHARED`` or more of the sampled documents hold the
line, call symbol, capital, table, number and repeated lines boilerplate and running prose content; only lines with little evidence take the document's
quality. The quality of a document is a constraint on its share of content words: where too few (or too many) words are content, the
lines of the weakest evidence change sides. In a second round the trained field gives the evidence. Where
labels are missing or of one kind only, the ``DEFAULT`` weights apply. Everything else covers all text.

Defined results: a null or empty text, or one without words, has zero counts and fails the base rule; repeated rows get
equal rows; a null doc_id is kept; null labels are not used; a document with contradicting labels counts as the worst of them;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.llm import flat

MAX_DOCS, MAX_LINES = 1500, 300
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW, MIN_CONTENT = 20, 30, 8, 0.5
SHARED, MARGIN = 5, 0.75
#: The features of a line, in order, and the default weights of "content".
FEATURES = ("bias", "log_words", "symbols", "upper", "bars", "digits", "word_length", "exclamations", "repeats_line", "first", "in_repeat", "sentence_end", "shared")
DEFAULT = (1.0, 0.3, -20.0, -4.0, -10.0, -4.0, 0.0, -8.0, -1.5, 0.5, -3.0, 0.5, -4.0)
DEFAULT_MOVES = ((1.0, -1.0), (-1.0, 1.0))

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NO_LINES = np.zeros(0, np.uint64)


@dataclass
class Measured:
    """Counts by text, and by line with a word (``of``: the line's text)."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    of: np.ndarray
    line_words: np.ndarray
    features: np.ndarray
    line_hash: np.ndarray


def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which hashes are in a sorted array."""
    return known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes if len(known) else np.zeros(len(hashes), bool)


def measure(data: np.ndarray, offsets: np.ndarray, shared: np.ndarray = _NO_LINES) -> Measured:
    """``shared``: sorted hashes of the lines that count as shared."""
    n = len(offsets) - 1
    starts, ends, firsts = flat.words(data, offsets)
    n_words = np.diff(firsts)
    roll = flat.Rolling(data)
    total = lambda flags: np.concatenate(([0], np.cumsum(flags)))
    points, symbols = total((data & 0xC0) != 0x80), total(_SYMBOL[data])
    word_doc = np.repeat(np.arange(n), n_words)
    length = points[ends] - points[starts]
    # words in 8-word windows that the text has twice or more
    at, h = flat.windows(roll(starts, ends), firsts, WINDOW)
    doc = word_doc[at]
    order = np.lexsort((h, doc))
    same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    inside = flat.covered(at[twice], WINDOW, len(starts))
    # lines with a word; equal to an earlier one?
    of, _, begin, end = flat.lines(data, offsets)
    line = np.searchsorted(begin, starts, "right") - 1
    line_words = np.bincount(line, minlength=len(of))
    full = np.flatnonzero(line_words)
    lh = roll(begin[full], end[full])
    order = np.lexsort((full, lh, of[full]))
    dup = np.zeros(len(full), bool)
    dup[order[1:]] = (lh[order][1:] == lh[order][:-1]) & (of[full][order][1:] == of[full][order][:-1])
    a, b, k = begin[full], end[full], line_words[full]
    chars = np.maximum(points[b] - points[a], 1)
    within = lambda flags: (lambda s: s[b] - s[a])(total(flags))
    upper, low = within((data >= 65) & (data <= 90)), within((data >= 97) & (data <= 122))
    first = np.append(True, of[full][1:] != of[full][:-1]) if len(full) else np.zeros(0, bool)
    last_word = np.cumsum(k) - 1
    columns = [np.ones(len(full)), np.log1p(k) / 5, (symbols[b] - symbols[a]) / chars, upper / np.maximum(upper + low, 1), within(data == 124) / k, within((data >= 48) & (data <= 57)) / chars, np.minimum(np.bincount(line, weights=length, minlength=len(of))[full] / k / 10, 5), within(data == 33) / k, dup, first, np.bincount(line, weights=inside, minlength=len(of))[full] / k, data[ends[last_word] - 1] == 46 if len(full) else np.zeros(0), among(lh, shared)]
    per_doc = lambda w, d=word_doc: np.bincount(d, weights=w, minlength=n).astype(np.int64)
    return Measured(n_words, per_doc(length), symbols[offsets[1:]] - symbols[offsets[:-1]], np.bincount(of[full][dup], minlength=n), per_doc(inside), of[full], k, np.column_stack(columns).astype(float), lh)


class Chains:
    """Sequences of unequal length, advanced together one line at a time, longest first."""

    def __init__(self, of: np.ndarray):
        lead = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
        size = np.diff(np.append(lead, len(of)))
        order = np.argsort(-size, kind="stable")
        self.lead, self.size = lead[order], size[order]

    def steps(self):
        """For t = 0, 1, ...: the row of line t of every sequence that has one."""
        live = len(self.size)
        for t in range(int(self.size[0]) if live else 0):
            live = int(np.searchsorted(-self.size[:live], -t, "left")) if t else live
            yield self.lead[:live] + t


def viterbi(of: np.ndarray, scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best states (0 or 1) of all lines. Ties take the state content (1)."""
    states, back, best = np.zeros(len(of), np.int64), np.zeros((len(of), 2), np.int64), None
    trail = []
    for rows in Chains(of).steps():
        if best is None:
            best = scores[rows].copy()
        else:
            reach = best[: len(rows), :, None] + moves
            back[rows] = np.where(reach[:, 1] >= reach[:, 0], 1, 0)
            best[: len(rows)] = reach.max(1) + scores[rows]
        trail.append(rows)
    if best is None:
        return states
    state = np.where(best[:, 1] >= best[:, 0], 1, 0)
    for t in range(len(trail) - 1, -1, -1):
        rows = trail[t]
        states[rows] = state[: len(rows)]
        state[: len(rows)] = back[rows, state[: len(rows)]] if t else state[: len(rows)]
    return states


def _sum_up(v: np.ndarray, axis: int) -> np.ndarray:
    """log(sum(exp(v))) over an axis."""
    top = v.max(axis, keepdims=True)
    return (np.log(np.exp(v - top).sum(axis, keepdims=True)) + top).squeeze(axis)


def _marginals(steps: list[np.ndarray], s: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Forward and backward scores of all lines, the logarithm of their sum, and each line's probabilities."""
    alpha, beta = np.zeros_like(s), np.zeros_like(s)
    for t, rows in enumerate(steps):
        alpha[rows] = s[rows] + (_sum_up(alpha[steps[t - 1][: len(rows)]][:, :, None] + a, 1) if t else 0)
    for t in range(len(steps) - 2, -1, -1):
        rest = steps[t + 1]
        beta[steps[t][: len(rest)]] = _sum_up(a + (s[rest] + beta[rest])[:, None, :], 2)
    z = _sum_up(alpha + beta, 1)
    return alpha, beta, z, np.exp(alpha + beta - z[:, None])


def weak_labels(of: np.ndarray, words: np.ndarray, good: np.ndarray, evidence: np.ndarray, min_content: float = MIN_CONTENT) -> np.ndarray:
    """A state for every line. ``evidence`` is positive for content; within ``MARGIN`` it says little, and the document's quality (``good``, by line) decides.

    Then every document gets the share of content words that its quality asks for: at least ``min_content`` if good, less if not. The lines of the
    weakest evidence change sides.
    """
    y = np.where(np.abs(evidence) < MARGIN, good, evidence > 0).astype(np.int64)
    for rows in np.split(np.arange(len(of)), np.flatnonzero(of[1:] != of[:-1]) + 1) if len(of) else ():
        want, total = bool(good[rows[0]]), words[rows].sum()
        have = words[rows][y[rows] == 1].sum()
        for r in rows[np.argsort(-evidence[rows] if want else evidence[rows], kind="stable")]:
            if (have >= min_content * total) == want:
                break
            if y[r] != want:
                y[r] = want
                have += words[r] if want else -words[r]
    return y


def train(of: np.ndarray, x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.3, l2: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features, 2) and moves (2, 2): full-batch Adam on the conditional log-likelihood (forward-backward)."""
    w, a = np.zeros((x.shape[1], 2)), np.zeros((2, 2))
    steps, onehot = list(Chains(of).steps()), np.eye(2)[y]
    seen = np.zeros((2, 2))
    for rows, rest in zip(steps, steps[1:], strict=False):
        np.add.at(seen, (y[rows[: len(rest)]], y[rest]), 1)
    m1, m2 = [np.zeros_like(w), np.zeros_like(a)], [np.zeros_like(w), np.zeros_like(a)]
    for r in range(1, rounds + 1):
        s = x @ w
        alpha, beta, z, p = _marginals(steps, s, a)
        moved = np.zeros((2, 2))
        for t in range(len(steps) - 1):
            rest = steps[t + 1]
            rows = steps[t][: len(rest)]
            moved += np.exp(alpha[rows][:, :, None] + a + (s[rest] + beta[rest])[:, None, :] - z[rows][:, None, None]).sum(0)
        for k, (v, g) in enumerate(((w, x.T @ (onehot - p) / len(y) - l2 * w), (a, (seen - moved) / len(y) - l2 * a))):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            v += rate * (m1[k] / (1 - 0.9**r)) / (np.sqrt(m2[k] / (1 - 0.99**r)) + 1e-8)
    return w, a


@dataclass
class Model:
    """Weights of the features by state, moves between states, sorted hashes of the lines that many sampled documents hold."""

    weights: np.ndarray
    moves: np.ndarray
    shared: np.ndarray


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES) -> Model:
    """The model from the bounded sample of labelled documents; it holds ``max_docs * max_lines / SHARED`` shared lines at most."""
    marks = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(marks), "doc_id").select("doc_id", "text", "quality")

    def lines(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int64()), ("x", pa.list_(pa.float64())), ("words", pa.list_(pa.int64())), ("line", pa.list_(pa.int64()))])
        for batch in batches:
            good = batch.column(2).to_numpy(zero_copy_only=False)
            for rows, data, offsets in flat.text_slices(batch):
                m = measure(data, offsets)
                few = np.bincount(m.of, minlength=rows.stop - rows.start) <= max_lines
                for d in np.unique(m.of[few[m.of]]):
                    own = m.of == d
                    yield pa.RecordBatch.from_pylist([{"doc_id": int(batch.column(0)[rows.start + d].as_py()), "y": int(good[rows.start + d] > 0), "x": m.features[own].ravel().tolist(), "words": m.line_words[own].tolist(), "line": m.line_hash[own].view(np.int64).tolist()}], schema)

    found = sorted(sample.mapInArrow(lines, "doc_id bigint, y bigint, x array<double>, words array<bigint>, line array<bigint>").collect(), key=lambda r: (r.doc_id, r.x))
    w, moves = np.zeros((len(FEATURES), 2)), np.array(DEFAULT_MOVES)
    w[:, 1] = DEFAULT
    if len({r.y for r in found}) < 2:
        return Model(w, moves, _NO_LINES)
    size = [len(r.words) for r in found]
    of, good = np.repeat(np.arange(len(found)), size), np.repeat([r.y for r in found], size)
    x = np.concatenate([np.array(r.x).reshape(-1, len(FEATURES)) for r in found])
    words = np.concatenate([r.words for r in found])
    line = np.concatenate([r.line for r in found]).astype(np.int64).view(np.uint64)
    known, no = np.unique(line, return_inverse=True)
    shared = known[np.bincount(np.unique(np.stack((no, of)), axis=1)[0]) >= SHARED]
    x[:, FEATURES.index("shared")] = among(line, shared)
    evidence = x @ np.array(DEFAULT)
    for _ in range(2):
        w, moves = train(of, x, weak_labels(of, words, good, evidence))
        p = np.clip(_marginals(list(Chains(of).steps()), x @ w, moves)[3], 1e-9, 1)
        evidence = np.log(p[:, 1]) - np.log(p[:, 0])
    return Model(w, moves, shared)


def _judged(data, offsets, model: Model, min_content: float):
    """Measures, words in content lines, base verdict, verdict."""
    m = measure(data, offsets, model.shared)
    states = viterbi(m.of, m.features @ model.weights, model.moves)
    content = np.bincount(m.of, weights=m.line_words * states, minlength=len(m.n_words)).astype(np.int64)
    failed = (m.n_words < MIN_WORDS) | (100 * m.n_repeat_words > MAX_REPEAT_PERCENT * m.n_words)
    return m, content, failed, ~failed & (content >= min_content * m.n_words)


def quality(docs: DataFrame, labels: DataFrame, min_content: float = MIN_CONTENT) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_words, base_failed, kept: one row per input row."""
    model = fit(docs, labels)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in flat.text_slices(batch):
                m, content, failed, kept = _judged(data, offsets, model, min_content)
                columns = [m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, content]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(rows.start, rows.stop - rows.start), *(pa.array(c.astype(np.int64)) for c in columns), pa.array(failed), pa.array(kept)], ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content_words", "base_failed", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, content_words bigint, base_failed boolean, kept boolean")


def kept_rows(docs: DataFrame, labels: DataFrame, min_content: float = MIN_CONTENT) -> DataFrame:
    """The rows of docs, all columns, that ``quality`` keeps: one narrow pass."""
    model = fit(docs, labels)

    def run(batches):
        for batch in batches:
            for rows, data, offsets in flat.text_slices(batch):
                yield batch.slice(rows.start, rows.stop - rows.start).filter(pa.array(_judged(data, offsets, model, min_content)[3]))

    return docs.mapInArrow(run, docs.schema)
