"""Operator 5: language identification by sparse multinomial logistic regression.

Features are hashed character n-grams (1 to 3 code points, lower-cased) of the whole text, weighted by log(1 + count) times inverse
document frequency, scaled to length 1. Document frequencies are counted over every labelled training document. The model is
trained on the driver by FTRL-proximal with elastic-net penalties, which leaves most weights zero, from a bounded sample:
about ``PER_LANG`` documents a language, by the hash of doc_id. A fifth of the sample is kept from training and sets the temperature that
calibrates the scores.

Training sees text and non-null lang only where crc32(doc_id as text) mod 3 is not 1; predictions use the text alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned; a null
doc_id is never trained on and not held out; repeated rows get equal rows; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.llm import flat

BITS, PER_LANG, EPOCHS = 15, 600, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1

_LOWER: list[np.ndarray] = []


def _lower(cps: np.ndarray) -> np.ndarray:
    if not _LOWER:
        _LOWER.append(np.array([ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x3000)], np.uint32))
    low = cps < 0x3000
    return np.where(low, _LOWER[0][np.where(low, cps, 0)], cps)


def grams(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text: the hashed n-grams it has (ascending) and their counts."""
    cps = _lower(np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)).astype(np.uint64)
    at = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    codes = []
    h = np.zeros(len(cps), np.uint64)
    for n in range(1, 4):
        h = (h[: len(cps) - n + 1] << np.uint64(21)) | cps[n - 1 :] if len(cps) >= n else np.zeros(0, np.uint64)
        codes.append((((h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int32))
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        count = np.bincount(np.concatenate([c[a : max(a, b - n)] for n, c in enumerate(codes)]), minlength=1 << bits)
        have = np.flatnonzero(count)
        out.append((have, count[have]))
    return out


def train_ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, dims: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> np.ndarray:
    """Weights (dims, classes), most of them zero."""
    z, n = np.zeros((dims, classes)), np.zeros((dims, classes))
    weights = lambda z, n: np.where(np.abs(z) <= l1, 0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            at, v = x[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(v @ w)
            p[y[i]] -= 1
            g = v[:, None] * p
            more = ni + g * g
            z[at] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[at] = more
    return weights(z, n)


def _softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def temperature(scores: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, from a fixed grid."""
    if not len(y):
        return 1.0
    grid = 2.0 ** np.linspace(-5, 5, 81)
    loss = [-np.log(np.maximum(_softmax(scores / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def _weighted(have: np.ndarray, count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    v = np.log1p(count) * idf[have]
    return have, v / (np.sqrt((v * v).sum()) or 1)


def _training(docs: DataFrame) -> DataFrame:
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    return docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(fold != 1)


def fit(docs: DataFrame, bits: int = BITS, per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, idf, weights, temperature."""
    train = _training(docs)
    counts = {r.lang: r.n for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(counts)

    def frequencies(batches):
        df = np.zeros(1 << bits, np.int64)
        for batch in batches:
            for _, data, offsets in flat.text_slices(batch):
                for have, _ in grams(data, offsets, bits):
                    df[have] += 1
        have = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(have), pa.array(df[have])], ["gram", "df"])

    df = np.zeros(1 << bits)
    for r in train.select("text").mapInArrow(frequencies, "gram bigint, df bigint").groupBy("gram").agg(F.sum("df").alias("df")).collect():
        df[r.gram] = r.df
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 1
    if not langs:
        return langs, idf, np.zeros((1 << bits, 0)), 1.0
    share = F.create_map(*(F.lit(x) for k in langs for x in (k, min(1.0, per_lang / counts[k]))))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = train.where(place < share[F.col("lang")])

    def features(batches):
        for batch in batches:
            for rows, data, offsets in flat.text_slices(batch):
                found = grams(data, offsets, bits)
                part = batch.slice(rows.start, rows.stop - rows.start)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([h.astype("<i4").tobytes() for h, _ in found], pa.binary()), pa.array([c.astype("<i4").tobytes() for _, c in found], pa.binary())], ["doc_id", "lang", "have", "count"])

    rows = sorted(sample.mapInArrow(features, "doc_id bigint, lang string, have binary, count binary").collect(), key=lambda r: (r.doc_id, r.lang))
    x = [_weighted(np.frombuffer(r.have, "<i4"), np.frombuffer(r["count"], "<i4"), idf) for r in rows]
    y = np.array([langs.index(r.lang) for r in rows], np.int64)
    spare = np.arange(len(y)) % 5 == 4
    w = train_ftrl([v for v, s in zip(x, spare, strict=True) if not s], y[~spare], len(langs), 1 << bits)
    t = temperature(np.array([v @ w[at] for (at, v), s in zip(x, spare, strict=True) if s]).reshape(-1, len(langs)), y[spare])
    return langs, idf, w, t


_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


def predict(docs: DataFrame, bits: int = BITS, per_lang: int = PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per input row."""
    langs, idf, w, t = fit(docs, bits, per_lang)
    model = docs.sparkSession.sparkContext.broadcast((idf, w))

    def run(batches):
        idf, w = model.value
        for batch in batches:
            names, scores = [], []
            for _, data, offsets in flat.text_slices(batch):
                ascii_letters = np.concatenate(([0], np.cumsum(_ASCII_LETTER[data])))[offsets]
                for i, (have, count) in enumerate(grams(data, offsets, bits)):
                    letter = ascii_letters[i + 1] > ascii_letters[i] or any(map(str.isalpha, data[offsets[i] : offsets[i + 1]].tobytes().decode()))
                    if not letter or not langs:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    at, v = _weighted(have, count, idf)
                    p = _softmax(v @ w[at] / t)
                    names.append(langs[int(np.argmax(p))])
                    scores.append(float(p.max()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return docs.select("doc_id", "text", held.alias("held_out")).mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double")
