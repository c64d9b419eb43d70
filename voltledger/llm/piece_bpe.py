"""Operator 6: SentencePiece BPE by vectorised merge rounds.

The texts of a slice become flat numpy arrays. They are cut wherever no piece of the vocabulary spans two characters, so
each cut-out *word* merges on its own, and equal words are merged once. The symbols of all distinct words lie in one array; a round
looks up the rank of every adjacent pair, takes the minimum of each word (segmented), merges its leftmost occurrences in
all words at once, and compacts the array. A word without a pair leaves; the rounds end when none is left.

Order matters in one case: if the merged piece can join a neighbour at a better rank than its own, the library
merges that neighbour before the next occurrence. Such pieces (``_eager``) merge one occurrence a round; all others merge every
leftmost non-overlapping occurrence of the word at once, with the same result.

Decoding maps ids to bytes: pieces with the space mark as space, byte pieces as bytes, control ids as nothing; one leading
space that comes from the dummy prefix goes; bytes that are not UTF-8 become U+FFFD as in the library.

The model must be BPE with byte fallback, identity normaliser, escaped spaces and dummy prefix; anything else is refused.

Defined results: a null text counts as empty and gives the begin and end ids only; an unknown character becomes its byte
pieces; equal rows give equal rows; a null doc_id is kept; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from voltledger.llm import flat

#: Text encoded at once: the temporaries take some 110 bytes a byte of it in each worker.
SLICE_BYTES = 1 << 18
SPACE = "▁"
_NONE = np.int64(1 << 40)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Pairs:
    """Open-addressing table from (left symbol, right symbol) to merged symbol, looked up by arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, merged: np.ndarray):
        self.bits = max(10, int(len(left) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        keys = (left.astype(np.int64) << 32) | right
        rest = np.arange(len(keys))
        self.probes = 0
        while len(rest):
            at = self._at(keys[rest], self.probes)
            free = self.keys[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = rest[free][first]
            self.keys[self._at(keys[won], self.probes)] = keys[won]
            self.values[self._at(keys[won], self.probes)] = merged[won]
            rest = np.setdiff1d(rest, won)
            self.probes += 1

    def _at(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = flat.mix(keys.view(np.uint64)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(probe * (probe + 1) // 2)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.int64) << 32) | right
        out = np.full(len(keys), -1, np.int64)
        rest = np.arange(len(keys))
        for probe in range(self.probes):
            at = self._at(keys[rest], probe)
            hit = self.keys[at] == keys[rest]
            out[rest[hit]] = self.values[at[hit]]
            rest = rest[~hit & (self.keys[at] >= 0)]
            if not len(rest):
                break
        return out


class PieceModel:
    """Vocabulary of a SentencePiece BPE model, as arrays. Symbols: piece ids, then ``size + code point`` for characters without a piece."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix or train.treat_whitespace_as_suffix or {p.type for p in proto.pieces} - {1, 2, 3, 6}:
            raise ValueError("only BPE models with byte fallback, identity normaliser and dummy prefix are handled")
        self.size, self.bos, self.eos = len(proto.pieces), train.bos_id, train.eos_id
        kind = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == 1}
        score = np.array([p.score for p in proto.pieces])
        self.rank = np.full(self.size, _NONE)
        own = np.array(sorted(kind.values()))
        self.rank[own] = np.unique(-score[own], return_inverse=True)[1]
        self.byte = np.zeros(256, np.int64)
        self.bytes: list[bytes] = [b""] * self.size
        self.is_byte = np.zeros(self.size, bool)
        for i, p in enumerate(proto.pieces):
            if p.type == 6:
                self.byte[int(p.piece[3:-1], 16)] = i
                self.bytes[i], self.is_byte[i] = bytes([int(p.piece[3:-1], 16)]), True
            elif p.type == 1:
                self.bytes[i] = p.piece.replace(SPACE, " ").encode()
            elif p.type == 2:
                self.bytes[i] = train.unk_surface.encode()
        self.char = np.arange(0x110000, dtype=np.int64) + self.size
        for text, i in kind.items():
            if len(text) == 1:
                self.char[ord(text)] = i
        symbol = lambda s: kind.get(s, self.size + ord(s) if len(s) == 1 else None)
        splits = [(symbol(t[:k]), symbol(t[k:]), i) for t, i in kind.items() for k in range(1, len(t))]
        splits = np.array([x for x in splits if x[0] is not None and x[1] is not None], np.int64)
        self.pairs = _Pairs(*splits.T)
        inner = np.array(sorted({(ord(a), ord(b)) for t in kind for a, b in zip(t, t[1:], strict=False)}), np.int64)
        self.glue = _Pairs(inner[:, 0], inner[:, 1], np.zeros(len(inner), np.int64))
        self.eager = np.zeros(self.size, bool)
        for part, other, whole in ((0, 1, 2), (1, 0, 2)):
            m, w = splits[:, part], splits[:, whole]
            better = (m < self.size) & (self.rank[w] <= self.rank[np.minimum(m, self.size - 1)])
            self.eager[m[better]] = True
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.pool_at = np.concatenate(([0], np.cumsum(self.lengths)))

    def merge(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words and each symbol's word; ``word`` ascends."""
        out_s, out_w = [], []
        while len(symbols):
            n = len(symbols)
            merged = np.full(n, -1, np.int64)
            near = np.flatnonzero(word[:-1] == word[1:]) if n > 1 else np.zeros(0, np.int64)
            merged[near] = self.pairs(symbols[near], symbols[near + 1])
            rank = np.where(merged >= 0, self.rank[np.maximum(merged, 0)], _NONE)
            lead = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(lead, n))
            best = np.minimum.reduceat(rank, lead)
            over = np.repeat(best == _NONE, size)
            if over.any():
                out_s.append(symbols[over])
                out_w.append(word[over])
                live = ~over
                symbols, word, merged, rank = symbols[live], word[live], merged[live], rank[live]
                size, best = size[best != _NONE], best[best != _NONE]
                n = len(symbols)
                if not n:
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            w = word[at]
            first = np.append(True, w[1:] != w[:-1])
            # leftmost non-overlapping ones among adjacent candidates: every other one of a run, from its start
            same = (at[1:] == at[:-1] + 1) & ~first[1:]
            run = np.flatnonzero(np.append(True, ~same))
            nth = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
            start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            alike = merged[at] == merged[at[start]]
            take = np.where(self.eager[merged[at[start]]] | ~alike, first, nth % 2 == 0)
            at = at[take]
            symbols = symbols.copy()
            symbols[at] = merged[at]
            keep = np.ones(n, bool)
            keep[at + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not out_s:
            return symbols, word
        s, w = np.concatenate(out_s), np.concatenate(out_w)
        order = np.argsort(w, kind="stable")
        return s[order], w[order]

    def expand(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many ids each symbol gave: a character without a piece becomes its UTF-8 bytes."""
        odd = np.flatnonzero(symbols >= self.size)
        count = np.ones(len(symbols), np.int64)
        raw = [chr(c).encode() for c in (symbols[odd] - self.size).tolist()]
        count[odd] = [len(x) for x in raw]
        ids = np.repeat(np.where(symbols >= self.size, 0, symbols), count)
        if len(odd):
            begin = (np.cumsum(count) - count)[odd]
            width = count[odd]
            where = np.repeat(begin - (np.cumsum(width) - width), width) + np.arange(width.sum())
            ids[where] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return ids, count

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (begin and end included) and the texts' offsets in them."""
        n_texts = len(offsets) - 1
        texts = np.diff(offsets) > 0
        cps = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        lead = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        # the dummy prefix before every text that is not empty
        prefix = lead[:-1][texts]
        cps = np.insert(cps, prefix, ord(SPACE))
        cps[cps == 0x20] = ord(SPACE)
        begin = lead[:-1] + np.cumsum(texts) - texts
        if not len(cps):
            words = np.zeros(0, np.int64)
            ids = w_count = of = np.zeros(0, np.int64)
        else:
            cut = np.ones(len(cps), bool)
            cut[1:] = self.glue(cps[:-1], cps[1:]) < 0
            cut[begin[texts]] = True
            start = np.flatnonzero(cut)
            end = np.append(start[1:], len(cps))
            h = flat.Rolling(cps, flat._Q)(start, end)
            _, first, of = np.unique(h + (end - start).astype(np.uint64), return_index=True, return_inverse=True)
            length = (end - start)[first]
            word = np.repeat(np.arange(len(first)), length)
            inside = np.arange(len(word)) - np.repeat(np.cumsum(length) - length, length)
            symbols, word = self.merge(self.char[cps[np.repeat(start[first], length) + inside]], word)
            ids, per = self.expand(symbols)
            w_count = np.bincount(word, weights=per, minlength=len(first)).astype(np.int64)
            words = start
        w_begin = np.cumsum(w_count) - w_count
        per_word = w_count[of]
        text_of = np.searchsorted(begin, words, "right") - 1 if len(words) else np.zeros(0, np.int64)
        # empty texts share their begin with the next one; the last of equals is the one that has the words
        n_ids = np.bincount(text_of, weights=per_word, minlength=n_texts).astype(np.int64)
        out_at = np.concatenate(([0], np.cumsum(n_ids + 2)))
        out = np.empty(out_at[-1], np.int64)
        out[out_at[:-1]], out[out_at[1:] - 1] = self.bos, self.eos
        hole = np.ones(len(out), bool)
        hole[out_at[:-1]] = hole[out_at[1:] - 1] = False
        src = np.repeat(w_begin[of], per_word) + np.arange(per_word.sum()) - np.repeat(np.cumsum(per_word) - per_word, per_word)
        out[hole] = ids[src]
        return out, out_at

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of the ids between the offsets."""
        n = self.lengths[ids]
        at = np.concatenate(([0], np.cumsum(n)))
        src = np.repeat(self.pool_at[ids], n) + np.arange(at[-1]) - np.repeat(at[:-1], n)
        raw = self.pool[src].tobytes()
        out = []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            piece = raw[at[a] : at[b]]
            k = a
            while k < b and not n[k]:
                k += 1
            if k < b and not self.is_byte[ids[k]] and piece[:1] == b" ":
                piece = piece[1:]
            try:
                out.append(piece.decode())
            except UnicodeDecodeError:
                out.append(_replaced(piece))
        return out


_WELL_FORMED = re.compile(rb"[\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2}")


def _replaced(raw: bytes) -> str:
    """Every byte outside a well-formed character becomes U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        m = _WELL_FORMED.match(raw, at)
        out.append(m[0].decode() if m else "�")
        at = m.end() if m else at + 1
    return "".join(out)


@functools.lru_cache(maxsize=2)
def _model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_decode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids binary (little-endian unsigned 32-bit, begin and end included), decoded string: one row per input row.

    ``numpy.frombuffer(ids, "<u4")`` gives the ids back.
    """
    path = model or default_model()

    def run(batches):
        m = _model(path)
        for batch in batches:
            for rows, data, offsets in flat.text_slices(batch, limit=SLICE_BYTES):
                ids, at = m.encode(data, offsets)
                packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at * 4), pa.py_buffer(ids.astype("<u4"))])
                columns = [batch.column(0).slice(rows.start, rows.stop - rows.start), pa.array(np.diff(at)), packed.cast(pa.binary()), pa.array(m.decode(ids, at), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")
