"""What a worker holds while it encodes follows the slice, and the ids don't depend on it."""

import tracemalloc

import numpy as np
import pyarrow as pa

from voltledger.llm import flat, piece_bpe


def test_temporaries_and_slices():
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(map(chr, rng.integers(97, 123, k))) for k in rng.integers(2, 9, 500)) for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    model = piece_bpe._model(piece_bpe.default_model())

    def ids(limit):
        return np.concatenate([model.encode(data, offsets)[0] for _, data, offsets in flat.text_slices(batch, limit=limit)])

    want = ids(1 << 22)
    tracemalloc.start()
    got = ids(piece_bpe.SLICE_BYTES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got == want).all()
    assert peak < 64 << 20, peak
