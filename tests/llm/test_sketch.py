"""Sketches grow with the texts, and count exactly what falls into a cell."""

import numpy as np
import pytest

from voltledger.llm import ngram_join, sketch, substring_dedup, suffix_dedup


def unlike(spark, n=40, words=400):
    """Texts without a common passage."""
    rng = np.random.default_rng(5)
    return spark.createDataFrame([(i, " ".join(f"{x:x}" for x in rng.integers(1 << 20, 1 << 30, words))) for i in range(n)], "doc_id bigint, text string").repartition(3)


@pytest.mark.parametrize("bits", [8, 16, 20])
def test_repeated_cells(spark, bits):
    rng = np.random.default_rng(bits)
    h = rng.integers(0, 1 << 62, 30000)
    h = np.concatenate((h, h[:500], np.full(3000, h[7])))
    df = spark.createDataFrame([(int(x),) for x in h], "h bigint").repartition(5)
    got = sketch.repeated(df, lambda b: iter([b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)]), bits, 2)
    for r in range(2):
        count = np.bincount(sketch.cells(h.view(np.uint64), bits, r), minlength=1 << bits)
        assert (np.unpackbits(got[r], bitorder="little")[: 1 << bits] == (count > 1)).all()


@pytest.mark.parametrize(("module", "run"), [(ngram_join, ngram_join.near_duplicates), (suffix_dedup, suffix_dedup.remove_repeats), (substring_dedup, substring_dedup.remove_repeated_windows)])
def test_sketches_grow_with_the_texts(spark, monkeypatch, module, run):
    """Sketches made for a tenth of the texts would be full and let everything through to the exact pass."""
    docs = unlike(spark)
    first = "BITS" if module is ngram_join else "FIRST_BITS"
    monkeypatch.setattr(module, first, 10)
    monkeypatch.setattr(module, "SECOND_BITS", 9)
    used, repeated = [], sketch.repeated

    def spied(df, hashes, bits, rows=1):
        used.append(bits)
        return repeated(df, hashes, bits, rows)

    monkeypatch.setattr(sketch, "repeated", spied)
    run(docs).count()
    size = sum(len(r.text) for r in docs.collect())
    assert size / module.BYTES_A_CELL <= 2 ** used[0] < 2 * size / module.BYTES_A_CELL
    assert used[1] == used[0] - 1


def test_largest_sketch(spark):
    assert sketch.doublings(unlike(spark, 2, 10), 28, 5) == 0
    assert sketch.doublings(unlike(spark), 10, 1 << 30) == 0
    assert sketch.doublings(unlike(spark).limit(0), 10, 5) == 0
    assert sketch.MOST_BITS <= 32  # cells are 32-bit numbers
