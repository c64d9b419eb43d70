"""The pipeline's stages on rows with null and repeated doc_ids, by the rules that its docstring states."""

import random
from collections import Counter

from test_operators import labels


def test_null_and_repeated_doc_ids(spark, tmp_path):
    import corpus_pipeline as pipeline

    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklm") for _ in range(6)) for _ in range(600)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n)) + "."
    item = prose(30)
    clean = [(i, prose(80)) for i in range(6)]
    leak = (9, f"{prose(50)} {item} {prose(50)}")
    rows = [*clean, clean[2], leak, leak, (None, prose(70)), (None, f"{prose(50)} {item}"), (None, None), (12, clean[1][1]), (12, clean[1][1])]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, __gone string")
    spark.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    stages = dict(pipeline.STAGES)
    ids = lambda df: Counter(r.doc_id for r in df.collect())
    every = Counter(i for i, _ in rows)

    kept = stages["quality_rules"](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and ids(kept) == every - Counter([None])  # the null text goes, null doc_ids are judged
    lines = stages["line_dedup"](spark, docs, str(tmp_path))
    assert lines.columns == docs.columns and ids(lines) == every
    near = stages["ngram_join"](spark, docs, str(tmp_path))
    assert near.columns == docs.columns and ids(near) == every - Counter({12: 2})  # both rows of 12 go with the copy, rows that repeat an id stay together
    decontaminated = stages["decontamination"](spark, docs, str(tmp_path))
    assert ids(decontaminated) == every - Counter({9: 2})  # a null doc_id passes
    tokens = stages["sentencepiece"](spark, docs, str(tmp_path))
    assert ids(tokens) == every and {r.n_tokens for r in tokens.where("doc_id = 2").collect()} == {tokens.where("doc_id = 2").first().n_tokens}
