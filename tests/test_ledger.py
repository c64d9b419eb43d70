import os
from pathlib import Path

import pytest

from voltledger.operators import append as ap
from voltledger.sources.ledger import Ledger


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in Path(path).rglob("part-*.parquet")}


def frame(spark, n, start=0, plus=0.0):
    return spark.createDataFrame([(f"A{i}", float(i) + plus) for i in range(start, start + n)], "id_fatura string, `valor_total_r$` double")


def items(spark, ids, kind="x"):
    return spark.createDataFrame([(i, f"{kind}{k % 2}") for i in ids for k in range(3)], "id_fatura string, item string")


def test_append_equals_the_append_of_tables_and_rewrites_no_file(spark, tmp_path):
    book = Ledger(spark, str(tmp_path), buckets=16)
    assert book.read() == ({}, None) and book.compact() is None
    book.write({"fatura": frame(spark, 40), "itens_fatura": items(spark, [f"A{i}" for i in range(40)]).distinct()}, {"m": 1})
    before = files(tmp_path)
    new = {"fatura": frame(spark, 3, 38, 0.5).union(frame(spark, 1, 40, 0.7)), "itens_fatura": items(spark, ["A1", "A40", "A40"], "y")}
    want = ap.append(book.read()[0], {n: {c: c for c in df.columns} for n, df in new.items()}, new).sheets
    want = {n: rows(df) for n, df in want.items()}
    assert book.append(new) == 2
    got, meta = book.read()
    assert {n: rows(df) for n, df in got.items()} == want and meta == {"m": 1}
    assert ("A40", 40.5) in want["fatura"] and ("A38", 38.0) in want["fatura"] and ("A1", "y0") not in want["itens_fatura"]
    after = files(tmp_path)
    assert before.items() <= after.items() and len({n.split("bucket=")[1].split("/")[0] for n in after.keys() - before.keys()}) <= 2
    assert rows(book.read(1)[0]["fatura"]) == rows(frame(spark, 40))  # an older version is still there


def test_a_write_that_fails_between_two_sheets_changes_nothing(spark, tmp_path):
    book = Ledger(spark, str(tmp_path), buckets=4)
    book.write({"fatura": frame(spark, 5), "itens_fatura": items(spark, ["A1"])})
    want = {n: rows(df) for n, df in book.read()[0].items()}
    broken = items(spark, ["A9"]).selectExpr("id_fatura", "raise_error('disk full') item")
    for write in (book.append, book.write):
        with pytest.raises(Exception, match="disk full"):
            write({"fatura": frame(spark, 5, 5), "itens_fatura": broken})
        assert {n: rows(df) for n, df in book.read()[0].items()} == want and book.versions() == [1]
    assert len(book.vacuum()) == 2 and {n: rows(df) for n, df in book.read()[0].items()} == want  # what the failed writes left


def test_of_two_writers_of_one_version_the_second_fails(spark, tmp_path):
    book = Ledger(spark, str(tmp_path), buckets=4)
    book.write({"fatura": frame(spark, 2)})
    stale = book.manifest() | {"version": 2}
    book.append({"fatura": frame(spark, 1, 7)})
    with pytest.raises(RuntimeError, match="someone else"):
        book._commit(stale)
    assert book.read()[0]["fatura"].count() == 3 and not [n for n in os.listdir(tmp_path / "versions") if n[0] == "." and not n.endswith(".crc")]


def test_compaction_rewrites_crowded_buckets_only(spark, tmp_path):
    book = Ledger(spark, str(tmp_path), buckets=8)
    book.write({"fatura": frame(spark, 30)})
    for k in (100, 201, 202):
        book.append({"fatura": frame(spark, 1, k)})
    want = rows(book.read()[0]["fatura"])
    segments = book.manifest()["sheets"]["fatura"]["segments"]
    crowded = {b for b, s in segments.items() if len(s) > 1}
    assert book.compact(1) == 5
    now = book.manifest()["sheets"]["fatura"]["segments"]
    assert rows(book.read()[0]["fatura"]) == want and {b for b in now if now[b] != segments[b]} == crowded and all(len(s) == 1 for s in now.values())
    book.vacuum(1)
    assert rows(book.read()[0]["fatura"]) == want and book.versions() == [5]


def test_first_rows_null_keys_and_new_sheets(spark, tmp_path):
    book = Ledger(spark, str(tmp_path), buckets=4)
    kind = "id_fatura string, `valor_total_r$` double, extra string"
    book.append({"fatura": spark.createDataFrame([("A", 9.0, "e"), ("A", 2.0, "f"), (None, 5.0, "g"), (None, 1.0, "h")], kind).coalesce(1)})
    assert rows(book.read()[0]["fatura"]) == rows(spark.createDataFrame([("A", 9.0, "e"), (None, 5.0, "g")], kind))
    book.append({"fatura": spark.createDataFrame([(None, 0.0), ("B", 1.0)], "id_fatura string, `valor_total_r$` double"), "notes": spark.createDataFrame([("n",), ("n",)], "note string")})
    assert book.read()[0]["fatura"].count() == 3 and rows(book.read()[0]["notes"]) == [("n",)]
    book.append({"fatura": frame(spark, 0)})
    assert book.read()[0]["fatura"].count() == 3
