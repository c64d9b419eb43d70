import threading
import time

import pytest

from voltledger.plans import runs
from voltledger.sources.documents import Job
from voltledger.sources.ledger import Ledger

TEXT = "10605788 NOTA FISCAL Nº 1\nMAR/2024 09/03/2024 R$***10,00\nFORNECIMENTO\n{}\nITENS FINANCEIROS\nTOTAL\n"
ITEM = "CONSUMO kWh 1,00 0,50 0,50 0,10 0,50 17% 0,10 0,40"


def folders(path, n, files=2):
    out = []
    for f in range(n):
        (path / f"f{f}").mkdir()
        for k in range(files):
            (path / f"f{f}" / f"20240000000{f}{k}.txt").write_text(TEXT.format(ITEM if k else ""))
        out.append(Job(str(path / f"f{f}"), "EQUATORIAL", glob="*.txt"))
    return out


def test_a_run_counts_and_adds_each_folder(spark, tmp_path):
    book = Ledger(spark, str(tmp_path / "book"), buckets=4)
    jobs = folders(tmp_path, 2)
    done = runs.Run(spark, jobs, book).result(300)
    assert (done.total, done.processed, done.errors, done.cancelled, done.failure) == (4, 2, 2, False, None)
    assert book.versions() == [1, 2] and book.read()[0]["fatura"].count() == 2
    assert sum(e.count() for e in done.error_rows) == 2
    runs.Run(spark, jobs[:1], book).result(300)  # nothing is added twice
    assert book.read()[0]["fatura"].count() == 2 and book.read()[0]["itens_fatura"].count() == 2


def test_cancelling_keeps_finished_folders_and_stops_only_this_run(spark, tmp_path):
    gate = tmp_path / "go"
    book = Ledger(spark, str(tmp_path / "book"), buckets=4)

    def slow(content, gate=str(gate)):
        import os

        for _ in range(6000):
            if b"STOP" not in content or os.path.exists(gate):
                return [content.decode()]
            time.sleep(0.05)
        raise TimeoutError

    jobs = folders(tmp_path, 3)
    for f in (tmp_path / "f1").iterdir():
        f.write_text("STOP")
    other = {}
    beside = threading.Thread(target=lambda: other.update(n=spark.range(50).repartition(2).count()))
    run = runs.Run(spark, jobs, book, decode=slow)
    limit = time.time() + 240
    while time.time() < limit and not (run.progress()["folders_finished"] == 1 and run.progress()["tasks"]):
        time.sleep(0.1)
    assert run.progress()["folders"] == 3
    beside.start()
    run.cancel()
    try:
        done = run.result(120)
    finally:
        gate.write_text("")  # lets the workers end
    beside.join()
    assert done.cancelled and done.failure is None and [j.folder for j in done.finished] == [jobs[0].folder]
    assert (done.total, done.processed, done.errors) == (2, 1, 1) and book.read()[0]["fatura"].count() == 1 and other == {"n": 50}


def test_a_failing_folder_ends_the_run_with_what_is_finished(spark, tmp_path):
    jobs = [*folders(tmp_path, 1), Job(str(tmp_path / "missing"), "EQUATORIAL", glob="*.txt")]
    done = runs.Run(spark, jobs, Ledger(spark, str(tmp_path / "book"), buckets=4)).result(300)
    assert not done.cancelled and "missing" in done.failure and done.processed == 1
    with pytest.raises(TimeoutError):
        hanging = runs.Run.__new__(runs.Run)
        hanging._thread = threading.Thread(target=time.sleep, args=(2,))
        hanging._thread.start()
        hanging.result(0.01)
