"""Large tables are dealt by their key before they are joined, so that a task's share does not grow with them."""

import re

from voltledger.operators import derive
from voltledger.plans import queries

SF = "/root/testdata/sf0.001"


def test_readings_are_dealt_by_size(spark, monkeypatch):
    want = sorted(map(tuple, queries.uc_current_id(spark, SF).collect()), key=str)
    monkeypatch.setattr(derive, "DEALT_BYTES", 1 << 9)
    found = queries.uc_current_id(spark, SF)
    dealt = {int(n) for n in re.findall(r"RepartitionByExpression \[id_fatura#\d+\], (\d+)", found._jdf.queryExecution().optimizedPlan().toString())}
    assert len(dealt) == 1  # both sides alike, so that the join moves nothing again
    assert min(dealt) > spark.sparkContext.defaultParallelism
    assert sorted(map(tuple, found.collect()), key=str) == want


def test_small_tables_stay(spark):
    a = queries.invoices(spark, SF)
    assert derive.dealt("id_fatura", a)[0] is a
