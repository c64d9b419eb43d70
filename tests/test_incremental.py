import random

from voltledger.operators import derive, incremental


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def sheets(spark, rnd, ids):
    """Invoices of few units with few meters, so that new rows move first and last months, modes and current units."""
    units, meters = [f"u{i}" for i in range(12)] + [None], [f"m{i}" for i in range(9)] + [None]
    inv, read, item, reg = [], [], [], []
    for i in ids:
        u = rnd.choice(units)
        uc = u or f"NULO_{i}"
        month = rnd.choice([None, *(f"20{y}-{m:02d}" for y in (22, 23, 24) for m in (1, 6, 12))])
        inv.append((f"F{i}", uc, month, "mono"))
        reg.append((uc, "name" if rnd.random() < 0.8 else "other"))
        for _ in range(rnd.randint(0, 3)):
            read.append((f"F{i}", uc, month, "q", rnd.choice(meters)))
        item.append((f"F{i}", uc, month, rnd.choice(["A", "b "])))
    return {
        "fatura": spark.createDataFrame(inv, "id_fatura string, id_uc string, competencia string, tipo_fornecimento string"),
        "unidade_consumidora": spark.createDataFrame(reg, "id_uc string, razao_social string"),
        "itens_fatura": spark.createDataFrame(item, "id_fatura string, id_uc string, competencia string, item string"),
        "medicao": spark.createDataFrame(read, "id_fatura string, id_uc string, competencia string, Grandezas string, Medidor string"),
    }


def test_refreshed_sheets_equal_the_full_computation(spark):
    rnd = random.Random(11)
    equal = spark.createDataFrame([("b", "B!")], "item string, item_normalizado string")
    seen = sheets(spark, rnd, range(60))
    now, facts = derive.enrich(seen, equal), incremental.facts(seen)
    for n in range(2):
        new = sheets(spark, rnd, range(100 + 15 * n, 115 + 15 * n))
        now, facts = incremental.refreshed(now, new, facts, incremental.facts(new), equal)
        now = {k: v.checkpoint() for k, v in now.items()}  # as a caller writes them between appends
        facts = {k: v.checkpoint() for k, v in facts.items()}
        seen = {k: seen[k].unionByName(new[k]) for k in seen}
        want = derive.enrich(seen, equal)
        for k in want:
            assert now[k].columns == want[k].columns and rows(now[k]) == rows(want[k]), k
        for k, v in incremental.facts(seen).items():
            assert rows(facts[k]) == rows(v)


def test_rows_that_no_new_fact_concerns_are_passed_on(spark):
    a = {"fatura": [("F1", "u1", "2024-01", "x"), ("F2", "u2", "2024-01", "x")], "unidade_consumidora": [("u1", "n"), ("u2", "n")], "medicao": [("F1", "u1", "2024-01", "q", "m1"), ("F2", "u2", "2024-01", "q", "m2")]}
    kinds = {"fatura": "id_fatura string, id_uc string, competencia string, tipo_fornecimento string", "unidade_consumidora": "id_uc string, razao_social string", "medicao": "id_fatura string, id_uc string, competencia string, Grandezas string, Medidor string"}
    old = {k: spark.createDataFrame(v, kinds[k]) for k, v in a.items()}
    new = {"fatura": spark.createDataFrame([("F3", "u3", "2024-05", "x")], kinds["fatura"]), "medicao": spark.createDataFrame([("F3", "u3", "2024-05", "q", "m1")], kinds["medicao"])}
    enriched = derive.enrich(old)
    marked = {k: v.withColumn("id_uc_atual", v["id_uc_atual"]) if "id_uc_atual" in v.columns else v for k, v in enriched.items()}
    marked["fatura"] = marked["fatura"].selectExpr("* except (id_uc_atual)", "concat(id_uc_atual, '*') id_uc_atual")  # would be lost if it were computed again
    got, _ = incremental.refreshed(marked, new, incremental.facts(old), incremental.facts(new))
    assert {r.id_fatura: r.id_uc_atual for r in got["fatura"].collect()} == {"F1": "u3", "F2": "u2*", "F3": "u3"}
    assert {r.id_uc: r.id_uc_atual_medidor for r in got["unidade_consumidora"].collect()} == {"u1": "u3", "u2": "u2"}
