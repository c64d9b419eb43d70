import pytest

from voltledger.operators import rules
from voltledger.sources import stores


def rule(sheet, groups, actions, **more):
    return rules.parse([{"aba": sheet, "grupos": [{"operador": op, "condicoes": [dict(zip(("coluna", "operador", "valor"), c, strict=True)) for c in cs]} for op, cs in groups], "acoes": [{"coluna": c, "valor": v} for c, v in actions], **more}])[0]


def column(df, name):
    return [r[name] for r in df.collect()]


def test_groups_and_links(spark):
    t = spark.createDataFrame([(1, 0, 9), (2, 0, 9), (3, 0, 9), (1, 3, 9), (2, 9, 9)], "X int, Y int, Z int").coalesce(1)
    r = rule("t", [("OU", [("X", "igual", "1"), ("X", "igual", "2")]), ("E", [("Y", "diferente", "3")])], [("Z", "0")])
    out, report = rules.apply({"t": t}, [r])
    assert column(out["t"], "Z") == [0, 0, 9, 9, 0]
    assert report[0].rows.first().rows == 3


def test_list_and_mixed_numbers(spark):
    t = spark.createDataFrame([("CONSUMO KWH", q) for q in ("30", "100", "254.0", "43")], "item string, quantidade string").coalesce(1)
    r = rules.parse(stores.DEFAULT_RULES)[0]
    out, _ = rules.apply({"itens_fatura": t}, [r])
    assert column(out["itens_fatura"], "item") == ["CONSUMO KWH", "CONSUMO KWH", "CONSUMO", "CONSUMO"]


def test_names_are_found_loosely(spark):
    t = spark.createDataFrame([("ENERGIA GERAÇÃO - KWH", "FORA PONTA", "5"), ("ENERGIA ATIVA - KWH", "PONTA", "7")], "Grandezas string, `Postos horarios` string, `Consumo kWh` string").coalesce(1)
    r = rule("Medição", [("E", [("grandezas", "igual", "energia geracao -  kwh"), ("POSTOS_HORARIOS", "igual", "fora ponta")])], [("consumo_kwh", "0")])
    out, _ = rules.apply({"medicao": t}, [r])
    assert column(out["medicao"], "Consumo kWh") == ["0", "7"]


def test_inactive_and_ghost_columns(spark):
    t = spark.createDataFrame([(1,), (2,)], "a int").coalesce(1)
    off = rule("t", [("E", [("a", "igual", "1")])], [("a", "9")], ativo=False)
    ghost = rule("t", [("E", [("nope", "igual", "1")])], [("a", "9")])
    out, report = rules.apply({"t": t}, [off, ghost])
    assert column(out["t"], "a") == [1, 2]
    assert len(report) == 1 and "nope" in report[0].note


def test_text_and_blank(spark):
    t = spark.createDataFrame([("Energia X", None), ("outro", "a")], "item string, obs string").coalesce(1)
    r = rule("t", [("E", [("item", "contem", "energía"), ("obs", "vazio", "")])], [("obs", "ok")])
    assert column(rules.apply({"t": t}, [r])[0]["t"], "obs") == ["ok", "a"]


def test_nulls_never_match_but_differ(spark):
    t = spark.createDataFrame([(None, "x"), ("1", "x")], "a string, b string").coalesce(1)
    r = rule("t", [("E", [("a", "diferente", "1")])], [("b", "d")])
    assert column(rules.apply({"t": t}, [r])[0]["t"], "b") == ["d", "x"]


def test_mask_is_taken_before_the_actions(spark):
    t = spark.createDataFrame([(1, 1)], "a int, b int")
    r = rule("t", [("E", [("a", "igual", "1")])], [("a", "2"), ("b", "3")])
    assert tuple(rules.apply({"t": t}, [r])[0]["t"].first()) == (2, 3)


def test_text_into_number_promotes(spark):
    t = spark.createDataFrame([(1, 1.5)], "a int, b double")
    out = rules.apply({"t": t}, [rule("t", [("E", [("a", "igual", "1")])], [("a", "x"), ("b", "2")])])[0]["t"]
    assert out.dtypes == [("a", "string"), ("b", "double")] and tuple(out.first()) == ("x", 2.0)


@pytest.mark.parametrize("value, out", [("", None), ("7", 7), ("-1,5", -1.5), ("a b", "a b")])
def test_literals(value, out):
    assert rules.typed(value) == out


def test_default_rules_are_complete(tmp_path):
    from voltledger import schemas

    for r in stores.load_rules(tmp_path / "rules.json"):
        assert r.aba in schemas.SHEETS and r.grupos and r.acoes and "ENTÃO" in rules.describe(r)
    (tmp_path / "rules.json").write_text("[]")
    assert stores.load_rules(tmp_path / "rules.json") == []
    (tmp_path / "rules.json").write_text("{broken")
    assert stores.load_rules(tmp_path / "rules.json") == []


def test_target_name():
    from voltledger.plans.flows import default_target

    assert default_target("/a/b.xlsx") == "/a/b_hardcodes.xlsx" and default_target("/a/b") == "/a/b_hardcodes"


def test_layers_equal_one_rule_after_the_other(spark):
    """Rules that read what others write, write the same column, change its type, and share conditions."""
    import random

    rnd = random.Random(3)
    t = spark.createDataFrame([(i, i % 5, float(i % 3), rnd.choice(["a", "B", "ç", None, " ", "7"])) for i in range(40)], "id int, x int, y double, s string").repartition(2)
    values = {"x": ["0", "1", "4", "2,5", "t"], "y": ["0", "1", "9", "u"], "s": ["A", "b", "C", "7", "", "z"]}
    ops = [o for o in rules.OPERATORS]
    condition = lambda: (c := rnd.choice("xys"), rnd.choice(ops), rnd.choice(["1", "a;b;7", "C", "0;2", "3"]))
    some = [rule("t", [(rnd.choice(["E", "OU"]), [condition() for _ in range(rnd.randint(1, 3))]) for _ in range(rnd.randint(1, 2))], [(c, rnd.choice(values[c])) for c in rnd.sample("xys", rnd.randint(1, 2))]) for _ in range(14)]
    one, counts = t, []
    for r in some:
        done, report = rules.apply({"t": one}, [r])
        counts.append(report[0].rows.first().rows)
        one = done["t"].checkpoint()
    every, report = rules.apply({"t": t}, some)
    assert every["t"].dtypes == one.dtypes and sorted(map(tuple, every["t"].collect()), key=str) == sorted(map(tuple, one.collect()), key=str)
    assert [r.changed for r in rules.report_rows(spark, report).collect()] == counts


def test_three_hundred_rules_are_one_shallow_plan(spark):
    t = spark.range(1000).selectExpr("cast(id % 300 as int) a", "cast(0 as int) b", "'-' c")
    many = [rule("t", [("E", [("a", "igual", str(i))])], [("b", str(i + 1)), ("c", f"v{i % 7}")], nome=f"r{i}") for i in range(300)]
    last = rule("t", [("E", [("c", "igual", "v3")])], [("c", "three")], nome="last")
    done, report = rules.apply({"t": t}, [*many, last])
    plan = done["t"]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Project") <= 8
    got = {(r.a, r.b, r.c) for r in done["t"].collect()}
    assert got == {(i, i + 1, "three" if i % 7 == 3 else f"v{i % 7}") for i in range(300)}
    changed = {r.rule: r.changed for r in rules.report_rows(spark, report).collect()}
    assert changed["r0"] == 4 and changed["r299"] == 3 and changed["last"] == sum(1 for i in range(1000) if i % 300 % 7 == 3)


def test_literals_are_read_as_cells_are(spark):
    from pyspark.sql import functions as F

    from voltledger.functions import text as tx

    some = ["", " ", "1", "+1,50", "1.234,5", "1e3", "-2E-1", "1 000", "Ção  ß\tx ", "ǅ é", "٣", "nan", "1d", "\n a\r\n"]
    rows = spark.createDataFrame([(s,) for s in some], "s string").select("s", tx.text_key(F.col("s")).alias("k"), tx.loose_number(F.col("s")).alias("n")).collect()
    assert [(r.k, r.n) for r in rows] == [(tx.py_text_key(s), tx.py_loose_number(s)) for s in some]
