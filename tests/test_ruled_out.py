"""Patterns that a text can't match are ruled out by a literal that is not in it; what is found stays the same."""

import random

import pytest
from pyspark.sql import functions as F

from voltledger.functions import text as tx
from voltledger.operators import layout_a
from test_extract import A

ALIKE = {"s": "ſ", "i": "ı", "I": "İ", "k": "\u212a"}


def varied(n=120):
    rnd, lines = random.Random(3), A.split("\n")
    for _ in range(n):
        text = "\n".join(x for x in lines if rnd.random() > 0.2)
        yield "".join(ALIKE.get(c, c.swapcase()) if rnd.random() < 0.05 else c for c in text)


@pytest.mark.parametrize(("pattern", "literals"), [
    (r"(?iud)Protocolo de autoriza[çc][ãa]o:\s*(\d+)", {("protocolo de autoriza",)}),
    (r"(?iud)^(CNPJ?)?\s(?:abc+|xbcd)(?:efg){0,2}[hij]klm\.(?!nop)", {("abc", "xbcd"), ("klm.",)}),
    (r"(?d)a?bcd*efg|hij", {("efg", "hij")}),
    (r"(?d)abc|\d+", set()),
])
def test_required(pattern, literals):
    assert set(tx.required(pattern)) == literals


def test_every_field_is_the_same(spark):
    rows = [(f"/in/{i}.pdf", t) for i, t in enumerate([*varied(), A, "", None])]
    docs = spark.createDataFrame(rows, "path string, text string").withColumn("folded", tx.folded(F.col("text"))).cache()
    plain, path, none = F.col("text"), F.col("path"), F.lit(None).cast("string")

    def found(text):
        fields = {**layout_a.header(text, path, none), **layout_a.customer(text), "impostos": layout_a.taxes(text), "medicao": layout_a.readings(text), "itens": layout_a.items(text)}
        return [[str(r[k]) for r in docs.select("path", c.alias(k)).orderBy("path").collect()] for k, c in fields.items() if k in ("id_uc", "numero_nf", "serie_nf", "competencia", "data_vencimento", "classificacao_tarifaria", "scee_saldo_kwh_FP", "uf", "impostos", "medicao", "itens")]

    assert found(tx.Scanned(plain, F.col("folded"))) == found(plain)


def test_numbers_of_lines(spark):
    rows = spark.createDataFrame([("1.234,56",), ("-0,05",), ("7",), (",",), ("1,2,3",), ("...",)], "s string")
    from voltledger.operators.items import num, plain_num

    for r in rows.select(num(F.array("s"), 1).alias("a"), plain_num(F.array("s"), 1).alias("b")).collect():
        assert r.a == r.b


def test_extraction_tries_only_what_may_match(spark):
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    found = layout_a.extract(spark.createDataFrame([("/in/1.pdf", A)], "path string, text string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.unset("spark.sql.debug.maxToStringFields")
    for literal in ("chave de acesso:", "lim min:", "cnpj/cpf:", "data de emiss"):
        assert literal in plan
