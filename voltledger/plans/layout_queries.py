"""Registered queries of the second layout, of the rarer parts of the first one, and of profiles, appends and sources.

Documents are written from the driver's tables, so that the DuckDB SQL can say what has to be found in them.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.functions import text as tx
from voltledger.operators import append as ap
from voltledger.operators import derive, glossary, incremental, layout_a, layout_b, profile, rules, sheets
from voltledger.operators.containment import longest_contained
from voltledger.plans.queries import ORACLE, SQL_INVOICES, SQL_READINGS, _br, _halves, _rule, _text, invoices, query, readings, table
from voltledger.schemas import quoted
from voltledger.sources.documents import spread
from voltledger.sources.ledger import Ledger
from voltledger.streaming.ingest import scratch


def _day(column: str, n: int):
    return F.date_format(F.date_add(F.to_date(column), n), "dd/MM/yyyy")


_SQL_DAY = "strftime(o_orderdate + INTERVAL {} DAY, '%Y-%m-%d')"


# ---- Layout B ----------------------------------------------------------------------------------------------------------------------------


@query(f"""SELECT 'CHESP_' || o_orderkey id_fatura, CAST(10000000 + o_custkey AS VARCHAR) id_uc, strftime(o_orderdate, '%Y-%m') competencia, {_SQL_DAY.format(0)} data_emissao, {_SQL_DAY.format(9)} data_vencimento,
CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) valor_total, CAST(o_orderkey AS VARCHAR) numero_nf, '00' || CAST(o_orderkey % 7 AS VARCHAR) serie_nf, 'B3 - Poder' classe, CASE o_orderkey % 3 WHEN 0 THEN 'Bifásico' ELSE 'Trifásico' END tipo,
{_SQL_DAY.format(1)} leitura_anterior, {_SQL_DAY.format(32)} leitura_atual, CAST(CASE WHEN o_orderkey % 2 = 1 THEN 31 ELSE o_orderkey % 31 END AS INTEGER) dias, {_SQL_DAY.format(60)} proxima, repeat('1234', 11) chave, '352' || o_orderkey protocolo FROM orders""")
def b_header(spark, sf):
    """Header of layout B. Odd invoices have their reading dates in columns, without the number of days."""
    odd = F.col("o_orderkey") % 2 == 1
    row = F.concat_ws(" ", _day("o_orderdate", 1), _day("o_orderdate", 32), (F.col("o_orderkey") % 31).cast("string"), _day("o_orderdate", 60))
    columns = F.concat(F.lit("ANTERIOR ATUAL PRÓXIMA EMISSÃO APRESENTAÇÃO\n"), F.concat_ws(" ", _day("o_orderdate", 1), _day("o_orderdate", 32), _day("o_orderdate", 60)))
    total = F.concat(F.lit("R$ "), _br("o_totalprice"))
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("UNIDADE CONSUMIDORA:"), (F.col("o_custkey") + 10000000).cast("string")),
        F.concat(F.lit("NOTA FISCAL Nº "), _text("o_orderkey"), F.lit(" - SÉRIE 00"), (F.col("o_orderkey") % 7).cast("string")),
        F.concat(F.lit("DATA DE EMISSÃO: "), _day("o_orderdate", 0)),
        F.concat_ws(" ", F.date_format("o_orderdate", "MM/yyyy"), _day("o_orderdate", 9), total),
        F.concat(F.lit("TOTAL A PAGAR "), total),
        F.lit("Chave de acesso:\n1234 1234 1234 1234 1234 1234 1234 1234 1234 1234 1234"),
        F.concat(F.lit("Protocolo de autorização: 352"), _text("o_orderkey")),
        F.lit("Classificação: B3 -  Poder o Modalidade X"),
        F.when(F.col("o_orderkey") % 3 == 0, "bifásico").when(F.col("o_orderkey") % 3 == 1, "TRIFÁSICO"),
        F.when(odd, columns).otherwise(row),
    )
    docs = table(spark, sf, "orders").select(F.lit("/in/b.pdf").alias("path"), text.alias("text"))
    names = {"id_fatura": "id_fatura", "id_uc": "id_uc", "competencia": "competencia", "data_emissao": "data_emissao", "data_vencimento": "data_vencimento", "valor_total": "valor_total_r$", "numero_nf": "numero_nf", "serie_nf": "serie_nf", "classe": "classificacao_tarifaria", "tipo": "tipo_fornecimento", "leitura_anterior": "data_leitura_anterior", "leitura_atual": "data_leitura_atual", "dias": "numero_dias_leitura", "proxima": "data_proxima_leitura", "chave": "chave_acesso_nfe", "protocolo": "protocolo_autorizacao"}
    h = layout_b.header(F.col("text"), F.col("path"))
    return spread(docs).select(*(h[c].alias(n) for n, c in names.items()))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'GOIAS TRIBUNAL DE JUSTICA DO ESTADO DE GOIAS' END razao_social, '02.292.266/0001-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') cnpj,
CASE WHEN c_custkey % 5 = 0 THEN '11111111' ELSE '74000' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') END cep, translate(upper(n_name), '_0123456789', ' ABCDEFGHIJ') municipio, 'GO' uf FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def b_customer(spark, sf):
    """The owner's postcode, else the second of the page, else its only one."""
    code = F.concat(F.lit("CEP: 74 000-"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    town = F.translate("n_name", "_0123456789", " ABCDEFGHIJ")
    even, only = F.col("c_custkey") % 2 == 0, F.col("c_custkey") % 5 == 0
    text = F.concat_ws(
        "\n",
        F.when(~only, F.lit("CEP 11111111")),
        F.when(even, F.lit("GOIAS TRIBUNAL DE JUSTICA DO ESTADO DE GOIAS")),
        F.concat(F.lit("CPF/CNPJ: 02.292.266/0001-"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0")),
        F.lit("RUA UM / OUTRA CIDADE - GO"),
        F.concat(F.lit("RUA DOIS / "), town, F.lit(" - GO")),
        F.when(only, F.lit("CEP 11111111")).otherwise(code),
    )
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", *(v.alias(k) for k, v in layout_b.customer(text).items()))


_B_LINES = "WITH l AS (SELECT *, CAST(l_partkey % 1000 + 1 AS DOUBLE) / 100 p, translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') name FROM lineitem), e AS (SELECT *, round(l_quantity * p, 2) e FROM l)"


@query(_B_LINES + """ SELECT l_orderkey, upper(CASE l_linenumber % 4 WHEN 0 THEN 'Energia ' || name WHEN 1 THEN 'ADICIONAL BANDEIRA ' || name WHEN 2 THEN 'CUSTEIO DE ' || name ELSE 'COMP. ' || name END) item,
CASE WHEN l_linenumber % 4 < 2 THEN 'FORNECIMENTO' ELSE 'ITENS FINANCEIROS' END tipo, CASE WHEN l_linenumber % 4 = 0 THEN CASE l_partkey % 3 WHEN 0 THEN 'kWh' WHEN 1 THEN 'kW' ELSE 'kVArh' END END unidade,
CASE l_linenumber % 4 WHEN 2 THEN 1 WHEN 3 THEN -CAST(l_quantity AS INTEGER) ELSE l_quantity END quantidade, e valor, CASE WHEN l_linenumber % 4 < 2 THEN CAST(l_linenumber AS DOUBLE) / 100 END pis_cofins FROM e""")
def b_items(spark, sf):
    """Items of the block of layout B by shape: with a (broken) unit, flag surcharge, lighting, counted."""
    k = F.col("l_linenumber") % 4
    price = (F.col("l_partkey") % 1000 + 1).cast("double") / 100
    value = F.round(F.col("l_quantity") * price, 2)
    name = F.translate(_text("l_partkey"), "0123456789", "ABCDEFGHIJ")
    unit = F.when(F.col("l_partkey") % 3 == 0, "kWwh").when(F.col("l_partkey") % 3 == 1, "w").otherwise("kvarh")
    amounts = [_br("l_quantity"), _br(price), _br(value), _br(F.col("l_linenumber") / 100), _br(price)]
    row = (
        F.when(k == 0, F.concat_ws(" ", F.lit("Energia"), name, unit, *amounts))
        .when(k == 1, F.concat_ws(" ", F.lit("ADICIONAL BANDEIRA"), name, *amounts))
        .when(k == 2, F.concat_ws(" ", F.lit("CUSTEIO DE"), name, F.lit("1"), amounts[1], amounts[2]))
        .otherwise(F.concat_ws(" ", F.lit("COMP."), name, F.concat(F.lit("-"), F.col("l_quantity").cast("int").cast("string")), amounts[1], amounts[2]))
    )
    body = F.concat(F.lit("DEMANDA kW 9,00\nItens de fatura Quant Unid\n"), F.array_join(F.collect_list(row), "\n"), F.lit("\nTOTAL 1,00\nDepois 1 2,00 3,00\n"))
    docs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(body.alias("text"))
    return docs.select("l_orderkey", F.inline(layout_b.items(F.col("text")))).select("l_orderkey", "item", "tipo", "unidade", "quantidade", "valor", "pis_cofins")


@query("""WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) v, CAST(o_orderkey % 50 + 1 AS DOUBLE) c, CAST(o_orderkey % 90 + 1 AS DOUBLE) / 4 t FROM orders)
SELECT o_orderkey, 'CONSUMO FORA DE PONTA' item, 'FORNECIMENTO' tipo, CAST(o_orderkey AS DOUBLE) quantidade, v valor FROM o UNION ALL SELECT o_orderkey, 'CUSTEIO DE ILUMINACAO PUBLICA', 'ITENS FINANCEIROS', 1, c FROM o
UNION ALL SELECT o_orderkey, 'COMP. DMIC MENSAL 11/21', 'ITENS FINANCEIROS', NULL, -c FROM o UNION ALL SELECT o_orderkey, 'TRIBUTOS (PIS/COFINS)', 'ITENS FINANCEIROS', NULL, CASE WHEN o_orderkey % 2 = 0 THEN round(t + c, 2) ELSE t END FROM o""")
def b_old_note(spark, sf):
    """Items of the old note of layout B; the taxes are one item, from their rows or from the line that sums them."""
    light, tax = _br("o_orderkey % 50 + 1"), _br("(o_orderkey % 90 + 1) / 4")
    rows = F.concat(F.lit("PIS 100,00 1,0000% "), tax, F.lit("\nCOFINS 100,00 5,0000% "), light)
    text = F.concat(
        F.lit("Modelo 6\nkWh Ativa F P CONSUMO FORA DE PONTA "), _text("o_orderkey"), F.lit(" 0,32776 "), _br("o_totalprice"),
        F.lit("\nx CUSTEIO DE ILUMINACAO PUBLICA "), light, F.lit("\nCOMP. DMIC MENSAL 11/21 -"), light, F.lit("\nTOTAL -5,00\n"),
        F.when(F.col("o_orderkey") % 2 == 0, rows).otherwise(F.concat(F.lit("TRIBUTOS: "), tax)), F.lit("\n"),
    )
    docs = table(spark, sf, "orders").select("o_orderkey", F.regexp_replace(text, "kWh Ativa F P ", "kWh 8.852 ").alias("text"))
    return docs.select("o_orderkey", F.inline(layout_b.items(F.col("text")))).select("o_orderkey", "item", "tipo", "quantidade", "valor")


@query("""WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,0)) AS DOUBLE) b FROM orders)
SELECT o_orderkey, 'PIS/PASEP' tributo, b base, '1.0%' aliquota, b / 100 valor FROM o UNION ALL SELECT o_orderkey, 'COFINS', b, '5.0%', b * 5 / 100 FROM o
UNION ALL SELECT o_orderkey, 'ICMS', CASE WHEN o_orderkey % 2 = 1 THEN b END, CASE WHEN o_orderkey % 2 = 1 THEN '17.0%' ELSE '0%' END, CASE WHEN o_orderkey % 2 = 1 THEN b / 4 ELSE 0 END FROM o""")
def b_taxes(spark, sf):
    """Tax rows of layout B behind the signs that recognition leaves; a missing ICMS is a zero row; a hundredfold rate is repaired."""
    b = F.col("o_totalprice").cast("decimal(18,0)").cast("double")
    odd = F.col("o_orderkey") % 2 == 1
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Tributos\n"), F.when(odd, "PIS/PASEP").otherwise("PIS / IPASEP"), F.lit(" ["), _br(b), F.lit("] 1,00% "), _br(b / 100)),
        F.concat(F.lit("| COFINS "), _br(b), F.lit(" "), F.when(odd, "500,00").otherwise("5,00"), F.lit(" | "), _br(b * 5 / 100)),
        F.when(odd, F.concat(F.lit("icms "), _br(b), F.lit("% - 17,00 "), _br(b / 4))),
    )
    found = table(spark, sf, "orders").select("o_orderkey", F.inline(layout_b.taxes(text)))
    return found.select("o_orderkey", F.col("Tributo").alias("tributo"), "base", "aliquota", "valor")


@query("""SELECT DISTINCT l_orderkey, CASE l_linenumber % 3 WHEN 0 THEN 'ENERGIA ATIVA - KWH' WHEN 1 THEN 'ENERGIA REATIVA - KWH' ELSE 'DEMANDA - KW' END grandeza, CASE WHEN l_linenumber % 2 = 0 THEN 'FORA PONTA' ELSE 'PONTA' END posto,
CASE WHEN l_linenumber = 1 THEN 10 * l_suppkey ELSE l_suppkey END anterior, l_partkey atual, CAST(l_linenumber AS DOUBLE) constante, l_quantity consumo, CAST(l_suppkey + 1000 AS VARCHAR) medidor FROM lineitem""")
def b_readings(spark, sf):
    """Readings of layout B; a zero that was read as a letter is put back; equal rows count once."""
    n = F.col("l_linenumber")
    kind = F.when(n % 3 == 0, "Energia Ativa-kWh").when(n % 3 == 1, "Energia Reativa").otherwise("Demanda-kW")
    before = F.when(n == 1, F.concat(_text("l_suppkey"), F.lit("(o)"))).otherwise(_text("l_suppkey"))
    row = F.concat_ws(" ", (F.col("l_suppkey") + 1000).cast("string"), kind, F.when(n % 2 == 0, "Fora  ponta").otherwise("Ponta"), before, _text("l_partkey"), n.cast("string"), _br("l_quantity"))
    docs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(row), "\n").alias("text"))
    found = docs.select("l_orderkey", F.inline(layout_b.readings(F.col("text"))))
    return found.select("l_orderkey", F.col("Grandezas").alias("grandeza"), "posto", "anterior", "atual", "constante", "consumo", F.col("Medidor").alias("medidor"))


@query("""SELECT o_orderkey, '2' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') competencia FROM orders""")
def month_of_file(spark, sf):
    """yyyy-mm from the long name of a month and a year in the file's name."""
    month = F.element_at(F.array(*map(F.lit, ("Janeiro", "fevereiro", "MARÇO", "Abril", "Maio", "Junho", "JULHO", "agosto", "Setembro", "Outubro", "Novembro", "Dezembro"))), (F.col("o_orderkey") % 12 + 1).cast("int"))
    path = F.concat(F.lit("/in/MAIO.2001/conta "), month, F.lit("."), F.lit("2"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"), F.lit(" - via.pdf"))
    return table(spark, sf, "orders").select("o_orderkey", tx.month_from_name(path).alias("competencia"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_orderkey % 400 AS INTEGER) END dias FROM orders")
def date_difference(spark, sf):
    later = F.when(F.col("o_orderkey") % 5 == 0, "31/02/2024").otherwise(F.date_format(F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 400).cast("int")), "dd/MM/yyyy"))
    return table(spark, sf, "orders").select("o_orderkey", tx.date_days(_day("o_orderdate", 0), later).alias("dias"))


# ---- Layout A: customer, balance, old layout -----------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, 'FORUM DE ' || upper(c_mktsegment) razao_social, '02.292.266/0001-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') cnpj, CASE WHEN c_custkey % 3 < 2 THEN lpad(CAST(c_custkey % 100000000 AS VARCHAR), 8, '0') END cep,
'NATION ' || translate(CAST(n_nationkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') municipio, 'GO' uf FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def a_customer(spark, sf):
    """Customer of layout A: the place of delivery, else the one behind the tax number, else any of the page."""
    town = F.concat(F.lit("NATION "), F.translate(_text("n_nationkey"), "0123456789", "ABCDEFGHIJ"), F.lit(" GO BRASIL"))
    place = F.concat(F.lit("CEP: "), F.lpad((F.col("c_custkey") % 100000000).cast("string"), 8, "0"), F.lit(" "), town)
    owner = F.concat(F.lit("FORUM DE "), F.upper("c_mktsegment"), F.lit("\nCNPJ/CPF: 02.292.266/0001-"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("\n"))
    k = F.col("c_custkey") % 3
    other = F.lit("CEP: 99999999 OUTRA SP BRASIL\n")
    text = (
        F.when(k == 0, F.concat(F.lit("ENDEREÇO DE ENTREGA: X\nRUA UM\n"), place, F.lit("\n"), owner, other))
        .when(k == 1, F.concat(F.lit("1\n"), owner, F.lit("RUA UM\n"), place, F.lit("\nPERDAS DE TRANSFORMAÇÃO / RAMAL: 0,00 %\n"), other))
        .otherwise(F.concat(F.lit("1\n"), owner, F.lit("2\n"), town, F.lit("\n")))
    )
    joined = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select("c_custkey", *(v.alias(n) for n, v in layout_a.customer(text).items()))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 3 k, replace(replace(replace(format('{:,.2f}', CAST(o_totalprice AS DECIMAL(18,2))), ',', '#'), '.', ','), '#', '.') v FROM orders)
SELECT o_orderkey, CAST(2000 + o_orderkey % 25 AS VARCHAR) || '_' || lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0') ciclo, CASE WHEN k > 0 THEN v END total, CASE WHEN k = 0 THEN '0,00' END p, CASE WHEN k = 0 THEN v END fp, CASE WHEN k = 0 THEN '-1,50' END hr FROM o""")
def a_scee(spark, sf):
    """Cycle and balances of the net-metering scheme: by tariff post, as a total, or as a bare amount."""
    v, k = _br("o_totalprice"), F.col("o_orderkey") % 3
    balance = F.when(k == 0, F.concat(F.lit("P=0,00, FP="), v, F.lit(", HR=-1,50"))).when(k == 1, F.concat(F.lit("ATV="), v)).otherwise(v)
    text = F.concat(F.lit("x GERAÇÃO CICLO ("), (F.col("o_orderkey") % 12 + 1).cast("string"), F.lit("/"), (F.col("o_orderkey") % 25 + 2000).cast("string"), F.lit("):\nSALDO KWH: "), balance, F.lit(", SALDO A EXPIRAR 1,00"))
    names = ("ciclo", "total", "p", "fp", "hr")
    return table(spark, sf, "orders").select("o_orderkey", *(c.alias(n) for n, c in zip(names, layout_a.scee(text), strict=True)))


@query("""WITH l AS (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) v, translate(CAST(l_partkey AS VARCHAR), '0123456789', 'KLMNOQSTUV') name FROM lineitem)
SELECT l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN 'CONSUMO ' || name WHEN 1 THEN 'ENERGIA ATIVA FORNECIDA HR' WHEN 2 THEN 'MULTA ' || name ELSE 'ENERGIA ' || name END item,
CASE WHEN l_linenumber % 4 = 2 THEN 'ITENS FINANCEIROS' ELSE 'FORNECIMENTO' END tipo, CASE WHEN l_linenumber % 4 <> 2 THEN 'kWh' END unidade, CASE WHEN l_linenumber % 4 <> 2 THEN l_quantity END quantidade, v valor,
CASE WHEN l_linenumber % 4 IN (1, 3) THEN CAST(0.4 AS DOUBLE) END tarifa FROM l UNION ALL SELECT l_orderkey, 'CIP RETROATIVA', 'ITENS FINANCEIROS', NULL, NULL, 15.88, NULL FROM l WHERE l_linenumber % 4 = 3""")
def a_old_items(spark, sf):
    """The old layout of A: items with unit and rate, an anagram of a known name, counted and plain amounts, and a second item on the line."""
    k = F.col("l_linenumber") % 4
    name = F.translate(_text("l_partkey"), "0123456789", "KLMNOQSTUV")
    tail = F.concat_ws(" ", F.lit("kWh"), _br("l_quantity"), F.lit("1,00"), _br("l_extendedprice"), F.lit("0 0 17% 0 0,4"))
    row = (
        F.when(k == 0, F.concat_ws(" ", F.lit("Consumo"), name, F.lit("- kWh"), _br("l_quantity"), F.lit("0,650560"), _br("l_extendedprice")))
        .when(k == 1, F.concat_ws(" ", F.lit("AVITA ENERGIA FORNECIDA RH"), tail))
        .when(k == 2, F.concat_ws(" ", F.lit("Multa"), name, _br("l_extendedprice"), F.lit("COFINS 83,82 5,8225% 4,88")))
        .otherwise(F.concat_ws(" ", F.lit("Energia"), name, tail, F.lit("CIP RETROATIVA 15,88")))
    )
    docs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit("Itens da Fatura\n"), F.array_join(F.collect_list(row), "\n"), F.lit("\nTOTAL 1\n")).alias("text"))
    return docs.select("l_orderkey", F.inline(layout_a.items(F.col("text")))).select("l_orderkey", "item", "tipo", "unidade", "quantidade", "valor", "tarifa")


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'ENERGIA ATIVA FORNECIDA FP' WHEN 1 THEN 'UFER DEMONSTRATIVO PONTA' WHEN 2 THEN 'AD. BAND. VERMELHA EN. ATIVA FORN. P - PARC. TE' WHEN 3 THEN 'A X B Y C Z QQ FP' ELSE p_name END item FROM part""")
def a_contained_name(spark, sf):
    """Scrambled names: the longest known name whose letters are in it, whose tariff post agrees and that is half of it; others stay."""
    k = F.col("p_partkey") % 5
    given = (
        F.when(k == 0, "E N E R G I A ATIVAFORNECIDA X K FP")
        .when(k == 1, "UFER DEMONST R A T IVO PONTA W")
        .when(k == 2, "AD. BAND. V E R MELHA EN. ATIVA FORN. Q P - PARC. TE")
        .when(k == 3, "A X B Y C Z QQ FP")
        .otherwise(F.col("p_name"))
    )
    return table(spark, sf, "part").select("p_partkey", layout_a.unscrambled(given).alias("item"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'CONSUMO ' || upper(p_brand) ELSE 'CONSUMO' END item FROM part""")
def a_old_name(spark, sf):
    """Names of the old layout lose the unit and the meter's words before them."""
    even = F.col("p_partkey") % 2 == 0
    given = F.when(even, F.concat(F.lit(" Consumo "), F.col("p_brand"), F.lit(" - kVArh "))).otherwise("Energia Ativa - kWh Fora Ponta Consumo")
    return table(spark, sf, "part").select("p_partkey", layout_a.old_name(given).alias("item"))


# ---- Enrichment --------------------------------------------------------------------------------------------------------------------------


@query(SQL_READINGS + """, r AS (SELECT *, row_number() OVER (PARTITION BY medidor ORDER BY competencia DESC, id_fatura DESC) n FROM rd WHERE id_uc NOT LIKE 'NULO%'), lat AS (SELECT medidor, id_uc FROM r WHERE n = 1),
c AS (SELECT id_uc, medidor, count(*) k FROM rd GROUP BY ALL), mo AS (SELECT *, row_number() OVER (PARTITION BY id_uc ORDER BY k DESC, medidor) n FROM c), u AS (SELECT CAST(c_custkey AS VARCHAR) id_uc FROM customer)
SELECT u.id_uc, replace(replace(u.id_uc, '.', ''), '-', '') id_uc_sem_format, coalesce(lat.id_uc, u.id_uc) id_uc_atual_medidor, replace(replace(coalesce(lat.id_uc, u.id_uc), '.', ''), '-', '') id_uc_atual_medidor_sem_format
FROM u LEFT JOIN mo ON mo.id_uc = u.id_uc AND mo.n = 1 LEFT JOIN lat ON lat.medidor = mo.medidor""")
def meter_of_unit(spark, sf):
    """The current unit of the meter that a unit's readings name most often."""
    units = table(spark, sf, "customer").select(_text("c_custkey").alias("id_uc"))
    return derive.with_meters({"unidade_consumidora": units, "medicao": readings(spark, sf)})["unidade_consumidora"]


def _enriched(spark, sf) -> dict[str, DataFrame]:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    units = c.select(_text("c_custkey").alias("id_uc"), F.col("c_mktsegment").alias("razao_social"), F.col("n_name").alias("municipio"))
    kind = F.when(F.col("o_orderstatus") == "F", "Trifásico").otherwise("mono")
    bills = invoices(spark, sf).select("id_fatura", "id_uc", "competencia", kind.alias("tipo_fornecimento"))
    return derive.enrich({"unidade_consumidora": units.unionByName(units), "fatura": bills})


@query(f"""WITH {SQL_INVOICES}, r AS (SELECT id_uc, min(competencia) a, max(competencia) b FROM inv GROUP BY 1)
SELECT CAST(c_custkey AS VARCHAR) id_uc, c_mktsegment razao_social, n_name municipio, a primeira_competencia, b ultima_competencia FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN r ON r.id_uc = CAST(c_custkey AS VARCHAR)""")
def registry_enriched(spark, sf):
    """The registry after enrichment: first and last month, equal rows once, canonical order."""
    return _enriched(spark, sf)["unidade_consumidora"].select("id_uc", "razao_social", "municipio", "primeira_competencia", "ultima_competencia")


@query("SELECT CAST(o_orderkey AS VARCHAR) id_fatura, CASE WHEN o_orderstatus = 'F' THEN 'TRIFÁSICO' ELSE 'MONO' END tipo_fornecimento FROM orders")
def upper_supply_type(spark, sf):
    return _enriched(spark, sf)["fatura"].select("id_fatura", "tipo_fornecimento")


@query("SELECT CAST(o_orderkey AS VARCHAR) id_fatura, CAST(o_custkey AS VARCHAR) id_uc, strftime(o_orderdate, '%Y-%m') competencia, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) \"valor_total_r$\", 'x' extra FROM orders")
def short_invoices(spark, sf):
    """The short invoice sheet, a projection in canonical order; columns that are not canonical come last."""
    rows = invoices(spark, sf).select(F.lit("x").alias("extra"), F.col("`valor_total_r$`").cast("double").alias("valor_total_r$"), F.lit("g").alias("chave_acesso_nfe"), "competencia", "id_uc", "id_fatura")
    empty = spark.createDataFrame([], schemas.schema("medicao"))
    short = sheets.with_derived({"fatura": rows, "medicao": empty})["fatura_resumida"].join(rows.select("id_fatura", "extra"), "id_fatura")
    return schemas.conform(short, "fatura_resumida", fill=False).select("id_fatura", "id_uc", "competencia", quoted("valor_total_r$"), "extra")


# ---- Rules, profiles, appends ------------------------------------------------------------------------------------------------------------


@query("""SELECT * FROM (SELECT 'one' rule, 't' sheet, '' note, count(*) FILTER (o_orderstatus = 'F') changed FROM orders UNION ALL SELECT 'two', 't', 'column ''no column'' not found', count(*) FILTER (o_orderstatus IN ('O', 'F')) FROM orders
UNION ALL SELECT 'three', 'nowhere', 'sheet ''nowhere'' not found', NULL)""")
def rules_report(spark, sf):
    """What each active rule changed: the second one sees the rows that the first one changed. An inactive rule leaves no line."""
    from dataclasses import replace

    named = lambda n, r: replace(r, nome=n)
    one = named("one", _rule("t", [("E", [("o_orderstatus", "igual", "F")])], [("o_orderstatus", "O")]))
    two = named("two", _rule("t", [("E", [("o_orderstatus", "igual", "O")])], [("no column", "1"), ("o_orderpriority", "x")]))
    three, off = named("three", _rule("nowhere", [("E", [("a", "igual", "1")])], [("a", "2")])), rules.switched(one, False)
    report = rules.apply({"t": table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")}, [one, two, off, three])[1]
    return rules.report_rows(spark, report)


@query("""SELECT * FROM (VALUES ('fatura', true, 1, 'id_fatura', true), ('fatura', true, 2, 'valor_total_r$', true), ('fatura', true, 3, 'nothing', false), ('fatura', true, 4, 'blank', false), ('impostos', false, 1, 'id_fatura', true),
('fatura_resumida', true, 1, 'id_fatura', true), ('fatura_resumida', true, 2, 'nothing', true)) t(sheet, shown, pos, name, included)""")
def profile_meta(spark, sf):
    """The default profile, through its metadata and back: columns without a value and empty sheets are off; derived sheets keep all."""
    rows = invoices(spark, sf).select("id_fatura", F.col("`valor_total_r$`").cast("double").alias("valor_total_r$"), F.lit(None).cast("string").alias("nothing"), F.lit(" ").alias("blank"))
    given = {"fatura": rows, "impostos": rows.select("id_fatura").where("id_fatura is null"), "fatura_resumida": rows.select("id_fatura", "nothing")}
    meta = profile.to_meta(profile.from_meta(profile.to_meta(profile.default_profile(given))))
    found = [(s, p["incluida"], i, c["exibido"], c["incluida"]) for s, p in meta["abas"].items() for i, c in enumerate(p["colunas"], 1)]
    return spark.createDataFrame(found, "sheet string, shown boolean, pos int, name string, included boolean")


_SQL_BY_META = ORACLE["append_dedup_key"].replace('"Valor Total"', '"Quanto"').replace("SELECT id_fatura, v", 'SELECT id_fatura AS "Nota", v')


@query("""SELECT t.*, (SELECT count(*) FROM orders) AS n FROM (VALUES ('suggested', 'ID fatura', 'id_fatura'), ('suggested', 'Valor Total R$', 'valor_total_r$'), ('suggested', 'coluna_inventada', NULL), ('stored', 'Fatura', 'id_fatura'), ('stored', 'Nota livre', NULL), ('stored', 'Total', 'valor_total_r$')) t(source, shown, canonical)""")
def append_mapping(spark, sf):
    """The mapping of a table's shown names to canonical ones, suggested from the names and read from a workbook's metadata, and how many values each column has."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    meta = {"abas": {"fatura": {"colunas": [{"exibido": "Fatura", "canonico": "id_fatura"}, {"exibido": "Nota livre", "canonico": None}, {"exibido": "Total", "canonico": "valor_total_r$"}]}}}
    tables = {"suggested": rows.toDF("ID fatura", "Valor Total R$", "coluna_inventada"), "stored": rows.toDF("Fatura", "Total", "Nota livre")}
    maps = {"suggested": ap.suggest_mapping("fatura", tables["suggested"].columns), "stored": ap.mapping_of_meta(meta, "fatura") or {}}
    found = [df.agg(*(F.count(quoted(c)).alias(c) for c in df.columns)).select(F.inline(F.array(*(F.struct(F.lit(source).alias("source"), F.lit(c).alias("shown"), F.lit(maps[source][c]).cast("string").alias("canonical"), F.col(quoted(c)).alias("n")) for c in df.columns)))) for source, df in tables.items()]
    return found[0].union(found[1])


@query(_SQL_BY_META)
def append_by_metadata(spark, sf):
    """An append onto a table whose shown names are told by the metadata that its profile wrote."""
    old, new = _halves(spark, sf)
    old = old.toDF("Nota", "Quanto")
    shown = profile.SheetProfile(True, [profile.Shown("id_fatura", "Nota"), profile.Shown("valor_total_r$", "Quanto")])
    maps = {"fatura": ap.mapping_of_meta(profile.to_meta({"fatura": shown}), "fatura")}
    return ap.append({"fatura": old}, maps, {"fatura": new}).sheets["fatura"]


@query("""WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) k, l_orderkey % 3 m, l_quantity q FROM lineitem) SELECT DISTINCT k id_fatura, q quantidade FROM l WHERE m <> 2 UNION ALL SELECT DISTINCT k, q + 100 FROM l WHERE m = 2""")
def append_new_only(spark, sf):
    """Items of invoices that are already in the table are not added again, even if they differ."""
    line = table(spark, sf, "lineitem").select(_text("l_orderkey").alias("id_fatura"), F.col("l_quantity").alias("quantidade"))
    k = F.col("id_fatura").cast("bigint") % 3
    old, new = line.where(k != 2), line.where(k != 0).withColumn("quantidade", F.col("quantidade") + 100)
    return ap.append({"itens_fatura": old}, {"itens_fatura": {c: c for c in old.columns}}, {"itens_fatura": new}).sheets["itens_fatura"]


@query("""SELECT CAST(l_orderkey AS VARCHAR) "Fatura", CASE WHEN l_linenumber % 2 = 0 THEN 'consumo' ELSE 'demanda' END "Item", CASE WHEN l_linenumber % 2 = 0 THEN 'CONSUMO TOTAL' ELSE 'demanda' END item_normalizado FROM lineitem GROUP BY ALL""")
def rederived_columns(spark, sf):
    """Derived columns over old and new rows, written back under the names that the workbook shows."""
    line = table(spark, sf, "lineitem").select(_text("l_orderkey").alias("id_fatura"), F.when(F.col("l_linenumber") % 2 == 0, "consumo").otherwise("demanda").alias("item"))
    k = F.col("id_fatura").cast("bigint") % 2
    old, new = line.where(k == 0).withColumnsRenamed({"id_fatura": "Fatura", "item": "Item"}), line.where(k == 1)
    both = ap.append({"itens_fatura": old}, {"itens_fatura": {"Fatura": "id_fatura", "Item": "item"}}, {"itens_fatura": new})
    equal = spark.createDataFrame([(0, "Consumo", "CONSUMO TOTAL")], "pos int, item string, item_normalizado string")
    return ap.rederive(both, equal)["itens_fatura"].select("Fatura", "Item", "item_normalizado")


@query("SELECT 'Item de fatura' categoria, count(DISTINCT p_type) n FROM part UNION ALL SELECT 'Valor', 7 UNION ALL SELECT 'Aba', 8")
def glossary_items(spark, sf):
    """The dictionary with the items of the corpus as terms, added once."""
    items = table(spark, sf, "part").select(F.col("p_type").alias("item"))
    built = glossary.glossary(spark, glossary.item_terms(items))
    done = glossary.with_glossary(glossary.with_glossary({}, built), built)
    return done[glossary.SHEET].where("Categoria in ('Item de fatura', 'Valor', 'Aba')").groupBy(F.col("Categoria").alias("categoria")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'p_name' name, CAST(greatest(max(length(p_name)), 6) AS INTEGER) width FROM part UNION ALL SELECT 'p_retailprice', 13 UNION ALL SELECT 'p_partkey', 9")
def widest_texts(spark, sf):
    """The widest text of each column, its heading included: one aggregate."""
    from voltledger.sources import workbook

    rows = table(spark, sf, "part").select("p_name", F.col("p_retailprice").cast("int").alias("p_retailprice"), "p_partkey")
    return spark.createDataFrame(list(workbook.widths(rows).items()), "name string, width int")


@query("SELECT * FROM (SELECT 'total' counter, CAST(count(*) AS BIGINT) n FROM orders UNION ALL SELECT 'processed', count(*) FILTER (o_orderkey % 3 <> 0) FROM orders UNION ALL SELECT 'errors', count(*) FILTER (o_orderkey % 3 = 0) FROM orders)")
def run_counters(spark, sf):
    """Counters of a run: texts, invoices and error rows, of whole invoices without a single item in every third one."""
    from voltledger.plans import flows

    body = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.lit("CONSUMO kWh 1,00 0,50 0,50 0,10 0,50 17% 0,10 0,40\n"))
    text = F.concat(F.lit("10605788 NOTA FISCAL Nº 1\nMAR/2024 09/03/2024 R$***"), _br("o_totalprice"), F.lit("\nFORNECIMENTO\n"), body, F.lit("\nITENS FINANCEIROS\nTOTAL\n"))
    docs = table(spark, sf, "orders").select(F.concat(F.lit("/in/"), (F.col("o_orderkey") + 2000000000000).cast("string"), F.lit(".pdf")).alias("path"), F.lit(layout_a.SUPPLIER).alias("fornecedor"), text.alias("text"))
    return flows.process_texts(docs, [layout_a.SUPPLIER]).counters()


@query("""WITH d AS (SELECT DISTINCT p_name n, replace(p_name, ' ', '') b FROM part), t AS (SELECT c_custkey, lower(reverse(c_mktsegment)) || ' ' || reverse(coalesce(p_name, '')) x FROM customer LEFT JOIN part ON p_partkey = c_custkey),
h AS (SELECT DISTINCT x, replace(x, ' ', '') y FROM t), m AS (SELECT x, n, row_number() OVER (PARTITION BY x ORDER BY length(b) DESC, n) k FROM h JOIN d ON length(b) * 2 >= length(y) AND length(b) <= length(y)
AND list_bool_and(list_transform(string_split(b, ''), lambda c: length(b) - length(replace(b, c, '')) <= length(y) - length(replace(y, c, '')))))
SELECT c_custkey, t.x AS "text", n item FROM t LEFT JOIN m ON m.x = t.x AND k = 1""")
def contained_names(spark, sf):
    """Part names as the dictionary: the longest name whose letters a scrambled text holds."""
    c, p = table(spark, sf, "customer"), table(spark, sf, "part")
    text = F.concat(F.lower(F.reverse("c_mktsegment")), F.lit(" "), F.reverse(F.coalesce("p_name", F.lit(""))))
    texts = c.join(p, c.c_custkey == p.p_partkey, "left").select("c_custkey", text.alias("text"))
    return longest_contained(texts, "text", p, "p_name", "item")


# ---- Appends that read and write only what new rows touch --------------------------------------------------------------------------------


@query(ORACLE["append_dedup_key"])
def append_ledger(spark, sf):
    """The append of ``append_dedup_key`` onto a ledger: only keys of touched buckets are read, and files are added."""
    old, new = (df.toDF("id_fatura", "valor_total_r$") for df in _halves(spark, sf))
    book = Ledger(spark, f"{scratch(spark)}/ledger-{uuid4().hex}")
    book.write({"fatura": old})
    book.append({"fatura": new})
    return book.read()[0]["fatura"].withColumnRenamed("valor_total_r$", "Valor Total")


def _refreshed(spark, sf):
    """Two thirds of the invoices with derived columns and facts; the others are appended."""
    inv = invoices(spark, sf).withColumn("tipo_fornecimento", F.lit("x"))
    every = {"fatura": inv, "medicao": readings(spark, sf, dealt=False), "unidade_consumidora": table(spark, sf, "customer").select(_text("c_custkey").alias("id_uc"))}
    part = lambda is_new: {n: df.where((F.col("id_uc" if n == "unidade_consumidora" else "id_fatura").try_cast("bigint") % 3 == 2) == is_new) for n, df in every.items()}
    old, new = part(False), part(True)
    return incremental.refreshed(derive.enrich(old), new, incremental.facts(old), incremental.facts(new))[0]


@query(ORACLE["uc_first_last"])
def incremental_units(spark, sf):
    return _refreshed(spark, sf)["unidade_consumidora"].select("id_uc", "primeira_competencia", "ultima_competencia", "primeira_fatura", "ultima_fatura")


@query(ORACLE["uc_current_id"])
def incremental_meters(spark, sf):
    return _refreshed(spark, sf)["fatura"].select("id_fatura", "medidor", "id_uc_atual")


# ---- The header fields that the other queries don't print --------------------------------------------------------------------------------


@query("""SELECT CAST(2000000000000 + o_orderkey AS VARCHAR) numero_fatura, CAST(2000000000000 + o_orderkey AS VARCHAR) || '.pdf' arquivo_pdf, 'EQUATORIAL' fornecedor, CAST(o_orderkey % 4 AS VARCHAR) serie_nf, '5258' cfop, lpad(CAST(o_orderkey AS VARCHAR), 44, '7') chave_acesso_nfe,
CAST(900000 + o_custkey AS VARCHAR) protocolo_autorizacao, strftime(o_orderdate, '%Y-%m-%d') || ' 10:' || CAST(10 + o_orderkey % 50 AS VARCHAR) data_hora_protocolo, CASE WHEN o_orderkey % 2 = 0 THEN 'BIF' ELSE 'TRI' END tipo_fornecimento,
CAST(CASE WHEN o_orderkey % 3 > 0 THEN 220 + o_orderkey % 160 END AS VARCHAR) tensao_nominal_v, CAST(200 + o_orderkey % 10 AS VARCHAR) tensao_min_v, CAST(230 + o_orderkey % 10 AS VARCHAR) tensao_max_v,
CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey + 0.5 ELSE 0 END AS DOUBLE) demanda_contratada_kw, CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_custkey + 1 ELSE 0 END AS DOUBLE) demanda_geracao_contratada_kw,
CAST(CASE WHEN o_orderkey % 2 = 0 THEN 2.5 END AS DOUBLE) perdas_transformacao_pct, '2024_0' || (1 + o_orderkey % 9) scee_geracao_ciclo, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || ',25' END scee_saldo_kwh_total,
CASE WHEN o_orderkey % 2 = 1 THEN '1,00' END scee_saldo_kwh_p, CASE WHEN o_orderkey % 2 = 1 THEN o_custkey || ',50' END scee_saldo_kwh_fp, CASE WHEN o_orderkey % 2 = 1 THEN '3,75' END scee_saldo_kwh_hr,
strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') data_leitura_anterior, strftime(o_orderdate + INTERVAL 2 DAY, '%Y-%m-%d') data_leitura_atual, strftime(o_orderdate + INTERVAL 3 DAY, '%Y-%m-%d') data_proxima_leitura FROM orders""")
def header_fields(spark, sf):
    o = table(spark, sf, "orders")
    k, c, given = F.col("o_orderkey"), _text("o_custkey"), lambda when, *parts: F.when(when, F.concat(*parts)).otherwise(F.lit(""))
    text = F.concat(
        F.lit("NOTA FISCAL Nº "), _text("o_orderkey"), F.lit(" - SÉRIE "), (k % 4).cast("string"), F.lit("\nchave de acesso:\n"), F.lpad(_text("o_orderkey"), 44, "7"), F.lit("\nProtocolo de autorização: "), (F.col("o_custkey") + 900000).cast("string"),
        F.lit(" - "), _day("o_orderdate", 0), F.lit(" às 10:"), (10 + k % 50).cast("string"), F.lit("\nTipo de Fornecimento: "), F.when(k % 2 == 0, "BIF").otherwise("TRI"), F.lit("\n"),
        given(k % 3 > 0, F.lit("Tensão Nominal Disp: "), (220 + k % 160).cast("string"), F.lit(" V ")), F.lit("Lim Min: "), (200 + k % 10).cast("string"), F.lit(" V Lim Max: "), (230 + k % 10).cast("string"), F.lit(" V\n"),
        given(k % 5 == 0, F.lit("DEMANDA - kW "), c, F.lit(",5\n")), given(k % 7 == 0, F.lit("DEMANDA GERAÇÃO - kW "), (F.col("o_custkey") + 1).cast("string"), F.lit("\n")), given(k % 2 == 0, F.lit("PERDAS DE TRANSFORMAÇÃO / RAMAL: 2,5 %\n")),
        _day("o_orderdate", 1), F.lit(" "), _day("o_orderdate", 2), F.lit(" 30 "), _day("o_orderdate", 3), F.lit("\nGERAÇÃO CICLO ("), (1 + k % 9).cast("string"), F.lit("/2024)\nSALDO KWH: "),
        F.when(k % 2 == 0, F.concat(c, F.lit(",25"))).otherwise(F.concat(F.lit("P=1,00, FP="), c, F.lit(",50, HR=3,75"))), F.lit(", SALDO A EXPIRAR: 0,00\n"),
    )
    docs = o.select(F.concat(F.lit("/in/"), (k + 2000000000000).cast("string"), F.lit(".pdf")).alias("path"), text.alias("text"))
    h = layout_a.header(F.col("text"), F.col("path"), F.lit(None).cast("string"))
    names = ("numero_fatura", "arquivo_pdf", "fornecedor", "serie_nf", "cfop", "chave_acesso_nfe", "protocolo_autorizacao", "data_hora_protocolo", "tipo_fornecimento", "tensao_nominal_v", "tensao_min_v", "tensao_max_v", "demanda_contratada_kw", "demanda_geracao_contratada_kw", "perdas_transformacao_pct", "scee_geracao_ciclo", "scee_saldo_kwh_total", "scee_saldo_kwh_P", "scee_saldo_kwh_FP", "scee_saldo_kwh_HR", "data_leitura_anterior", "data_leitura_atual", "data_proxima_leitura")
    return spread(docs).select(*(h[n].alias(n.lower()) for n in names))
