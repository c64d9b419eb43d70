"""Registered queries: every operator of the engine over the driver's tables, each with the DuckDB SQL of the same result.

Roles: orders are invoices, lineitem rows are items, taxes and readings, customers are units, suppliers are meters. Money is exact decimals until the
last projection, which casts to double so that both engines hash alike.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltledger.functions import repair
from voltledger.functions import text as tx
from voltledger.operators import append as ap
from voltledger.operators import derive, glossary, layout_a, profile, reconcile, rules, sheets
from voltledger.operators.items import READING, SUPPLY, TAX, cut_before, item
from voltledger.operators.order import POSITION, positioned
from voltledger.sources.documents import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(c: str) -> Column:
    return F.col(c).cast("string")


# ---- Roles -------------------------------------------------------------------------------------------------------------------------------


def invoices(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(_text("o_orderkey").alias("id_fatura"), _text("o_custkey").alias("id_uc"), F.date_format("o_orderdate", "yyyy-MM").alias("competencia"), F.col("o_totalprice").cast("decimal(18,2)").alias("valor_total_r$"), "o_orderpriority", "o_orderstatus")


def items(spark: SparkSession, sf: str) -> DataFrame:
    v, t = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_tax").cast("decimal(6,4)")
    tax = F.when(F.col("l_returnflag") == "R", F.lit(0)).otherwise(F.round(v * t, 2)).cast("decimal(18,2)")
    return table(spark, sf, "lineitem").select(_text("l_orderkey").alias("id_fatura"), F.when(F.col("l_linestatus") == "F", "TRIBUTOS (PIS/COFINS)").otherwise("CONSUMO").alias("item"), v.alias("valor_r$"), tax.alias("pis_cofins"), F.lit(None).cast("decimal(18,2)").alias("icms"))


def taxes(spark: SparkSession, sf: str) -> DataFrame:
    v, t = F.col("l_extendedprice").cast("decimal(18,2)"), F.col("l_tax").cast("decimal(6,4)")
    return table(spark, sf, "lineitem").select(_text("l_orderkey").alias("id_fatura"), F.when(F.col("l_linestatus") == "F", v).otherwise(F.round(v * t, 2)).cast("decimal(18,2)").alias("Valor (R$)"))


def readings(spark: SparkSession, sf: str, dealt: bool = True) -> DataFrame:
    line, order = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), invoices(spark, sf).select("id_fatura", "id_uc", "competencia")
    uc = F.when(F.col("id_uc").cast("bigint") % 10 == 0, F.concat(F.lit("NULO_"), "id_uc")).otherwise(F.col("id_uc"))
    line = line.select(_text("l_orderkey").alias("id_fatura"), _text("l_suppkey").alias("Medidor"))
    line, order = derive.dealt("id_fatura", line, order) if dealt else (line, order)
    return line.join(order, "id_fatura").withColumn("id_uc", uc)


SQL_INVOICES = "inv AS (SELECT CAST(o_orderkey AS VARCHAR) id_fatura, CAST(o_custkey AS VARCHAR) id_uc, strftime(o_orderdate, '%Y-%m') competencia, CAST(o_totalprice AS DECIMAL(18,2)) total FROM orders)"
SQL_TOTALS = """WITH l AS (SELECT CAST(l_orderkey AS VARCHAR) id, l_returnflag rf, l_linestatus ls, CAST(l_extendedprice AS DECIMAL(18,2)) v, CAST(l_tax AS DECIMAL(6,4)) t FROM lineitem),
a AS (SELECT id, sum(CASE WHEN ls = 'F' THEN v ELSE round(v * t, 2) END) impostos, sum(CASE WHEN ls = 'F' THEN v WHEN rf = 'R' THEN 0 ELSE round(v * t, 2) END) soma, sum(v) valor FROM l GROUP BY id),
t AS (SELECT coalesce(a.id, o.id) id_fatura, coalesce(impostos, 0) impostos, coalesce(soma, 0) soma, coalesce(valor, 0) valor, total FROM a FULL JOIN (SELECT CAST(o_orderkey AS VARCHAR) id, CAST(o_totalprice AS DECIMAL(18,2)) total FROM orders) o ON a.id = o.id)"""
SQL_READINGS = f"""WITH {SQL_INVOICES}, rd AS (SELECT CAST(l_orderkey AS VARCHAR) id_fatura, CAST(l_suppkey AS VARCHAR) medidor, CASE WHEN CAST(id_uc AS BIGINT) % 10 = 0 THEN 'NULO_' || id_uc ELSE id_uc END id_uc, competencia FROM lineitem JOIN inv ON inv.id_fatura = CAST(l_orderkey AS VARCHAR))"""


def _totals(spark, sf):
    return reconcile.totals(taxes(spark, sf), items(spark, sf), invoices(spark, sf))


def _doubles(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") for n in names})


# ---- Reconciliation ----------------------------------------------------------------------------------------------------------------------


@query(SQL_TOTALS + " SELECT id_fatura, CAST(impostos AS DOUBLE) aba_impostos, CAST(soma AS DOUBLE) soma_itens, CAST(impostos - soma AS DOUBLE) diferenca FROM t WHERE abs(impostos - soma) > 0.5")
def reconcile_taxes(spark, sf):
    return _doubles(reconcile.tax_differences(_totals(spark, sf)), "aba_impostos", "soma_itens", "diferenca")


@query(SQL_TOTALS + " SELECT id_fatura, CAST(total AS DOUBLE) valor_total, CAST(valor AS DOUBLE) soma_itens, CAST(total - valor AS DOUBLE) diferenca FROM t WHERE total IS NOT NULL AND abs(total - valor) > 0.5")
def reconcile_totals(spark, sf):
    return _doubles(reconcile.total_differences(_totals(spark, sf)), "valor_total", "soma_itens", "diferenca")


@query(SQL_TOTALS + """ SELECT 'Total fatura = soma itens' "Verificacao", count(*) "Total", count(*) FILTER (abs(total - valor) > 0.5) "Inconsistencias", CAST(0.5 AS DOUBLE) "Tolerancia" FROM t
UNION ALL SELECT 'Impostos = soma impostos itens', count(*), count(*) FILTER (abs(impostos - soma) > 0.5), CAST(0.5 AS DOUBLE) FROM t""")
def reconcile_summary(spark, sf):
    return reconcile.summary(_totals(spark, sf))


# ---- Enrichment --------------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {SQL_INVOICES}, r AS (SELECT *, row_number() OVER (PARTITION BY id_uc ORDER BY competencia, id_fatura) a, row_number() OVER (PARTITION BY id_uc ORDER BY competencia DESC, id_fatura DESC) b FROM inv)
SELECT CAST(c_custkey AS VARCHAR) id_uc, f.competencia primeira_competencia, l.competencia ultima_competencia, f.id_fatura primeira_fatura, l.id_fatura ultima_fatura FROM customer
LEFT JOIN (SELECT * FROM r WHERE a = 1) f ON f.id_uc = CAST(c_custkey AS VARCHAR) LEFT JOIN (SELECT * FROM r WHERE b = 1) l ON l.id_uc = CAST(c_custkey AS VARCHAR)""")
def uc_first_last(spark, sf):
    units = table(spark, sf, "customer").select(_text("c_custkey").alias("id_uc"))
    return units.join(derive.first_and_last(invoices(spark, sf)), "id_uc", "left")


@query(SQL_READINGS + ", r AS (SELECT *, row_number() OVER (PARTITION BY medidor ORDER BY competencia DESC, id_fatura DESC) n FROM rd WHERE id_uc NOT LIKE 'NULO%') SELECT medidor, id_uc uc FROM r WHERE n = 1")
def meter_latest_uc(spark, sf):
    return derive.current_unit(readings(spark, sf))


@query("WITH c AS (SELECT l_orderkey, CAST(l_suppkey AS VARCHAR) m, count(*) n FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, m) k FROM c) SELECT CAST(l_orderkey AS VARCHAR) id_fatura, m medidor FROM r WHERE k = 1")
def meter_mode(spark, sf):
    line = table(spark, sf, "lineitem").select(_text("l_orderkey").alias("id_fatura"), F.col("l_suppkey").alias("Medidor"))
    return derive.mode(line, "id_fatura", "Medidor", "medidor")


@query(SQL_READINGS + """, r AS (SELECT *, row_number() OVER (PARTITION BY medidor ORDER BY competencia DESC, id_fatura DESC) n FROM rd WHERE id_uc NOT LIKE 'NULO%'), lat AS (SELECT medidor, id_uc FROM r WHERE n = 1),
c AS (SELECT id_fatura, medidor, count(*) k FROM rd GROUP BY ALL), mo AS (SELECT *, row_number() OVER (PARTITION BY id_fatura ORDER BY k DESC, medidor) n FROM c)
SELECT inv.id_fatura, mo.medidor, replace(replace(coalesce(lat.id_uc, inv.id_uc), '.', ''), '-', '') id_uc_atual FROM inv LEFT JOIN mo ON mo.id_fatura = inv.id_fatura AND mo.n = 1 LEFT JOIN lat ON lat.medidor = mo.medidor""")
def uc_current_id(spark, sf):
    found = derive.with_meters({"fatura": invoices(spark, sf), "medicao": readings(spark, sf)})
    return found["fatura"].select("id_fatura", "medidor", "id_uc_atual")


_EQUIVALENCES = [("promo brushed tin", "PROMO TIN"), ("STANDARD POLISHED BRASS", "STD BRASS"), ("standard polished brass ", "STD POLISHED"), ("small plated steel", " "), ("", "X")]


@query("""WITH e(p, i, t) AS (VALUES (0, 'promo brushed tin', 'PROMO TIN'), (1, 'STANDARD POLISHED BRASS', 'STD BRASS'), (2, 'standard polished brass ', 'STD POLISHED')),
l AS (SELECT upper(trim(i)) k, arg_max(t, p) t FROM e GROUP BY 1) SELECT p_partkey, p_type item, coalesce(t, p_type) item_normalizado FROM part LEFT JOIN l ON l.k = upper(trim(p_type))""")
def item_equivalence(spark, sf):
    entries = spark.createDataFrame([(i, *e) for i, e in enumerate(_EQUIVALENCES)], "pos int, item string, item_normalizado string")
    return derive.normalised_items(table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("item")), entries)


@query("""SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' AND upper(replace(p_type, ' ', '')) = 'PROMOBRUSHEDTIN' THEN 'FIXED' WHEN p_brand = 'Brand#12' THEN p_type ELSE p_type END item FROM part""")
def item_correction(spark, sf):
    fixes = spark.createDataFrame([("Brand#1", "Promo  Brushed TÍN", "FIXED")], "id_fatura string, item_estranho string, item_correto string")
    return derive.correct_items(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("id_fatura"), F.col("p_type").alias("item")), fixes).select("p_partkey", "item")


@query("""SELECT event_id, CASE WHEN user_id = 7 AND event_type = 'click' THEN CAST(0 AS DOUBLE) ELSE value END consumo FROM events""")
def reading_correction(spark, sf):
    fixes = spark.createDataFrame([("7", "CLICK", "ÚNICO", 0.0)], "id_fatura string, Grandezas string, `Postos horarios` string, `Consumo kWh` double")
    read = table(spark, sf, "events").select("event_id", _text("user_id").alias("id_fatura"), F.col("event_type").alias("Grandezas"), F.lit("único").alias("Postos horarios"), F.col("value").alias("Consumo kWh"))
    return derive.correct_readings(read, fixes).select("event_id", F.col("`Consumo kWh`").alias("consumo"))


# ---- Rules -------------------------------------------------------------------------------------------------------------------------------


def _rule(sheet: str, groups: list[tuple[str, list[tuple[str, str, str]]]], actions: list[tuple[str, str]]) -> rules.Rule:
    return rules.parse([{"aba": sheet, "grupos": [{"operador": op, "condicoes": [{"coluna": c, "operador": o, "valor": v} for c, o, v in cs]} for op, cs in groups], "acoes": [{"coluna": c, "valor": v} for c, v in actions]}])[0]


def _ruled(df: DataFrame, *found: rules.Rule) -> DataFrame:
    return rules.apply({"t": df}, list(found))[0]["t"]


@query("SELECT o_orderkey, CASE WHEN (o_orderstatus = 'F' OR o_orderstatus = 'P') AND NOT o_orderpriority = '1-URGENT' THEN 'ZERO' ELSE o_orderpriority END o_orderpriority FROM orders")
def rules_group_logic(spark, sf):
    rule = _rule("t", [("OU", [("o_orderstatus", "igual", "f"), ("O_ORDERSTATUS", "igual", "P")]), ("E", [("o orderpriority", "diferente", "1-urgent")])], [("o_orderpriority", "ZERO")])
    return _ruled(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), rule).drop("o_orderstatus")


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') AND NOT contains(lower(p_type), 'promo') THEN 'METAL' ELSE p_type END p_type FROM part")
def rules_text_ops(spark, sf):
    return _ruled(table(spark, sf, "part").select("p_partkey", "p_type"), _rule("t", [("E", [("p_type", "contem", "STEEL"), ("p_type", "nao_contem", "promo")])], [("p_type", "METAL")]))


@query("SELECT p_partkey, CASE WHEN p_size > 10 AND p_size < 40 THEN 0 ELSE p_size END p_size, CASE WHEN p_size > 10 AND p_size < 40 THEN 'mid' ELSE CAST(p_retailprice AS VARCHAR) END p_retailprice FROM part")
def rules_numeric_ops(spark, sf):
    return _ruled(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), _rule("t", [("E", [("p_size", "maior_que", "10"), ("p_size", "menor_que", "40,0")])], [("p_size", "0"), ("p_retailprice", "mid")]))


@query("SELECT p_partkey, CASE WHEN p_size IN (1, 5, 9) THEN 'IN' ELSE p_brand END p_brand, CASE WHEN p_size NOT IN (1, 5, 9) THEN 'OUT' ELSE p_type END p_type FROM part")
def rules_list_ops(spark, sf):
    inside, outside = _rule("t", [("E", [("p_size", "esta_em", "1; 5;9,0")])], [("p_brand", "IN")]), _rule("t", [("E", [("p_size", "nao_esta_em", "1;5;9")])], [("p_type", "OUT")])
    return _ruled(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type"), inside, outside).drop("p_size")


@query("WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '  ' ELSE lang END lang FROM documents) SELECT doc_id, CASE WHEN lang IS NULL OR trim(lang) = '' THEN 'none' ELSE 'some' END lang FROM t")
def rules_blank_ops(spark, sf):
    k = F.col("doc_id") % 3
    rows = table(spark, sf, "documents").select("doc_id", F.when(k == 1, "  ").when(k == 2, F.col("lang")).alias("lang"), F.lit("").alias("out"))
    done = _ruled(rows, _rule("t", [("E", [("lang", "vazio", "")])], [("out", "none")]), _rule("t", [("E", [("lang", "nao_vazio", "")])], [("out", "some")]))
    return done.select("doc_id", F.col("out").alias("lang"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'open' ELSE o_orderstatus END o_orderstatus FROM orders")
def rules_sequence(spark, sf):
    steps = [("F", "fin"), ("fin", "closed"), ("O", "open"), ("closed", "done")]
    return _ruled(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), *(_rule("t", [("E", [("o_orderstatus", "igual", a)])], [("o_orderstatus", b)]) for a, b in steps))


def _many_rules() -> list[rules.Rule]:
    """300 rules that name the parts of a size and a brand, and one that reads what they write."""
    many = [_rule("t", [("E", [("p_size", "igual", str(i % 50 + 1)), ("p_brand", "igual", f"brand#{i % 25 + 1}")])], [("p_type", f"T{i}")]) for i in range(300)]
    named = [replace(r, nome=f"rule {i}") for i, r in enumerate(many)]
    return [*named, replace(_rule("t", [("OU", [("p_type", "igual", "t7"), ("p_type", "igual", "T8")])], [("p_type", "LAST")]), nome="rule 300")]


_SQL_MANY = "WITH k AS (SELECT i, CAST(i % 50 + 1 AS INTEGER) s, 'Brand#' || (i % 25 + 1) b FROM range(300) r(i)), m AS (SELECT p_partkey, max(i) i FROM part JOIN k ON p_size = s AND p_brand = b GROUP BY p_partkey)"


@query(_SQL_MANY + " SELECT p_partkey, CASE WHEN m.i IN (7, 8) THEN 'LAST' WHEN m.i IS NOT NULL THEN 'T' || m.i ELSE p_type END p_type FROM part LEFT JOIN m USING (p_partkey)")
def rules_many(spark, sf):
    return _ruled(table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type"), *_many_rules()).select("p_partkey", "p_type")


@query(_SQL_MANY + " SELECT 'rule ' || i AS rule, (SELECT count(*) FROM part WHERE p_size = s AND p_brand = b) changed FROM k UNION ALL SELECT 'rule 300', count(*) FROM m WHERE i IN (7, 8)")
def rules_many_report(spark, sf):
    """Rows changed by each of 301 rules, from one pass."""
    rows = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand", "p_type")
    return rules.report_rows(spark, rules.apply({"t": rows}, _many_rules())[1]).select("rule", "changed")


# ---- Append ------------------------------------------------------------------------------------------------------------------------------


def _halves(spark, sf):
    rows = invoices(spark, sf).select("id_fatura", F.col("`valor_total_r$`").cast("double").alias("valor_total_r$"), F.col("id_fatura").cast("bigint").alias("k"))
    old = rows.where("k % 3 <> 2").select("id_fatura", F.col("`valor_total_r$`").alias("Valor Total"))
    new = rows.where("k % 3 <> 0").select("id_fatura", (F.col("`valor_total_r$`") + 1).alias("valor_total_r$"))
    return old, new


_OLD_FIRST = "WITH u AS (SELECT CAST(o_orderkey AS VARCHAR) id_fatura, o_totalprice v, 0 s FROM orders WHERE o_orderkey % 3 <> 2 UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_totalprice + 1, 1 FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY id_fatura ORDER BY s) n FROM u)"


@query(_OLD_FIRST + ' SELECT id_fatura, v "Valor Total" FROM r WHERE n = 1')
def append_dedup_key(spark, sf):
    old, new = _halves(spark, sf)
    return ap.append({"fatura": old}, {"fatura": {"id_fatura": "id_fatura", "Valor Total": "valor_total_r$"}}, {"fatura": new}).sheets["fatura"]


@query("SELECT CAST(l_orderkey AS VARCHAR) id_fatura, l_quantity quantidade, l_extendedprice \"valor_r$\" FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY ALL UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_quantity, l_extendedprice FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL")
def append_dedup_row(spark, sf):
    rows = table(spark, sf, "lineitem").select(_text("l_orderkey").alias("id_fatura"), F.col("l_quantity").alias("quantidade"), F.col("l_extendedprice").alias("valor_r$"))
    k = F.col("id_fatura").cast("bigint") % 3
    maps = {"itens_fatura": {c: c for c in rows.columns}}
    return ap.append({"itens_fatura": rows.where(k != 0)}, maps, {"itens_fatura": rows.where(k != 2)}).sheets["itens_fatura"]


@query("""WITH u AS (SELECT CAST(l_orderkey AS VARCHAR) id_fatura, l_extendedprice v, 0 s FROM lineitem WHERE l_returnflag <> 'N' UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_extendedprice + 1, 1 FROM lineitem WHERE l_returnflag = 'N'),
r AS (SELECT *, row_number() OVER (PARTITION BY id_fatura ORDER BY s, v DESC) n FROM u) SELECT id_fatura, v "Valor Total" FROM r WHERE n = 1""")
def append_keep_first(spark, sf):
    """Rows of one key in falling order of their values: the first row stays, not the least one."""
    rows = table(spark, sf, "lineitem").select(_text("l_orderkey").alias("id_fatura"), F.col("l_extendedprice").alias("v"), (F.col("l_returnflag") == "N").alias("is_new"))
    old = positioned(rows.where("not is_new").select("id_fatura", F.col("v").alias("Valor Total")), [(-F.col("Valor Total")).alias("place")])
    new = positioned(rows.where("is_new").select("id_fatura", (F.col("v") + 1).alias("valor_total_r$")), [(-F.col("`valor_total_r$`")).alias("place")])
    return ap.append({"fatura": old}, {"fatura": {"id_fatura": "id_fatura", "Valor Total": "valor_total_r$"}}, {"fatura": new}).sheets["fatura"]


@query("""WITH o AS (SELECT *, row_number() OVER () pos FROM orders), u AS (SELECT CAST(o_custkey AS VARCHAR) id_fatura, o_totalprice v, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END s, pos FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY id_fatura ORDER BY s, pos) n FROM u) SELECT id_fatura, v "valor_total_r$" FROM r WHERE n = 1""")
def append_file_order(spark, sf):
    """Of the rows of one key the one that stands first in its file stays."""
    rows = positioned(table(spark, sf, "orders")).select(_text("o_custkey").alias("id_fatura"), F.col("o_totalprice").alias("valor_total_r$"), "o_orderstatus", POSITION)
    old, new = (rows.where(w).drop("o_orderstatus") for w in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"))
    return ap.append({"fatura": old}, {"fatura": {c: c for c in ("id_fatura", "valor_total_r$")}}, {"fatura": new}).sheets["fatura"]


@query(_OLD_FIRST + ' SELECT id_fatura "ID DA FATURA", v "Valor Total R$" FROM r WHERE n = 1')
def append_rename(spark, sf):
    old, new = _halves(spark, sf)
    old = old.withColumnsRenamed({"id_fatura": "ID DA FATURA", "Valor Total": "Valor Total R$"})
    maps = {"fatura": {"ID DA FATURA": "id_fatura", **ap.suggest_mapping("fatura", ["Valor Total R$"])}}
    return ap.append({"fatura": old}, maps, {"fatura": new}).sheets["fatura"]


@query(_OLD_FIRST + ' SELECT id_fatura, CASE WHEN s = 1 THEN v END "valor_total_r$" FROM r WHERE n = 1')
def append_new_columns(spark, sf):
    old, new = _halves(spark, sf)
    return ap.append({"fatura": old.select("id_fatura")}, {"fatura": {"id_fatura": "id_fatura"}}, {"fatura": new}, add_columns=True).sheets["fatura"]


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) n FROM documents) SELECT doc_id FROM r WHERE n = 1")
def batch_first_wins(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("text").alias("id_fatura"), "doc_id")
    return sheets.first_wins(docs, ["doc_id"]).select("doc_id")


@query("SELECT DISTINCT CAST(c_nationkey AS VARCHAR) id_uc, n_name municipio, c_mktsegment razao_social FROM customer JOIN nation ON c_nationkey = n_nationkey")
def registry_distinct(spark, sf):
    """The registry of enriched sheets: rows that are equal in all columns count once, a unit with different rows keeps them."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    registry = c.join(n, c.c_nationkey == n.n_nationkey).select(_text("c_nationkey").alias("id_uc"), F.col("n_name").alias("municipio"), F.col("c_mktsegment").alias("razao_social"))
    return derive.enrich({"unidade_consumidora": registry, "fatura": invoices(spark, sf).withColumn("tipo_fornecimento", F.lit("x"))})["unidade_consumidora"].select("id_uc", "municipio", "razao_social")


@query("SELECT CAST(l_orderkey AS VARCHAR) id_fatura, 'ITEM ' || l_linenumber item, l_quantity quantidade FROM lineitem WHERE l_returnflag <> 'R'")
def informative_filter(spark, sf):
    """Items that only inform are not on the sheet."""
    name = F.when(F.col("l_returnflag") == "R", "UFER Demonstrativo").otherwise(F.concat(F.lit("ITEM "), _text("l_linenumber")))
    rows = F.collect_list(item(name, SUPPLY, quantidade=F.col("l_quantity")))
    found = table(spark, sf, "lineitem").groupBy(_text("l_orderkey").alias("id_fatura")).agg(rows.alias("itens"))
    nothing = {"impostos": f"array<{TAX}>", "medicao": f"array<{READING}>", "cliente": "struct<cnpj:string>"}
    whole = found.select("*", F.lit("u").alias("id_uc"), F.lit("2024-01").alias("competencia"), F.struct("id_fatura").alias("fatura"), *(F.lit(None).cast(t).alias(n) for n, t in nothing.items()))
    return sheets.explode_sheets(whole)["itens_fatura"].select("id_fatura", "item", "quantidade")


@query("SELECT CAST(o_orderkey AS VARCHAR) id_fatura FROM orders WHERE NOT (o_totalprice > 0 AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R'))")
def illegible_filter(spark, sf):
    line = table(spark, sf, "lineitem").groupBy(_text("l_orderkey").alias("id_fatura")).agg(F.collect_list(F.struct(F.when(F.col("l_returnflag") == "R", "UFER DEMONSTRATIVO").otherwise("CONSUMO").alias("item"))).alias("itens"))
    order = table(spark, sf, "orders").select(_text("o_orderkey").alias("id_fatura"), F.struct(F.col("o_totalprice").alias("valor_total_r$")).alias("fatura"))
    joined = order.join(line, "id_fatura", "left").withColumns({"itens": F.coalesce("itens", F.array().cast("array<struct<item:string>>")), "path": F.col("id_fatura")})
    return sheets.readable(joined)[0].select("id_fatura")


@query("SELECT event_id, value energia_geracao_kwh FROM events WHERE event_type = 'purchase'")
def generation_readings(spark, sf):
    kind = F.when(F.col("event_type") == "purchase", " Energia  geracao - kwh ").otherwise(F.col("event_type"))
    return sheets.generation_readings(table(spark, sf, "events").select("event_id", kind.alias("Grandezas"), F.col("value").alias("Consumo kWh"))).drop("Grandezas")


@query("""WITH l AS (SELECT l_orderkey k, l_extendedprice, l_partkey, l_suppkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(18,2)) v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) pos FROM lineitem),
d AS (SELECT l.*, CAST(50 AS DECIMAL(18,2)) due, sum(v) OVER (PARTITION BY k) base, row_number() OVER (PARTITION BY k ORDER BY v DESC, pos) r FROM l),
s AS (SELECT *, CAST(round(CAST(due * v AS DOUBLE) / CAST(base AS DOUBLE), 2) AS DECIMAL(18,2)) share FROM d)
SELECT CAST(k AS VARCHAR) id_fatura, pos, CAST(CASE WHEN r > 1 THEN share ELSE due - coalesce(sum(CASE WHEN r > 1 THEN share END) OVER (PARTITION BY k), 0) END AS DOUBLE) pis_cofins FROM s""")
def tax_allocation(spark, sf):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    line = table(spark, sf, "lineitem").select(_text("l_orderkey").alias("id_fatura"), F.row_number().over(w).cast("bigint").alias("pos"), F.lit("FORNECIMENTO").alias("tipo"), F.col("l_extendedprice").cast("decimal(18,2)").cast("double").alias("valor_r$"), F.lit(None).cast("double").alias("pis_cofins"), F.lit(None).cast("double").alias("icms"))
    tax = table(spark, sf, "orders").select(_text("o_orderkey").alias("id_fatura"), F.inline(F.array(*(F.struct(F.lit(n).alias("Tributo"), F.lit(v).alias("Valor (R$)")) for n, v in (("COFINS", 30.0), ("pis/pasep", 20.0), ("ICMS", 99.0))))))
    return derive.allocate_taxes(line, tax).select("id_fatura", "pos", "pis_cofins")


# ---- Text --------------------------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, lower(trim(regexp_replace(strip_accents(text), '\\s+', ' ', 'g'))) k FROM documents")
def text_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower(tx.text_key(F.col("text"))).alias("k"))


@query("SELECT doc_id, lower(regexp_replace(strip_accents(text), '\\s+', '', 'g')) k FROM documents")
def tight_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.lower(tx.tight_key(F.col("text"))).alias("k"))


@query("SELECT doc_id, regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '', 'g') k FROM documents")
def column_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.name_key(F.col("text")).alias("k"))


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) v, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) pct, CAST(NULL AS DOUBLE) bad FROM orders")
def br_number_roundtrip(spark, sf):
    br = tx.format_br(F.col("o_totalprice").cast("decimal(18,2)"))
    return table(spark, sf, "orders").select("o_orderkey", tx.br_number(br).alias("v"), tx.br_number(F.concat(F.lit(" "), br, F.lit("%"))).alias("pct"), tx.br_number(F.concat(br, F.lit("d"))).alias("bad"))


def _br(c, d: int = 2) -> Column:
    return tx.format_br((F.expr(c) if isinstance(c, str) else c).cast(f"decimal(18,{d})"), d)


_LETTERS = "ABCDEFGHIJ"


@query("""SELECT CAST(l_orderkey AS VARCHAR) id_fatura, 'ENERGIA ' || translate(CAST(l_partkey AS VARCHAR), '0123456789', 'ABCDEFGHIJ') item, 'FORNECIMENTO' tipo, 'kWh' unidade, l_quantity quantidade, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) valor,
CAST(CAST(l_tax AS DECIMAL(6,2)) AS DOUBLE) pis_cofins, CAST(l_linenumber AS VARCHAR) || ',00%' aliquota FROM lineitem""")
def item_line_parse(spark, sf):
    line = table(spark, sf, "lineitem")
    name = F.concat(F.lit("Energia "), F.translate(_text("l_partkey"), "0123456789", _LETTERS))
    row = F.concat_ws(" ", name, F.lit("kWh"), _br("l_quantity"), _br("l_discount"), _br("l_extendedprice"), _br("l_tax"), _br("l_extendedprice"), F.concat(_br("l_linenumber"), F.lit("%")), _br("l_tax"), _br("l_discount"))
    docs = line.groupBy(_text("l_orderkey").alias("id_fatura")).agg(F.concat(F.lit("FORNECIMENTO\n"), F.array_join(F.collect_list(row), "\n"), F.lit("\nITENS FINANCEIROS\nTOTAL")).alias("text"))
    found = spread(docs).select("id_fatura", F.inline(layout_a.supply_items(F.col("text"), F.lit(True))))
    return found.select("id_fatura", "item", "tipo", "unidade", "quantidade", "valor", "pis_cofins", "aliquota")


@query("""SELECT DISTINCT CAST(l_orderkey AS VARCHAR) id_fatura, 'ENERGIA ATIVA - KWH' grandeza, CASE WHEN l_linenumber % 2 = 0 THEN 'PONTA' ELSE 'FORA PONTA' END posto, CASE WHEN l_linenumber % 3 > 0 THEN l_suppkey END anterior, l_partkey atual, CAST(1 AS DOUBLE) constante, l_quantity consumo, CAST(l_suppkey + 1000000 AS VARCHAR) || '-1' medidor FROM lineitem""")
def reading_line_parse(spark, sf):
    post = F.when(F.col("l_linenumber") % 2 == 0, "PONTA").otherwise("FORA PONTA")
    before = F.when(F.col("l_linenumber") % 3 > 0, _text("l_suppkey"))
    row = F.concat_ws(" ", F.concat((F.col("l_suppkey") + 1000000).cast("string"), F.lit("-1")), F.lit("Energia Ativa - kWh"), post, before, _text("l_partkey"), F.lit("1,000000"), _br("l_quantity"))
    docs = table(spark, sf, "lineitem").groupBy(_text("l_orderkey").alias("id_fatura")).agg(F.array_join(F.collect_list(row), "\n").alias("text"))
    found = docs.select("id_fatura", F.inline(layout_a.readings(F.col("text"))))
    return found.select("id_fatura", F.col("Grandezas").alias("grandeza"), "posto", "anterior", "atual", "constante", "consumo", F.col("Medidor").alias("medidor"))


@query("""WITH o AS (SELECT CAST(o_orderkey AS VARCHAR) id_fatura, o_orderkey k, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) b, CAST(CAST((o_orderkey % 900) + 1 AS DECIMAL(9,2)) / 100 AS DOUBLE) r FROM orders)
SELECT id_fatura, 'PIS/PASEP' tributo, b base, CAST(r AS VARCHAR) || '%' aliquota, r valor FROM o UNION ALL SELECT id_fatura, 'COFINS', b, CAST(r AS VARCHAR) || '%', r FROM o
UNION ALL SELECT id_fatura, 'ICMS', CASE WHEN k % 2 = 1 THEN b END, CASE WHEN k % 2 = 1 THEN CAST(r AS VARCHAR) || '%' ELSE '0%' END, CASE WHEN k % 2 = 1 THEN r ELSE 0 END FROM o""")
def tax_line_parse(spark, sf):
    rate = _br("((o_orderkey % 900) + 1) / 100")
    row = F.concat_ws(" ", _br("o_totalprice"), F.concat(rate, F.lit("%")), rate)
    some = F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("ICMS "), row))
    docs = table(spark, sf, "orders").select(_text("o_orderkey").alias("id_fatura"), F.concat_ws("\n", F.concat(F.lit("PIS/PASEP "), row), F.concat(F.lit("COFINS "), row), some).alias("text"))
    found = spread(docs).select("id_fatura", F.inline(layout_a.taxes(F.col("text"))))
    return found.select("id_fatura", F.col("Tributo").alias("tributo"), "base", "aliquota", "valor")


@query("""SELECT 'EQUATORIAL_' || CAST(2000000000000 + o_orderkey AS VARCHAR) id_fatura, CAST(10000000 + o_custkey AS VARCHAR) id_uc, strftime(o_orderdate, '%Y-%m') competencia, strftime(o_orderdate, '%Y-%m-%d') data_emissao, strftime(o_orderdate + INTERVAL 9 DAY, '%Y-%m-%d') data_vencimento,
CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) valor_total, CAST(o_orderkey AS VARCHAR) numero_nf, CAST(o_orderkey % 31 AS INTEGER) dias, 'B3 PODER' classe FROM orders""")
def header_parse(spark, sf):
    o = table(spark, sf, "orders")
    day = lambda n: F.date_format(F.date_add(F.to_date("o_orderdate"), n), "dd/MM/yyyy")
    month = F.element_at(F.array(*map(F.lit, tx.MONTHS_SHORT)), F.month("o_orderdate"))
    text = F.concat(
        (F.col("o_custkey") + 10000000).cast("string"), F.lit(" NOTA FISCAL Nº "), _text("o_orderkey"), F.lit(" - SÉRIE 1\nDATA DE EMISSÃO: "), day(0), F.lit("\n"), month, F.lit("/"), F.year("o_orderdate").cast("string"), F.lit(" "), day(9),
        F.lit(" R$***"), _br("o_totalprice"), F.lit("\nClassificação: B3 PODER Tipo de Fornecimento: MONO\n"), day(1), F.lit(" "), day(2), F.lit(" "), (F.col("o_orderkey") % 31).cast("string"), F.lit(" "), day(3),
    )
    docs = o.select(F.concat(F.lit("/in/"), (F.col("o_orderkey") + 2000000000000).cast("string"), F.lit(".pdf")).alias("path"), text.alias("text"))
    h = layout_a.header(F.col("text"), F.col("path"), F.lit(None).cast("string"))
    return spread(docs).select(h["id_fatura"].alias("id_fatura"), h["id_uc"].alias("id_uc"), h["competencia"].alias("competencia"), h["data_emissao"].alias("data_emissao"), h["data_vencimento"].alias("data_vencimento"), h["valor_total_r$"].alias("valor_total"), h["numero_nf"].alias("numero_nf"), h["numero_dias_leitura"].alias("dias"), h["classificacao_tarifaria"].alias("classe"))


_HEAD = "DOCUMENTO AUXILIAR DA NOTA FISCAL DE ENERGIA "


@query("""WITH o AS (SELECT o_custkey, CAST(20000000000 + o_orderkey AS VARCHAR) n, count(*) OVER (PARTITION BY o_custkey) k FROM orders) SELECT CAST(o_custkey AS VARCHAR) path, CASE WHEN k > 1 THEN '20' || n END numero FROM o""")
def merged_split(spark, sf):
    body = F.concat(F.lit(f"{_HEAD} 20"), (F.col("o_orderkey") + 20000000000).cast("string"), F.lit(" fim\n"))
    docs = table(spark, sf, "orders").groupBy(_text("o_custkey").alias("path")).agg(F.array_join(F.collect_list(body), "").alias("text"))
    return sheets.split_merged(docs).select("path", "numero")


@query("""WITH o AS (SELECT o_custkey, o_orderkey % 3 g, max(length(o_orderpriority)) m FROM orders GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) k FROM o)
SELECT CAST(o_custkey AS VARCHAR) path, '20' || CAST(20000000000 + g AS VARCHAR) numero, CAST(m AS INTEGER) longest FROM c WHERE k > 1""")
def keep_longest(spark, sf):
    body = F.concat(F.lit(f"{_HEAD} 20"), (F.col("o_orderkey") % 3 + 20000000000).cast("string"), F.lit(" "), F.col("o_orderpriority"))
    docs = table(spark, sf, "orders").groupBy(_text("o_custkey").alias("path")).agg(F.array_join(F.collect_list(body), "").alias("text"))
    return sheets.split_merged(docs).where("numero is not null").select("path", "numero", (F.length("text") - len(_HEAD) - 15).alias("longest"))


@query("WITH l AS (SELECT doc_id, string_split(text, chr(10)) x FROM documents), s AS (SELECT doc_id, x, list_position(list_transform(x, lambda y: starts_with(y, 'The ')), true) p FROM l) SELECT doc_id, CAST(CASE WHEN coalesce(p, 0) > 0 THEN p - 1 ELSE len(x) END AS INTEGER) before FROM s")
def terminator_stop(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.size(cut_before(F.split("text", "\n"), lambda x: F.startswith(x, F.lit("The ")))).alias("before"))


@query("SELECT doc_id, regexp_extract_all(text, '([A-Za-z]{6,}) ', 1)[-1] w FROM documents")
def last_match(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.last(F.col("text"), "([A-Za-z]{6,}) ").alias("w"))


_NOISY = "WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity q, CAST(l_partkey % 1000 + 1 AS DOUBLE) / 100 p FROM lineitem), e AS (SELECT *, round(q * p, 2) e FROM l)"


def _noisy(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), ((F.col("l_partkey") % 1000 + 1).cast("double") / 100).alias("p")).withColumn("e", F.round(F.col("q") * F.col("p"), 2))


@query(_NOISY + """ SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN e ELSE CASE WHEN l_partkey % 4 = 1 THEN e ELSE e + 0.5 END END valor FROM e""")
def ocr_value_repair(spark, sf):
    rows = _noisy(spark, sf)
    k = F.col("l_partkey")
    printed = F.when(k % 2 == 0, F.replace(_br("e"), F.lit(","), F.lit(""))).otherwise(_br(F.col("e") + F.when(k % 4 == 1, 7.0).otherwise(0.5)))
    value = repair.item_value(F.col("q"), F.col("p"), tx.br_number(printed), printed, F.lit(None).cast("double"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", value.alias("valor"))


@query("""WITH o AS (SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,0)) AS DOUBLE) b FROM orders) SELECT o_orderkey, b base, CAST(1 AS DOUBLE) aliquota, b / 100 valor, CAST(5 AS DOUBLE) cofins_aliquota, b * 5 / 100 cofins_valor FROM o""")
def ocr_tax_repair(spark, sf):
    b = F.col("o_totalprice").cast("decimal(18,0)").cast("double")
    odd = F.col("o_orderkey") % 2 == 1
    row = repair.tax_pair((F.when(odd, b * 100).otherwise(b), F.lit(1.0), b / 100), (b, F.lit(500.0), F.when(odd, b * 5).otherwise(b * 5 / 100)))
    return table(spark, sf, "orders").select("o_orderkey", row.alias("r")).select("o_orderkey", *(F.col(f"r.{k}").alias(n) for k, n in (("pb", "base"), ("pr", "aliquota"), ("pv", "valor"), ("cr", "cofins_aliquota"), ("cv", "cofins_valor"))))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS DOUBLE) / pow(10, length(CAST(l_partkey AS VARCHAR))) ELSE CAST(l_partkey AS DOUBLE) END tarifa FROM lineitem")
def tariff_repair(spark, sf):
    token = F.when(F.col("l_partkey") % 2 == 0, F.concat(F.lit("0"), _text("l_partkey"))).otherwise(_text("l_partkey"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", repair.tariff(token, tx.br_number(token)).alias("tarifa"))


@query("SELECT p_partkey, array_to_string(list_sort(string_split(replace(p_name, ' ', ''), '')), '') letters, CASE WHEN p_partkey % 2 = 0 THEN 'ENERGIA ATIVA FORNECIDA HR' ELSE p_name END item FROM part")
def anagram_lookup(spark, sf):
    scrambled = F.when(F.col("p_partkey") % 2 == 0, F.reverse(F.lit("ENERGIA ATIVA FORNECIDA HR"))).otherwise(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", tx.sorted_letters(F.col("p_name")).alias("letters"), layout_a.unscrambled(scrambled).alias("item"))


@query("SELECT page_id, 'https://drive.google.com/drive/search?q=a%20' || CAST(page_id AS VARCHAR) || '%C3%A7/~' search, 'http://x/' || 'a ' || CAST(page_id AS VARCHAR) || 'ç/~' || '?f=' || 'a ' || CAST(page_id AS VARCHAR) || 'ç/~.pdf' templated FROM pages")
def drive_link(spark, sf):
    file = F.concat(F.lit("a "), _text("page_id"), F.lit("ç/~.pdf"))
    return table(spark, sf, "pages").select("page_id", tx.file_link(file, "search").alias("search"), tx.file_link(file, "template", "http://x/{arquivo_sem_ext}?f={arquivo}").alias("templated"))


@query("SELECT 'all_null' name UNION ALL SELECT 'blank'")
def null_columns(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", F.lit(None).cast("string").alias("all_null"), F.lit(" ").alias("blank"), F.when(F.col("o_orderkey") % 2 == 0, " ").alias("mixed"), F.lit(None).cast("string").alias("medidor"), F.lit(None).cast("string").alias("competencia")).drop("medidor")
    return spark.createDataFrame([(c,) for c in profile.null_columns(rows)], "name string")


@query('SELECT CAST(o_orderkey AS VARCHAR) "Fatura", CAST(NULL AS VARCHAR) "Nota", o_totalprice "Total" FROM orders')
def profile_apply(spark, sf):
    rows = table(spark, sf, "orders").select(_text("o_orderkey").alias("id_fatura"), F.col("o_totalprice").alias("valor_total_r$"), "o_orderstatus")
    shown = profile.SheetProfile(True, [profile.Shown("id_fatura", "Fatura"), profile.Shown("numero_nf", "Nota"), profile.Shown("o_orderstatus", "S", False), profile.Shown("valor_total_r$", "Total")])
    return profile.apply({"fatura": shown}, {"fatura": rows})["fatura"]


@query("SELECT 'Aba' categoria, 8 n UNION ALL SELECT 'Valor', 7 UNION ALL SELECT 'Conceito', 15 UNION ALL SELECT 'Item de fatura', count(*) FROM region")
def glossary_union(spark, sf):
    """The dictionary: one union of the terms of sheets, values, concepts and the given items."""
    items = table(spark, sf, "region").select(F.col("r_name").alias("item"), F.lit("A region.").alias("definition"))
    return glossary.glossary(spark, items).where("not startswith(Categoria, 'Coluna')").groupBy(F.col("Categoria").alias("categoria")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, date_trunc('hour', ts) AS start, count(*) n FROM events GROUP BY ALL")
def event_windows(spark, sf):
    from voltledger.streaming.ingest import windowed

    return windowed(table(spark, sf, "events"), "ts", "event_type", "1 hour", "1 day", n=lambda: F.count(F.lit(1)))


@query("SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, count(*) n, sum(CAST(round(value * 100) AS BIGINT)) cents FROM events GROUP BY ALL")
def stream_windows(spark, sf):
    """The same windows from a file stream: one availableNow run, each batch of which overwrites a table of all windows."""
    from uuid import uuid4

    from voltledger.streaming.ingest import scratch, windowed

    kind = table(spark, sf, "events").schema
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{sf}/event[s].parquet")  # a pattern, so that a file will do
    found = windowed(stream, "ts", "event_type", "1 hour", "1 day", n=lambda: F.count(F.lit(1)), cents=lambda: F.sum(F.round(F.col("value") * 100).cast("bigint")))
    path = f"{scratch(spark)}/windows-{uuid4().hex}"
    run = found.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/table")).option("checkpointLocation", f"{path}/state").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/table")


@query("""SELECT 'EQUATORIAL_' || CAST(2000000000000 + o_orderkey AS VARCHAR) id_fatura, CAST(10000000 + o_custkey AS VARCHAR) id_uc, count(l_orderkey) itens, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) valor FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def process_invoices(spark, sf):
    """Whole invoices of layout A, written from orders and lineitem, through the flow that extracts and enriches them."""
    from voltledger.plans import flows

    name = F.concat(F.lit("Energia "), F.translate(_text("l_partkey"), "0123456789", _LETTERS))
    row = F.concat_ws(" ", name, F.lit("kWh"), _br("l_quantity"), _br("l_discount"), _br("l_extendedprice"), _br("l_tax"), _br("l_extendedprice"), F.concat(_br("l_linenumber"), F.lit("%")), _br("l_tax"), _br("l_discount"))
    body = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(row), "\n").alias("body"))
    o = table(spark, sf, "orders").join(body, F.col("l_orderkey") == F.col("o_orderkey"))
    text = F.concat((F.col("o_custkey") + 10000000).cast("string"), F.lit(" NOTA FISCAL Nº "), _text("o_orderkey"), F.lit("\nMAR/2024 09/03/2024 R$***"), _br("o_totalprice"), F.lit("\nFORNECIMENTO\n"), "body", F.lit("\nITENS FINANCEIROS\nTOTAL\n"))
    docs = o.select(F.concat(F.lit("/in/"), (F.col("o_orderkey") + 2000000000000).cast("string"), F.lit(".pdf")).alias("path"), F.lit(layout_a.SUPPLIER).alias("fornecedor"), text.alias("text"))
    done = flows.process_texts(docs, [layout_a.SUPPLIER])
    return done.sheets["itens_fatura"].groupBy("id_fatura", "id_uc").agg(F.count(F.lit(1)).alias("itens"), F.sum(F.col("`valor_r$`").cast("decimal(18,2)")).cast("double").alias("valor"))
