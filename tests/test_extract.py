from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voltledger.functions import repair
from voltledger.functions import text as tx
from voltledger.operators import layout_a, layout_b, sheets

A = """ENDEREÇO DE ENTREGA: X
RUA UM
CEP: 74000000 GOIANIA GO BRASIL
FORUM DA CAPITAL
CNPJ/CPF: 02.292.266/0001-80
10605788 Consulte pela Chave
NOTA FISCAL Nº 123 - SÉRIE 7
DATA DE EMISSÃO: 05/03/2024
MAR/2024 25/03/2024 R$***1.234,56
Classificação: B3 PODER PÚBLICO Tipo de Fornecimento: TRIFÁSICO
Protocolo de autorização: 352 05/03/2024 às 10:11
01/02/2024 02/03/2024 30 01/04/2024
GERAÇÃO CICLO (2/2024) SALDO KWH: P=0,00, FP=51.271,68,
HR=1,00, SALDO A EXPIRAR 1
FORNECIMENTO Quant
CONSUMO FP kWh 1.000,00 0,50 500,00 20,00 500,00 17% 85,00 0,40
DEMANDA ISENTO DE ICMS kW 10,00 2,00 20,00 1,00 20,00 0 1,50
INJEÇÃO SCEE kWh 5,00 0,50 -2,50 -0,10 0,40
BENEFÍCIO TARIFÁRIO BRUTO SCEE 3,00
ITENS FINANCEIROS
CONTRIB. ILUM. PÚBLICA - MUNICIPAL 10,00
EMIS. SEGUNDA VIA 1,00 2,50 2,50
MULTA - 01/2024 7,00
MULTA - 01/2024 7,00
TOTAL 1.234,56
DEVOLUÇÃO DOBRO -11,11
PIS/PASEP 500,00 1,02% 5,10
COFINS 500,00 4,70% 23,50
2993839-2 ENERGIA ATIVA - KWH ÚNICO 100 200 1,000000 100,00
2993839-2 ENERGIA ATIVA - KWH ÚNICO 100 200 1,000000 100,00
2993839-2 ENERGIA GERAÇÃO - KWH ÚNICO 50 1,000000 7,00
2993839-2 ENERGIA ATIVA - KWH ÚNICO 763377 1,000000
2993839-2 DEMANDA - KW PONTA 12 1,000000
"""

B = """NOTA FISCAL Nº 96411 - SÉRIE 001
UNIDADE CONSUMIDORA:10605788
DATA DE EMISSÃO: 05/10/2023
10/2023 25/10/2023 R$ 151,47
TOTAL A PAGAR R$ 151,47
Classificação: B3 - Poder Público Modalidade X
trifásico
Itens de fatura Quant
CONSUMO kWh 100 1,00000 15147 5,00 0,90
DEMANDA w 10 2,00000 20,00 1,00 042212
ADICIONAL BANDEIRA VERMELHA 10 1,00000 10,00 0,50 0,95000
RETENCAO IRPJ 1,2% x 3,00 -3,00
CUSTEIO DE ILUMINACAO 1 8,00 8,00
COMP. FIC-MENSAL -1 4,00000 -4,00
TOTAL 151,47
PIS/PASEP 100,00 1,00 1,00
COFINS 100,00 5,00 500
701 Energia Reativa Fora ponta 10 20 1 10
701 Energia Ativa-kWh Ponta 1o 30 1 10
"""


def one(spark, extract, text, path="/in/2024000000001.pdf"):
    return extract(spark.createDataFrame([(path, text)], "path string, text string")).first()


def test_layout_a(spark):
    r = one(spark, layout_a.extract, A)
    f = r.fatura
    assert (r.id_fatura, r.id_uc, r.competencia) == ("EQUATORIAL_2024000000001", "10605788", "2024-03")
    assert (f.data_emissao, f.data_vencimento, f["valor_total_r$"], f.numero_nf, f.serie_nf, f.cfop) == ("2024-03-05", "2024-03-25", 1234.56, "123", "7", "5258")
    assert (f.classificacao_tarifaria, f.tipo_fornecimento, f.data_hora_protocolo) == ("B3 PODER PÚBLICO", "TRIFÁSICO", "2024-03-05 10:11")
    assert (f.scee_geracao_ciclo, f.scee_saldo_kwh_total, f.scee_saldo_kwh_P, f.scee_saldo_kwh_FP, f.scee_saldo_kwh_HR) == ("2024_02", None, "0,00", "51.271,68", "1,00")
    assert (f.data_leitura_anterior, f.data_leitura_atual, f.numero_dias_leitura, f.data_proxima_leitura) == ("2024-02-01", "2024-03-02", 30, "2024-04-01")
    assert (r.cliente.razao_social, r.cliente.cnpj, r.cliente.cep, r.cliente.municipio, r.cliente.uf) == ("FORUM DA CAPITAL", "02.292.266/0001-80", "74000000", "GOIANIA", "GO")
    got = [(i.item, i.tipo[:4], i.unidade, i.quantidade, i.valor, i.aliquota, i.icms, i.tarifa) for i in r.itens]
    assert got == [
        ("CONSUMO FP", "FORN", "kWh", 1000.0, 500.0, "17%", 85.0, 0.4),
        ("DEMANDA ISENTO DE ICMS", "FORN", "kW", 10.0, 20.0, "0%", None, 1.5),
        ("INJEÇÃO SCEE", "FORN", "kWh", 5.0, -2.5, None, None, 0.4),
        ("BENEFÍCIO TARIFÁRIO BRUTO SCEE", "FORN", None, None, 3.0, None, None, None),
        ("CONTRIB. ILUM. PÚBLICA - MUNICIPAL", "ITEN", None, None, 10.0, None, None, None),
        ("EMIS. SEGUNDA VIA", "ITEN", None, 1.0, 2.5, None, None, None),
        ("MULTA - 01/2024", "ITEN", None, None, 7.0, None, None, None),
        ("MULTA - 01/2024", "ITEN", None, None, 7.0, None, None, None),
        ("DEVOLUÇÃO DOBRO", "ITEN", None, None, -11.11, None, None, None),
    ]
    assert [(t.Tributo, t.base, t.aliquota, t.valor) for t in r.impostos] == [("PIS/PASEP", 500.0, "1.02%", 5.1), ("ICMS", None, "0%", 0.0), ("COFINS", 500.0, "4.7%", 23.5)]
    assert [(m.Grandezas, m.posto, m.anterior, m.atual, m.consumo) for m in r.medicao] == [
        ("ENERGIA ATIVA - KWH", "ÚNICO", 100, 200, 100.0),
        ("ENERGIA GERAÇÃO - KWH", "ÚNICO", None, 50, 7.0),
        ("DEMANDA - KW", "PONTA", None, 12, None),
    ]


def test_old_layout_items_and_allocation(spark):
    text = "Itens da Fatura\nCONSUMO - kWh 470,00 0,650560 305,76\nCIP RETROATIVA 15,88 COFINS 83,82 5,8225% 4,88\nENERGIA ATIVA FORNECIDA RH kWh 10,00 1,00 94,24 0 0 17% 0 0,4\nTOTAL 1\nPIS/PASEP 400,00 1,00% 4,00\nCOFINS 83,82 5,82% 6,00\n"
    r = one(spark, layout_a.extract, text)
    assert [(i.item, i.tipo[:4], i.quantidade, i.valor, i.pis_cofins) for i in r.itens] == [("CONSUMO", "FORN", 470.0, 305.76, 6.79), ("CIP RETROATIVA", "ITEN", None, 15.88, None), ("ENERGIA ATIVA FORNECIDA HR", "FORN", 10.0, 94.24, 2.09)]
    assert r.id_uc == f"NULO_{r.id_fatura}"


def test_layout_b(spark):
    r = one(spark, layout_b.extract, B)
    assert (r.id_fatura, r.id_uc, r.competencia, r.fatura["valor_total_r$"]) == ("CHESP_96411", "10605788", "2023-10", 151.47)
    assert (r.fatura.classificacao_tarifaria, r.fatura.tipo_fornecimento, r.fatura.data_vencimento) == ("B3 - Poder Públic", "Trifásico", "2023-10-25")  # a trailing o goes, as noise of the form
    got = [(i.item, i.unidade, i.quantidade, i.valor, i.tarifa) for i in r.itens]
    assert got == [
        ("CONSUMO", "kWh", 100.0, 100.0, 0.9),
        ("DEMANDA", "kW", 10.0, 20.0, 0.42212),
        ("ADICIONAL BANDEIRA VERMELHA", None, 10.0, 10.0, 0.95),
        ("RETENCAO IRPJ 1,2%", None, -1.0, -3.0, None),
        ("CUSTEIO DE ILUMINACAO", None, 1.0, 8.0, None),
        ("COMP. FIC-MENSAL", None, -1.0, -4.0, None),
    ]
    assert [(t.Tributo, t.base, t.aliquota, t.valor) for t in r.impostos] == [("PIS/PASEP", 100.0, "1.0%", 1.0), ("COFINS", 100.0, "5.0%", 5.0), ("ICMS", None, "0%", 0.0)]
    assert [(m.Grandezas, m.posto, m.anterior, m.atual) for m in r.medicao] == [("ENERGIA REATIVA - KWH", "FORA PONTA", 10, 20)]


def test_old_note_of_layout_b(spark):
    text = "NOTA FISCAL Nº 1\nModelo 6\nkWh Ativa F P 8.852 CONSUMO FORA DE PONTA 8852 0,32776 2.901,33\nx CUSTEIO DE ILUMINACAO PUBLICA 10,00\nCOMP. DMIC MENSAL 11/21 -276,65\nPIS 6.656,87 1,02230% 68,05\nCOFINS 6.656,87 4,7% 312,87\n"
    r = one(spark, layout_b.extract, text, "/in/CONTA OUTUBRO.2025.pdf")
    assert [(i.item, i.valor) for i in r.itens] == [("CONSUMO FORA DE PONTA", 2901.33), ("CUSTEIO DE ILUMINACAO PUBLICA", 10.0), ("COMP. DMIC MENSAL 11/21", -276.65), ("TRIBUTOS (PIS/COFINS)", 380.92)]
    assert r.competencia == "2025-10"


def test_merged_documents(spark):
    head = "DOCUMENTO AUXILIAR DA NOTA FISCAL DE ENERGIA"
    text = f"lost {head} 2024000000001 a\n{head} tail\n{head} 2024000000002 b\n{head} 2024000000001 longer text of the copy\n"
    rows = sheets.split_merged(spark.createDataFrame([("p", text), ("q", "one 2024000000009")], "path string, text string")).collect()
    got = {(r.path, r.numero): r.text for r in rows}
    assert set(got) == {("p", "2024000000001"), ("p", "2024000000002"), ("q", None)}
    assert got["p", "2024000000001"].endswith("longer text of the copy\n") or "tail" in got["p", "2024000000001"]


def test_text_functions(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert row(tx.br_number(F.lit("1.234,56"))) == 1234.56 and row(tx.br_number(F.lit("1.5"))) == 15.0
    assert row(tx.br_number(F.lit("1d"))) is None and row(tx.br_number(F.lit("Infinity"))) is None
    assert row(tx.loose_number(F.lit("1.234,56"))) is None and row(tx.loose_number(F.lit(" 1 234"))) == 1234.0
    assert row(tx.br_date(F.lit("99/88/7777"))) == "7777-88-99" and row(tx.br_date(F.lit("x"))) == "x" and row(tx.br_date(F.lit(""))) is None
    assert row(tx.text_key(F.lit("  Ação  já "))) == "ACAO JA" and row(tx.tight_key(F.lit("Ação já"))) == "ACAOJA"
    assert row(tx.month_from_name(F.lit("/x/conta MARÇO.2024 - v.pdf"))) == "2024-03"
    assert row(tx.date_days(F.lit("28/02/2024"), F.lit("01/03/2024"))) == 2 and row(tx.date_days(F.lit("31/02/2024"), F.lit("01/03/2024"))) is None
    assert row(repair.item_tax(F.lit("18245"), F.lit(18245.0), F.lit(1000.0))) == 182.45
    assert row(repair.tax_base(F.lit(712047.0), F.lit(1.0), F.lit(71.2))) == 7120.0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**9), st.integers(0, 10**7), st.integers(0, 99)), min_size=1, max_size=20))
def test_tax_rows_round_trip(spark, values):
    rows = [(str(i), b / 100, r / 100, v / 100) for i, (b, v, r) in enumerate(values)]
    df = spark.createDataFrame(rows, "path string, b double, r double, v double")
    br = lambda c: tx.format_br(F.col(c).cast("decimal(18,2)"))
    text = F.concat(*(x for t in layout_a.TAXES for x in (F.lit(f"{t} "), br("b"), F.lit(" "), br("r"), F.lit("% "), br("v"), F.lit("\n"))))
    got = {r.path: r.t for r in df.select("path", layout_a.taxes(text).alias("t")).collect()}
    for path, b, _, v in rows:
        assert [(t.base, t.valor) for t in got[path]] == [(b, v)] * 3
