"""Tables of the engine: canonical columns and types, keys, and conforming a frame to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, I, L = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()

# Names, order and types of the canonical columns.
_FATURA = [
    ("id_fatura", S), ("numero_fatura", S), ("arquivo_pdf", S), ("link_pdf", S), ("fornecedor", S), ("id_uc", S), ("id_uc_atual", S), ("medidor", S),
    ("data_emissao", S), ("competencia", S), ("data_vencimento", S), ("valor_total_r$", D), ("numero_nf", S), ("serie_nf", S), ("cfop", S),
    ("chave_acesso_nfe", S), ("protocolo_autorizacao", S), ("data_hora_protocolo", S), ("classificacao_tarifaria", S), ("tipo_fornecimento", S),
    ("tensao_nominal_v", S), ("tensao_min_v", S), ("tensao_max_v", S), ("demanda_contratada_kw", D), ("demanda_geracao_contratada_kw", D),
    ("perdas_transformacao_pct", D), ("scee_geracao_ciclo", S), ("scee_saldo_kwh_total", S), ("scee_saldo_kwh_P", S), ("scee_saldo_kwh_FP", S),
    ("scee_saldo_kwh_HR", S), ("data_leitura_anterior", S), ("data_leitura_atual", S), ("numero_dias_leitura", I), ("data_proxima_leitura", S),
]
_UC = [
    ("id_uc", S), ("id_uc_sem_format", S), ("id_uc_atual_medidor", S), ("id_uc_atual_medidor_sem_format", S), ("razao_social", S), ("cnpj", S),
    ("cep", S), ("municipio", S), ("uf", S), ("primeira_competencia", S), ("ultima_competencia", S), ("primeira_fatura", S), ("ultima_fatura", S),
]
_ITEM = [
    ("id_fatura", S), ("id_uc", S), ("id_uc_atual", S), ("competencia", S), ("item", S), ("item_normalizado", S), ("tipo", S), ("unidade", S),
    ("quantidade", D), ("preco_unitario_com_tributos_r$", D), ("valor_r$", D), ("pis_cofins", D), ("base_calc_icms_r$", D),
    ("aliquota_icms_r$", S), ("icms", D), ("tarifa_unitaria_r$", D),
]
_TAX = [("id_fatura", S), ("id_uc", S), ("id_uc_atual", S), ("competencia", S), ("Tributo", S), ("Base (R$)", D), ("Aliquota (%)", S), ("Valor (R$)", D)]
_READING = [
    ("id_fatura", S), ("id_uc", S), ("id_uc_atual", S), ("competencia", S), ("Grandezas", S), ("Postos horarios", S), ("Leitura Anterior", L),
    ("Leitura Atual", L), ("Const Medidor", D), ("Consumo kWh", D), ("Medidor", S),
]
_SHORT = {
    "id_fatura", "numero_fatura", "id_uc", "id_uc_atual", "medidor", "competencia", "valor_total_r$", "classificacao_tarifaria", "tipo_fornecimento",
    "demanda_contratada_kw", "demanda_geracao_contratada_kw", "scee_geracao_ciclo", "scee_saldo_kwh_total", "scee_saldo_kwh_P", "scee_saldo_kwh_FP",
    "scee_saldo_kwh_HR", "numero_dias_leitura",
}
GENERATION_READING, GENERATION_COLUMN = "ENERGIA GERAÇÃO - KWH", "energia_geracao_kwh"

SHEETS = {
    "fatura_resumida": [c for c in _FATURA if c[0] in _SHORT],
    "fatura": _FATURA,
    "unidade_consumidora": _UC,
    "itens_fatura": _ITEM,
    "impostos": _TAX,
    "medicao": _READING,
    "medicao_resumida": [(GENERATION_COLUMN if n == "Consumo kWh" else n, t) for n, t in _READING],
}
BASE_SHEETS = ("fatura", "unidade_consumidora", "itens_fatura", "impostos", "medicao")
DERIVED_SHEETS = ("fatura_resumida", "medicao_resumida")
#: Columns that enrichment computes; they never decide whether two rows are the same.
DERIVED_COLUMNS = (
    "medidor", "id_uc_atual", "id_uc_sem_format", "id_uc_atual_medidor", "id_uc_atual_medidor_sem_format", "item_normalizado",
    "primeira_competencia", "ultima_competencia", "primeira_fatura", "ultima_fatura", "link_pdf",
)
DEDUP_KEYS = {"fatura": ["id_fatura"], "unidade_consumidora": ["id_uc"], "impostos": ["id_fatura", "Tributo"], "fatura_resumida": ["id_fatura"]}
FULL_ROW = {"itens_fatura", "medicao", "medicao_resumida"}
#: Columns that stay in a display profile even if they have no value.
PROTECTED = {
    "id_fatura", "numero_fatura", "arquivo_pdf", "fornecedor", "id_uc", "id_uc_sem_format", "id_uc_atual_medidor", "id_uc_atual_medidor_sem_format",
    "id_uc_atual", "item_normalizado", "competencia", "demanda_contratada_kw", "demanda_geracao_contratada_kw", "scee_geracao_ciclo",
    "scee_saldo_kwh_total", "scee_saldo_kwh_P", "scee_saldo_kwh_FP", "scee_saldo_kwh_HR", "energia_geracao_kwh",
}
ALIASES = {"fatura": {"link": "link_pdf", "urlpdf": "link_pdf", "url": "link_pdf"}}


def columns(sheet: str) -> list[str]:
    return [n for n, _ in SHEETS.get(sheet, [])]


def schema(sheet: str) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in SHEETS[sheet]])


def quoted(name: str) -> str:
    """A column name for F.col, whatever it contains."""
    return "`" + name.replace("`", "``") + "`"


def conform(df: DataFrame, sheet: str, fill: bool = True) -> DataFrame:
    """Canonical columns first and in order, cast to their types, missing ones null (if ``fill``), extras last."""
    have = set(df.columns)
    known = [(F.col(quoted(n)) if n in have else F.lit(None)).cast(t).alias(n) for n, t in SHEETS[sheet] if fill or n in have]
    return df.select(*known, *(F.col(quoted(c)) for c in df.columns if c not in columns(sheet)))
