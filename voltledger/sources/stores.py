"""Parameter stores as JSON files: equivalences, corrections and rules. All are small, and are read on the driver."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from voltledger.operators import rules

# The rules and corrections that come with the package, with their ids and names.
DEFAULT_RULES = [
    {
        "id": "hc_consumo_kwh_para_consumo",
        "nome": "CONSUMO KWH com quantidade atípica vira CONSUMO",
        "aba": "itens_fatura",
        "ativo": True,
        "grupos": [
            {"operador": "E", "condicoes": [{"coluna": "item", "operador": "igual", "valor": "CONSUMO KWH"}]},
            {"operador": "E", "condicoes": [{"coluna": "quantidade", "operador": "nao_esta_em", "valor": "30;50;100"}]},
        ],
        "acoes": [{"coluna": "item", "valor": "CONSUMO"}, {"coluna": "item_normalizado", "valor": "CONSUMO"}],
    },
    {
        "id": "hc_2022048615137_valor_min_faturavel",
        "nome": "EQUATORIAL_2022048615137: VALOR MIN. FATURÁVEL CUSTO DISP vira CONSUMO FP",
        "aba": "itens_fatura",
        "ativo": True,
        "grupos": [
            {
                "operador": "E",
                "condicoes": [
                    {"coluna": "id_fatura", "operador": "igual", "valor": "EQUATORIAL_2022048615137"},
                    {"coluna": "item", "operador": "igual", "valor": "VALOR MIN. FATURÁVEL CUSTO DISP"},
                ],
            },
        ],
        "acoes": [{"coluna": "item", "valor": "CONSUMO FP"}, {"coluna": "item_normalizado", "valor": "CONSUMO FP"}],
    },
    {
        "id": "hc_2025121886771_geracao_fp_zero",
        "nome": "EQUATORIAL_2025121886771: energia de geração fora ponta zerada",
        "aba": "medicao",
        "ativo": True,
        "grupos": [
            {
                "operador": "E",
                "condicoes": [
                    {"coluna": "id_fatura", "operador": "igual", "valor": "EQUATORIAL_2025121886771"},
                    {"coluna": "Grandezas", "operador": "igual", "valor": "ENERGIA GERAÇÃO - KWH"},
                    {"coluna": "Postos horarios", "operador": "igual", "valor": "FORA PONTA"},
                ],
            },
        ],
        "acoes": [{"coluna": "Consumo kWh", "valor": "0"}],
    },
    {
        "id": "hc_2025121886771_geracao_fp_zero_resumida",
        "nome": "EQUATORIAL_2025121886771: energia de geração fora ponta zerada (medicao_resumida)",
        "aba": "medicao_resumida",
        "ativo": True,
        "grupos": [
            {
                "operador": "E",
                "condicoes": [
                    {"coluna": "id_fatura", "operador": "igual", "valor": "EQUATORIAL_2025121886771"},
                    {"coluna": "Grandezas", "operador": "igual", "valor": "ENERGIA GERAÇÃO - KWH"},
                    {"coluna": "Postos horarios", "operador": "igual", "valor": "FORA PONTA"},
                ],
            },
        ],
        "acoes": [{"coluna": "energia_geracao_kwh", "valor": "0"}],
    },
]
ITEM_CORRECTIONS = [
    ("CHESP_280861", "DEMANDA W", "DEMANDA"),
    ("CHESP_280893", "DEMANDA W", "DEMANDA"),
    ("CHESP_280893", "CONSUMO REATIVO FORA DE PONTA KWH", "CONSUMO REATIVO FORA DE PONTA"),
    ("CHESP_403297", "CONSUMO REATIVO FORA DE PONTA KWH", "CONSUMO REATIVO FORA DE PONTA"),
    ("CHESP_1873270", "CONSUMO REATIVO FORA DE PONTA KWH", "CONSUMO REATIVO FORA DE PONTA"),
    ("EQUATORIAL_2022009120086", "A KW DC H BAND. VERMELHA INJET. FP TE -", "ADC BAND. VERMELHA INJET. FP TE -"),
    ("EQUATORIAL_2022009120086", "A KW DC H BAND. VERMELHA INJET. HR TE -", "ADC BAND. VERMELHA INJET. HR TE -"),
    ("EQUATORIAL_2022008082728", "A KW DC H BAND. VERMELHA INJET. FP TE -", "ADC BAND. VERMELHA INJET. FP TE -"),
    ("EQUATORIAL_2023010466908", "EV. FAT. A MAIOR - CRÉDITO DE CONSUMO", "JUROS DEV. FAT. A MAIOR - CRÉDITO DE CONSUMO - 11/2022"),
    ("EQUATORIAL_2023010466908", "ATUAL. MONET. IPCA - CRÉDITO DE CONSUMO", "ATUAL. MONET. IPCA - CRÉDITO DE CONSUMO - 11/2022"),
]
READING_CORRECTIONS = [("EQUATORIAL_2022023394288", "ENERGIA ATIVA - KWH", "ÚNICO", 0, 100, 0.375, 0.0)]
_EQUIVALENCE = "pos bigint, item string, item_normalizado string"


def load_equivalences(spark: SparkSession, path: str | Path) -> DataFrame:
    """pos, item, item_normalizado; a missing or broken file is an empty table."""
    try:
        rows = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        rows = []
    return spark.createDataFrame([(i, str(r.get("item") or ""), str(r.get("item_normalizado") or "")) for i, r in enumerate(rows) if isinstance(r, dict)], _EQUIVALENCE)


def save_equivalences(rows: list[tuple[str, str]], path: str | Path) -> None:
    """Rows without an item go; of items equal but for case the first stays."""
    seen: dict[str, tuple[str, str]] = {}
    for item, target in rows:
        if item.strip():
            seen.setdefault(item.strip().upper(), (item.strip(), target.strip()))
    Path(path).write_text(json.dumps([{"item": a, "item_normalizado": b} for a, b in seen.values()], ensure_ascii=False, indent=1), "utf-8")


def load_rules(path: str | Path) -> list[rules.Rule]:
    """The first run writes the default rules; an empty list is respected; a broken file has no rules."""
    path = Path(path)
    if not path.exists():
        found = rules.parse(DEFAULT_RULES)
        path.write_text(rules.dump(found), "utf-8")
        return found
    try:
        data = json.loads(path.read_text("utf-8"))
    except ValueError:
        return []
    return rules.parse(data) if isinstance(data, list) else []


def item_corrections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ITEM_CORRECTIONS, "id_fatura string, item_estranho string, item_correto string")


def reading_corrections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(READING_CORRECTIONS, "id_fatura string, Grandezas string, `Postos horarios` string, `Leitura Anterior` bigint, `Leitura Atual` bigint, `Const Medidor` double, `Consumo kWh` double")
