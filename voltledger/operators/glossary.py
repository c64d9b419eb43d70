"""The dictionary sheet: terms with a category and a definition, as one union of small literal tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.functions.text import py_name_key

SCHEMA = "Termo string, Categoria string, `Definição` string"
SHEET = "glossario"

# Terms; the definitions are this package's own.
SHEET_TERMS = {
    "fatura": "One row per invoice: identity, dates, total, tax note, tariff class, reading dates.",
    "unidade_consumidora": "Registry of consumer units with first and last month and invoice.",
    "itens_fatura": "Line items of the invoices.",
    "impostos": "Taxes of an invoice: base, rate, value.",
    "medicao": "Meter readings by quantity and tariff post.",
    "fatura_resumida": "Short form of the invoices.",
    "medicao_resumida": "Readings of generated energy only.",
    "glossario": "This dictionary.",
}
VALUE_TERMS = {
    "FORNECIMENTO (tipo de item)": "Energy or demand that was supplied.",
    "ITENS FINANCEIROS (tipo de item)": "Charges and credits other than supply.",
    "PONTA (posto horário)": "The three hours of highest load.",
    "FORA PONTA (posto horário)": "All hours outside the peak.",
    "RESERVADO (posto horário)": "Reserved or intermediate hours.",
    "ÚNICO (posto horário)": "No distinction by hour.",
    "Competência (AAAA-MM)": "Month of reference.",
}
CONCEPT_TERMS = {
    "Bandeira Tarifária": "Monthly signal of generation cost that may add a surcharge.",
    "Tarifa de Energia (TE)": "Price of the energy itself.",
    "Tarifa de Uso do Sistema de Distribuição (TUSD)": "Price of using the grid.",
    "ICMS": "State tax on goods and services.",
    "PIS/PASEP": "Federal contribution.",
    "COFINS": "Federal contribution for social security.",
    "CIP / Iluminação Pública": "Municipal contribution for street lighting.",
    "Demanda": "Mean power over an interval, in kW.",
    "Demanda contratada": "Power that the contract makes available, in kW.",
    "kWh": "Unit of energy.",
    "Grupo A": "Supply at high voltage.",
    "Grupo B": "Supply at low voltage.",
    "Unidade Consumidora (UC)": "One metered point of supply.",
    "SCEE": "Net-metering scheme: generated energy becomes credit in kWh.",
    "UFER": "Reactive energy above the allowance.",
}


def item_terms(items: DataFrame, definitions: dict[str, str] | None = None) -> DataFrame:
    """(item, definition) of the different items; an item without a definition of its own gets a general one."""
    names = items.where(F.trim("item") != "").select(F.trim("item").alias("item")).distinct()
    own = items.sparkSession.createDataFrame(list((definitions or {}).items()), "item string, definition string")
    return names.join(own, "item", "left").select("item", F.coalesce("definition", F.lit("Item of an invoice.")).alias("definition"))


def glossary(spark: SparkSession, items: DataFrame | list[tuple[str, str]] | None = None) -> DataFrame:
    """Termo, Categoria, Definição. ``items`` adds (item, definition) rows of category 'Item de fatura'; a frame of them (``item_terms``) stays distributed."""
    columns = [(c, f"Coluna ({s})", f"Column {c} of sheet {s}, {t.simpleString()}.") for s, cs in schemas.SHEETS.items() for c, t in cs]
    parts = [
        [(k, "Aba", v) for k, v in SHEET_TERMS.items()],
        columns,
        [(k, "Valor", v) for k, v in VALUE_TERMS.items()],
        [(k, "Conceito", v) for k, v in CONCEPT_TERMS.items()],
        [(k, "Item de fatura", v) for k, v in items] if isinstance(items, list) else [],
    ]
    terms = spark.createDataFrame([r for p in parts for r in p], SCHEMA)
    if not isinstance(items, DataFrame):
        return terms
    return terms.union(items.select(F.col("item"), F.lit("Item de fatura"), F.col("definition")))


def with_glossary(sheets: dict[str, DataFrame], table: DataFrame) -> dict[str, DataFrame]:
    """The sheets and, unless one of them is a glossary already, the table."""
    return sheets if any(py_name_key(s) == SHEET for s in sheets) else {**sheets, SHEET: table}
