"""From extracted documents to sheets; splitting of merged documents; batch-level filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.functions.text import last
from voltledger.schemas import conform, quoted

# The number of an invoice, the start of an invoice in a merged text, and items that are information only.
NUMBER_13 = r"(?<![\d.])(20\d{11})(?![\d.])"
ANCHOR = "(?i)DOCUMENTO AUXILIAR DA NOTA FISCAL DE ENERGIA"
INFORMATIVE = "(?i)DEMO"

Sheets = dict[str, DataFrame]


def split_merged(docs: DataFrame) -> DataFrame:
    """path, text, numero: one row per invoice of a text that holds several; other texts stay whole (numero null).

    A text counts as merged if it has two different invoice numbers and two anchors. It is cut at the anchors; what stands before the first one
    is lost. A segment without a number belongs to the last one that has a number; of a number's segments the longest stays, the first of equals.
    Everything happens inside the document's row.
    """
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(NUMBER_13), F.lit(1)))
    parts = F.split("text", f"(?={ANCHOR})")
    segments = F.filter(parts, lambda p: p.rlike(f"^{ANCHOR}"))
    merged = F.col("text").rlike(ANCHOR) & (F.size(numbers) > 1) & (F.size(segments) > 1)
    kind = "array<struct<numero:string,text:string>>"

    def join(acc: Column, s: Column) -> Column:
        number = last(s, NUMBER_13)
        new = F.array(F.struct(number.alias("numero"), s.alias("text")))
        top = F.try_element_at(acc, F.lit(-1))
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(top["numero"].alias("numero"), F.concat(top["text"], s).alias("text"))))
        return F.when(number.isNotNull(), F.concat(acc, new)).when(F.size(acc) > 0, longer).otherwise(acc)

    joined = F.aggregate(segments, F.array().cast(kind), join)
    best = lambda all_: F.filter(all_, lambda x, i: ~F.exists(F.transform(all_, lambda y, j: F.struct(y.alias("y"), j.alias("j"))), lambda z: (z["y"]["numero"] == x["numero"]) & ((F.length(z["y"]["text"]) > F.length(x["text"])) | ((F.length(z["y"]["text"]) == F.length(x["text"])) & (z["j"] < i)))))
    rest = [c for c in docs.columns if c not in ("path", "text")]
    rows = docs.select(*rest, "path", "text", F.when(merged, joined).alias("parts"))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("numero"), F.col("text").alias("text")))
    return rows.select(*rest, "path", F.posexplode(F.coalesce(best(F.col("parts")), whole)).alias("segment", "p")).select(*rest, "path", "segment", "p.text", "p.numero")


def readable(extracted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(invoices that count, error rows): an invoice with a total but no item beside informative ones is illegible."""
    useful = F.size(F.filter("itens", lambda i: ~F.coalesce(i["item"], F.lit("")).rlike(INFORMATIVE)))
    bad = F.coalesce((F.col("fatura")["valor_total_r$"] > 0) & (useful == 0), F.lit(False))
    return extracted.where(~bad), extracted.where(bad).select("path", "id_fatura", F.lit("total without items").alias("error"))


def first_wins(extracted: DataFrame, order: list[str]) -> DataFrame:
    """One result per invoice id, the first in order; a null id is never a duplicate."""
    named = extracted.where("id_fatura is not null")
    ranked = named.withColumn("__n", F.row_number().over(W.partitionBy("id_fatura").orderBy(*order))).where("__n = 1").drop("__n")
    return ranked.unionByName(extracted.where("id_fatura is null"))


def explode_sheets(extracted: DataFrame) -> Sheets:
    """The five base sheets. Informative items are left out; unit and month are stamped on every row."""
    stamp = [F.col("id_fatura"), F.col("id_uc"), F.col("competencia")]
    fatura = extracted.select("fatura.*", F.col("id_uc").alias("__uc")).withColumn("id_uc", F.col("__uc")).drop("__uc")
    items = extracted.select(*stamp, F.inline("itens")).where(~F.coalesce("item", F.lit("")).rlike(INFORMATIVE))
    items = items.withColumnsRenamed({"preco": "preco_unitario_com_tributos_r$", "valor": "valor_r$", "base": "base_calc_icms_r$", "aliquota": "aliquota_icms_r$", "tarifa": "tarifa_unitaria_r$"})
    tax = extracted.select(*stamp, F.inline("impostos")).withColumnsRenamed({"base": "Base (R$)", "aliquota": "Aliquota (%)", "valor": "Valor (R$)"})
    read = extracted.select(*stamp, F.inline("medicao")).withColumnsRenamed({"posto": "Postos horarios", "anterior": "Leitura Anterior", "atual": "Leitura Atual", "constante": "Const Medidor", "consumo": "Consumo kWh"})
    found = {"fatura": fatura, "unidade_consumidora": extracted.select("id_uc", "cliente.*"), "itens_fatura": items, "impostos": tax, "medicao": read}
    return {k: conform(v, k, fill=False) for k, v in found.items()}


def generation_readings(readings: DataFrame) -> DataFrame:
    """Readings of generated energy, consumption renamed."""
    is_generation = F.trim(F.col("Grandezas")).rlike(r"(?iu)^ENERGIA\s+GERA[ÇC][ÃA]O\s*-\s*KWH$")
    return readings.where(is_generation).withColumnRenamed("Consumo kWh", schemas.GENERATION_COLUMN)


def with_derived(sheets: Sheets) -> Sheets:
    """All sheets in output order: the base ones and the two derived ones."""
    short = [c for c in schemas.columns("fatura_resumida") if c in sheets["fatura"].columns]
    every = {**sheets, "fatura_resumida": sheets["fatura"].select(*map(quoted, short)), "medicao_resumida": generation_readings(sheets["medicao"])}
    return {k: every[k] for k in schemas.SHEETS if k in every}
