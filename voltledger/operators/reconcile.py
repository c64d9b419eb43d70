"""Reconciliation of taxes and totals between sheets, within a tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.schemas import quoted

TOLERANCE = 0.5
#: Items whose value is all of PIS and COFINS.
CONSOLIDATED = ("TRIBUTOS (PIS/COFINS)",)


def _zero(name: str) -> Column:
    return F.coalesce(F.col(quoted(name)), F.lit(0))


def totals(taxes: DataFrame, items: DataFrame, invoices: DataFrame) -> DataFrame:
    """id_fatura, impostos, itens_impostos, itens_valor, valor_total over the ids of all three sheets; sums start at 0, a missing total is null.

    Each side is summed before the joins, so that the joins are one to one and move one row an invoice.
    """
    a = taxes.groupBy("id_fatura").agg(F.sum(_zero("Valor (R$)")).alias("impostos"))
    tax = F.when(F.col("item").isin(*CONSOLIDATED), _zero("valor_r$")).otherwise(_zero("pis_cofins") + _zero("icms"))
    b = items.groupBy("id_fatura").agg(F.sum(tax).alias("itens_impostos"), F.sum(_zero("valor_r$")).alias("itens_valor"))
    c = invoices.groupBy("id_fatura").agg(F.max(quoted("valor_total_r$")).alias("valor_total"))
    joined = a.join(b, "id_fatura", "full").join(c, "id_fatura", "full")
    return joined.select("id_fatura", *(F.round(F.coalesce(x, F.lit(0)), 2).alias(x) for x in ("impostos", "itens_impostos", "itens_valor")), F.round("valor_total", 2).alias("valor_total"))


def tax_differences(all_totals: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Invoices whose taxes differ by more than the tolerance, largest difference first."""
    rows = all_totals.select("id_fatura", F.col("impostos").alias("aba_impostos"), F.col("itens_impostos").alias("soma_itens"), F.round(F.col("impostos") - F.col("itens_impostos"), 2).alias("diferenca"))
    return rows.where(F.abs("diferenca") > tolerance).orderBy(F.desc(F.abs("diferenca")), "id_fatura")


def total_differences(all_totals: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Invoices with a total that their items miss by more than the tolerance, largest difference first."""
    rows = all_totals.where("valor_total is not null").select("id_fatura", "valor_total", F.col("itens_valor").alias("soma_itens"), F.round(F.col("valor_total") - F.col("itens_valor"), 2).alias("diferenca"))
    return rows.where(F.abs("diferenca") > tolerance).orderBy(F.desc(F.abs("diferenca")), "id_fatura")


def summary(all_totals: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Verificacao, Total, Inconsistencias, Tolerancia: one aggregate for both checks."""
    off = lambda a, b: F.count_if(F.abs(F.col(a) - F.col(b)) > tolerance)
    one = all_totals.agg(F.count(F.lit(1)).alias("n"), off("valor_total", "itens_valor").alias("t"), off("impostos", "itens_impostos").alias("i"))
    row = lambda name, bad: F.struct(F.lit(name).alias("Verificacao"), F.col("n").alias("Total"), F.col(bad).alias("Inconsistencias"), F.lit(tolerance).alias("Tolerancia"))
    return one.select(F.inline(F.array(row("Total fatura = soma itens", "t"), row("Impostos = soma impostos itens", "i"))))
