"""Shapes shared by both invoice layouts: rows as structs inside a document's row, so that extraction needs no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltledger.functions.text import br_number

ITEM = "struct<item:string,tipo:string,unidade:string,quantidade:double,preco:double,valor:double,pis_cofins:double,base:double,aliquota:string,icms:double,tarifa:double>"
TAX = "struct<Tributo:string,base:double,aliquota:string,valor:double>"
READING = "struct<Grandezas:string,posto:string,anterior:bigint,atual:bigint,constante:double,consumo:double,Medidor:string>"
SUPPLY, FINANCIAL = "FORNECIMENTO", "ITENS FINANCEIROS"


def item(name: Column, kind: str | Column, unidade=None, quantidade=None, preco=None, valor=None, pis_cofins=None, base=None, aliquota=None, icms=None, tarifa=None) -> Column:
    values = dict(item=name, tipo=F.lit(kind) if isinstance(kind, str) else kind, unidade=unidade, quantidade=quantidade, preco=preco, valor=valor, pis_cofins=pis_cofins, base=base, aliquota=aliquota, icms=icms, tarifa=tarifa)
    return F.struct(*((F.lit(None) if v is None else v).alias(k) for k, v in values.items())).cast(ITEM)


def none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def num(parts: Column, i: int) -> Column:
    """The i-th group (from 1) as a Brazilian number."""
    return br_number(parts[i - 1])


def plain_num(parts: Column, i: int) -> Column:
    """``num`` of a group that its pattern keeps to digits, points, commas and a sign."""
    return F.replace(F.replace(parts[i - 1], F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def upper_name(c: Column) -> Column:
    """Trimmed, without a trailing hyphen, upper case."""
    return F.upper(F.regexp_replace(F.trim(c), r"\s*-\s*$", ""))


def integer(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "").try_cast("bigint")


def rate(value: Column) -> Column:
    """A number as text with a percent sign."""
    return F.concat(value.cast("string"), F.lit("%"))


def cut_before(array: Column, stop) -> Column:
    """The elements before the first one that satisfies ``stop``."""
    n = F.size(array)
    at = F.array_min(F.filter(F.transform(array, lambda x, i: F.when(stop(x), i)), lambda i: i.isNotNull()))
    return F.slice(array, 1, F.coalesce(at, n))
