"""Extraction from invoices of layout B (utility 2), often recognised from images: tolerant patterns and repaired numbers.

Same shape in and out as ``layout_a.extract``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.functions import repair
from voltledger.functions.text import all_groups, br_date, br_number, cut_right, date_days, file_name, file_stem, first, groups, last, let, month_from_name, shapes
from voltledger.operators.items import FINANCIAL, READING, SUPPLY, TAX, integer, item, num, rate

SUPPLIER = "CHESP"

# ---- Fixed values: patterns of the layout ------------------------------------------------------------------------------------------------
_DATE = r"\d{2}/\d{2}/\d{4}"
UNIT = (
    r"(?iud)UNIDADE CONSUMIDORA[:\s]{0,2}(\d{5,})",
    r"(?d)\b\d{2}/\d{4}\b[^\d\n]{0,4}(\d{6,10})[^\d\n]{0,6}905",
    r"(?d)\d{2}/\d{4}\s+(\d{5,})\s+905\s*-",
    r"(?iusd)UNIDADE CONSUMIDORA.{0,120}?(?<!\d)(\d{8,10})(?!\d)",
)
NOTE_NUMBER = r"(?iusd)NOTA FISCAL N[ºo°]\s+(\d+)"
FILE_NUMBER = r"(?iud)FATURA\s*N[ºo°]?\s*(\d+)"
MONTH = (rf"(?d)(\d{{2}})/(\d{{4}})\s+{_DATE}\s+R\$", r"(?d)(\d{2})/(\d{4})\s+\d{5,}\s+905\s*-\s*EMAIL", r"(?d)REF:[^\n]*\n(\d{2})/(\d{4})")
DUE = (rf"(?d)\d{{2}}/\d{{4}}\s+({_DATE})\s+R\$", rf"(?iusd)TOTAL A PAGAR[\s\S]{{0,160}}?({_DATE})\s+[\d.]+,\d{{2}}")
TOTAL = (r"(?iusd)TOTAL A PAGAR\s*R?\$?\s*([\d.]+,\d{2})", r"(?d)R\$([\d.]+,\d{2})", rf"(?iusd)TOTAL A PAGAR[\s\S]{{0,160}}?{_DATE}\s+([\d.]+,\d{{2}})")
KEY_NEAR, KEY_BLOCKS = r"(?iud)(?:chave de acesso)[^\n]*\n?\s*([\d\s]{44,60})", r"(?d)(\d{4}(?:\s+\d{4}){10})"
CLASS = (
    r"(?iusd)Classifica[çc][ãa]o:\s*([AB]\d[^\n]*?)(?:Tipo de|Modalidade)",
    r"(?iudm)CLASSIFICA[ÇC][ÃA]O:\s*([AB]\d\s*-\s*.+?)\s+[\d.,]+\s*$",
    r"(?iud)Classifica[çc][ãa]o:\s*([AB]\d[^\n]{0,45})",
)
IS_A4 = r"(?iudm)^\s*DEMANDA\s+kW[Ww]?\b|Hor[áa]ria\s+Verde"
IS_B3 = r"(?iusd)Modalidade.*?Convencional"
CLASS_A4, CLASS_B3 = "A4 - Poder Público - Poder Público Estad", "B3 - Poder Público - Poder Público Estadual"
DEMAND = (r"(?iud)Demanda fora ponta-kW\s+([\d.,]+)", r"(?iudm)^DEMANDA\s+kW\s+([\d.,]+)")
READ_DATES = rf"(?d)({_DATE})\s+({_DATE})\s+(\d{{1,3}})\s+({_DATE})"
READ_COLUMNS = rf"(?iud)ANTERIOR\s+ATUAL\s+PR[ÓO]XIMA\s+EMISS[ÃA]O\s+APRESENTA[ÇC][ÃA]O[^\n]*\n\s*({_DATE})\s+({_DATE})\s+({_DATE})"
OWNER = r"(?iusd)(GOIAS TRIBUNAL DE JUSTICA DO ESTADO DE GOIAS)"
PLACE = r"(?d)/\s*([^/\n]+?)\s*-\s*GO\b"
POSTCODE = r"(?d)CEP:?\s*(\d{2})\s*(\d{3})[-\s]?(\d{3})"
OWNER_POSTCODE = r"(?iusd)TRIBUNAL DE JUSTICA.+?CEP:?\s*(\d{2})\s*(\d{3})[-\s]?(\d{3})"
RIGHT_NEIGHBOURS = (
    r"(?iud)\s+(?:PIS/PASEP|PISIPASEP|COFINS|cus(?:tos?)?|ICMS|icms)\b.*$",
    r"(?iud)\s+\"?GRANDEZAS CONTRATADAS.*$",
    r"(?d)\s+[A-Z]{2,}\s+[A-Z\s]+\d+\s*$",
)
BLOCK = r"(?iusdm)(Itens de fatura.+?\n.+?^TOTAL\b)"
BLOCK_BARE = r"(?sd)(\nCONSUMO.+?\nTOTAL\b)"
SKIP_LINE = r"(?iud)^(TOTAL|VALOR BRUTO|Itens de|Tributo|Medidor|PIS|COF|ICM)"
_M = r"([\d.,]+)"
UNIT_ITEM = rf"(?iud)^(.+?)\s+(kWwh|kWh|kwh|kWw|kW|kw|kVArh|kvarh|w)\s+([\d.,]+|[a-zº])\s+{_M}\s+{_M}\s+{_M}\s+{_M}"
FLAG_ITEM = rf"(?iud)^(ADICIONAL BANDEIRA[^\d]+?)\s+{_M}\s+{_M}\s+{_M}\s+{_M}\s+{_M}"
WITHHELD_ITEM = rf"(?iud)^(RETENCAO IRPJ[^\n]+?%)\s+\S+\s+{_M}\s+(-[\d.,]+)"
LIGHTING_ITEM = rf"(?iud)^(CUSTEIO[^\d]+?)\s+\d+\s+{_M}\s+{_M}"
COUNTED_ITEM = rf"(?d)^([A-ZÀ-ÿ][A-Za-zÀ-ÿ0-9 ./%\-]{{3,}}?)\s+(-?\d+)\s+{_M}\s+(-?\d[\d.]*,\d{{2}})\b"
OLD_NOTE = r"(?iud)Modelo\s*6"
OLD_SUPPLY = r"(?dm)(?:^|\s)([A-ZÀ-Ü][A-ZÀ-Ü ]{3,}?)\s+(\d+)\s+(\d+,\d{3,})\s+([\d.]+,\d{2})\s*$"
OLD_LIGHTING = r"(?dm)(CUSTEIO DE ILUMINACAO PUBLIC[A-Z ]*?)\s+([\d.]+,\d{2})\s*$"
OLD_CREDIT = r"(?dm)(?:^|\s)([A-ZÀ-Ü][A-ZÀ-Ü ./]{3,}?(?:\s+\d{1,2}/\d{2,4})?)\s+(-\d[\d.]*,\d{2})\s*$"
OLD_NOT_ITEM = r"^(TOTAL|LIMITE|VENCIMENTO)"
OLD_PIS = r"(?d)\bPIS(?:\s*/?\s*PASEP)?\s+[\d.]+,\d{2}\s+[\d.,]+%?\s+([\d.]+,\d{2})"
OLD_COFINS = r"(?d)\bCOFINS\s+[\d.]+,\d{2}\s+[\d.,]+%?\s+([\d.]+,\d{2})"
OLD_TAXES = r"(?d)TRIBUTOS:\s*([\d.]+,\d{2})"
CONSOLIDATED = "TRIBUTOS (PIS/COFINS)"
_SEP = r"\s*[%/\-–—]?\s+"
TAX_LABELS = {"PIS/PASEP": r"(?:PIS\s*/?\s*I?PASEP|PIS\b)", "COFINS": "COFINS", "ICMS": "ICMS"}
ZEROS = (r"(?iud)\(o\)", r"(?iud)\[o\]", r"(?ud)(?<![\p{L}\d_])º(?![\p{L}\d_])", r"(?iud)\b[jf]o\]\b")
READING_ROW = rf"(?iudm)^(\d+)\s+(Energia Ativa-kWh|Energia Reativa|Demanda-kW|Demanda Reativa|Demanda kW)\s+(Ponta|Fora Ponta|Fora\s*[Pp]onta|Reservado|Unico|Único)\s+{_M}\s+{_M}\s+(\d+)\s+{_M}"
# ------------------------------------------------------------------------------------------------------------------------------------------


def header(text: Column, path: Column) -> dict[str, Column]:
    name = file_name(path)
    number = F.coalesce(first(text, NOTE_NUMBER), first(name, FILE_NUMBER), file_stem(name))
    read, columns = groups(text, READ_DATES, 4), groups(text, READ_COLUMNS, 3)
    now = br_date(F.coalesce(read[1], columns[1]))
    printed = [F.concat(first(text, p, 2), F.lit("-"), first(text, p)) for p in MONTH]
    month = F.coalesce(*printed, month_from_name(path), F.substring(now, 1, 7))
    values = [F.nullif(first(text, p), F.lit("")) for p in TOTAL]
    near = F.substring(F.regexp_replace(first(text, KEY_NEAR), r"\s", ""), 1, 44)
    key = F.when(F.length(near) == 44, near).otherwise(F.coalesce(F.regexp_replace(first(text, KEY_BLOCKS), r"\s", ""), near))
    given = F.coalesce(*(F.nullif(first(text, p), F.lit("")) for p in CLASS))
    tidy = F.regexp_replace(F.trim(F.regexp_replace(given, r"\s+", " ")), "[ o]+$", "")
    inferred = F.when(text.rlike(IS_A4), CLASS_A4).when(text.rlike(IS_B3), CLASS_B3)
    stamp = r"(?d)Protocolo[^\n]+?(\d{2}/\d{2}/\d{4})\s+[àa]s\s+(\d{2}:\d{2})"
    nothing = F.lit(None).cast("string")
    return {
        "id_fatura": F.concat(F.lit(f"{SUPPLIER}_"), number),
        "numero_fatura": number,
        "arquivo_pdf": name,
        "fornecedor": F.lit(SUPPLIER),
        "id_uc": F.coalesce(*(first(text, p) for p in UNIT)),
        "data_emissao": br_date(first(text, rf"(?iusd)DATA DE\s*EMISS[ÃA]O:\s*({_DATE})")),
        "competencia": month,
        "data_vencimento": F.coalesce(br_date(first(text, DUE[0])), F.when(values[0].isNull() & values[1].isNull(), br_date(first(text, DUE[1])))),
        "valor_total_r$": br_number(F.coalesce(*values)),
        "numero_nf": first(text, NOTE_NUMBER),
        "serie_nf": F.coalesce(first(text, r"(?iusd)NOTA FISCAL[^-]+-\s*S[ÉE]RIE\s+(\d+)"), F.lit("000")),
        "cfop": nothing,
        "chave_acesso_nfe": key,
        "protocolo_autorizacao": first(text, r"(?iusd)Protocolo de autoriza[çc][ãa]o:\s*(\d+)"),
        "data_hora_protocolo": F.concat(br_date(first(text, stamp)), F.lit(" "), first(text, stamp, 2)),
        "classificacao_tarifaria": F.when(given.isNotNull(), tidy).otherwise(inferred),
        "tipo_fornecimento": F.coalesce(F.initcap(first(text, r"(?iud)\b(Trif[áa]sico|Bif[áa]sico|Monof[áa]sico)\b")), F.lit("Trifásico")),
        "tensao_nominal_v": nothing,
        "tensao_min_v": nothing,
        "tensao_max_v": nothing,
        "demanda_contratada_kw": F.when(first(text, DEMAND[0]).isNull() & first(text, DEMAND[1]).isNull(), 0.0).otherwise(br_number(F.coalesce(*(first(text, p) for p in DEMAND)))),
        "demanda_geracao_contratada_kw": F.lit(None).cast("double"),
        "perdas_transformacao_pct": F.lit(None).cast("double"),
        **{f"scee_{k}": nothing for k in ("geracao_ciclo", "saldo_kwh_total", "saldo_kwh_P", "saldo_kwh_FP", "saldo_kwh_HR")},
        "data_leitura_anterior": br_date(F.coalesce(read[0], columns[0])),
        "data_leitura_atual": now,
        "numero_dias_leitura": F.coalesce(read[2].try_cast("int"), F.when(read.isNull(), date_days(columns[0], columns[1]))),
        "data_proxima_leitura": br_date(F.coalesce(read[3], columns[2])),
    }


def customer(text: Column) -> dict[str, Column]:
    codes = F.transform(all_groups(text, POSTCODE, 3), lambda g: F.array_join(g, ""))
    near = F.array_join(groups(text, OWNER_POSTCODE, 3), "")
    return {"razao_social": first(text, OWNER), "cnpj": first(text, r"(?iusd)CPF/CNPJ:?\s*([\d./-]+)"), "cep": F.coalesce(near, F.try_element_at(codes, F.lit(2)), F.try_element_at(codes, F.lit(1))), "municipio": F.upper(last(text, PLACE)), "uf": F.lit("GO")}


def _name(c: Column) -> Column:
    return F.upper(F.trim(c))


def table_items(lines: Column, in_block: Column) -> Column:
    """Line items by shape: with unit, flag surcharge, withholding, lighting, and inside the block any counted item."""

    def repaired(g: Column, k: int, unit: Column | None) -> Column:
        """k: the group of the quantity."""
        quantity = F.when(g[k - 1].rlike(r"^[\d.,]"), num(g, k))
        read = F.struct(quantity.alias("q"), num(g, k + 1).alias("p"), num(g, k + 2).alias("v"), repair.tariff(g[k + 3], num(g, k + 4)).alias("t"))

        def row(x: Column) -> Column:
            value = repair.item_value(x["q"], x["p"], x["v"], g[k + 1], x["t"])
            return let(value, lambda v: item(_name(g[0]), SUPPLY, unit, x["q"], x["p"], v, repair.item_tax(g[k + 2], num(g, k + 3), v), tarifa=x["t"]))

        return let(read, row)

    def of_line(line: Column) -> Column:
        fixed = shapes(
            line,
            (UNIT_ITEM, 7, lambda g: repaired(g, 3, repair.unit(g[1]))),
            (FLAG_ITEM, 6, lambda g: repaired(g, 2, None)),
            (WITHHELD_ITEM, 3, lambda g: item(_name(g[0]), FINANCIAL, None, F.lit(-1.0), num(g, 2), num(g, 3))),
            (LIGHTING_ITEM, 3, lambda g: item(_name(g[0]), FINANCIAL, None, F.lit(1.0), num(g, 2), num(g, 3))),
        )
        return F.coalesce(fixed, F.when(in_block, shapes(line, (COUNTED_ITEM, 4, lambda g: item(_name(g[0]), FINANCIAL, None, num(g, 2), num(g, 3), num(g, 4))))))

    clean = F.transform(lines, lambda x: F.trim(cut_right(x, RIGHT_NEIGHBOURS)))
    return F.filter(F.transform(F.filter(clean, lambda x: (x != "") & ~x.rlike(SKIP_LINE)), of_line), lambda x: x.isNotNull())


def old_items(text: Column) -> Column:
    """The old note: items at line ends, lighting, negative credits, and the taxes as one item."""
    usable = lambda g: ~F.trim(g[0]).rlike(OLD_NOT_ITEM)
    supply = F.transform(F.filter(all_groups(text, OLD_SUPPLY, 4), usable), lambda g: item(F.trim(g[0]), SUPPLY, None, num(g, 2), num(g, 3), num(g, 4)))
    credit = F.transform(F.filter(all_groups(text, OLD_CREDIT, 2), usable), lambda g: item(F.trim(g[0]), FINANCIAL, valor=num(g, 2)))
    light = shapes(text, (OLD_LIGHTING, 2, lambda g: item(F.trim(g[0]), FINANCIAL, None, F.lit(1.0), None, num(g, 2))))
    pis, cofins = br_number(first(text, OLD_PIS)), br_number(first(text, OLD_COFINS))
    due = F.when(first(text, OLD_PIS).isNotNull() & first(text, OLD_COFINS).isNotNull(), F.round(F.coalesce(pis, F.lit(0.0)) + F.coalesce(cofins, F.lit(0.0)), 2)).otherwise(br_number(first(text, OLD_TAXES)))
    tax = let(due, lambda v: F.when(v.isNotNull(), item(F.lit(CONSOLIDATED), FINANCIAL, valor=v)))
    return F.concat(supply, F.array_compact(F.array(light)), credit, F.array_compact(F.array(tax)))


def items(text: Column) -> Column:
    blocks = F.struct(first(text, BLOCK).alias("full"), first(text, BLOCK_BARE).alias("bare"))

    def found(x: Column) -> Column:
        lines = F.split(F.coalesce(x["full"], x["bare"], text), "\n")
        return F.when(x["full"].isNull() & text.rlike(OLD_NOTE), old_items(text)).otherwise(table_items(lines, x["full"].isNotNull() | x["bare"].isNotNull()))

    return let(blocks, found)


def taxes(text: Column) -> Column:
    """PIS/PASEP, COFINS and ICMS after repair; a missing ICMS is a zero row."""
    t = F.regexp_replace(text, r"[|\[\](){}]", " ")
    found = F.struct(*(groups(t, rf"(?iud){p}\s*{_M}%?{_SEP}{_M}%?{_SEP}{_M}", 3).alias(k) for k, p in TAX_LABELS.items()))
    row = lambda k, b, a, v: F.struct(F.lit(k).alias("Tributo"), b.alias("base"), a.alias("aliquota"), v.alias("valor")).cast(TAX)

    def both(x: Column) -> Column:
        numbers = {k: tuple(num(x[k], i) for i in (1, 2, 3)) for k in TAX_LABELS}
        repaired = repair.tax_pair(numbers["PIS/PASEP"], numbers["COFINS"])
        printed = let(repaired, lambda r: F.array(*(F.when(r[f"{t}b"].isNotNull(), row(k, r[f"{t}b"], rate(r[f"{t}r"]), r[f"{t}v"])) for k, t in (("PIS/PASEP", "p"), ("COFINS", "c")))))
        b, a, v = numbers["ICMS"]
        icms = F.when(x["ICMS"].isNotNull(), row("ICMS", b, rate(a), v)).otherwise(row("ICMS", F.lit(None), F.lit("0%"), F.lit(0.0)))
        return F.array_compact(F.concat(printed, F.array(icms)))

    return let(found, both)


def readings(text: Column) -> Column:
    clean = reduce(lambda c, p: F.regexp_replace(c, p, "0"), ZEROS, text)

    def of(g: Column) -> Column:
        quantity = F.trim(F.regexp_replace(F.upper(g[1]), r"\s*-\s*", " - "))
        quantity = F.when(quantity == "ENERGIA REATIVA", "ENERGIA REATIVA - KWH").otherwise(quantity)
        post = F.upper(F.regexp_replace(g[2], r"\s+", " "))
        return F.struct(quantity.alias("Grandezas"), post.alias("posto"), integer(g[3]).alias("anterior"), integer(g[4]).alias("atual"), num(g, 6).alias("constante"), num(g, 7).alias("consumo"), g[0].alias("Medidor")).cast(READING)

    return F.array_distinct(F.transform(all_groups(clean, READING_ROW, 7), of))


def extract(docs: DataFrame) -> DataFrame:
    """path, id_fatura, id_uc, competencia, fatura, cliente, itens, impostos, medicao. docs: path, text."""
    text, path = F.col("text"), F.col("path")
    fields = docs.select("path", "text", F.struct(*(v.alias(k) for k, v in header(text, path).items())).alias("fatura"))
    people = fields.select("*", F.struct(*(v.alias(k) for k, v in customer(text).items())).alias("cliente"), taxes(text).alias("impostos"), readings(text).alias("medicao"))
    unit = F.coalesce(F.col("fatura.id_uc"), F.concat(F.lit("NULO_"), F.col("fatura.id_fatura")))
    return people.select("path", F.col("fatura.id_fatura").alias("id_fatura"), unit.alias("id_uc"), F.col("fatura.competencia").alias("competencia"), "fatura", "cliente", items(text).alias("itens"), "impostos", "medicao")
