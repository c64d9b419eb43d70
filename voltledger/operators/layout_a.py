"""Extraction from invoices of layout A (utility 1): one row per document in, one row with structs and arrays of structs out.

Every field is a cascade of patterns, first hit wins (``coalesce``); line tables are array transforms with an ordered choice of line shapes. There
is no explode and no shuffle: the sheets are exploded from the arrays afterwards (``sheets.explode_sheets``).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.functions.text import MONTHS_SHORT, Scanned, all_groups, any_may, blank_to_null, br_date, br_number, cut_right, file_name, file_stem, first, folded, groups, has, last, let, may, month_number, required, shapes, sorted_letters
from voltledger.operators.items import FINANCIAL, ITEM, READING, SUPPLY, TAX, cut_before, empty, integer, item, num, plain_num, rate, upper_name

SUPPLIER = "EQUATORIAL"

# ---- Fixed values: patterns of the layout ------------------------------------------------------------------------------------------------
_DATE, _MONTH = r"\d{2}/\d{2}/\d{4}", "|".join(MONTHS_SHORT)
NUMBER = (rf"(?d){_DATE}\s+(\d{{10,}})\s+[A-Z]{{3}}/\d{{4}}", rf"(?d){_DATE}\s+(\d{{10,}})\s+{_DATE}", r"(?d)(?<![\d.])(20\d{11})(?![\d.])")
UNIT_BEFORE_NOTE = r"(?dm)^\s*(\d{5,12})\s*$"
NOTE = r"(?iud)NOTA FISCAL\s*N"
UNIT = (
    r"(?iudm)^(\d{4,})\s+Consulte",
    r"(?iud)Consulte pela Chave[^\n]*\n(\d{4,})\s",
    r"(?iud)PERDAS DE TRANSFORMA[ÇC][ÃA]O\s*/\s*RAMAL:\s*[\d.,]+\s*%\s+(\d{6,})",
    r"(?iud)(?<!\d)(\d{8,12})\s+NOTA FISCAL\s*N",
    None,  # the last line of digits before the note's heading
    r"(?iudm)^CEP:\s*\d{5,8}[^\n]*?BRASIL\s+(\d{8,12})\s*$",
    r"(?iud)UNIDADE CONSUMIDORA[^\d]{0,60}?(\d{8,12})",
    r"(?d)\b(\d{1,3}(?:\.\d{3})+\.\d{3}-\d{2}|\d{1,3}\.\d{3}\.\d{3}-\d{2})\b",
)
MONTH = (rf"(?iud)\b({_MONTH})/(\d{{4}})\b", rf"(?iud)\b({_MONTH})[^\s\d]?(\d{{4}})\b")
DUE = (rf"(?iusd)(?:{_MONTH})/\d{{4}}\s+({_DATE})", rf"(?iusd)(?:{_MONTH})[^\s\d]?\d{{4}}\s+({_DATE})")
TOTAL = (r"(?iusd)R\$\*+([\d.,]+)", r"(?iusd)R\$\S{0,12}?(\d{1,3}(?:\.\d{3})*,\d{2})(?!\d)")
CLASS = (r"(?iusd)Classifica[çc][ãa]o:\s*(.+?)\s+Tipo de [Ff]ornecimento:", r"(?iusd)Classifica[çc][ãa]o:\s*([^\n]+)")
HEADING = rf"(?iudm)^([AB](?:\s+OPT)?\s+[AB]\d?\S*)\s+(.+?)\s+\S+\s+((?:MONO|BI|TRI)F[ÁA]SICO)\s+(?:(\d{{1,3}})\s+)?({_DATE})"
READ_DATES = rf"(?d)({_DATE})\s+({_DATE})\s+(\d{{1,3}})\s+({_DATE})"
SCEE_CYCLE = r"(?iud)GERA[ÇC][ÃA]O\s+CICLO\s*\((\d{1,2})/(\d{4})\)"
SCEE_BALANCE = r"(?iusd)\bSALDO\s+KWH:\s*(.*?)(?:,?\s*SALDO\s+A\s+EXPIRAR|,?\s*CADASTRO|$)"
STATES = "AC|AL|AM|AP|BA|CE|DF|ES|GO|MA|MG|MS|MT|PA|PB|PE|PI|PR|RJ|RN|RO|RR|RS|SC|SE|SP|TO"
PLACE = rf"(?iud)CEP:\s*(\d{{8}})\s+([A-ZÀ-ÿ][A-ZÀ-ÿ\s]+?)\s+({STATES})\s+BRASIL"
PLACE_BARE = rf"(?d)(?:Segunda via\s+)?([A-ZÀ-ÿ][A-ZÀ-ÿ\s]+?)\s+({STATES})\s+BRASIL"
OWNER = (r"(?iusd)\n([A-ZÇÃÁÉÍÓÚÊÔÂ][A-ZÇÃÁÉÍÓÚÊÔÂ ]+?)\s*\nCNPJ/CPF:", r"(?iusd)\n([A-ZÇÃÁÉÍÓÚÊÔÂ][A-ZÇÃÁÉÍÓÚÊÔÂ .]+?)\s+CNPJ/CPF:")
DELIVERY = r"(?iusd)ENDERE[ÇC]O DE ENTREGA:[^\n]*\n((?:[^\n]+\n){2,5})"
AFTER_TAX_ID = r"(?iusd)CNPJ/CPF:[^\n]+\n(.+?)PERDAS DE TRANSFORMA"
_N, _M = r"(-?[\d.,]+)", r"([\d.,]+)"
_METER_PREFIX = r"(?d)^(?:(?:ENERGIA|DEMANDA)\s[A-ZÀ-Ü ÇÃ]*-\s*KWH?|UFER(?:\s+GERA[ÇC][ÃA]O)?|DMCR|FATOR DE POT[ÊE]NCIA)\s+(?:PONTA|FORA PONTA|RESERVADO|[ÚU]NICO|INTERMEDI[ÁA]RIO)\s+"
RIGHT_NEIGHBOURS = (
    r"(?iud)\s+DEMANDA(?:\s+GERA[ÇC][ÃA]O)?\s*-\s*kW\s+\d+.*$",
    r"(?iud)\s+(COFINS|PIS/PASEP|ICMS)\s+[\d.,]+\s+[\d.,]+%?\s+[\d.,]+.*$",
    r"(?iud)\s+TIPOS DE.*$",
    r"(?iud)\s+\d+\s+(LIDA|M[ÉE]DIA|M[ÍI]NIMO|ESTIMADA|LEITURA)\b.*$",
    rf"(?d)\s+[\d.,]+\s+{_DATE}.*$",
    r"(?d)\s+[\d.,]+\s+\d{4}/\d{2}.*$",
)
HISTORY = RIGHT_NEIGHBOURS[3]
FULL_ITEM = rf"(?iud)^(.+?)\s+(kWh|kVArh|kVar|kW)\s+{_N}\s+{_N}\s+{_N}\s+{_N}\s+{_N}\s+{_M}%\s+{_N}\s+{_N}(?:\s+.*)?$"
EXEMPT_ITEM = rf"(?iud)^(DEMANDA[^\d]*?)\s+(kWh|kW|kVar)\s+{_M}\s+{_M}\s+{_N}\s+{_N}\s+{_N}\s+{_M}%?\s+{_M}(?:\s+.*)?$"
SHORT_ITEM = rf"(?iud)^((?:DEMANDA|INJEÇÃO SCEE)[^\d]*?)\s+(kWh|kW|kVar)\s+{_M}\s+{_M}\s+{_N}\s+{_N}\s+{_M}(?:\s+.*)?$"
BENEFIT_ITEM = r"(?iud)^(BENEF[ÍI]CIO TARIF[ÁA]RIO\s+.+?)\s+(-?\d[\d.]*,\d{2})\s*$"
KNOWN_FINANCIAL = (
    ("IR LEI 9430(-)", r"(?iud)IR LEI 9430\(-\)\s*(-?[\d,.]+)"),
    ("CSLL LEI 9430(-)", r"(?iud)CSLL[^\n]*?LEI 9430\(-\)\s*(-?[\d,.]+)"),
    ("COFINS LEI 9430(-)", r"(?iud)COFINS\s*(?:\([^\)]+\))?\s*LEI 9430\(-\)\s*(-?[\d,.]+)"),
    ("PIS/PASEP LEI 9430(-)", r"(?iud)PIS/PASEP\s*(?:\([^\)]+\))?\s*LEI 9430\(-\)\s*(-?[\d,.]+)"),
    ("CONTRIB. ILUM. PÚBLICA - MUNICIPAL", r"(?iud)CONTRIB\.\s*ILUM\.\s*P[ÚU]BLICA\s*-\s*MUNICIPAL\s+(-?[\d,.]+)"),
    ("VALOR ACUM. PROXIMO MES", r"(?iud)VALOR ACUM\.\s*PROXIMO MES\s+(-?[\d,.]+)"),
    ("VALOR ACUM. MES PASSADO", r"(?iud)VALOR ACUM\.\s*M[ÊE]S PASSADO[^\d]*\d{1,2}/\d{4}\s+(-?[\d,.]+)"),
)
SECTION_END = (
    r"(?iud)^\s*(TOTAL\b|Cliente poder|Nota fiscal emitida|A EQUATORIAL|EQUATORIAL GOIAS|TRIBUNAL DE JUSTICA|FATURA PERTENCENTE|Aproveite|Consulte|https?:|CEP:|RODOVIA\b|RUA\b|AVENIDA\b|AV\.|QUADRA\b|ZONA RURAL|PRA[ÇC]A\b)",
    r"(?iud)^(ENERGIA ATIVA|ENERGIA GERA|DEMANDA|UFER|DMCR)\b.*\b(PONTA|FORA PONTA|RESERVADO|[ÚU]NICO|INTERMEDI)",
    r"(?d)\b\d{7,}-\d\b",
)
SKIP_LINE = r"(?iud)^\s*(M[ÊE]S\s*/\s*ANO\b|MES\s*/\s*ANO\b|TIPOS DE\b|CONSUMO FATURADO)"
KNOWN_PREFIX = r"(?iud)^(IR LEI 9430|CONTRIB\.\s*ILUM|COFINS\b|PIS/PASEP\b|PIS\b|CSLL\b|ICMS\b|VALOR ACUM\.\s*M[ÊE]S PASSADO|VALOR ACUM\.\s*PROXIMO)"
COUNTED_FINANCIAL = rf"(?iud)^(EMIS\.\s*SEGUNDA VIA|RELIGA[ÇC][ÃA]O PROGRAMADA|DESLIGAMENTO PROGRAMADO)\s+{_M}\s+{_M}\s+{_N}"
AMOUNT = r"(?d)-?\d[\d.]*,\d{2}\b"
LEAKED = r"(?iudm)^((?:DEV\.|DEVOLU[ÇC][ÃA]O|CR[ÉE]DITO DE CONSUMO|JUROS DEV\.|ATUAL\. MONET)[A-ZÀ-ÿa-z ./()\-]*(?:\d{1,2}/\d{4})?)\s+(-?\d[\d.]*,\d{2})\s*$"
OLD_WINDOW = r"(?iusdm)Itens da Fatura(.*?)(?:^\s*TOTAL\b|\z)"
OLD_ITEM = rf"(?d)([A-ZÀ-Þ(][A-Za-zÀ-ÿ .,/()\-]*?(?:\d{{1,2}}/\d{{1,2}})?)\s+(kWh|kW|kVArh|kVar)\s+{_N}\s+{_N}\s+{_N}\s+{_N}\s+{_N}\s+{_M}%\s+{_N}\s+{_N}"
_OLD_NAME = r"[A-ZÀ-Þ][A-Za-zÀ-ÿ .,/()\-]{2,}?(?:\d{1,6}/\d{1,4}[A-Za-zÀ-ÿ .,/()\-]*?)*"
OLD_AMOUNT = rf"(?d)({_OLD_NAME})\s+(-?\d[\d.]*,\d{{2}})(?:\s+-?[\d.,]+%?)*(?:\s+(?:PIS(?:/PASEP)?|COFINS|ICMS|CSLL)\b.*)?\s*$"
OLD_COUNTED = rf"(?d)({_OLD_NAME})\s+(\d[\d.]*,\d{{2}})\s+(\d[\d.]*,\d{{6}})\s+(-?\d[\d.]*,\d{{2}})\b"
OLD_TAX_WORD = r"(?iud)^\s*(PIS|COFINS|ICMS|CSLL|TOTAL|M[ÊE]S|MES)\b"
OLD_NAMES = (
    "ENERGIA ATIVA FORNECIDA FP - PARC. TE", "ENERGIA ATIVA FORNECIDA HR - PARC. TE", "ENERGIA ATIVA FORNECIDA P - PARC. TE",
    "AD. BAND. VERMELHA EN. ATIVA FORN. FP - PARC. TE", "AD. BAND. VERMELHA EN. ATIVA FORN. HR - PARC. TE",
    "AD. BAND. VERMELHA EN. ATIVA FORN. P - PARC. TE", "AD. BAND. AMARELA EN. ATIVA FORN. FP - PARC. TE",
    "AD. BAND. AMARELA EN. ATIVA FORN. HR - PARC. TE", "AD. BAND. AMARELA EN. ATIVA FORN. P - PARC. TE",
    "AD. BAND. VERMELHA EN. ATIVA FORN. FP", "AD. BAND. VERMELHA EN. ATIVA FORN. HR", "AD. BAND. VERMELHA EN. ATIVA FORN. P",
    "AD. BAND. AMARELA EN. ATIVA FORN. FP", "AD. BAND. AMARELA EN. ATIVA FORN. HR", "AD. BAND. AMARELA EN. ATIVA FORN. P",
    "ENERGIA ATIVA FORNECIDA FP", "ENERGIA ATIVA FORNECIDA HR", "ENERGIA ATIVA FORNECIDA P",
    "UFER DEMONSTRATIVO FORA DE PONTA", "UFER DEMONSTRATIVO HORÁRIO RESERVADO", "UFER DEMONSTRATIVO PONTA",
)
TAXES = ("PIS/PASEP", "ICMS", "COFINS")
_QUANTITY = r"(ENERGIA REATIVA GERA[ÇC][ÃA]O - KWH|ENERGIA REATIVA - KWH|ENERGIA GERA[ÇC][ÃA]O - KWH|ENERGIA ATIVA - KWH|DEMANDA GERA[ÇC][ÃA]O - KW|DEMANDA - KW|UFER GERA[ÇC][ÃA]O|UFER|DMCR)"
_POST, _H = r"(PONTA|FORA PONTA|RESERVADO|INTERMEDI[ÁA]RIO|[ÚU]NICO)", r"[^\S\n]"
METER_LAST = rf"(?iudm)^{_QUANTITY}{_H}+{_POST}{_H}+(\d+)(?:{_H}+(\d+))?{_H}+{_M}{_H}+{_M}{_H}+(\d+-?\d*)"
METER_FIRST = rf"(?iudm)^(\d+-?\d*){_H}+{_QUANTITY}{_H}+{_POST}{_H}+(\d+)(?:{_H}+(\d+))?{_H}+{_M}{_H}+{_M}"
METER_CUT = rf"(?iudm)^(\d+-?\d*){_H}+{_QUANTITY}{_H}+{_POST}{_H}+(\d+){_H}+{_M}{_H}*$"
STAMP = r"(?iud)Protocolo[^\n]+?(\d{2}/\d{2}/\d{4})\s+[àa]s\s+(\d{2}:\d{2})"
ISSUED = rf"(?iusd)DATA DE EMISS[ÃA]O:\s*({_DATE})"
NOTE_NUMBER, NOTE_SERIES = r"(?iusd)NOTA FISCAL N[º°O\s]+(\d+)", r"(?iusd)NOTA FISCAL[^-]+-\s*S[ÉE]RIE\s+(\d+)"
ACCESS_KEY, PROTOCOL = r"(?iud)chave de acesso:\s*\n?\s*(\d{44})", r"(?iud)Protocolo de autoriza[çc][ãa]o:\s*(\d+)"
CFOP = "5258"
SUPPLY_KIND = r"(?iusd)Tipo de [Ff]ornecimento:\s*(\S+)"
VOLTS = r"(?iusd)Tens[ãa]o Nominal Disp:\s*(\d+)\s*V"
VOLTS_LEAST, VOLTS_MOST = r"(?iusd)Lim Min:\s*([\d.,]+)\s*V", r"(?iusd)Lim Max:\s*([\d.,]+)\s*V"
CONTRACTED, CONTRACTED_GENERATION = r"(?iud)DEMANDA\s*-\s*kW\s+(\d+(?:[.,]\d+)?)", r"(?iud)DEMANDA\s+GERA[ÇC][ÃA]O\s*-\s*kW\s+(\d+(?:[.,]\d+)?)"
LOSSES = r"(?iusd)PERDAS DE TRANSFORMA[ÇC][ÃA]O\s*/\s*RAMAL:\s*([\d.,]+)\s*%"
TAX_ID = r"(?iusd)CNPJ/CPF:\s*([\d./-]+)"
LONE_CAPITAL = r"(?<![A-Za-zÀ-ÿ])[A-ZÀ-Þ](?![A-Za-zÀ-ÿ])"
POST_HINT = (r"\b(FP|HR|P)\s*-\s*PARC", r"\b(FP|HR|P)\s*\.?\s*$")
NAME_UNIT, GLUED_UNIT = r"\s*-\s*k(?:Wh|W|VArh|Var)\s*$", r"-?\s*(kWh|kW|kVArh|kVar)\s*$"
# ------------------------------------------------------------------------------------------------------------------------------------------


def _plain(text: Column | Scanned) -> Column:
    return text.text if isinstance(text, Scanned) else text


def _any(text: Column | Scanned, patterns, group: int = 1) -> Column:
    return F.coalesce(*(let(F.trim(first(text, p, group)), lambda x: F.when(x != "", x)) for p in patterns))


def unit_id(text: Column | Scanned) -> Column:
    before = F.when(has(text, NOTE), last(F.split(_plain(text), NOTE, 2)[0], UNIT_BEFORE_NOTE))
    return F.coalesce(*(before if p is None else first(text, p) for p in UNIT))


def balance(text: Column | Scanned) -> Column:
    return F.regexp_replace(first(text, SCEE_BALANCE), r"[,\s]+$", "")


def scee(text: Column | Scanned, part: Column | None = None) -> list[Column]:
    """Cycle, total, P, FP, HR. A balance by tariff post leaves the total empty. ``part``: the ``balance``, where it has been computed."""
    at = groups(text, SCEE_CYCLE, 2)
    cycle = F.concat(at[1], F.lit("_"), F.lpad(at[0], 2, "0"))
    part = balance(text) if part is None else part
    amount = r"(-?\d[\d.]*,\d{2})"
    p, fp, hr, atv = (first(part, rf"(?iud)\b{k}\s*[:=]\s*{amount}") for k in ("P", "FP", "HR", "ATV"))
    alone = F.when(p.isNull() & fp.isNull() & hr.isNull(), first(part, rf"(?d)^{amount}"))
    return [cycle, F.coalesce(atv, alone), p, fp, hr]


def shared(text: Column | Scanned, path: Column, forced: Column) -> dict[str, Column]:
    """What several fields are made of. ``extract`` makes columns of it, so that each is found once."""
    given = F.coalesce(forced, file_stem(file_name(path)))
    number = F.when(given.rlike(r"^\d+$"), given).otherwise(F.coalesce(*(first(text, p) for p in NUMBER), given))
    month = F.coalesce(*(groups(text, p, 2) for p in MONTH))
    return {"number": number, "head": groups(text, HEADING, 5), "read": groups(text, READ_DATES, 4), "month": month, "printed_class": _any(text, CLASS), "stamp": groups(text, STAMP, 2), "balance": balance(text)}


def header(text: Column | Scanned, path: Column, forced: Column, found: dict[str, Column] | None = None) -> dict[str, Column]:
    """The fields; ``found``: ``shared``, where it has been computed."""
    number, head, read, printed_month, printed_class, stamp, part = (found or shared(text, path, forced)).values()
    old = printed_class.isNull() & head.isNotNull()
    old_days = old & read.isNull() & (head[3] != "")
    month = F.concat(F.trim(printed_month[1]), F.lit("-"), month_number(F.trim(printed_month[0])))
    cycle, total, p, fp, hr = scee(text, part)
    return {
        "id_fatura": F.concat(F.lit(f"{SUPPLIER}_"), number),
        "numero_fatura": number,
        "arquivo_pdf": file_name(path),
        "fornecedor": F.lit(SUPPLIER),
        "id_uc": unit_id(text),
        "data_emissao": br_date(first(text, ISSUED)),
        "competencia": month,
        "data_vencimento": br_date(_any(text, DUE)),
        "valor_total_r$": br_number(F.coalesce(*(first(text, x) for x in TOTAL))),
        "numero_nf": first(text, NOTE_NUMBER),
        "serie_nf": F.coalesce(first(text, NOTE_SERIES), F.lit("0")),
        "cfop": F.lit(CFOP),
        "chave_acesso_nfe": first(text, ACCESS_KEY),
        "protocolo_autorizacao": first(text, PROTOCOL),
        "data_hora_protocolo": F.concat(br_date(stamp[0]), F.lit(" "), stamp[1]),
        "classificacao_tarifaria": F.coalesce(printed_class, F.when(old, F.concat(head[0], F.lit(" "), F.trim(head[1])))),
        "tipo_fornecimento": F.coalesce(first(text, SUPPLY_KIND), F.when(old, F.upper(head[2]))),
        "tensao_nominal_v": first(text, VOLTS),
        "tensao_min_v": first(text, VOLTS_LEAST),
        "tensao_max_v": first(text, VOLTS_MOST),
        "demanda_contratada_kw": F.coalesce(br_number(first(text, CONTRACTED)), F.lit(0.0)),
        "demanda_geracao_contratada_kw": F.coalesce(br_number(first(text, CONTRACTED_GENERATION)), F.lit(0.0)),
        "perdas_transformacao_pct": br_number(first(text, LOSSES)),
        "scee_geracao_ciclo": cycle,
        "scee_saldo_kwh_total": total,
        "scee_saldo_kwh_P": p,
        "scee_saldo_kwh_FP": fp,
        "scee_saldo_kwh_HR": hr,
        "data_leitura_anterior": br_date(read[0]),
        "data_leitura_atual": br_date(read[1]),
        "numero_dias_leitura": F.coalesce(read[2], F.when(old_days, head[3])).try_cast("int"),
        "data_proxima_leitura": br_date(F.coalesce(read[3], F.when(old_days, head[4]))),
    }


def location(text: Column | Scanned) -> Column:
    """cep, municipio, uf."""

    def place(block: Column | Scanned) -> Column:
        row = lambda cep, town, state: F.struct(cep.alias("cep"), F.trim(town).alias("municipio"), F.upper(state).alias("uf"))
        return shapes(block, (PLACE, 3, lambda g: row(g[0], g[1], g[2])), (PLACE_BARE, 2, lambda g: row(F.lit(None).cast("string"), g[0], g[1])))

    return F.coalesce(let(F.concat(first(text, DELIVERY), F.lit("\n")), place), let(first(text, AFTER_TAX_ID), place), place(text))


def customer(text: Column | Scanned, at: Column | None = None) -> dict[str, Column]:
    """``at``: the ``location``, where it has been computed."""
    at = location(text) if at is None else at
    return {"razao_social": _any(text, OWNER), "cnpj": first(text, TAX_ID), "cep": at["cep"], "municipio": at["municipio"], "uf": at["uf"]}


# ---- Items -------------------------------------------------------------------------------------------------------------------------------


def unscrambled(name: Column) -> Column:
    """The known name of the same letters; or, for a visibly scrambled name, the longest known one whose letters it holds and that is half of it.

    The known names are one literal, so the expression does not grow with them; for a table of names see ``containment``."""
    bare = lambda n: n.replace(" ", "")
    post = lambda n: p if (p := n.removesuffix(" - PARC. TE").rsplit(" ", 1)[-1]) in ("FP", "HR", "P") else None
    letters = sorted(set("".join(OLD_NAMES)) - {" "})
    known = [{"name": n, "post": post(n), "size": len(bare(n)), "need": [bare(n).count(c) for c in letters]} for n in sorted(OLD_NAMES, key=lambda n: -len(bare(n)))]
    known = F.from_json(F.lit(json.dumps(known, ensure_ascii=False)), "array<struct<name:string,post:string,size:int,need:array<int>>>")
    exact = F.from_json(F.lit(json.dumps({"".join(sorted(bare(n))): n for n in OLD_NAMES}, ensure_ascii=False)), "map<string,string>")
    alphabet = F.from_json(F.lit(json.dumps(letters, ensure_ascii=False)), "array<string>")

    def contained(n: Column) -> Column:
        hint = F.coalesce(*(first(n, p) for p in POST_HINT))
        has = F.transform(alphabet, lambda c: F.length(n) - F.length(F.replace(n, c, F.lit(""))))
        found = F.struct(hint.alias("hint"), F.length(F.replace(n, F.lit(" "), F.lit(""))).alias("size"), has.alias("has"))
        agrees = lambda x, k: F.coalesce(x["hint"] == k["post"], F.lit(True)) & (2 * k["size"] >= x["size"])
        enough = lambda x, k: F.forall(F.zip_with(x["has"], k["need"], lambda a, b: a >= b), lambda v: v)
        return let(found, lambda x: F.try_element_at(F.filter(known, lambda k: agrees(x, k) & enough(x, k)), F.lit(1))["name"])

    scrambled = lambda n: F.size(F.regexp_extract_all(n, F.lit(LONE_CAPITAL), F.lit(0))) >= 3
    return let(name, lambda n: F.coalesce(F.try_element_at(exact, sorted_letters(n)), F.when(scrambled(n), contained(n)), n))


def old_name(name: Column) -> Column:
    """Name of an old-layout item: without unit and merged meter words, unscrambled."""
    bare = F.upper(F.trim(F.regexp_replace(F.trim(name), NAME_UNIT, "")))
    return unscrambled(let(bare, lambda b: F.coalesce(blank_to_null(F.regexp_replace(b, _METER_PREFIX, "")), b)))


def financial_of(line: Column) -> Column:
    """The item in a line, or in what a supply item left of it: with quantity and price, or with a value only."""
    ok = lambda g, value: (upper_name(g[0]) != "") & ~g[0].rlike(OLD_TAX_WORD) & value.isNotNull()

    def counted(g: Column) -> Column:
        unit = first(g[0], GLUED_UNIT)
        name, kind = F.when(unit.isNull(), upper_name(g[0])).otherwise(old_name(g[0])), F.when(unit.isNull(), FINANCIAL).otherwise(SUPPLY)
        return F.when(ok(g, num(g, 4)), item(name, kind, unit, num(g, 2), num(g, 3), num(g, 4)))

    plain = lambda g: F.when(ok(g, num(g, 2)), item(upper_name(g[0]), FINANCIAL, valor=num(g, 2)))
    return let(F.trim(F.regexp_replace(line, HISTORY, "")), lambda rest: shapes(rest, (OLD_COUNTED, 4, counted), (OLD_AMOUNT, 2, plain)))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _present(array: Column) -> Column:
    return F.filter(array, lambda x: x.isNotNull())


def old_items(text: Column) -> Column:
    def full(g: Column) -> Column:
        return item(old_name(g[0]), SUPPLY, g[1], num(g, 3), num(g, 4), num(g, 5), num(g, 6), num(g, 7), F.concat(g[7], F.lit("%")), num(g, 9), num(g, 10))

    def of_line(line: Column) -> Column:
        supply = shapes(line, (OLD_ITEM, 10, full))
        rest = F.when(line.rlike(OLD_ITEM), F.element_at(F.split(line, OLD_ITEM, 2), -1)).otherwise(line)
        return F.array(supply, financial_of(rest))

    windows = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(OLD_WINDOW), F.lit(1)), _lines))
    return _present(F.flatten(F.transform(windows, of_line)))


def supply_items(text: Column | Scanned, sectioned: Column) -> Column:
    """Items of the supply block; where the text has no section of financial items they stand in the same block."""
    end = F.when(sectioned, first(text, r"(?iusd)FORNECIMENTO[^\n]*\n(.+?)ITENS FINANCEIROS")).otherwise(first(text, r"(?iusdm)FORNECIMENTO[^\n]*\n(.+?)^\s*TOTAL\b"))
    # without a neighbour's word in the text, or the / of its dates in the block, there is nothing to cut
    beside = lambda block: reduce(Column.__or__, (may(text, p) if required(p) else F.contains(block, F.lit("/")) for p in RIGHT_NEIGHBOURS))
    cut = lambda lines: F.transform(lines, lambda x: cut_right(x, RIGHT_NEIGHBOURS))
    clean = let(end, lambda block: F.when(beside(block), cut(_lines(block))).otherwise(_lines(block)))

    name = lambda g: F.upper(F.trim(g[0]))
    full = lambda g: item(F.regexp_replace(name(g), _METER_PREFIX, ""), SUPPLY, g[1], plain_num(g, 3), plain_num(g, 4), plain_num(g, 5), plain_num(g, 6), plain_num(g, 7), F.concat(g[7], F.lit("%")), plain_num(g, 9), plain_num(g, 10))
    exempt = lambda g: item(name(g), SUPPLY, g[1], plain_num(g, 3), plain_num(g, 4), plain_num(g, 5), plain_num(g, 6), plain_num(g, 7), F.concat(g[7], F.lit("%")), None, plain_num(g, 9))
    short = lambda g: item(name(g), SUPPLY, g[1], plain_num(g, 3), plain_num(g, 4), plain_num(g, 5), plain_num(g, 6), tarifa=plain_num(g, 7))
    benefit = lambda g: item(name(g), SUPPLY, valor=num(g, 2))

    def of_line(line: Column) -> Column:
        shaped = shapes(line, (FULL_ITEM, 10, full), (EXEMPT_ITEM, 9, exempt), (SHORT_ITEM, 7, short), (BENEFIT_ITEM, 2, benefit))
        extra = let(financial_of(line), lambda x: F.when(~x["item"].rlike(KNOWN_PREFIX), x))
        return F.coalesce(shaped, F.when(~sectioned & ~line.rlike(SKIP_LINE) & ~line.rlike(KNOWN_PREFIX), extra))

    return F.coalesce(_present(F.transform(clean, of_line)), empty(ITEM))


def section_items(text: Column | Scanned) -> Column:
    """Items of the financial section, up to the first line that ends it."""
    ends = lambda x: reduce(lambda a, b: a | b, (x.rlike(p) for p in SECTION_END))
    section = let(_lines(first(text, r"(?iusd)ITENS FINANCEIROS(.*)$")), lambda lines: cut_before(lines, ends))
    clean = F.transform(F.filter(section, lambda x: ~x.rlike(SKIP_LINE)), lambda x: F.regexp_replace(F.regexp_replace(x, RIGHT_NEIGHBOURS[2], ""), HISTORY, ""))

    def of_line(line: Column) -> Column:
        counted = shapes(line, (COUNTED_FINANCIAL, 4, lambda g: item(F.when(num(g, 4).isNotNull(), F.upper(F.trim(g[0]))), FINANCIAL, None, num(g, 2), num(g, 3), num(g, 4))))
        plain = F.struct(upper_name(F.split(line, AMOUNT, 2)[0]).alias("name"), br_number(first(line, rf"({AMOUNT})")).alias("value"))
        ok = lambda x: (x["name"] != "") & ~F.startswith(x["name"], F.lit("TOTAL")) & x["value"].isNotNull()
        row = F.coalesce(counted, let(plain, lambda x: F.when(ok(x), item(x["name"], FINANCIAL, valor=x["value"]))))
        return let(row, lambda x: F.when(x["item"].isNotNull(), x))

    useful = F.filter(clean, lambda x: x.rlike("^[A-Za-zÀ-ÿ]") & ~x.rlike(KNOWN_PREFIX))
    return F.coalesce(_present(F.transform(useful, of_line)), empty(ITEM))


def items(text: Column | Scanned) -> Column:
    known = _present(F.array(*(F.when(has(text, p), item(F.lit(n), FINANCIAL, valor=br_number(first(text, p)))) for n, p in KNOWN_FINANCIAL)))
    known = F.when(any_may(text, [p for _, p in KNOWN_FINANCIAL]), known).otherwise(empty(ITEM))
    leaks = F.filter(F.transform(all_groups(text, LEAKED, 2), lambda g: item(upper_name(g[0]), FINANCIAL, valor=num(g, 2))), lambda x: x["valor"].isNotNull())
    fresh = lambda found: F.filter(F.array_distinct(leaks), lambda x: ~F.exists(found, lambda y: (y["item"] == x["item"]) & (y["valor"] == x["valor"])))
    modern = lambda sectioned: let(F.concat(supply_items(text, sectioned), known, section_items(text)), lambda found: F.concat(found, fresh(found)))
    return let(has(text, "(?iud)ITENS FINANCEIROS"), lambda s: F.when(~s & has(text, "(?iud)Itens da Fatura"), old_items(_plain(text))).otherwise(modern(s)))


def taxes(text: Column | Scanned) -> Column:
    def of(name: str) -> Column:
        row = shapes(text, (rf"(?iud){name}\s+{_M}\s+{_M}%\s+{_M}", 3, lambda g: F.struct(F.lit(name).alias("Tributo"), num(g, 1).alias("base"), rate(num(g, 2)).alias("aliquota"), num(g, 3).alias("valor")).cast(TAX)))
        zero = F.struct(F.lit(name).alias("Tributo"), F.lit(None).alias("base"), F.lit("0%").alias("aliquota"), F.lit(0.0).alias("valor")).cast(TAX)
        return F.coalesce(row, zero) if name == "ICMS" else row

    return _present(F.array(*(of(n) for n in TAXES)))


def _reading(quantity, post, before, now, constant, use, meter) -> Column:
    return F.struct(F.upper(quantity).alias("Grandezas"), F.upper(post).alias("posto"), before.alias("anterior"), now.alias("atual"), constant.alias("constante"), use.alias("consumo"), meter.alias("Medidor")).cast(READING)


def readings(text: Column | Scanned) -> Column:
    """A lone reading is the current one; equal rows count once; a cut row counts only if no full row has its quantity, post and meter."""
    two = lambda a, b: (F.when(b != "", integer(a)), integer(F.when(b != "", b).otherwise(a)))
    late = F.transform(all_groups(text, METER_LAST, 7), lambda g: _reading(g[0], g[1], *two(g[2], g[3]), num(g, 5), num(g, 6), g[6]))
    early = F.transform(all_groups(text, METER_FIRST, 7), lambda g: _reading(g[1], g[2], *two(g[3], g[4]), num(g, 6), num(g, 7), g[0]))
    full = F.array_distinct(F.concat(late, early))
    cut = F.transform(all_groups(text, METER_CUT, 5), lambda g: _reading(g[1], g[2], F.lit(None), integer(g[3]), num(g, 5), F.lit(None), g[0]))
    same = lambda a, b: (a["Grandezas"] == b["Grandezas"]) & (a["posto"] == b["posto"]) & (a["Medidor"] == b["Medidor"])
    add = lambda acc, c: F.when(F.exists(acc, lambda f: same(c, f)), acc).otherwise(F.concat(acc, F.array(c)))
    return F.when(~may(text, _POST), empty(READING)).otherwise(let(full, lambda rows: F.aggregate(cut, rows, add)))


def allocated(items: Column, taxes: Column) -> Column:
    """Where no item carries taxes, PIS and COFINS go to the supply items by value; the first largest takes what rounding leaves."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    total = lambda array, f: F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))
    due = F.round(total(F.filter(taxes, lambda t: F.upper(t["Tributo"]).isin("PIS/PASEP", "COFINS")), lambda t: zero(t["valor"])), 2)
    printed = total(items, lambda i: zero(i["pis_cofins"]) + zero(i["icms"]))
    takes = lambda i: (i["tipo"] == SUPPLY) & (zero(i["valor"]) > 0)
    supply = F.filter(items, takes)
    base = total(supply, lambda i: i["valor"])
    largest = F.array_max(F.transform(supply, lambda i: i["valor"]))
    at = F.array_min(_present(F.transform(items, lambda i, n: F.when(takes(i) & (i["valor"] == largest), n))))
    share = lambda i: F.round(due * i["valor"] / base, 2)
    others = total(F.filter(F.transform(items, lambda i, n: F.struct(n.alias("n"), i.alias("i"))), lambda x: takes(x["i"]) & (x["n"] != at)), lambda x: share(x["i"]))
    spread = F.transform(items, lambda i, n: F.when(n == at, i.withField("pis_cofins", F.round(due - others, 2))).when(takes(i), i.withField("pis_cofins", share(i))).otherwise(i))
    return F.when((due > 0.005) & (F.size(supply) > 0) & (F.abs(printed) <= 0.005), spread).otherwise(items)


def extract(docs: DataFrame) -> DataFrame:
    """path, id_fatura, id_uc, competencia, fatura, cliente, itens, impostos, medicao. docs: path, text and optionally numero (forced)."""
    text, path = Scanned(F.col("text"), F.col("__folded")), F.col("path")
    forced = F.col("numero") if "numero" in docs.columns else F.lit(None).cast("string")
    found = shared(text, path, forced)
    docs = docs.withColumn("__folded", folded(F.col("text")))
    docs = docs.select("path", "text", "__folded", forced.alias("__forced"), *(v.alias(f"__{k}") for k, v in found.items()), location(text).alias("__at"))
    fields = header(text, path, F.col("__forced"), {k: F.col(f"__{k}") for k in found})
    fields = docs.select("path", "text", "__folded", "__at", F.struct(*(v.alias(k) for k, v in fields.items())).alias("fatura"))
    people = fields.select("*", F.struct(*(v.alias(k) for k, v in customer(text, F.col("__at")).items())).alias("cliente"), taxes(text).alias("impostos"), readings(text).alias("medicao"))
    rows = people.select("*", items(text).alias("itens"))
    unit = F.coalesce(F.col("fatura.id_uc"), F.concat(F.lit("NULO_"), F.col("fatura.id_fatura")))
    return rows.select("path", F.col("fatura.id_fatura").alias("id_fatura"), unit.alias("id_uc"), F.col("fatura.competencia").alias("competencia"), "fatura", "cliente", allocated(F.col("itens"), F.col("impostos")).alias("itens"), "impostos", "medicao")
