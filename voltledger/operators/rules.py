"""User rules (IF ... THEN ...) compiled to Columns.

Rules run in order, later ones see earlier effects; the mask of a rule is computed once, before its actions. Groups are joined by AND; inside a group
conditions fold from the left with the group's link. Predicates are two-valued: a null never makes a mask null.

Hundreds of rules make one plan: rules of a sheet are gathered into layers, as long as no rule reads a column that an earlier rule of its layer
writes. A layer is three projections: each column that is tested as a number and as a key, once; each different condition, once; the masks and one choice
of value for each column that is written (the last rule whose mask holds). The depth of the plan follows the chain of effects, not the number of rules.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltledger.functions.text import is_blank, loose_number, py_column_key, py_loose_number, py_text_key, text_key
from voltledger.schemas import quoted

# Operators and links of the rule format.
OPERATORS = ("igual", "diferente", "esta_em", "nao_esta_em", "contem", "nao_contem", "maior_que", "menor_que", "vazio", "nao_vazio")
LINKS = ("E", "OU")


@dataclass(frozen=True)
class Condition:
    coluna: str = ""
    operador: str = "igual"
    valor: str = ""


@dataclass(frozen=True)
class Group:
    operador: str = "E"
    condicoes: tuple[Condition, ...] = ()


@dataclass(frozen=True)
class Action:
    coluna: str = ""
    valor: str = ""


@dataclass(frozen=True)
class Rule:
    nome: str = ""
    aba: str = ""
    ativo: bool = True
    grupos: tuple[Group, ...] = ()
    acoes: tuple[Action, ...] = ()
    id: str = field(default_factory=lambda: uuid.uuid4().hex)


def parse(rules: list[dict]) -> list[Rule]:
    """Rules from their JSON form; an unknown operator is ``igual``, an unknown link is AND."""
    out = []
    for r in rules:
        groups = []
        for g in r.get("grupos") or []:
            link = str(g.get("operador") or "E").upper()
            conditions = (Condition(str(c.get("coluna", "")), c.get("operador") if c.get("operador") in OPERATORS else "igual", str(c.get("valor", ""))) for c in g.get("condicoes") or [])
            groups.append(Group(link if link in LINKS else "E", tuple(conditions)))
        actions = tuple(Action(str(a.get("coluna", "")), str(a.get("valor", ""))) for a in r.get("acoes") or [])
        out.append(Rule(str(r.get("nome", "")).strip(), str(r.get("aba", "")).strip(), bool(r.get("ativo", True)), tuple(groups), actions, str(r.get("id") or uuid.uuid4().hex)))
    return out


def dump(rules: list[Rule]) -> str:
    return json.dumps([asdict(r) for r in rules], ensure_ascii=False, indent=1)


@dataclass(frozen=True)
class Cell:
    """A column as conditions see it: as it is, as a number and as a text key."""

    raw: Column
    number: Column
    key: Column

    @staticmethod
    def of(c: Column) -> Cell:
        return Cell(c, loose_number(c), text_key(c.cast("string")))


def equal(cell: Column | Cell, value: str) -> Column:
    """Both numbers: equal within 1e-9; else equal text keys. A null equals nothing."""
    cell, number = cell if isinstance(cell, Cell) else Cell.of(cell), py_loose_number(value)
    same = cell.key == py_text_key(value)
    if number is not None:
        same = F.when(cell.number.isNotNull(), F.abs(cell.number - number) < 1e-9).otherwise(same)
    return F.coalesce(same, F.lit(False))


def test(cell: Column | Cell, operator: str, value: str) -> Column:
    """The literal is taken apart here, not in the plan."""
    cell = cell if isinstance(cell, Cell) else Cell.of(cell)
    inside = lambda: reduce(lambda a, b: a | b, (equal(cell, x.strip()) for x in value.split(";") if x.strip()), F.lit(False))
    has = lambda: F.contains(F.coalesce(cell.key, F.lit("")), F.lit(py_text_key(value)))
    over = lambda sign: F.coalesce(cell.number * sign > py_loose_number(value) * sign, F.lit(False)) if py_loose_number(value) is not None else F.lit(False)
    return {
        "igual": lambda: equal(cell, value),
        "diferente": lambda: ~equal(cell, value),
        "esta_em": inside,
        "nao_esta_em": lambda: ~inside(),
        "contem": has,
        "nao_contem": lambda: ~has(),
        "maior_que": lambda: over(1),
        "menor_que": lambda: over(-1),
        "vazio": lambda: is_blank(cell.raw),
        "nao_vazio": lambda: ~is_blank(cell.raw),
    }[operator]()


def resolve(name: str, names: list[str]) -> str | None:
    """The exact name, else the first one with the same key."""
    if name in names:
        return name
    return next((n for n in names if py_column_key(n) == py_column_key(name)), None)


def conditions(rule: Rule, columns: list[str]) -> list[tuple[str, list[tuple[str, str, str]]]] | str:
    """The rule's groups as (link, conditions), with resolved columns; or why it has no mask."""
    groups = []
    for g in rule.grupos:
        found = []
        for c in g.condicoes:
            if not c.coluna.strip():
                continue
            column = resolve(c.coluna, columns)
            if column is None:
                return f"column '{c.coluna}' not found"
            found.append((column, c.operador, c.valor))
        if found:
            groups.append((g.operador, found))
    return groups or "no conditions"


def typed(value: str):
    """Blank is null, integer text an int, decimal text a float, else text."""
    s = value.strip()
    if not s:
        return None
    plain = s.replace(",", ".")
    if plain.lstrip("+-").isdigit():
        return int(plain)
    try:
        return float(plain) if plain.lstrip("+-").replace(".", "", 1).isdigit() else value
    except ValueError:
        return value


def _assigned(kind: T.DataType, value) -> T.DataType:
    """The type of a column after an assignment: a text into a number column makes it text, decided by the literal and the schema alone."""
    if isinstance(value, str) and isinstance(kind, T.NumericType):
        return T.StringType()
    return T.DoubleType() if isinstance(value, float) and isinstance(kind, T.IntegralType) else kind


def _choice(column: str, kind: T.DataType, steps: list[tuple[str, object]]) -> Column:
    """The column after assignments (mask, value) in order. The last one whose mask holds counts; a value follows the later changes of type."""
    kinds = [kind]
    for _, value in steps:
        kinds.append(_assigned(kinds[-1], value))
    follow = lambda c, since: reduce(lambda x, t: x.cast(t), [t for before, t in zip(kinds[since:], kinds[since + 1 :], strict=False) if t != before], c)
    out = None
    for n in range(len(steps), 0, -1):
        mask, value = steps[n - 1]
        literal = follow(F.lit(value).cast(kinds[n]), n)
        out = F.when(F.col(mask), literal) if out is None else out.when(F.col(mask), literal)
    return out.otherwise(follow(F.col(quoted(column)), 0))


@dataclass
class _Layer:
    """Rules of one sheet that see the same state: (mask name, groups, actions)."""

    rules: list[tuple[str, list, list[tuple[str, object]]]] = field(default_factory=list)
    written: set[str] = field(default_factory=set)

    def on(self, df: DataFrame) -> DataFrame:
        every = list(dict.fromkeys(c for _, groups, _ in self.rules for _, found in groups for c in found))
        read = list(dict.fromkeys(c for c, _, _ in every))
        at = {c: i for i, c in enumerate(read)}
        cells = {c: Cell.of(F.col(quoted(c))) for c in read}
        keep = [F.col(quoted(c)) for c in df.columns]
        df = df.select(*keep, *(cells[c].number.alias(f"__n{at[c]}") for c in read), *(cells[c].key.alias(f"__k{at[c]}") for c in read))
        seen = {c: Cell(F.col(quoted(c)), F.col(f"__n{at[c]}"), F.col(f"__k{at[c]}")) for c in read}
        df = df.select(*keep, *(test(seen[c], operator, value).alias(f"__c{i}") for i, (c, operator, value) in enumerate(every)))
        place = {c: F.col(f"__c{i}") for i, c in enumerate(every)}
        folded = lambda link, found: reduce(lambda a, b: a | b if link == "OU" else a & b, (place[c] for c in found))
        df = df.select(*keep, *(reduce(lambda a, b: a & b, (folded(*g) for g in groups)).alias(name) for name, groups, _ in self.rules))
        steps: dict[str, list[tuple[str, object]]] = {}
        for name, _, actions in self.rules:
            for column, value in actions:
                steps.setdefault(column, []).append((name, value))
        kinds = {f.name: f.dataType for f in df.schema}
        return df.select(*(_choice(c, kinds[c], steps[c]).alias(c) if c in steps else F.col(quoted(c)) for c in df.columns))


@dataclass(frozen=True)
class Applied:
    """What a rule did. ``counted`` names its mask in the sheet's ``marks``; none for a rule that was ignored."""

    rule: str
    sheet: str
    note: str
    counted: str | None = None
    marks: DataFrame | None = None

    @property
    def rows(self) -> DataFrame | None:
        """One row: how many rows the rule changed. For all rules of a report at once see ``report_rows``."""
        return self.marks.agg(F.count_if(F.col(self.counted)).alias("rows")) if self.counted else None


def apply(sheets: dict[str, DataFrame], rules: list[Rule]) -> tuple[dict[str, DataFrame], list[Applied]]:
    """The sheets after all active rules, and one report line for each of them. Nothing runs until the frames are used.

    Every mask stays a column beside the sheet until the end, so that a report counts all rules of a sheet in one pass.
    """
    lines: list[tuple[str, str, str, str | None]] = []
    layers: dict[str, list[_Layer]] = {}
    for rule in rules:
        if not rule.ativo:
            continue
        sheet = resolve(rule.aba, list(sheets))
        if sheet is None:
            lines.append((rule.nome, rule.aba, f"sheet '{rule.aba}' not found", None))
            continue
        columns = sheets[sheet].columns
        groups = conditions(rule, columns)
        if isinstance(groups, str):
            lines.append((rule.nome, sheet, groups, None))
            continue
        name, notes, actions = f"__mask_{len(lines)}", [], []
        for a in rule.acoes:
            column = resolve(a.coluna, columns)
            if column is None:
                notes.append(f"column '{a.coluna}' not found")
            else:
                actions.append((column, typed(a.valor)))
        own = layers.setdefault(sheet, [_Layer()])
        if own[-1].written & {c for _, found in groups for c, _, _ in found}:
            own.append(_Layer())
        own[-1].rules.append((name, groups, actions))
        own[-1].written |= {c for c, _ in actions}
        lines.append((rule.nome, sheet, "; ".join(notes), name))
    marked = {s: reduce(lambda df, layer: layer.on(df), own, sheets[s]) for s, own in layers.items()}
    report = [Applied(nome, sheet, note, name, marked[sheet] if name else None) for nome, sheet, note, name in lines]
    return {k: marked[k].select(*map(quoted, v.columns)) if k in marked else v for k, v in sheets.items()}, report


def report_rows(spark: SparkSession, report: list[Applied]) -> DataFrame:
    """rule, sheet, note, changed (rows; null for a rule that was ignored): one aggregate a sheet, whatever the number of rules."""
    parts = [spark.createDataFrame([(r.rule, r.sheet, r.note, None) for r in report if not r.counted], "rule string, sheet string, note string, changed bigint")]
    for sheet in dict.fromkeys(r.sheet for r in report if r.counted):
        own = [r for r in report if r.counted and r.sheet == sheet]
        counts = own[0].marks.agg(*(F.count_if(F.col(r.counted)).alias(r.counted) for r in own))
        parts.append(counts.select(F.inline(F.array(*(F.struct(F.lit(r.rule).alias("rule"), F.lit(r.sheet).alias("sheet"), F.lit(r.note).alias("note"), F.col(r.counted).alias("changed")) for r in own)))))
    return reduce(DataFrame.unionByName, parts)


def describe(rule: Rule) -> str:
    """One line: IF (...) AND (...) THEN column = value."""
    groups = [f" {g.operador} ".join(f"{c.coluna} {c.operador}" + ("" if "vazio" in c.operador else f" '{c.valor}'") for c in g.condicoes if c.coluna.strip()) for g in rule.grupos]
    actions = [f"{a.coluna} = '{a.valor}'" for a in rule.acoes if a.coluna.strip()]
    groups = [f"({g})" for g in groups if g]
    return f"SE {' E '.join(groups)} ENTÃO {', '.join(actions)}" if groups and actions else "(incomplete rule)"


def switched(rule: Rule, active: bool) -> Rule:
    return replace(rule, ativo=active)
