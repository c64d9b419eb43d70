"""Display profiles: which sheets and columns are shown, and under which names; and their metadata."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger import schemas
from voltledger.schemas import quoted


@dataclass
class Shown:
    canonico: str
    exibido: str
    incluida: bool = True


@dataclass
class SheetProfile:
    incluida: bool = True
    colunas: list[Shown] = field(default_factory=list)


def null_columns(df: DataFrame, protected: set[str] | frozenset = frozenset(schemas.PROTECTED)) -> list[str]:
    """Columns that are all null, or all blank text; a mix of the two is not. One aggregate over all columns."""
    names = [c for c in df.columns if c not in protected]
    if not names:
        return []
    filled = lambda c: F.trim(F.col(quoted(c)).cast("string")) != ""
    row = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(quoted(c)).alias(f"v{i}") for i, c in enumerate(names)), *(F.count_if(filled(c)).alias(f"t{i}") for i, c in enumerate(names))).first()
    return [c for i, c in enumerate(names) if row[f"v{i}"] == 0 or (row[f"v{i}"] == row.n and row[f"t{i}"] == 0)]


Profile = dict[str, SheetProfile]


def default_profile(sheets: dict[str, DataFrame]) -> Profile:
    """Everything on, but columns without a value and empty sheets; derived sheets are always on, with all columns."""
    out = {}
    for name, df in sheets.items():
        derived = name in schemas.DERIVED_SHEETS
        off = set() if derived else set(null_columns(df))
        out[name] = SheetProfile(derived or not df.isEmpty(), [Shown(c, c, c not in off) for c in df.columns])
    return out


def apply(profile: Profile, sheets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Selected and renamed columns in profile order; a missing column is null; two columns must not share a shown name."""
    out = {}
    for name, p in profile.items():
        if not p.incluida or name not in sheets:
            continue
        on = [c for c in p.colunas if c.incluida]
        names = [c.exibido.strip() or c.canonico for c in on]
        if len(set(names)) < len(names):
            raise ValueError(f"{name}: two columns are shown under one name")
        have = sheets[name].columns
        out[name] = sheets[name].select(*((F.col(quoted(c.canonico)) if c.canonico in have else F.lit(None).cast("string")).alias(n) for c, n in zip(on, names, strict=True)))
    return out


def to_meta(profile: Profile, app: str = "voltledger") -> dict:
    return {"app": app, "versao_meta": 1, "abas": {k: {"incluida": p.incluida, "colunas": [{"exibido": c.exibido.strip() or c.canonico, "canonico": c.canonico, "incluida": c.incluida} for c in p.colunas]} for k, p in profile.items()}}


def from_meta(meta: dict) -> Profile:
    return {k: SheetProfile(v.get("incluida", True), [Shown(c.get("canonico") or c["exibido"], c["exibido"], c.get("incluida", True)) for c in v.get("colunas", [])]) for k, v in meta.get("abas", {}).items()}


def renamed(profile: Profile, sheet: str, canonical: str, shown: str | None = None, included: bool = True) -> Profile:
    """A copy with one column's shown name or inclusion changed; a blank name is the canonical one."""
    p = profile[sheet]
    columns = [Shown(c.canonico, (shown or "").strip() or c.canonico if c.canonico == canonical else c.exibido, included if c.canonico == canonical else c.incluida) for c in p.colunas]
    return {**profile, sheet: SheetProfile(p.incluida, columns)}
