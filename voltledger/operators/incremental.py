"""Derived columns after an append, by the keys that the new rows touch.

What enrichment needs of all rows are four small tables that can be merged: a unit's first and last invoice, a meter's latest reading, and
how often a meter occurs in an invoice and in a unit. ``facts`` takes them from rows, ``merged`` adds those of new rows to those of the old ones, and ``refreshed``
computes the derived columns of old rows again only where a fact that they depend on has changed. Old readings are never read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.operators import derive
from voltledger.operators.sheets import Sheets
from voltledger.schemas import conform, quoted

Facts = dict[str, DataFrame]
#: By table: its key.
KEYS = {"ends": ["id_uc"], "latest": ["medidor"], "invoice_meters": ["id_fatura", "__meter"], "unit_meters": ["id_uc", "__meter"]}


def facts(sheets: Sheets) -> Facts:
    """The tables of some rows: small beside them, and partial sums until they are merged."""
    read = sheets["medicao"]
    return {"ends": derive.unit_ends(sheets["fatura"]), "latest": derive.meter_latest(read), "invoice_meters": derive.value_counts(read, "id_fatura", "Medidor", "__meter"), "unit_meters": derive.value_counts(read, "id_uc", "Medidor", "__meter")}


def merged(old: Facts, new: Facts) -> Facts:
    """The tables of old and new rows together. ``new`` must come from rows that ``old`` has not seen."""
    by = {"ends": [F.min("a").alias("a"), F.max("b").alias("b")], "latest": [F.max("m").alias("m")], "invoice_meters": [F.sum("n").alias("n")], "unit_meters": [F.sum("n").alias("n")]}
    return {t: old[t].unionByName(new[t]).groupBy(*KEYS[t]).agg(*by[t]) for t in KEYS}


def _columns(found: Facts) -> Facts:
    """The tables as ``derive.enrich`` takes them."""
    return {"ends": found["ends"], "latest": found["latest"].select("medidor", F.col("m.u").alias("uc")), "of_invoice": derive.most_frequent(found["invoice_meters"], "id_fatura", "__meter"), "of_unit": derive.most_frequent(found["unit_meters"], "id_uc", "__meter")}


def _changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose row is new or differs. ``after`` is cut down to the keys that new rows touch before."""
    return after.exceptAll(before).select(key).distinct()


def refreshed(old: Sheets, new: Sheets, before: Facts, added: Facts, equivalences: DataFrame | None = None) -> tuple[Sheets, Facts]:
    """(sheets, facts) after an append. ``old``: enriched sheets and their facts ``before``; ``new``: canonical rows that are not there yet, without derived columns, and their facts ``added``.

    Old rows that no changed fact concerns are passed on as they are.
    """
    after = merged(before, added)
    # only keys with new facts can change
    touched = lambda t, key: added[t].select(key).distinct()
    part = lambda found, t, key: found[t].join(touched(t, key), key, "left_semi")
    now, then = _columns(after), _columns({t: part(before, t, k[0]) for t, k in KEYS.items()})
    only = _columns({t: part(after, t, k[0]) for t, k in KEYS.items()})
    ends, units, meters = (_changed(then[t], only[t], k) for t, k in (("ends", "id_uc"), ("of_unit", "id_uc"), ("latest", "medidor")))
    rest, redo = {}, {}
    for name, df in old.items():
        if "id_uc" not in df.columns:
            rest[name] = df
            continue
        if name == "unidade_consumidora":
            concerned = ends.union(units).union(before["unit_meters"].join(meters.withColumnRenamed("medidor", "__meter"), "__meter", "left_semi").select("id_uc")).distinct()
            on = "id_uc"
        elif name in ("medicao", "medicao_resumida"):
            concerned, on = meters.select(F.col("medidor").alias("__meter")), "Medidor"
        else:
            # an invoice's own meters never change: its readings come with it
            concerned, on = before["invoice_meters"].join(meters.withColumnRenamed("medidor", "__meter"), "__meter", "left_semi").select("id_fatura").distinct(), "id_fatura"
        mark = concerned.select(F.col(concerned.columns[0]).alias("__hit"))
        match = F.col(quoted(on)).cast("string") == F.col("__hit")
        rest[name], redo[name] = df.join(mark, match, "left_anti"), df.join(mark, match, "left_semi")
    every = {n: new[n] if n not in redo else redo[n].unionByName(new[n], allowMissingColumns=True) if n in new else redo[n] for n in {**new, **redo}}
    done = derive.enrich({n: every[n] for n in [*old, *(n for n in new if n not in old)] if n in every}, equivalences, facts=now)
    out = {}
    for name in [*old, *(n for n in new if n not in old)]:
        parts = [x[name] for x in (rest, done) if name in x]
        out[name] = conform(parts[0].unionByName(parts[1], allowMissingColumns=True) if len(parts) > 1 else parts[0], name, fill=False) if name in done else parts[0]
    if "unidade_consumidora" in out:
        out["unidade_consumidora"] = out["unidade_consumidora"].distinct()
    return out, after
