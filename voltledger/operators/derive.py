"""Enrichment: first and last per unit, meter by mode, current unit per meter, normalised items, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voltledger.functions.text import blank_to_null, tight_key, without_format
from voltledger.operators.sheets import Sheets
from voltledger.schemas import conform, quoted


METER_COLUMNS = ("medidor", "id_uc_atual", "id_uc_sem_format", "id_uc_atual_medidor", "id_uc_atual_medidor_sem_format")


#: Large tables that are joined by a key are dealt into partitions of about so many bytes, by Spark's estimate.
DEALT_BYTES = 4 << 20


def dealt(key: str, *tables: DataFrame) -> list[DataFrame]:
    """The tables in equally many partitions by the key, as many as the largest needs; small ones as they are.

    Spark gathers exchanged rows into partitions of 64 MB as written, which are many times that while a task sorts and groups them. It goes by Spark's estimate of the
    plans' sizes, so nothing runs: give it scans and not joins, whose estimates are products."""
    size = max(int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) for df in tables)
    n = size // DEALT_BYTES
    return [df.repartition(n, key) for df in tables] if n > tables[0].sparkSession.sparkContext.defaultParallelism else list(tables)


def value_counts(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """key, out, n: how often each value that is not null occurs, compared as text. Counts of parts can be added."""
    return df.where(F.col(quoted(value)).isNotNull()).groupBy(key, F.col(quoted(value)).cast("string").alias(out)).agg(F.count(F.lit(1)).alias("n"))


def most_frequent(counts: DataFrame, key: str, out: str) -> DataFrame:
    """key, out: the value with the highest count, the smallest of equals."""
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(out))).alias("__m")).select(key, F.col(f"__m.{out}").alias(out))


def mode(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """key, out: the most frequent value that is not null, the smallest of equals (compared as text).

    Counts are partial per map task; the second aggregate sees one row per key and value.
    """
    return most_frequent(value_counts(df, key, value, out), key, out)


def unit_ends(invoices: DataFrame) -> DataFrame:
    """id_uc, a, b: the first and the last invoice of a unit. A null month sorts after all months; ties go by id_fatura. Ends of parts can be merged."""
    at = F.struct(F.coalesce("competencia", F.lit("None")).alias("k"), F.col("id_fatura").alias("f"), F.col("competencia").alias("m"))
    return invoices.where("id_uc is not null").groupBy("id_uc").agg(F.min(at).alias("a"), F.max(at).alias("b"))


def ends_columns(ends: DataFrame) -> DataFrame:
    return ends.select("id_uc", F.col("a.m").alias("primeira_competencia"), F.col("b.m").alias("ultima_competencia"), F.col("a.f").alias("primeira_fatura"), F.col("b.f").alias("ultima_fatura"))


def first_and_last(invoices: DataFrame) -> DataFrame:
    """id_uc, primeira/ultima_competencia, primeira/ultima_fatura."""
    return ends_columns(unit_ends(invoices))


def meter_latest(readings: DataFrame) -> DataFrame:
    """medidor, m: the latest reading of a meter, by month and invoice; placeholder units don't count. Parts can be merged."""
    known = readings.where("Medidor is not null and id_uc is not null and not startswith(id_uc, 'NULO_')")
    at = F.struct(F.coalesce("competencia", F.lit("None")).alias("k"), F.col("id_fatura").alias("f"), F.col("id_uc").alias("u"))
    return known.groupBy(F.col("Medidor").cast("string").alias("medidor")).agg(F.max(at).alias("m"))


def current_unit(readings: DataFrame) -> DataFrame:
    """medidor, uc: the unit of a meter's latest month."""
    return meter_latest(readings).select("medidor", F.col("m.u").alias("uc"))


def _replace(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns({k: v for k, v in columns.items()})


def with_meters(sheets: Sheets, facts: dict[str, DataFrame] | None = None) -> Sheets:
    """medidor of invoices; id_uc_atual of all sheets but the registry, which gets three columns.

    ``facts``: of_invoice (id_fatura, __meter), of_unit (id_uc, __meter) and latest (medidor, uc), where they are not to be taken from the readings here."""
    read = sheets["medicao"]
    facts = facts or {"of_invoice": mode(read, "id_fatura", "Medidor", "__meter"), "of_unit": mode(read, "id_uc", "Medidor", "__meter"), "latest": current_unit(read)}
    of_invoice, of_unit, latest = facts["of_invoice"], facts["of_unit"], facts["latest"]
    latest = latest.select(F.col("medidor").alias("__key"), F.col("uc").alias("__uc"))
    out = {}
    for name, df in sheets.items():
        if "id_uc" not in df.columns:
            out[name] = df
            continue
        base = df.select(*(quoted(c) for c in df.columns if c not in METER_COLUMNS))  # drop() would take Medidor for medidor
        if name == "unidade_consumidora":
            rows = base.join(of_unit, "id_uc", "left")
        elif name in ("medicao", "medicao_resumida"):
            rows = base.withColumn("__meter", F.col("Medidor").cast("string"))
        else:
            rows = base.join(of_invoice, "id_fatura", "left")
        # rows without a meter match nothing: each gets one of many keys of its own kind, so that they don't meet in one task
        nowhere = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*(c for c in ("id_fatura", "id_uc") if c in rows.columns)), F.lit(4096)).cast("string"))
        rows = rows.join(latest, F.coalesce("__meter", nowhere) == F.col("__key"), "left")
        unit = F.coalesce("__uc", "id_uc")
        if name == "unidade_consumidora":
            rows = _replace(rows, id_uc_sem_format=without_format(F.col("id_uc")), id_uc_atual_medidor=unit, id_uc_atual_medidor_sem_format=without_format(unit))
        else:
            rows = _replace(rows, id_uc_atual=without_format(unit))
            if name in ("fatura", "fatura_resumida"):
                rows = _replace(rows, medidor=F.col("__meter"))
        out[name] = rows.drop("__meter", "__key", "__uc")
    return out


def normalised_items(items: DataFrame, table: DataFrame | None, column: str = "item_normalizado") -> DataFrame:
    """The item's name from the equivalence table (item, item_normalizado), compared trimmed and in upper case; the last entry counts; else the item."""
    if table is None:
        return items.withColumn(column, F.col("item"))
    w = W.partitionBy("__key").orderBy(F.desc("__pos"))
    rows = table.withColumn("__pos", F.monotonically_increasing_id()) if "pos" not in table.columns else table.withColumn("__pos", F.col("pos"))
    rows = rows.select(F.upper(F.trim("item")).alias("__key"), blank_to_null(F.col("item_normalizado")).alias("__to"), "__pos").where("__to is not null")
    last = rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").select("__key", "__to")
    joined = items.join(last, F.upper(F.trim(items["item"])) == F.col("__key"), "left")
    return joined.withColumn(column, F.coalesce("__to", "item")).drop("__key", "__to")


def correct_items(items: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections: id_fatura, item_estranho, item_correto; matched by invoice and by name without accents and spaces."""
    table = corrections.select(F.col("id_fatura").alias("__f"), tight_key(F.col("item_estranho")).alias("__k"), F.col("item_correto").alias("__to")).dropDuplicates(["__f", "__k"])
    joined = items.join(table, (F.col("id_fatura") == F.col("__f")) & (tight_key(F.col("item")) == F.col("__k")), "left")
    return joined.withColumn("item", F.coalesce("__to", "item")).drop("__f", "__k", "__to")


def correct_readings(readings: DataFrame, corrections: DataFrame) -> DataFrame:
    """corrections: id_fatura, Grandezas, Postos horarios and new values; the match decides, so that a new value may be 0 or null."""
    values = [c for c in ("Leitura Anterior", "Leitura Atual", "Const Medidor", "Consumo kWh") if c in corrections.columns]
    table = corrections.select(F.col("id_fatura").alias("__f"), tight_key(F.col("Grandezas")).alias("__g"), tight_key(F.col(quoted("Postos horarios"))).alias("__p"), *(F.col(quoted(c)).alias(f"__{i}") for i, c in enumerate(values)), F.lit(True).alias("__hit"))
    table = table.dropDuplicates(["__f", "__g", "__p"])
    on = (F.col("id_fatura") == F.col("__f")) & (tight_key(F.col("Grandezas")) == F.col("__g")) & (tight_key(F.col(quoted("Postos horarios"))) == F.col("__p"))
    joined = readings.join(table, on, "left")
    new = {c: F.when(F.col("__hit"), F.col(f"__{i}").cast(readings.schema[c].dataType)).otherwise(F.col(quoted(c))) for i, c in enumerate(values)}
    return joined.withColumns(new).select(*map(quoted, readings.columns))


def enrich(sheets: Sheets, equivalences: DataFrame | None = None, one_row_per_uc: bool = False, facts: dict[str, DataFrame] | None = None) -> Sheets:
    """All derived columns, canonical order, and the registry without equal rows.

    The registry keeps several rows of a unit if they differ, unless ``one_row_per_uc``. ``facts``: as in ``with_meters``, and ends (as from ``unit_ends``).
    """
    out = dict(sheets)
    if {"unidade_consumidora", "fatura"} <= set(out):
        registry = out["unidade_consumidora"].drop("primeira_competencia", "ultima_competencia", "primeira_fatura", "ultima_fatura")
        out["unidade_consumidora"] = registry.join(ends_columns(facts["ends"] if facts else unit_ends(out["fatura"])), "id_uc", "left")
    if "medicao" in out:
        out = with_meters(out, facts)
    if "itens_fatura" in out:
        out["itens_fatura"] = normalised_items(out["itens_fatura"].drop("item_normalizado"), equivalences)
    for name in ("fatura", "fatura_resumida"):
        if name in out:
            out[name] = out[name].withColumn("tipo_fornecimento", F.upper("tipo_fornecimento"))
    out = {k: conform(v, k, fill=False) for k, v in out.items()}
    if "unidade_consumidora" in out:
        registry = out["unidade_consumidora"].distinct()
        out["unidade_consumidora"] = registry.dropDuplicates(["id_uc"]) if one_row_per_uc else registry
    return out


def allocate_taxes(items: DataFrame, taxes: DataFrame) -> DataFrame:
    """Table form of the allocation: PIS and COFINS spread over an invoice's supply items by value; the first largest takes the rest.

    items: id_fatura, pos, tipo, valor_r$, pis_cofins, icms; taxes: id_fatura, Tributo, Valor (R$). Columns must be decimals or doubles.
    """
    by = W.partitionBy("id_fatura")
    takes = (F.col("tipo") == "FORNECIMENTO") & (F.col("`valor_r$`") > 0)
    due = taxes.where("upper(Tributo) in ('PIS/PASEP', 'COFINS')").groupBy("id_fatura").agg(F.round(F.sum(quoted("Valor (R$)")), 2).alias("__due"))
    rows = items.join(due, "id_fatura", "left").withColumns({
        "__base": F.sum(F.when(takes, F.col("`valor_r$`"))).over(by),
        "__printed": F.sum(F.coalesce("pis_cofins", F.lit(0)) + F.coalesce("icms", F.lit(0))).over(by),
        "__rank": F.row_number().over(by.orderBy(F.desc(F.when(takes, F.col("`valor_r$`"))), "pos")),
    })
    active = takes & (F.abs("__printed") <= 0.005) & (F.col("__due") > 0.005)
    rows = rows.withColumn("__share", F.when(active, F.round(F.col("__due") * F.col("`valor_r$`") / F.col("__base"), 2)))
    others = F.sum(F.when(F.col("__rank") > 1, F.col("__share"))).over(by)
    final = F.when(F.col("__share").isNull(), F.col("pis_cofins")).when(F.col("__rank") == 1, F.round(F.col("__due") - F.coalesce(others, F.lit(0)), 2)).otherwise(F.col("__share"))
    return rows.withColumn("pis_cofins", final).drop("__due", "__base", "__printed", "__rank", "__share")
