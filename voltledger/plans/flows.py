"""The engine's flows: documents to sheets, append to a workbook, rules on a workbook, reconciliation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltledger.functions.text import file_link
from voltledger.operators import append as appending
from voltledger.operators import derive, glossary, layout_a, layout_b, reconcile, rules, sheets
from voltledger.sources import documents, stores, workbook
from voltledger.sources.documents import Job

#: Extractors by utility; others may be added: path, text (and numero) to the shape of ``layout_a.extract``.
EXTRACTORS = {
    layout_a.SUPPLIER: lambda docs: layout_a.extract(sheets.split_merged(docs)),
    layout_b.SUPPLIER: layout_b.extract,
}


@dataclass
class Parsed:
    """What extraction made of the texts, before duplicates go: the frame that is parsed once, and files that could not be read."""

    extracted: DataFrame
    failed: DataFrame | None = None

    def counters(self) -> DataFrame:
        """counter, n: texts in all, invoices, error rows. One job over the frame that is parsed once, beside whatever reads it; no sheet is computed for it."""
        good, bad = sheets.readable(self.extracted)
        seen = [good.select("path", "id_fatura", F.lit(False).alias("error")), bad.select("path", "id_fatura", F.lit(True).alias("error"))]
        if self.failed is not None:
            seen.append(self.failed.select("path", "id_fatura", F.lit(True).alias("error")))
        named = F.when(~F.col("error"), F.col("id_fatura"))
        nameless = F.count_if(~F.col("error") & F.col("id_fatura").isNull())
        row = reduce(DataFrame.unionByName, seen).agg(F.count_distinct("path").alias("total"), (F.count_distinct(named) + nameless).alias("processed"), F.count_if("error").alias("errors"))
        return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in ("total", "processed", "errors")))))


@dataclass
class Processed:
    sheets: dict[str, DataFrame]
    errors: DataFrame
    report: list[rules.Applied]
    parsed: Parsed | None = None

    def counters(self) -> DataFrame:
        """counter, n: texts in all, invoices, error rows."""
        return self.parsed.counters()

    def release(self) -> None:
        """Gives back what the parsed texts hold in memory, when the sheets have been written."""
        self.parsed.extracted.unpersist()


def extract(texts: DataFrame, suppliers: list[str], held: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one row per invoice id, error rows) of texts(path, fornecedor, text). ``held`` gets the frame that was cached, if any: unpersist it when the results are written."""
    parts = []
    for n, s in enumerate(dict.fromkeys(suppliers)):
        found = EXTRACTORS[s](documents.spread(texts.where(F.col("fornecedor") == s).select("path", "text")))
        parts.append(found.withColumn("job", F.lit(n)))
    every = _once(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts))
    if held is not None:
        held.append(every)
    good, bad = sheets.readable(every)
    return sheets.first_wins(good, ["job", "path"]), bad


def _once(extracted: DataFrame) -> DataFrame:
    """The texts are parsed once for all sheets: a reliable checkpoint where the session has a folder for it, else a cache."""
    if extracted.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        return extracted.persist()
    return extracted.checkpoint()


def base_sheets(extracted: DataFrame) -> dict[str, DataFrame]:
    """The five base sheets with the corrections that come with the package."""
    spark = extracted.sparkSession
    found = sheets.explode_sheets(extracted)
    found["itens_fatura"] = derive.correct_items(found["itens_fatura"], stores.item_corrections(spark))
    found["medicao"] = derive.correct_readings(found["medicao"], stores.reading_corrections(spark))
    return found


def process_texts(texts: DataFrame, suppliers: list[str], equivalences: DataFrame | None = None, user_rules: list[rules.Rule] = (), link: tuple[str, str | None] = ("search", None)) -> Processed:
    """Texts to enriched sheets: extract, correct, derive, enrich, rules."""
    held: list[DataFrame] = []
    extracted, errors = extract(texts, suppliers, held)
    found = sheets.with_derived(base_sheets(extracted))
    found["fatura"] = found["fatura"].withColumn("link_pdf", file_link(F.col("arquivo_pdf"), *link))
    done, report = rules.apply(derive.enrich(found, equivalences), list(user_rules))
    return Processed(done, errors, report, Parsed(held[0]))


def process_folders(spark: SparkSession, jobs: list[Job], decode: documents.Decoder = documents.text_pages, recognise: documents.Decoder | None = None, **options) -> Processed:
    """Folders of documents to enriched sheets; files that can't be read are rows of ``errors``."""
    texts, failed = documents.texts(spark, jobs, decode, recognise)
    done = process_texts(texts, [j.fornecedor for j in jobs], **options)
    return Processed(done.sheets, done.errors.unionByName(failed), done.report, Parsed(done.parsed.extracted, failed))


def append_to(uploaded: dict[str, DataFrame], meta: dict | None, new: dict[str, DataFrame], equivalences: DataFrame | None = None, user_rules: list[rules.Rule] = (), add_columns: bool = False, keep_removed: bool = False, strict: bool = False) -> tuple[dict[str, DataFrame], dict, list[rules.Applied], list[str]]:
    """New canonical sheets onto a workbook's sheets: mapping, append, derived columns, rules."""
    maps = {s: appending.mapping_of_meta(meta, s) or appending.suggest_mapping(s, df.columns) for s, df in uploaded.items()}
    both = appending.append(uploaded, maps, new, add_columns, strict)
    done, report = rules.apply(appending.rederive(both, equivalences, keep_removed), list(user_rules))
    return done, both.meta, report, both.notes


def apply_rules_to_file(spark: SparkSession, source: str, target: str, user_rules: list[rules.Rule]) -> list[rules.Applied]:
    """Rules on a finished workbook (a folder, or one .xlsx file), written to another one of the same kind."""
    if source == target:
        raise ValueError("source and target must differ")
    one_file = source.lower().endswith(".xlsx")
    tables, meta = workbook.read_xlsx(spark, source) if one_file else workbook.read_folder(spark, source)
    done, report = rules.apply(tables, user_rules)
    (workbook.write_xlsx if one_file else workbook.write_folder)(done, target, meta)
    return report


def default_target(path: str) -> str:
    """name.ext -> name_hardcodes.ext"""
    stem, dot, ext = path.rpartition(".")
    return f"{stem}_hardcodes.{ext}" if dot and "/" not in ext else f"{path}_hardcodes"


def reconcile_workbook(tables: dict[str, DataFrame], tolerance: float = reconcile.TOLERANCE) -> dict[str, DataFrame]:
    """Summary and both lists of differences, as the sheets of a report."""
    totals = reconcile.totals(tables["impostos"], tables["itens_fatura"], tables["fatura"])
    return {"Resumo": reconcile.summary(totals, tolerance), "Impostos_divergencias": reconcile.tax_differences(totals, tolerance), "Total_divergencias": reconcile.total_differences(totals, tolerance)}


def write_report(tables: dict[str, DataFrame], target: str, tolerance: float = reconcile.TOLERANCE) -> None:
    """The report of a reconciliation as a workbook (a folder, or one .xlsx file): the summary, and what differs, the largest differences first. An empty list has no sheet."""
    found = reconcile_workbook(tables, tolerance)
    lists = {k: v.orderBy(F.desc(F.abs("diferenca")), "id_fatura") for k, v in found.items() if k != "Resumo" and not v.isEmpty()}
    (workbook.write_xlsx if target.lower().endswith(".xlsx") else workbook.write_folder)({"Resumo": found["Resumo"], **lists}, target)


def finished(spark: SparkSession, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return glossary.with_glossary(tables, glossary.glossary(spark))


def health() -> dict[str, bool]:
    """Which optional decoders can be imported here."""
    from importlib.util import find_spec

    return {name: find_spec(name) is not None for name in ("pdfplumber", "fitz", "pytesseract")}
