"""Document scans: folders of files to (path, fornecedor, pages, text)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Decoder = Callable[[bytes], list[str]]

# What a useful page of layout A starts with, and what a body of layout B contains.
ANCHOR_A = "(?iu)^ENDERE[ÇC]O DE ENTREGA:"
BODY_B = "(?iu)TOTAL A PAGAR|Itens de fatura"
LEAST_CHARS = 100


@dataclass(frozen=True)
class Job:
    """A folder of one utility's documents."""

    folder: str
    fornecedor: str
    recursive: bool = False
    glob: str = "*.[pP][dD][fF]"


def files(spark: SparkSession, jobs: list[Job]) -> DataFrame:
    """path, length, content, fornecedor, job: the files of all jobs; the extension matches in any case."""
    scans = [spark.read.format("binaryFile").option("pathGlobFilter", j.glob).option("recursiveFileLookup", str(j.recursive).lower()).load(j.folder).select("path", "length", "content", F.lit(j.fornecedor).alias("fornecedor"), F.lit(n).alias("job")) for n, j in enumerate(jobs)]
    return reduce(DataFrame.unionByName, scans)


#: Texts that Spark estimates below so many bytes a core are dealt over all cores.
SPREAD_BYTES = 32 << 20


def spread(docs: DataFrame) -> DataFrame:
    """A few texts in a few partitions are dealt over all cores: extraction costs much more than moving them. Large tables stay as they are read.

    It goes by Spark's estimate of the plan's size, so nothing runs."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < cores * SPREAD_BYTES else docs


def count(spark: SparkSession, jobs: list[Job]) -> int:
    """Number of files; no content is read."""
    return files(spark, jobs).select("path").count()


def text_pages(content: bytes) -> list[str]:
    """Decoder of plain text: pages are separated by form feeds."""
    return content.decode("utf-8").split("\f")


def decoded(scan: DataFrame, decode: Decoder = text_pages, recognise: Decoder | None = None) -> DataFrame:
    """scan's columns without content, and pages, recognised (array<string>) and error.

    ``decode`` turns a file into page texts; ``recognise`` (optical recognition) runs only where these are too short or have no body.
    Both run on the executors, a file at a time; a failing file becomes an error row and stops nothing.
    """
    import pandas as pd

    def nfc(pages: list[str]) -> list[str]:
        return [unicodedata.normalize("NFC", p or "").replace("\xa0", " ") for p in pages]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for content, need in zip(frame["content"], frame["fornecedor"], strict=True):
                pages, extra, error = [], [], None
                try:
                    pages = nfc(decode(content))
                    text = "\n".join(pages)
                    if len(text.strip()) < LEAST_CHARS and recognise is None:
                        error = None if text.strip() else "no text, and optical recognition is not available"
                    elif recognise is not None and len(text.strip()) < LEAST_CHARS:
                        extra = nfc(recognise(content))
                except Exception as e:  # noqa: BLE001  any decoder's failure is that file's error
                    error = f"{type(e).__name__}: {e}"
                rows.append((pages, extra, error, need))
            yield frame.drop(columns=["content"]).assign(pages=[r[0] for r in rows], recognised=[r[1] for r in rows], error=[r[2] for r in rows])

    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scan.schema if f.name != "content")
    return scan.mapInPandas(run, f"{columns}, pages array<string>, recognised array<string>, error string")


def text_a(pages: Column, recognised: Column) -> Column:
    """Useful pages, else all; below the least length the recognised pages."""
    useful = F.filter(pages, lambda p: F.trim(p).rlike(ANCHOR_A))
    text = F.array_join(F.when(F.size(useful) > 0, useful).otherwise(pages), "\n")
    return F.when((F.length(F.trim(text)) >= LEAST_CHARS) | (F.size(recognised) == 0), text).otherwise(F.array_join(recognised, "\n"))


def text_b(pages: Column, recognised: Column) -> Column:
    """The first page if it has the body, else all pages; else these with the recognised ones behind them."""
    whole = lambda t: (F.length(t) >= LEAST_CHARS) & t.rlike(BODY_B)
    some = lambda a: F.array_join(F.filter(a, lambda p: F.trim(p) != ""), "\n")
    first, every, extra = F.coalesce(F.try_element_at(pages, F.lit(1)), F.lit("")), some(pages), some(recognised)
    mixed = F.when(F.trim(every) == "", extra).otherwise(F.concat_ws("\n", every, extra))
    return F.when(whole(first), first).when(whole(every) | (F.size(recognised) == 0), every).otherwise(mixed)


def texts(spark: SparkSession, jobs: list[Job], decode: Decoder = text_pages, recognise: Decoder | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, fornecedor, job, text; error rows path, error)."""
    pages = decoded(files(spark, jobs), decode, recognise)
    text = F.when(F.col("fornecedor") == "CHESP", text_b(F.col("pages"), F.col("recognised"))).otherwise(text_a(F.col("pages"), F.col("recognised")))
    return pages.where("error is null").select("path", "fornecedor", "job", text.alias("text")), pages.where("error is not null").select("path", F.lit(None).cast("string").alias("id_fatura"), "error")
