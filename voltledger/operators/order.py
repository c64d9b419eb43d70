"""The order of a table's rows as data: Spark's frames have none, but "the first of equal rows" needs one.

``positioned`` adds a column that sorts rows as they stand in the source. It is computed where the rows are, without moving any:

* given columns, where the order is in the data (a sheet's row number, say);
* file and row number, for a scan of Parquet files (``_metadata.row_index``), whatever splits and partitions Spark reads it in;
* file, place of the split in it, and number in the split, for other files;
* number by partition otherwise (a local list, a frame that was cached or checkpointed). A frame that comes out of a shuffle has no order of its own: position it before.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltledger.schemas import quoted

POSITION = "__position"


def _resolves(df: DataFrame, *names: str) -> bool:
    try:
        df.select(*names)
        return True
    except AnalysisException:
        return False


def positioned(df: DataFrame, by: list[Column | str] | None = None) -> DataFrame:
    """df and POSITION; a frame that has it stays as it is, unless ``by`` is given."""
    if by is not None:
        return df.withColumn(POSITION, F.struct(*by))
    if POSITION in df.columns:
        return df
    if _resolves(df, "_metadata.file_path", "_metadata.row_index"):
        return df.withColumn(POSITION, F.struct("_metadata.file_path", "_metadata.row_index"))
    if _resolves(df, "_metadata.file_path", "_metadata.file_block_start"):
        return df.withColumn(POSITION, F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row")))
    return df.withColumn(POSITION, F.struct(F.monotonically_increasing_id().alias("row")))


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order; null keys equal each other. A minimum with partial aggregation, so that a key with many rows (null, say) is one row a map task."""
    row = F.struct(*(F.col(quoted(c)) for c in df.columns))
    first = df.groupBy(*(k.alias(f"__k{i}") for i, k in enumerate(keys))).agg(F.min_by(row, F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))).alias("__first"))
    return first.select("__first.*")
