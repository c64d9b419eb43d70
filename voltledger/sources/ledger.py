"""A workbook that grows: sheets in buckets by id, and versions that name the files of each bucket.

``data/<segment>/<sheet>/bucket=<n>`` holds the rows that one write added; ``versions/<n>.json`` names, for every sheet, the segments of each
bucket. It is small (buckets times segments) and written last, in one step that fails if the version exists: a write that fails half way leaves files
that no version names, all sheets change together, and readers of an older version keep theirs.

An append reads the keys of the buckets that new rows fall into, and nothing else; it adds files and rewrites none. A bucket that has gathered many
segments is rewritten by ``compact``; the others keep their files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltledger import schemas
from voltledger.operators.order import POSITION, keep_first, positioned
from voltledger.schemas import quoted

BUCKETS = 64


def _key(sheet: str, columns: list[str]) -> str:
    """The column that decides the bucket of a row."""
    return next(c for c in ("id_fatura", "id_uc", *columns) if c in columns)


class Ledger:
    """Sheets have canonical names. ``buckets`` counts when the first version is written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # ---- Versions

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), where

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []

    def versions(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/versions") if n.endswith(".json") and n[0] != ".")

    def manifest(self, version: int | None = None) -> dict | None:
        """The newest version, or the given one; None before the first write."""
        every = self.versions()
        if not every:
            return None
        fs, where = self._fs(f"{self.path}/versions/{every[-1] if version is None else version:08d}.json")
        stream = fs.open(where)
        try:
            return json.loads(bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> int:
        """Write under a name of its own, then rename: readers never see a part of it, and of two writers of one version the second fails."""
        version = manifest["version"]
        fs, draft = self._fs(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(json.dumps(manifest, ensure_ascii=False).encode())
        out.close()
        _, target = self._fs(f"{self.path}/versions/{version:08d}.json")
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} was written by someone else: read it and try again")
        return version

    # ---- Segments

    def _bucket(self, column: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(quoted(column))), F.lit(buckets)).cast("int")

    def _write(self, segment: str, sheet: str, df: DataFrame, key: str, buckets: int) -> list[str]:
        """The buckets written. Rows are rebalanced by bucket: few files, and a hot bucket is split over tasks and files."""
        folder = f"{self.path}/data/{segment}/{sheet}"
        df.drop(POSITION).withColumn("bucket", self._bucket(key, buckets)).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
        return [n.removeprefix("bucket=") for n in self._names(folder) if n.startswith("bucket=")]

    def _read(self, sheet: str, info: dict, only: set[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/data/{s}/{sheet}/bucket={b}" for b, segments in info["segments"].items() if only is None or b in only for s in segments]
        schema = T.StructType.fromJson(info["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- Use

    def read(self, version: int | None = None) -> tuple[dict[str, DataFrame], dict | None]:
        """All sheets of one version, and its metadata."""
        manifest = self.manifest(version)
        return ({s: self._read(s, i) for s, i in manifest["sheets"].items()}, manifest["meta"]) if manifest else ({}, None)

    def write(self, sheets: dict[str, DataFrame], meta: dict | None = None) -> int:
        """A version with these sheets and no others."""
        now = self.manifest() or {"version": 0, "buckets": self.buckets}
        segment = f"{now['version'] + 1:08d}-{uuid.uuid4().hex}"
        found = {}
        for name, df in sheets.items():
            key = _key(name, df.columns)
            found[name] = {"key": key, "schema": df.drop(POSITION).schema.jsonValue(), "segments": {b: [segment] for b in self._write(segment, name, df, key, now["buckets"])}}
        return self._commit({"version": now["version"] + 1, "buckets": now["buckets"], "meta": meta, "sheets": found})

    def append(self, new: dict[str, DataFrame], meta: dict | None = None) -> int:
        """A version with the rows that are not there yet: by the sheet's key, the first of equal ones; items and readings by their invoice, equal rows once.

        Keys that are known are found by a semi join of the old keys with the new ones, in the buckets that the new rows fall into: small batches
        are broadcast, for large ones Spark filters the old side by a bloom filter of the new keys (its runtime filters) before it shuffles keys.
        """
        now = self.manifest()
        if now is None:
            now = {"version": 0, "buckets": self.buckets, "meta": None, "sheets": {}}
        segment = f"{now['version'] + 1:08d}-{uuid.uuid4().hex}"
        sheets = dict(now["sheets"])
        for name, df in new.items():
            info = sheets.get(name)
            schema = T.StructType.fromJson(info["schema"]) if info else df.drop(POSITION).schema
            key = info["key"] if info else _key(name, schema.names)
            rows = positioned(df)
            laid = rows.select(*((F.col(quoted(f.name)) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema), POSITION)
            whole = name in schemas.FULL_ROW or name not in schemas.DEDUP_KEYS
            by = [key] if whole else schemas.DEDUP_KEYS[name]
            columns = [f.name for f in schema] if whole else by
            laid = keep_first(laid, [F.col(quoted(c)) for c in columns], [F.col(POSITION)]).drop(POSITION)
            if info and info["segments"]:
                touched = {str(r[0]) for r in laid.select(self._bucket(key, now["buckets"])).distinct().collect()}  # at most as many as buckets
                mine = laid.select(*(F.col(quoted(c)).alias(f"__n{i}") for i, c in enumerate(by))).distinct()
                old = self._read(name, info, touched).select(*(F.col(quoted(c)).alias(f"__o{i}") for i, c in enumerate(by)))
                same = lambda a, b: [F.col(f"{a}{i}").eqNullSafe(F.col(f"{b}{i}")) for i in range(len(by))]
                known = old.join(mine, same("__o", "__n"), "left_semi").distinct()
                laid = laid.join(known, [F.col(quoted(c)).eqNullSafe(F.col(f"__o{i}")) for i, c in enumerate(by)], "left_anti")
            segments = {b: list(s) for b, s in (info["segments"] if info else {}).items()}
            for b in self._write(segment, name, laid, key, now["buckets"]):
                segments.setdefault(b, []).append(segment)
            sheets[name] = {"key": key, "schema": schema.jsonValue(), "segments": segments}
        return self._commit(now | {"version": now["version"] + 1, "meta": now["meta"] if meta is None else meta, "sheets": sheets})

    def compact(self, most: int = 8) -> int | None:
        """Rewrites the buckets with more than ``most`` segments; the files of the others stay. None if there are none."""
        now = self.manifest()
        crowded = {s: {b for b, found in i["segments"].items() if len(found) > most} for s, i in now["sheets"].items()} if now else {}
        if not any(crowded.values()):
            return None
        segment = f"{now['version'] + 1:08d}-{uuid.uuid4().hex}"
        for sheet, buckets in crowded.items():
            if buckets:
                info = now["sheets"][sheet]
                self._write(segment, sheet, self._read(sheet, info, buckets), info["key"], now["buckets"])
                info["segments"] |= {b: [segment] for b in buckets}
        return self._commit(now | {"version": now["version"] + 1})

    def vacuum(self, keep: int = 2) -> list[str]:
        """Removes versions but the newest ``keep``, and segments that none of these names; those of a write that is under way count as named by none."""
        every = self.versions()
        fs, _ = self._fs(self.path)
        for v in every[:-keep]:
            fs.delete(self._fs(f"{self.path}/versions/{v:08d}.json")[1], False)
        used = {s for v in every[-keep:] for i in self.manifest(v)["sheets"].values() for found in i["segments"].values() for s in found}
        gone = [s for s in self._names(f"{self.path}/data") if s not in used]
        for s in gone:
            fs.delete(self._fs(f"{self.path}/data/{s}")[1], True)
        return gone
