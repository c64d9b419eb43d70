"""Operator 13: exact k-means with clusters as balls.

Components are integers, floor(``scale`` * x), so every distance, sum and mean is exact and the result does not depend on how rows are
partitioned. A cluster is a ball: its centroid, and a bound of the distance of its members from it. For each round

1. two balls are neighbours if half the distance of their centroids is within the radius; other centroids are never looked at;
2. a member closer to its centroid than half the way to the nearest neighbour centroid lies in the stable core and stays;
3. the other members lie in annuli, bounded by half the distances to the neighbours in ascending order: a member of the n-th annulus is
   compared exactly with the n nearest neighbour centroids and no others.

The vectors are written once, each with the number of the ball it was in then. A round is one pass over that table: per partition the sums,
counts, radii and inertias of each cluster, added up by Spark; k times ``dims`` numbers come to the driver. A ball of the table stays valid
while centroids move (its radius is measured against the moved centroid in the pass itself, and grows by the next move at most), so the table is written
anew only when more than ``stale`` of the members have left the ball they were written with. The older table is removed then.

Defined results: a null vector, one of another size, and one with a null or non-finite component take no part; a null vec_id is clustered but starts no
centroid; rows that repeat a vec_id are vectors of their own (of equal hashes the smaller vector starts the first centroid); components
beyond ``LIMIT`` count as ``LIMIT``, which keeps a squared distance within a long; sums of distances stop at the largest long;
with fewer vectors than k there are as many centroids as vectors; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltledger.llm.shared import new_path, remove

K, ROUNDS, DIMS, SCALE, SALT = 8, 10, 64, 1024, "3:"
#: Share of the members that have left their ball at which the table is written again.
STALE = 0.1
LIMIT = 1 << 27
_LONG = (1 << 63) - 1


def _integers(values: np.ndarray, dims: int, scale: int) -> np.ndarray:
    return np.clip(np.floor(scale * values.astype(np.float64)), -LIMIT, LIMIT).astype("<i4").reshape(-1, dims)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x.astype(np.int64) - c
    return np.einsum("ij,ij->i", d, d)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid, by comparing all; ties: the smaller number."""
    return np.stack([_squared(x, c) for c in centroids]).argmin(0).astype(np.int32)


def neighbours(centroids: np.ndarray, radii: list[int | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each ball the neighbour centroids, nearest first, and the squared distance from its centroid at which their annulus begins.

    ``radii``: a bound of the members' distance, rounded up; None where it is not known."""
    out = []
    c = [[int(v) for v in row] for row in centroids]
    for i, own in enumerate(c):
        near = []
        for j, other in enumerate(c):
            apart = sum((a - b) ** 2 for a, b in zip(own, other, strict=True))
            if j != i and (radii[i] is None or apart <= 4 * radii[i] ** 2):
                near.append((-(-apart // 4), j))
        near.sort()
        out.append((np.array([d for d, _ in near], np.int64), np.array([j for _, j in near], np.int32)))
    return out


def assign(x: np.ndarray, ball: np.ndarray, centroids: np.ndarray, near: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance from it, squared distance from the own ball's centroid) of each vector."""
    own = _squared(x, centroids[ball])
    label, best = ball.copy(), own.copy()
    for i in np.unique(ball).tolist():
        rows = np.flatnonzero(ball == i)
        begins, others = near[i]
        annulus = np.searchsorted(begins, own[rows], "right")  # 0: stable core
        for n in range(int(annulus.max())):
            r = rows[annulus > n]
            d = _squared(x[r], centroids[others[n]])
            better = (d < best[r]) | ((d == best[r]) & (others[n] < label[r]))
            label[r[better]], best[r[better]] = others[n], d[better]
    return label, best, own


def _vectors(batch: pa.RecordBatch, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and balls of a batch of the written table."""
    column = batch.column(1).cast(pa.large_binary())
    raw = np.frombuffer(column.buffers()[2], np.uint8)
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset]
    x = raw[at : at + batch.num_rows * dims * 4].view("<i4") if at % 4 == 0 else raw[at : at + batch.num_rows * dims * 4].copy().view("<i4")
    return x.reshape(-1, dims), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int32)


def _batch_total(d: np.ndarray) -> int:
    return int(d.sum()) if not len(d) or int(d.max()) < _LONG // len(d) else sum(d.tolist())


def _pass(table: DataFrame, centroids: np.ndarray, near: list, dims: int) -> dict[str, list]:
    """Per cluster: vector sums, members, inertia, squared radius; squared radius of the written balls; how many left their ball."""
    k = len(centroids)

    def measure(batches):
        sums, count, inertia = np.zeros((k, dims), np.int64), np.zeros(k, np.int64), [0] * k
        radius, held, left = np.full(k, -1, np.int64), np.full(k, -1, np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, ball = _vectors(batch, dims)
            label, best, own = assign(x, ball, centroids, near)
            left += int((label != ball).sum())
            np.maximum.at(held, ball, own)
            for j in np.unique(label).tolist():
                mine = label == j
                sums[j] += x[mine].sum(0, dtype=np.int64)
                count[j] += int(mine.sum())
                inertia[j] += _batch_total(best[mine])
                radius[j] = max(radius[j], int(best[mine].max()))
        rows = [(j, s, str(v)) for j in range(k) if count[j] for s, v in [*enumerate(sums[j].tolist()), (dims, count[j]), (dims + 1, inertia[j]), (dims + 2, radius[j])]]
        rows += [(j, dims + 3, str(v)) for j, v in enumerate(held.tolist()) if v >= 0] + [(0, dims + 4, str(left))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)], ["cluster", "slot", "value"])

    value = F.col("value").cast("decimal(38,0)")
    parts = table.mapInArrow(measure, "cluster int, slot int, value string").groupBy("cluster", "slot").agg(F.sum(value).alias("total"), F.max(value).alias("top"))
    got = {(r.cluster, r.slot): r for r in parts.collect()}  # k * (dims + 4) rows
    total = lambda j, s: int(got[j, s].total) if (j, s) in got else 0
    top = lambda j, s: int(got[j, s].top) if (j, s) in got else None
    each = range(k)
    return {"sums": [[total(j, s) for s in range(dims)] for j in each], "count": [total(j, dims) for j in each], "inertia": [total(j, dims + 1) for j in each], "radius": [top(j, dims + 2) for j in each], "held": [top(j, dims + 3) for j in each], "left": total(0, dims + 4)}


def _reach(radii: list[int | None], before: np.ndarray, now: np.ndarray) -> list[int | None]:
    """A bound of the members' distance from the moved centroids: the radius and the move, both rounded up. An empty ball has no member."""
    moved = [sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True)) for x, y in zip(before, now, strict=True)]
    return [0 if r is None else isqrt(r) + isqrt(m) + 2 for r, m in zip(radii, moved, strict=True)]


def ball_kmeans(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, salt: str = SALT, stale: float = STALE) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid array<int>: one row per kept vector."""
    spark = vectors.sparkSession
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.select("vec_id", "embedding").where((F.size("embedding") == dims) & finite)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid array<int>"
    first = kept.where("vec_id is not null").orderBy(F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256), "embedding").limit(k).collect()
    if not first:
        if kept.isEmpty():
            return spark.createDataFrame([], schema)
        first = kept.orderBy("embedding").limit(k).collect()  # vectors without any vec_id: the smallest ones start
    centroids = _integers(np.array([r.embedding for r in first], np.float64), dims, scale).astype(np.int64)

    def prepare(batches, centroids=centroids):
        for batch in batches:
            if batch.num_rows:
                x = _integers(batch.column(1).flatten().to_numpy(zero_copy_only=False), dims, scale)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(nearest(x, centroids))], ["vec_id", "v", "ball"])

    def write(df: DataFrame) -> tuple[str, DataFrame]:
        df.write.option("compression", "zstd").parquet(path := new_path(spark))
        return path, spark.read.schema("vec_id bigint, v binary, ball int").parquet(path)

    path, table = write(kept.mapInArrow(prepare, "vec_id bigint, v binary, ball int"))
    reach: list[int | None] = [None] * len(centroids)
    for _ in range(rounds):
        near = neighbours(centroids, reach)
        seen = _pass(table, centroids, near, dims)
        moved = np.array([[s // n for s in sums] if n else old.tolist() for sums, n, old in zip(seen["sums"], seen["count"], centroids, strict=True)], np.int64)
        radii = seen["held"]
        if seen["left"] > stale * sum(seen["count"]):

            def relabel(batches, centroids=centroids, near=near):
                for batch in batches:
                    if batch.num_rows:
                        label, _, _ = assign(*_vectors(batch, dims), centroids, near)
                        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(label)], ["vec_id", "v", "ball"])

            older = path
            path, table = write(table.mapInArrow(relabel, "vec_id bigint, v binary, ball int"))
            remove(spark, older)
            radii = seen["radius"]
        reach, centroids = _reach(radii, centroids, moved), moved
    near = neighbours(centroids, reach)
    inertia = _pass(table, centroids, near, dims)["inertia"]
    whole = min(sum(inertia), _LONG)

    def result(batches):
        each = pa.array([min(v, _LONG) for v in inertia], pa.int64())
        at = pa.array(centroids.tolist(), pa.list_(pa.int32()))
        for batch in batches:
            if batch.num_rows:
                label, best, _ = assign(*_vectors(batch, dims), centroids, near)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(label), pa.array(best), each.take(pa.array(label)), pa.array(np.full(len(label), whole)), at.take(pa.array(label))], ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"])

    return table.mapInArrow(result, schema)
