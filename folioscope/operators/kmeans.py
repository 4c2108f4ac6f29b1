"""Mini-batch k-means over vectors, several starts in each job.

Rounds take batches that are drawn by a hash of the rows' keys, so a rerun draws the same. A task assigns its rows of the batch to the nearest center of each start and sums them up; each center then
moves by its batch's mean, weighted by all rows that it has had so far. The costs of all starts come from one pass over all rows, and the best one is taken."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.reduce import _add_rows
from folioscope.operators.work import settled

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows from which the first centers are drawn; rounds, and rows of a batch for each center (at least BATCH in all).
DRAWN, ROUNDS, A_CENTER, BATCH = 10_000, 40, 30, 4096


@dataclass(frozen=True)
class Fit:
    centers: np.ndarray  # k x dims
    cost: float  # summed squared distances of all rows
    costs: tuple[float, ...]  # of all starts

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  # as MLlib's models have it
        return list(self.centers)


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the nearest center (of equal ones the first) and the squared distance."""
    gap = (x * x).sum(axis=1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(axis=1)[None]
    at = gap.argmin(axis=1)
    return at, ((x - centers[at]) ** 2).sum(axis=1)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(starts: np.ndarray):
    """Rows (x) -> for each start the summed rows and counts of its centers, and the cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, k, dims = starts.shape
        total, cost = np.zeros((n, k, dims + 1)), np.zeros(n)
        for batch in batches:
            for part in range(0, batch.num_rows, 4096):
                x = _matrix(batch.column(0).slice(part, 4096))
                one = np.column_stack([x, np.ones(len(x))])
                for s in range(n):
                    at, gap = _nearest(x, starts[s])
                    order = np.argsort(at, kind="stable")
                    _add_rows(total[s], at[order], one[order])
                    cost[s] += gap.sum()
        yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.array([t.tobytes() for t in total], pa.binary()), pa.array(cost)], ["start", "sums", "cost"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, tuple[np.ndarray, float]] = {}
    for batch in batches:
        for start, sums, cost in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            old = total.get(start, (0.0, 0.0))
            total[start] = (old[0] + np.frombuffer(sums), old[1] + cost)
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t, _ in total.values()], pa.binary()), pa.array([c for _, c in total.values()], pa.float64())], ["start", "sums", "cost"])


def _pass(rows: DataFrame, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sums, counts, costs) of all starts; one task adds up a start's sums from all others, so only one for each start comes to the driver."""
    kind, (n, k, dims) = "start int, sums binary, cost double", starts.shape
    out, cost = np.zeros((n, k, dims + 1)), np.zeros(n)
    for r in rows.mapInArrow(_sums(starts), kind).repartition(n, "start").mapInArrow(_added, kind).collect():
        out[r["start"]] += np.frombuffer(r["sums"]).reshape(k, dims + 1)
        cost[r["start"]] += r["cost"]
    return out[:, :, :dims], out[:, :, dims], cost


def _first(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k rows: each time some are drawn with a chance that grows with the square of the distance to those before, and that one is taken which brings all rows nearest to a center."""
    rng, tries = np.random.default_rng(seed), 2 + int(np.log(k))
    squares = lambda c: ((x - c) ** 2).sum(axis=1)
    chosen = [x[rng.integers(len(x))]]
    gap = squares(chosen[0])
    while len(chosen) < k:
        total = gap.sum()
        some = rng.choice(len(x), tries, p=gap / total) if total > 0 else rng.integers(len(x), size=1)
        left = [np.minimum(gap, squares(x[i])) for i in some]
        best = int(np.argmin([g.sum() for g in left]))
        chosen.append(x[some[best]])
        gap = left[best]
    return np.array(chosen)


def fit(df: DataFrame, key: str | None, vector: str, k: int, starts: int = 8, seed: int = 42, rounds: int = ROUNDS) -> Fit:
    """The best of several starts over all rows. Vectors have one length and no nulls; there are at least k rows (centers repeat where fewer differ). The first centers come from at most DRAWN rows,
    and rounds from batches, both by hashes of keys (or of the vectors); the costs cover all rows. A table of a few batches is taken whole each round."""
    drawn = F.xxhash64(F.lit(seed), F.col(vector) if key is None else F.col(key).cast("string"))
    rows = settled(df.select(drawn.alias("h"), F.col(vector).cast("array<double>").alias("x")))
    n = rows.count()
    batch = max(BATCH, A_CENTER * k)
    some = rows.orderBy("h", "x").limit(DRAWN).select("x").toArrow()
    x = _matrix(some.column(0).combine_chunks())
    now = np.array([_first(x, k, seed + s) for s in range(starts)])
    whole = n <= 4 * batch
    if not whole:  # a row is in a batch of at most one round, and only rows of batches are read again
        share = min(1.0, rounds * batch / n)
        place = F.pmod("h", F.lit(1 << 30)) / float(1 << 30)
        taken = settled(rows.filter(place < share).withColumn("round", F.floor(place / share * rounds)))
    had = np.zeros((starts, k))
    for r in range(rounds):
        sums, counts, _ = _pass(rows.select("x") if whole else taken.filter(F.col("round") == r).select("x"), now)
        had = counts if whole else had + counts
        step = np.where(had > 0, 1 / np.maximum(had, 1), 0)[:, :, None] * (sums - counts[:, :, None] * now)
        now = now + step
        if np.abs(step).max() < 1e-4:
            break
    costs = _pass(rows.select("x"), now)[2]
    best = int(np.argmin(costs))
    return Fit(now[best], float(costs[best]), tuple(costs.tolist()))


def nearest(vector: Column, centers: np.ndarray) -> Column:
    """struct<cluster_id int, distance double> of the nearest center, of equal ones the first."""

    @F.arrow_udf("struct<cluster_id:int,distance:double>")
    def run(column: pa.Array) -> pa.Array:
        at, gap = _nearest(_matrix(column), centers) if len(column) else (np.zeros(0, np.int64), np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(np.sqrt(gap))], ["cluster_id", "distance"])

    return run(vector)
