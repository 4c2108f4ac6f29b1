"""Reduction of sparse rows to few dimensions, by a randomised range finder.

The right singular vectors of the largest singular values of a matrix X (a row a document, sparse; features bounded, rows not) are found from products of X'X with a block of a few
more vectors than are wanted: each pass over the rows sums X'(XV) within the tasks, in Arrow batches, and adds the tasks' sums by strips of features. Between passes the block, features by
dims, is made orthogonal on the driver. Passes end when the space no longer turns."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Features of a strip, of which a row holds one task's sums; passes at most; the sine of the angle by which the space may still turn.
STRIP, PASSES, TURN = 256, 60, 1e-5
#: Numbers of a block (features by dims) that go to every task.
MOST = 16_000_000


def _add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Adds rows to those of a matrix; at: where, in ascending order. Each stretch of equal places is summed first, many times as fast as one by one."""
    if len(at):
        starts = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
        to[at[starts]] += np.add.reduceat(rows, starts)


def _products(v: np.ndarray):
    """Rows of indices and values -> X'(XV) of all rows of a task, strip by strip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(v)
        for batch in batches:
            ids, values = (batch.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            of = pa.compute.list_parent_indices(batch.column(0)).to_numpy(zero_copy_only=False)
            y = np.zeros((batch.num_rows, v.shape[1]))
            for a in range(0, len(ids), 1 << 16):  # products of some entries at a time
                k = slice(a, a + (1 << 16))
                _add_rows(y, of[k], values[k, None] * v[ids[k]])
            for a in range(0, len(ids), 1 << 16):
                k = slice(a, a + (1 << 16))
                order = np.argsort(ids[k], kind="stable")
                _add_rows(total, ids[k][order], values[k][order, None] * y[of[k][order]])
        strips = [total[a : a + STRIP] for a in range(0, len(total), STRIP)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(strips)), pa.int32()), pa.array([s.tobytes() for s in strips], pa.binary())], ["strip", "sums"])

    import pyarrow.compute  # noqa: F401

    return run


def _added(width: int):
    """Rows (strip, sums) -> one row for each strip of a task; a task holds one sum of each of its strips, however many rows come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for strip, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(sums).reshape(-1, width)
                total[strip] = total[strip] + own if strip in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([s.tobytes() for s in total.values()], pa.binary())], ["strip", "sums"])

    return run


def gram_times(rows: DataFrame, v: np.ndarray) -> np.ndarray:
    """X'XV. rows: indices array<int>, values array<double>, of nonzero entries."""
    kind, strips = "strip int, sums binary", -(-len(v) // STRIP)
    each = rows.select("indices", "values").mapInArrow(_products(v), kind)
    some = each.repartition(min(strips, 64), "strip").mapInArrow(_added(v.shape[1]), kind)
    out = np.zeros_like(v)
    for r in some.collect():  # the block itself: features by dims
        out[r["strip"] * STRIP : (r["strip"] + 1) * STRIP] += np.frombuffer(r["sums"]).reshape(-1, v.shape[1])
    return out


def right_singular_vectors(rows: DataFrame, features: int, dims: int, seed: int = 42, passes: int = PASSES, turn: float = TURN) -> tuple[np.ndarray, np.ndarray]:
    """(features x dims, the singular values), largest first. rows: indices and values of each row, read once a pass, so they should be cheap to read. Of a row space of fewer dimensions the
    rest is some orthogonal complement, at singular values of 0. Signs: each vector's largest entry is positive, so the result is the same on every run up to rounding."""
    dims = min(dims, features)
    width = min(features, dims + max(10, dims))
    if features * width > MOST:
        raise ValueError(f"{features} features by {width} dimensions are more than {MOST} numbers; take fewer features")
    v = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, width)))[0]
    kept = None
    for _ in range(passes):
        y = gram_times(rows, v)
        # the best vectors within the block, from the products that are there already
        values, turned = np.linalg.eigh((v.T @ y + y.T @ v) / 2)
        order = np.argsort(values)[::-1][:dims]
        best, size = v @ turned[:, order], np.sqrt(np.maximum(values[order], 0))
        if kept is not None and np.linalg.norm(best - kept @ (kept.T @ best), 2) <= turn:
            break
        kept = best
        v = np.linalg.qr(y)[0]
    sign = np.sign(best[np.abs(best).argmax(axis=0), np.arange(dims)])
    return best * np.where(sign == 0, 1, sign), size
