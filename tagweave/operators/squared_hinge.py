"""Linear SVM with squared hinge loss and l2 penalty, one-vs-rest (M11), by Newton
steps with conjugate gradients on the primal (Keerthi and DeCoste 2005).

For each class, min over w of |w|^2 / 2 + C sum max(0, 1 - t w.x)^2, the constant
feature 1 included in x. A gradient or a product with the Hessian is one scan of
the rows: every task adds up its rows for all classes, and Spark adds up the
tasks' sums. A gradient also gives the dual point 2 C max(0, 1 - t w.x) and so the
duality gap; a class whose gap is within ``tol`` of its objective is done. The
weights are classes x features, a bound set by the parameters (checked).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagweave.operators.mllib import ENTRIES, add_up, arrow_rows, sparse_rows, split_entries
from tagweave.session import cut_lineage

#: The weights are held by the driver and by each task.
WEIGHT_BYTES = 256 << 20
_LOSS, _DUAL = -1, -2
#: Rows that a task multiplies at once.
SCAN_ROWS = 1024


@dataclass(frozen=True)
class SvmParams:
    C: float = 1.0
    tol: float = 1e-3
    max_steps: int = 50
    cg_steps: int = 30


def fit_squared_hinge(data: DataFrame, n_classes: int, dim: int, p: SvmParams = SvmParams()) -> tuple[np.ndarray, np.ndarray]:
    """(weights classes x (dim + 1), bias last; relative duality gap of each class)
    from ``data`` (id, features vector of ``dim``, y class index). A gap above ``tol``
    says that ``max_steps`` ended the job. No rows: zeros."""
    if n_classes * (dim + 1) * 8 > WEIGHT_BYTES:
        raise ValueError(f"{n_classes} x {dim + 1} weights are over {WEIGHT_BYTES} bytes; hash into fewer features")
    rows = cut_lineage(sparse_rows(data.withColumn("y", F.col("y").cast("int")), "y"))

    def measured(w: np.ndarray):
        """Objective, relative gap and gradient of each class."""
        total, extra = _scan(rows, p.C, w, None)
        objective = (w * w).sum(axis=1) / 2 + extra[_LOSS]
        dual = extra[_DUAL] - (total * total).sum(axis=1) / 2
        return objective, (objective - dual) / np.maximum(objective, 1e-300), w - total

    w = np.zeros((n_classes, dim + 1))
    objective, gap, grad = measured(w)
    for _ in range(p.max_steps):
        open_ = gap > p.tol
        if not open_.any():
            break
        move = _newton_move(rows, p, w, np.where(open_[:, None], grad, 0.0))
        size = np.where(open_, 1.0, 0.0)
        while True:     # halved, class by class, until the objective falls enough
            trial = measured(w - size[:, None] * move)
            worse = (trial[0] > objective - 1e-4 * size * (grad * move).sum(axis=1)) & (size > 0)
            if not worse.any():
                break
            size = np.where(worse, np.where(size > 1e-6, size / 2, 0.0), size)
        w = w - size[:, None] * move
        objective, gap, grad = trial
        if not size.any():
            break
    return w, gap


def _newton_move(rows: DataFrame, p: SvmParams, w: np.ndarray, grad: np.ndarray) -> np.ndarray:
    """The solution of (Hessian at w) move = grad, each class by conjugate gradients."""
    move, left, way = np.zeros_like(w), grad.copy(), grad.copy()
    square = (left * left).sum(axis=1)
    stop = 1e-2 * square        # a tenth of the gradient's length
    for _ in range(p.cg_steps):
        going = (square > stop) & (square > 0)
        if not going.any():
            break
        turned = way + _scan(rows, p.C, w, way)[0]
        size = np.where(going, square / np.maximum((way * turned).sum(axis=1), 1e-300), 0.0)[:, None]
        move, left = move + size * way, left - size * turned
        new = (left * left).sum(axis=1)
        way = np.where(going[:, None], left + (new / np.maximum(square, 1e-300))[:, None] * way, 0.0)
        square = new
    return move


def _scan(rows: DataFrame, C: float, w: np.ndarray, way: np.ndarray | None):
    """Without ``way``: the sums of a t x over all rows, a = 2 C max(0, 1 - t w.x), and
    by class the loss and the sum of a - a^2 / 4 C. With it: the sums of
    2 C (way.x) x over the rows within the margin."""
    spark, shape = rows.sparkSession, w.shape
    bc = spark.sparkContext.broadcast((w, way))

    def add(batches: Iterator) -> Iterator[pa.RecordBatch]:
        w, way = (None if x is None else np.ascontiguousarray(x.T) for x in bc.value)
        dim, classes = shape[1] - 1, np.arange(shape[0])
        total, loss, dual = np.zeros(shape), np.zeros(shape[0]), np.zeros(shape[0])
        for b in _pieces(batches):
            start, i, v = arrow_rows(b)
            row = np.repeat(np.arange(len(start) - 1), np.diff(start))
            t = np.where(classes == b.column("y").to_numpy(zero_copy_only=False)[:, None], 1.0, -1.0)
            short = np.maximum(1 - t * _scores(w, start, i, v), 0)
            if way is None:
                a = 2 * C * short
                loss += C * (short * short).sum(axis=0)
                dual += (a - a * a / (4 * C)).sum(axis=0)
                a *= t
            else:
                a = 2 * C * (short > 0) * _scores(way, start, i, v)
            for k in np.flatnonzero(a.any(axis=0)):
                total[k, :dim] += np.bincount(i, v * a[row, k], dim)
            total[:, dim] += a.sum(axis=0)      # the bias is one more feature, always 1
        yield split_entries(np.concatenate([total.ravel(), loss, dual]))

    # Classes x (features + 3) numbers at most.
    key, d = add_up(rows.mapInArrow(add, ENTRIES))
    bc.unpersist()
    every = np.zeros(shape[0] * (shape[1] + 2))
    every[key] = d
    total, loss, dual = np.split(every, [shape[0] * shape[1], shape[0] * (shape[1] + 1)])
    return total.reshape(shape), {_LOSS: loss, _DUAL: dual}


def _pieces(batches: Iterator) -> Iterator:
    for b in batches:
        for at in range(0, b.num_rows, SCAN_ROWS):
            yield b.slice(at, SCAN_ROWS)


def _scores(w: np.ndarray, start: np.ndarray, i: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Rows x classes: w.x with the bias, ``w`` features x classes, bias last."""
    s, some = np.tile(w[-1], (len(start) - 1, 1)), np.flatnonzero(np.diff(start))
    if len(some):
        s[some] += np.add.reduceat(w[i] * v[:, None], start[some], axis=0)
    return s
