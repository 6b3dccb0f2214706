"""Whitening of vectors by a one-sided Jacobi SVD of what a blockwise TSQR leaves.

Entries become whole numbers, so sums, centring and squared deviations are exact. Passes over
the rows, each by Arrow batches, with state of the size of a d x d matrix a task:

1. sums by dimension, added up by Spark, d numbers;
2. TSQR: each partition folds its centred rows, block by block, into one upper triangular R;
   the Rs are folded ``fan_in`` at a time by Spark until few are left, so neither a task nor
   the driver holds more than ``fan_in`` matrices. R has the singular values and right
   singular vectors of all centred rows;
3. one-sided Jacobi on the last R: plane rotations make pairs of columns orthogonal, d / 2
   disjoint pairs at a time, until all are orthogonal to working precision. Columns' lengths
   are the singular values and the accumulated rotations the components, both with high
   relative accuracy, also small ones (Demmel and Veselic 1992);
4. the whitened rows' second moments, as a check of the result on the rows themselves;
5. the result.

Cases: rows without a whole vector are left out, and so are rows whose vector has another
length than most have (of lengths equally frequent, the longest counts). Entries beyond 2**52
in size after scaling count as that. A ``deviation`` beyond 64 bits is null. Components
without spread, which cannot be whitened, are not returned: none for equal rows, a single row
or an empty table. Equal rows count each and get equal results; null ids stay null. Only the
id and vector columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryspark.llm.vectors import doubles, matrix, whole_vector
from quarryspark.runtime import materialize, quoted

MOST_ENTRY = 2.0**52
MOST_LONG = 2**63 - 1
#: centred rows that a task folds into R at a time
BLOCK_ROWS = 4096


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # a column each, by falling eigenvalue
    eigenvalues: np.ndarray
    trace: float
    scale: float
    shift: int

    def centred(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S as whole numbers, x - S / n)."""
        x = whole_numbers(v, self.scale, self.shift)
        most = max([abs(s) for s in self.sums] + [self.n * int(np.abs(x).max(initial=0))])
        whole = self.n * x - np.array(self.sums, dtype=np.int64) if most < 2**62 else self.n * x.astype(object) - np.array(self.sums, dtype=object)
        return whole, np.asarray(whole / self.n, dtype=np.float64)

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ (self.components / np.sqrt(self.eigenvalues))


def whole_numbers(v: np.ndarray, scale: float, shift: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * scale), -MOST_ENTRY, MOST_ENTRY).astype(np.int64) + shift


def one_sided_jacobi(r: np.ndarray, most_sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(singular values, right singular vectors as columns), by falling value."""
    a, d = r.astype(np.float64).copy(), r.shape[1]
    v = np.eye(d)
    line = np.arange(d + d % 2)  # an odd one out sits out a round
    for _ in range(most_sweeps):
        worst = 0.0
        for _ in range(len(line) - 1):
            p, q = line[: len(line) // 2], line[len(line) // 2 :][::-1]
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            alpha, beta, gamma = (a[:, p] ** 2).sum(0), (a[:, q] ** 2).sum(0), (a[:, p] * a[:, q]).sum(0)
            size = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), size, out=np.zeros_like(gamma), where=size > 0)
            worst = max(worst, off.max(initial=0.0))
            turn = off > 1e-15
            if turn.any():
                p, q, alpha, beta, gamma = p[turn], q[turn], alpha[turn], beta[turn], gamma[turn]
                zeta = (beta - alpha) / (2 * gamma)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                c = 1 / np.hypot(1.0, t)
                s = c * t
                for m in (a, v):
                    left, right = m[:, p].copy(), m[:, q].copy()
                    m[:, p], m[:, q] = c * left - s * right, s * left + c * right
            line = np.concatenate([line[:1], line[-1:], line[1:-1]])
        if worst <= d * 2.3e-16:
            break
    sigma = np.sqrt((a**2).sum(0))
    order = np.argsort(-sigma, kind="stable")
    return sigma[order], v[:, order]


def _rows(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that count, and their dimension."""
    good = df.filter(whole_vector(vec_col)).select(F.col(quoted([id_col])[0]).alias("id"), doubles(df, vec_col).alias("vec"))
    usual = good.groupBy(F.size("vec").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("d").desc()).first()
    d = 0 if usual is None else usual.d
    return good.filter(F.size("vec") == d), d


def _sums(rows: DataFrame, d: int, scale: float, shift: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            x = whole_numbers(matrix(b.column(0)), scale, shift)
            for at in range(0, len(x), 256):  # partial sums within 64 bits
                total = [t + int(s) for t, s in zip(total, x[at : at + 256].sum(0), strict=True)]
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))], names=["at", "s"])

    found = {r["at"]: int(r.s) for r in rows.select("vec").mapInArrow(run, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").alias("s")).collect()}  # d + 1 rows
    return found.get(-1, 0), [found.get(k, 0) for k in range(d)]


def _folded(parts: list[np.ndarray]) -> np.ndarray:
    """R of what is stacked, with non-negative diagonal."""
    r = np.linalg.qr(np.vstack(parts), mode="r")
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None] if r.shape[0] == r.shape[1] else r


def _tsqr(rows: DataFrame, base: Whitening, d: int, fan_in: int) -> np.ndarray:
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, r, waiting = None, [], []
        for b in batches:
            block = b.column(0)[0].as_py() if block is None else block
            waiting.append(base.centred(matrix(b.column(1)))[1])
            if sum(map(len, waiting)) >= BLOCK_ROWS:
                r, waiting = [_folded(r + waiting)], []
        if r or waiting:
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "r": pa.array([_folded(r + waiting).tobytes()], pa.binary())})

    def merged(key: tuple, table: pa.Table) -> pa.Table:
        inner = table.sort_by("block").column("r").to_pylist()
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([_folded([np.frombuffer(x).reshape(-1, d) for x in inner]).tobytes()], pa.binary())})

    rs = materialize(rows.select(F.spark_partition_id().cast("long").alias("block"), "vec").mapInArrow(local, "block long, r binary"))
    while rs.count() > fan_in:
        nth = rs.select(F.col("block").alias("was"), "r").withColumn("block", F.floor(F.col("was") / fan_in))
        rs = materialize(nth.groupBy("block").applyInArrow(merged, "block long, r binary"))
    few = rs.orderBy("block").collect()  # fan_in matrices at most
    return _folded([np.frombuffer(x.r).reshape(-1, d) for x in few]) if few else np.zeros((0, d))


def fit_whitening(rows: DataFrame, d: int, *, components: int = 32, scale: float = 64.0, shift: int = 1_000_000, fan_in: int = 16) -> Whitening:
    """Fitted on all of ``rows`` (vec), which have ``d`` entries each."""
    n, sums = _sums(rows, d, scale, shift)
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, scale, shift)
    if n == 0 or d == 0:
        return none
    sigma, v = one_sided_jacobi(_tsqr(rows, none, d, fan_in))
    rank = int((sigma > sigma.max(initial=0.0) * d * 2.3e-16).sum())
    k = min(components, rank)
    v = v[:, :k]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(k)]) if k else v  # the same sign whatever the order of rows
    return Whitening(n, sums, v, sigma[:k] ** 2 / n, float((sigma**2).sum()) / n, scale, shift)


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry, sign aside, of the whitened rows' covariance less the identity."""
    k = len(model.eigenvalues)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for b in batches:
            w = model.whitened(model.centred(matrix(b.column(0)))[1])
            total[:k] += w.T @ w
            total[k] += w.sum(0)
        yield pa.RecordBatch.from_pydict({"at": np.arange(total.size, dtype=np.int32), "s": total.ravel()})

    sums = rows.select("vec").mapInArrow(run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).toArrow()  # k * (k + 1) rows
    total = np.zeros((k + 1) * k)
    total[sums.column("at").to_numpy()] = sums.column("s").to_numpy() / model.n
    total = total.reshape(k + 1, k)
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def whiten(df: DataFrame, *, components: int = 32, scale: float = 64.0, shift: int = 1_000_000, fan_in: int = 16, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), a row for each row and component up to ``components``.

    ``deviation``: the sum of (n x - S)^2 over the dimensions, where x = floor(scale * entry) + shift
    and S are the sums of x over all rows.
    """
    rows, d = _rows(df, id_col, vec_col)
    model = fit_whitening(rows, d, components=components, scale=scale, shift=shift, fan_in=fan_in)
    error, k = identity_error(rows, model), len(model.eigenvalues)
    share = model.eigenvalues / model.trace if k else model.eigenvalues

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            whole, centred = model.centred(matrix(b.column(1)))
            if whole.dtype == object or float(np.abs(whole).max(initial=0)) ** 2 * d >= MOST_LONG:
                square = [s if (s := sum(int(x) ** 2 for x in row)) <= MOST_LONG else None for row in whole]
            else:
                square = (whole**2).sum(1)
            m = len(centred)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)), pa.array(square, pa.int64()).take(pa.array(each)), pa.array(model.whitened(centred).ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error))],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out.withColumnRenamed("id", id_col)
