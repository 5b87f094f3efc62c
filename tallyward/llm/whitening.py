"""Whitening of embeddings by a hierarchical singular value decomposition.

Each partition goes through its vectors once and keeps a summary: how many there are, their
exact sums, and the singular values and vectors of the centred rows, all of them. Two
summaries are merged by stacking their singular vectors, scaled by the singular values, and
one more row, the difference of the means times sqrt(a * b / (a + b)), and decomposing the
stack again. Nothing is cut off, so the summary of all rows is that of the whole matrix.
Partitions merge in groups of FAN, level by level, until one is left.

A summary has the size of d * d numbers whatever the number of rows. Entries are scaled to
whole numbers first (floor(SCALE * c) + SHIFT), so sums and the deviation are exact.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import require, settle

SCALE, SHIFT = 1024.0, 100_000
#: Summaries that one task merges.
FAN = 16
#: Numbers of a block of rows that is decomposed at a time.
BLOCK = 1 << 19
#: Scaled entries beyond this are taken as this; up to it doubles hold every whole number.
LARGEST = 1 << 52
LOW = (1 << 32) - 1


@dataclass
class Summary:
    """n rows, their sums as high * 2**32 + low, and the singular values and vectors (rows) of the centred rows."""

    n: int
    high: np.ndarray
    low: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    def sums(self) -> list[int]:
        return [int(h) * (LOW + 1) + int(x) for h, x in zip(self.high, self.low)]

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, n=np.int64(self.n), high=self.high, low=self.low, values=self.values, vectors=self.vectors)
        return held.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Summary:
        held = np.load(io.BytesIO(data), allow_pickle=False)
        return cls(int(held["n"]), held["high"], held["low"], held["values"], held["vectors"])


def scaled(rows: np.ndarray) -> np.ndarray:
    """Entries as whole numbers."""
    return np.clip(np.floor(rows.astype(np.float64) * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def summarize(x: np.ndarray) -> Summary:
    """The summary of a block of scaled rows."""
    high, low = (x >> 32).sum(axis=0), (x & LOW).sum(axis=0)
    base = x[0]  # differences from a row of the block are small and exact
    apart = (x - base).astype(np.float64)
    return Summary(len(x), high + (low >> 32), low & LOW, *_decomposed(apart - apart.mean(axis=0)))


def merge(a: Summary, b: Summary) -> Summary:
    low = a.low + b.low
    gap = np.array([float(q * a.n - p * b.n) for p, q in zip(a.sums(), b.sums())]) / a.n / b.n  # exact difference of the means
    row = gap * np.sqrt(a.n * b.n / (a.n + b.n))
    stack = np.vstack([a.values[:, None] * a.vectors, b.values[:, None] * b.vectors, row[None]])
    return Summary(a.n + b.n, a.high + b.high + (low >> 32), low & LOW, *_decomposed(stack))


@dataclass
class Whitening:
    """What turns vectors into whitened ones: of the size of a summary."""

    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues, falling
    components: np.ndarray  # rows
    trace: float

    @classmethod
    def of(cls, s: Summary, k: int) -> Whitening:
        d = len(s.low)
        values = np.zeros(d)
        values[: len(s.values)] = s.values**2 / s.n
        vectors = _completed(s.vectors, d)[:k]
        heavy = np.argmax(np.abs(vectors), axis=1)
        vectors = vectors * np.where(vectors[np.arange(len(vectors)), heavy] < 0, -1.0, 1.0)[:, None]
        return cls(s.n, s.sums(), values[:k], vectors, float(values.sum()))

    def usable(self) -> np.ndarray:
        """Components along which the rows differ at all, beyond rounding."""
        floor = self.values[0] * np.finfo(float).eps ** 2 * len(self.sums) ** 2 if len(self.values) else 0.0
        return self.values > floor

    def apply(self, x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        """Exact deviations of scaled rows, and the rows whitened (NaN where a component has no variance)."""
        room = max(1, int(np.abs(x).max(initial=0)), max(map(abs, self.sums), default=0) // self.n + 1)
        if self.n * room < 1 << 61:
            gap = x * self.n - np.array(self.sums, np.int64)
            exact = gap if x.shape[1] * int(np.abs(gap).max(initial=0)) ** 2 < 1 << 62 else gap.astype(object)
        else:
            gap = exact = x.astype(object) * self.n - np.array(self.sums, object)
        deviations = [int(v) if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)] if x.shape[1] else [0] * len(x)
        centred = gap.astype(np.float64) / self.n
        with np.errstate(divide="ignore", invalid="ignore"):
            projected = centred @ self.components.T / np.sqrt(self.values)
        projected[:, ~self.usable()] = np.nan
        return deviations, projected


def _completed(vectors: np.ndarray, d: int) -> np.ndarray:
    """d orthonormal rows, those given first."""
    if len(vectors) >= d:
        return vectors[:d]
    full = np.linalg.svd(vectors, full_matrices=True)[2]
    return np.vstack([vectors, full[len(vectors) :]])


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(-1, d)


def usable_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, vector: rows whose vector is not null and holds only finite numbers."""
    require(df, id_col, vector_col)
    v = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).alias("vec_id"), v.alias("vector"))
    odd = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & ~odd)


def fit(vectors: DataFrame, d: int, k: int = 8) -> Whitening | None:
    """The whitening of all rows of vec_id, vector, each of d entries; None if there are none."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for at in range(0, len(batch), max(1, BLOCK // d)):
                x = scaled(_matrix(batch.column(0).slice(at, max(1, BLOCK // d)), d))
                held = summarize(x) if held is None else merge(held, summarize(x))
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held.to_bytes()], pa.binary())], names=["summary"])

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("part")
        held = None
        for data in rows.summary:
            held = Summary.from_bytes(data) if held is None else merge(held, Summary.from_bytes(data))
        return pd.DataFrame({"part": [int(rows.part.iloc[0]) // FAN], "summary": [held.to_bytes()]})

    level = vectors.select("vector").mapInArrow(first, "summary binary").select(F.spark_partition_id().cast("long").alias("part"), "summary")
    level = settle(level)
    while True:
        last = level.agg(F.max("part")).first()[0]
        if last is None:
            return None
        level = settle(level.groupBy(F.expr(f"part div {FAN}").alias("next")).applyInPandas(lambda key, g: merged(g), "part long, summary binary"))
        if last < FAN:
            return Whitening.of(Summary.from_bytes(level.first().summary), k)  # one row, of d * d numbers


def whiten(df: DataFrame, k: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n, deviation, whitened array<double>, explained array<double>, identity_error.

    Vectors that are null or hold a null, NaN or infinite entry are left out, and so are empty ones (they have no
    component). All others must have one length, that of most rows (of the longer at a tie); the rest is an
    error. whitened has min(k, length) entries, component by component; a component along which all vectors
    agree gives null. deviation is null if it exceeds a long. Entries beyond 2**52 / 1024 count as that. Equal
    components (ties of eigenvalues) come in the order of the decomposition; each has its largest entry positive.
    Rows that stand twice count twice and come out twice, null ids as well; other columns are ignored, whatever
    their names; an empty table gives an empty one.
    """
    vectors = usable_vectors(df, id_col, vector_col)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    shape = f"vec_id {kind}, n long, deviation long, whitened array<double>, explained array<double>"
    sizes = vectors.groupBy(F.size("vector").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    if not sizes:
        return df.sparkSession.createDataFrame([], f"{shape}, identity_error double")
    if len(sizes) > 1:
        raise ValueError(f"vectors of {sizes[0].d} and of {sizes[1].d} entries in one table")
    d = sizes[0].d
    vectors = vectors.where(F.size("vector") == d)
    model = fit(vectors, d, k)
    usable = model.usable()
    explained = [float(e / model.trace) if model.trace else None for e in model.values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), max(1, BLOCK // d)):
                part = batch.slice(at, max(1, BLOCK // d))
                deviations, w = model.apply(scaled(_matrix(part.column(1), d)))
                flat = pa.array(w.ravel(), pa.float64(), mask=np.tile(~usable, len(w)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), flat)
                shares = pa.array([explained] * len(w), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([model.n] * len(w), pa.int64()), pa.array(deviations, pa.int64()), lists, shares], names=["vec_id", "n", "deviation", "whitened", "explained"])

    rows = vectors.mapInArrow(run, shape)
    return rows.withColumn("identity_error", F.lit(_identity_error(rows, usable)).cast("double"))


def _identity_error(rows: DataFrame, usable: np.ndarray) -> float | None:
    """The largest entry of the whitened rows' covariance less the identity, measured on the rows themselves."""
    kept = [int(i) for i in np.flatnonzero(usable)]
    if not kept:
        return None
    flat = rows.select(*(F.col("whitened")[i].alias(f"w{i}") for i in kept))
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    found = flat.agg(*(F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs)).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(found, pairs))


def components(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component of whiten()."""
    spread = F.posexplode(F.arrays_zip("whitened", "explained")).alias("i", "c")
    rows = whitened.select("vec_id", "n", "deviation", "identity_error", spread)
    return rows.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
