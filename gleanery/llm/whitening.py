"""Whitened leading components of embeddings, with their exact deviations.

Vectors become whole numbers, so that equal ones are equal and their sums exact. Spark makes them distinct, adds up their
sums and then the products of what is centred; only the d sums and d x d covariances reach the driver, which slices
the spectrum (``spectrum``) and sends back the leading components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spectrum import leading
from .stages import Scratch

#: Whole steps of an entry by 1, and components returned.
STEPS, COMPONENTS = 256, 4
#: Eigenvalues below this share of the trace are rounding, and aren't components.
LEAST = 1e-12

OUT = "vec_id {id}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def stepped(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: entries as the whole numbers floor(256 c), of the rows whose vector isn't null and holds only finite entries."""
    c = F.col("_c")
    finite = ~F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("_c")).where(c.isNotNull() & finite)
    return rows.select("vec_id", F.transform(c, lambda e: F.floor(e * STEPS)).alias("x"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sums of their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), d)
            n += len(x)
            largest = max(abs(int(x.max())), abs(int(x.min())))
            x = x if largest * len(x) < 1 << 62 else x.astype(object)
            total = [a + int(b) for a, b in zip(total, x.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(total, pa.decimal128(38, 0))], names=["i", "n", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, n long, s decimal(38, 0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # d rows
    by_place = {r.i: r for r in rows}
    return (rows[0].n, [int(by_place[i].s) for i in range(d)]) if rows else (0, [0] * d)


def _covariance(fit: DataFrame, n: int, mean: np.ndarray, onto: np.ndarray | None = None) -> np.ndarray:
    """Covariance, divisor n, of the vectors less ``mean``, or of their products with the rows of ``onto``."""
    d = len(mean)
    k = d if onto is None else len(onto)
    i, j = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            y = _matrix(batch.column(0), d) - mean
            y = y if onto is None else y @ onto.T
            total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "v"])

    rows = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # k (k + 1) / 2 rows
    out = np.zeros((k, k))
    out[rows["i"].to_numpy(), rows["j"].to_numpy()] = rows["v"].to_numpy() / n
    return np.triu(out) + np.triu(out, 1).T


def _squares(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sums over the dimensions of (n x - S)^2, exact; null where one exceeds a long."""
    largest = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if largest * largest * len(sums) < 1 << 62:
        y = n * x - np.array(sums, dtype=np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for each vector that ``stepped`` leaves and each of the leading components, numbered from 1.

    Means, covariances and components are those of the n distinct vectors. Repeated rows and null ids get their rows;
    a vector counts once in the fit however often it stands there. Components without variance aren't returned, so there
    are fewer of them where vectors span less, and none at all for a single distinct vector or an empty table. Vectors of
    another length than most distinct ones have (of equally many: the greater length) are left out, and so are empty ones.
    Deviations that exceed a long are null. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = stepped(vectors, id_col, vec_col)
    id_type = rows.schema["vec_id"].dataType.simpleString()
    schema = OUT.format(id=id_type)
    nothing = spark.createDataFrame([], schema)
    scratch = Scratch(spark)
    fit = scratch.write(rows.select("x").where(F.size("x") > 0).distinct(), "fit")
    usual = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if usual is None:
        return nothing
    d = usual.d
    fit = fit.where(F.size("x") == d)
    n, sums = _sums(fit, d)
    mean = np.array([s / n for s in sums])
    variance = _covariance(fit, n, mean)
    trace = float(np.trace(variance))
    values, axes = leading(variance, components)
    known = values > LEAST * trace
    values, axes = values[known], axes[known]
    k = len(values)
    if not k:
        return nothing
    onto = axes / np.sqrt(values)[:, None]
    error = float(np.abs(_covariance(fit, n, mean, onto) - np.eye(k)).max())
    explained = values / trace
    scratch.drop(*(t for t, _ in scratch.tables))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1), d)
            each = np.repeat(np.arange(m), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                    pa.array(_squares(x, n, sums), pa.int64()).take(pa.array(each)), pa.array(((x - mean) @ onto.T).ravel()),
                    pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.where(F.size("x") == d).mapInArrow(run, schema)
