"""Whitening of embeddings from an exact scatter matrix, summed in a residue number system.

Components become whole numbers. A first pass gives how many vectors there are, the exact sums of
each dimension and the largest component, from which follows how many primes are needed. Then every
partition multiplies its vectors' residues by each other, prime by prime: the primes are so small that
products of `ROWS` vectors are whole doubles without rounding, so each is one matrix product. What
partitions found is added by (prime, row of the matrix), modulo the prime, and the Chinese remainder
theorem gives the scatter matrix itself, however large its entries. Centring is done on whole numbers,
(n * scatter - sums * sums) / n^2, and only its result becomes double and is decomposed.

A last pass over the whitened vectors gives their covariance, centred in each batch and merged by
means, and how far it is from the identity.

Defined results: a vector that is null or holds null or non-finite components is left out; a shorter
one, an empty one too, ends in zeros; components beyond 2^62 after scaling stop there; rows that
repeat count each, and those without an id take part. A principal component along which nothing
varies (fewer vectors or dimensions than components, or only copies) has no scale: whitened is null,
and the identity is asked of the others. Where nothing varies at all explained and identity_error are
null. Deviations beyond a long stop at its end. An empty table gives no row. Other columns are passed on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyledger.llm import common, vectors

FACTOR, OFFSET, COMPONENTS = 1024, 100_000, 8
#: Primes are below `CEILING`; a product of `ROWS` vectors' residues is below 2^53 then.
CEILING, ROWS = 1 << 21, 2048
LONGEST = (1 << 63) - 1


@dataclass(frozen=True)
class Whitening:
    """`axes` are rows, one for each component; `variances` their eigenvalues, 0 where nothing varies."""

    n: int
    sums: tuple[int, ...]
    most: int
    axes: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float | None = None


def primes(least_product: int) -> list[int]:
    """The largest primes below `CEILING`, as many as make their product greater than `least_product`."""
    found, at = [], CEILING
    while prod(found) <= least_product:
        at -= 1
        if all(at % d for d in range(2, int(at**0.5) + 1)):
            found.append(at)
    return found


def remaindered(residues: np.ndarray, moduli: list[int]) -> np.ndarray:
    """Whole numbers, nearest to zero, of which each prime's remainders are given (prime first)."""
    whole = prod(moduli)
    parts = [whole // p * pow(whole // p, -1, p) for p in moduli]
    value = sum(r.astype(object) * c for r, c in zip(residues, parts)) % whole
    return np.where(value > whole // 2, value - whole, value)


def _totals(rows: DataFrame) -> tuple[int, int, list[int]]:
    """(vectors, largest component by size, sums by dimension), exact, without the offset."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, most, high, low = 0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            kept, own = vectors.floored(batch.column("vector"), FACTOR)
            n, most = n + int(kept.sum()), max(most, int(np.abs(own).max(initial=0)))
            width = max(len(high), own.shape[1])
            high, low = (np.pad(x, (0, width - len(x))) for x in (high, low))
            high[: own.shape[1]] += (own >> 32).sum(0)
            low[: own.shape[1]] += (own & 0xFFFFFFFF).sum(0)
        shown = {"dim": [-1, *range(len(high))], "high": [0, *high.tolist()], "low": [0, *low.tolist()], "n": [n] + [0] * len(high), "most": [most] + [0] * len(high)}
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in shown.items()})

    by_dim = rows.mapInArrow(count, "dim long, high long, low long, n long, most long").groupBy("dim")
    found = by_dim.agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n"), F.max("most").alias("most")).orderBy("dim").collect()
    return (found[0]["n"], found[0]["most"], [(r["high"] << 32) + r["low"] for r in found[1:]]) if found else (0, 0, [])


def scatter(rows: DataFrame, width: int, moduli: list[int]) -> np.ndarray:
    """The exact sum of outer products of the vectors with themselves, offset included."""

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(moduli), width, width), np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = vectors.widened(vectors.floored(batch.column("vector").slice(at, ROWS), FACTOR)[1], width) + OFFSET
                for k, p in enumerate(moduli):
                    residues = (own % p).astype(np.float64)
                    sums[k] = (sums[k] + (residues.T @ residues).astype(np.int64)) % p
        for k in range(len(moduli)):
            blobs = [sums[k, i, i:].astype("<u4").tobytes() for i in range(width)]
            yield pa.RecordBatch.from_arrays([pa.array([k] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array(blobs, pa.binary())], ["prime", "row", "residues"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, blob in zip(*(batch.column(c).to_pylist() for c in ("prime", "row", "residues"))):
                sums[k, i] = (sums.get((k, i), 0) + np.frombuffer(blob, "<u4").astype(np.int64)) % moduli[k]
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in keys], pa.int32()), pa.array([i for _, i in keys], pa.int32()), pa.array([sums[x].astype("<u4").tobytes() for x in keys], pa.binary())],
                ["prime", "row", "residues"],
            )

    shape = "prime int, row int, residues binary"
    parts = rows.mapInArrow(multiply, shape).repartition(common.partitions(rows.sparkSession), "prime", "row").mapInArrow(add, shape)
    residues = np.zeros((len(moduli), width, width), np.int64)
    for r in parts.collect():  # a row for each prime and dimension
        residues[r["prime"], r["row"], r["row"] :] = np.frombuffer(r["residues"], "<u4")
    upper = np.triu_indices(width)
    out = np.zeros((width, width), object)
    out[upper] = remaindered(residues[:, *upper], moduli)
    out.T[upper] = out[upper]
    return out


def _centred(own: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - sums, exact: longs where they hold it, else Python's whole numbers."""
    wide = 2 * model.n * model.most >= 1 << 63
    own = vectors.widened(own, len(model.sums)).astype(object if wide else np.int64) + OFFSET
    return model.n * own - np.array(model.sums, own.dtype)


def _whitened(centred: np.ndarray, model: Whitening) -> np.ndarray:
    spread = model.variances > 0
    return (centred / model.n).astype(np.float64) @ (model.axes[spread] / np.sqrt(model.variances[spread])[:, None]).T


def _squares(centred: np.ndarray) -> np.ndarray:
    """Sums of squares by row, exact up to the end of a long."""
    rough = (centred.astype(np.float64) ** 2).sum(1)
    small = rough < 1 << 62
    out = np.full(len(centred), LONGEST, np.int64)
    out[small] = (centred[small].astype(np.int64) ** 2).sum(1)
    for i in np.flatnonzero(~small & (rough < 1 << 64)):
        out[i] = min(LONGEST, sum(int(x) ** 2 for x in centred[i]))
    return out


def _merged(one: tuple, two: tuple) -> tuple:
    """(count, mean, centred products) of two sets together."""
    n = one[0] + two[0]
    if not n:
        return one
    apart = two[1] - one[1]
    return n, one[1] + apart * (two[0] / n), one[2] + two[2] + np.outer(apart, apart) * (one[0] * two[0] / n)


def identity_error(rows: DataFrame, model: Whitening) -> float | None:
    """The largest entry, by size, of the whitened vectors' covariance minus the identity."""
    k = int((model.variances > 0).sum())
    if not k:
        return None
    none = 0, np.zeros(k), np.zeros((k, k))
    shape = "n long, mean binary, products binary"

    def row(found: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([found[0]], pa.int64()), pa.array([found[1].tobytes()], pa.binary()), pa.array([found[2].tobytes()], pa.binary())], ["n", "mean", "products"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = none
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                white = _whitened(_centred(vectors.floored(batch.column("vector").slice(at, ROWS), FACTOR)[1], model), model)
                if len(white):
                    mean = white.mean(0)
                    found = _merged(found, (len(white), mean, (white - mean).T @ (white - mean)))
        yield row(found)

    def unpacked(r) -> tuple:
        return r["n"], np.frombuffer(r["mean"]), np.frombuffer(r["products"]).reshape(k, k)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = none
        for batch in batches:
            for r in batch.to_pylist():
                found = _merged(found, unpacked(r))
        yield row(found)

    found = none
    for r in rows.mapInArrow(measure, shape).repartition(common.partitions(rows.sparkSession)).mapInArrow(join, shape).collect():
        found = _merged(found, unpacked(r))
    return float(np.abs(found[2] / found[0] - np.eye(k)).max())


def fit(df: DataFrame, vector_column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The principal components of all vectors of `df`, each once, and how well they whiten them."""
    rows = df.select(F.col(vector_column).cast("array<double>").alias("vector"))
    n, most, sums = _totals(rows)
    width, most = len(sums), most + OFFSET
    sums = [s + n * OFFSET for s in sums]
    if not n or not width:
        return Whitening(n, tuple(sums), most, np.zeros((0, width)), np.zeros(0), 0.0)
    products = n * scatter(rows, width, primes(2 * n * most * most)) - np.outer(np.array(sums, object), np.array(sums, object))
    values, axes = np.linalg.eigh((products / (n * n)).astype(np.float64))
    order = np.argsort(-values)[:components]
    values = values[order]
    values = np.where(values > width * np.finfo(float).eps * max(0.0, values[0]), values, 0.0)
    model = Whitening(n, tuple(sums), most, axes[:, order].T, values, float(sum(products.diagonal()) / (n * n)))
    return replace(model, identity_error=identity_error(rows, model))


def whiten(df: DataFrame, model: Whitening, vector_column: str = "embedding", found: str = "whitening") -> DataFrame:
    """Rows of `df` that hold a vector, with a struct column `found` of its deviation and whitened values by component."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<deviation: bigint, whitened: array<double>>")
    def project(column: pa.Array) -> pa.Array:
        own, parts, spread = shared.value, [], shared.value.variances > 0
        kind = pa.struct({"deviation": pa.int64(), "whitened": pa.list_(pa.float64())})
        for at in range(0, len(column), ROWS):
            kept, rows = vectors.floored(column.slice(at, ROWS), FACTOR)
            centred = _centred(rows, own)
            values = np.full((len(rows), len(spread)), np.nan)
            values[:, spread] = _whitened(centred, own)
            flat = pa.array(values.ravel(), pa.float64(), mask=np.isnan(values.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(spread), pa.int32()), flat)
            made = pa.StructArray.from_arrays([pa.array(_squares(centred), pa.int64()), lists], ["deviation", "whitened"])
            at_row = np.where(kept, np.cumsum(kept) - 1, 0)
            parts.append(made.take(pa.array(at_row, pa.int64(), mask=~kept)))
        return pa.concat_arrays(parts) if parts else pa.array([], kind)

    vector: Column = F.col(vector_column).cast("array<double>")
    return df.withColumn(found, project(vector)).where(F.col(found).isNotNull())
