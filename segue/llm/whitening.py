"""Whitening of integer embeddings, each distinct vector counted and whitened once.

Vectors become integers (``floor(scale * c)``) and equal ones are grouped by all their components.
The fit list is the distinct vectors, each weighted by one or by its number of copies. Sums are exact
integers; the covariance is a sum of weighted matrix products of centred blocks, one small matrix from
each task, and its eigenvectors are taken on the driver (one matrix of the vectors' length squared).
A second pass whitens each distinct vector, and every row gets its vector's numbers by a join on two
64-bit hashes; the job stops if two different vectors share both, so the join is exact.

Defined results: rows whose vector is NULL, empty, or holds NULL or non-finite entries, or entries that
times the scale don't fit a long, are dropped; so are vectors of another length than the most frequent
one (of equally frequent lengths the shorter). Repeated rows and rows with a NULL vec_id are kept.
Components whose eigenvalue is zero within rounding have no unit variance and are not returned, so one
distinct vector alone gives no rows; an empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segue.llm.shared import lean
from segue.session import materialise

RESULT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
BLOCK = 4096


def whole_vectors(vectors: DataFrame, scale: float) -> DataFrame:
    """(vec_id, x, h1, h2): valid rows with their integer vector and its two hashes."""
    c = F.col("embedding").cast("array<double>")
    valid = F.forall(c, lambda v: F.coalesce(F.abs(v * scale) < float(1 << 63), F.lit(False)))
    rows = vectors.where((F.size(c) > 0) & valid).select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c"))
    rows = rows.select("vec_id", F.transform("c", lambda v: F.floor(v * scale).cast("long")).alias("x"))
    return rows.withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")})


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray]]:
    """The integer vectors of a batch, some rows at a time."""
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        yield slice(at, at + part.num_rows), np.asarray(part.column("x").flatten(), dtype=np.int64).reshape(part.num_rows, -1)


def _exact(values: np.ndarray, most: int) -> np.ndarray:
    """As Python's integers where a long would not hold ``most``."""
    return values if most < 1 << 63 else values.astype(object)


def _largest(x: np.ndarray) -> int:
    return max(-int(x.min()), int(x.max())) if x.size else 0


def _decimals(values: list[int] | np.ndarray) -> pa.Array:
    return pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0))


def exact_sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """The total weight, and each dimension's weighted sum, exact."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, None
        for batch in batches:
            weights = np.asarray(batch.column("weight"), dtype=np.int64)
            for rows, x in _blocks(batch):
                w = weights[rows]
                most = (_largest(x) + 1) * int(w.sum())
                part = (_exact(x, most) * _exact(w, most)[:, None]).sum(axis=0)
                sums = part.astype(object) if sums is None else sums + part.astype(object)
                total += int(w.sum())
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), _decimals([total, *sums])], ["i", "total"])

    found = distinct.select("x", "weight").mapInArrow(lean(add), "i int, total decimal(38,0)").groupBy("i").agg(F.sum("total").alias("total")).collect()
    by_place = {r.i: int(r.total) for r in found}
    return by_place.get(-1, 0), [by_place[i] for i in range(len(by_place) - 1)]


def covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The weighted covariance, centred before multiplying, divisor ``n``."""
    dim, centre = len(sums), np.array([s / n for s in sums])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        product = np.zeros((dim, dim))
        for batch in batches:
            weights = np.asarray(batch.column("weight"), dtype=np.float64)
            for rows, x in _blocks(batch):
                centred = x - centre
                product += (centred * weights[rows][:, None]).T @ centred
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(product[i, j])], ["i", "j", "s"])

    parts = distinct.select("x", "weight").mapInArrow(lean(multiply), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    out = np.zeros((dim, dim))
    for r in parts:
        out[r.i, r.j] = out[r.j, r.i] = r.s / n
    return out


def principal(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues that are not zero within rounding, falling, and unit eigenvectors as columns,
    the entry largest in size positive."""
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    kept = values > max(len(v) * np.finfo(float).eps * abs(np.trace(v)), 0)
    values, vectors = values[kept], vectors[:, kept]
    if len(values):
        vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))])
    return values, vectors


def whiten(vectors: DataFrame, scale: float = 256.0, components: int = 4, by_copies: bool = False) -> DataFrame:
    """For each valid row and component (from 1, by falling eigenvalue): n (the fit's weight), deviation (the
    sum of (n * x - S) squared, exact), whitened, explained (the eigenvalue's share of the trace), and
    identity_error (the largest entry of the whitened fit list's covariance minus the identity)."""
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, scale)
    distinct = rows.groupBy("x").agg(F.count("*").alias("copies")).withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(1), "x")})
    distinct = materialise(distinct.withColumns({"dim": F.size("x"), "weight": F.col("copies") if by_copies else F.lit(1).cast("long")}), "distinct")
    lengths = distinct.groupBy("dim").agg(F.sum("copies").alias("rows")).orderBy(F.desc("rows"), "dim").first()
    if lengths is None:
        return spark.createDataFrame([], RESULT)
    dim = lengths["dim"]
    distinct = distinct.where(F.col("dim") == dim)
    if not distinct.groupBy("h1", "h2").count().where("count > 1").isEmpty():
        raise RuntimeError("two different vectors share both hashes")
    n, sums = exact_sums(distinct)
    v = covariance(distinct, n, sums)
    values, axes = principal(v, components)
    if not len(values):
        return spark.createDataFrame([], RESULT)
    centre, width = np.array([s / n for s in sums]), len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, deviation = np.empty((batch.num_rows, width)), []
            for at, x in _blocks(batch):
                out[at] = ((x - centre) @ axes) / np.sqrt(values)
                most = n * _largest(x) + max(map(abs, sums))
                far = _exact(x, most) * n - np.array(sums, dtype=object if most >= 1 << 63 else np.int64)
                far = _exact(far, dim * most * most)
                deviation += (far * far).sum(axis=1).tolist()
            columns = [batch.column("h1"), batch.column("h2"), batch.column("weight"), _decimals(deviation)]
            whitened = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, whitened], ["h1", "h2", "weight", "deviation", "whitened"])

    white = distinct.select("x", "h1", "h2", "weight").mapInArrow(lean(project), "h1 long, h2 long, weight long, deviation decimal(38,0), whitened array<double>")
    white = materialise(white, "whitened")
    entry = lambda i: F.col("whitened")[i]
    means = white.agg(*[(F.sum(entry(i) * F.col("weight")) / n).alias(f"m{i}") for i in range(width)]).first()
    pairs = [(i, j) for i in range(width) for j in range(i, width)]
    products = white.agg(*[(F.sum((entry(i) - means[i]) * (entry(j) - means[j]) * F.col("weight")) / n).alias(f"p{i}_{j}") for i, j in pairs]).first()
    error = max(abs(p - (i == j)) for p, (i, j) in zip(products, pairs))
    shares = F.array(*[F.lit(float(e / np.trace(v))) for e in values])
    met = rows.where(F.size("x") == dim).select("vec_id", "h1", "h2").join(white.drop("weight"), ["h1", "h2"])
    met = met.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return met.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(float(error)).alias("identity_error"),
    )
