"""Whitening of embeddings by a tall-skinny QR, without forming their covariance.

Vectors become whole numbers. The fit list holds each different vector once; its sums are exact, so rows are centred exactly.
Each task reduces its centred rows to the R of a QR, batch by batch; the R factors are merged in a tree, FANIN at a time, by
further QRs of two or more stacked, and the last one's singular value decomposition gives right vectors and scales that whiten.
The driver sees sums, one R and one matrix of COMPONENTS by COMPONENTS, whose sizes the dimension fixes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import limited_batches, ship, table, written

ship(__name__)

SCALE, COMPONENTS = 256, 4
#: R factors that one task of the tree merges.
FANIN = 16
#: Directions whose singular value is under this part of the largest, times the dimension, have no variance.
TINY = float(np.finfo(np.float64).eps)


def whole_numbers(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """df with x: floor(scale * entry) of each entry, as longs, or null where the vector is null, empty or holds an entry that is null or not finite."""
    v = F.col(f"`{vector}`").cast("array<double>")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.withColumn("x", F.when(v.isNotNull() & (F.size(v) > 0) & ~bad, F.transform(v, lambda c: F.floor(c * scale).cast("long"))))


def _matrices(batches, d: int):
    for batch in batches:
        x = batch.column(batch.schema.get_field_index("x"))
        if len(x):
            yield x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), d)


def _packed(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


def sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of rows and exact sum of each dimension; each task adds up its own rows first."""

    def each(batches):
        n, total = 0, [0] * d
        for x in _matrices(batches, d):
            safe = len(x) * int(max(abs(int(x.max())), abs(int(x.min())))) < 2**63
            add = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
            n, total = n + len(x), [a + int(b) for a, b in zip(total, add)]
        yield _packed(n=pa.array([n], pa.int64()), at=pa.array([-1], pa.int32()), s=pa.array(["0"]))
        yield _packed(n=pa.array([0] * d, pa.int64()), at=pa.array(range(d), pa.int32()), s=pa.array(list(map(str, total))))

    parts = fit.select("x").mapInArrow(each, "n long, at int, s string")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()  # d + 1 rows
    by = {r["at"]: r for r in rows}
    return by[-1]["n"], [int(by[i]["s"]) for i in range(d)]


def _centred(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    """x - s / n; n * x - s is exact in whole numbers and rounded once."""
    return exact_deviations(x, n, s).astype(np.float64) / n


def exact_deviations(x: np.ndarray, n: int, s: np.ndarray) -> np.ndarray:
    most = max(abs(int(x.max())), abs(int(x.min())), 1)
    return x * n - s if most * n < 2**61 and max(map(abs, s.tolist())) < 2**61 else x.astype(object) * n - s


def _reduced(stack: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(stack), mode="r")


def _rows_of(r: np.ndarray | None, d: int):
    """An R factor as one row of bytes; fewer than d rows are filled up with zeros."""
    if r is not None:
        full = np.zeros((d, d))
        full[: len(r)] = r
        yield _packed(r=pa.array([full.tobytes()], pa.binary()))


def r_factor(fit: DataFrame, d: int, n: int, s: np.ndarray, fanin: int = FANIN) -> np.ndarray:
    """R of the QR of all centred rows of fit."""

    def leaf(batches):
        r = None
        for x in _matrices(batches, d):
            r = _reduced([_centred(x, n, s)] if r is None else [r, _centred(x, n, s)])
        yield from _rows_of(r, d)

    def merge(batches):
        r = None
        for batch in batches:
            for b in batch.column(0).to_pylist():
                one = np.frombuffer(b).reshape(d, d)
                r = one if r is None else _reduced([r, one])
        yield from _rows_of(r, d)

    factors = written(limited_batches(fit.select("x")).mapInArrow(leaf, "r binary"), "whitening-r")
    while (parts := factors.count()) > 1:
        factors = written(factors.repartition(math.ceil(parts / fanin)).mapInArrow(merge, "r binary"), "whitening-r")
    return np.frombuffer(bytes(factors.first()["r"])).reshape(d, d)


class Whitening:
    """n, sums, right vectors, scales and explained shares of at most `components` directions."""

    def __init__(self, n: int, s: list[int], r: np.ndarray, components: int):
        self.n, self.s = n, np.array(s, dtype=np.int64 if max(map(abs, s)) < 2**63 else object)
        _, sizes, right = np.linalg.svd(r)
        k = min(components, len(s))
        self.vectors = right[:k].T.copy()
        has = sizes[:k] > sizes[0] * TINY * len(s)
        self.scales = np.where(has, math.sqrt(n) / np.where(has, sizes[:k], 1), np.nan)
        energy = sizes**2
        self.explained = energy[:k] / energy.sum() if sizes[0] > 0 else np.full(k, np.nan)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, self.n, self.s) @ self.vectors * self.scales

    def deviations(self, x: np.ndarray) -> list[int]:
        y = exact_deviations(x, self.n, self.s)
        if y.dtype == object or int(np.abs(y).max()) ** 2 * y.shape[1] >= 2**63:
            y = y.astype(object)
        out = [int(v) for v in (y * y).sum(axis=1)]
        if max(out) >= 2**63:
            raise OverflowError("a deviation is beyond a long")
        return out


def identity_error(fit: DataFrame, model: Whitening) -> float | None:
    """The largest absolute entry of the covariance of whitened rows of fit less the identity, over directions with variance."""
    d, k = len(model.s), len(model.scales)

    def each(batches):
        total, products = np.zeros(k), np.zeros((k, k))
        for x in _matrices(batches, d):
            w = model.apply(x)
            total, products = total + w.sum(axis=0), products + w.T @ w
        yield _packed(at=pa.array(range(k + k * k), pa.int32()), v=pa.array(np.r_[total, products.ravel()], pa.float64()))

    rows = limited_batches(fit.select("x")).mapInArrow(each, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k + k * k rows
    v = np.zeros(k + k * k)
    for r in rows:
        v[r["at"]] = r["v"] / model.n
    # rows are centred already: the mean is rounding alone
    error = np.abs(v[k:].reshape(k, k) - np.outer(v[:k], v[:k]) - np.eye(k))
    has = ~np.isnan(model.scales)
    return float(error[np.ix_(has, has)].max()) if has.any() else None


def fitted(rows: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening, float | None] | None:
    """rows (x: arrays of one length) -> fit list, model and identity error; None for no rows."""
    fit = written(rows.select("x").distinct(), "whitening-fit")
    first = fit.first()
    if first is None:
        return None
    d = len(first["x"])
    n, s = sums(limited_batches(fit), d)
    at = np.array(s, dtype=np.int64 if max(map(abs, s)) < 2**63 else object)
    model = Whitening(n, s, r_factor(fit, d, n, at), components)
    return fit, model, identity_error(fit, model)


def whiten(df: DataFrame, vector: str = "embedding", key: str = "vec_id", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: one row for each row of df and component.

    Rows whose vector is null, empty, or holds an entry that is null or not finite are dropped, and so are vectors of
    another length than most rows have (of two lengths with as many rows, the shorter counts). Equal vectors count once in the fit, whatever
    their ids; each of their rows is returned. Components are at most the dimension; in a direction without variance
    whitened is null, and the shares explained are null if no direction has any. Equal variances have any vectors that fit
    them. Ids may be null or repeat. An empty table, or one without usable rows, gives an empty result. A deviation beyond a long is an error.
    """
    spark: SparkSession = df.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = whole_numbers(df.select(F.col(f"`{key}`").alias("vec_id"), F.col(f"`{vector}`").alias("v_")), "v_", scale).select(F.col("vec_id").cast("long").alias("vec_id"), "x").filter("x is not null")
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("m")).orderBy(F.desc("m"), "d").first()
    if common is None:
        return spark.createDataFrame([], schema)
    d = common["d"]
    rows = rows.filter(F.size("x") == d)
    _, model, error = fitted(rows, components)
    sent = spark.sparkContext.broadcast((model, error))  # d numbers for each component and dimension

    def each(batches):
        model, error = sent.value
        k = len(model.scales)
        for batch in batches:
            for x in _matrices([batch], d):
                ids, m = batch.column(0), len(x)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": ids.take(pa.array(np.repeat(np.arange(m), k))), "component": pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), "n": pa.array([model.n] * (m * k), pa.int64()), "deviation": pa.array(np.repeat(np.array(model.deviations(x), np.int64), k)),
                    "whitened": pa.array(model.apply(x).ravel(), pa.float64(), from_pandas=True), "explained": pa.array(np.tile(model.explained, m), pa.float64(), from_pandas=True), "identity_error": pa.array([error] * (m * k), pa.float64()),
                })

    return limited_batches(rows).mapInArrow(each, schema)


def op12_whitening(spark, sf_dir):
    """whiten() of all embeddings."""
    return whiten(table(spark, sf_dir, "embeddings"))
