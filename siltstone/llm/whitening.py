"""Embedding whitening: blockwise TSQR of centred rows, then a one-sided Jacobi SVD of the triangle.

Components become whole numbers, so that sums and the squared deviation of a row are exact. Rows are
centred as (n x - S) / n, a whole number divided once, before anything is multiplied. Each block of rows
is compressed to a triangle R, triangles are stacked and compressed again, FAN_IN or fewer at a
time (no more than STACK bytes), until one is left. Plane rotations of pairs of its columns, as many disjoint
pairs at once as there are, make the columns orthogonal: their lengths are the standard deviations times
sqrt(n), the accumulated rotations the components. Nothing is ever squared into a covariance, so small
deviations keep their digits. What passes the driver is the model: sums, deviations and kept components.

Defined cases: a vector that is null or holds a null or a component that is not finite takes no part
(nor one that leaves the range of a long when scaled); all others count, with their repeats and with a
null id; of vectors of several lengths those of the commonest length count (of equally common ones the
longest), and an empty vector never does; directions without deviation (below RANK of the largest) have no whitened value
and are left out, as is all if every row is the same; components are 32 or as many as there are dimensions; a squared
deviation beyond a long counts as its end; each component's largest entry is positive; an empty table
gives no rows; columns beside vec_id and embedding are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
#: Rows of a block that is compressed at once, triangles that are stacked, bytes of a stack, and the smallest relative deviation.
BLOCK, FAN_IN, STACK, RANK = 2048, 16, 256 << 20, 1e-12
#: Sweeps end when no pair of columns is further from orthogonal than this.
ORTHOGONAL = 1e-15
LONGEST = 2**63 - 1


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and x (whole numbers) of every row whose vector takes part, of whatever length."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float(2**62 // SCALE)))
    rows = rows.where((F.size("v") > 0) & F.coalesce(good, F.lit(False)))
    return rows.select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + F.lit(OFFSET)).alias("x"))


@dataclass(frozen=True)
class Centre:
    """n and S of the fit list; rows are centred by them."""

    n: int
    sums: np.ndarray

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: as longs where they hold it, else as whole numbers of any size."""
        most = max(int(np.abs(x).max(initial=0)), 1)
        if self.sums.dtype != object and 2 * self.n * most < LONGEST:
            return self.n * x - self.sums
        return self.n * x.astype(object) - self.sums.astype(object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(np.float64)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """The sum over dimensions of (n x - S)**2 of each row."""
        y = self.numerators(x)
        if y.dtype != object and float(np.abs(y).max(initial=0)) ** 2 * y.shape[1] < LONGEST:
            return (y * y).sum(axis=1)
        return np.array([min(sum(int(c) ** 2 for c in row), LONGEST) for row in y], np.int64)


def centre_of(rows: DataFrame) -> Centre:
    """Exact sums of the rows of the commonest length: batches add in longs as far as they hold it, and are added as decimals."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, some in pdf.groupby(pdf["x"].map(len)):
                # halves of 32 bits, so that no sum of a batch leaves a long
                x = np.stack(some["x"].to_numpy())
                yield pd.DataFrame({"d": d, "dim": range(d), "high": (x >> 32).sum(axis=0), "low": (x & 0xFFFFFFFF).sum(axis=0), "n": len(x)})

    parts = rows.select("x").mapInPandas(run, "d int, dim int, high bigint, low bigint, n bigint")
    whole = [F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("high", "low", "n")]
    sums = written(parts.groupBy("d", "dim").agg(*whole), "sums")
    top = sums.where("dim = 0").orderBy(F.col("n").desc(), F.col("d").desc()).first()
    if not top:
        return Centre(0, np.zeros(0, np.int64))
    exact = [(int(r["high"]) << 32) + int(r["low"]) for r in sums.where(F.col("d") == top["d"]).orderBy("dim").collect()]
    return Centre(int(top["n"]), np.array(exact, np.int64 if max(map(abs, exact)) < LONGEST // 4 else object))


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def triangles(rows: DataFrame, centre: Centre) -> DataFrame:
    """part, r: one triangle of each partition of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = np.zeros((0, len(centre.sums)))
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                r = triangle(np.vstack([r, centre.centred(np.stack(pdf["x"].iloc[at : at + BLOCK].to_numpy()))]))
        if len(r):
            yield pd.DataFrame({"r": [r.tobytes()]})

    return rows.select("x").mapInPandas(run, "r binary").select(F.spark_partition_id().alias("part"), "r")


def compressed(rows: DataFrame, centre: Centre) -> np.ndarray:
    """The triangle of all rows: those of partitions, stacked and compressed in a tree."""
    d = len(centre.sums)
    fan = int(max(2, min(FAN_IN, STACK // (8 * d * d))))

    def stack(pdf: pd.DataFrame) -> pd.DataFrame:
        r = triangle(np.vstack([np.frombuffer(b, np.float64).reshape(-1, d) for b in pdf.sort_values("part")["r"]]))
        return pd.DataFrame({"part": [int(pdf["part"].iloc[0]) // fan], "r": [r.tobytes()]})

    parts = written(triangles(rows, centre), "triangles")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        parts, left = parts.groupBy(F.floor(F.col("part") / fan)).applyInPandas(stack, "part bigint, r binary"), -(-left // fan)
    found = [np.frombuffer(row["r"], np.float64).reshape(-1, d) for row in parts.select("r").collect()]
    return found[0] if found else np.zeros((0, d))


def meetings(d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounds of disjoint pairs in which each of d columns meets every other once (one seat stays, the others move on)."""
    seats = np.arange(d + d % 2)
    half = len(seats) // 2
    for _ in range(len(seats) - 1):
        i, j = np.minimum(seats[:half], seats[::-1][:half]), np.maximum(seats[:half], seats[::-1][:half])
        yield i[j < d], j[j < d]
        seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the orthogonalised columns of r, falling, and the rotations that made them: r v has columns of those lengths."""
    d = r.shape[1]
    # columns as rows: a rotation then works on two runs of memory
    a, v = np.ascontiguousarray(r.T), np.eye(d)
    for _ in range(sweeps):
        furthest = 0.0
        for i, j in meetings(d):
            x, y = a[i], a[j]
            xx, yy, xy = (x * x).sum(1), (y * y).sum(1), (x * y).sum(1)
            size = np.sqrt(xx) * np.sqrt(yy)
            apart = np.divide(np.abs(xy), size, out=np.zeros(len(i)), where=size > 0)
            furthest = max(furthest, apart.max(initial=0.0))
            turn = apart > ORTHOGONAL
            if not turn.any():
                continue
            i, j, x, y = i[turn], j[turn], x[turn], y[turn]
            zeta = (yy[turn] - xx[turn]) / (2.0 * xy[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c = 1.0 / np.hypot(1.0, t)
            c, s = c[:, None], (c * t)[:, None]
            a[i], a[j] = c * x - s * y, s * x + c * y
            v[i], v[j] = c * v[i] - s * v[j], s * v[i] + c * v[j]
        if furthest <= ORTHOGONAL * d:
            break
    lengths = np.sqrt((a * a).sum(1))
    order = np.argsort(-lengths, kind="stable")
    return lengths[order], v[order].T


@dataclass(frozen=True)
class Whitening:
    """What whitens rows: the centre, kept components (as columns) with their standard deviations, and their shares of the trace."""

    centre: Centre
    components: np.ndarray
    deviations: np.ndarray
    explained: np.ndarray

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.centred(x) @ self.components / self.deviations


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of all rows (vec_id, x) that are of the commonest length."""
    centre = centre_of(rows)
    d = len(centre.sums)
    lengths, v = jacobi(compressed(rows.where(F.size("x") == d), centre) if d else np.zeros((0, 0)))
    kept = np.flatnonzero((lengths > RANK * lengths.max(initial=0.0)) & (lengths > 0))[:components]
    v = v[:, kept]
    if len(kept):
        v = v * np.where(v[np.abs(v).argmax(axis=0), np.arange(len(kept))] < 0, -1.0, 1.0)
    power = lengths**2
    return Whitening(centre, v, lengths[kept] / np.sqrt(max(centre.n, 1)), power[kept] / max(power.sum(), np.finfo(float).tiny))


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest entry of the covariance of all whitened rows minus the identity.

    Whitened rows are centred already; what rounding left of their means is taken off.
    """
    k = len(model.deviations)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k + 1))
        for pdf in batches:
            if len(pdf):
                w = model.whitened(np.stack(pdf["x"].to_numpy()))
                total += w.T @ np.hstack([w, np.ones((len(w), 1))])
        yield pd.DataFrame({"at": range(total.size), "value": total.ravel()})

    got = rows.select("x").mapInPandas(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    total = np.array([r["value"] for r in got] or np.zeros(k * (k + 1))).reshape(k, k + 1) / max(model.centre.n, 1)
    mean = total[:, -1]
    return float(np.abs(total[:, :-1] - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = valid(vectors)
    model = fit(rows, components)
    rows = rows.where(F.size("x") == len(model.centre.sums))
    error, k = identity_error(rows, model), len(model.deviations)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf) if k else 0, BLOCK):
                some = pdf.iloc[at : at + BLOCK]
                x = np.stack(some["x"].to_numpy())
                ids = some["vec_id"].astype("Int64").repeat(k)
                columns = {"component": np.tile(np.arange(1, k + 1), len(x)), "n": model.centre.n, "deviation": model.centre.deviations(x).repeat(k)}
                numbers = {"whitened": model.whitened(x).ravel(), "explained": np.tile(model.explained, len(x)), "identity_error": error}
                yield pd.DataFrame({"vec_id": ids.array, **columns, **numbers})

    return rows.mapInPandas(run, "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
