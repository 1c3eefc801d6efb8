"""Embedding whitening by hierarchical SVD merging.

Every partition keeps its number of vectors, their exact sums, and all singular values and right vectors of its centred
vectors. Two such states merge by stacking their scaled vectors and one mean-correction row, sqrt(a b / (a + b)) times the
difference of the means, and a new SVD; nothing is truncated, so the last state is that of all vectors at once. States are
as large as the square of the dimension, whatever the number of vectors, and merge in a tree of fixed fan-in.

Edge cases: rows whose vector is null, empty or holds null or non-finite entries are dropped; the space is that of the
commonest length of the others (ties: the longest), and vectors of other lengths are dropped too, as they have no place in
it; repeated rows are fitted once and all returned; null keys are allowed; extra columns are ignored; empty tables give empty
results. Components without variance (all vectors alike, or fewer vectors than components) have explained 0 and a null
coordinate, as they cannot be scaled to variance one. A deviation beyond 64 bits is null in `deviation`, and whole in
`deviation_exact` (null beyond 38 digits). Entries beyond 2**55 count as that (floor saturates at 64 bits).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basisline.llm.common import stored, table

SCALE = 256  # an entry c becomes floor(SCALE * c)
FAN_IN = 16  # states merged by one task
BATCH = 4096  # vectors taken into a state at once
COMPONENTS = 4
STATE = "id long, n long, sums array<decimal(38,0)>, singular array<double>, vectors binary"


@dataclass(frozen=True)
class State:
    """What is kept of n vectors: their exact sums, and singular values and right vectors of the centred ones."""

    n: int
    sums: tuple[int, ...]
    singular: np.ndarray
    vectors: np.ndarray

    def merged(self, other: State) -> State:
        n, d = self.n + other.n, len(self.sums)
        apart = np.asarray([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        correction = np.sqrt(self.n * other.n / n) * apart
        rows = np.vstack([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, correction.reshape(1, d)])
        _, s, vt = np.linalg.svd(rows, full_matrices=False)
        return State(n, tuple(a + b for a, b in zip(self.sums, other.sums, strict=True)), s, vt)

    @staticmethod
    def of(x: np.ndarray) -> State:
        """Of whole vectors, which are centred before anything is multiplied."""
        wide = len(x) * float(np.abs(x.astype("float64")).max()) >= 2**62
        sums = tuple(int(v) for v in (x.astype(object) if wide else x).sum(axis=0))
        _, s, vt = np.linalg.svd(x - np.asarray([v / len(x) for v in sums]), full_matrices=False)
        return State(len(x), sums, s, vt)

    def row(self, at: int) -> tuple:
        return at, self.n, [Decimal(v) for v in self.sums], self.singular.tolist(), np.ascontiguousarray(self.vectors).tobytes()

    @staticmethod
    def read(row: object) -> State:
        return State(int(row.n), tuple(int(v) for v in row.sums), np.asarray(row.singular, "float64"), np.frombuffer(bytes(row.vectors), "float64").reshape(-1, len(row.sums)))


@dataclass(frozen=True)
class Whitening:
    """A fitted space: n vectors, their sums, and all components by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    eigenvalues: np.ndarray
    components: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        total = self.eigenvalues.sum()
        return self.eigenvalues / total if total > 0 else self.eigenvalues

    def scales(self, k: int) -> np.ndarray:
        """One over the square root of each eigenvalue; NaN where there is no variance beyond rounding."""
        e = self.eigenvalues[:k]
        least = self.eigenvalues[0] * (len(self.sums) * np.finfo("float64").eps) ** 2 * max(self.n, 1)
        with np.errstate(divide="ignore"):
            return np.where((e > 0) & (e > least), 1 / np.sqrt(e), np.nan)


def finite(vector: str) -> Column:
    """A vector with entries, none of them null or non-finite."""
    return (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))


def integral(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows key, x (long entries) of the usable vectors of the commonest length."""
    good = rows.where(F.coalesce(finite(vector), F.lit(False))).select(F.col(key), F.col(vector).alias("__v"))
    lengths = good.groupBy(F.size("__v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()  # one row
    kept = good.where(F.size("__v") == (lengths[0]["d"] if lengths else 0))
    return kept.select(F.col(key), F.transform("__v", lambda c: F.floor(c.cast("double") * SCALE) + F.lit(0)).cast("array<bigint>").alias("x"))


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as the rows of a matrix."""
    return np.asarray(column.flatten()).reshape(len(column), -1)


def partition_states(x: DataFrame) -> DataFrame:
    """One state for each partition that holds a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for i in range(0, batch.num_rows, BATCH):
                new = State.of(matrix(batch.column(0).slice(i, BATCH)))
                state = new if state is None else state.merged(new)
        if state is not None:
            _, n, sums, singular, vectors = state.row(0)
            kinds = [pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((n, sums, singular, vectors), kinds, strict=True)], names=["n", "sums", "singular", "vectors"])

    return x.select("x").mapInArrow(run, STATE.split(", ", 1)[1]).select(F.spark_partition_id().cast("long").alias("id"), "n", "sums", "singular", "vectors")


def merged_states(states: DataFrame) -> State | None:
    """The state of all vectors: FAN_IN states a task at a time, in the order of their ids, until one is left."""

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        found = [State.read(r) for r in rows.sort_values("id").itertuples()]
        state = found[0]
        for other in found[1:]:
            state = state.merged(other)
        return pd.DataFrame([state.row(int(rows.id.min()) // FAN_IN)], columns=["id", "n", "sums", "singular", "vectors"])

    states = stored(states, "svd-states")
    while states.count() > 1:
        states = stored(states.groupBy(F.expr(f"id div {FAN_IN}").alias("__g")).applyInPandas(merge, STATE), "svd-states")
    last = states.collect()  # one row, of the size of the square of the dimension
    return State.read(last[0]) if last else None


def fitted(vectors: DataFrame) -> Whitening | None:
    """The space of stored distinct vectors `x`; None if there are none."""
    state = merged_states(partition_states(vectors))
    if state is None:
        return None
    d = len(state.sums)
    e = np.zeros(d)
    e[: len(state.singular)] = state.singular[:d] ** 2 / state.n
    vt = np.zeros((d, d))
    vt[: len(state.vectors)] = state.vectors[:d]
    return Whitening(state.n, state.sums, e, vt)


def deviations(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int]:
    """Sum over dimensions of (n x - S)**2, exact: in 64 bits where a bound shows that they suffice, else in Python's."""
    most = max([n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))]) if x.size else 0
    if most * most * x.shape[1] < 2**63:
        return (((n * x - np.asarray(sums, "int64")) ** 2).sum(axis=1)).tolist()
    wide = n * x.astype(object) - np.asarray(sums, dtype=object)
    return (wide * wide).sum(axis=1).tolist()


def whitened(rows: DataFrame, key: str, model: Whitening, k: int = COMPONENTS) -> DataFrame:
    """Rows key, deviation, deviation_exact, whitened (coordinates on the first k components) of integral rows."""
    n, sums, top, scale = model.n, model.sums, model.components[:k], model.scales(k)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean = np.asarray([s / n for s in sums])
        for batch in batches:
            x = matrix(batch.column(1)) if batch.num_rows else np.zeros((0, len(sums)), "int64")
            y = ((x - mean) @ top.T) * scale
            exact = deviations(x, n, sums)
            coordinates = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype="int32") * y.shape[1], pa.array(y.ravel(), pa.float64(), from_pandas=True))
            narrow = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
            decimal = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), narrow, decimal, coordinates], names=["key", "deviation", "deviation_exact", "whitened"])

    out = rows.select(F.col(key), "x").mapInArrow(run, f"key {kind}, deviation long, deviation_exact decimal(38,0), whitened array<double>")
    return out.withColumnRenamed("key", key) if key != "key" else out


def identity_error(vectors: DataFrame, model: Whitening, k: int = COMPONENTS) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity (0 without any variance)."""
    at = [i for i, s in enumerate(model.scales(k)) if not np.isnan(s)]
    if not at:
        return 0.0
    w = whitened(vectors.withColumn("__k", F.lit(0)), "__k", model, k).select(*[F.col("whitened")[i].alias(f"w{i}") for i in at])
    found = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in at for j in at if i <= j]).first()
    return max(abs(found[f"c{i}_{j}"] - (i == j)) for i in at for j in at if i <= j)


def whitened_components(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = COMPONENTS) -> DataFrame:
    """A row for each usable row and component up to k: key, component, n, deviation, whitened, explained, identity_error,
    deviation_exact."""
    points = integral(rows, key, vector)
    vectors = stored(points.select("x").distinct(), "distinct-vectors")
    model = fitted(vectors)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(vectors, model, k)
    parts = F.split(F.lit(",".join(repr(float(v)) for v in model.explained[:k])), ",").cast("array<double>")
    out = whitened(points, key, model, k).select(key, "deviation", "deviation_exact", F.posexplode("whitened").alias("at", "whitened"))
    return out.select(key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", parts[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"), "deviation_exact")


def op11_svd_merge_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(table(spark, sf_dir, "embeddings"))
