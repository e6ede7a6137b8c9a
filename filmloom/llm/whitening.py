"""Whitening of embeddings by merging singular value decompositions in a tree.

Each partition keeps the number, sums, singular values and right vectors of its centred rows, all dimensions of them.
Two such states merge into that of their rows together: the scaled vectors of both and one row for the difference of
their means are stacked and decomposed again. What two covariances lose by squaring is never lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import materialise, quoted, read_table
from ._vectors import is_finite, lists, matrix

#: States that meet in one task; rows that are decomposed at a time; singular values below this share of the first count as 0.
FAN_IN, BLOCK, LEAST = 8, 4096, 1e-11


@dataclass
class State:
    """Of n rows: exact sums, singular values and right vectors (scaled: one times the other) of the centred rows."""

    n: int
    sums: list[int]
    scaled: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def decomposed(n: int, sums: list[int], rows: np.ndarray) -> State:
    """The state whose centred rows have the same products as `rows`."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return State(n, sums, s[:, None] * vt)


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of the columns of a matrix of longs, however large: both halves of a long are summed apart."""
    return [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0))]


def state_of(x: np.ndarray) -> State:
    sums = exact_sums(x)
    return decomposed(len(x), sums, x - np.array([s / len(x) for s in sums]))


def merged(a: State, b: State) -> State:
    """The state of a's and b's rows: both, and the row that corrects for the difference of their means."""
    n = a.n + b.n
    row = np.sqrt(a.n / n * b.n) * (a.mean - b.mean)
    return decomposed(n, [p + q for p, q in zip(a.sums, b.sums)], np.vstack([a.scaled, b.scaled, row]))


def _rows(state: State | None, part: int) -> Iterable[pa.RecordBatch]:
    if state is None:
        return
    scaled = pa.ListArray.from_arrays(pa.array([0, state.scaled.size], pa.int32()), pa.array(state.scaled.ravel()))
    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([state.n], pa.int64()), pa.array([[Decimal(s) for s in state.sums]], pa.list_(pa.decimal128(38, 0))), scaled], names=["part", "n", "sums", "scaled"])


_STATE = "part long, n long, sums array<decimal(38,0)>, scaled array<double>"


def reduce_states(states: DataFrame, first: Callable[[Iterable[pa.RecordBatch]], State | None], label: str) -> DataFrame:
    """One state of all rows (no row for none): `first` makes that of a partition; then FAN_IN at a time meet in a task, level after level."""

    def partial(batches):
        yield from _rows(first(batches), TaskContext.get().partitionId())

    def merge(key, table):
        state = None
        for r in table.to_pylist():
            own = State(r["n"], [int(s) for s in r["sums"]], np.array(r["scaled"]).reshape(-1, len(r["sums"])))
            state = own if state is None else merged(state, own)
        return pa.Table.from_batches(_rows(state, key[0].as_py()))

    out = materialise(states.mapInArrow(partial, _STATE), label)
    parts = (out.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        grouped = out.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part")
        out, parts = materialise(grouped.applyInArrow(merge, _STATE), label, (out,)), -(-parts // FAN_IN)
    return out


def _fit(col: str, width: int) -> Callable[[Iterable[pa.RecordBatch]], State | None]:
    def first(batches):
        state = None
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index(col)), width)
            for at in range(0, len(x), BLOCK):
                own = state_of(x[at : at + BLOCK])
                state = own if state is None else merged(state, own)
        return state

    return first


@dataclass
class Model:
    """n and exact sums of the fit list, the first components (rows, none of zero variance), their eigenvalues and all of the covariance's trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: longs, or Python's numbers where longs are too short."""
        if self.n * (float(np.abs(x.astype(float)).max(initial=0)) + 1) + max(map(abs, self.sums), default=0) < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def whitened(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations / self.n).astype(float) @ self.components.T / np.sqrt(self.values)


def squared(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares; None beyond a long."""
    if d.dtype != object and (d.astype(float) ** 2).sum(1).max(initial=0) < 2**62:
        return (d * d).sum(1).tolist()
    return [s if s < 2**63 else None for s in (sum(int(c) ** 2 for c in row) for row in d)]


def fit(vectors: DataFrame, components: int | None, width: int) -> Model | None:
    """The model of the rows of x (arrays of longs); None for no rows. At most components * width numbers reach the driver."""
    state = reduce_states(vectors.select("x"), _fit("x", width), "states")
    k = width if components is None else min(components, width)
    energy = F.aggregate("scaled", F.lit(0.0), lambda s, c: s + c * c)
    row = state.select("n", "sums", F.slice("scaled", 1, max(1, k * width)).alias("top"), energy.alias("energy")).first()
    if row is None:
        return None
    top = np.array(row["top"]).reshape(-1, width) if width else np.zeros((0, 0))
    s = np.sqrt((top**2).sum(1))
    own = (s > LEAST * s.max(initial=0)) & (s > 0)
    vt = top[own] / s[own, None]
    vt *= np.where(np.take_along_axis(vt, np.abs(vt).argmax(1)[:, None], 1) < 0, -1, 1) if len(vt) else 1
    return Model(row["n"], [int(x) for x in row["sums"]], vt, s[own] ** 2 / row["n"], row["energy"] / row["n"])


def identity_error(vectors: DataFrame, model: Model, width: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, centred before multiplying."""
    scale, k = 2.0**40, len(model.components)  # a state's sums are whole numbers
    if not k:
        return None

    def first(batches):
        state = None
        for b in batches:
            w = model.whitened(model.deviations(matrix(b.column(0), width)))
            for at in range(0, len(w), BLOCK):
                part = w[at : at + BLOCK]
                own = decomposed(len(part), [int(c) for c in np.rint(part.sum(0) * scale)], (part - part.mean(0)) * scale)
                state = own if state is None else merged(state, own)
        return state

    row = reduce_states(vectors.select("x"), first, "whitened").first()
    scaled = np.array(row["scaled"]).reshape(-1, k) / scale
    return float(np.abs(scaled.T @ scaled / row["n"] - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int | None = 4, scale: float = 256.0) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained, identity_error: a row for each valid vector and component.

    Entries become x = floor(scale * c), beyond longs the nearest long. The model is fitted to the different x, each once:
    n of them. components: how many of the largest, None for all dimensions. deviation: the sum of (n * x - S)^2 over
    dimensions, null beyond a long. Vectors that are null or hold null or non-finite entries are left out; repeated rows
    and ids are answered each, null ids too. Vectors shorter than the longest are filled with zeros. A component without
    variance has a null whitened and 0 as explained (null if no component has variance). An empty table gives an empty result;
    other columns don't matter. Nothing but the components, sums and eigenvalues is on the driver or sent to all tasks.
    """
    v = F.col(quoted(vec_col)).cast("array<double>")
    x = F.transform(v, lambda c: F.floor(c * scale))
    rows = vectors.where(is_finite(v)).select(F.col(quoted(id_col)).alias("_id"), x.alias("x"))
    kind = vectors.schema[id_col].dataType
    schema = f"_id {kind.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = materialise(rows.select("x").distinct(), "fit")
    width = distinct.agg(F.max(F.size("x"))).first()[0] or 0
    model = fit(distinct, components, width) or Model(0, [], np.zeros((0, width)), np.zeros(0), 0.0)
    error = identity_error(distinct, model, width)
    k, own = width if components is None else min(components, width), len(model.components)
    explained = [*(model.values / model.trace), *[0.0] * (k - own)] if model.trace else [None] * k
    arrow_id = to_arrow_type(kind)

    def run(batches):
        for b in batches:
            d = model.deviations(matrix(b.column(1), width))
            w = np.full((len(d), k), np.nan)
            w[:, :own] = model.whitened(d)
            each = lambda a: np.repeat(np.arange(len(d)), k) if a is None else np.tile(a, len(d))
            at = pa.array(each(None))
            cols = [b.column(0).cast(arrow_id).take(at), pa.array(each(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(at), model.n)), pa.array(squared(d), pa.int64()).take(at), pa.array(w.ravel(), mask=np.isnan(w.ravel())), pa.array(explained * len(d), pa.float64()), pa.array([error] * len(at), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
