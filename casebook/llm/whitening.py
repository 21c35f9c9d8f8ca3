"""Embedding whitening from an exact integer scatter.

Entries become integers on a grid (``grid`` steps a unit, plus ``offset``). Covariances are taken over the distinct integer vectors of a width, so
copies do not weigh. Tasks subtract the shift (the offset), and accumulate sums and cross-products exactly: a vector is split into limbs of ``LIMB``
bits, whose products over ``CHUNK`` rows stay below 2^53, so each product is a matrix product of floats without any rounding. A task's sums are
cut into limbs again and added up by Spark, an integer sum for each pair of dimensions and limb. The driver puts the limbs of one matrix together,
forms n X'X - SS' in integers of any size, and only then converts to float and decomposes by ``eigh``. What it holds depends on the width alone.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; zero vectors stay. Each width is whitened by itself (an
empty vector has no components, and a width above ``MAX_WIDTH`` is refused with an error). Repeated rows are returned each, with the same values;
rows without an id too. Entries whose integer would be beyond +-2^61 are taken as that. Components with an eigenvalue of at most ``RANK`` of the
trace are noise of constant or dependent dimensions and are left out: of a single distinct vector nothing is returned. Eigenvectors have the sign that makes their
largest entry positive (ties: the first). ``deviation`` is null where the exact value is beyond a long. An empty table gives no rows. Only the id and
vector columns are read, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import written

GRID, OFFSET = 64, 1_000_000
COMPONENTS = 16
MAX_WIDTH = 4096
FARTHEST = 1 << 61
LIMB, CHUNK = 18, 1 << 16  # 2 * 18 + 16 bits are below 53
SUM_LIMB = 30
RANK = 1e-12
OUT_ROWS = 1 << 11  # rows of a batch that are whitened together


def finite(vector: Column) -> Column:
    """Not null, and no null or non-finite entry."""
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def on_grid(vector: Column, grid: int = GRID, offset: int = OFFSET) -> Column:
    """floor(grid * entry) + offset as long."""
    far = float(FARTHEST)
    return F.transform(vector, lambda x: F.floor(F.greatest(F.least(x.cast("double") * grid, F.lit(far)), F.lit(-far))).cast("long") + F.lit(offset))


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Integers (int64) as sums of limb k * 2^(bits k); the last has the sign."""
    out = []
    while np.abs(values).max(initial=0) >= 1 << bits:
        out.append(values & ((1 << bits) - 1))
        values = values >> bits
    return [*out, values]


def scatter(rows: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Exact sums and cross-products (integers of any size) of int64 rows."""
    width = rows.shape[1]
    sums, cross = np.zeros(width, object), np.zeros((width, width), object)
    for start in range(0, len(rows), CHUNK):
        parts = [p.astype(np.float64) for p in limbs(rows[start : start + CHUNK], LIMB)]
        for i, a in enumerate(parts):
            sums = sums + (a.sum(0).astype(np.int64).astype(object) << (LIMB * i))
            for j, b in enumerate(parts):
                cross = cross + ((a.T @ b).astype(np.int64).astype(object) << (LIMB * (i + j)))
    return list(sums), cross


def _stacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and vectors of a batch, a width at a time."""
    lists = batch.column("x")
    widths, flat, starts = lists.value_lengths().to_numpy(zero_copy_only=False), lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_pylist()])
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        if w:
            yield at, flat[(starts[at][:, None] + np.arange(w)).ravel()].reshape(len(at), w)


def _scattered(batches: Iterator[pa.RecordBatch], shift: int) -> Iterator[pa.RecordBatch]:
    """A task's n (i = -2), sums (i = -1) and cross-products of each width, as limbs."""
    held: dict[int, list] = {}
    for batch in batches:
        for _, x in _stacked(batch):
            sums, cross = scatter(x - shift)
            n, s, c = held.get(x.shape[1], (0, 0, 0))
            held[x.shape[1]] = [n + len(x), s + np.array(sums, object), c + cross]
    for width, (n, sums, cross) in held.items():
        upper = np.triu_indices(width)
        i = np.concatenate([[-2], np.full(width, -1), upper[0]])
        j = np.concatenate([[0], np.arange(width), upper[1]])
        left, limb = np.concatenate([np.array([n], object), sums, cross[upper]]), 0
        while len(left):
            last = (left >= -(1 << SUM_LIMB)) & (left < 1 << SUM_LIMB)
            low = np.where(last, left, left & ((1 << SUM_LIMB) - 1))
            columns = [np.full(len(i), width), i, j, np.full(len(i), limb), low]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], ["width", "i", "j", "limb", "value"])
            i, j, left, limb = i[~last], j[~last], left[~last] >> SUM_LIMB, limb + 1


class Model(NamedTuple):
    """How vectors of one width are whitened."""

    n: int
    sums: list[int]
    trace: float
    values: np.ndarray  # of the components, falling
    vectors: np.ndarray  # a column a component

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, each entry rounded once: the whole part is subtracted as integers."""
        whole, part = np.array([s // self.n for s in self.sums], np.int64), np.array([(s % self.n) / self.n for s in self.sums])
        return (x - whole).astype(np.float64) - part

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 over the dimensions; as int64 where no step can overflow."""
        sums = np.array(self.sums, object)
        farthest = max((int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)), 1)
        if farthest**2 * x.shape[1] < 1 << 63:
            return ((x * self.n - sums.astype(np.int64)) ** 2).sum(1).tolist()
        # most of n x and S is the common offset: without it the rest is small
        whole = np.array([s // self.n for s in self.sums], np.int64)
        near, rest = x - whole, np.array([s % self.n for s in self.sums], np.int64)
        if (int(np.abs(near).max(initial=0)) * self.n + self.n) ** 2 * x.shape[1] < 1 << 63:
            return ((near * self.n - rest) ** 2).sum(1).tolist()
        exact = ((x.astype(object) * self.n - sums) ** 2).sum(1)
        return [d if d < 1 << 63 else None for d in exact]


def decompose(n: int, sums: list[int], cross: np.ndarray, components: int) -> Model:
    """From exact n, S and X'X (objects): n X'X - SS' in integers, then float and eigh."""
    s = np.array(sums, object)
    exact = n * cross - np.outer(s, s)
    covariance = np.array([[v / (n * n) for v in row] for row in exact.tolist()], np.float64)  # integers divide with one rounding
    trace = sum(exact[k, k] for k in range(len(sums))) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > RANK * trace]
    vectors = vectors[:, order]
    if len(order):
        largest = np.abs(vectors).argmax(0)
        vectors = vectors * np.where(vectors[largest, np.arange(len(order))] < 0, -1.0, 1.0)
    return Model(n, sums, trace, values[order], vectors)


def fit(distinct: DataFrame, components: int = COMPONENTS, shift: int = OFFSET) -> dict[int, Model]:
    """A model for each width of ``distinct`` (x array<long>, each once)."""
    wide = distinct.where(F.size("x") > MAX_WIDTH).select(F.size("x")).first()
    if wide:
        raise ValueError(f"vectors of {wide[0]} entries are above the limit of {MAX_WIDTH}")
    parts = distinct.mapInArrow(partial(_scattered, shift=shift), "width long, i long, j long, limb long, value long")
    # limbs times the square of the width: independent of the number of rows
    totals = parts.groupBy("width", "i", "j", "limb").agg(F.sum("value").alias("value")).toPandas()
    models = {}
    for width, of in totals.groupby("width"):
        exact = np.zeros((width + 2, width), object)
        for i, j, limb, value in of[["i", "j", "limb", "value"]].itertuples(index=False):
            exact[i + 2, j] += int(value) << (SUM_LIMB * int(limb))
        cross, n = exact[2:], int(exact[0, 0])
        cross = cross + np.triu(cross, 1).T
        sums = [int(s) for s in exact[1]]
        # the shift cancels in n X'X - SS', so only the sums need it back
        model = decompose(n, sums, cross, components)
        models[int(width)] = model._replace(sums=[s + n * shift for s in sums])
    return models


def _products(batches: Iterator[pa.RecordBatch], models: dict[int, Model], means: dict[int, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
    """A task's sums of whitened vectors (i = -1) or, given their means, of the products of what is left."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for _, x in _stacked(batch):
            w = models[x.shape[1]].whitened(x)
            w = w.sum(0)[None, :] if means is None else (w - means[x.shape[1]]).T @ (w - means[x.shape[1]])
            held[x.shape[1]] = held.get(x.shape[1], 0) + w
    for width, w in held.items():
        i, j = np.indices(w.shape)
        columns = [np.full(w.size, width), i.ravel(), j.ravel(), w.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["width", "i", "j", "value"])


def identity_error(distinct: DataFrame, models: dict[int, Model]) -> dict[int, float]:
    """Measured over the fit list: the largest absolute entry of the whitened vectors' covariance minus the identity, of each width."""

    def summed(means: dict[int, np.ndarray] | None) -> dict[int, np.ndarray]:
        parts = distinct.mapInArrow(partial(_products, models=models, means=means), "width long, i long, j long, value double")
        out = {}
        for width, of in parts.groupBy("width", "i", "j").agg(F.sum("value").alias("value")).toPandas().groupby("width"):
            size = int(of["j"].max()) + 1
            matrix = np.zeros((size if means is not None else 1, size))
            matrix[of["i"].to_numpy(), of["j"].to_numpy()] = of["value"] / models[int(width)].n
            out[int(width)] = matrix
        return out

    means = {width: m[0] for width, m in summed(None).items()}
    means |= {width: np.zeros(0) for width in models if width not in means}
    return {width: float(np.abs(c - np.eye(len(c))).max()) for width, c in summed(means).items()}


def _applied(batches: Iterator[pa.RecordBatch], models: dict[int, Model], errors: dict[int, float]) -> Iterator[pa.RecordBatch]:
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for whole in batches:
        for start in range(0, len(whole), OUT_ROWS):
            batch = whole.slice(start, OUT_ROWS)
            for at, x in _stacked(batch):
                m = models[x.shape[1]]
                k = len(m.values)
                if not k:
                    continue
                rows = np.repeat(np.arange(len(at)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(at[rows])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(rows), m.n)),
                        pa.array(m.deviations(x), pa.int64()).take(pa.array(rows)), pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.values / m.trace, len(at))), pa.array(np.full(len(rows), errors[x.shape[1]])),
                    ],
                    names,
                )


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, grid: int = GRID, offset: int = OFFSET) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: up to ``components`` rows for each usable row."""
    taken = df.where(finite(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), on_grid(F.col(vector_col), grid, offset).alias("x"))
    # copies meet in the map-side partial of the distinct, so a very common vector is no hot group
    distinct = written(taken.select("x").distinct())
    models = fit(distinct, components, offset)
    errors = identity_error(distinct, models)
    shape = f"vec_id {taken.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return taken.mapInArrow(partial(_applied, models=models, errors=errors), shape)
