"""Embedding whitening by Chan merging: moments of partitions merged pairwise, decorrelated components, identity checked.

Each partition computes count, local mean and centred scatter of its vectors; ``treeReduce`` joins two of
them by Chan's formula, so no sum of squares is ever cancelled and no partition's rows leave it. The driver
gets one (dimension x dimension) matrix, whatever the number of rows, and its eigenvectors go back with the
tasks. A second pass merges the moments of the whitened rows in the same way: their covariance must be the identity.

Entries are quantised first: ``floor(64 * c) + 1000000``, as long. The constant cancels in every centred
value, so the work is on ``floor(64 * c)``, which doubles hold exactly.

Cases: a null vector or one with a null, NaN or infinite entry is dropped, as is one whose length is not
the commonest among the others (ties: the longer). An empty table, or only empty vectors, gives no rows.
Equal vectors count as often as they occur; a null id stays null. Components without variance (constant
columns, fewer rows than dimensions) have ``whitened`` 0 and take no part in ``identity_error``;
``explained`` is 0 if nothing varies. ``deviation`` is null where the exact value exceeds a long."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SCALE, OFFSET = 64, 1_000_000
#: Components of less variance than this share of the largest are treated as constant.
RANK_EPS = 1e-12

#: (count, mean, scatter about the mean)
Moments = tuple[int, np.ndarray, np.ndarray]


def moments(x: np.ndarray) -> Moments:
    mean = x.mean(axis=0)
    centred = x - mean
    return len(x), mean, centred.T @ centred


def merged(a: Moments, b: Moments) -> Moments:
    """Chan's pairwise formula; neither side's mean is ever rebuilt from sums."""
    (n, mean_a, scatter_a), (m, mean_b, scatter_b) = a, b
    apart = mean_b - mean_a
    return n + m, mean_a + apart * (m / (n + m)), scatter_a + scatter_b + np.outer(apart, apart) * (n * m / (n + m))


def by_length(rows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of a list column: places and quantised entries (long) of the vectors that count, one pair a length."""
    lengths = pc.fill_null(pc.list_value_length(rows), -1).to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[lengths > 0]):
        places = np.flatnonzero(lengths == d)
        entries = rows.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        good = np.isfinite(entries).all(axis=1)
        if good.any():
            yield places[good], np.floor(SCALE * entries[good]).astype(np.int64)


def _join(a: dict, b: dict) -> dict:
    out = dict(a)
    for d, (m, sums) in b.items():
        out[d] = (merged(out[d][0], m), out[d][1] + sums) if d in out else (m, sums)
    return out


def _reduced(df: DataFrame, column: str, turned: Callable[[np.ndarray], np.ndarray | None], depth: int) -> dict[int, tuple[Moments, np.ndarray]]:
    """By length of vector, the moments of ``turned`` rows of all partitions and the exact sums of entries."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        found: dict = {}
        for batch in batches:
            for _, x in by_length(batch.column(0)):
                values = turned(x)
                if values is not None:
                    found = _join(found, {x.shape[1]: (moments(values), x.sum(axis=0).astype(object))})
        yield pa.RecordBatch.from_pydict({"found": pa.array([pickle.dumps(found)], pa.binary())})

    def opened(row) -> dict:
        import pickle

        return pickle.loads(row["found"])

    parts = df.select(column).mapInArrow(local, "found binary").rdd
    return parts.map(opened).treeReduce(_join, depth) if parts.getNumPartitions() else {}


class Whitening:
    """Mean and components of a fit list; ``basis`` maps a centred vector to its whitened components."""

    def __init__(self, n: int, mean: np.ndarray, covariance: np.ndarray, sums: np.ndarray, components: int) -> None:
        values, vectors = np.linalg.eigh(covariance)
        falling = np.argsort(-values, kind="stable")[:components]
        values, vectors = np.maximum(values[falling], 0.0), vectors[:, falling]
        self.n, self.mean, self.sums, self.dimension = n, mean, sums, len(mean)
        self.varies = values > RANK_EPS * max(values[0], np.finfo(float).tiny)
        self.basis = np.where(self.varies, vectors / np.sqrt(np.where(self.varies, values, 1.0)), 0.0)
        trace = float(np.trace(covariance))
        self.explained = values / trace if trace > 0 else np.zeros(len(values))

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of ``(n * x - S) ** 2``."""
        most = max(abs(self.n * int(x.max()) - int(min(self.sums))), abs(self.n * int(x.min()) - int(max(self.sums))))
        if self.dimension * most * most < 2**63:
            return ((self.n * x - self.sums.astype(np.int64)) ** 2).sum(axis=1).tolist()
        exact = ((self.n * x.astype(object) - self.sums) ** 2).sum(axis=1)
        return [int(v) if v < 2**63 else None for v in exact]


def fit(df: DataFrame, column: str = "embedding", components: int = 32, depth: int = 2) -> Whitening | None:
    """Whitening of the vectors of ``column``; None if there are none."""
    found = _reduced(df, column, lambda x: x.astype(np.float64), depth)
    if not found:
        return None
    (n, mean, scatter), sums = found[max(found, key=lambda d: (found[d][0][0], d))]
    return Whitening(n, mean, scatter / n, sums, components)


def identity_error(df: DataFrame, whitening: Whitening, column: str = "embedding", depth: int = 2) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, in a pass of its own."""
    found = _reduced(df, column, lambda x: whitening.whiten(x) if x.shape[1] == whitening.dimension else None, depth)
    (n, _, scatter), _ = reduce(lambda a, b: (merged(a[0], b[0]), a[1] + b[1]), found.values())
    kept = np.flatnonzero(whitening.varies)
    return float(np.abs(scatter[np.ix_(kept, kept)] / n - np.eye(len(kept))).max()) if len(kept) else 0.0


def whiten(df: DataFrame, id_column: str = "vec_id", column: str = "embedding", components: int = 32) -> DataFrame:
    """One row per vector and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error``."""
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(df, column, components)
    if fitted is None:
        return df.sparkSession.createDataFrame([], schema)
    error, k = identity_error(df, fitted, column), len(fitted.explained)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for places, x in by_length(batch.column(1)):
                if x.shape[1] != fitted.dimension:
                    continue
                deviations = pa.array(fitted.deviations(x), pa.int64())
                white = fitted.whiten(x)
                for at in range(0, len(x), 2048):  # 2048 vectors give 65 536 rows
                    here = np.repeat(np.arange(at, min(at + 2048, len(x))), k)
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(pa.array(places[here])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(here) // k)), pa.array(np.full(len(here), fitted.n)), deviations.take(pa.array(here)),
                            pa.array(white[at : at + 2048].ravel()), pa.array(np.tile(fitted.explained, len(here) // k)), pa.array(np.full(len(here), error)),
                        ],
                        names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
                    )

    return df.select(id_column, column).mapInArrow(rows, schema)
