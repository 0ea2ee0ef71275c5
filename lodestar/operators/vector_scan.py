"""Which pairs of vectors and questions can be among the nearest, told by matrix products before exact scores are worked out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Scores in a block at most, and what a product may differ from the exact score, which is rounded to 4 places, to be passed over.
BLOCK, MARGIN = 1 << 21, 1.001e-4


def _matrix(values: list, size: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(places, unit vectors)`` of those values that have ``size`` numbers (as the first), all finite and not all 0."""
    size = next((len(x) for x in values if x is not None), 0) if size is None else size
    places = [i for i, x in enumerate(values) if x is not None and len(x) == size and None not in x]
    found = np.array([values[i] for i in places], np.float64).reshape(len(places), size)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        norms = np.sqrt((found * found).sum(axis=1))
    fine = np.isfinite(norms) & (norms > 1e-100)
    return np.array(places, np.int64)[fine], found[fine] / norms[fine, None]


def candidates(vectors: DataFrame, queries: list, k: int, equal: tuple[str, str] | None = None) -> DataFrame:
    """``(vectors' columns, _place)``: for each place in ``queries`` (rows with ``q``) at least the ``k`` nearest of
    ``vectors(chunk_id, v)`` by rounded cosine, ties to smaller ids, and few more. ``equal``: a column of the vectors that
    must equal one of the queries. Vectors and queries without a direction, or of another length, are paired with all."""
    names, context = vectors.columns, vectors.sparkSession.sparkContext
    asked, matrix = _matrix([r.q for r in queries])
    kinds = [r[equal[1]] if equal else 0 for r in queries]
    number = {x: i for i, x in enumerate(dict.fromkeys(x for x in kinds if x is not None))}
    rest = np.setdiff1d(np.arange(len(queries)), asked)
    sent = context.broadcast((asked, matrix, np.array([number.get(kinds[i], -2) for i in asked], np.int64), number, rest))
    rows = max(1, BLOCK // max(len(queries), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, matrix, wanted, number, rest = sent.value
        every = np.concatenate([asked, rest])
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                part = whole.slice(at, rows)
                v = part.column("v")
                if v.null_count == 0 and v.flatten().null_count == 0 and len(v) and (v.value_lengths().to_numpy() == matrix.shape[1]).all():
                    values = v.flatten().to_numpy().reshape(len(v), -1)
                else:
                    values = v.to_pylist()
                at_rows, units = _matrix(values, matrix.shape[1]) if isinstance(values, list) else _array(values)
                mine = np.array([number.get(x, -1) for x in part.column(equal[0]).to_pylist()], np.int64)[at_rows] if equal else np.zeros(len(at_rows), np.int64)
                found = _near(at_rows, units, mine, part.column("chunk_id"), matrix, wanted, k)
                odd = np.setdiff1d(np.arange(part.num_rows), at_rows)
                places = [asked[found[0]], np.repeat(every, len(odd)), np.repeat(rest, len(at_rows))]
                taken = [found[1], np.tile(odd, len(every)), np.tile(at_rows, len(rest))]
                out = part.take(pa.array(np.concatenate(taken).astype(np.int64)))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(places).astype(np.int32))], names=[*names, "_place"])

    return vectors.mapInArrow(run, T.StructType(list(vectors.schema.fields)).add("_place", T.IntegerType()))


def _array(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`_matrix`, of vectors of one length."""
    found = values.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        norms = np.sqrt((found * found).sum(axis=1))
    fine = np.isfinite(norms) & (norms > 1e-100)
    return np.flatnonzero(fine), found[fine] / norms[fine, None]


def _near(places: np.ndarray, units: np.ndarray, kinds: np.ndarray, chunks: pa.Array, matrix: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``(queries, rows)`` that can be among the ``k`` best. Of equal vectors those with the smallest ids stand for all."""
    if not len(places) or not len(matrix):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids = chunks.take(pa.array(places)).to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i])), np.int64)
    places, units, kinds = places[order], np.ascontiguousarray(units[order]), kinds[order]
    _, same = np.unique(np.column_stack([units, kinds]).view(np.dtype((np.void, (units.shape[1] + 1) * 8))).ravel(), return_inverse=True)
    by = np.argsort(same, kind="stable")
    starts = np.flatnonzero(np.r_[True, same[by][1:] != same[by][:-1]])
    nth = np.empty(len(by), np.int64)
    nth[by] = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
    first = nth < k
    places, units, kinds = places[first], units[first], kinds[first]
    scores = np.where(wanted[:, None] == kinds[None, :], matrix @ units.T, -np.inf)
    least = np.partition(scores, len(places) - k, axis=1)[:, len(places) - k] if len(places) > k else np.full(len(scores), -np.inf)
    queries, rows = np.nonzero((scores >= (least - MARGIN)[:, None]) & (scores > -np.inf))
    return queries, places[rows]
