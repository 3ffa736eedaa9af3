"""One block of vectors against one block of queries: the nearest of each query, with the numbers that `vectors.cosine_distance` gives."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Queries whose approximate distances to a block are held at once.
SLICE = 128
DECIMALS, STEP = 6, 1e-6


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length: places in the column, vectors in double precision, whether one is or holds null."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = np.asarray(pc.fill_null(pc.list_value_length(lists), -1))
    flat = lists.flatten()
    values, missing = np.asarray(pc.fill_null(flat.cast(pa.float64()), 0.0)), np.asarray(pc.is_null(flat))
    starts = np.cumsum(np.maximum(lengths, 0)) - np.maximum(lengths, 0)
    out = {}
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        places = starts[at][:, None] + np.arange(max(n, 0))
        out[int(n)] = (at, values[places], missing[places].any(1) | (n < 0))
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums in the order of the components, as Spark's fold has them, so that they agree to the last bit."""
    total = np.zeros(np.broadcast_shapes(a.shape[:-1], b.shape[:-1]))
    for j in range(a.shape[-1]):
        total = total + a[..., j] * b[..., j]
    return total


def _rounded(x: np.ndarray) -> np.ndarray:
    """To DECIMALS places, halves away from zero by the number's shortest text, as Spark rounds."""
    scaled = x / STEP
    whole = np.floor(scaled + 0.5)
    out = np.where(np.isfinite(x), whole / 10**DECIMALS, x)
    for i in np.flatnonzero(np.isfinite(x) & (np.abs(scaled - np.floor(scaled) - 0.5) < 1e-3)):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal(1).scaleb(-DECIMALS), ROUND_HALF_UP))
    return out + 0.0


def _first_copies(x: np.ndarray, rank: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of least rank of each vector: of equal vectors no more can be among the k nearest."""
    if len(x) <= k or not x.shape[1]:
        return np.argsort(rank)[:k] if not x.shape[1] else np.arange(len(x))
    _, same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)
    order = np.lexsort((rank, same.ravel()))
    starts = np.flatnonzero(np.r_[True, np.diff(same.ravel()[order]) != 0])
    number = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[number < k]


def nearest_in_block(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """query_id, item, distance: the k rows of each query by rounded distance, then by item; NaN behind numbers, nulls last.

    A product of matrices tells which rows may be among the nearest; their distances are made as Spark makes them. Rows without a number for a distance
    (other length, null, zero or not finite) follow in the order of items.
    """
    taken_q, taken_r, distances, null = [], [], [], []
    if rows.num_rows and queries.num_rows:
        rank = np.asarray(pc.rank(rows["item"], sort_keys="ascending", null_placement="at_start", tiebreaker="first")).astype(np.int64)
        of_rows = _vectors(rows["vector"])
        with np.errstate(all="ignore"):
            for n, (q_at, q, q_null) in _vectors(queries["q"]).items():
                at, x, holds = of_rows.get(n, (np.zeros(0, int), np.zeros((0, max(n, 0))), np.zeros(0, bool)))
                other = np.setdiff1d(np.arange(rows.num_rows), at)
                plain = ~holds & np.isfinite(x).all(1)
                kept = np.concatenate([np.flatnonzero(plain)[_first_copies(x[plain], rank[at[plain]], k)], np.flatnonzero(~plain)])
                at, x, holds = at[kept], x[kept], holds[kept]
                for places, picked, d in _of_length(q, q_null, x, holds, rank[at], k):
                    # Of rows whose distance is null only the least items can count.
                    taken_q.append(q_at[places]), taken_r.append(at[picked]), distances.append(d[0]), null.append(d[1])
                least = other[np.argsort(rank[other])[:k]]
                taken_q.append(np.repeat(q_at, len(least))), taken_r.append(np.tile(least, len(q_at)))
                distances.append(np.zeros(len(least) * len(q_at))), null.append(np.ones(len(least) * len(q_at), bool))
    if not taken_q:
        taken_q, taken_r, distances, null, rank = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros(0)], [np.zeros(0, bool)], np.zeros(0, int)
    q, r, d, none = (np.concatenate(v) for v in (taken_q, taken_r, distances, null))
    kind = np.where(none, 2, np.isnan(d))
    order = np.lexsort((rank[r], np.where(kind == 0, d, 0.0), kind, q))
    starts = np.flatnonzero(np.r_[True, np.diff(q[order]) != 0]) if len(order) else np.zeros(0, int)
    order = order[np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < k]
    return pa.table({"query_id": queries["query_id"].take(q[order]), "item": rows["item"].take(r[order]), "distance": pa.array(d[order], mask=none[order])})


def _of_length(q: np.ndarray, q_null: np.ndarray, x: np.ndarray, holds: np.ndarray, rank: np.ndarray, k: int):
    """Places of queries and of rows of one length, with (distance, whether it is null), for all that may be among the k nearest."""
    norms, q_norms = np.sqrt(_dot(x, x)), np.sqrt(_dot(q, q))
    usual = lambda n: (n > 1e-140) & (n < 1e140)
    good, q_good = usual(norms) & ~holds, usual(q_norms) & ~q_null
    nothing = np.flatnonzero(holds | (norms == 0))
    nothing = nothing[np.argsort(rank[nothing])[:k]]
    endless = np.flatnonzero(~holds & ~np.isfinite(x).all(1))
    endless = endless[np.argsort(rank[endless])[:k]]
    odd = np.flatnonzero(~good & ~holds & (norms != 0) & np.isfinite(x).all(1))
    always = np.concatenate([nothing, endless, odd])
    place = np.flatnonzero(good)
    unit = (x[good] / norms[good][:, None]).T

    def pairs(a: np.ndarray, b: np.ndarray):
        product = norms[b] * q_norms[a]
        none = holds[b] | q_null[a] | (product == 0)
        d = np.empty(len(a))
        for lo in range(0, len(a), 1 << 18):  # so that vectors of few pairs are gathered at once
            s = slice(lo, lo + (1 << 18))
            d[s] = 1 - _dot(x[b[s]], q[a[s]]) / product[s]
        return a, b, (_rounded(np.where(none, 0.0, d)), none)

    queries = np.flatnonzero(q_good)
    for lo in range(0, len(queries), SLICE):
        some = queries[lo : lo + SLICE]
        near = 1 - (q[some] / q_norms[some][:, None]) @ unit
        edge = np.partition(near, k - 1, axis=1)[:, k - 1 : k] if len(place) > k else np.full((len(some), 1), np.inf)
        # Two roundings by half a step each, and the product's own error.
        a, b = np.nonzero(near <= edge + 1.01 * STEP)
        yield pairs(np.concatenate([some[a], np.repeat(some, len(always))]), np.concatenate([place[b], np.tile(always, len(some))]))
    for one in np.flatnonzero(~q_good):
        a, b, (d, none) = pairs(np.full(len(x), one), np.arange(len(x)))
        first = np.lexsort((rank, np.where(none | np.isnan(d), 0.0, d), np.where(none, 2, np.isnan(d))))[:k]
        yield a[first], b[first], (d[first], none[first])
