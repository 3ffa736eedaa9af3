"""Vector codes by product quantisation, with codebooks learned by Yinyang Lloyd rounds over integers.

Components become integers (floor of 256 times each), vectors are cut into equal consecutive parts, and
each part position has its own codebook. Before the rounds the entries of a codebook are clustered into
groups. A row keeps, for each part, its entry and one lower bound for each group: no other entry of that
group is nearer. When entries have moved, a group's bound falls by the greatest move in it; only groups
whose bound is not above the distance to the row's own entry are scanned. Bounds are whole numbers, rounded
down (moves are rounded up), and distances are exact integers, so ties are decided exactly, for the lower
index.

Between rounds the rows with their entries and bounds are a written table; a round is one pass over it
without a shuffle, and the sums of a task are one row for each part and entry. The driver holds the codebooks
alone.

Rows whose vector is null or has null or non-finite components are left out. So are vectors of another
length than that of the row that comes first by (id, vector). Vectors whose length the number of parts does
not divide count as filled up with zeros at the end. Components beyond 2^26 in integer form are held there,
so that distances stay within 64 bits. Repeated rows and rows of one id count each; a null id comes last in
the order of ids. Fewer kept rows than entries give codebooks of so many entries; an empty table gives an
empty result. A sum of errors beyond 64 bits is null. Other columns of the table are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import broadcast_if, materialize, table

SCALE = 256
GREATEST = 1 << 26
#: A bound that stands for "no other entry in this group".
FAR = (1 << 31) - 1
#: Entries for each group, on average.
PER_GROUP = 10


def root_down(x: np.ndarray) -> np.ndarray:
    """Integer square roots, rounded down."""
    r = np.sqrt(x.astype(np.float64)).astype(np.int64)
    r -= r * r > x
    return r + ((r + 1) * (r + 1) <= x)


def group_entries(book: np.ndarray, rounds: int = 5) -> list[list[np.ndarray]]:
    """For each part the groups of its entries, as ascending indexes: some rounds of Lloyd over the entries themselves."""
    out = []
    for entries in book.astype(np.float64):
        k = len(entries)
        n = -(-k // PER_GROUP)
        centres = entries[np.linspace(0, k - 1, n).astype(int)]
        for _ in range(rounds):
            near = ((entries[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([entries[near == g].mean(0) if (near == g).any() else centres[g] for g in range(n)])
        out.append([np.flatnonzero(near == g) for g in range(n)])
    return out


def nearest(x: np.ndarray, entries: np.ndarray, groups: list[np.ndarray], own: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of the rows x of one part: entry, squared distance, lower bounds by group, and how many distances to members of groups were computed.

    own: the entries so far; low: what no other entry of a group comes below, moves taken off; it is changed.
    """
    was, n = own.copy(), len(x)
    own, least = own.copy(), ((x - entries[own]) ** 2).sum(1)
    at_first, work = least.copy(), 0
    member = np.empty(len(entries), np.int64)
    for g, of in enumerate(groups):
        member[of] = g
    first, second, which = (np.full((n, len(groups)), v, np.int64) for v in (-1, -1, -1))
    for g, of in enumerate(groups):
        rows = np.flatnonzero(np.maximum(low[:, g], 0) ** 2 <= least)
        if not len(rows) or not len(of):
            continue
        d = ((x[rows, None] - entries[None, of]) ** 2).sum(2)
        work += d.size
        at = d.argmin(1)
        best = d[np.arange(len(rows)), at]
        first[rows, g], which[rows, g] = best, of[at]
        d[np.arange(len(rows)), at] = FAR * FAR
        second[rows, g] = d.min(1)
        better = (best < least[rows]) | ((best == least[rows]) & (of[at] < own[rows]))
        own[rows[better]], least[rows[better]] = of[at][better], best[better]
    scanned = which >= 0
    bound = root_down(np.where(which == own[:, None], second, first).clip(0))
    low = np.where(scanned, np.minimum(bound, FAR), low.clip(0))
    # A row that left an entry of a group that was not scanned: that entry is one of the others now.
    left = np.flatnonzero((was != own) & ~scanned[np.arange(n), member[was]])
    low[left, member[was[left]]] = np.minimum(low[left, member[was[left]]], root_down(at_first[left]))
    return own, least, low, work


def _vectors(batch: pa.RecordBatch, dim: int, parts: int) -> np.ndarray:
    """rows x parts x width."""
    n, width = batch.num_rows, -(-dim // parts)
    q = np.zeros((n, parts * width), np.int64)
    q[:, :dim] = np.asarray(batch.column("q").flatten()).reshape(n, dim)
    return q.reshape(n, parts, width)


def _lists(x: np.ndarray) -> pa.ListArray:
    n = len(x)
    flat = x.reshape(n, -1).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))


def _assign(rows: DataFrame, book: np.ndarray, groups: list, moves: np.ndarray | None, dim: int) -> DataFrame:
    """id, label, q, own (an entry for each part), low (bounds by part and group), error. moves: by part and group, null before the first round."""
    parts, n_groups = len(book), len(groups[0])

    def run(batches):
        for b in batches:
            x, n = _vectors(b, dim, parts), b.num_rows
            if moves is None:
                own, low = np.zeros((n, parts), np.int64), np.zeros((n, parts, n_groups), np.int64)
            else:
                own = np.asarray(b.column("own").flatten()).reshape(n, parts).astype(np.int64)
                low = np.asarray(b.column("low").flatten()).reshape(n, parts, n_groups).astype(np.int64) - moves
            error = np.zeros(n, np.int64)
            for p in range(parts):
                own[:, p], d, low[:, p], _ = nearest(x[:, p], book[p], groups[p], own[:, p], low[:, p])
                error += d
            columns = [b.column("id"), b.column("label"), b.column("q"), _lists(own), _lists(low), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "label", "q", "own", "low", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, q array<int>, own array<int>, low array<int>, error long")


def _moved(rows: DataFrame, book: np.ndarray, dim: int) -> np.ndarray:
    """The codebooks after a round: floors of means by component; entries without rows stay. Sums are exact decimals."""
    parts, k, width = book.shape

    def run(batches):
        n, total = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64)
        for b in batches:
            x, own = _vectors(b, dim, parts), np.asarray(b.column("own").flatten()).reshape(-1, parts)
            for p in range(parts):
                np.add.at(n[p], own[:, p], 1)
                np.add.at(total[p], own[:, p], x[:, p])
        p, e = np.nonzero(n)
        columns = [pa.array(p), pa.array(e), pa.array(n[p, e]), *(pa.array(total[p, e, i]) for i in range(width))]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", *(f"t{i}" for i in range(width))])

    sums = rows.select("q", "own").mapInArrow(run, ", ".join(["part long, entry long, n long", *(f"t{i} long" for i in range(width))]))
    sums = sums.groupBy("part", "entry").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *(f"t{i}" for i in range(width)))))
    out = book.copy()
    for r in sums.collect():  # a row for each part and entry at most
        out[r["part"], r["entry"]] = [int(r[f"t{i}"]) // int(r["n"]) for i in range(width)]
    return out


def _drift(old: np.ndarray, new: np.ndarray, groups: list) -> np.ndarray:
    """The greatest move in each group of each part, rounded up."""
    square = ((old - new) ** 2).sum(2)
    far = np.array([[square[p, of].max() if len(of) else 0 for of in groups[p]] for p in range(len(groups))])
    down = root_down(far)
    return down + (down * down < far)


def quantize(rows: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """(a written table of id, label, code: hex digits, two for each part, and error: squared distances summed over parts; the final codebooks: part x entry x position)."""
    if entries > 256:
        raise ValueError("an entry's index must fit in two hex digits")
    vec = F.col(vec_col)
    whole = rows.where(vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))))
    held = F.transform(vec, lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"), F.lit(-float(GREATEST))), F.lit(float(GREATEST))).cast("int"))
    kept = whole.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), held.alias("q"))
    order = (F.col("id").asc_nulls_last(), F.col("q"))
    head: list[Row] = kept.orderBy(*order).limit(1).collect()
    dim = len(head[0]["q"]) if head else 0
    kept = kept.where(F.size("q") == dim)
    first = [r["q"] for r in kept.orderBy(*order).limit(entries).collect()]
    width = -(-dim // parts)
    book = np.zeros((len(first), parts * width), np.int64)
    book[:, :dim] = np.array(first, np.int64).reshape(len(first), dim)
    book = book.reshape(len(first), parts, width).transpose(1, 0, 2)
    code = F.lower(F.concat_ws("", F.transform("own", lambda e: F.lpad(F.hex(e), 2, "0"))))
    if not first:
        return kept.select("id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), book
    groups, moves = group_entries(book), None
    for _ in range(rounds):
        kept = materialize(_assign(kept, book, groups, moves, dim), "codes")
        after = _moved(kept, book, dim)
        moves, book = _drift(book, after, groups), after
    return materialize(_assign(kept, book, groups, moves, dim).select("id", "label", code.alias("code"), "error"), "codes"), book


def book_digest(book: np.ndarray) -> str:
    """SHA-256 of all components as decimals, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def op12_vector_codes(spark, sf_dir):
    codes, book = quantize(table(spark, sf_dir, "embeddings"))
    labels = codes.groupBy("label").agg(F.try_sum("error").alias("label_error"))
    labels = broadcast_if(labels.withColumnRenamed("label", "of"), codes.select("label").distinct().count(), 64)
    out = codes.join(labels, codes["label"].eqNullSafe(labels["of"]))
    return out.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(book_digest(book)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """The assignment to the codebooks of round k, and the codebooks after it."""
    return f""",
a{k} AS (SELECT n.vec_id, n.p, min(struct_pack(d := list_sum(list_transform(list_zip(n.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.e)) AS best
  FROM pieces n JOIN c{k} c ON n.p = c.p GROUP BY n.vec_id, n.p),
m{k} AS (SELECT p, e, list(x ORDER BY i) AS v FROM (
    SELECT n.p, a.best.e AS e, i, CAST(floor(sum(n.v[i])::DOUBLE / count(*)) AS BIGINT) AS x
    FROM pieces n JOIN a{k} a ON a.vec_id = n.vec_id AND a.p = n.p, generate_series(1, len(n.v)) t(i) GROUP BY n.p, a.best.e, i) GROUP BY p, e),
c{k + 1} AS (SELECT c.p, c.e, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)"""


ORACLE = f"""
WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pieces AS (SELECT vec_id, label, p, list_slice(q, p * (len(q) // 16) + 1, (p + 1) * (len(q) // 16)) AS v FROM kept, generate_series(0, 15) t(p)),
c0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM pieces
  WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)){_round_sql(0)}{_round_sql(1)},
a2 AS (SELECT n.vec_id, n.p, min(struct_pack(d := list_sum(list_transform(list_zip(n.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := c.e)) AS best
  FROM pieces n JOIN c2 c ON n.p = c.p GROUP BY n.vec_id, n.p),
coded AS (SELECT k.vec_id, any_value(k.label) AS label, string_agg(format('{{:02x}}', a.best.e), '' ORDER BY a.p) AS code, CAST(sum(a.best.d) AS BIGINT) AS error
  FROM kept k JOIN a2 a ON a.vec_id = k.vec_id GROUP BY k.vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(x, ',' ORDER BY p, e, i)) FROM (SELECT p, e, i, CAST(v[i] AS VARCHAR) AS x FROM c2, generate_series(1, len(v)) t(i))) AS codebooks_sha256
FROM coded"""
