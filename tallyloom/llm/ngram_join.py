"""Exact Jaccard join of word n-gram sets through prefix trees.

Texts with equal sets are one class, so copies are never paired. Which classes can be
linked at all is found without loss: two sets of similarity t or more differ in at most
(1 - t) / t times the smaller size, so of that many parts of the hash space and one more, cut in global
order, one part holds the same n-grams in both. Every class gives a hash for each of its parts, under
its own range of sizes and the next; equal hashes are candidates, kept as stars
around the least member, not as pairs. Parts leave out n-grams that very many texts have, by
a sketch of all counts, unless too few others are left.

The classes of a connected group of candidates meet in one task, or, where they have
more than BLOCK n-grams in all, block by block. There the sets, in a common order with the most
frequent n-gram first, are stored in a compressed prefix tree. Each set goes down
the tree once, level by level; the overlap with a shared path is counted once for all sets
below it, and a subtree is left as soon as the remaining lengths of its sets and of the query can't
reach the similarity. What arrives at the end of a set is an exact overlap.

N-grams and sets are told apart by 64-bit hashes. Null and empty texts, and texts without
words, have an empty set and link with nothing, not even one another. A text with fewer
words than an n-gram has the whole sequence as its one n-gram. Repeated rows are documents of
their own with equal sets. A null id is never the least of its component unless all are. Rows are
numbered in a written table, so that ids may be null or shared. An empty table gives an empty result. Texts may be of any
length. Other columns, whatever their names, have no effect.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, dealt_by, materialize, table, text_bytes
from .components import connected_components

CACHE = 400_000
#: N-grams in all that one task of the tree join holds of a block.
BLOCK = 3_000_000
U = np.uint64
#: Buckets of the sketch of frequent n-grams, by the upper bits of their hashes, and slices in which it is summed.
BUCKETS, SLICES, SHIFT = 1 << 22, 64, np.uint64(42)


class WordHashes(dict):
    def __missing__(self, word):
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[word] = h
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def shingle_set(text: str | None, words: WordHashes, n: int) -> np.ndarray:
    """Sorted hashes of the distinct word n-grams. bytes.lower() and bytes.split() know ASCII only, as is wanted."""
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.zeros(0, U)
    a = np.fromiter(map(words.__getitem__, parts), U, len(parts))
    k = min(n, len(a))
    h = np.full(len(a) - k + 1, k, U)
    for j in range(k):
        h = (h ^ a[j : len(a) - k + 1 + j]) * U(0x9E3779B97F4A7C15)
        h ^= h >> U(29)
    return np.unique(mixed(h))


def set_id(h: np.ndarray) -> int:
    return int(np.int64(U(xxhash.xxh3_64_intdigest(h.tobytes()))))


class Ranges:
    """Ranges of set sizes such that linked sets lie in one range or in neighbours, and the parts of each."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]

    def _grow(self, n: int) -> None:
        while self.starts[-1] <= n:
            self.starts.append(self.starts[-1] * self.den // self.num + 1)

    def of(self, n: int) -> int:
        self._grow(n)
        return int(np.searchsorted(self.starts, n, side="right")) - 1

    def parts(self, r: int) -> tuple[int, int]:
        """Parts of which one must be equal, and parts to cut into, a few more so that hardly ever too many are empty."""
        self._grow(1)
        while len(self.starts) < r + 2:
            self._grow(self.starts[-1])
        need = (self.starts[r + 1] - 1) * (self.den - self.num) // self.num + 1
        return need, need if need == 1 else need + 1 + need // 16


def part_hashes(h: np.ndarray, size: int, ranges: Ranges, space: int = 0) -> tuple[np.ndarray, bool]:
    """Hashes of the parts of h, all or some n-grams of a set of that size, under its range and the next; and whether they are enough.

    A set of n differs from any linked one in d = n (1 - t) / t at most. Of p parts that
    aren't empty, p - d or more are equal in both; so either may leave out half of p - d - 1, and one is
    still given by both. The parts of fewest n-grams are left out: they are equal by chance most often.
    """
    out, enough = [], True
    r = ranges.of(size)
    salted = mixed(h + U(1))
    differ = size * (ranges.den - ranges.num) // ranges.num
    for key in (r, r + 1):
        _, parts = ranges.parts(key)
        part = ((h >> U(32)) * U(parts)) >> U(32)
        starts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1]) if len(h) else np.zeros(0, np.int64)
        spare = (len(starts) - differ - 1) // 2
        enough &= len(starts) > differ
        if not len(starts):
            continue
        hashes = mixed(np.add.reduceat(salted, starts) ^ mixed(part[starts] * U(1 << 20) + U((space << 50) + key + 1)))
        if spare > 0:
            sizes = np.diff(np.concatenate([starts, [len(h)]]))
            hashes = hashes[np.argsort(sizes, kind="stable")[spare:]]
        out.append(hashes)
    return np.concatenate(out) if out else np.zeros(0, U), enough


def candidate_hashes(h: np.ndarray, frequent: np.ndarray, ranges: Ranges) -> np.ndarray:
    """Hashes of which two linked sets have one in common.

    Parts are made of the n-grams that aren't frequent, since passages that many texts share make
    parts equal too often; two sets differ no more in these than in all. Sets that have too few of them for
    the argument meet by the parts of all their n-grams, and those that fail even so by their range.
    """
    rare, enough = part_hashes(h[~frequent[h >> SHIFT]], len(h), ranges)
    if enough:
        return rare
    full, enough = part_hashes(h, len(h), ranges, 1)
    out = [rare, full]
    if not enough:
        r = ranges.of(len(h))
        out.append(mixed(np.array([r + (1 << 40), r + 1 + (1 << 40)], U)))
    return np.concatenate(out)


def _count(n: int):
    """Rows (slice, counts): how many n-grams of the task's texts fall into each bucket of each slice of the sketch."""

    def run(batches):
        words, counts = WordHashes(), np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                np.add.at(counts, shingle_set(text, words, n) >> SHIFT, 1)
        if counts.any():
            for k, part in enumerate(np.split(np.minimum(counts, 65535).astype("<u2"), SLICES)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], ["slice", "counts"])

    return run


def _frequent(batches):
    """Rows (slice, bits): the buckets that hold far more than their share."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, c in zip(batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            one = np.frombuffer(zlib.decompress(c), "<u2").astype(np.int64)
            sums[k] = sums[k] + one if k in sums else one
    if sums:
        bits = [np.packbits(c > c.mean() + 6 * np.sqrt(c.mean()) + 4).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(bits, pa.binary())], ["slice", "counts"])


def frequent_buckets(rows: DataFrame, n: int) -> bytes:
    """One bit for each of BUCKETS buckets of n-grams, from all texts: 512 KB, whatever the data's size."""
    merged = rows.select("text").mapInArrow(_count(n), "slice int, counts binary").repartition("slice").mapInArrow(_frequent, "slice int, counts binary")
    found = dict(map(tuple, merged.collect()))  # SLICES rows of 8 KB
    return b"".join(bytes(found.get(k, b"\0" * (BUCKETS // SLICES // 8))) for k in range(SLICES))


def forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (least of the group, member) that connect the same values as the given pairs, one for each member but the least."""
    values, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    least = np.arange(len(values))
    while True:
        low = np.minimum(least[a], least[b])
        after = least.copy()
        # Labels are members too, so their own labels sink with those of the ends.
        for end in (a, b, least[a], least[b]):
            np.minimum.at(after, end, low)
        after = after[after]
        if np.array_equal(after, least):
            break
        least = after
    member = np.flatnonzero(least != np.arange(len(values)))
    return np.stack([values[least[member]], values[member]], 1)


FOUND, FOUND_SCHEMA = ["key", "a", "b", "row"], "key long, a long, b long, row long"


def _found(key: np.ndarray, a: np.ndarray, b: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(a), pa.array(np.full(len(key), b, np.int64)), pa.nulls(len(key), pa.int64())], FOUND)


def _candidates(num: int, den: int, n: int, bits: bytes):
    """Rows (key, a, b, row): b = -1: a part's hash and a class; b = -2: classes key and a are candidates; else class, document id, set size and row."""

    def run(batches):
        words, ranges = WordHashes(), Ranges(num, den)
        frequent = np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)
        for whole in batches:
            for first in range(0, max(whole.num_rows, 1), 2000):
                batch = whole.slice(first, 2000)
                ids = batch.column("id")
                nodes, sizes, keys, owners, seen = [], [], [], [], set()
                for text in batch.column("text").to_pylist():
                    h = shingle_set(text, words, n)
                    node = set_id(h) if len(h) else 0
                    nodes.append(node)
                    sizes.append(len(h))
                    if len(h) and node not in seen:
                        seen.add(node)
                        k = candidate_hashes(h, frequent, ranges)
                        keys.append(k)
                        owners.append(np.full(len(k), node, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), ids, pa.array(sizes, pa.int64()), batch.column("row")], FOUND)
                if keys:
                    k, o = np.concatenate(keys).view(np.int64), np.concatenate(owners)
                    order = np.lexsort((o, k))
                    k, o = k[order], o[order]
                    new = np.concatenate([[True], k[1:] != k[:-1]])
                    head = o[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
                    yield _found(k[new], o[new], -1)
                    if not new.all():
                        pairs = forest(np.stack([head[~new], o[~new]], 1))
                        yield _found(pairs[:, 0].copy(), pairs[:, 1].copy(), -2)

    return run


def _stars(batches):
    """Pass documents and candidates on; of part hashes that several classes have, make stars around the least class."""
    keys, owners = [], []
    for batch in batches:
        kind = batch.column("b")
        part = pc.equal(kind, -1)
        rest = batch.filter(pc.invert(part))
        if rest.num_rows:
            yield rest
        mine = batch.filter(part)
        keys.append(mine.column("key").to_numpy(zero_copy_only=False))
        owners.append(mine.column("a").to_numpy(zero_copy_only=False))
    if keys:
        k, o = np.concatenate(keys).astype(np.int64), np.concatenate(owners).astype(np.int64)
        if len(k):
            order = np.argsort(k, kind="stable")
            k = k[order]
            same = np.concatenate([[False], k[1:] == k[:-1]])
            use = same | np.concatenate([same[1:], [False]])
            k, o = k[use], o[order][use]
            order = np.lexsort((o, k))
            k, o = k[order], o[order]
            if len(k):
                new = np.concatenate([[True], k[1:] != k[:-1]])
                head = o[np.maximum.accumulate(np.where(new, np.arange(len(k)), 0))]
                pairs = forest(np.stack([head, o], 1))
                yield _found(pairs[:, 0].copy(), pairs[:, 1].copy(), -2)


class PrefixTree:
    """A compressed prefix tree over sets of token ranks; every set's tokens ascend."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        self.tokens = np.concatenate([sets[i] for i in order])
        offset = np.concatenate([[0], np.cumsum([len(sets[i]) for i in order])])
        parent, lo, hi, depth, own, start = [-1], [0], [0], [0], [-1], [0]
        stack, previous = [0], None
        for k, i in enumerate(order):
            s, shared = sets[i], 0
            if previous is not None:
                m = min(len(s), len(previous))
                differ = s[:m] != previous[:m]
                shared = int(differ.argmax()) if differ.any() else m
            last = -1
            while depth[stack[-1]] > shared:
                last = stack.pop()
            top = stack[-1]
            if depth[top] < shared:  # cut the edge to the last node
                parent.append(top)
                lo.append(offset[k] + depth[top])
                hi.append(offset[k] + shared)
                depth.append(shared)
                own.append(-1)
                start.append(start[last])
                lo[last] += shared - depth[top]
                parent[last] = top = len(parent) - 1
                stack.append(top)
            parent.append(top)
            lo.append(offset[k] + shared)
            hi.append(offset[k] + len(s))
            depth.append(len(s))
            own.append(i)
            start.append(k)
            stack.append(len(parent) - 1)
            previous = s
        self.order = np.array(order, np.int64)
        self.lo, self.hi, self.depth, self.own, self.start = (np.array(x, np.int64) for x in (lo, hi, depth, own, start))
        parent = np.array(parent, np.int64)
        self.least = np.where(self.own >= 0, self.depth, 1 << 60)
        self.most, self.stop = self.depth.copy(), self.start + (self.own >= 0)
        # From the leaves up; of equal depths the later node is the lower one.
        for node in sorted(range(len(parent)), key=lambda k: (-depth[k], -k)):
            if (p := parent[node]) >= 0:
                self.least[p] = min(self.least[p], self.least[node])
                self.most[p] = max(self.most[p], self.most[node])
                self.stop[p] = max(self.stop[p], self.stop[node])
        by_parent = np.argsort(parent, kind="stable")[1:]
        counts = np.bincount(parent[1:], minlength=len(parent))
        self.kids, self.first = by_parent, np.concatenate([[0], np.cumsum(counts)])

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.first[nodes + 1] - self.first[nodes]
        at = np.repeat(self.first[nodes] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return self.kids[at], n

    def linked(self, query: np.ndarray, mark: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Ranges (starts, ends) of places in the order of the tree: the sets whose overlap with query reaches num / den of the union.

        A subtree all of whose sets link with query, whatever follows, is one range and is not walked.
        """
        size, starts, ends_found = len(query), [], []
        mark[query] = True
        nodes, n = self.children(np.zeros(1, np.int64))
        overlap = np.zeros(len(nodes), np.int64)
        while len(nodes):
            lo, length = self.lo[nodes], self.hi[nodes] - self.lo[nodes]
            ends = np.cumsum(length)
            at = np.repeat(lo - (ends - length), length) + np.arange(ends[-1])
            hits = np.concatenate([[0], np.cumsum(mark[self.tokens[at]])])
            overlap = overlap + hits[ends] - hits[ends - length]
            depth, most, least = self.depth[nodes], self.most[nodes], self.least[nodes]
            every = den * overlap >= num * (size + most - overlap)
            ending = ~every & (self.own[nodes] >= 0) & (den * overlap >= num * (size + depth - overlap))
            starts += [self.start[nodes[every]], self.start[nodes[ending]]]
            ends_found += [self.stop[nodes[every]], self.start[nodes[ending]] + 1]
            # What the rest of the paths and of the query can add at most.
            passed = np.searchsorted(query, self.tokens[self.hi[nodes] - 1], side="right")
            best = overlap + np.minimum(most - depth, size - passed)
            alive = ~every & (most > depth) & (den * best >= num * (size + np.maximum(least, best) - best))
            nodes, n = self.children(nodes[alive])
            overlap = np.repeat(overlap[alive], n)
        mark[query] = False
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *starts]), np.concatenate([none, *ends_found])


def _top(up: list[int], k: int) -> int:
    while up[k] != k:
        up[k] = up[up[k]]
        k = up[k]
    return k


class Groups:
    """Numbers 0 to n - 1 in groups. Those of a range are united by the gaps that are left in it, each of which closes once."""

    def __init__(self, n: int):
        self.up, self.gap = list(range(n)), list(range(n))

    def unite(self, a: int, b: int) -> None:
        a, b = _top(self.up, a), _top(self.up, b)
        self.up[max(a, b)] = min(a, b)

    def unite_range(self, start: int, end: int) -> None:
        k = _top(self.gap, start)
        while k < end - 1:
            self.unite(k, k + 1)
            self.gap[k] = k + 1
            k = _top(self.gap, k)

    def root(self, k: int) -> int:
        return _top(self.up, k)


def tree_join(sets: list[np.ndarray], copies: np.ndarray, blocks: list[int] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """For each set one of the sets that its links reach, the same for all of these, and the copies that it links with; with two kinds of blocks, only across them.

    No pair is listed: links are counted and united by ranges of the tree, so memory grows with the n-grams and not with the links.
    """
    flat = np.concatenate(sets)
    kinds, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.empty(len(kinds), np.int64)
    rank[np.lexsort((kinds, -counts))] = np.arange(len(kinds))
    bounds = np.cumsum([len(s) for s in sets])[:-1]
    ranked = [np.sort(x) for x in np.split(rank[inverse], bounds)]
    mark = np.zeros(len(kinds), bool)
    across = blocks is not None and len(set(blocks)) > 1
    stored = [i for i, b in enumerate(blocks) if b == min(blocks)] if across else list(range(len(sets)))
    asking = [i for i, b in enumerate(blocks) if b != min(blocks)] if across else stored
    tree = PrefixTree([ranked[i] for i in stored])
    # Sets are numbered by their place in the tree, those that only ask after them.
    placed = np.concatenate([np.array(stored, np.int64)[tree.order], np.array(asking if across else [], np.int64)])
    number = np.empty(len(sets), np.int64)
    number[placed] = np.arange(len(sets))
    before = np.concatenate([[0], np.cumsum(copies[placed[: len(stored)]])])
    links, steps, groups = np.zeros(len(sets), np.int64), np.zeros(len(stored) + 1, np.int64), Groups(len(sets))
    for i in asking:
        starts, ends = tree.linked(ranked[i], mark, num, den)
        links[i] = (before[ends] - before[starts]).sum() - (0 if across else copies[i])
        if across:
            np.add.at(steps, starts, copies[i])
            np.add.at(steps, ends, -copies[i])
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            groups.unite_range(start, end)
            groups.unite(int(number[i]), start)
    links[placed[: len(stored)]] += np.cumsum(steps[:-1])
    return placed[[groups.root(k) for k in number.tolist()]], links


def _unit(rows: list[tuple], cross: bool, num: int, den: int) -> pa.RecordBatch:
    """rows: (node, copies, block, tokens) of one unit; cross: only links across its two blocks. Gives node, root and links for the linked ones."""
    if cross and len({r[2] for r in rows}) < 2:
        rows = []
    nodes, copies = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
    root = links = np.zeros(0, np.int64)
    if rows:
        root, links = tree_join([r[3] for r in rows], copies, [r[2] for r in rows] if cross else None, num, den)
    use = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([pa.array(nodes[use]), pa.array(nodes[root[use]]), pa.array(links[use])], ["node", "root", "links"])


def _units(num: int, den: int):
    def run(batches):
        held, key = [], None
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("component", "i", "j", "node", "copies", "block", "tokens")), strict=True):
                if r[:3] != key:
                    if len(held) > 1:
                        yield _unit(held, key[1] != key[2], num, den)
                    held, key = [], r[:3]
                held.append((*r[3:6], np.frombuffer(r[6], U)))
        if len(held) > 1:
            yield _unit(held, key[1] != key[2], num, den)

    return run


def jaccard_components(docs: DataFrame, words: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """id, n_shingles, class_id, n_links, component_id for each row.

    class_id is the same for texts with equal sets (null for empty ones), n_links the number of documents that a
    document links with, component_id the least id that its links reach. row_col: a number of the
    rows of docs, a written table; then row and component come too, a class of the component that no other has (null for empty texts).
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
    rows = rows if row_col else materialize(rows, "rows")
    emitted = rows.mapInArrow(_candidates(num, den, words, frequent_buckets(rows, words)), FOUND_SCHEMA)
    # Part hashes are dealt by hash, all else evenly.
    n_bytes = text_bytes(rows)
    dealt = dealt_by(emitted, n_bytes, F.when(F.col("b") == -1, F.col("key")).otherwise(F.xxhash64("a", "b", "key", "row")))
    found = materialize(dealt.mapInArrow(_stars, FOUND_SCHEMA), "candidates")
    members = found.where("b >= 0").select(F.col("key").alias("node"), F.col("a").alias("id"), F.col("b").alias("n"), "row")
    classes = materialize(members.where("n > 0").groupBy("node").agg(F.min("id").alias("least_id"), F.min("row").alias("first_row"), F.max("n").alias("n"), F.count(F.lit(1)).alias("copies")), "classes")
    groups = connected_components(found.where("b = -2"), "key", "a")
    grouped = groups.join(classes, "node")
    sizes = grouped.groupBy("component").agg(F.ceil(F.sum("n") / F.lit(BLOCK)).cast("int").alias("blocks"))
    wanted = materialize(
        grouped.join(sizes, "component").select("node", "first_row", "component", "copies", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block")), "wanted"
    )

    def sets(batches):
        cache = WordHashes()
        for batch in batches:
            out = []
            for text, node in zip(batch.column("text").to_pylist(), batch.column("node").to_pylist(), strict=True):
                h = shingle_set(text, cache, words)
                out.append(h.tobytes() if len(h) and set_id(h) == node else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("node", "component", "copies", "blocks", "block")), pa.array(out, pa.binary())], ["node", "component", "copies", "blocks", "block", "tokens"])

    # One row for each node.
    texts = rows.join(broadcast_if(wanted, wanted.count(), 64), rows["row"] == wanted["first_row"]).select("text", "node", "component", "copies", "blocks", "block")
    stored = texts.mapInArrow(sets, "node long, component long, copies long, blocks int, block int, tokens binary").where("tokens IS NOT NULL")
    units = stored.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    units = units.select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "copies", "block", "tokens")
    sorted_units = dealt_by(units, n_bytes, "component", "i", "j").sortWithinPartitions("component", "i", "j", "node")
    linked = materialize(sorted_units.mapInArrow(_units(num, den), "node long, root long, links long"), "links")
    joined = connected_components(linked.where("node <> root"), "node", "root")
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.join(joined, "node", "left").join(counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = known.groupBy("component").agg(F.min("least_id").alias("component_id"))
    table_of_nodes = known.join(heads, "component").select("node", "component", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    full = members.where("n > 0").join(table_of_nodes, "node").select("row", "component", F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("node").alias("class_id"), "n_links", "component_id")
    none = F.lit(None).cast("long")
    empty = members.where("n = 0").select("row", none.alias("component"), F.col("id").alias(id_col), F.col("n").alias("n_shingles"), none.alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = full.union(empty)
    return out if row_col else out.drop("row", "component")


def op4_ngram_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents")).drop("class_id")
