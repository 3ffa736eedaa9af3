"""The trie of conversations' prefixes, by polynomial rolling fingerprints.

1. Turns are numbered in the order of (conversation, turn): a range sort, written once with the texts, and counts by
   range; a conversation that fills many ranges is numbered range by range. All steps but the comparison of texts
   read the written table's narrow columns alone.
2. Each turn has two hashes below 2^31 - 1. A prefix's fingerprint is the pair of sums of hash * base^depth modulo that
   prime, from numpy scans over stretches of at most STRETCH turns, with the sums of the stretches before added.
3. Prefixes of equal depth and fingerprint are a candidate group, represented by its least conversation. Every turn of a
   group of two and more is compared with the representative's turn of that depth, role and text in full (turns that
   are the same row need no comparing). If all are equal at every depth, groups are nodes: equal fingerprints
   and equal last turns leave equal fingerprints of the prefixes before. Where turns differ, the rows of that group
   get new hashes, one for each distinct turn, and the fingerprints are made again, until none differ.
4. Rollup: a node's value goes to all its parents up to the root as a sum along the prefixes of its least conversation, and
   from there to the nodes of each depth; no step for each depth. Nodes of one conversation need none of it.

Digests of ids are made from blocks of joined ids, which Spark sorts, so that copies of one conversation in any number
go through one task as few rows and in bounded memory.

Null role or text counts as empty. Rows of one turn go by role and then text, by their first 64 characters, then by a hash
of the whole. Repeated rows are turns of their own. Rows with a null conversation belong to none and are left out. The conversation from which a
conversation takes its first turns is found with the remainder that keeps the sign of the id. Texts may be of any length. An empty table gives an
empty result. Other columns of the table are not looked at.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

PRIME = (1 << 31) - 1
BASES = (911382323, 972663749)
#: Turns that one scan takes, and ids joined in one block.
STRETCH, BLOCK = 4096, 256
#: Ids start with so many turns of another conversation at most, less one.
MOST_HEAD = 4
EMPTY_DIGEST = hashlib.sha256(b"").hexdigest()


def turn_hash(seed: int, *columns: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(PRIME))


def number_turns(rows: DataFrame) -> DataFrame:
    """A written table: g (rises with conversation and turn), conv, h0, h1, words; role and text beside them."""
    turns = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"),
    )
    turns = turns.withColumns({"a": F.substring("role", 1, 64), "b": F.substring("text", 1, 64), "h": F.xxhash64("role", "text")})
    order = ["conv", "turn", "a", "b", "h", "row"]
    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    out = ranged.select(F.monotonically_increasing_id().alias("g"), "conv", turn_hash(1, "role", "text").alias("h0"), turn_hash(2, "role", "text").alias("h1"), words.alias("words"), "role", "text")
    return materialize(out, "turns")


def rebuild(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv, length; their rebuilt turns: conv, length, depth, g, h0, h1, words)."""
    part = F.shiftright("g", 33)
    ranges = turns.groupBy("conv", part.alias("part")).agg(F.min("g").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumns({"before": before, "all": F.sum("n").over(Window.partitionBy("conv"))})
    conv = F.col("conv")
    ranges = ranges.withColumns({"base": conv - conv % 20, "head": F.crc32(conv.cast("string").cast("binary")) % MOST_HEAD})
    bases = ranges.where("before = 0").select(F.col("conv").alias("of"), F.col("all").alias("base_all"))
    ranges = ranges.join(bases, ranges["base"] == bases["of"], "left").withColumn("taken", F.least("head", F.coalesce("base_all", F.lit(0))))
    length = F.col("taken") + F.greatest(F.col("all") - F.col("head"), F.lit(0))
    ranges = materialize(ranges.select("conv", "part", "first", "before", "base", "head", "taken", length.alias("length")), "ranges")
    convs, keep = ranges.where("before = 0").select("conv", "base", "taken", "length"), ["conv", "length", "depth", "g", "h0", "h1", "words"]
    narrow = turns.select("conv", part.alias("part"), "g", "h0", "h1", "words").join(ranges.drop("base"), ["conv", "part"])
    narrow = narrow.withColumn("place", F.col("g") - F.col("first") + F.col("before") + 1)
    own = narrow.where("place > head").withColumn("depth", F.col("place") - F.col("head") + F.col("taken")).select(*keep)
    heads = narrow.where(F.col("place") < MOST_HEAD).select(F.col("conv").alias("of"), F.col("place").alias("depth"), "g", "h0", "h1", "words")
    given = convs.join(heads, convs["base"] == heads["of"]).where("depth <= taken").select(*keep)
    return convs.select("conv", "length"), materialize(own.union(given), "rebuilt")


def _scan(key: np.ndarray, values: list[np.ndarray], carried: tuple) -> list[np.ndarray]:
    """Running sums of each value within runs of equal keys (rows of key); carried: last key and sums of the batch before."""
    n = len(key)
    new = np.ones(n, bool)
    new[1:] = (key[1:] != key[:-1]).any(1)
    new[0] = carried[0] is None or bool((key[0] != carried[0]).any())
    start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
    out = []
    for v, c in zip(values, carried[1]):
        total = np.cumsum(v)
        out.append(total - np.where(start > 0, total[start - 1], 0) + np.where(start < 0, c, 0))
    return out


def _powers(base: int, exponent: np.ndarray) -> np.ndarray:
    out, square, left = np.ones(len(exponent), np.int64), base % PRIME, exponent.copy()
    while left.any():
        out = np.where(left & 1, out * square % PRIME, out)
        left, square = left >> 1, square * square % PRIME
    return out


def running_sums(rows: DataFrame, values: list[str], rolling: bool = False) -> DataFrame:
    """rows (with conv and depth), e0, e1, …: sums of each value over the conversation's lesser depths, and s0, s1, …: with the row's own.

    Rolling: values are first multiplied by BASES[i]^depth, and sums are taken modulo PRIME. Stretches of
    a conversation are scanned apart; those after the first get the sums of the ones before.
    """
    names, places = rows.columns, range(len(values))
    sums = [*(f"e{i}" for i in places), *(f"s{i}" for i in places)]

    def run(batches):
        carried = (None, [0] * len(values))
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column("conv").to_numpy(), b.column("stretch").to_numpy()], 1)
            value = [b.column(v).to_numpy() for v in values]
            if rolling:
                value = [v * _powers(base, b.column("depth").to_numpy()) % PRIME for v, base in zip(value, BASES)]
            got = _scan(key, value, carried)
            carried = (key[-1], [int(g[-1]) for g in got])
            got = [*(g - v for g, v in zip(got, value)), *got]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, got)], [*b.schema.names, *sums])

    kinds = dict(rows.dtypes)
    cut = rows.withColumn("stretch", F.floor((F.col("depth") - 1) / STRETCH).cast("long"))
    cut = cut.repartition("conv", "stretch").sortWithinPartitions("conv", "stretch", "depth")
    out = materialize(cut.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in names), "stretch long", *(f"{s} long" for s in sums)])), "sums")
    long = out.where("stretch > 0").select("conv").distinct()
    last = out.join(long, "conv", "left_semi").groupBy("conv", "stretch").agg(*(F.max_by(f"s{i}", "depth").alias(f"t{i}") for i in places))
    before = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    earlier = last.select("conv", "stretch", *((F.sum(f"t{i}") if not rolling else F.sum(F.col(f"t{i}") % PRIME)).over(before).alias(f"c{i}") for i in places)).where("stretch > 0")
    whole = lambda c: F.col(c) + F.coalesce(F.col(f"c{c[1:]}"), F.lit(0))
    return out.join(earlier, ["conv", "stretch"], "left").select(*names, *((whole(c) % PRIME if rolling else whole(c)).alias(c) for c in sums))


def find_nodes(turns: DataFrame, rebuilt: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rebuilt turns with print and up, the fingerprints with and without the turn; nodes: depth, print, up, least, n, words; rows of nodes with n > 1). All verified."""
    seed = 1
    while True:
        mark = lambda c: F.shiftleft(f"{c}0", 31) + F.col(f"{c}1")
        prints = running_sums(rebuilt, ["h0", "h1"], rolling=True).withColumns({"print": mark("s"), "up": mark("e")})
        groups = prints.groupBy("depth", "print").agg(F.min(F.struct("conv", "g", "up", "words")).alias("of"), F.count("*").alias("n"))
        groups = materialize(groups.select("depth", "print", F.col("of.up").alias("up"), F.col("of.conv").alias("least"), F.col("of.g").alias("least_g"), F.col("of.words").alias("words"), "n"), "groups")
        shared = prints.select("conv", "depth", "print", "g").join(groups.where("n > 1").drop("up"), ["depth", "print"])
        shared = materialize(shared, "shared")
        differ = differing(turns, shared)
        if differ is None:
            return prints, groups, shared
        seed += 1
        rebuilt = renewed(turns, rebuilt, shared, differ, seed)


def differing(turns: DataFrame, shared: DataFrame) -> DataFrame | None:
    """depth, print of the groups with a turn that is not the representative's; None if there is none."""
    texts = turns.select("g", "role", "text")
    pairs = shared.where("g <> least_g").select("depth", "print", "g", "least_g").distinct()
    # Equal turns of a group are one row before they meet the representative's.
    each = pairs.join(texts, "g").select("depth", "print", "least_g", "role", "text").distinct()
    its = texts.select(F.col("g").alias("least_g"), F.col("role").alias("its_role"), F.col("text").alias("its_text"))
    apart = each.join(its, "least_g").where("role <> its_role OR text <> its_text").select("depth", "print").distinct()
    apart = materialize(apart, "apart")
    return apart if apart.limit(1).count() else None


def renewed(turns: DataFrame, rebuilt: DataFrame, shared: DataFrame, differ: DataFrame, seed: int) -> DataFrame:
    """rebuilt, with new hashes for the turns of the groups in `differ`: the same for equal turns."""
    rows = shared.join(differ, ["depth", "print"], "left_semi").select("g").distinct()
    texts = rows.join(turns.select("g", "role", "text"), "g")
    kinds = texts.groupBy("role", "text").agg(F.min("g").alias("kind"))
    fresh = texts.join(kinds, ["role", "text"]).select("g", *(F.pmod(F.xxhash64(F.lit(2 * seed + i), "kind"), F.lit(PRIME)).alias(f"f{i}") for i in (0, 1)))
    hashes = [F.coalesce(f"f{i}", f"h{i}").alias(f"h{i}") for i in (0, 1)]
    return materialize(rebuilt.join(fresh, "g", "left").select("conv", "length", "depth", "g", *hashes, "words"), "rebuilt")


def digest_ends(ends: DataFrame) -> DataFrame:
    """depth, print, digest: SHA-256 of the ascending ids of a node's conversations that end in it, joined by commas."""

    def blocks(batches):
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("depth", "print")], 1)
            ids, starts = b.column("conv").to_pylist(), np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)][: len(key)])
            cuts = [(i, min(i + BLOCK, end)) for start, end in zip(starts, [*starts[1:], len(key)]) for i in range(start, end, BLOCK)]
            at = [i for i, _ in cuts]
            joined = [",".join(map(str, ids[i:j])) for i, j in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(key[at, 0]), pa.array(key[at, 1]), pa.array([ids[i] for i in at], pa.int64()), pa.array(joined, pa.string())], ["depth", "print", "first", "ids"])

    def digests(batches):
        key, sha = None, None
        row = lambda keys, out: pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(out, pa.string())], ["depth", "print", "digest"])
        for b in batches:
            keys, out = [], []
            for depth, mark, ids in zip(*(b.column(c).to_pylist() for c in ("depth", "print", "ids"))):
                if (depth, mark) == key:
                    sha.update(b"," + ids.encode())
                    continue
                if key:
                    keys.append(key)
                    out.append(sha.hexdigest())
                key, sha = (depth, mark), hashlib.sha256(ids.encode())
            yield row(keys, out)
        yield row([key], [sha.hexdigest()]) if key else row([], [])

    order = ["depth", "print", "conv"]
    joined = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(blocks, "depth long, print long, first long, ids string")
    return joined.repartition("depth", "print").sortWithinPartitions("depth", "print", "first").mapInArrow(digests, "depth long, print long, digest string")


def trie(rows: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = number_turns(rows)
    convs, rebuilt = rebuild(turns)
    prints, groups, shared = find_nodes(turns, rebuilt)
    place = ["depth", "print"]
    zero = F.lit(0).cast("long")
    ends = prints.where("depth = length").select(*place, "conv").union(convs.where("length = 0").select(zero.alias("depth"), zero.alias("print"), "conv"))
    children = groups.groupBy((F.col("depth") - 1).alias("depth"), F.col("up").alias("print")).agg(F.count("*").alias("n_children"))
    nodes = groups.join(children, place, "left").select(*place, "up", "least", "n", "n_children", ((F.col("n") - 1) * F.col("words")).alias("own"))
    nodes = materialize(nodes.withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    root = convs.select("conv", F.lit(1).cast("long").alias("n"), zero.alias("child"), zero.alias("leaf"), zero.alias("own"))
    root = root.union(nodes.select(F.lit(None).cast("long"), zero, (F.col("depth") == 1).cast("long"), (F.col("n_children") == 0).cast("long"), "own"))
    root = root.agg(F.min("conv").alias("least"), F.sum("n").alias("n"), F.sum("child").alias("n_children"), F.greatest(F.sum("leaf"), F.lit(1)).alias("leaves"), F.sum("own").alias("saved")).where("n > 0")
    root = materialize(root, "root")
    # Of nodes with several conversations, each leaf's least conversation is a member, and so are those whose prefixes have values.
    leaf = nodes.where("n_children = 0").select(F.col("least").alias("conv"))
    leaves = shared.join(leaf, "conv", "left_semi").groupBy(*place).agg(F.count("*").alias("leaves"))
    valued = shared.select("conv", *place, F.when(F.col("conv") == F.col("least"), (F.col("n") - 1) * F.col("words")).otherwise(0).alias("own"))
    totals = valued.groupBy("conv").agg(F.sum("own").alias("total")).where("total > 0")
    saved = running_sums(valued.join(totals, "conv"), ["own"]).groupBy(*place).agg(F.sum(F.col("total") - F.col("e0")).alias("saved"))
    none, text = F.lit(None).cast("long"), F.lit(None).cast("string")
    facts = leaves.select(*place, "leaves", none.alias("saved"), text.alias("digest")).union(saved.select(*place, none, "saved", text)).union(digest_ends(ends).select(*place, none, none, "digest"))
    facts = facts.groupBy(*place).agg(F.max("leaves").alias("leaves"), F.max("saved").alias("saved"), F.max("digest").alias("digest"))
    parents = groups.where("n > 1").select(F.col("depth").alias("above"), F.col("print").alias("up"), F.col("least").alias("parent")).union(root.select(zero, zero, "least"))
    below = nodes.withColumn("above", F.col("depth") - 1).join(parents, ["above", "up"], "left")
    below = below.select(*place, "least", F.coalesce("parent", "least").alias("parent"), "n", "n_children", F.lit(1).cast("long").alias("one"), zero.alias("nothing"))
    top = root.select(zero.alias("depth"), zero.alias("print"), "least", none.alias("parent"), "n", "n_children", F.col("leaves").alias("one"), F.col("saved").alias("nothing"))
    both = below.union(top).join(facts, place, "left")
    return both.select(
        F.col("least").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children",
        F.coalesce("leaves", "one").alias("n_leaves"), F.coalesce("saved", "nothing").alias("saved_tokens"), F.coalesce("digest", F.lit(EMPTY_DIGEST)).alias("ends_sha256"),
    )


def op13_conversation_trie(spark, sf_dir):
    return trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a string of digits, bit by bit.
CRC = "xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: ascii(d)::BIGINT), lambda a, d: list_reduce([xor(a, d)] || range(8), lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))))"
ORACLE = f"""
WITH own AS (SELECT conv_id AS c, list([coalesce(role, ''), coalesce(text, '')] ORDER BY turn NULLS FIRST, role, text) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
headed AS (SELECT c, turns, c - c % 20 AS base, {CRC} % 4 AS h FROM own),
built AS (SELECT a.c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM headed a LEFT JOIN own b ON b.c = a.base),
member AS (SELECT c, d, turns[1:d] AS path, len(turns) = d AS last FROM built, generate_series(0, len(turns)) t(d)),
node AS (SELECT d, path, min(c) AS least, count(*) AS n, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE last), '') AS ends FROM member GROUP BY d, path),
kids AS (SELECT d - 1 AS d, path[1:d - 1] AS path, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (SELECT n.*, coalesce(k.k, 0) AS k, CASE WHEN n.d = 0 THEN 0 ELSE (n.n - 1) * len(regexp_extract_all(n.path[n.d][2], '[^\x20\x09-\x0D]+')) END AS own
  FROM node n LEFT JOIN kids k ON k.d = n.d AND k.path = n.path),
rolled AS (SELECT a AS d, path[1:a] AS path, sum(own) AS saved, count(*) FILTER (WHERE k = 0) AS leaves FROM full_node, generate_series(0, d) t(a) GROUP BY ALL)
SELECT n.least AS conv_id, n.d AS depth, p.least AS parent_conv_id, n.n AS n_convs, n.k AS n_children, r.leaves AS n_leaves, CAST(r.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM full_node n JOIN rolled r ON r.d = n.d AND r.path = n.path LEFT JOIN node p ON p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]"""
