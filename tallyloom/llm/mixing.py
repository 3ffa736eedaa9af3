"""Mixing sources to target weights. DataFrame functions only.

Every source is dealt into blocks by a hash of its documents, so that a block is a
random part of its source. A source whose target exceeds its size is passed over
several times; the last pass draws blocks in a permuted order until the target is
met, and of the block that straddles the target a part is taken: whole sub-blocks by another
hash, then documents in the order of a third.

How many blocks of each source and pass go to each output shard is drawn by a splitting tree. A node that has n blocks passes
half of them, rounded up, to the left: of each source and pass in turn a hypergeometric variate, given what the earlier ones took, so that the numbers together
are a draw from the multivariate hypergeometric distribution; the rest goes right, and the leaves hold exact quotas. A variate is the quantile at a hash of seed, node, source and pass.
The blocks of a source, in their permuted order, are then handed to the shards by these quotas, each block to one shard,
and inside its shard a document has a position by a hash.

Tables of sources, quotas and blocks are ranked in ranges where they have more than RANGE rows, and are broadcast only where their counted rows are few. A node keeps its numbers in arrays of CELLS, or
of the root of their number where that is more, and first shares its draws among the arrays; so a node is no group that grows with the sources. Shards hold about
SHARD_WORDS words each and blocks are at least BLOCKS_A_SHARD times as many, so no group grows with the data. No draw
depends on the order of rows or on partitions: reruns agree.

Null texts and texts without words have size 0 and are taken as 0 words; they go with their block. A block without words is drawn
in the first pass. A null source is a source of its own, the last. Rows that share an id, or have none, are told apart by their text; rows that repeat
altogether are documents of their own that share a permutation key. Very long texts are documents like others. Other columns of the input, whatever their names,
have no effect. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, broadcast_if, materialize, table

MAX_PASSES = 3
LEAST_LEVELS, LEAST_BLOCKS, BLOCKS_A_SHARD = 4, 8192, 16
SHARD_WORDS = 16_000_000
#: Parts by hash of a block that is taken in part.
SUB_BLOCKS = 1024
#: Rows of a table of sources, quotas or blocks that one task ranks.
RANGE = 1_000_000
#: Numbers of sources and passes in one array of a node, unless their root is more, and levels of the tree that one plan holds.
CELLS, PLANNED_LEVELS = 1024, 4
#: A variate is looked for so many deviations, and so many units more, around its mean; what lies beyond weighs less than 2^-53.
REACH, SLACK = 12, 24


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, rows: int, order: list[Column], sums: list[str] = (), label: str = "ranked") -> DataFrame:
    """df, of so many rows at most, with place, from 0, in the given total order, and before_<c> for each of sums. More than RANGE rows are ranked range by range."""
    if rows <= RANGE:
        whole = W.orderBy(*order)
        until = whole.rowsBetween(W.unboundedPreceding, -1)
        return df.select("*", (F.row_number().over(whole) - 1).cast("long").alias("place"), *[F.coalesce(F.sum(c).over(until), F.lit(0)).alias(f"before_{c}") for c in sums])
    parts = rows // RANGE + 1
    placed = materialize(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), label)
    totals = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{c}") for c in sums])
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row for each range
    bases = totals.select("_part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_base") for c in ("_n", *(f"_{c}" for c in sums))])
    own = W.partitionBy("_part").orderBy(*order)
    until = own.rowsBetween(W.unboundedPreceding, -1)
    out = placed.join(F.broadcast(bases), "_part").withColumn("place", F.col("_n_base") + F.row_number().over(own) - 1)
    for c in sums:
        out = out.withColumn(f"before_{c}", F.col(f"_{c}_base") + F.coalesce(F.sum(c).over(until), F.lit(0)))
    return out.select(*df.columns, "place", *[f"before_{c}" for c in sums])


def source_targets(sizes: DataFrame, rows: int, cap: int = MAX_PASSES) -> DataFrame:
    """From (source, source_size): target, the share by weight 1, 2, 3 and again, stopped at cap times the size, the excess shared anew.

    Sources in ascending order of cap / weight are stopped one after another; once one
    isn't, no later one is. So prefix sums in that order replace the repeated sharing.
    """
    by_name = F.col("source").asc_nulls_last()
    weighed = ranked(sizes, rows, [by_name], label="sources").withColumn("weight", F.pmod("place", F.lit(3)) + 1).withColumn("most", F.lit(cap) * F.col("source_size")).drop("place")
    total, weights = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    stops = ranked(weighed.withColumn("ratio", F.col("most") / F.col("weight")), rows, [F.col("ratio").asc(), by_name], ["most", "weight"], "stops")
    level = (F.lit(total or 0) - F.col("before_most")) / (F.lit(weights or 0) - F.col("before_weight"))
    free = stops.withColumn("level", level).where(F.col("most") > F.col("level") * F.col("weight")).agg(F.min_by("level", "place")).first()[0]
    # The level of the first source that isn't stopped holds for all after it.
    target = F.col("most").cast("double") if free is None else F.least(F.col("most").cast("double"), F.lit(free) * F.col("weight"))
    return stops.select("source", "source_size", target.alias("target"))


def _draw(seed: int, salt: str, *cols) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(salt), *cols)


def _let(value: Column, then) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _struct(**fields: Column) -> Column:
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many marked ones are among `drawn` of `total` things, `marked` of them marked: the quantile at u, from 0 to below 1.

    Weights follow from the ratio of each to the one before, from the lower end of the range on, and u cuts their sum.
    """
    given = _struct(t=total.cast("double"), k=marked.cast("double"), d=drawn.cast("double"), u=u)

    def reach(g: Column) -> Column:
        mean = g["d"] * g["k"] / F.greatest(g["t"], F.lit(1.0))
        spread = F.sqrt(mean * (g["t"] - g["k"]) * (g["t"] - g["d"]) / F.greatest(g["t"] * (g["t"] - 1), F.lit(1.0))) * REACH + SLACK
        low = F.greatest(F.lit(0.0), g["d"] + g["k"] - g["t"], F.floor(mean - spread).cast("double"))
        return _struct(g=g, low=low.cast("long"), high=F.least(g["k"], g["d"], F.ceil(mean + spread).cast("double")).cast("long"))

    def quantile(r: Column) -> Column:
        g, steps = r["g"], F.sequence(r["low"], r["high"])

        def ratio(x: Column) -> Column:
            return (g["k"] - x) * (g["d"] - x) / ((x + 1) * (g["t"] - g["k"] - g["d"] + x + 1))

        whole = F.aggregate(
            steps, _struct(w=F.lit(1.0), sum=F.lit(0.0)), lambda a, x: _struct(w=a["w"] * ratio(x), sum=a["sum"] + a["w"]), lambda a: a["sum"] * g["u"]
        )

        def below(cut: Column) -> Column:
            start = _struct(w=F.lit(1.0), sum=F.lit(0.0), n=F.lit(0).cast("long"))
            more = lambda a, x: _struct(w=a["w"] * ratio(x), sum=a["sum"] + a["w"], n=a["n"] + (a["sum"] + a["w"] <= cut).cast("long"))
            return F.aggregate(steps, start, more, lambda a: F.least(r["low"] + a["n"], r["high"]))

        return _let(whole, below)

    return _let(_let(given, reach), quantile)


def shared(cells: Column, drawn: Column, uniform) -> Column:
    """How many of so many drawn things fall to each of the cells, in their order; uniform gives a cell's u. A draw from the multivariate hypergeometric distribution."""
    start = _struct(rest=F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["n"]), drawn=drawn.cast("long"), out=F.array().cast("array<bigint>"))

    def step(a: Column, c: Column) -> Column:
        taken = lambda x: _struct(rest=a["rest"] - c["n"], drawn=a["drawn"] - x, out=F.concat(a["out"], F.array(x)))
        return _let(hypergeometric(a["rest"], c["n"], a["drawn"], uniform(c)), taken)

    return F.aggregate(cells, start, step, lambda a: a["out"])


def shard_quotas(drawn: DataFrame, rows: int, levels: int, seed: int) -> DataFrame:
    """From (source, pass, n) drawn blocks of each source and pass, so many rows at most: source, pass, shard, quota. Rows of no blocks have no quota."""

    def uniform(*cols: Column) -> Column:
        return F.shiftrightunsigned(_draw(seed, "node", *cols), 11) * F.lit(2.0**-53)

    length = max(CELLS, math.isqrt(rows) + 1)
    cells = ranked(drawn.where("n > 0"), rows, [F.col("source").asc_nulls_last(), F.col("pass")], label="cells")
    cells = cells.select(F.floor(F.col("place") / length).alias("part"), F.struct("place", "source", "pass", "n").alias("cell"))
    nodes = cells.groupBy("part").agg(F.array_sort(F.collect_list("cell")).alias("cells")).select(F.lit(1).cast("long").alias("node"), "part", "cells")
    for level in range(1, levels + 1):
        nodes = nodes.withColumn("n", F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + c["n"]))
        if rows > length:
            # The node's draws are shared among its arrays first.
            parts = nodes.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("part", "n"))).alias("parts"), F.shiftright(F.sum("n") + 1, 1).alias("half"))
            to_part = shared(F.col("parts"), F.col("half"), lambda c: uniform(F.col("node"), F.lit("part"), c["part"]))
            each = parts.select("node", F.inline(F.zip_with("parts", to_part, lambda c, x: _struct(part=c["part"], half=x))))
            nodes = nodes.join(each, ["node", "part"])
        else:
            nodes = nodes.withColumn("half", F.shiftright(F.col("n") + 1, 1))
        nodes = nodes.withColumn("left", shared(F.col("cells"), F.col("half"), lambda c: uniform(F.col("node"), c["source"], c["pass"])))

        def side(n, node: Column) -> Column:
            kept = F.zip_with("cells", "left", lambda c, x: _struct(place=c["place"], source=c["source"], **{"pass": c["pass"]}, n=n(c["n"], x)))
            return _struct(node=node, part=F.col("part"), cells=F.filter(kept, lambda c: c["n"] > 0))

        nodes = nodes.select(F.inline(F.array(side(lambda n, x: x, F.col("node") * 2), side(lambda n, x: n - x, F.col("node") * 2 + 1)))).where(F.size("cells") > 0)
        if rows > length or level % PLANNED_LEVELS == 0:
            nodes = materialize(nodes.repartition("node", "part"), "nodes")
    return nodes.select((F.col("node") - (1 << levels)).alias("shard"), F.inline("cells")).select("source", "pass", "shard", F.col("n").alias("quota"))


def draw_blocks(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(source, blocks, source_size, target) and (source, block, block_size, draws, part_pass, part_words); docs: (source, size, key).

    draws: (pass, shard) of each pass that takes the block; part_words: of pass part_pass, where that takes a part of it only.
    """
    sizes = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    sizes = materialize(sizes, "sizes")
    n_sources, total = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    targets = materialize(source_targets(sizes, n_sources), "targets")
    levels = max(LEAST_LEVELS, math.ceil(math.log2(max(1, total / SHARD_WORDS))))
    n_blocks = max(LEAST_BLOCKS, BLOCKS_A_SHARD << levels)
    shares = targets.withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") * n_blocks / max(1, total))).cast("long"))
    dealt = docs.join(broadcast_if(shares, n_sources, 128), docs["source"].eqNullSafe(shares["source"])).drop(shares["source"])
    blocks = dealt.groupBy("source", F.pmod("key", F.col("blocks")).alias("block")).agg(F.sum("size").alias("block_size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"))
    blocks = materialize(blocks, "blocks")
    most = MAX_PASSES * (n_blocks + 2 * n_sources)
    passes = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(MAX_PASSES - 1)))).withColumn("draw", _draw(seed, "pass", "pass", "source", "block"))
    # The permuted order of a source's blocks in a pass, and the words before each block in it.
    own = [F.col("source").asc_nulls_last(), F.col("pass")]
    permuted = ranked(passes, most, [*own, F.col("draw"), F.col("block")], ["block_size"], "passes")
    starts = permuted.groupBy("source", "pass").agg(F.min("before_block_size").alias("start")).withColumnsRenamed({"source": "s", "pass": "p"})
    begun = permuted.drop("place").join(broadcast_if(starts, MAX_PASSES * n_sources, 96), permuted["source"].eqNullSafe(starts["s"]) & (permuted["pass"] == starts["p"]))
    left = F.round("target").cast("long") - F.col("pass") * F.col("source_size") - (F.col("before_block_size") - F.col("start"))
    taken = begun.withColumn("words", F.greatest(F.lit(0).cast("long"), F.least("block_size", left))).where("words > 0 OR block_size = 0 AND pass = 0")
    taken = materialize(ranked(taken.select("source", "pass", "draw", "block", "block_size", "words"), most, [*own, F.col("draw"), F.col("block")], label="taken"), "drawn")
    # Each shard has a run of places in the order of a source and pass, as many as its quota: the blocks take them in their permuted order.
    quotas = shard_quotas(taken.groupBy("source", "pass").agg(F.count(F.lit(1)).alias("n")), MAX_PASSES * n_sources, levels, seed)
    runs = ranked(quotas, most, [*own, F.col("shard")], ["quota"], "quotas")
    places = runs.select("shard", F.explode(F.sequence(F.col("before_quota"), F.col("before_quota") + F.col("quota") - 1)).alias("place"))
    part = F.col("words") < F.col("block_size")
    handed = taken.join(places, "place").groupBy("source", "block").agg(
        F.first("block_size").alias("block_size"), F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"), F.max(F.when(part, F.col("pass"))).alias("part_pass"), F.max(F.when(part, F.col("words"))).alias("part_words")
    )
    return shares, materialize(handed, "shards")


def mix(docs: DataFrame, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple = ()) -> DataFrame:
    """id, source, size, source_size, target, draws for each row; draws: (pass, shard, position, words) of each pass that takes the document.

    words: what a pass takes of it, its whole size but for the one document of a source that straddles the target.
    keep: further columns of docs to carry along, under the names kept_<name>.
    """
    text = F.col(text_col)
    base = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.shiftrightunsigned(_draw(seed, "block", F.col(id_col), text), 1).alias("key"), *[F.col(k).alias(f"kept_{k}") for k in keep]
    )
    rows = materialize(base, "rows")
    slim = rows.select("source", "size", "key")
    shares, blocks = draw_blocks(slim, seed)
    n_sources, n_blocks = shares.count(), blocks.count()
    blocks = blocks.withColumnsRenamed({"source": "s", "block": "b"})
    held = [f"kept_{k}" for k in keep]

    def dealt(df: DataFrame) -> DataFrame:
        out = df.join(broadcast_if(shares, n_sources, 128), df["source"].eqNullSafe(shares["source"])).drop(shares["source"])
        out = out.withColumn("block", F.pmod("key", F.col("blocks"))).drop("blocks")
        return out.join(broadcast_if(blocks, n_blocks, 256), out["source"].eqNullSafe(blocks["s"]) & (out["block"] == blocks["b"]), "left").drop("s", "b", "block_size")

    # Of the blocks that are taken in part, the words before each sub-block in its block.
    sub = F.pmod(_draw(seed, "sub", "part_pass", "key"), F.lit(SUB_BLOCKS))
    parts = dealt(slim).where("part_pass IS NOT NULL").groupBy("source", "block", sub.alias("sub")).agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("source", "block").orderBy("sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    subs = parts.select(F.col("source").alias("s"), F.col("block").alias("b"), F.col("sub").alias("x"), before.alias("before_sub"))
    everything = dealt(rows)
    whole = everything.where("part_pass IS NULL").withColumn("part", F.lit(None).cast("long"))
    some = everything.where("part_pass IS NOT NULL").withColumn("sub", sub)
    some = some.join(subs, some["source"].eqNullSafe(subs["s"]) & (some["block"] == subs["b"]) & (some["sub"] == subs["x"]))
    local = W.partitionBy("source", "block", "sub").orderBy(_draw(seed, "local", "part_pass", "key"), "key", "id", "size")
    inside = F.coalesce(F.sum("size").over(local.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    some = some.withColumn("part", F.greatest(F.lit(0).cast("long"), F.least("size", F.col("part_words") - F.col("before_sub") - inside)))
    columns = ["id", "source", "size", "source_size", "target", "key", "draws", "part_pass", "part", *held]
    out = whole.select(*columns).union(some.select(*columns))
    draws = F.transform(
        F.coalesce("draws", F.array().cast("array<struct<pass:int,shard:bigint>>")),
        lambda d: F.struct(
            d["pass"].alias("pass"), d["shard"].alias("shard"), _draw(seed, "place", d["shard"], F.col("key"), d["pass"]).alias("position"),
            F.when(d["pass"].eqNullSafe(F.col("part_pass")), F.col("part")).otherwise(F.col("size")).alias("words"),
        ),
    )
    return out.select("id", "source", "size", "source_size", "target", draws.alias("draws"), *held)


def op10_mixing(spark, sf_dir):
    m = mix(table(spark, sf_dir, "documents"))
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"])
    return m.select(F.col("id").alias("doc_id"), "size", "source_size", "target", taken.alias("taken"), "draws")
