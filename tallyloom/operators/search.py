"""Hybrid search: vector and word retrieval, fused by weighted reciprocal ranks."""

from __future__ import annotations

import re
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import edition_rank
from ..functions.text import match_key, once, text_tokens
from ..functions.vectors import cosine_distance
from .blocks import nearest_in_block

# The constant of reciprocal ranks, weights of the ways to find something, and additions for labels.
RRF_K = 10
WEIGHTS = {"title": 1.0, "table_vector": 1.8, "table_lexical": 3.0, "note_vector": 1.0, "note_lexical": 1.2}
PRIORITIES = {"title": 1, "note": 2, "vector_column": 3, "vector_row": 2, "lexical": 4, "lexical_exact_column": 5}
EXACT_BONUS, TOKEN_BONUS = 0.05, 0.04
#: Rows and queries that meet in one block, about.
ROW_BLOCK, QUERY_BLOCK = 32_768, 2_048


def pool_size(limit: int) -> int:
    return max(20, 5 * limit)


def latest_editions(rows: DataFrame, kind: str = "publication_kind", title: str = "title_ko", item: str = "stat_id", rank: Column | None = None) -> DataFrame:
    """Rows of the newest edition that carries their title; ties all stay. To be taken before any filter by year."""
    rank = edition_rank(F.col("year"), F.col("period")) if rank is None else rank
    key = F.coalesce(match_key(F.col(title)), F.concat(F.lit("#"), F.col(item).cast("string")))
    ranked = rows.withColumn("_rank", rank).withColumn("_newest", F.max("_rank").over(W.partitionBy(kind, key)))
    return ranked.where("_rank = _newest").drop("_rank", "_newest")


def with_flag(rows: DataFrame, others: DataFrame, key: str, flag: str) -> DataFrame:
    """rows with whether others have a row of their key."""
    there = others.select(F.col(key).alias("_k")).distinct()
    return rows.join(there, F.col(key) == F.col("_k"), "left").withColumn(flag, F.col("_k").isNotNull()).drop("_k")


def nearest(rows: DataFrame, query: Column, k: int, vector: str = "embedding", ties: tuple = (), decimals: int | None = None) -> DataFrame:
    """The k rows of least cosine distance, exactly: a top-k in every task, then of these. decimals: distances that are equal when rounded are ties."""
    distance = cosine_distance(F.col(vector), query)
    distance = distance if decimals is None else F.round(distance, decimals) + F.lit(0.0)
    near = rows.where(F.col(vector).isNotNull()).withColumn("distance", distance)
    return near.orderBy(F.col("distance").asc_nulls_last(), *ties).limit(k)


def nearest_each(rows: DataFrame, queries: DataFrame, item: str, k: int, vector: str = "embedding") -> DataFrame:
    """query_id, item, distance: for each of queries (query_id, q) the k rows of least cosine distance, exactly: block against block, a top-k of each query in every block, then of these."""
    near = nearest_in_groups(rows.select(F.lit(0).alias("group"), F.col(item).alias("item"), F.col(vector).alias("vector")), queries.select(F.lit(0).alias("group"), "query_id", "q"), k)
    return near.withColumnRenamed("item", item)


def nearest_in_groups(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, item, distance: the k nearest of the rows (group, item, vector) of each query's groups (group, query_id, q), by cosine distance to 6 decimals, then by item.

    Groups are cut into blocks of about ROW_BLOCK rows and QUERY_BLOCK queries; each pair of blocks is one small product of matrices (`blocks.nearest_in_block`).
    Groups are few: cells of an index, or one.
    """
    rows = rows.where(F.col("vector").isNotNull())
    n_rows, n_queries = rows.groupBy("group").agg(F.count(F.lit(1)).alias("_r")), queries.groupBy("group").agg(F.count(F.lit(1)).alias("_q"))
    cut = lambda n, size: F.ceil(F.col(n) / size).cast("int")
    sizes = n_rows.join(n_queries, "group").select("group", cut("_r", ROW_BLOCK).alias("_r"), cut("_q", QUERY_BLOCK).alias("_q"))
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = rows.join(F.broadcast(sizes), "group").select("group", F.pmod(F.xxhash64("item", "vector"), "_r").cast("int").alias("row_block"), others("_q").alias("query_block"), "item", "vector")
    right = queries.join(F.broadcast(sizes), "group").select("group", others("_r").alias("row_block"), F.pmod(F.xxhash64("query_id", "q"), "_q").cast("int").alias("query_block"), "query_id", "q")
    keys, kinds = ["group", "row_block", "query_block"], dict(left.dtypes) | dict(right.dtypes)
    schema = f"query_id {kinds['query_id']}, item {kinds['item']}, distance double"
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(partial(nearest_in_block, k=k), schema)
    order = W.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "item")
    return found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).drop("_n")


def _times(tokens: Column, word: str) -> Column:
    return F.size(F.filter(tokens, lambda t: t == word))


def word_score(text: Column, words: list[str]) -> Column:
    """How often the words occur, if all of them do; a stand-in for cover density that other engines can compute."""
    if not words:
        return F.lit(None).cast("int")

    def of(counts: Column) -> Column:
        return F.when(F.forall(counts, lambda n: n > 0), F.aggregate(counts, F.lit(0), lambda a, n: a + n))

    return once(once(text_tokens(text), lambda t: F.array(*[_times(t, w.lower()) for w in words])), of)


def cover_density(text: Column, words: list[str]) -> Column:
    """Sum over the shortest stretches that hold all words of 0.1 over their length in words."""
    want = [w.lower() for w in words]
    place = F.transform(text_tokens(text), lambda t, i: F.struct(i.alias("i"), t.alias("t")))
    return density_of_hits(F.filter(place, lambda p: p["t"].isin(*want)), want)


def density_of_hits(hits: Column, want: list[str]) -> Column:
    """Cover density from the places (i, t) of the wanted words, in ascending order."""
    start = F.struct(F.array(*[F.lit(-1)] * len(want)).alias("last"), F.lit(-1).alias("begin"), F.lit(0.0).alias("score"))

    def step(s, p):
        last = F.array(*[F.when(p["t"] == w, p["i"]).otherwise(F.get(s["last"], F.lit(k))) for k, w in enumerate(want)])
        begin = F.array_min(last)
        # A stretch that begins further on than the last one is a new shortest one.
        new = (begin >= 0) & (begin > s["begin"])
        return F.struct(last.alias("last"), F.when(new, begin).otherwise(s["begin"]).alias("begin"), (s["score"] + F.when(new, 0.1 / (p["i"] - begin + 1)).otherwise(0.0)).alias("score"))

    return F.aggregate(hits, start, step, lambda s: s["score"])


def by_words(rows: DataFrame, text: str, words: list[str], k: int, ties: tuple = (), score=word_score) -> DataFrame:
    # The score is made and tested in one step, so that texts are split once.
    kept = F.filter(F.array(score(F.col(text), words)), lambda s: s > 0)
    found = rows.select("*", F.explode(kept).alias("score"))
    return found.orderBy(F.col("score").desc(), *ties).limit(k)


def compact(c: Column) -> Column:
    """Lower case without blanks and joining marks, to look for words in labels."""
    return F.regexp_replace(F.lower(c), r"(?U)[\s·･_/-]+", "")


def best_label(labels: Column, words: list[str]) -> Column:
    """(label, exact, coverage): the first label that holds the words as they stand, else that which holds most of them, of equal ones the longest, then the first."""
    if not words:
        first = F.try_element_at(labels, F.lit(1))
        return F.when(F.size(labels) > 0, F.struct(first.alias("label"), F.lit(False).alias("exact"), F.lit(0.0).alias("coverage")))
    phrase = " ".join(words).lower()
    small = [re.sub(r"[\s·･_/-]+", "", w.lower()) for w in words]

    def held(label: Column) -> Column:
        return once(compact(label), lambda x: sum((x.contains(w).cast("int") for w in small[1:]), x.contains(small[0]).cast("int")))

    def ranked(label: Column, i: Column) -> Column:
        whole = F.lower(label).contains(phrase)
        n = F.when(whole, len(small)).otherwise(held(label))
        return F.struct(whole.alias("whole"), F.when(whole, -i).otherwise(n).alias("first"), F.length(label).alias("length"), (-i).alias("at"), n.alias("n"), label.alias("label"))

    def given(best: Column) -> Column:
        return F.when(best.isNotNull(), F.struct(best["label"].alias("label"), (best["n"] == len(small)).alias("exact"), (best["n"] / float(len(small))).alias("coverage")))

    return once(F.array_max(F.transform(labels, ranked)), given)


def coverage(label: Column, words: list[str]) -> Column:
    """The share of the words that a label contains."""
    n = sum((F.lower(label).contains(w.lower()).cast("int") for w in words), F.lit(0))
    return n / float(max(1, len(words)))


def contributions(found: DataFrame, path: str, order: list[Column], item: str = "stat_id", bonus: Column | None = None) -> DataFrame:
    """item, path, rank, gain for one way to find something. found is bounded by the pool's size."""
    ranked = found.withColumn("rank", F.row_number().over(W.orderBy(*order)))
    gain = WEIGHTS[path] / (RRF_K + F.col("rank")) + (F.lit(0.0) if bonus is None else bonus)
    return ranked.select(item, F.lit(path).alias("path"), "rank", gain.alias("gain"))


def fuse(parts: list[DataFrame], item: str = "stat_id") -> DataFrame:
    """item, score: of each way the best gain, summed."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    best = rows.groupBy(item, "path").agg(F.max("gain").alias("gain"))
    # Summed in a fixed order, so that reruns agree to the last bit.
    return best.groupBy(item).agg(F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("path", "gain"))), lambda s: s["gain"]), F.lit(0.0), lambda a, x: a + x).alias("score"))


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """The best row of each key, best first."""
    ranked = rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
    return ranked.orderBy(*order).limit(limit)


def best_source(rows: DataFrame, item: str = "stat_id") -> DataFrame:
    """Of each item the row of highest priority; of equal ones the first by way and rank."""
    order = W.partitionBy(item).orderBy(F.col("priority").desc(), F.col("way" if "way" in rows.columns else "path"), F.col("rank"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def interleave(lists: list[DataFrame], order: list[Column], limit: int) -> DataFrame:
    """First rows of all lists, then second ones, ...; lists are bounded by the limit."""
    out = None
    for k, rows in enumerate(lists):
        one = rows.withColumn("position", F.row_number().over(W.orderBy(*order))).withColumn("list_no", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out.orderBy("position", *order, "list_no").limit(limit * len(lists))
