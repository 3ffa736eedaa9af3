"""A positional inverted index: postings of words, written at load in ranges of words, so that a search reads those of its words alone."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import text_tokens
from ..sources.staging import written
from .search import density_of_hits

#: Bytes of a posting, about; lists of at most SMALL bytes go to all tasks.
POSTING_BYTES, SMALL = 64, 16 << 20
#: Words whose places are gathered at once in a task, if they aren't of one text, and items of a row of postings, at most.
AT_ONCE, ITEMS = 1 << 20, 128


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    changed = np.zeros(len(keys[0]), bool)
    changed[:1] = True
    for k in keys:
        changed[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(changed)


def _gathered(items: pa.Array, lengths: np.ndarray, tokens: pa.Array) -> pa.RecordBatch:
    """word, items, positions: of texts, as their numbers of words and all their words, one row for each word and ITEMS of its items."""
    coded = tokens.dictionary_encode()
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    code, text = codes[order], np.repeat(np.arange(len(lengths)), lengths)[order]
    each = _starts(code, text)  # a word in a text
    of_word = _starts(code[each])
    number = np.arange(len(each)) - np.repeat(of_word, np.diff(np.r_[of_word, len(each)]))
    rows = np.flatnonzero(number % ITEMS == 0)
    listed = lambda at, n, values: pa.ListArray.from_arrays(pa.array(np.r_[at, n], pa.int32()), values)
    positions = listed(each, len(order), pa.array(place[order], pa.int32()))
    columns = [coded.dictionary.take(pa.array(code[each[rows]])), listed(rows, len(each), items.take(pa.array(text[each]))), listed(rows, len(each), positions)]
    return pa.RecordBatch.from_arrays(columns, names=["word", "items", "positions"])


def _gather(batches):
    """Rows of _gathered from batches of items and their words."""
    for batch in batches:
        items, lists = batch.columns
        lengths, tokens = pc.list_value_length(lists).to_numpy(zero_copy_only=False), lists.flatten()
        ends = np.cumsum(lengths)
        cuts = np.r_[_starts(ends // AT_ONCE), len(lengths)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            begin = ends[a] - lengths[a]
            if ends[b - 1] > begin:
                yield _gathered(items.slice(a, b - a), lengths[a:b], tokens.slice(begin, ends[b - 1] - begin))


def build(rows: DataFrame, item: str, text: str, path: str, ranges: int | None = None) -> None:
    """Write path/postings (word, items, positions: for each item the word's places in the text, from 0) and path/words (word, n_items).

    The places of a word are gathered where the texts are read, so that few rows are shuffled, ITEMS items in one at most. They are dealt by ranges of
    word and first item, so that a word that is everywhere fills several ranges, and sorted in each, so that a file's statistics tell which words it has.
    Null and empty texts have none. An item that comes in several rows has the places of all of them.
    """
    texts = rows.select(F.col(item).alias("item"), text_tokens(F.col(text)).alias("tokens"))
    kind = texts.schema["item"].dataType.simpleString()
    # Ranges are found by a pass over what they cut: written, so that texts are split once.
    gathered = written(texts.mapInArrow(_gather, f"word string, items array<{kind}>, positions array<array<int>>"), "gathered")
    order = ["word", F.get("items", F.lit(0))]
    dealt = gathered.repartitionByRange(ranges, *order) if ranges else gathered.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.option("parquet.block.size", 8 << 20).parquet(f"{path}/postings")
    if rows.groupBy(item).count().where("count > 1").isEmpty():
        counts = gathered.groupBy("word").agg(F.sum(F.size("items")).alias("n_items"))
    else:
        counts = gathered.select("word", F.explode("items").alias("item")).distinct().groupBy("word").agg(F.count(F.lit(1)).alias("n_items"))
    counts.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{path}/words")


def postings(spark: SparkSession, path: str, word: str) -> DataFrame:
    """item, positions of a word; an item that came in several rows may have several here too."""
    found = spark.read.parquet(f"{path}/postings").where(F.col("word") == word)
    return found.select(F.explode(F.arrays_zip("items", "positions")).alias("p")).select(F.col("p.items").alias("item"), "p.positions")


def containing(spark: SparkSession, path: str, words: list[str]) -> DataFrame:
    """item, hits: places (i, t) in ascending order, of the items that have all the words.

    The rarest word's postings are read first, and each further word's are met by what is left: a broadcast, where the counts of the index say that
    the rarest are few. What was met is shuffled by item: a word may lie in one file. A word that the index has not leaves nothing.
    """
    want = list(dict.fromkeys(w.lower() for w in words))
    if not want:
        return spark.createDataFrame([], "item long, hits array<struct<i:int,t:string>>")
    known = spark.read.parquet(f"{path}/words").where(F.col("word").isin(*want))
    counts = {r["word"]: r["n_items"] for r in known.collect()}  # a row for each word of the request
    order = sorted(want, key=lambda w: (counts.get(w, 0), w))
    few = counts.get(order[0], 0) * POSTING_BYTES <= SMALL
    placed = lambda w: F.flatten(F.collect_list(F.transform("positions", lambda p: F.struct(p.alias("i"), F.lit(w).alias("t")))))
    left = postings(spark, path, order[0]).groupBy("item").agg(placed(order[0]).alias("hits"))
    for w in order[1:]:
        met = postings(spark, path, w).join(F.broadcast(left) if few else left, "item")
        left = met.groupBy("item").agg(placed(w).alias("more"), F.first("hits").alias("hits")).select("item", F.concat("hits", "more").alias("hits"))
    return left.select("item", F.array_sort("hits").alias("hits"))


def ranked(spark: SparkSession, path: str, words: list[str], k: int) -> DataFrame:
    """item, score, n_hits of the k items of greatest cover density, of equal ones the least item."""
    want = list(dict.fromkeys(w.lower() for w in words))
    found = containing(spark, path, want).select("item", density_of_hits(F.col("hits"), want).alias("score"), F.size("hits").alias("n_hits"))
    return found.orderBy(F.round("score", 9).desc(), "item").limit(k)
