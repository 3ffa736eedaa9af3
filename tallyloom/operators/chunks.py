"""Search chunks: texts of bounded length under a heading, from headers, labels and notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_label
from ..sources.staging import shuffled, written

# Fixed value: characters of a chunk.
LENGTH = 800


def pack_labels(labels: Column, room: Column | int = LENGTH, glue: str = " | ") -> Column:
    """Greedy: labels in order, a new piece where the next label would not fit. A longer label is a piece of its own."""
    room = F.lit(room) if isinstance(room, int) else room
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(s, x):
        fits = (s["open"] == "") | (F.length(s["open"]) + len(glue) + F.length(x) <= room)
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"), F.when(fits & (s["open"] != ""), F.concat(s["open"], F.lit(glue), x)).otherwise(x).alias("open"))

    return F.aggregate(labels, start, step, lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))))


def unique_labels(labels: Column) -> Column:
    """Labels that hold a letter, without regard to case once each, in the order in which they come first."""
    clean = F.filter(F.transform(labels, clean_label), lambda x: x.rlike("[A-Za-z가-힣]"))
    low = F.transform(clean, lambda x: F.lower(x))
    return F.filter(clean, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def chunks(rows: DataFrame, key: str, heading: str, kind: str, labels: str, length: int = LENGTH) -> DataFrame:
    """key, chunk_kind, chunk_no, search_text for each piece, its heading in front."""
    head = clean_label(F.col(heading))
    pieces = pack_labels(unique_labels(F.col(labels)), F.greatest(F.lit(1), F.lit(length) - F.length(head) - 1))
    out = rows.select(key, head.alias("_h"), F.posexplode(pieces).alias("chunk_no", "_t"))
    return out.select(key, F.lit(kind).alias("chunk_kind"), "chunk_no", F.concat_ws(" ", F.nullif("_h", F.lit("")), "_t").alias("search_text"))


def changed_chunks(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New chunks whose text is not there yet."""
    return new.join(old.select(*keys, "search_text"), [*keys, "search_text"], "left_anti")


def in_order(rows: DataFrame, key: str, place: str) -> DataFrame:
    """A written table of rows with pos: 0, 1, … under each key in the order of place. Keys may fill any number of ranges: places are counted in each range, and ranges are added up."""
    ranged = rows.repartitionByRange(key, place).sortWithinPartitions(key, place)
    table = written(ranged.withColumn("_g", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_g", 33))
    parts = table.groupBy(key, "_part").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(key).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return table.join(parts.withColumn("_before", before).drop("_n"), [key, "_part"]).withColumn("pos", F.col("_g") - F.col("_first") + F.col("_before")).drop("_g", "_first", "_before")


def pack_rows(labels: DataFrame, key: str, place: str, label: str, room: str, glue: str = " | ") -> DataFrame:
    """key, chunk_no, text: the same pieces as pack_labels', for labels that are rows, however many a key has. room: a column, the same for all rows of a key.

    Running lengths say where the piece that would start at each label ends; that is at most a room's length away, so it is looked up in the two
    stretches of that length around it. Then pointers double: the starts known so far jump by ever longer pointers, and the
    last of log2(pieces) rounds has found all starts. Each round is a written table. Labels that are null or empty are left out.
    """
    width = F.length("label") + len(glue)
    ordered = in_order(labels.where(F.coalesce(F.col(label), F.lit("")) != "").select(F.col(key).alias("key"), F.col(place).alias("place"), F.col(label).alias("label"), F.greatest(F.col(room), F.lit(1)).cast("long").alias("room")), "key", "place")
    local = F.sum(width).over(W.partitionBy("key", "_part").orderBy("pos"))
    sums = ordered.withColumn("upto", local)
    parts = sums.groupBy("key", "_part").agg(F.max("upto").alias("all"))
    before = F.coalesce(F.sum("all").over(W.partitionBy("key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sums = sums.join(parts.withColumn("base", before).drop("all"), ["key", "_part"])
    # A piece from i to j is as long as the end of j less the start of i.
    end = F.col("base") + F.col("upto") - len(glue)
    sums = written(sums.select("key", "pos", "label", "room", end.alias("end"), (end + len(glue) - width).alias("start")), "sums")
    ends = sums.groupBy("key", F.expr("end div room").alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("end", "pos"))).alias("ends"))
    asked = sums.select("key", "pos", (F.col("start") + F.col("room")).alias("most"), F.explode(F.array(F.expr("(start + room) div room"), F.expr("(start + room) div room - 1"))).alias("stretch"))
    fits = F.array_max(F.transform(F.filter("ends", lambda e: e["end"] <= F.col("most")), lambda e: e["pos"]))
    after = asked.join(shuffled(ends), ["key", "stretch"], "left").groupBy("key", "pos").agg((F.greatest(F.max(fits), F.col("pos")) + 1).alias("next"))
    jumps = written(after, "jumps")
    marks, pointers = written(jumps.where("pos = 0").select("key", "pos"), "marks"), jumps
    while True:
        reached = marks.join(shuffled(pointers), ["key", "pos"]).join(shuffled(jumps.select("key", F.col("pos").alias("next"))), ["key", "next"], "left_semi").select("key", F.col("next").alias("pos"))
        more = written(marks.union(reached).distinct(), "marks")
        if more.count() == marks.count():
            break
        onward = pointers.select("key", F.col("pos").alias("next"), F.col("next").alias("beyond"))
        pointers = written(pointers.join(shuffled(onward), ["key", "next"]).select("key", "pos", F.col("beyond").alias("next")), "pointers")
        marks = more
    starts = in_order(marks.withColumnRenamed("pos", "place"), "key", "place").select("key", F.col("place").alias("from"), F.col("pos").cast("int").alias("chunk_no"))
    spans = starts.join(shuffled(jumps.withColumnRenamed("pos", "from")), ["key", "from"]).select("key", "chunk_no", F.explode(F.sequence("from", F.col("next") - 1)).alias("pos"))
    pieces = spans.join(shuffled(sums.select("key", "pos", "label")), ["key", "pos"]).groupBy("key", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("pos", "label"))).alias("x"))
    return pieces.select(F.col("key").alias(key), "chunk_no", F.array_join(F.transform("x", lambda p: p["label"]), glue).alias("text"))


def unique_rows(labels: DataFrame, key: str, place: str, label: str) -> DataFrame:
    """The same labels as unique_labels', for labels that are rows: those that hold a letter, of equal ones without regard to case the first."""
    clean = labels.withColumn(label, clean_label(F.col(label))).where(F.col(label).rlike("[A-Za-z가-힣]"))
    first = clean.groupBy(key, F.lower(label).alias("_low")).agg(F.min_by(label, place).alias(label), F.min(place).alias(place))
    return first.drop("_low")
