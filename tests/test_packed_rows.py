"""Labels as rows against the fold over one array."""

import random

from pyspark.sql import functions as F

from tallyloom.operators import chunks


def test_packed_rows_are_the_folds_pieces(spark):
    rnd = random.Random(5)
    rows = []
    for key, n, room in (("a", 0, 20), ("b", 1, 20), ("c", 70, 20), ("d", 300, 9), ("e", 40, 500), ("f", 30, 1)):
        rows += [(key, 3 * i, rnd.choice(["x", "yy", "Z" * 12, "w" * 40, "été", "", None, "label %d" % i]), room) for i in range(n)]
    df = spark.createDataFrame(rows, "key string, place long, label string, room int").repartition(3)
    arrays = df.where("label <> ''").groupBy("key", "room").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]).alias("l"))
    want = arrays.select("key", F.posexplode(chunks.pack_labels(F.col("l"), F.col("room"))).alias("chunk_no", "text"))
    assert sorted(map(tuple, chunks.pack_rows(df, "key", "place", "label", "room").collect())) == sorted(map(tuple, want.collect()))


def test_one_key_with_many_labels(spark):
    rows = spark.range(200_000).select(F.lit("k").alias("key"), "id", F.concat(F.lit("label "), "id").alias("label"), F.lit(800).alias("room"))
    out = chunks.pack_rows(rows, "key", "id", "label", "room").orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in out] == list(range(len(out)))
    assert " | ".join(r["text"] for r in out) == " | ".join(f"label {i}" for i in range(200_000))
    assert all(len(r["text"]) <= 800 for r in out) and all(len(a["text"]) + 3 + len(b["text"].split(" | ")[0]) > 800 for a, b in zip(out, out[1:]))


def test_unique_rows(spark):
    rows = [("k", 3, "Ab"), ("k", 1, " aB "), ("k", 2, "12"), ("k", 4, None), ("j", 1, "AB")]
    got = chunks.unique_rows(spark.createDataFrame(rows, "key string, place int, label string"), "key", "place", "label").collect()
    assert sorted((r["key"], r["place"], r["label"]) for r in got) == [("j", 1, "AB"), ("k", 1, "aB")]
