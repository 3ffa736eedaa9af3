"""Queries over whole tables against brute force."""

from tallyloom.plans.queries import QUERIES


def test_chunk_labels_of_all_customers(spark, tmp_path):
    # So many that a key takes several chunks.
    many = [(i, f"Customer#{i:09d}", i % 3, "AUTO" if i % 2 else "BUILD") for i in range(600)]
    spark.createDataFrame(many, "c_custkey long, c_name string, c_nationkey int, c_mktsegment string").repartition(3).write.parquet(f"{tmp_path}/customer.parquet")
    want = {}
    for segment, nation in {(r[3], r[2]) for r in many}:
        pieces = []
        for name in (r[1] for r in many if (r[3], r[2]) == (segment, nation)):
            if pieces and len(pieces[-1]) + 3 + len(name) <= 800 - len(segment) - 1:
                pieces[-1] += " | " + name
            else:
                pieces.append(name)
        want |= {(f"{segment} {nation} 0", k): f"{segment} {p}" for k, p in enumerate(pieces)}
    got = {(r["key"], r["chunk_no"]): r["search_text"] for r in QUERIES["chunk_labels_all"](spark, str(tmp_path)).collect()}
    assert got == want and max(k for _, k in got) > 1
