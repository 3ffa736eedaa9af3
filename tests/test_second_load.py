"""Loads over loads, and jobs' states that survive a restart."""

import json

import pytest
from pyspark.sql import functions as F

from tallyloom.sources.upsert import CHUNK_TEXT, upsert
from tallyloom.streaming import progress


def stats(spark, rows):
    df = spark.createDataFrame(rows, "stat_id long, ref_id string, period string, title_ko string, unit string")
    return df.withColumns({"chapter": F.lit("c"), **{c: F.lit(None).cast("string") for c in ("title_en", "section", "level3_title", "level4_title")}})


def test_upsert(spark):
    old = stats(spark, [(5, "a", None, "one", "u"), (7, "b", None, "two", "u"), (9, "c", "H1", None, "u")])
    old = old.withColumns({"embedding": F.array(F.col("stat_id").cast("float")), "embedding_profile_key": F.lit("p"), "search_doc": F.array(F.lit("old"))})
    new = stats(spark, [(None, "a", None, "one", "other unit"), (None, "b", None, "Two more", "u"), (None, "c", "H1", "", "u"), (None, "z", None, "x", "u"), (None, "c", "H2", None, "u")])
    got = {(r["ref_id"], r["period"]): r for r in upsert(old, new, ["ref_id", "period"], "stat_id").collect()}
    assert {k: (r["stat_id"], r["change"]) for k, r in got.items()} == {("a", None): (5, "unchanged"), ("b", None): (7, "changed"), ("c", "H1"): (9, "changed"), ("c", "H2"): (10, "inserted"), ("z", None): (11, "inserted")}
    assert got["a", None]["embedding"] == [5.0] and got["a", None]["search_doc"] == ["old"] and got["a", None]["unit"] == "other unit"
    assert got["b", None]["embedding"] is None and got["b", None]["embedding_profile_key"] is None and got["b", None]["search_doc"] == ["c", "more", "two", "u"]
    again = upsert(old, new.where("ref_id = 'a'"), ["ref_id", "period"], "stat_id")
    assert sorted((r["stat_id"], r["change"]) for r in again.collect()) == [(5, "unchanged"), (7, "kept"), (9, "kept")]
    assert upsert(old, new.where("ref_id = 'a'"), ["ref_id", "period"], "stat_id", keep_missing=False).count() == 1
    assert upsert(old.limit(0), new, ["ref_id", "period"], "stat_id").agg(F.max("stat_id")).first()[0] == 5
    with pytest.raises(ValueError):
        upsert(old, new.union(new), ["ref_id", "period"], "stat_id")


def test_upsert_of_chunks(spark):
    schema = "chunk_id long, stat_id long, chunk_no int, search_text string, embedding array<float>, embedding_profile_key string"
    old = spark.createDataFrame([(1, 1, 0, "a", [1.0], "p"), (2, 1, 1, "b", [2.0], "p")], schema)
    new = spark.createDataFrame([(None, 1, 0, "a", None, None), (None, 1, 1, "B", None, None), (None, 2, 0, "c", None, None)], schema)
    got = {r["chunk_id"]: (r["change"], r["embedding"]) for r in upsert(old, new, ["stat_id", "chunk_no"], "chunk_id", CHUNK_TEXT, CHUNK_TEXT).collect()}
    assert got == {1: ("unchanged", [1.0]), 2: ("changed", None), 3: ("inserted", None)}


def put(folder, name, events):
    rows = [{"event_id": i, "job_id": j, "status": s, "stage": "x", "progress": i, "message": "m", "created_at": f"2024-01-01T00:00:{i:02d}Z"} for i, j, s in events]
    (folder / name).write_text("\n".join(map(json.dumps, rows)))


def test_states_survive_a_restart(spark, tmp_path):
    source, path, check = tmp_path / "in", str(tmp_path / "jobs"), str(tmp_path / "check")
    source.mkdir()

    def drain():
        q = progress.keep_states(spark, str(source), path, check)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    state = lambda: {r["job_id"]: (r["event_id"], r["status"], r["n_events"], r["n_ignored"]) for r in progress.states(spark, path).collect()}
    put(source, "a.json", [(1, "j", "queued"), (2, "j", "running"), (2, "j", "running"), (3, "k", "queued")])
    drain()
    assert state() == {"j": (2, "running", 2, 1), "k": (3, "queued", 1, 0)}
    # The stream is started anew; a late event, one that is there already, an end, and one after the end.
    put(source, "b.json", [(1, "j", "queued"), (4, "j", "failed"), (5, "j", "running"), (6, "l", "queued")])
    drain()
    assert state() == {"j": (4, "failed", 3, 3), "k": (3, "queued", 1, 0), "l": (6, "queued", 1, 0)}
    # A batch that was broken off is done again from the versions before it.
    last = progress._versions(spark, path)[-1]
    (tmp_path / "jobs" / f"v={last}" / "_SUCCESS").unlink()
    assert state() == {"j": (2, "running", 2, 1), "k": (3, "queued", 1, 0)}
    for name in (str(last), f".{last}.crc"):
        (tmp_path / "check" / "commits" / name).unlink()
    drain()
    assert state()["j"] == (4, "failed", 3, 3) and progress._versions(spark, path)[-1] == last
    put(source, "c.json", [(7, "j", "running")])
    drain()
    assert state()["j"] == (4, "failed", 3, 4)
    assert [r["job_id"] for r in progress.newest(progress.states(spark, path), 2).collect()] == ["l", "j"]
