"""The trie against a brute-force version: nulls, ties, repeats, copies, collisions of fingerprints, long conversations."""

import collections
import hashlib
import random
import re
import zlib

from pyspark.sql import functions as F

from tallyloom.llm import conversation_trie as ct
from tallyloom.llm.common import materialize

SCHEMA = "conv_id long, turn long, role string, text string, n long, depth string, g string, print long"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, t in turns.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c >= 0 else -1)
        built[c] = turns.get(base, [])[:h] + t[h:]
    members = collections.defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[tuple(built[c][:d])].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(m) - 1) * words
    digest = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if len(built[c]) == len(p)).encode()).hexdigest()
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p], digest(p)) for p, m in members.items())


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(3)
    return sorted(tuple(-1 if v is None else v for v in r) for r in ct.trie(df).select(*NAMES).collect())


def make(seed, n=60, long=0):
    rnd = random.Random(seed)
    say = [("user", "hello there"), ("assistant", "hi\t you  all"), ("system", "be kind"), ("user", ""), (None, "x"), ("user", None), ("user", "été 日本")]
    rows = []
    for c in [*range(n), -3, -20, 10**12, 10**12 + 7]:
        if c % 17 == 4:
            continue
        for turn in range(rnd.choice([1, 2, 3, 5, 8])):
            role, text = rnd.choice(say[: 2 + c % 6])
            rows.append((c, None if rnd.random() < 0.05 else turn // (1 + c % 2), role, text))
    rows += [(41, 1, "user", "again")] * 3 + [(None, 1, "user", "nobody's")]
    rows += [(1000 + k, t, "user", f"copy {t}") for k in range(40) for t in range(4)]
    rows += [(2000 + k, t, "user", str(t % 3)) for k in range(3) for t in range(long)]
    return rows


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = make(seed)
        assert result(spark, rows) == brute(rows)


def test_collisions_are_split(spark, monkeypatch):
    monkeypatch.setattr(ct, "turn_hash", lambda seed, *columns: F.pmod(F.xxhash64(*columns), F.lit(2)))
    monkeypatch.setattr(ct, "BASES", (1, 1))
    rows = make(3, n=30)
    assert result(spark, rows) == brute(rows)


def test_long_conversations_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(ct, "STRETCH", 7)
    monkeypatch.setattr(ct, "BLOCK", 3)
    rows = make(4, n=12, long=80)
    assert result(spark, rows) == brute(rows)


def test_numbers_over_many_ranges(spark):
    """One conversation, and one turn of it, in most rows."""
    rows = [(7, 1 if k % 3 else k, "user", f"t{k % 5}") for k in range(500)] + [(8, k, "user", "b") for k in range(9)] + [(0, 0, "system", "s")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(spark, rows) == brute(rows)
        turns = ct.number_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert turns.where("conv = 7").select(F.shiftright("g", 33)).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_empty_and_turnless(spark):
    assert result(spark, []) == []
    only = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(only, 0, "user", "one"), (only, 1, "user", "two")]
    assert result(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_long_text(spark):
    rows = [(c, t, "user", ("word " * 200_000) + str(c // 2 if t else 0)) for c in (20, 40, 41) for t in range(4)]
    assert result(spark, rows) == brute(rows)


def test_powers_and_sums(spark):
    rows = spark.createDataFrame([(c, d, d * 3) for c in (1, 2) for d in range(1, 40)], "conv long, depth long, v long")
    out = ct.running_sums(materialize(rows, "rows"), ["v"], rolling=True).collect()
    for r in out:
        assert r["s0"] == sum(k * 3 * pow(ct.BASES[0], k, ct.PRIME) for k in range(1, r["depth"] + 1)) % ct.PRIME
        assert (r["e0"] + r["v"] * pow(ct.BASES[0], r["depth"], ct.PRIME)) % ct.PRIME == r["s0"]


