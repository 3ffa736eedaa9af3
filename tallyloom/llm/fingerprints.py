"""Document fingerprints by consistent weighted sampling. DataFrame functions only.

The terms of a text are its words, weighted by how often they occur. For each of SAMPLES
places of the signature every term draws r and c from a gamma distribution of shape 2 and b
uniformly, all from hashes of the term; t = floor(ln(weight) / r + b) and
ln a = ln c - r (t - b + 1). The term of least a, with its t, is the sample. Two texts have
equal samples at a place with a probability that is their generalised Jaccard similarity,
the sum of the lesser weights over the sum of the greater ones; the share of equal places estimates it.

Neighbours in order of ids are found without sorting everything in one place: ids are
split into buckets at quantiles, an id that fills several by a hash of its texts too, and the first document of every bucket goes as a guest to the
bucket before it. Terms are counted and samples drawn where the bucket's texts lie: the texts are
shuffled once.

Null text is empty. A text without words has the fingerprint of no terms, which equals
only itself. Rows that share an id follow one another by text, or by its hash where an id fills several buckets; a null id comes last.
Rows that repeat altogether share a bucket. The last
document's next one is the first, which may be itself. An empty table gives an empty result. Texts may be of any length. Other
columns, whatever their names, have no effect.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

SAMPLES = 32
#: Documents in a bucket, as long as FANOUT * FANOUT buckets hold all; beyond that buckets grow. What comes to the driver is one id for each.
BUCKET, FANOUT = 256, 256
LOWEST = -(1 << 63)


def _unit(h: Column, low: int, bits: int) -> Column:
    """A number between 0 and 1 from some bits of a hash."""
    return (F.shiftrightunsigned(h, low).bitwiseAND(F.lit((1 << bits) - 1)).cast("double") + 0.5) * (2.0**-bits)


def sample(h: Column, weights: list[Column], k: int) -> list[Column]:
    """For each of the logarithmic weights, ln a in order-preserving steps above 32 bits of the sample's identity."""
    one, two = F.xxhash64(h, F.lit(2 * k)), F.xxhash64(h, F.lit(2 * k + 1))
    r = -F.ln(_unit(one, 0, 24) * _unit(one, 24, 24))
    c = F.ln(-F.ln(_unit(two, 0, 24) * _unit(two, 24, 24)))
    b = _unit(one, 48, 16)
    out = []
    for w in weights:
        t = F.floor(w / r + b)
        steps = ((c - r * (t - b + 1) + 1000.0) * 1e6).cast("long")
        identity = F.shiftrightunsigned(two, 32).bitwiseXOR(t * 0x9E3779B1).bitwiseAND(F.lit(0xFFFFFFFF))
        out.append(F.shiftleft(steps, 32).bitwiseOR(identity))
    return out


def _below(cuts: list[int], key: Column) -> Column:
    """How many of the cuts, which ascend, are less than key, by bisection."""
    if not cuts:
        return F.lit(0)
    listed = _longs(cuts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda n, s: F.when(F.get(listed, n + s - 1) < key, n + s).otherwise(n))


def _longs(values: list[int]) -> Column:
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")


def cut_points(keys: DataFrame, n: int) -> tuple[list[int], dict[int, int]]:
    """Ascending keys that cut n rows into groups of about BUCKET, FANOUT * FANOUT at most; and into how many groups a key that fills several is to be cut.

    Quantiles of all rows come first, then those of each part between them, so that no task ranks everything. They choose a plan, not the result.
    """
    size = max(BUCKET, -(-n // FANOUT**2))
    wide = math.isqrt(max(0, n // size - 1)) + 1
    if wide < 2:
        return [], {}
    quantiles = F.percentile_approx("key", [i / wide for i in range(1, wide)], 8 * wide).alias("q")
    found = list(keys.agg(quantiles).first()["q"])
    parts = keys.groupBy(_below(sorted(set(found)), F.col("key")).alias("part")).agg(quantiles).collect()  # FANOUT rows of FANOUT keys
    times = Counter(found)
    for r in parts:
        times.update(r["q"])
    often = [k for k, m in times.items() if m > 2]
    counts = keys.where(F.array_contains(_longs(often), F.col("key"))).groupBy("key").count().collect() if often else []
    return sorted(times), {r["key"]: r["count"] // size for r in counts if r["count"] >= 2 * size}


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, place, guest, id, text, next: the text that follows by descending id, within each bucket."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.coalesce("id", F.lit(LOWEST).cast("long")))
    cuts, hot = cut_points(rows.select("key"), rows.count())
    key, bucket, turn = F.col("key"), _below(cuts, F.col("key")).cast("long"), F.lit(0).cast("long")
    if hot:
        # A key of many rows is the greatest of its bucket; its rows are dealt behind the others in the order of a hash of their texts.
        turn = F.xxhash64("text")
        often = sorted(hot)
        at = _below(often, key)
        groups = F.when(F.get(_longs(often), at) == key, F.get(_longs([hot[k] for k in often]), at))
        bucket = F.shiftleft(bucket, 32) + F.coalesce(1 + F.floor((turn.cast("double") * 2.0**-64 + 0.5) * groups), F.lit(0))
    rows = rows.withColumn("turn", turn).withColumn("bucket", bucket)
    # The first document of a bucket follows the last of the bucket above; the very first follows the very last. A row for each bucket, at most some FANOUT * FANOUT.
    tops = rows.groupBy("bucket").agg(F.max(F.struct("key", "turn")).alias("top"))
    up = W.orderBy("bucket")
    host = F.coalesce(F.lead("bucket").over(up), F.min("bucket").over(up.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    guests = tops.select(F.col("top.key").alias("k"), F.col("top.turn").alias("t"), host.alias("host"))
    placed = rows.join(F.broadcast(guests), (rows["key"] == guests["k"]) & (rows["turn"] == guests["t"]), "left")
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("guest"))
    placed = placed.withColumn("to", F.explode(F.when(F.col("host").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("host").alias("bucket"), F.lit(1).alias("guest"))))))
    placed = placed.select("to.bucket", "to.guest", "id", "key", "turn", "text")
    order = W.partitionBy("bucket").orderBy("guest", F.col("key").desc(), F.col("turn").desc(), F.col("text").desc())
    return placed.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("text").over(order)).drop("key", "turn")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: int = SAMPLES) -> DataFrame:
    """id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    rows = with_next(docs, id_col, text_col)
    n = F.char_length("text")
    rows = rows.withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.expr("substring(next, 1, cast(floor(char_length(text) / 2) as int))")))
    facts = rows.where("guest = 0").select("bucket", "place", F.col("id").alias(id_col), n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    sides = rows.select("bucket", "place", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")), F.struct(F.lit(1).alias("side"), F.coalesce("edited", F.lit("")).alias("t")))).alias("s"))
    words = sides.select("bucket", "place", "s.side", F.explode(F.split(F.translate("s.t", "\n\t\r", "   "), " ")).alias("word"))
    terms = words.select("bucket", "place", "side", F.when(F.col("word") != "", F.xxhash64("word")).alias("term"))
    counts = terms.groupBy("bucket", "place", "term").agg(F.sum(1 - F.col("side")).alias("own"), F.sum("side").alias("new"))
    weights = [F.when(F.col("term").isNotNull() & (F.col(c) > 0), F.ln(F.col(c).cast("double"))) for c in ("own", "new")]
    weighed = counts.select("bucket", "place", "term", weights[0].alias("w0"), weights[1].alias("w1"))
    draws = []
    for k in range(samples):
        a, b = sample(F.col("term"), [F.col("w0"), F.col("w1")], k)
        draws += [F.min(a).alias(f"a{k}"), F.min(b).alias(f"b{k}")]
    signs = weighed.groupBy("bucket", "place").agg(*draws)
    low = lambda c: F.col(c).bitwiseAND(F.lit(0xFFFF))
    signs = signs.select("bucket", "place", F.array(*[low(f"a{k}") for k in range(samples)]).alias("own"), F.array(*[low(f"b{k}") for k in range(samples)]).alias("new"))
    signs = signs.withColumn("after", F.lead("own").over(W.partitionBy("bucket").orderBy("place")))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x)), 4, "0"), F.lit("-"))), "")
    near = lambda c: reduce(lambda x, y: x + y, [F.get("own", F.lit(k)).eqNullSafe(F.get(c, F.lit(k))).cast("int") for k in range(samples)]) / float(samples)
    found = signs.select("bucket", "place", text("own").alias("fingerprint"), text("new").alias("edited_fingerprint"), near("new").alias("near_edited"), near("after").alias("near_next"))
    return facts.join(found, ["bucket", "place"]).drop("bucket", "place")


def op9_fingerprints(spark, sf_dir):
    return fingerprint(table(spark, sf_dir, "documents"))
