"""A convolutional text classifier for toxicity, trained in numpy.

Words are lower-cased, stripped of marks at their ends and hashed; the hashes that occur
in at least MIN_DOCS training texts have an embedding, up to MAX_ROWS of them. That of
its first PREFIX letters, if these have one, is added to a word's, and stands alone for any
other word. Filters of several widths run over the embeddings, each is
max-pooled over the whole text, and a logistic layer gives the score. Training uses a
bounded sample, the MAX_TRAIN labelled rows with the least hash; scoring is one pass
over all rows without shuffle, where the product of embeddings and filters is kept as a
table, so that a word costs one gather.

Thresholds by language are calibrated on the part of the sample that training leaves
out; they are used for `flag`, never for the score.

The sample has one text for each id, and whole texts only: those past MAX_WORDS words in all, in the order of their hashes, are left out.

Null and empty texts have the score of a text without words. Labels that repeat count as
toxic if one of them does. Without labels of both kinds, every score is the rate of toxic
labels, or 0. An empty table gives an empty result. Rows with a null id or an id that is shared, and repeated rows, are scored each. Texts may be of any length; all their
words count. Other columns, whatever their names, have no effect.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

#: Bounds of the training sample, in documents and in words.
MAX_TRAIN, MAX_WORDS = 8000, 8_000_000
MIN_DOCS, MAX_ROWS = 4, 60_000
DIM, FILTERS, WIDTHS = 12, 8, (1, 2, 3)
EPOCHS, BATCH = 8, 64
PAD = max(WIDTHS) - 1
CACHE = 600_000
STRIP = ".,!?;:\"'()[]{}<>*_-"
FOLDS = 5
PREFIX = 4
LOW = np.uint64(0xFFFFFFFF)


def word_hash(raw: str) -> int:
    """32 bits of the word, and above them 32 bits of its first letters."""
    word = raw.lower().strip(STRIP)
    if not word:
        return 0
    crc = lambda x: zlib.crc32(x.encode("utf-8", "surrogatepass"))
    return crc(word) | crc("^" + word[:PREFIX]) << 32


class Cached(dict):
    """make(raw word), kept up to a bounded number."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, raw):
        h = self.make(raw)
        if len(raw) <= 64:
            if len(self) >= CACHE:
                self.clear()
            self[raw] = h
        return h


class Network:
    """Embeddings E, filters W[w][k] and biases, and the logistic layer."""

    def __init__(self, rows: np.ndarray, rate: float, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.rows = rows  # sorted hashes that have an embedding; row 0 is for all others
        self.E = (rng.normal(size=(len(rows) + 1, DIM)) * 0.1).astype(np.float32)
        self.E[0] = 0
        self.prefix = np.zeros(len(rows) + 1, np.int64)  # the row of a word's first letters
        self.W = {w: (rng.normal(size=(w, DIM, FILTERS)) * 0.3).astype(np.float32) for w in WIDTHS}
        self.b = {w: np.zeros(FILTERS, np.float32) for w in WIDTHS}
        self.out = (rng.normal(size=FILTERS * len(WIDTHS)) * 0.3).astype(np.float32)
        self.bias = np.float32(np.log(rate / (1 - rate)))
        self.shift, self.thresholds, self.threshold = 0.0, {}, 0.5

    def row(self, h: np.ndarray) -> np.ndarray:
        if not len(self.rows):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.rows, h), len(self.rows) - 1)
        return np.where(self.rows[at] == h, at + 1, 0)

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of word hashes."""
        known = self.row(hashes & LOW)
        return np.where(known > 0, known, self.row(hashes >> np.uint64(32))).astype(np.int32)

    def train(self, texts: list[np.ndarray], y: np.ndarray, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        params = {"E": self.E, "out": self.out} | {f"W{w}": self.W[w] for w in WIDTHS} | {f"b{w}": self.b[w] for w in WIDTHS}
        squares = {k: np.full_like(v, 1e-6) for k, v in params.items()}
        bias_square = 1e-6

        def step(name: str, grad: np.ndarray, rows=None, rate: float = 0.05) -> None:
            p, s = params[name], squares[name]
            if rows is None:
                s += grad * grad
                p -= rate * grad / np.sqrt(s)
            else:
                s[rows] += grad * grad
                p[rows] -= rate * grad / np.sqrt(s[rows])

        pad = np.zeros(PAD, np.int32)
        for _ in range(EPOCHS):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                pick = order[at : at + BATCH]
                ids = np.concatenate([x for i in pick for x in (texts[i], pad)] + [pad])
                ends = np.cumsum([len(texts[i]) + PAD for i in pick])
                starts = np.concatenate([[0], ends[:-1]])
                n = ends[-1]
                X = self.E[ids] + self.E[self.prefix[ids]]
                pooled, where = [], []
                for w in WIDTHS:
                    C = sum(X[k : k + n] @ self.W[w][k] for k in range(w)) + self.b[w]
                    top = np.maximum.reduceat(C, starts, axis=0)
                    hit = np.empty_like(top, dtype=np.int64)
                    for d, (s, e) in enumerate(zip(starts, ends, strict=True)):
                        hit[d] = s + C[s:e].argmax(0)
                    pooled.append(top)
                    where.append(hit)
                P = np.concatenate(pooled, 1)
                H = np.maximum(P, 0)
                z = H @ self.out + self.bias
                g = (1 / (1 + np.exp(-z)) - y[pick]).astype(np.float32) / len(pick)
                dP = g[:, None] * self.out[None] * (P > 0)
                grads_E, rows_E = [], []
                for j, w in enumerate(WIDTHS):
                    d = dP[:, j * FILTERS : (j + 1) * FILTERS]
                    dW = np.zeros_like(self.W[w])
                    for k in range(w):
                        at_k = where[j] + k
                        dW[k] = np.einsum("bf,bfd->df", d, X[at_k])
                        grads_E.append((d[:, :, None] * self.W[w][k].T[None]).reshape(-1, DIM))
                        rows_E.append(ids[at_k].ravel())
                        grads_E.append(grads_E[-1])
                        rows_E.append(self.prefix[rows_E[-1]])
                    step(f"W{w}", dW + 1e-5 * self.W[w])
                    step(f"b{w}", d.sum(0))
                step("out", H.T @ g + 1e-5 * self.out)
                gb = float(g.sum())
                bias_square += gb * gb
                self.bias -= np.float32(0.05 * gb / np.sqrt(bias_square))
                rows, inverse = np.unique(np.concatenate(rows_E), return_inverse=True)
                grad = np.zeros((len(rows), DIM), np.float32)
                np.add.at(grad, inverse, np.concatenate(grads_E))
                if len(rows) and rows[0] == 0:
                    rows, grad = rows[1:], grad[1:]
                step("E", grad, rows)

    def tables(self) -> np.ndarray:
        """Row x (width, place in the filter, filter): what a word adds to each filter at each place."""
        E = self.E + self.E[self.prefix]
        return np.ascontiguousarray(np.concatenate([E @ self.W[w][k] for w in WIDTHS for k in range(w)], axis=1))

    def logits(self, texts: list[np.ndarray], tables: np.ndarray, at_once: int = 100_000) -> np.ndarray:
        out, pad, first = [], np.zeros(PAD, np.int64), 0
        while first < len(texts):
            last, n = first, 0
            while last < len(texts) and (last == first or n + len(texts[last]) <= at_once):
                n += len(texts[last]) + PAD
                last += 1
            ids = np.concatenate([x for t in texts[first:last] for x in (t, pad)] + [pad])
            starts = np.concatenate([[0], np.cumsum([len(t) + PAD for t in texts[first:last]])[:-1]])
            A, col, pooled = tables[ids], 0, []
            for w in WIDTHS:
                C = A[:n, col : col + FILTERS].copy()
                for k in range(1, w):
                    C += A[k : k + n, col + k * FILTERS : col + (k + 1) * FILTERS]
                pooled.append(np.maximum.reduceat(C, starts, axis=0) + self.b[w])
                col += w * FILTERS
            out.append(np.maximum(np.concatenate(pooled, 1), 0) @ self.out + self.bias)
            first = last
        return np.concatenate(out).astype(np.float64) if out else np.zeros(0)


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit above which most F1 is reached, halfway to the next lower one."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    top = logits[order]
    return float((top[k] + top[k + 1]) / 2 if k + 1 < len(top) else top[k] - 1)


def fit(samples: list[tuple[np.ndarray, int, str | None]]) -> Network | float:
    """samples: (word hashes, label, language). A number stands for a constant score."""
    y = np.array([s[1] for s in samples], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    kinds, n = np.unique(np.concatenate([np.unique(np.concatenate([s[0] & LOW, s[0] >> np.uint64(32)])) for s in samples]), return_counts=True)
    keep = np.lexsort((kinds, -n))[:MAX_ROWS]
    net = Network(np.sort(kinds[keep][n[keep] >= min(MIN_DOCS, max(1, len(y) // 100))]), float(y.mean()))
    words = np.unique(np.concatenate([np.unique(s[0]) for s in samples]))
    own, first = net.row(words & LOW), net.row(words >> np.uint64(32))
    net.prefix[own[own > 0]] = first[own > 0]
    texts = [net.lookup(s[0]) for s in samples]
    held = np.arange(len(y)) % FOLDS == 0 if y.sum() >= 3 * FOLDS else np.zeros(len(y), bool)
    net.train([t for t, h in zip(texts, held, strict=True) if not h], y[~held])
    use = held if held.any() and y[held].min() != y[held].max() else np.ones(len(y), bool)
    z = net.logits([t for t, u in zip(texts, use, strict=True) if u], net.tables())
    net.shift = best_cut(z, y[use])
    langs = np.array([s[2] or "" for s, u in zip(samples, use, strict=True) if u])
    for lang in sorted(set(langs.tolist())):
        m = langs == lang
        # Too few of a language leave it the common threshold.
        if y[use][m].sum() >= 10:
            net.thresholds[lang] = float(np.clip(1 / (1 + np.exp(-(best_cut((z - net.shift)[m], y[use][m])))), 0.2, 0.8))
    return net


def _ids(text: str | None, words: Cached, kind) -> np.ndarray:
    parts = text.split() if text else []
    return np.fromiter(map(words.__getitem__, parts), kind, len(parts))


def train(docs: DataFrame, labels: DataFrame) -> Network | float:
    """Fit on at most MAX_TRAIN labelled documents, of MAX_WORDS words in all, whose crc32(doc_id) mod 5 isn't 0."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold != 0)).groupBy(F.col("doc_id").alias("i")).agg(F.max("toxic").cast("int").alias("y"))
    # Bounded by MAX_TRAIN rows.
    sample = rows.orderBy(F.xxhash64("i"), "i").limit(MAX_TRAIN)
    texts = docs.select("doc_id", "text", "lang").join(F.broadcast(sample), F.col("doc_id") == F.col("i")).select("doc_id", "text", "lang", "y")

    def run(batches):
        words = Cached(word_hash)
        for batch in batches:
            ids = [_ids(t, words, "<u8").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), batch.column("lang"), pa.array(ids, pa.binary())], ["doc_id", "y", "lang", "ids"])

    hashed = texts.mapInArrow(run, "doc_id long, y int, lang string, ids binary")
    one = hashed.groupBy("doc_id").agg(F.min(F.struct("ids", "lang", "y")).alias("r")).select("doc_id", "r.*")
    kept = materialize(one.withColumn("h", F.xxhash64("doc_id")), "sample")
    # MAX_TRAIN rows of three numbers at most.
    sizes = sorted(map(tuple, kept.select("h", "doc_id", (F.octet_length("ids") / 8).cast("long")).collect()))
    within = np.cumsum([n for _, _, n in sizes]) <= MAX_WORDS
    last = sizes[int(within.sum()) - 1][0] if within.any() else None
    got = kept.where(F.col("h") <= F.lit(last).cast("long")).select("doc_id", "y", "lang", "ids").toArrow().combine_chunks()
    ids, y, lang = got.column("doc_id").to_numpy(), got.column("y").to_numpy(), got.column("lang").to_pylist()
    hashes = [np.frombuffer(x.as_buffer(), "<u8") for x in got.column("ids")]
    return fit([(hashes[k], int(y[k] > 0), lang[k]) for k in np.argsort(ids, kind="stable").tolist()])


def score(docs: DataFrame, model: Network | float, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """id, kept columns, score for each row."""
    tables = model.tables() if isinstance(model, Network) else None
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t_in"), *[F.col(k).alias(f"k_{k}") for k in keep])
    kept = [f"k_{k}" for k in keep]

    def run(batches):
        place = {int(h): i + 1 for i, h in enumerate(model.rows)} if tables is not None else {}
        words = Cached(lambda raw: place.get((h := word_hash(raw)) & 0xFFFFFFFF) or place.get(h >> 32) or 0)
        for batch in batches:
            texts = batch.column("t_in").to_pylist()
            if tables is None:
                s = np.full(len(texts), float(model))
            else:
                z = [model.logits([_ids(t, words, np.int64) for t in texts[at : at + 256]], tables) for at in range(0, len(texts), 256)]
                s = 1 / (1 + np.exp(-np.clip((np.concatenate(z) if z else np.zeros(0)) - model.shift, -600, 600)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(batch.column(k) for k in kept), pa.array(s, pa.float64())], ["id", *kept, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "t_in")
    out = rows.mapInArrow(run, f"{fields}, score double")
    return out.select(F.col("id").alias(id_col), *[F.col(f"k_{k}").alias(k) for k in keep], "score")


def flag(scored: DataFrame, model: Network | float, lang_col: str = "lang") -> DataFrame:
    """Add threshold, by language, and flag."""
    known = model.thresholds if isinstance(model, Network) else {}
    limit = F.lit(0.5)
    for lang, t in sorted(known.items()):
        limit = F.when(F.col(lang_col).eqNullSafe(F.lit(lang)), F.lit(t)).otherwise(limit)
    return scored.withColumn("threshold", limit).withColumn("flag", (F.col("score") >= F.col("threshold")).cast("int"))


def op3_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    out = flag(score(docs, model, keep=("lang",)), model)
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", "flag")
