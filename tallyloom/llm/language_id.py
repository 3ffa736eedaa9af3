"""Language identification by words first, backing off to shorter and shorter character n-grams.

A text is lower-cased and cut into runs of letters; runs of over LONGEST letters are cut into pieces of that
length. A word that the model knows scores its log frequency in each language, with a penalty where a language
lacks it. For an unseen word the n-grams of the word between two blanks are looked up, longest first: the first
length of which any n-gram is known gives the mean of the known ones' scores; a word of which nothing is known
says nothing. A text's scores are the sums over its words; the greatest wins, of equal ones the first by name.
`score` is the winner's share after exponentiation, the sums divided by the root of the number of words.

Words of all training texts are counted: each task counts its own, Spark adds the counts. N-grams are counted
from the table of distinct words, not from texts. What is bounded is the model: MOST_LANGUAGES languages, those
with the most texts, and for each an equal share of MOST_WORDS words and of MOST_GRAMS n-grams of each length,
the most frequent ones, found by a histogram of counts (where a count's words do not all fit, none of them comes in).

Null texts and texts without a letter are `und` with score 0, as is everything if nothing was learned. Texts without
language teach nothing, nor do rows with a null id. Whole texts count, however long. Repeated rows and
rows of one id count each. Other columns of the table are not looked at. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table

LETTERS = re.compile(r"[^\W\d_]+")
LONGEST = 64
GRAM = 5
MOST_LANGUAGES, MOST_WORDS, MOST_GRAMS = 200, 240_000, 60_000
#: Counts that a task holds before it hands them on, and unseen words whose scores a worker keeps.
HELD, CACHE = 400_000, 200_000
#: How far below the rarest known frequency a missing word or n-gram scores, as a natural logarithm.
PENALTY = 2.0


def words_of(text: str) -> Counter:
    """How often each run of letters comes."""
    found = Counter(LETTERS.findall(text.lower()))
    for w in [w for w in found if len(w) > LONGEST]:
        n = found.pop(w)
        for i in range(0, len(w), LONGEST):
            found[w[i : i + LONGEST]] += n
    return found


def grams_of(word: str, n: int) -> list[str]:
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_words(batches):
    """lang, word, n: partial counts, handed on whenever there are HELD of them."""
    counts: dict[str, Counter] = {}

    def rows():
        flat = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
        columns = [pa.array([r[0] for r in flat], pa.string()), pa.array([r[1] for r in flat], pa.string()), pa.array([r[2] for r in flat], pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["lang", "word", "n"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            counts.setdefault(lang, Counter()).update(words_of(text.as_py()))
            if sum(map(len, counts.values())) > HELD:
                yield rows()
    yield rows()


def _most_frequent(counts: DataFrame, share: Column | int, by: list[str]) -> DataFrame:
    """Rows whose count is so great that no more than share rows of the same `by` have one as great."""
    histogram = counts.groupBy(*by, "n").agg(F.count("*").alias("many"))
    upto = F.sum("many").over(Window.partitionBy(*by).orderBy(F.desc("n")))
    least = histogram.withColumn("upto", upto).where(F.col("upto") <= share).groupBy(*by).agg(F.min("n").alias("least"))
    return counts.join(F.broadcast(least), by).where("n >= least").drop("least")  # a row for each language and length


class Model:
    """Languages, and the scores of words and of n-grams in each of them."""

    def __init__(self, langs: list[str], words: list[tuple], grams: list[tuple]):
        """words: (word, lang, n, total of the language); grams: the same for n-grams."""
        self.langs = langs
        self.words, self.word_scores = self._scores(words)
        self.grams, self.gram_scores = self._scores(grams)
        self.unseen: dict[str, int] = {}
        self.backed: list[np.ndarray] = []

    def _scores(self, rows: list[tuple]) -> tuple[dict[str, int], np.ndarray]:
        at = {x: i for i, x in enumerate(dict.fromkeys(r[0] for r in rows))}
        lang = {x: i for i, x in enumerate(self.langs)}
        value = np.log(np.array([r[2] for r in rows], float) / np.array([r[3] for r in rows], float)) if rows else np.zeros(0)
        out = np.full((len(at), len(self.langs)), (value.min() if rows else 0.0) - PENALTY, np.float32)
        out[[at[r[0]] for r in rows], [lang[r[1]] for r in rows]] = value
        return at, out

    def back_off(self, word: str) -> np.ndarray:
        for n in range(min(GRAM, len(word) + 2), 0, -1):
            known = [i for g in grams_of(word, n) if g != " " and (i := self.grams.get(g)) is not None]
            if known:
                return self.gram_scores[known].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def unseen_scores(self, words: list[str]) -> np.ndarray:
        if len(self.unseen) > CACHE:
            self.unseen, self.backed = {}, []
        for w in words:
            if w not in self.unseen:
                self.unseen[w] = len(self.backed)
                self.backed.append(self.back_off(w))
        return np.array([self.backed[self.unseen[w]] for w in words])

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words_of(text) if text else {}
        if not found or not self.langs:
            return "und", 0.0
        names, n = list(found), np.array(list(found.values()), float)
        at = list(map(self.words.get, names))
        known = np.array([i is not None for i in at])
        total = n[known] @ self.word_scores[[i for i in at if i is not None]].astype(float)
        if not known.all():
            total = total + n[~known] @ self.unseen_scores([w for w, i in zip(names, at) if i is None]).astype(float)
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp((total - total[best]) / n.sum() ** 0.5).sum())


def train(rows: DataFrame, lang_col: str = "lang", text_col: str = "text") -> Model:
    """A model of the rows that have language and text. The driver gets the bounded model alone."""
    texts = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    langs = sorted(r["lang"] for r in texts.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect())
    if not langs:
        return Model([], [], [])
    texts = texts.where(F.col("lang").isin(langs))
    words = materialize(texts.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.length("word") + 3 - k), lambda i: F.substring(padded, i, F.lit(k)))
    each = F.flatten(F.array(*(F.when(F.length("word") + 2 >= k, cut(k)).otherwise(F.array().cast("array<string>")) for k in range(1, GRAM + 1))))
    grams = words.select("lang", "n", F.explode(each).alias("word")).where("word <> ' '")
    grams = materialize(grams.groupBy("lang", "word").agg(F.sum("n").alias("n")).withColumn("size", F.length("word")), "grams")
    with_total = lambda df, by, share: _most_frequent(df, share, by).join(F.broadcast(df.groupBy(*by).agg(F.sum("n").alias("total"))), by)
    kept_words = with_total(words, ["lang"], MOST_WORDS // len(langs)).select("word", "lang", "n", "total")
    kept_grams = with_total(grams, ["lang", "size"], MOST_GRAMS // len(langs)).select("word", "lang", "n", "total")
    return Model(langs, *(sorted(zip(*(c.to_pylist() for c in df.toArrow().columns))) for df in (kept_words, kept_grams)))


def identify(rows: DataFrame, model: Model, keep: tuple[str, ...] = (), text_col: str = "text") -> DataFrame:
    """lang_pred and score beside the kept columns. One pass, no shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            out = [shared.value.predict(t.as_py()) for t in b.column(0)]
            columns = [*b.columns[1:], pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f"k{i}" for i in range(len(keep))), "lang_pred", "score"])

    kinds = dict(rows.dtypes)
    picked = rows.select(F.col(text_col).alias("t"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)))
    fields = ", ".join([*(f"k{i} {kinds[c]}" for i, c in enumerate(keep)), "lang_pred string", "score double"])
    return picked.mapInArrow(run, fields).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "lang_pred", "score")


def fold(id_col: str, of: int) -> Column:
    """CRC-32 of the id as decimal text, modulo `of`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def op11_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 3) != 1))
    out = identify(docs.select("doc_id", "text"), model, keep=("doc_id",))
    return out.select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
