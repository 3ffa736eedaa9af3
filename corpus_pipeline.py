"""From documents to packed training sequences: five stages, each written as Parquet and read again.

Stages keep the columns of documents up to the last. Null and empty texts pass through all of them
(they are neither toxic nor copies, lose nothing and count no words); an empty table stays
empty. Rows that share an id: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import mixing, ngram_join, packing, suffix_dedup, toxicity
from tallyloom.llm.common import WORD, materialize, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = tuple(COLUMNS[1:])
#: N-grams of so many words, and the similarity as a fraction, for near-duplicates.
WORDS, NUM, DEN = 5, 80, 100
#: Pieces in which a shard of the mix is written.
SLICES = 16


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5, by a model of the labelled ones among them."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=REST).where("score < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of the least id, of equal ids the first; a null id comes last. Of rows without words that are equal in id and text one stays."""
    rows = materialize(docs.select(*COLUMNS).withColumn("row", F.monotonically_increasing_id()), "rows")
    groups = ngram_join.jaccard_components(rows, WORDS, NUM, DEN, row_col="row").where("component IS NOT NULL")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("kept"))
    wordless = rows.where(~F.coalesce(F.col("text").rlike(WORD), F.lit(False))).groupBy("doc_id", "text").agg(F.min("row").alias("kept"))
    kept = first.union(wordless.select("kept"))
    return rows.join(kept, rows["row"] == kept["kept"], "left_semi").select(*COLUMNS)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that came before; documents of which nothing is left go."""
    left = suffix_dedup.remove_repeats(docs, keep=("lang", "source"))
    left = left.where("n_removed = 0 OR n_removed < n_bytes")
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.coalesce(F.char_length("kept_text"), F.lit(0)).cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; one that is taken in part comes whole if half of it is taken."""
    mixed = mixing.mix(docs, keep=("text", "lang", "n_chars"))
    taken = mixed.withColumn("d", F.explode("draws")).where("2 * d.words >= size")
    # The shards of the mix, each in its own order, a shard in SLICES pieces at random.
    shuffled = taken.repartition("d.shard", F.pmod("d.position", F.lit(SLICES))).sortWithinPartitions("d.shard", "d.position", "id")
    return shuffled.select(F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), F.col("kept_lang").alias("lang"), "source", F.col("kept_n_chars").alias("n_chars"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each piece, with its sequence and offset."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
