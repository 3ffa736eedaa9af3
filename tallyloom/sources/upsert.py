"""A second load over a first: which rows are new, changed or the same, ids for the new ones, and what was made from text that changed is emptied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text_tokens
from .catalog import SEARCHED, assign_ids
from .staging import written

# The columns from whose text a statistic's vector and a chunk's vector are made.
STATISTIC_TEXT = ("title_ko", "title_en", "chapter", "section", "level3_title", "level4_title")
CHUNK_TEXT = ("search_text",)
MADE = ("embedding", "embedding_profile_key")


def text_digest(columns: tuple[str, ...]) -> Column:
    """SHA-256 over the columns, null apart from empty."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in columns]), {"ignoreNullFields": "false"}), 256)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], id_col: str, text: tuple[str, ...] = STATISTIC_TEXT, searched: tuple[str, ...] = SEARCHED, keep_missing: bool = True) -> DataFrame:
    """new over old by natural key, nulls equal to nulls, with `change`: inserted, changed, unchanged, or kept for rows of old that new lacks (left out if not keep_missing).

    Of old only keys, id, digest of the text and what was made from it are moved; its texts are not. Ids of inserted rows follow the greatest id, in the order
    of the keys, so that a rerun gives the same ones. Vector, profile and search_doc stay with unchanged text; else the vector goes and search_doc is made anew.
    A key that comes twice in new is refused.
    """
    if new.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"a key of {', '.join(keys)} comes more than once")
    made = [c for c in (*MADE, "search_doc") if c in old.columns]
    has_doc = "search_doc" in old.columns
    before = old.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(id_col).alias("_id"), text_digest(text).alias("_digest"), *[F.col(c).alias(f"_{c}") for c in made])
    match = F.lit(True)
    for k in keys:
        match = match & new[k].eqNullSafe(before[f"_{k}"])
    joined = new.drop(id_col, *made).join(before, match, "left")
    same = F.col("_digest") == text_digest(text)
    change = F.when(F.col("_id").isNull(), "inserted").when(same, "unchanged").otherwise("changed")
    doc = {"search_doc": F.when(same, F.col("_search_doc")).otherwise(F.array_sort(F.array_distinct(text_tokens(F.concat_ws(" ", *searched)))))} if has_doc else {}
    fresh = joined.withColumn("change", change).withColumns({c: F.when(same, F.col(f"_{c}")) for c in made if c != "search_doc"} | doc)
    fresh = written(fresh.drop("_digest", *[f"_{c}" for c in made], *[f"_{k}" for k in keys]), "upsert")
    known = fresh.where("change <> 'inserted'").withColumnRenamed("_id", id_col)
    greatest = old.agg(F.max(id_col)).first()[0] or 0
    inserted = assign_ids(fresh.where("change = 'inserted'").drop("_id"), keys, id_col, greatest)
    out = known.unionByName(inserted.withColumn(id_col, F.col(id_col).cast(dict(known.dtypes)[id_col])))
    if keep_missing:
        there = new.select(*[F.col(k).alias(f"_{k}") for k in keys])
        found = F.lit(True)
        for k in keys:
            found = found & old[k].eqNullSafe(there[f"_{k}"])
        out = out.unionByName(old.join(there, found, "left_anti").withColumn("change", F.lit("kept")), allowMissingColumns=True)
    return out
