"""The engine's entry points: contacts, tables, search and chart data for a catalogue; analysis and comparison are in operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import edition_label
from ..functions.text import is_total, query_tokens
from ..operators import cells, charts, derive, search
from ..operators.analyze import base_rows, scoped
from ..operators.compare import first_contact
from ..sources.catalog import Catalog, kinds_of
from ..sources.staging import written

MOST_FOUND = 20


@dataclass
class Found:
    rows: DataFrame
    relaxed: bool = False
    notes: list[str] = field(default_factory=list)


def search_contacts(c: Catalog, stat_id: int) -> DataFrame:
    """Contacts of one statistic in their order; no rows if it has none."""
    s = c.statistics.where(F.col("stat_id") == stat_id).select("stat_id", "ref_id", "title_ko")
    return s.join(c.contacts, "stat_id").orderBy("contact_id")


def statistic(c: Catalog, stat_id: int) -> dict[str, DataFrame]:
    """One statistic with its tables, notes and first department, each a filtered scan."""
    one = lambda df: df.where(F.col("stat_id") == stat_id)
    head = one(c.statistics).join(first_contact(one(c.contacts)), "stat_id", "left").join(c.publications.drop("title", "year"), "pub_id", "left")
    return {"statistic": head, "tables": one(c.stat_tables).orderBy("seq"), "notes": one(c.footnotes).orderBy("seq")}


def search_tables(c: Catalog, stat_id: int, seq: int | None = None, row_label: str | None = None) -> DataFrame:
    """The cells of a statistic's tables, or the rows that a label names."""
    t = c.stat_tables.where(F.col("stat_id") == stat_id)
    t = t if seq is None else t.where(F.col("seq") == seq)
    long = cells.cells(t.withColumnRenamed("seq", "table_seq"), ["stat_id", "table_seq"])
    return long if row_label is None else cells.rows_by_label(long, ["stat_id", "table_seq"], row_label)


# What a chunk of each kind says of a statistic; all other kinds are labels of rows.
CHUNK_SOURCES = {"headers": "column", "notes": "footnote"}


def _evidence(hits: DataFrame, way: str, words: list[str]) -> DataFrame:
    """hits (with rank) of one way to look through chunks: stat_id, path, way, rank, gain, priority, matched_source, matched_text, table_seq."""
    source = F.coalesce(F.create_map(*[F.lit(x) for kv in CHUNK_SOURCES.items() for x in kv])[F.col("chunk_kind")], F.lit("row_label"))
    rows = hits.withColumns({"source": source, "best": search.best_label(F.coalesce("search_labels", F.array().cast("array<string>")), words)})
    note, exact = F.col("source") == "footnote", F.coalesce(F.col("best.exact"), F.lit(False))
    weight = F.when(note, search.WEIGHTS[f"note_{way}"]).otherwise(search.WEIGHTS[f"table_{way}"])
    gain = weight / (search.RRF_K + F.col("rank")) + F.coalesce(F.col("best.coverage"), F.lit(0.0)) * search.TOKEN_BONUS
    if way == "lexical":
        gain = gain + F.when(exact & ~note, search.EXACT_BONUS).otherwise(0.0)
        priority = F.when(note, search.PRIORITIES["note"]).when(exact & (F.col("source") == "column"), search.PRIORITIES["lexical_exact_column"]).otherwise(search.PRIORITIES["lexical"])
    else:
        priority = F.when(~note & (F.col("source") == "column"), search.PRIORITIES["vector_column"]).otherwise(search.PRIORITIES["vector_row"])
    path = F.concat(F.when(note, "note_").otherwise("table_"), F.lit(way))
    return rows.select(
        "stat_id", path.alias("path"), F.lit(1 if way == "lexical" else 2).alias("way"), "rank", gain.alias("gain"), priority.alias("priority"),
        F.col("source").alias("matched_source"), F.col("best.label").alias("matched_text"), "table_seq",
    )


def search_statistics(
    c: Catalog, query: str, vector: list[float] | None = None, kind: str = "all", year: int | None = None, period: str | None = None, limit: int = 5, profile: str | None = None, score=search.word_score
) -> Found:
    """Statistics by title vector, chunk words and chunk vector, fused; kinds of publications take turns.

    Of each title only the newest edition is looked at, which is chosen before year and period are. If a year finds nothing, all years are looked
    through once. profile: only vectors made that way. Each statistic comes with the place and text by which it was found best, the words of the query it holds,
    and whether it has tables. score: how words are ranked.
    """
    if not 1 <= limit <= MOST_FOUND:
        raise ValueError(f"limit is 1 to {MOST_FOUND}")
    words, k = query_tokens(query), search.pool_size(limit)
    lists, relaxed = [], False
    made = (lambda df: df) if profile is None else (lambda df: df.where(F.col("embedding_profile_key") == profile))
    for one in kinds_of(kind):
        newest = search.latest_editions(base_rows(c).where((F.col("publication_kind") == one) & F.col("stat_id").isNotNull()).withColumn("period", F.col("publication_period")))

        def fused(y: int | None, newest=newest, one=one) -> DataFrame:
            base = scoped(newest, one, y, period if one == "major_statistics" else None)
            ties = (F.col("publication_year").desc(), F.col("stat_id"))
            parts = []
            if vector is not None:
                near = search.nearest(made(base), F.lit(vector), k, ties=ties).withColumn("rank", F.row_number().over(W.orderBy(F.col("distance"), *ties)))
                gain = search.WEIGHTS["title"] / (search.RRF_K + F.col("rank"))
                none = F.lit(None).cast("int")
                parts.append(near.select("stat_id", F.lit("title").alias("path"), F.lit(0).alias("way"), "rank", gain.alias("gain"), F.lit(1).alias("priority"), F.lit("title").alias("matched_source"), F.col("title_ko").alias("matched_text"), none.alias("table_seq")))
            if c.chunks is not None:
                seqs = c.stat_tables.select("table_id", F.col("seq").alias("table_seq"))
                chunks = c.chunks.join(base.select("stat_id", "publication_year"), "stat_id").join(seqs, "table_id", "left")
                more = (*ties, F.col("chunk_no"), F.col("chunk_id"))
                if words:
                    hits = search.by_words(chunks, "search_text", words, k, more, score).withColumn("rank", F.row_number().over(W.orderBy(F.col("score").desc(), *more)))
                    parts.append(_evidence(hits, "lexical", words))
                if vector is not None:
                    hits = search.nearest(made(chunks), F.lit(vector), k, ties=more).withColumn("rank", F.row_number().over(W.orderBy(F.col("distance"), *more)))
                    parts.append(_evidence(hits, "vector", words))
            if not parts:
                raise ValueError("nothing to look for")
            found = reduce(DataFrame.unionByName, parts)
            scores = search.fuse([found.select("stat_id", "path", "gain")])
            best = search.best_source(found).select("stat_id", "matched_source", "matched_text", "table_seq")
            shown = base.select("stat_id", "ref_id", "title_ko", "chapter", "section", "unit", "publication_kind", "publication_year", "publication_period").join(scores, "stat_id").join(best, "stat_id")
            shown = search.with_flag(shown, c.stat_tables, "stat_id", "has_tables")
            text = F.lower(F.concat_ws(" ", "title_ko", "chapter", "section", "unit", "matched_text"))
            tokens = F.filter(F.array(*map(F.lit, words)) if words else F.array().cast("array<string>"), lambda w: text.contains(F.lower(w)))
            edition = edition_label(F.col("publication_year"), F.col("publication_period"), F.col("publication_kind"))
            shown = shown.withColumns({"score": F.bround("score", 6), "edition": edition, "matched_tokens": tokens})
            return search.first_of_each(shown, ["ref_id", "title_ko"], [F.col("score").desc(), F.col("publication_year").desc(), F.col("stat_id")], limit)

        # What a year finds is at most `limit` rows: written, so that the search runs once for the question and the result.
        rows = fused(None) if year is None else written(fused(year), "found")
        if year is not None and rows.isEmpty():
            rows, relaxed = fused(None), True
        lists.append(rows)
    order = [F.col("score").desc(), F.col("publication_year").desc(), F.col("stat_id")]
    return Found(search.interleave(lists, order, limit), relaxed, ["the year was widened"] if relaxed else [])


def chart(rows: DataFrame, x: str, metrics: list[str], pos: str, kind: str = "bar", top_n: int = charts.CATEGORIES, keep_totals: bool = False, descending: bool | None = None) -> DataFrame:
    """Chart data in the fixed order of steps: melt, cap series, drop totals, cap categories, sort, and what the kind of chart adds."""
    r = charts.top_by_sum(charts.melt(rows, x, metrics, pos), "series", charts.SERIES)
    if not keep_totals or kind in ("ring", "stacked_share", "waterfall"):
        r = r.where(~F.coalesce(is_total(F.col("x").cast("string")), F.lit(False)))
    r = charts.top_by_sum(r, "x", charts.RING if kind == "ring" else top_n)
    if descending is not None:
        r = charts.sort_by_value(r, descending)
    add = {"bump": charts.ranks, "stacked_share": charts.shares, "waterfall": charts.waterfall, "ring": charts.ring_angles, "line": charts.marks, "stacked": charts.stack_order}
    return add[kind](r) if kind in add else r


def chart_of_sources(sources: dict[str, tuple[DataFrame, str, str]], op: str | None = None, per: float = 1.0, inner: bool = False) -> DataFrame:
    """sources: name -> (rows, label column, value column). Aligned on canonical keys; with op, the first over the second."""
    points = {name: derive.series_points(rows, label, value) for name, (rows, label, value) in sources.items()}
    if op:
        a, b = list(points.values())[:2]
        return derive.derive(op, a, b, per)
    return derive.align(points, "inner" if inner else "outer")
