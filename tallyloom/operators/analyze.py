"""Counts, breakdowns and lists over a catalogue, from a checked request."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import department_keys, officer_keys
from ..functions.text import collapsed, contains_any_key, match_key_value, not_blank
from ..sources.catalog import Catalog, period_of

MOST_ROWS = 500


@dataclass
class Answer:
    """Rows, and what they mean."""

    rows: DataFrame
    definition: str = ""
    basis: str = ""
    limitations: list[str] = field(default_factory=list)
    source_tables: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    relaxed: bool = False
    #: All rows of a list, of which rows is a page.
    every: DataFrame | None = None

    @cached_property
    def total(self) -> int | None:
        """Rows of a list before limit and offset; counted when it is asked for."""
        return None if self.every is None else self.every.count()


@dataclass(frozen=True)
class Metric:
    """A number of distinct things: of the columns of a table, where none of them is null."""

    child: str | None
    columns: tuple[str, ...]
    definition: str
    limitations: tuple[str, ...] = ()


METRICS = {
    "statistics": Metric(None, ("stat_id",), "statistics as parsed and stored", ("counts what was parsed, not the lines of a table of contents",)),
    "tables": Metric("stat_tables", ("table_id",), "physical tables", ("a statistic may be stored in several parts",)),
    "chapters": Metric(None, ("year", "chapter_no"), "chapters that statistics belong to"),
    "sections": Metric(None, ("year", "chapter_no", "section_no"), "sections that statistics belong to"),
    "organizations": Metric("contacts", ("organization",), "departments named under the tables", ("not an official list of agencies, nor a number of agencies",)),
    "source_systems": Metric("contacts", ("source_system",), "source systems named under the tables"),
    "publications": Metric(None, ("pub_id",), "editions that are loaded"),
    "contacts": Metric("contacts", ("contact_id",), "contacts of statistics"),
    "footnotes": Metric("footnotes", ("note_id",), "notes of statistics"),
}
GROUPS = {
    "publication_year": (None, ("publication_year",), None),
    "chapter": (None, ("chapter_no",), "chapter"),
    "section": (None, ("chapter_no", "section_no"), "section"),
    "organization": ("contacts", ("organization",), None),
    "source_system": ("contacts", ("source_system",), None),
}
#: Fields of lists: the table they come from (None: statistics and publications), and their text-ness.
FIELDS = {
    **dict.fromkeys(("publication_year", "publication_kind", "publication_period", "publication_title", "publication_page_count"), None),
    **dict.fromkeys(("stat_id", "ref_id", "chapter_no", "chapter", "section_no", "section", "level3_title", "level4_title", "statistic_title", "unit", "base_date", "page_start"), None),
    **dict.fromkeys(("table_id", "table_seq", "table_caption", "row_count", "column_count"), "stat_tables"),
    **dict.fromkeys(("contact_id", "department", "officer", "phone", "source_system", "source_url"), "contacts"),
    **dict.fromkeys(("note_id", "note_seq", "note_no", "note"), "footnotes"),
}


def base_rows(c: Catalog) -> DataFrame:
    """Statistics with their edition. Editions are few; Spark broadcasts them by their size."""
    p = c.publications.select("pub_id", F.col("year").alias("publication_year"), "publication_kind", F.col("period").alias("publication_period"), F.col("title").alias("publication_title"), F.col("page_count").alias("publication_page_count"))
    return p.join(c.statistics, "pub_id", "left").withColumn("statistic_title", F.col("title_ko"))


def child_rows(c: Catalog, child: str) -> DataFrame:
    if child == "stat_tables":
        return c.stat_tables.select("stat_id", "table_id", F.col("seq").alias("table_seq"), F.col("caption").alias("table_caption"), F.col("n_rows").alias("row_count"), F.col("n_cols").alias("column_count"))
    if child == "contacts":
        clean = {"organization": "dept", "department": "dept", "officer": "officer", "phone": "phone", "source_system": "source_system", "source_url": "source_url"}
        return c.contacts.select("stat_id", "contact_id", *[collapsed(F.col(v)).alias(k) for k, v in clean.items()])
    return c.footnotes.select("stat_id", "note_id", F.col("seq").alias("note_seq"), "note_no", F.col("content").alias("note"))


def present(df: DataFrame, name: str) -> Column:
    return not_blank(F.col(name)) if dict(df.dtypes)[name] == "string" else F.col(name).isNotNull()


def scoped(df: DataFrame, kind: str = "yearbook", year: int | None = None, period: str | None = None, chapter_no: int | None = None, section_no: int | None = None) -> DataFrame:
    df = df if kind == "all" else df.where(F.col("publication_kind") == kind)
    for name, value in (("publication_year", year), ("publication_period", None if period is None else period_of(period)), ("chapter_no", chapter_no), ("section_no", section_no)):
        if value is not None:
            df = df.where(F.col(name) == value)
    return df


def latest_year(c: Catalog, kind: str, period: str | None = None) -> int | None:
    p = c.publications if kind == "all" else c.publications.where(F.col("publication_kind") == kind)
    return (p if period is None else p.where(F.col("period") == period_of(period))).agg(F.max("year")).first()[0]


def value_filter(df: DataFrame, filters: list[tuple[str, str]]) -> DataFrame:
    """Each (field, text): the field's match key contains the text's, in any form that it may be asked for."""
    for name, text in dict.fromkeys(filters):
        keys = officer_keys(text) if name == "officer" else department_keys(text) if name in ("department", "organization") else [k for k in [match_key_value(text)] if k]
        if not keys:
            raise ValueError(f"nothing to look for in {name}: {text!r}")
        df = df.where(contains_any_key(F.col(name), keys))
    return df


def distinct_count(df: DataFrame, columns: tuple[str, ...]) -> Column:
    known = reduce(lambda a, b: a & b, [present(df, x) for x in columns])
    return F.count_distinct(F.when(known, F.struct(*columns) if len(columns) > 1 else F.col(columns[0])))


def overview(c: Catalog, kind: str = "all") -> DataFrame:
    """Each edition with its numbers of statistics, tables, chapters, sections, departments and systems.

    Children are counted by themselves and joined, so that no row is multiplied.
    """
    edition = ["pub_id", "publication_year", "publication_kind", "publication_period", "publication_title", "publication_page_count"]
    base = scoped(base_rows(c), kind)
    own = base.groupBy(*edition).agg(*[distinct_count(base, METRICS[m].columns).alias(m) for m in ("statistics", "chapters", "sections")])
    owner = base.where("stat_id IS NOT NULL").select("pub_id", "stat_id")
    tables, contacts = owner.join(child_rows(c, "stat_tables"), "stat_id"), owner.join(child_rows(c, "contacts"), "stat_id")
    t = tables.groupBy("pub_id").agg(F.count_distinct("table_id").alias("tables"))
    k = contacts.groupBy("pub_id").agg(F.count_distinct("organization").alias("organizations"), F.count_distinct("source_system").alias("source_systems"))
    out = own.join(t, "pub_id", "left").join(k, "pub_id", "left").na.fill(0, ["tables", "organizations", "source_systems"])
    return out.orderBy(F.col("publication_year").desc(), F.col("publication_period").desc(), "publication_kind", "pub_id")


def analyze(
    c: Catalog, operation: str, subject: str = "statistics", *, group_by: str | None = None, distinct_field: str | None = None, fields: list[str] | None = None, required: list[str] = (), filters: list[tuple[str, str]] = (),
    deduplicate: bool = False, kind: str = "yearbook", period: str | None = None, year: int | None = None, all_years: bool = False, chapter_no: int | None = None, section_no: int | None = None, limit: int = MOST_ROWS, offset: int = 0,
) -> Answer:
    """overview, count, breakdown or list. Without a year the latest is taken; if nothing is found there, all are, once."""
    if operation not in ("overview", "count", "breakdown", "list"):
        raise ValueError(f"unknown operation: {operation}")
    if operation == "overview":
        return Answer(overview(c, kind), "editions and what they hold", source_tables=["publications", "statistics", "stat_tables", "contacts"])
    if subject not in METRICS:
        raise ValueError(f"unknown subject: {subject}")
    if operation == "breakdown" and group_by not in GROUPS or operation != "breakdown" and group_by:
        raise ValueError("group_by goes with breakdown, and only there")
    if distinct_field and (operation != "count" or distinct_field not in FIELDS):
        raise ValueError("distinct_field goes with count")
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"limit is 1 to {MOST_ROWS}, offset 0 or more")
    for name in [*(fields or []), *required, *(f for f, _ in filters)]:
        if name not in FIELDS and name != "organization":
            raise ValueError(f"unknown field: {name}")
    defaulted = year is None and not all_years and subject != "publications"
    if defaulted:
        year = latest_year(c, kind, period)

    def plan(y: int | None) -> DataFrame:
        metric = METRICS[subject]
        columns = fields or list(metric.columns)
        children = {metric.child, GROUPS[group_by][0] if group_by else None, FIELDS.get(distinct_field), *(FIELDS.get(f) for f in (*columns, *required)), *("contacts" if f == "organization" else FIELDS.get(f) for f, _ in filters)} - {None}
        df = scoped(base_rows(c), kind, y, period, chapter_no, section_no)
        df = df if subject == "publications" else df.where("stat_id IS NOT NULL")
        # Only the children that the request needs: an unused outer join would stay in the plan.
        for child in sorted(children):
            df = df.join(child_rows(c, child), "stat_id", "left")
        df = value_filter(df, filters)
        if operation == "count":
            counted = (distinct_field,) if distinct_field else metric.columns
            return df.agg(F.count_distinct("pub_id").alias("matched_publications"), distinct_count(df, counted).alias("value"))
        if operation == "breakdown":
            _, keys, label = GROUPS[group_by]
            for k in keys:
                df = df.where(present(df, k)) if k != "publication_year" else df
            labels = [F.min(label).alias(label)] if label else []
            return df.groupBy(*keys).agg(*labels, distinct_count(df, metric.columns).alias("value"))
        for name in required:
            df = df.where(present(df, name))
        df = df.select(*dict.fromkeys(columns))
        return df.distinct() if deduplicate else df

    rows, relaxed = plan(year), False
    empty = (lambda df: not df.first()["value"]) if operation == "count" else (lambda df: df.isEmpty())
    if defaulted and offset == 0 and empty(rows):
        rows, relaxed = plan(None), True
    every = None
    if operation == "list":
        every = rows
        order = [F.col(x).desc_nulls_last() if x == "publication_year" else F.col(x).asc_nulls_last() for x in rows.columns]
        rows = rows.orderBy(*order).offset(offset).limit(limit)
    elif operation == "breakdown":
        keys = GROUPS[group_by][1]
        rows = rows.orderBy(*[F.col(k).desc_nulls_last() if k == "publication_year" else F.col(k).asc_nulls_last() for k in keys]).limit(limit)
    m = METRICS[subject]
    return Answer(rows, m.definition, f"distinct {', '.join(m.columns)}", list(m.limitations), sorted({"publications", "statistics", *({m.child} - {None})}), ["the year was widened"] if relaxed else [], relaxed, every)
