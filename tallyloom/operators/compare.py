"""What changed between two editions."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import collapsed, match_key, simple_key
from ..sources.catalog import Catalog

MOST_ROWS = 500
OPERATIONS = ("summary", "only_in_base", "only_in_target", "in_both", "changed")


def edition_items(rows: DataFrame, key: Column, fields: list[str], order: list[str]) -> DataFrame:
    """One row for each key: match_key, the fields of its first record in the given order, and record_count of all."""
    keyed = rows.withColumn("match_key", key).where("match_key IS NOT NULL")
    first = W.partitionBy("match_key").orderBy(*[F.col(c).asc_nulls_last() for c in order])
    ranked = keyed.withColumn("_rank", F.row_number().over(first)).withColumn("record_count", F.count(F.lit(1)).over(W.partitionBy("match_key")))
    return ranked.where("_rank = 1").select("match_key", *fields, "record_count")


def changed_fields(base: str, target: str, fields: list[str], keys: dict[str, str] | None = None) -> Column:
    """Names of the fields that differ, in the given order; nulls equal nulls. keys: by field the column that is compared in its place."""
    pairs = [(f, (keys or {}).get(f, f)) for f in fields]
    names = [F.when(~F.col(f"{base}{k}").eqNullSafe(F.col(f"{target}{k}")), F.lit(f)) for f, k in pairs]
    return F.array_compact(F.array(*names)) if names else F.array().cast("array<string>")


def paired(base: DataFrame, target: DataFrame, fields: list[str], how: str) -> DataFrame:
    b = base.select(F.col("match_key").alias("b_key"), *[F.col(f).alias(f"base_{f}") for f in (*fields, "record_count")])
    t = target.select(F.col("match_key").alias("t_key"), *[F.col(f).alias(f"target_{f}") for f in (*fields, "record_count")])
    return b.join(t, F.col("b_key") == F.col("t_key"), how)


def summary(base: DataFrame, target: DataFrame, fields: list[str]) -> DataFrame:
    """One row of ten counts."""
    both = paired(base, target, fields, "full")
    inb, int_ = F.col("b_key").isNotNull(), F.col("t_key").isNotNull()
    differs = reduce(lambda a, b: a | b, [~F.col(f"base_{f}").eqNullSafe(F.col(f"target_{f}")) for f in fields], F.lit(False))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return both.agg(
        zero(F.count_if(inb)).alias("base_items"), zero(F.count_if(int_)).alias("target_items"), zero(F.sum("base_record_count")).alias("base_records"), zero(F.sum("target_record_count")).alias("target_records"),
        zero(F.count_if(inb & int_)).alias("in_both"), zero(F.count_if(inb & ~int_)).alias("only_in_base"), zero(F.count_if(~inb & int_)).alias("only_in_target"),
        zero(F.count_if(inb & int_ & differs)).alias("changed"), zero(F.count_if(F.col("base_record_count") > 1)).alias("base_merged"), zero(F.count_if(F.col("target_record_count") > 1)).alias("target_merged"),
    )


def compare(base: DataFrame, target: DataFrame, operation: str, fields: list[str], compare_on: list[str] | None = None, keys: dict[str, str] | None = None) -> DataFrame:
    """base and target: edition_items of two editions. compare_on: fields that tell a change, instead of those shown; keys: what is compared in a field's place."""
    if operation not in OPERATIONS:
        raise ValueError(f"unknown operation: {operation}")
    on, keys = fields if compare_on is None else compare_on, keys or {}
    if operation == "summary":
        return summary(base, target, [keys.get(f, f) for f in on])
    if operation in ("only_in_base", "only_in_target"):
        one, other = (base, target) if operation == "only_in_base" else (target, base)
        return one.join(other.select("match_key"), "match_key", "left_anti")
    both = paired(base, target, list(dict.fromkeys([*fields, *(keys.get(f, f) for f in on)])), "inner").withColumn("changed_fields", changed_fields("base_", "target_", on, keys))
    both = both.withColumnRenamed("b_key", "match_key").drop("t_key")
    return both.where(F.size("changed_fields") > 0) if operation == "changed" else both


def fold_contacts(contacts: DataFrame, key: str = "stat_id", columns: tuple[str, ...] = ("dept", "officer", "source_system")) -> DataFrame:
    """One row for each key: the distinct values of each column in order, joined by bars; null if there are none."""
    return contacts.groupBy(key).agg(*[F.nullif(F.array_join(F.array_sort(F.collect_set(collapsed(F.col(c)))), " | "), F.lit("")).alias(c) for c in columns])


def first_contact(contacts: DataFrame, key: str = "stat_id", value: str = "dept", order: str = "contact_id") -> DataFrame:
    """The first value of each key that isn't blank."""
    return contacts.where(F.trim(F.col(value)) != "").groupBy(key).agg(F.min_by(value, order).alias(value))


def choose_editions(editions: list[tuple[int, str]], base: tuple[int, str] | None, target: tuple[int, str] | None) -> tuple[tuple[int, str], tuple[int, str]]:
    """editions, newest first. What isn't given is the neighbour of what is; without either, the two newest."""
    if base is None and target is None:
        if len(editions) < 2:
            raise ValueError("two editions are needed")
        return editions[1], editions[0]
    for e in (base, target):
        if e is not None and e not in editions:
            raise ValueError(f"no such edition: {e}")
    at = editions.index(base if base is not None else target)
    if base is None:
        if at + 1 >= len(editions):
            raise ValueError("no earlier edition")
        return editions[at + 1], target
    if target is None:
        if at == 0:
            raise ValueError("no later edition")
        return base, editions[at - 1]
    return base, target


def edition_of(editions: list[tuple[int, str]], asked: int | tuple[int, str | None] | None, side: str) -> tuple[int, str] | None:
    """The loaded edition that a year, or a year and period, names. A year of two editions is an error that names both."""
    if asked is None:
        return None
    year, period = asked if isinstance(asked, tuple) else (asked, None)
    found = [e for e in editions if e[0] == year and period in (None, e[1])]
    names = lambda some: ", ".join(f"{y} {p}".strip() for y, p in some)
    if not found:
        raise ValueError(f"{side}: no edition of {year} {period or ''}; loaded are {names(editions)}")
    if len(found) > 1:
        raise ValueError(f"{side}: {year} has the editions {names(found)}; name a period")
    return found[0]


@dataclass(frozen=True)
class Subject:
    """What of an edition is compared: keys to match by, fields shown, order of a list, fields never compared, and fields compared by their match key."""

    keys: dict[str, Column]
    fields: tuple[str, ...]
    default: tuple[str, ...]
    order: tuple[str, ...]
    never: tuple[str, ...] = ()
    by_key: tuple[str, ...] = ()

    def compared(self, fields: list[str], compare_fields: list[str] | None) -> list[str]:
        return [f for f in dict.fromkeys(fields if compare_fields is None else compare_fields) if f not in self.never]


def subject_rows(c: Catalog, subject: str) -> tuple[DataFrame, Subject]:
    """Rows of all editions (with pub_id), and how they are compared."""
    s = c.statistics
    if subject == "statistics":
        rows = s.join(fold_contacts(c.contacts).withColumnRenamed("dept", "organization"), "stat_id", "left").withColumn("statistic_title", F.col("title_ko"))
        title, unit = match_key(F.col("title_ko")), F.coalesce(match_key(F.col("unit")), F.lit(""))
        keys = {"title": title, "number": simple_key(F.col("ref_id")), "title_and_unit": F.concat(title, F.lit("|"), unit)}
        own = ("ref_id", "chapter", "section", "level3_title", "level4_title", "statistic_title", "unit", "base_date", "organization", "officer", "source_system")
        default = ("stat_id", "ref_id", "chapter", "statistic_title", "unit", "page_start")
        return rows, Subject(keys, ("stat_id", *own, "page_start"), default, ("page_start", "stat_id"), ("stat_id", "page_start"), ("organization", "source_system"))
    if subject == "chapters":
        return s, Subject({"title": match_key(F.col("chapter")), "number": simple_key(F.col("chapter_no").cast("string"))}, ("chapter_no", "chapter"), ("chapter_no", "chapter"), ("chapter_no",))
    if subject == "sections":
        number = F.concat(F.col("chapter_no").cast("string"), F.lit("-"), F.col("section_no").cast("string"))
        fields = ("chapter_no", "section_no", "section", "chapter")
        return s, Subject({"title": match_key(F.col("section")), "number": number}, fields, fields[:3], fields[:2])
    if subject in ("organizations", "source_systems"):
        one, col = subject[:-1], "dept" if subject == "organizations" else "source_system"
        rows = s.select("stat_id", "pub_id").join(c.contacts, "stat_id")
        return rows.withColumn("_name", collapsed(F.col(col))).drop(one).withColumnRenamed("_name", one), Subject({"title": match_key(F.col(one))}, (one,), (one,), (one,))
    raise ValueError(f"unknown subject: {subject}")


def compare_editions(
    c: Catalog, operation: str, subject: str = "statistics", match_by: str = "title", kind: str = "yearbook", base=None, target=None, fields: list[str] | None = None, compare_fields: list[str] | None = None
) -> DataFrame:
    """compare for two editions of the catalogue, each named by year, or year and period, or left to be chosen. Ids and page numbers tell no change."""
    p = c.publications.where(F.col("publication_kind") == kind)
    editions = sorted((tuple(r) for r in p.select("year", F.coalesce("period", F.lit(""))).distinct().collect()), reverse=True)  # some tens of rows
    sides = choose_editions(editions, edition_of(editions, base, "base"), edition_of(editions, target, "target"))
    rows, spec = subject_rows(c, subject)
    if match_by not in spec.keys:
        raise ValueError(f"{subject} can't be matched by {match_by}")
    for f in (*(fields or ()), *(compare_fields or ())):
        if f not in spec.fields:
            raise ValueError(f"{subject} have no field {f}")
    show = list(dict.fromkeys(fields or spec.default))
    on = spec.compared(show, compare_fields)
    keys = {f: f"{f}_key" for f in on if f in spec.by_key}
    rows = rows.withColumns({k: match_key(F.col(f)) for f, k in keys.items()})

    def items(edition) -> DataFrame:
        chosen = p.where((F.col("year") == edition[0]) & (F.coalesce("period", F.lit("")) == edition[1])).select("pub_id")
        needed = list(dict.fromkeys([*show, *on, *keys.values(), *spec.order]))
        return edition_items(rows.join(chosen, "pub_id", "left_semi"), spec.keys[match_by], needed, list(dict.fromkeys([*spec.order, *show])))

    return compare(items(sides[0]), items(sides[1]), operation, list(dict.fromkeys([*show, *spec.order])), on, keys)


@dataclass
class Page:
    """Rows of a list from offset on; total and what follows from it are counted once they are asked for."""

    rows: DataFrame
    every: DataFrame
    limit: int
    offset: int

    @cached_property
    def total(self) -> int:
        return self.every.count()

    @property
    def truncated(self) -> bool:
        return self.next_offset is not None

    @property
    def next_offset(self) -> int | None:
        return self.offset + self.limit if self.offset + self.limit < self.total else None


def compare_page(c: Catalog, operation: str, subject: str = "statistics", limit: int = MOST_ROWS, offset: int = 0, **asked) -> Page:
    """A page of what compare_editions lists, in the order of the base edition (of the only one there is), nulls last."""
    if operation not in OPERATIONS[1:] or not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"a list operation, limit 1 to {MOST_ROWS}, offset 0 or more")
    every = compare_editions(c, operation, subject, **asked)
    spec = subject_rows(c, subject)[1]
    side = "base_" if operation in ("in_both", "changed") else ""
    shown = [f for f in (asked.get("fields") or spec.default)]
    hidden = [x for x in every.columns if x.removeprefix("base_").removeprefix("target_") in {*spec.fields, *(f"{f}_key" for f in spec.fields)} - set(shown)]
    ordered = every.orderBy(*[F.col(f"{side}{f}").asc_nulls_last() for f in spec.order], "match_key")
    return Page(ordered.offset(offset).limit(limit).drop(*hidden), every, limit, offset)
