"""The catalogue's tables: schemas, reading, loading editions, deleting and verifying."""

from __future__ import annotations

import hashlib
import json
import math
import re
import uuid
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import text_tokens
from .staging import written

KINDS = ("yearbook", "major_statistics")
PERIODS = ("", "H1", "H2")
# Other spellings of the halves of a year.
PERIOD_ALIASES = {"": "", "none": "", "annual": "", "h1": "H1", "1h": "H1", "first_half": "H1", "상반기": "H1", "h2": "H2", "2h": "H2", "second_half": "H2", "하반기": "H2"}

SCHEMAS = {
    "publications": "pub_id int, publication_kind string, period string, year int, pub_no string, title string, page_count int",
    "embedding_profiles": "profile_key string, provider string, model string, revision string, content_version string, dimension int, max_length int, normalized boolean, created_at timestamp",
    "statistics": "stat_id bigint, pub_id int, year int, ref_id string, ordinal int, chapter_no int, section_no int, level3_no int, level4_no int, chapter string, section string, level3_title string, level4_title string, "
    "title_ko string, title_en string, unit string, base_date string, page_start int, embedding array<float>, embedding_profile_key string",
    "stat_tables": "table_id bigint, stat_id bigint, seq int, caption string, n_rows int, n_cols int, body string, table_md string",
    "table_search_chunks": "chunk_id bigint, stat_id bigint, table_id bigint, chunk_no int, chunk_kind string, search_labels array<string>, search_text string, embedding array<float>, embedding_profile_key string",
    "footnotes": "note_id bigint, stat_id bigint, seq int, note_no string, content string",
    "contacts": "contact_id bigint, stat_id bigint, dept string, officer string, phone string, source_system string, source_url string",
    "embedding_jobs": "job_id bigint, source_name string, profile_key string, status string, force_reembed boolean, target_count int, processed_count int, max_source_id bigint, error_message string, started_at timestamp, finished_at timestamp",
}
CHILDREN = ("stat_tables", "table_search_chunks", "footnotes", "contacts")
IDS = {"publications": "pub_id", "statistics": "stat_id", "stat_tables": "table_id", "table_search_chunks": "chunk_id", "footnotes": "note_id", "contacts": "contact_id"}
EDITION = ("publication_kind", "year", "period")
#: Under a catalogue's path: a row for each edition that was loaded (with the version and the shelf its tables were written under) or removed (without them), the last turn counts.
SWITCHES = "switches"
SWITCH_SCHEMA = "publication_kind string, year int, period string, version string, shelf int, turn long"
#: Editions of one load that share a partition, about: files are for so many, not for each.
SHELF = 1000


def period_of(value: str | None) -> str:
    found = PERIOD_ALIASES.get((value or "").strip().lower())
    if found is None:
        raise ValueError(f"unknown period: {value}")
    return found


def kinds_of(scope: str | None) -> tuple[str, ...]:
    scope = (scope or "all").strip()
    if scope == "all":
        return KINDS
    if scope not in KINDS:
        raise ValueError(f"unknown kind of publication: {scope}")
    return (scope,)


@dataclass(frozen=True)
class Catalog:
    """The catalogue's tables as DataFrames."""

    publications: DataFrame
    statistics: DataFrame
    stat_tables: DataFrame
    footnotes: DataFrame
    contacts: DataFrame
    chunks: DataFrame | None = None

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Catalog:
        """All tables at one state: what is loaded or removed after this doesn't show."""
        live = live_state(spark, path)
        return cls(*(read_table(spark, path, n, live) for n in ("publications", "statistics", "stat_tables", "footnotes", "contacts", "table_search_chunks")))


def duplicates(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Keys that occur more than once, with the values of label under them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(F.array_sort(F.collect_set(F.col(label).cast("string"))), ",").alias("labels")).where("n_rows > 1")


def assign_ids(new: DataFrame, order: list[str], id_col: str, start: int = 0) -> DataFrame:
    """Consecutive ids in a fixed order, so that reruns agree. Ranks are counted within ranges of the order, not in one task.

    The ranges are a written table: planned twice, for the rows and for the ranges' sizes, they need not be cut alike, and ids would repeat and differ from table to table.
    """
    empty = [f.name for f in new.schema if isinstance(f.dataType, T.NullType)]  # no file can hold these
    ranged = new.drop(*empty).repartitionByRange(*order).sortWithinPartitions(*order)
    table = written(ranged.withColumn("_g", F.monotonically_increasing_id()), "numbered").withColumn("_part", F.shiftright("_g", 33))
    # One row for each partition.
    sizes = table.groupBy("_part").agg(F.min("_g").alias("_first"), F.count(F.lit(1)).alias("_n"))
    bases = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    numbered = table.join(F.broadcast(bases), "_part").withColumn(id_col, F.col("_g") - F.col("_first") + F.col("_base") + start + 1)
    return numbered.select(*[F.lit(None).alias(c) if c in empty else F.col(c) for c in new.columns if c != id_col], id_col)


def check_edition(statistics: DataFrame, year: int) -> list[str]:
    """What is wrong with the statistics of one edition before it is loaded; one aggregation. Columns that aren't given aren't checked."""
    missing = [c for c in ("ref_id", "title_ko") if c not in statistics.columns]
    faults = statistics.withColumns({c: F.monotonically_increasing_id().cast("string") for c in missing}).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(F.trim("ref_id"), F.lit("")) == "").alias("no_ref"), F.count_if(F.coalesce(F.trim("title_ko"), F.lit("")) == "").alias("no_title"),
        (F.count("ref_id") - F.count_distinct("ref_id")).alias("repeated"),
    ).first()
    out = [] if 1900 <= year <= 2100 else [f"year {year} is out of range"]
    out += ["no statistics"] if not faults["n"] else []
    out += [f"{faults[k]} {what}" for k, what in (("no_ref", "without a reference"), ("no_title", "without a title"), ("repeated", "repeat a reference")) if faults[k]]
    return out


def conform(df: DataFrame, name: str) -> DataFrame:
    """The columns of a table of the catalogue in their order and types; those that are missing are null."""
    fields = T.StructType.fromDDL(SCHEMAS[name])
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What is written under path, without rows if nothing is."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def _versions(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table with every version that was ever written, finished or not, and the columns of its editions and partitions. With `_shelve` the only place that knows how editions are written."""
    fields = {f.name: f for f in T.StructType.fromDDL(SCHEMAS[name])}
    parts = T.StructType.fromDDL("publication_kind string, year int, period string, version string, shelf int")
    return _stored(spark, f"{path}/{name}", T.StructType([*fields.values(), *(f for f in parts if f.name not in fields)]))


def _place() -> Column:
    return F.concat_ws("/", "version", "shelf")


def _shelf(shelves: int) -> Column:
    """The shelf of an edition in a load of so many shelves."""
    return F.pmod(F.xxhash64("publication_kind", F.col("year").cast("int"), F.coalesce("period", F.lit(""))), F.lit(shelves)).cast("int").alias("shelf")


def _shelve(rows: DataFrame, name: str, path: str, version: str, shelves: int) -> None:
    """Write rows of many editions (with publication_kind, year and period) under a version: a shelf is a partition, tasks have ranges of shelves, editions and ids."""
    keyed = rows.withColumns({"year": F.col("year").cast("int"), "period": F.coalesce("period", F.lit(""))})
    order = ["shelf", *EDITION, IDS[name]]
    fields = [f for f in T.StructType.fromDDL(SCHEMAS[name]) if f.name not in EDITION]
    own = [(F.col(f.name) if f.name in keyed.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    table = keyed.select(*own, *EDITION, _shelf(shelves))
    table.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("shelf").parquet(f"{path}/{name}/version={version}")


@dataclass(frozen=True)
class State:
    """What counts at one moment: the editions, with version and shelf, and the partitions that they are in."""

    editions: DataFrame
    places: list[str]


def _switches(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/{SWITCHES}", T.StructType.fromDDL(SWITCH_SCHEMA))


def live_state(spark: SparkSession, path: str) -> State:
    """Of each edition the version that was switched to last, unless it was removed. A text for each partition comes to the driver; the editions stay a table, of the files that there are now."""
    last = F.max_by(F.struct("version", "shelf"), F.struct("turn", "version")).alias("last")
    editions = _switches(spark, path).groupBy(*EDITION).agg(last).where("last.version IS NOT NULL").select(*EDITION, "last.*")
    return State(editions, [r[0] for r in editions.select(_place()).distinct().collect()])


def _switch(editions: DataFrame, path: str, version: str | None, shelves: int = 1) -> None:
    """Point these editions to a version, all at once: one file is added."""
    turn = _switches(editions.sparkSession, path).agg(F.coalesce(F.max("turn"), F.lit(0)) + 1).first()[0]
    shelf = _shelf(shelves) if version else F.lit(None).cast("int").alias("shelf")
    rows = editions.select("publication_kind", F.col("year").cast("int").alias("year"), F.coalesce("period", F.lit("")).alias("period"), F.lit(version).cast("string").alias("version"), shelf, F.lit(turn).cast("long").alias("turn"))
    rows.coalesce(1).write.mode("append").parquet(f"{path}/{SWITCHES}")


def _rows_of(spark: SparkSession, path: str, name: str, live: State) -> DataFrame:
    """Rows of the editions of a state. Its partitions are a filter, so only their files are read; editions that count no more may share a partition with some that do."""
    rows, e = _versions(spark, path, name).where(_place().isin(live.places)), live.editions
    return rows.join(e, reduce(lambda a, b: a & b, [rows[c].eqNullSafe(e[c]) for c in (*EDITION, "version")]), "left_semi")


def read_table(spark: SparkSession, path: str, name: str, live: State | None = None) -> DataFrame:
    """A table of the catalogue under path, without rows if no edition is loaded. live: what counts, that of the moment if not given."""
    return conform(_rows_of(spark, path, name, live or live_state(spark, path)), name)


def taken_ids(new: dict[str, DataFrame], path: str, live: State) -> list[str]:
    """Which of the new tables have ids that rows of these editions have already; one job."""
    spark = new["publications"].sparkSession
    given = {name: key for name, key in IDS.items() if name in new and key in new[name].columns}
    met = [
        new[name].select(key).join(read_table(spark, path, name, live).select(key), key, "left_semi").limit(1).select(F.lit(f"ids of {name} are taken").alias("fault"))
        for name, key in given.items()
    ]
    return sorted(r[0] for r in reduce(DataFrame.unionByName, met).collect()) if met and live.places else []


def editions_of(publications: DataFrame) -> list[tuple[str, int, str]]:
    """Kind, year and period of the publications: a row for each edition."""
    p = publications.select("publication_kind", F.col("year").cast("int").alias("year"), F.coalesce("period", F.lit("")).alias("period")).distinct()
    return [tuple(r) for r in p.collect()]


def load_edition(publications: DataFrame, new: dict[str, DataFrame], path: str, mode: str = "reject") -> None:
    """Check one edition's tables and write them under its partition of kind, year and period. publications: those that are loaded.

    reject: an edition that is there stays, and this fails; replace: it gives way with all its children, also where
    the new one has none. Tables are written under a version of their own, and one added row makes that the one that counts. So readers see the old edition or the new
    one, never parts of both; a load that breaks off changes nothing and can be repeated. Ids that another edition has are refused.
    """
    if mode not in ("reject", "replace"):
        raise ValueError(f"unknown mode: {mode}")
    spark = publications.sparkSession
    editions = editions_of(new["publications"].limit(2))
    if len(editions) != 1 or new["publications"].count() != 1:
        raise ValueError("one publication is loaded at a time")
    kind, year, period = editions[0]
    if not re.fullmatch(r"\w+", kind) or period not in PERIODS:
        raise ValueError(f"no such edition: {kind} {year} {period}")
    faults = check_edition(new["statistics"], year)
    if faults:
        raise ValueError("; ".join(faults))
    loaded = conform(publications, "publications").unionByName(read_table(spark, path, "publications"))
    if mode == "reject" and editions[0] in editions_of(loaded):
        raise ValueError("the edition is loaded already")
    live = live_state(spark, path)
    own = (F.col("publication_kind") == kind) & (F.col("year") == year) & (F.col("period") == period)
    faults = taken_ids(new, path, State(live.editions.where(~own), live.places))
    if faults:
        raise ValueError("; ".join(faults))
    version = uuid.uuid4().hex
    edition = [F.lit(kind).alias("publication_kind"), F.lit(year).cast("int").alias("year"), F.lit(period).alias("period")]
    for name in (*CHILDREN, "statistics", "publications"):
        if name in new:
            conform(new[name], name).drop(*EDITION).select("*", *edition).write.parquet(f"{path}/{name}/version={version}/shelf=0")
    _switch(spark.createDataFrame(editions, "publication_kind string, year int, period string"), path, version)


def load_editions(new: dict[str, DataFrame], path: str) -> None:
    """Check and write any number of new editions at once. Rows carry publication_kind, year and period; an edition that is there already is refused.

    Each table is one job that writes a new version, about SHELF editions to a partition; then one added file makes all the editions count at once. What broke off shows nowhere, and
    the next try is written beside it. Ids that a loaded edition has are refused.
    """
    spark = new["publications"].sparkSession
    edition, live, version = list(EDITION), live_state(spark, path), uuid.uuid4().hex
    pubs = new["publications"].select(*edition)
    faults = [f"{r['publication_kind']} {r['year']} {r['period']} comes more than once" for r in pubs.groupBy(*edition).count().where("count > 1").limit(5).collect()]
    faults += [f"no such edition: {r['publication_kind']} {r['year']} {r['period']}" for r in pubs.where(~F.coalesce(F.col("publication_kind").rlike("^[0-9A-Za-z_]+$") & F.col("period").isin(*PERIODS) & F.col("year").between(1900, 2100), F.lit(False))).limit(5).collect()]
    faults += [f"{tuple(r)} is loaded already" for r in pubs.join(read_table(spark, path, "publications", live).select(*edition), edition, "left_semi").limit(5).collect()]
    named = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    each = new["statistics"].groupBy(*edition).agg(F.count_if(named("ref_id")).alias("no_ref"), F.count_if(named("title_ko")).alias("no_title"), (F.count("ref_id") - F.count_distinct("ref_id")).alias("repeated"))
    checked = pubs.join(each, edition, "left").where("no_ref IS NULL OR no_ref > 0 OR no_title > 0 OR repeated > 0")
    faults += [f"{tuple(r)[:3]}: no statistics, or references or titles that lack or repeat" for r in checked.limit(5).collect()]
    faults = faults or taken_ids(new, path, live)
    if faults:
        raise ValueError("; ".join(faults))
    shelves = max(1, math.ceil(pubs.count() / SHELF))
    for name in (*CHILDREN, "statistics", "publications"):
        if name in new:
            _shelve(new[name], name, path, version, shelves)
    _switch(pubs, path, version, shelves)


def remove_edition(spark: SparkSession, path: str, kind: str, year: int, period: str = "") -> None:
    """An edition counts no more, in any table at once; its files stay until `vacuum`."""
    _switch(spark.createDataFrame([(kind, year, period)], "publication_kind string, year int, period string"), path, None)


def _apart(spark: SparkSession, path: str, live: State) -> State:
    """Editions that share a partition with some that count no more move to a version of their own, all at once. The state after that."""
    shared = _switches(spark, path).where("version IS NOT NULL").select(*EDITION, "version", "shelf").join(live.editions, [*EDITION, "version"], "left_anti")
    mixed = live.editions.join(shared.select("version", "shelf").distinct(), ["version", "shelf"], "left_semi").select(*live.editions.columns)
    moving = State(mixed, [r[0] for r in mixed.select(_place()).distinct().collect()])
    if not moving.places:
        return live
    version, shelves = uuid.uuid4().hex, math.ceil(mixed.count() / SHELF)
    for name in (*CHILDREN, "statistics", "publications"):
        _shelve(_rows_of(spark, path, name, moving), name, path, version, shelves)
    _switch(mixed, path, version, shelves)
    return live_state(spark, path)


def vacuum(spark: SparkSession, path: str) -> int:
    """Empty the partitions of versions that don't count: replaced, removed or broken off. Their number. No load may run meanwhile, nor a reader of an older state."""
    live, n = _apart(spark, path, live_state(spark, path)), 0
    for name in ("publications", "statistics", *CHILDREN):
        for version, shelf in _versions(spark, path, name).where(~_place().isin(live.places)).select("version", "shelf").distinct().collect():
            empty = spark.createDataFrame([], T.StructType([f for f in _versions(spark, path, name).schema if f.name not in ("version", "shelf")]))
            empty.write.mode("overwrite").parquet(f"{path}/{name}/version={version}/shelf={shelf}")
            n += 1
    return n


def children_of(units: DataFrame) -> dict[str, DataFrame]:
    """From statistics with arrays tables, chunks, footnotes and contacts (of structs): the four child tables, each with stat_id."""
    arrays = {"stat_tables": "tables", "table_search_chunks": "chunks", "footnotes": "footnotes", "contacts": "contacts"}
    return {name: units.select("stat_id", F.inline(array)) for name, array in arrays.items() if array in units.columns}


SEARCHED = ("title_ko", "title_en", "chapter", "section", "level3_title", "level4_title", "unit")


def search_doc(*columns: str) -> Column:
    """Distinct lower-case words of the given columns, in order; nulls are empty."""
    return F.array_sort(F.array_distinct(text_tokens(F.concat_ws(" ", *(columns or SEARCHED)))))


def profile_key(provider: str, model: str, revision: str, dimension: int, max_length: int, content_version: str, normalized: bool = True) -> str:
    """SHA-256 of what tells one way to make vectors from another, as JSON with sorted keys and without blanks."""
    identity = dict(provider=provider, model=model, revision=revision, dimension=dimension, max_length=max_length, content_version=content_version, normalized=normalized)
    return hashlib.sha256(json.dumps(identity, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def add_profiles(profiles: DataFrame, new: DataFrame) -> DataFrame:
    """profiles and those of new whose key isn't there yet, each once; what is there stays as it is."""
    first = new.dropDuplicates(["profile_key"]).join(profiles.select("profile_key"), "profile_key", "left_anti")
    return profiles.unionByName(first.select(*profiles.columns))


def in_editions(rows: DataFrame, publications: DataFrame, kinds: tuple[str, ...] = KINDS, year: int | None = None, period: str | None = None) -> DataFrame:
    """Rows (with pub_id) of the chosen editions."""
    chosen = publications.where(F.col("publication_kind").isin(*kinds))
    for name, value in (("year", year), ("period", None if period is None else period_of(period))):
        chosen = chosen if value is None else chosen.where(F.col(name) == value)
    return rows.join(chosen.select("pub_id"), "pub_id", "left_semi")


def newest_first(rows: DataFrame, *order: str, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return out if limit is None else out.limit(limit)


def page_after(rows: DataFrame, id_col: str, after: int, last: int, n: int) -> DataFrame:
    """The n rows that follow an id, up to a last one that was fixed before the first page."""
    return rows.where((F.col(id_col) > after) & (F.col(id_col) <= last)).orderBy(id_col).limit(n)


def embed_missing(rows: DataFrame, id_col: str, text_col: str, profile: str, embed, batch: int = 16) -> DataFrame:
    """id, embedding, embedding_profile_key for rows whose vector is missing or of another profile; embed gives vectors of a list of texts.

    One pass over the rows instead of page after page; vectors that aren't finite fail the job.
    """

    def run(frames):
        for f in frames:
            for at in range(0, len(f), batch):
                part = f.iloc[at : at + batch]
                vectors = [[float(x) for x in v] for v in embed(part["text"].tolist())]
                if len(vectors) != len(part) or not all(math.isfinite(x) for v in vectors for x in v):
                    raise ValueError("the model gave no finite vector for each text")
                yield pd.DataFrame({"id": part["id"].to_numpy(), "embedding": vectors, "embedding_profile_key": profile})

    todo = stale_vectors(rows, profile).select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return todo.mapInPandas(run, "id long, embedding array<float>, embedding_profile_key string").withColumnRenamed("id", id_col)


# Fixed value: what stands for a title that isn't there.
UNTITLED = "(제목 없음)"


def _joined(*parts: Column) -> Column:
    text = F.array_join(F.array_distinct(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != ""))), " ")
    return F.coalesce(F.nullif(F.trim(text), F.lit("")), F.lit(UNTITLED))


def title_text() -> Column:
    """What the title's vector is made of."""
    return _joined(F.col("title_ko"), F.col("title_en"))


def hierarchy_text() -> Column:
    """What the vector of the place in the book is made of: chapter, section and third level, without the title itself."""
    return _joined(*[F.when(~F.col(c).eqNullSafe(F.col("title_ko")), F.col(c)) for c in ("chapter", "section", "level3_title")])


def without_publications(catalog: Catalog, pub_ids: list[int]) -> tuple[Catalog, DataFrame]:
    """The catalogue without these editions and all that hangs on them, and the number of rows that go from each table."""
    gone = catalog.statistics.where(F.col("pub_id").isin(pub_ids)).select("stat_id")
    parts, counts = {}, []
    for name in ("stat_tables", "footnotes", "contacts", "chunks"):
        df = getattr(catalog, name)
        if df is not None:
            parts[name] = df.join(gone, "stat_id", "left_anti")
            counts.append(df.join(gone, "stat_id", "left_semi").agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")))
    statistics = catalog.statistics.where(~F.col("pub_id").isin(pub_ids))
    publications = catalog.publications.where(~F.col("pub_id").isin(pub_ids))
    counts.append(gone.agg(F.lit("statistics").alias("table_name"), F.count(F.lit(1)).alias("n_rows")))
    total = counts[0]
    for c in counts[1:]:
        total = total.union(c)
    return Catalog(publications, statistics, parts["stat_tables"], parts["footnotes"], parts["contacts"], parts.get("chunks")), total


def orphan_profiles(profiles: DataFrame, *users: DataFrame) -> DataFrame:
    """Profiles that none of the tables names."""
    for u in users:
        profiles = profiles.join(u.select("profile_key").where("profile_key IS NOT NULL").distinct(), "profile_key", "left_anti")
    return profiles


def update_vectors(statistics: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Vectors put in by natural key, nulls equal to nulls. Rows without a vector keep what they have."""
    new = vectors.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("embedding").alias("_v"), F.col("embedding_profile_key").alias("_p"))
    on = F.lit(True)
    for k in keys:
        on = on & statistics[k].eqNullSafe(new[f"_{k}"])
    out = statistics.join(new, on, "left")
    return out.withColumn("embedding", F.coalesce("_v", "embedding")).withColumn("embedding_profile_key", F.coalesce("_p", "embedding_profile_key")).drop("_v", "_p", *[f"_{k}" for k in keys])


def stale_vectors(statistics: DataFrame, profile: str) -> DataFrame:
    """Rows whose vector is missing or of another profile."""
    return statistics.where(F.col("embedding").isNull() | ~F.col("embedding_profile_key").eqNullSafe(F.lit(profile)))


def keep_vector_if_same(old: DataFrame, new: DataFrame, key: str, text_cols: list[str]) -> DataFrame:
    """On an update, a vector stays only with unchanged text."""
    o = old.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in text_cols], F.col("embedding").alias("_v"))
    same = F.lit(True)
    for c in text_cols:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = new.drop("embedding").join(o, F.col(key) == F.col("_k"), "left")
    return joined.withColumn("embedding", F.when(same, F.col("_v"))).drop("_k", "_v", *[f"_{c}" for c in text_cols])


def verification(catalog: Catalog) -> DataFrame:
    """Rows of each table, and of those that point nowhere."""
    out = None
    for name in ("stat_tables", "footnotes", "contacts"):
        df = getattr(catalog, name)
        lost = df.join(catalog.statistics, "stat_id", "left_anti").agg(F.count(F.lit(1)).alias("lost"))
        one = df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows")).crossJoin(lost)  # one row each
        out = one if out is None else out.union(one)
    return out
