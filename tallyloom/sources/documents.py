"""Whole documents to editions: from the blocks of archives to the catalogue's tables, for any number of documents at once.

A document's blocks are read in their order by windows over the document; documents are independent of one another. What
an archive holds is bounded by what one upload may hold, so a window over one is, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_label
from ..operators import cells as cell_ops
from ..operators import interpret
from . import parsing
from .catalog import assign_ids
from .staging import written

DOC, NO = "doc", "block_no"
REFERENCES = r"[0-9]+-[0-9]+-[0-9]+|" + parsing.APPENDIX + r"\s*[0-9]"


def described(blocks: DataFrame) -> DataFrame:
    """Blocks (doc, block_no, page, kind, text, cells) with what their tables are like: n_rows, n_cols, texts (of filled cells in order), plain."""
    table = F.col("kind") == "table"
    reach = lambda at, span: F.array_max(F.transform("cells", lambda c: c[at] + c[span]))
    order = F.array_sort(F.transform("cells", lambda c: F.struct(c["row"].alias("row"), c["col"].alias("col"), clean_label(c["text"]).alias("text"))))
    texts = F.filter(F.transform(order, lambda c: c["text"]), lambda t: t != "")
    return blocks.withColumns({
        "n_rows": F.when(table, F.coalesce(reach("row", "row_span"), F.lit(0))), "n_cols": F.when(table, F.coalesce(reach("col", "col_span"), F.lit(0))),
        "texts": F.when(table, texts), "plain": F.when(table, F.array_join(texts, " ")),
    })


def table_rows(tables: DataFrame) -> DataFrame:
    """doc, block_no, row, cells (texts in order): a row for each row of each table."""
    spans = tables.select(DOC, NO, F.inline("cells"))
    return spans.groupBy(DOC, NO, "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda c: c["text"]).alias("cells"))


def contents_of(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, block_no of the contents tables; their lines as parsing.contents gives them, chapter rows among them as kind chapter)."""
    tables = blocks.where("kind = 'table'")
    rows = table_rows(tables).withColumn("chapter", parsing.chapter_row(F.col("cells")))
    chaptered = rows.where("chapter IS NOT NULL").select(DOC, NO).distinct().withColumn("has_chapter", F.lit(True))
    marked = tables.select(DOC, NO, "plain").join(chaptered, [DOC, NO], "left")
    found = parsing.contents_run(marked, DOC, NO, F.coalesce("has_chapter", F.lit(False)) & F.col("plain").rlike(REFERENCES)).select(DOC, NO)
    inside = written(rows.join(found, [DOC, NO], "left_semi"), "contents")
    before = W.partitionBy(DOC).orderBy(NO, "row").rowsBetween(W.unboundedPreceding, 0)
    numbered = inside.withColumn("chapter_no", F.last("chapter.chapter_no", ignorenulls=True).over(before))
    lines = numbered.where("chapter IS NULL").select(DOC, NO, "row", "chapter_no", F.posexplode(F.split(F.array_join("cells", "\n"), "\n")).alias("place", "text"))
    lines = lines.withColumn("line_no", F.struct(NO, "row", "place")).where(F.trim("text") != "")
    read = parsing.contents(lines, DOC).select(DOC, "kind", "chapter_no", "section_no", "ref_id", "title", "title_en", "page")
    own = inside.where("chapter IS NOT NULL").select(DOC, F.lit("chapter").alias("kind"), "chapter.chapter_no", F.lit(None).cast("int").alias("section_no"), F.lit(None).cast("string").alias("ref_id"), F.col("chapter.ko").alias("title"), F.col("chapter.en").alias("title_en"), F.lit(None).cast("int").alias("page"))
    return inside.select(DOC, NO).distinct(), written(read.unionByName(own), "lines")


def scan(blocks: DataFrame, contents: DataFrame) -> DataFrame:
    """Blocks behind the contents and before the imprint, with role: cover, heading, data, paragraph or other; cover and heads where they have them.

    As many tables are passed over at the start as the contents have. `now` is the last event that says to which statistic content belongs: a
    cover ends the one before, a heading begins one.
    """
    order = W.partitionBy(DOC).orderBy(NO).rowsBetween(W.unboundedPreceding, 0)
    table = F.col("kind") == "table"
    skipped = contents.groupBy(DOC).agg(F.count(F.lit(1)).alias("n_contents"))
    body = blocks.withColumn("table_no", F.sum(table.cast("int")).over(order)).join(skipped, DOC, "left")
    body = body.where(~table | (F.col("table_no") > F.coalesce("n_contents", F.lit(0))))
    ended = F.max((table & parsing.is_imprint(F.coalesce("plain", F.lit("")))).cast("int")).over(order)
    body = body.withColumn("ended", ended).where("ended = 0")
    single = table & (F.col("n_cols") == 1)
    body = body.withColumns({"cover": F.when(single, parsing.section_cover(F.col("texts"))), "heads": F.when(single, F.filter(F.transform("texts", parsing.heading), lambda h: h.isNotNull()))})
    data = table & parsing.is_data_table(F.col("n_rows"), F.col("n_cols"), F.col("texts"))
    role = F.when(F.col("cover").isNotNull(), "cover").when(F.size("heads") > 0, "heading").when(data, "data").when(~table, "paragraph").otherwise("other")
    body = body.withColumn("role", role)
    event = F.when(F.col("role") == "cover", F.struct(F.lit(None).cast("string").alias("ref_id"))).when(F.col("role") == "heading", F.struct(F.element_at("heads", -1)["ref_id"].alias("ref_id")))
    return body.withColumn("now", F.last(event, ignorenulls=True).over(order)).drop("table_no", "n_contents", "ended")


def sections_of(body: DataFrame, lines: DataFrame) -> DataFrame:
    """doc, chapter_no, section_no, section: of a cover, by the first numbered heading behind it if that has its number; else of the contents."""
    order = W.partitionBy(DOC).orderBy(NO)
    numbered = F.get(F.filter("heads", lambda h: h["section_no"].isNotNull()), F.lit(0))
    marks = body.where("role = 'cover' OR role = 'heading'").select(DOC, NO, "cover", numbered.alias("h")).where("cover IS NOT NULL OR h IS NOT NULL")
    told = marks.withColumn("before", F.lag("cover").over(order)).where("h IS NOT NULL AND before.section_no = h.section_no AND h.chapter_no IS NOT NULL")
    covers = told.groupBy(DOC, "h.chapter_no", "h.section_no").agg(F.min_by("before.title", NO).alias("own"))
    listed = lines.where("kind = 'section'").groupBy(DOC, "chapter_no", "section_no").agg(F.first("title").alias("listed"))
    return covers.join(listed, [DOC, "chapter_no", "section_no"], "full").select(DOC, "chapter_no", "section_no", F.coalesce("own", "listed").alias("section"))


def table_bodies(data: DataFrame) -> DataFrame:
    """doc, block_no, caption, columns, records: data tables read by captions, grid, header rows and names, with spans spread out."""
    keys = [DOC, NO]
    spans = data.select(*keys, "n_cols", F.inline("cells"))
    captions = interpret.caption_rows(spans, keys, F.col("n_cols"))
    caption = captions.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: clean_label(x["text"])), " ").alias("caption"))
    grid = cell_ops.expand_spans(spans, keys).join(captions.select(*keys, F.col("row").alias("r")), [*keys, "r"], "left_anti")
    # Names, ends of headers and rows are all made of the grid.
    grid = written(grid.join(interpret.active_columns(spans, keys), [*keys, "c"], "left_semi"), "grid")
    long = interpret.grid_cells(grid, keys)
    rows = long.groupBy(*keys, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "column", "text"))).alias("row"))
    record = F.map_from_entries(F.transform("row", lambda c: F.struct(c["column"], F.coalesce(c["text"], F.lit("")))))
    body = rows.groupBy(*keys).agg(F.collect_list(F.struct("row_no", F.to_json(record).alias("record"))).alias("records"), F.min_by(F.transform("row", lambda c: c["column"]), "row_no").alias("columns"))
    return body.join(caption, keys, "left").select(*keys, "caption", "columns", F.transform(F.array_sort("records"), lambda r: r["record"]).alias("records"))


def _body_json(columns: Column, records: Column) -> Column:
    """{"columns": […], "records": […]}, from records that are JSON already."""
    return F.concat(F.lit('{"columns":'), F.to_json(columns), F.lit(',"records":['), F.array_join(records, ","), F.lit("]}"))


def yearbook(blocks: DataFrame) -> dict[str, DataFrame]:
    """statistics, stat_tables, footnotes, contacts (each with doc and ref_id), faults and differences from the contents of yearbooks.

    blocks: doc, block_no, page, kind, text, cells. A third level with fourth levels below it has no content of its own; data tables before any heading
    or behind a cover are left out and named in faults. Of contacts and notes that repeat as a page turns the first stays.
    """
    blocks = written(described(blocks), "blocks")
    found, lines = contents_of(blocks)
    body = written(scan(blocks, found), "body")
    heads = body.where("role = 'heading'").select(DOC, NO, "page", F.posexplode("heads").alias("place", "h")).withColumn("order", F.struct(NO, "place"))
    chapters = lines.where("kind = 'chapter'").groupBy(DOC, "chapter_no").agg(F.first("title").alias("chapter"))
    units = parsing.unit_titles(parsing.outline(heads.select(DOC, "order", "page", "h"), DOC, "order", chapters, sections_of(body, lines)))
    # A heading that comes again in English only, on a later page, gives the gloss that the first had not.
    gloss = heads.groupBy(DOC, F.col("h.ref_id").alias("ref_id")).agg(F.min_by("h.en", F.when(F.col("h.en").isNotNull(), F.col("order"))).alias("later_en"))
    units = written(units.join(gloss, [DOC, "ref_id"], "left").withColumn("title_en", F.coalesce("title_en", "later_en")).drop("later_en"), "units")
    own = body.withColumn("ref_id", F.col("now.ref_id")).join(units.select(DOC, "ref_id"), [DOC, "ref_id"])
    data = written(own.where("role = 'data'").select(DOC, NO, "ref_id", "n_rows", "n_cols", "plain", "cells"), "data")
    bodies = table_bodies(data).join(data.select(DOC, NO, "ref_id", "n_rows", "n_cols", "plain"), [DOC, NO])
    said = F.coalesce("caption", "plain")
    bodies = written(bodies.withColumns({"base_date": parsing.base_date(said), "unit": parsing.unit(said)}), "bodies")
    of_unit = W.partitionBy(DOC, "ref_id").orderBy(NO)
    tables = bodies.select(DOC, "ref_id", F.row_number().over(of_unit).alias("seq"), "caption", "n_rows", "n_cols", _body_json(F.col("columns"), F.col("records")).alias("body"))
    facts = parsing.first_values(bodies, [DOC, "ref_id"], NO, ["unit", "base_date"])
    statistics = units.join(facts, [DOC, "ref_id"], "left").select(
        DOC, "ref_id", "ordinal", "chapter_no", "section_no", "level3_no", "level4_no", "chapter", "section", "level3_title", "level4_title", "title_ko", "title_en", "unit", "base_date", "page_start",
    )
    # Whatever is not a paragraph breaks a note off.
    told = own.withColumn("text", F.when(F.col("role") == "paragraph", F.coalesce("text", F.lit(""))).otherwise("|"))
    footnotes = parsing.notes(told.select(DOC, "ref_id", NO, "text"), [DOC, "ref_id"])
    starred = own.where("role = 'paragraph' AND startswith(trim(text), '*')").select(DOC, "ref_id", NO, parsing.contact(F.trim("text")).alias("c")).where("c.phone IS NOT NULL OR c.dept IS NOT NULL")
    once = W.partitionBy(DOC, "ref_id", "c.dept", "c.officer", "c.phone").orderBy(NO)
    contacts = starred.withColumn("n", F.row_number().over(once)).where("n = 1").select(DOC, "ref_id", NO, "c.*")
    lost = body.where("role = 'data'").select(DOC, NO, F.col("now.ref_id").alias("ref_id")).join(units.select(DOC, "ref_id"), [DOC, "ref_id"], "left_anti")
    lost = lost.select(DOC, F.lit("table_without_heading").alias("fault"), "ref_id", F.col(NO).cast("string").alias("detail"))
    leaves = lines.where("kind IN ('level3', 'level4', 'appendix')").select(DOC, "ref_id", F.col("title").alias("title_ko"))
    above = leaves.where("ref_id RLIKE '-[0-9]+-[0-9]+-[0-9]+$'").select(DOC, F.regexp_replace("ref_id", "-[0-9]+$", "").alias("ref_id")).distinct()
    differences = parsing.reconcile(units, leaves.join(above, [DOC, "ref_id"], "left_anti"), [DOC])
    return {"statistics": statistics, "stat_tables": tables, "footnotes": footnotes, "contacts": contacts, "faults": parsing.unit_faults(units, tables, [DOC]).unionByName(lost), "differences": differences}


def major_statistics(blocks: DataFrame, year_col: str = "year") -> dict[str, DataFrame]:
    """statistics, stat_tables and footnotes (each with doc and ref_id) of half-yearly collections. blocks have the publication's year besides.

    Items are cut at their numbers; their parts are statistics. An item without a chapter's number, a reference, belongs to the chapter that is named so, else to
    the last one. A part without tables has its lines as a table of one column.
    """
    rows = written(described(blocks.where("kind <> 'paragraph' OR trim(text) <> ''")), "blocks")
    chapters = written(parsing.numbered_chapters(rows, DOC, NO), "chapters")
    of_references = chapters.groupBy(DOC).agg(
        F.coalesce(F.min(F.when(F.col("chapter").contains(parsing.REFERENCE), F.col("chapter_no"))), F.max("chapter_no")).alias("reference_chapter"), F.collect_set("chapter_no").alias("known"),
    )
    items = parsing.split_items(rows.join(of_references.select(DOC, "known"), DOC, "left"), DOC, NO, F.col("known"))
    items = written(items, "items")
    entries = rows.where("kind = 'paragraph'").select(DOC, NO, parsing.contents_line(F.col("text")).alias("e")).where("e IS NOT NULL").groupBy(DOC, F.col("e.ref_id").alias("item")).agg(F.min_by("e.page", NO).alias("printed"))
    inside = items.where("item IS NOT NULL AND role = 'body'")
    keys = [DOC, "item"]
    classified = written(parsing.classify(inside, keys, F.col(year_col), NO), "classified")
    units = parsing.units_of(classified, keys, "item", "item_title", F.col(year_col), NO)
    numbers = items.where("role = 'number'").select(DOC, "item", "chapter_no", "item_no", F.col(NO).alias("item_at"))
    whole = units.join(numbers, keys).join(of_references, DOC, "left").withColumn("chapter_no", F.coalesce("chapter_no", "reference_chapter")).join(chapters, [DOC, "chapter_no"], "left")
    whole = whole.join(entries, keys, "left").withColumn("page", F.coalesce("printed", "page"))
    whole = whole.withColumn("ordinal", F.row_number().over(W.partitionBy(DOC).orderBy("item_at", "at")))
    whole = written(whole, "units")
    statistics = whole.select(DOC, "ref_id", "ordinal", "chapter_no", F.col("item_no").alias("section_no"), "chapter", "level3_title", "level4_title", "title_ko", "unit", "base_date", F.col("page").alias("page_start"))
    part_of = classified.select(DOC, "item", NO, "part", "class").join(whole.select(DOC, "item", "at", "ref_id"), keys)
    # A part's statistic is that of the greatest start at or before the block.
    nearest = part_of.where(F.col("at") <= F.col(NO)).groupBy(DOC, NO, "class").agg(F.max_by("ref_id", "at").alias("ref_id"))
    data = inside.join(nearest.where("class = 'table'"), [DOC, NO])
    bodies = written(table_bodies(data).join(data.select(DOC, NO, "ref_id", "n_rows", "n_cols"), [DOC, NO]), "bodies")
    drawn = bodies.select(DOC, "ref_id", F.row_number().over(W.partitionBy(DOC, "ref_id").orderBy(NO)).alias("seq"), "caption", "n_rows", "n_cols", _body_json(F.col("columns"), F.col("records")).alias("body"))
    lines_only = whole.where("n_tables = 0 AND size(lines) > 0").select(DOC, "ref_id", F.lit(1).alias("seq"), F.lit(None).cast("string").alias("caption"), F.size("lines").alias("n_rows"), F.lit(1).alias("n_cols"), F.to_json(parsing.text_table(F.col("lines"))).alias("body"))
    footnotes = whole.select(DOC, "ref_id", F.posexplode("notes").alias("place", "content")).select(DOC, "ref_id", (F.col("place") + 1).alias("seq"), parsing.note_number(F.col("content")).alias("note_no"), "content")
    return {"statistics": statistics, "stat_tables": drawn.unionByName(lines_only), "footnotes": footnotes}


def editions(publications: DataFrame, parts: dict[str, DataFrame], first_pub: int = 0, first_stat: int = 0) -> dict[str, DataFrame]:
    """The catalogue's tables, with ids after the given ones, in the order of kind, year, period and place. publications: doc and what is known of each."""
    pubs = assign_ids(publications, ["publication_kind", "year", "period", DOC], "pub_id", first_pub)
    keyed = parts["statistics"].join(pubs.select(DOC, "pub_id", "publication_kind", "year", "period"), DOC)
    statistics = assign_ids(keyed, ["pub_id", "ordinal"], "stat_id", first_stat)
    edition = ["publication_kind", "year", "period"]
    known = statistics.select(DOC, "ref_id", "stat_id", *edition)
    out = {"publications": pubs, "statistics": statistics}
    for name, id_col, place in (("stat_tables", "table_id", "seq"), ("footnotes", "note_id", "seq"), ("contacts", "contact_id", NO)):
        if name in parts:
            out[name] = assign_ids(parts[name].join(known, [DOC, "ref_id"]), ["stat_id", place], id_col)
    return out
