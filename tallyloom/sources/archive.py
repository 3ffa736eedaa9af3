"""Document archives (zipped XML sections) as rows of blocks, one document a task step."""

from __future__ import annotations

import glob
import io
import itertools
import os
import re
import zipfile
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BLOCKS = "path string, block_no int, section int, page int, kind string, text string, cells array<struct<row:int,col:int,row_span:int,col_span:int,text:string>>"


CELL = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("text", pa.string())])


@lru_cache(1024)
def bare(tag: str) -> str:
    return tag.rpartition("}")[2]


def local(e) -> str:
    return bare(e.tag)


def sections(z: zipfile.ZipFile) -> list[str]:
    """Section files in the order of their numbers."""
    found = [(int(m[1]), n) for n in z.namelist() if (m := re.search(r"section(\d+)\.xml$", n))]
    return [n for _, n in sorted(found)]


def own_text(p) -> str:
    """Text of a paragraph's runs, without that of tables and boxes in it."""
    out = []
    for e in p:
        if local(e) in ("run", "t"):
            out.append(e.text or "" if local(e) == "t" else own_text(e))
            if local(e) == "t":
                out += [(c.text or "") + (c.tail or "") for c in e]
    return "".join(out)


def table_cells(tbl) -> list[dict]:
    """Cells with their place and span; a cell without an address stands at the next free place of its row."""
    out, taken = [], set()
    for r, tr in enumerate(e for e in tbl if local(e) == "tr"):
        c = 0
        for tc in (e for e in tr if local(e) == "tc"):
            addr, span, texts = None, None, []
            for e in tc.iter():
                name = local(e)
                if name == "p":
                    texts.append(own_text(e).strip())
                elif name == "cellAddr" and addr is None:
                    addr = e
                elif name == "cellSpan" and span is None:
                    span = e
            while (r, c) in taken:
                c += 1
            row, col = (int(addr.get("rowAddr", r)), int(addr.get("colAddr", c))) if addr is not None else (r, c)
            rs, cs = (int(span.get("rowSpan", 1)), int(span.get("colSpan", 1))) if span is not None else (1, 1)
            taken |= {(row + i, col + j) for i in range(rs) for j in range(cs)}
            out.append({"row": row, "col": col, "row_span": rs, "col_span": cs, "text": " ".join(filter(None, texts))})
    return out


def walk(e, boxes: bool):
    """Texts of paragraphs and tables in document order; boxes: go into text boxes as well."""
    for child in e:
        kind = local(child)
        if kind == "p":
            if child.get("pageBreak") == "1":
                yield "page", None
            if text := own_text(child).strip():
                yield "paragraph", text
            yield from walk(child, boxes)
        elif kind == "tbl":
            yield "table", child
        elif boxes or kind not in ("drawText", "rect", "container"):
            yield from walk(child, boxes)


#: Bytes of a section file that are read at once.
PIECE = 1 << 16


def section_blocks(stream, boxes: bool):
    """Paragraphs, tables and page breaks of one section file, read piece by piece; elements below its root are let go when they are whole."""
    parser, root = ElementTree.XMLPullParser(("start",)), None
    while piece := stream.read(PIECE):
        parser.feed(piece)
        for _, e in parser.read_events():
            root = e if root is None else root
        if root is not None:
            whole = root[:-1]  # the last one may go on
            del root[:-1]
            yield from walk(whole, boxes)
    parser.close()
    yield from walk(() if root is None else root, boxes)


def blocks_of(content, boxes: bool = True):
    """section, page, kind, text, cells of each block. content: an archive's bytes, or a file of them."""
    page = 1
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as z:
        for s, name in enumerate(sections(z)):
            with z.open(name) as stream:
                for kind, e in section_blocks(stream, boxes):
                    if kind == "page":
                        page += 1
                    elif kind == "paragraph":
                        yield s, page, kind, e, None
                    else:
                        yield s, page, kind, None, table_cells(e)


#: Blocks that a task hands on at once.
AT_ONCE = 2000


def archive_blocks(files: DataFrame, path_col: str = "path", content_col: str = "content", boxes: bool = True) -> DataFrame:
    """One row for each block of each archive, of archives in a column of bytes. An archive is read by one task, and leaves it in parts, small ones together. Null content has no blocks."""

    def numbered(batch):
        for name, content in zip(batch.column(0), batch.column(1), strict=True):
            if content.is_valid:
                for i, b in enumerate(blocks_of(content.as_py(), boxes)):
                    yield name.as_py(), i, *b

    def run(batches):
        for batch in batches:
            rows = numbered(batch)
            while some := list(itertools.islice(rows, AT_ONCE)):
                columns = [pa.array(c, k) for c, k in zip(zip(*some, strict=True), (batch.column(0).type, *[pa.int32()] * 3, *[pa.string()] * 2, pa.list_(CELL)), strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "block_no", "section", "page", "kind", "text", "cells"])

    return files.select(F.col(path_col).alias("path"), F.col(content_col).alias("content")).mapInArrow(run, BLOCKS)


def read_blocks(spark: SparkSession, path: str, boxes: bool = True) -> DataFrame:
    """One row for each block of each archive under path, in any store that Spark reads."""
    return archive_blocks(spark.read.format("binaryFile").load(path).select("path", "content"), boxes=boxes)


class OneArchive(InputPartition):
    """A partition: the path of one archive."""


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.boxes = options.get("path", ""), options.get("boxes", "true").lower() == "true"

    def partitions(self):
        found = sorted(glob.glob(os.path.join(self.path, "**", "*.hwpx"), recursive=True)) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [OneArchive(p) for p in found]

    def read(self, partition):
        if partition is None:
            return
        for i, (section, page, kind, text, cells) in enumerate(blocks_of(partition.value, self.boxes)):
            yield partition.value, i, section, page, kind, text, cells and [tuple(c.values()) for c in cells]


class ArchiveSource(DataSource):
    """spark.read.format("hwpx").load(folder): one partition for each archive of a folder that driver and executors share; blocks are streamed out of the file, which is never whole in memory."""

    @classmethod
    def name(cls):
        return "hwpx"

    def schema(self):
        return BLOCKS

    def reader(self, schema):
        return ArchiveReader(self.options)


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Paragraph-like pieces of HTML with their place; built-in functions only."""
    bare = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    pieces = F.split(F.regexp_replace(bare, r"(?i)</?(p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|title|head|body|html|section|article|nav|footer|header)\b[^>]*>", "\x01"), "\x01")
    text: Column = F.trim(F.regexp_replace(F.regexp_replace(F.col("piece"), "<[^>]*>", ""), r"\s+", " "))
    rows = pages.select(id_col, F.posexplode(pieces).alias("block_no", "piece")).withColumn("text", text)
    return rows.where("text <> ''").select(id_col, "block_no", "text")
