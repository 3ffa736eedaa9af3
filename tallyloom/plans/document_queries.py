"""Queries that turn document archives into editions, with SQL over the tables that the archives were made from.

Customers stand in for statistics: those of one nation and one thousand keys are one yearbook, each market segment a section of it.
"""

from __future__ import annotations

import io
import itertools
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import archive, documents
from ..sources import catalog as cat
from ..sources.staging import scratch, written
from .queries import query, read

NAMES = '<hs:sec xmlns:hs="urn:section" xmlns:hp="urn:paragraph">'


def paragraph(text: str, page_break: bool = False) -> str:
    return f'<hp:p pageBreak="{int(page_break)}"><hp:run><hp:t>{escape(text)}</hp:t></hp:run></hp:p>'


def table(*rows: list[str], spans: dict[int, int] | None = None) -> str:
    """Rows of cell texts; spans: of rows with one cell the number of columns that it covers."""
    out = []
    for r, row in enumerate(rows):
        cells = [f'<hp:tc><hp:cellAddr colAddr="{c}" rowAddr="{r}"/><hp:cellSpan colSpan="{(spans or {}).get(r, 1)}" rowSpan="1"/><hp:subList>{paragraph(t)}</hp:subList></hp:tc>' for c, t in enumerate(row)]
        out.append(f"<hp:tr>{''.join(cells)}</hp:tr>")
    return f"<hp:p><hp:run><hp:tbl>{''.join(out)}</hp:tbl></hp:run></hp:p>"


def zipped(*sections: list[str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for k, parts in enumerate(sections):
            z.writestr(f"Contents/section{k}.xml", NAMES + "".join(parts) + "</hs:sec>")
    return out.getvalue()


def yearbook_archive(rows: pd.DataFrame) -> bytes:
    """Contents without the customers whose key 10 divides, then sections with a cover, a table without a heading, and the customers; the imprint; and a heading that is none."""
    rows = rows.sort_values(["section_no", "k"])
    lines, body = [], []
    for no, same in itertools.groupby(rows.itertuples(), lambda c: c.section_no):
        part = list(same)
        segment = part[0].c_mktsegment
        lines.append([f"제 {no} 절 부문{segment} 3", ""])
        body += [paragraph("", True), table([f"제 {no} 절"], [f"부문 {segment}"], [f"Segment {segment}"]), table(["가", "나"], ["1", "2"])]
        for c in part:
            title = f"고객{c.c_custkey}"
            if c.c_custkey % 10:
                lines.append([f"1-{no}-{c.k} {title} {c.k}", ""])
            body += [
                table([f"1-{no}-{c.k} {title} Customer No {c.c_custkey}"]), table(["(2024. 12. 31. 기준, 단위 : 원)"], ["구분", "잔액"], [c.c_name, f"{c.c_acctbal:.2f}"], spans={0: 2}),
                paragraph(f"주1) {c.c_name} 기준"), paragraph(f"- 계속 {c.c_custkey}"), paragraph(f"* 고객과 담당{c.c_custkey} 02-{100 + c.c_custkey % 900}-{1000 + c.c_custkey % 9000} / SYS{c.c_nationkey}"),
            ]
    body += [table(["발행처", "가"], ["인 쇄", "나"]), table(["1-9-1 없는 표제 None"])]
    return zipped([table(["1", "고객 통계 Customers"], *lines)], body)


def yearbooks(spark, d) -> tuple[DataFrame, DataFrame]:
    """(publications: doc, kind, year, period, title; archives: doc, content)."""
    c = read(spark, d, "customer").join(read(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    c = c.withColumns({"part": F.expr("c_custkey div 1000"), "doc": F.concat_ws("-", F.expr("c_custkey div 1000"), "c_nationkey")})
    segments = c.select("c_mktsegment").distinct().withColumn("section_no", F.expr("row_number() over (order by c_mktsegment)"))
    c = c.join(F.broadcast(segments), "c_mktsegment").withColumn("k", F.expr("row_number() over (partition by doc, c_mktsegment order by c_custkey)"))
    made = c.groupBy("doc").applyInArrow(lambda t: pa.table({"doc": t["doc"][:1], "content": [yearbook_archive(t.to_pandas())]}), "doc string, content binary")
    pubs = c.select("doc", F.concat(F.lit("yearbook_"), "part").alias("publication_kind"), (F.col("c_nationkey") + 1990).alias("year"), F.lit("").alias("period"), F.concat("n_name", F.lit(" 연보")).alias("title")).distinct()
    return pubs, made


def parsed(spark, d) -> tuple[DataFrame, dict[str, DataFrame]]:
    pubs, made = yearbooks(spark, d)
    return pubs, documents.yearbook(archive.archive_blocks(written(made, "archives"), "doc").withColumnRenamed("path", "doc"))


BOOKS = """WITH s AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) AS section_no FROM (SELECT DISTINCT c_mktsegment FROM customer)),
c AS (SELECT *, c_custkey // 1000 AS part, (c_custkey // 1000) || '-' || c_nationkey AS doc, row_number() OVER (PARTITION BY c_custkey // 1000, c_nationkey, c_mktsegment ORDER BY c_custkey) AS k FROM customer JOIN s USING (c_mktsegment)) """


@query(BOOKS + """SELECT 'yearbook_' || part AS publication_kind, CAST(1990 + c_nationkey AS INTEGER) AS year, '1-' || section_no || '-' || k AS ref_id,
CAST(row_number() OVER (PARTITION BY doc ORDER BY section_no, k) AS INTEGER) AS ordinal, '고객 통계' AS chapter, '부문 ' || c_mktsegment AS section, '고객' || c_custkey AS title_ko, 'Customer No ' || c_custkey AS title_en,
'원' AS unit, '2024.12.31.' AS base_date, CAST(1 + dense_rank() OVER (PARTITION BY doc ORDER BY section_no) AS INTEGER) AS page_start,
'{"columns":["구분","잔액"],"records":[{"구분":"' || c_name || '","잔액":"' || format('{:.2f}', c_acctbal) || '"}]}' AS body, '주1) ' || c_name || ' 기준 - 계속 ' || c_custkey AS note,
'고객과/담당' || c_custkey || '/02-' || (100 + c_custkey % 900) || '-' || (1000 + c_custkey % 9000) || '/SYS' || c_nationkey AS contact, CAST(1 AS BIGINT) AS n_of_id FROM c""")
def documents_to_editions(spark, d):
    """Archives parsed, given ids, loaded as editions in one go, and read again from disk."""
    pubs, parts = parsed(spark, d)
    path = scratch(spark, "editions")
    cat.load_editions(documents.editions(pubs, parts), path)
    c = cat.Catalog.read(spark, path)
    contact = F.concat_ws("/", "dept", "officer", "phone", "source_system").alias("contact")
    s = c.statistics.join(c.publications.select("pub_id", "publication_kind"), "pub_id").withColumn("n_of_id", F.count(F.lit(1)).over(cat.W.partitionBy("stat_id")))
    s = s.join(c.stat_tables.select("stat_id", "body"), "stat_id", "left").join(c.footnotes.select("stat_id", F.col("content").alias("note")), "stat_id", "left").join(c.contacts.select("stat_id", contact), "stat_id", "left")
    return s.select("publication_kind", "year", "ref_id", "ordinal", "chapter", "section", "title_ko", "title_en", "unit", "base_date", "page_start", "body", "note", "contact", "n_of_id")


@query(BOOKS + """SELECT doc, 'table_without_heading' AS found, count(DISTINCT section_no) AS n FROM c GROUP BY doc
UNION ALL SELECT doc, 'body_only', count(*) FROM c WHERE c_custkey % 10 = 0 GROUP BY doc""")
def document_faults(spark, d):
    """What is wrong with documents that were parsed: tables without a heading, and statistics that the contents lack."""
    _, parts = parsed(spark, d)
    found = parts["faults"].select("doc", F.col("fault").alias("found")).union(parts["differences"].select("doc", "difference"))
    return found.groupBy("doc", "found").agg(F.count(F.lit(1)).alias("n"))


def half_year_archive(rows: pd.DataFrame) -> bytes:
    """A cover and suppliers as items: one with a dated line that carries its data, one part with a table where the key is even, else with a line."""
    body = [paragraph("4"), paragraph("거래처")]
    for k, s in enumerate(rows.sort_values("s_suppkey").itertuples(), 1):
        body += [paragraph(f"거래처{s.s_suppkey}"), paragraph(f"4-{k}"), paragraph("('25.6.30.)"), paragraph("❍ 잔액"), paragraph("(단위 : 원)")]
        body += [table(["구분", "잔액"], [s.s_name, f"{s.s_acctbal:.2f}"]) if s.s_suppkey % 2 == 0 else paragraph(f"잔액은 {s.s_acctbal:.2f}원"), paragraph(f"❍ 번호 : {s.s_suppkey}")]
    return zipped(body)


@query("""WITH s AS (SELECT *, (s_suppkey // 1000) || '-' || s_nationkey AS doc, row_number() OVER (PARTITION BY s_suppkey // 1000, s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
SELECT doc, '4-' || k || '-1' AS ref_id, CAST(2 * k - 1 AS INTEGER) AS ordinal, '거래처' AS chapter, '거래처' || s_suppkey || ' 잔액' AS title_ko, '원' AS unit, '2025.6.30.' AS base_date,
  CASE WHEN s_suppkey % 2 = 0 THEN '{"columns":["구분","잔액"],"records":[{"구분":"' || s_name || '","잔액":"' || format('{:.2f}', s_acctbal) || '"}]}' ELSE '{"columns":["내용"],"records":[{"내용":"잔액은 ' || format('{:.2f}', s_acctbal) || '원"}]}' END AS body FROM s
UNION ALL SELECT doc, '4-' || k || '-2', CAST(2 * k AS INTEGER), '거래처', '거래처' || s_suppkey || ' 번호 : ' || s_suppkey, NULL, '2025.6.30.', '{"columns":["내용"],"records":[{"내용":"번호 : ' || s_suppkey || '"}]}' FROM s""")
def half_yearly_documents(spark, d):
    """Half-yearly collections to statistics and their tables."""
    s = read(spark, d, "supplier").withColumn("doc", F.concat_ws("-", F.expr("s_suppkey div 1000"), "s_nationkey"))
    made = s.groupBy("doc").applyInPandas(lambda f: pd.DataFrame({"doc": f["doc"].iloc[:1], "content": [half_year_archive(f)]}), "doc string, content binary")
    blocks = archive.archive_blocks(made, "doc").withColumnRenamed("path", "doc").withColumn("year", F.lit(2025))
    parts = documents.major_statistics(blocks)
    return parts["statistics"].join(parts["stat_tables"].select("doc", "ref_id", "body"), ["doc", "ref_id"], "left").select("doc", "ref_id", "ordinal", "chapter", "title_ko", "unit", "base_date", "body")
