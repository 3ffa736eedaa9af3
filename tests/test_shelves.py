"""Many editions of one load share files, and each still counts by itself."""

import pytest
from pyspark.sql import functions as F

from tallyloom.sources import catalog

N = 60


def tables(spark, years, first=0, note="old"):
    """One annual edition for each year, with two statistics and a footnote for each."""
    pubs = spark.createDataFrame([(first + y, "yearbook", "", y, None, f"t {y}", 3) for y in years], catalog.SCHEMAS["publications"])
    of = lambda y, i: (first + y) * 10 + i
    rows = [(of(y, i), first + y, "yearbook", y, "", f"r{i}", f"title {y} {i}") for y in years for i in (0, 1)]
    s = spark.createDataFrame(rows, "stat_id bigint, pub_id int, publication_kind string, year long, period string, ref_id string, title_ko string")
    notes = spark.createDataFrame([(r[0] * 10, r[0], 1, "1", note, *r[2:5]) for r in rows], catalog.SCHEMAS["footnotes"] + ", publication_kind string, year int, period string")
    return {"publications": pubs, "statistics": s, "footnotes": notes}


def state(c):
    rows = c.statistics.join(c.footnotes, "stat_id", "left").join(c.publications.select("pub_id", F.col("year").alias("of"), "period"), "pub_id", "left")
    return sorted((r["year"], r["of"], r["period"], r["stat_id"], r["title_ko"], r["content"]) for r in rows.collect())


def expected(years, first=0, note="old"):
    return [(y, y, "", (first + y) * 10 + i, f"title {y} {i}", note) for y in years for i in (0, 1)]


@pytest.mark.parametrize("shelf", [1000, 25])
def test_files_are_for_many_editions(spark, tmp_path, monkeypatch, shelf):
    monkeypatch.setattr(catalog, "SHELF", shelf, raising=False)
    years, path = list(range(2000, 2000 + N)), str(tmp_path)
    catalog.load_editions(tables(spark, years), path)
    assert state(catalog.Catalog.read(spark, path)) == expected(years)
    for name in ("publications", "statistics", "footnotes"):
        assert len(list((tmp_path / name).rglob("part-*.parquet"))) < N / 2


@pytest.mark.parametrize("shelf", [1000, 4])
def test_editions_that_share_files(spark, tmp_path, monkeypatch, shelf):
    monkeypatch.setattr(catalog, "SHELF", shelf, raising=False)
    path, none = str(tmp_path), spark.createDataFrame([], catalog.SCHEMAS["publications"])
    catalog.load_editions(tables(spark, range(2000, 2012)), path)
    before = catalog.Catalog.read(spark, path)
    # One of them is replaced with the ids that it had, one is removed.
    new = tables(spark, [2003], note="new")
    catalog.load_edition(none, new, path, "replace")
    catalog.remove_edition(spark, path, "yearbook", 2007)
    left = [y for y in range(2000, 2012) if y not in (2003, 2007)]
    now = sorted(expected(left) + expected([2003], note="new"))
    assert state(catalog.Catalog.read(spark, path)) == now and state(before) == expected(range(2000, 2012))
    # Ids of those that count are refused, those of the removed one are free.
    with pytest.raises(ValueError, match="ids of footnotes are taken"):
        catalog.load_editions(tables(spark, [2050], first=-48), path)
    with pytest.raises(ValueError, match="loaded already"):
        catalog.load_editions(tables(spark, [2004], first=100), path)
    # What counts moves away from what does not, which goes with its partition.
    assert catalog.vacuum(spark, path) > 0 and state(catalog.Catalog.read(spark, path)) == now and catalog.vacuum(spark, path) == 0
    kept = spark.read.parquet(f"{path}/statistics")
    assert kept.count() == 2 * len(left) + 2 and kept.where("year = 2007").count() == 0
    catalog.load_editions(tables(spark, [2007], note="again"), path)
    assert state(catalog.Catalog.read(spark, path)) == sorted(now + expected([2007], note="again"))
