"""Wrapped blocks folded and refused, and bodies read from cells."""

from pyspark.sql import functions as F

from tallyloom.operators import bodies


def grid(spark, tables):
    rows = [(k, r, c, t[0][c], text) for k, t in tables.items() for r, row in enumerate(t[1:]) for c, text in enumerate(row)]
    return spark.createDataFrame(rows, "k string, row_no int, col_no int, column string, text string")


def result(df):
    out = {}
    for r in df.orderBy("row_no", "col_no").collect():
        out.setdefault(r["k"], (r["folded"], {}))[1].setdefault(r["row_no"], []).append((r["column"], r["text"]))
    return {k: (folded, [tuple(v for v in row) for row in rows.values()]) for k, (folded, rows) in out.items()}


def test_folds_and_refusals(spark):
    head, base = ["구분", "1", "2"], [["a", "x", "y"], ["b", "z", "w"]]
    tables = {
        "two": [head, *base, ["구 분", "3", "4"], ["b", "p", "q"], ["a", "r", "s"], ["구분", "5", "6"], ["", "m", "n"]],
        "empty": [head, *base, ["구분", "3", "4"]], "unnamed": [head, *base, ["구분", "3", " "], ["a", "", ""]], "twice": [head, *base, ["구분", "3", "3"], ["a", "", ""]],
        "again": [head, *base, ["구분", "2", "4"], ["a", "", ""]], "too_long": [head, *base, ["구분", "3", "4"], ["a", "", ""], ["b", "", ""], ["c", "", ""]], "plain": [head, *base], "first": [head, ["구분", "1", "2"], *base],
        "short": [head, base[0], ["구분", "3", "4"]],
    }
    got = result(bodies.fold_wrapped(grid(spark, tables), ["k"]))
    assert got["two"] == (True, [(("구분", "a"), ("1", "x"), ("2", "y"), ("3", "r"), ("4", "s"), ("5", "m"), ("6", "n")), (("구분", "b"), ("1", "z"), ("2", "w"), ("3", "p"), ("4", "q"), ("5", ""), ("6", ""))])
    for k in tables.keys() - {"two"}:
        assert got[k] == (False, [tuple(zip(head, row)) for row in tables[k][1:]]), k


def test_from_cells_to_rows(spark):
    rows = [["시도별 인구", None, None], ["구분", "'23", "'24"], ["서울", "1", "2"], ["부산", "3", "4"], ["구분", "'25", "'26"], ["서울", "5", "6"], ["부산", "7", "8"]]
    spans = [("t", r, c, 1, 3 if r == 0 else 1, text, 3) for r, row in enumerate(rows) for c, text in enumerate(row) if text is not None]
    df = spark.createDataFrame(spans, "k string, row int, col int, row_span int, col_span int, text string, n_cols int")
    got = result(bodies.read_rows(df, ["k"], F.col("n_cols")))
    assert got["t"] == (True, [(("구분", "서울"), ("'23", "1"), ("'24", "2"), ("'25", "5"), ("'26", "6")), (("구분", "부산"), ("'23", "3"), ("'24", "4"), ("'25", "7"), ("'26", "8"))])
    stored = spark.createDataFrame([("s", '{"columns":["a","b"],"records":[{"a":" x ","b":"1"},{"a":"y"}]}'), ("bad", "no"), ("null", None)], "k string, body string")
    assert result(bodies.stored_rows(stored, ["k"])) == {"s": (False, [(("a", "x"), ("b", "1")), (("a", "y"), ("b", ""))])}
