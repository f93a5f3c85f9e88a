"""Filters, sorts, diffs, edits, recalculation, sources, streams."""

import math
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lattica.operators import batch, table
from lattica.parser import FormulaError, parse
from lattica.plans import ordered
from lattica.recalc import Model, data_table, with_overrides
from lattica.sheet import Sheet, Workbook
from lattica.sources import text, xlsx
from lattica.streaming import stream


@pytest.fixture(scope="module")
def rivers(spark):
    """Name, length in km, whether it reaches a sea; a last row without anything."""
    rows = [(1, "Isar", 292.0, False), (2, "Elbe", 1094.0, True), (3, "Inn", 517.0, False), (4, "Weser", 451.0, True), (5, "Kleine Elbe", 24.5, False), (6, None, None, None)]
    return Sheet("R", spark.createDataFrame(rows, "_row bigint, river string, km double, sea boolean"), row="_row")


@pytest.mark.parametrize(("predicate", "want"), [
    ("B > 300", [2, 3, 4]), ("km < 500 AND NOT sea = TRUE", [1, 5]), ("river LIKE '%elbe'", [2, 5]), ("River = 'ISAR'", [1]), ("KM BETWEEN 292 AND 517", [1, 3, 4]), ("B IN (24.5, 451, 7)", [4, 5]), ("C IS EMPTY", [6]), ("A IS NOT EMPTY", [1, 2, 3, 4, 5]),
    ("B != 517", [1, 2, 4, 5]), ("NOT B = 517", [1, 2, 4, 5, 6]), ("km = 'long'", []), ("NOT km = 'long'", [1, 2, 3, 4, 5, 6]), ("(km < 100 OR km > 1000) AND river NOT LIKE 'K%'", [2]), ("A LIKE 'In_'", []), ("A LIKE 'in%'", [3]),
])
def test_filter(rivers, predicate, want):
    assert sorted(r._row for r in table.filter_sheet(rivers, predicate).collect()) == want


@pytest.mark.parametrize("predicate", ["Z > 1", "B BETWEEN 1 AND 'x'", "B >", "B > 1 extra", "NOT"])
def test_bad_filters(rivers, predicate):
    with pytest.raises(FormulaError):
        table.filter_sheet(rivers, predicate)


def test_columns_limit_sort(rivers):
    assert table.filter_sheet(rivers, "B > 0", "C,A:B", 2).columns == ["_row", "sea", "river", "km"]
    assert [r._row for r in table.sort_sheet(rivers, [("km", False)]).collect()] == [5, 1, 4, 3, 2, 6]
    assert [r._row for r in table.sort_sheet(rivers, [("km", True)]).collect()] == [6, 2, 3, 4, 1, 5]


def test_stats_bounds_search_view(rivers):
    s = table.stats(rivers).first()
    assert (s["column"], s["count"], s["sum"], s["min"], s["max"]) == ("km", 5, 2378.5, 24.5, 1094.0)
    b = table.bounds(rivers).first()
    assert (b.min_row, b.max_row, b.max_col, b.n_cells) == (1, 5, 3, 15)
    wb = Workbook()
    wb.add(rivers)
    assert {(r._row, r._col) for r in table.search(wb, "^E|51").collect()} == {(2, 1), (3, 2), (4, 2)}
    assert [tuple(r) for r in table.view(rivers, "A2:B3").orderBy("_row").collect()] == [(2, "Elbe", 1094.0), (3, "Inn", 517.0)]


def test_diff_put_clear_edit(rivers):
    new = rivers.with_df(rivers.df.where("_row != 2").withColumn("km", F.when(F.col("_row") == 1, 1.0).otherwise(F.col("km"))))
    got = {(r._row, r._col, r.status) for r in table.diff(rivers, new).collect()}
    assert got == {(1, 2, "changed"), (2, 1, "removed"), (2, 2, "removed"), (2, 3, "removed")}
    assert table.clear(rivers, "B1:B9").df.where("km IS NOT NULL").count() == 0
    assert sorted(r._row for r in table.delete_rows(table.insert_rows(rivers, 2, 2), 1, 1).df.collect()) == [3, 4, 5, 6, 7]
    assert table.delete_column(table.insert_column(rivers, 2, "New"), 1).columns == ["New", "km", "sea"]


@pytest.mark.parametrize(("formula", "at", "count", "want"), [("=A5+B2", 3, 2, "=(A7+B2)"), ("=A5", 5, -1, "=#REF!"), ("=SUM(A1:A9)", 3, -2, "=SUM(A1:A7)"), ("=SUM(A3:A4)", 3, -2, "=SUM(#REF!)"), ("=SUM($A$1:A4)", 4, -3, "=SUM($A$1:A3)")])
def test_restructure(formula, at, count, want):
    assert table.restructure(formula, at, count) == want


def test_fill_text():
    assert table.fill_text("=A1+$B$1+C$2", 2, 1) == "=((B3+$B$1)+D$2)"
    assert table.fill_text("=A1", -1) == "=#REF!"


def test_recalc_order_cycles_and_blocks(spark):
    wb = Workbook()
    wb.add(Sheet("S", spark.createDataFrame([(1, 2.0), (2, 3.0)], "_row bigint, a double"), row="_row"))
    m = Model(wb)
    m.set("S", "b", "=A1*2")
    m.set("S", "c", "=D1+1")
    m.set("S", "d", "=B1+1")
    m.set("S", "e", "=F1")
    m.set("S", "f", "=E1")
    m.set("S", "g", "=E1+1")
    r = m.recalculate()
    assert [tuple(x) for x in wb.sheet("S").df.select("b", "c", "d").orderBy("b").collect()] == [(4.0, 6.0, 5.0), (6.0, 8.0, 7.0)]
    assert r.cycles and set(r.errors) == {("s", "g")}
    assert m.precedents(("s", "c"), True) == {("s", "d"), ("s", "b")} and m.dependents(("s", "b")) == {("s", "d")}


def test_iteration_and_recurrence(spark):
    wb = Workbook()
    wb.add(Sheet("S", spark.createDataFrame([(1, 10.0), (2, 20.0)], "_row bigint, cost double"), row="_row"))
    m = Model(wb)
    m.set("S", "price", "=A1+C1")
    m.set("S", "fee", "=B1*50%")
    assert m.recalculate(iterate=True).converged
    assert [round(r.price, 1) for r in wb.sheet("S").df.orderBy("_row").collect()] == [20.0, 40.0]
    wb.add(Sheet("T", spark.range(1, 6).select(F.col("id").alias("_row"), F.col("id").cast("double").alias("x")), ["x"], "_row"))
    m = Model(wb, base_row=2)
    m.set("T", "bal", "=B1+A2")
    m.set("T", "cap", "=MIN(C1+A2,6)")
    m.recalculate()
    assert [(r.bal, r.cap) for r in wb.sheet("T").df.orderBy("_row").collect()] == [(1, 1), (3, 3), (6, 6), (10, 6), (15, 6)]


def test_errors_in_recurrences(spark):
    """An error stays an error, in its own row and in all that it reaches."""
    wb = Workbook()
    wb.add(Sheet("T", spark.createDataFrame([(1, 2.0, "x"), (2, 4.0, "y"), (3, 0.0, "z"), (4, 5.0, "w")], "_row bigint, a double, t string"), row="_row"))
    m = Model(wb, base_row=2)
    m.set("T", "inverse", "=1/A2")
    m.set("T", "sum", "=D1+C2")
    m.set("T", "least", "=MIN(1/A2,99)+E1*2")
    m.set("T", "safe", "=IFERROR(MIN(1/A2,99),0)+F1*2")
    m.set("T", "grown", "=EXP(G1*0)+LN(2)")
    m.set("T", "words", "=H1+B2")
    assert not m.recalculate().errors
    rows = [r.asDict() for r in wb.sheet("T").df.orderBy("_row").collect()]
    assert [(r["inverse"], r["inverse__err"]) for r in rows] == [(0.5, None), (0.25, None), (None, "#DIV/0!"), (0.2, None)]
    assert [(r["sum"], r["sum__err"]) for r in rows] == [(0.5, None), (0.75, None), (None, "#DIV/0!"), (None, "#DIV/0!")]
    assert [(r["least"], r["least__err"]) for r in rows] == [(0.5, None), (1.25, None), (None, "#DIV/0!"), (None, "#DIV/0!")]
    assert [r["safe"] for r in rows] == [0.5, 1.25, 2.5, 5.2] and all(abs(r["grown"] - 1 - math.log(2)) < 1e-12 for r in rows)
    assert [(r["words"], r["words__err"]) for r in rows] == [(None, "#VALUE!")] * 4
    m = Model(wb, base_row=2)
    m.set("T", "odd", "=VLOOKUP(I1,A:A,1)+A2")
    assert list(m.recalculate().errors) == [("t", "odd")]


def test_recurrence_functions_agree_with_compiled_ones(spark):
    """The row evaluator against the same formulas as Spark columns."""
    from lattica.plans import interpret

    formulas = ["ROUND(A1,1)", "ROUNDUP(A1,1)", "ROUNDDOWN(A1,1)", "MOD(A1,3)", "FLOOR(A1,0.5)", "CEILING(A1,0.5)", "MROUND(A1,0.5)", "TRUNC(A1)", "INT(A1)", "SIGN(A1)", "SQRT(A1)", "LN(A1)", "LOG(A1,2)", "POWER(A1,3)", "A1^0.5", "EXP(A1)", "PMT(0.1,10,A1)", "FV(0.1,10,A1)", "PV(0,10,A1,5,1)", "LEFT(B1,2)&RIGHT(B1,1)", "MID(B1,2,2)", "LEN(B1)", "UPPER(B1)", "IF(A1>1,A1,-A1)", "IFS(A1>5,1,A1>0,2)", "SWITCH(B1,\"ab\",1,2)", "CHOOSE(2,A1,B1)", "IFERROR(1/A1,B1)", "ISERROR(LN(A1))", "A1&B1", "B1>\"b\"", "A1%", "10/A1", "ISBLANK(A1)", "ISTEXT(B1)", "MAX(A1,2)+MIN(A1,2)", "AND(A1>0,TRUE)", "B1+1"]
    cells = [(1.25, "abc"), (-2.5, "ab"), (0.0, " x "), (7.75, "12"), (None, None)]
    wb = Workbook()
    wb.add(Sheet("S", spark.createDataFrame([(i + 1, *c) for i, c in enumerate(cells)], "_row bigint, a double, b string"), row="_row"))
    rows = [r.asDict() for r in wb.fill_all("S", {f"f{i}": "=" + f for i, f in enumerate(formulas)}, errors=True).df.orderBy("_row").collect()]
    bad = []
    for row, (a, b) in zip(rows, cells, strict=True):
        for i, f in enumerate(formulas):
            got = interpret.run(parse(f), lambda ref: (a, b)[ref.col - 1])
            got = got.code if isinstance(got, interpret.Error) else got
            want = row.get(f"f{i}__err") or row[f"f{i}"]
            same = abs(got - want) < 1e-9 if isinstance(got, int | float) and isinstance(want, int | float) else got == want or (isinstance(want, str) and isinstance(got, float) and interpret.text(got) == want)
            if not same:
                bad.append((f, a, b, got, want))
    assert not bad, bad


def test_what_if(spark):
    wb = Workbook()
    wb.add(Sheet("S", spark.createDataFrame([(1, 2.0), (2, 3.0)], "_row bigint, a double"), row="_row"))
    assert {tuple(r) for r in data_table(wb, "S", "=SUM(A:A)*C1+C2", {"C1": [1, 10], "C2": [0, 1]}).collect()} == {(1, 0, 5), (1, 1, 6), (10, 0, 50), (10, 1, 51)}
    assert wb.eval(with_overrides("=A1*10+A2", {"A1": 7})).first().value == 73


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=40), st.integers(-3, 0), st.integers(0, 3), st.integers(1, 7))
def test_windows_in_buckets(spark, xs, lo, hi, size):
    df = spark.createDataFrame(list(enumerate(xs)), "r bigint, x int")
    run = ordered.running(df, "r", {"s": ("sum", F.col("x")), "m": ("max", F.col("x"))}, bucket_rows=size).orderBy("r").collect()
    assert [(r.s, r.m) for r in run] == [(sum(xs[: i + 1]), max(xs[: i + 1])) for i in range(len(xs))]
    slid = ordered.sliding(df, "r", lo, hi, {"s": F.sum("x")}, size).orderBy("r").collect()
    assert [r.s for r in slid] == [sum(xs[max(0, i + lo) : i + hi + 1]) for i in range(len(xs))]


def test_numbering_and_ranks_with_ties(spark):
    df = spark.createDataFrame([(x % 7, x) for x in range(50)], "k int, v int")
    assert [(r.k, r.v) for r in ordered.numbered(df, ["k", "v"]).orderBy("_row").collect()] == sorted((x % 7, x) for x in range(50))
    got = {r.k: r["rank"] for r in ordered.ranks(df.withColumn("d", F.col("k").cast("double")), "d", "rank").collect()}
    assert got == {k: 1 + sum(x % 7 > k for x in range(50)) for k in range(7)}


def test_csv_types(spark, tmp_path):
    (tmp_path / "a.csv").write_text('n,b,d,m,t\n1,true,2024-01-02,1,x\n2,FALSE,2024-02-03,2,"y, z"\n3,true,2024-03-04,3,\n4,true,2024-03-05,4,q\n5,true,2024-03-06,oops,q\n')
    df = text.read_csv(spark, str(tmp_path / "a.csv")).df
    assert dict(df.dtypes) == {"n": "double", "b": "boolean", "d": "date", "m": "double", "m__text": "string", "t": "string"}
    assert [r.m__text for r in df.orderBy("n").collect()][-1] == "oops"


def test_csv_misfit_after_the_sample(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,d,k\n" + "".join(f"{i},2024-01-02,{i}\n" for i in range(50)) + "n/a,soon,50\n,2024-01-03,51\n")
    df = text.read_csv(spark, str(tmp_path / "a.csv")).df
    assert df.columns == ["n", "n__text", "d", "d__text", "k"]
    assert [(r.n, r.n__text, r.d, r.d__text) for r in df.where("n__text IS NOT NULL OR d__text IS NOT NULL").collect()] == [(None, "n/a", None, "soon")]
    assert df.where("n IS NULL").count() == 2



def test_markdown(spark):
    sheet = text.read_markdown(spark, "| a | b |\n|---|:-:|\n| 1 | x\\|y |\n| 2 |  |")
    assert [tuple(r) for r in sheet.df.collect()] == [(1, "1", "x|y"), (2, "2", None)]
    assert text.markdown(sheet.df.select("a", "b")).splitlines()[2] == "| 1 | x\\|y |"


def test_xlsx(spark, tmp_path):
    df = spark.createDataFrame([(1, "é & <b>", 1.5, True), (2, "=danger", None, False)], "_row bigint, t string, n double, f boolean").withColumn("d", F.expr("TIMESTAMP_NTZ'2024-03-15 12:00:00'"))
    path = str(tmp_path / "b.xlsx")
    xlsx.write_xlsx({"One": df, "Two": df.limit(0)}, f"file://{path}")
    assert xlsx.sheets_of(spark, path) == ["One", "Two"]
    back = xlsx.read_sheet(spark, path, "One").df.orderBy("_row").collect()
    assert [(r.t, r.n, r.f, str(r.d)) for r in back] == [("é & <b>", 1.5, True, "2024-03-15 12:00:00"), ("'=danger", None, False, "2024-03-15 12:00:00")]
    assert xlsx.read_cells(spark, path, "One", rows=(2, 2), cols=(1, 1)).count() == 1
    with pytest.raises(Exception, match="cells"):
        xlsx.read_cells(spark, path, cells=2).count()


def test_xlsx_foreign_parts(spark, tmp_path):
    """Shared strings, shared formulas, date styles, errors, as other writers make them."""
    path = tmp_path / "f.xlsx"
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>plain</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" s="1"><v>45366</v></c><c r="D1" t="e"><v>#N/A</v></c></row><row r="2"><c r="A2"><f t="shared" ref="A2:A3" si="0">B2*$C$1</f><v>2</v></c></row><row r="3"><c r="A3"><f t="shared" si="0"/><v>3</v></c></row></sheetData></worksheet>')
    got = {(r._row, r._col): r for r in xlsx.read_cells(spark, str(path)).collect()}
    assert got[1, 2].txt == "rich" and str(got[1, 3].ts) == "2024-03-15 00:00:00" and got[1, 4].err == "#N/A"
    assert got[2, 1].formula == "B2*$C$1" and got[3, 1].formula == "(B3*$C$1)"


def test_streams(spark, sf):
    path = f"{sf}/events.parquet"
    events = spark.read.parquet(path)
    src = lambda: stream.source(spark, f"{sf}/*", events.schema, pathGlobFilter="events.parquet")
    assert stream.drain(stream.filtered(src(), "value > 50"), "t_filter").count() == events.where("value > 50").count()
    got = {r["column"]: r["count"] for r in stream.drain(stream.stats(src(), "E"), "t_stats", "complete").collect()}
    assert got == {"value": events.count()}


def test_batch(spark):
    wb = Workbook()
    wb.add(Sheet("S", spark.createDataFrame([(1, 2.0), (2, 3.0)], "_row bigint, a double"), row="_row"))
    batch.run(wb, '[{"op": "put", "sheet": "S", "ref": "A1", "value": 5}, {"op": "put", "sheet": "S", "ref": "A3", "value": 1}, {"op": "define_name", "name": "rate", "text": "=2"}, {"op": "fill", "sheet": "S", "column": "b", "formula": "=A1*rate"}, {"op": "add_sheet", "from": "S", "sheet": "T"}, {"op": "delete_rows", "sheet": "T", "at": 1}, {"op": "rename_sheet", "sheet": "T", "to": "U"}]')
    assert [tuple(r) for r in wb.sheet("S").df.select("_row", "a", "b").orderBy("_row").collect()] == [(1, 5.0, 10.0), (2, 3.0, 6.0), (3, 1.0, 2.0)]
    assert [r._row for r in wb.sheet("u").df.orderBy("_row").collect()] == [1, 2]
    with pytest.raises(FormulaError):
        batch.run(wb, [{"op": "nothing"}])


def test_ordered_iteration_and_view(rivers):
    assert [(r._row, r._col) for r in table.cells_sorted(rivers).collect()][:4] == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert [(r._row, r._col) for r in table.columns_sorted(rivers).collect()][4:7] == [(5, 1), (1, 2), (2, 2)]
    assert [(r._row, len(r.cells)) for r in table.rows_sorted(rivers).collect()] == [(i, 3) for i in range(1, 6)]
    assert [r._row for r in table.view(rivers, "A5:C6", skip_empty=True).collect()] == [5] and table.view(rivers, "A5:C6").count() == 2


def test_put_ranges(rivers):
    out = table.put_range(rivers, "A1:B2", ["Lech", 256.0, "Naab", 98.5])
    assert [(r.river, r.km) for r in out.df.orderBy("_row").collect()][:3] == [("Lech", 256.0), ("Naab", 98.5), ("Inn", 517.0)]
    assert [r.km for r in table.put_column(rivers, 2, 6, [1.0, 2.0]).df.orderBy("_row").collect()][-2:] == [1.0, 2.0]
    assert table.put_row(rivers, 2, 1, ["Ilm", 3.0, None]).df.where("_row = 2").first()[1:] == ("Ilm", 3.0, None)
    for text, values in (("A1:B2", ["x"]), ("A1:Z1", ["x"] * 26), ("A:A", [])):
        with pytest.raises(FormulaError):
            table.put_range(rivers, text, values)


def test_merge_and_filter_state(rivers):
    out = table.merge(rivers, "A1:B2")
    assert [tuple(r)[1:3] for r in out.df.orderBy("_row").collect()][:3] == [("Isar", None), (None, None), ("Inn", 517.0)] and out.merged == ["A1:B2"]
    with pytest.raises(FormulaError):
        table.merge(out, "B2:C3")
    assert table.unmerge(out, "A1:B2").merged == [] and rivers.merged == []
    assert table.auto_filter(out, "A1:C6").filter_range == "A1:C6" and table.auto_filter(table.auto_filter(out, "A1:C6"), None).filter_range is None


def test_workbook_diff(rivers):
    a, b = Workbook(), Workbook()
    a.add(rivers)
    b.add(rivers.with_df(rivers.df.withColumn("km", F.col("km") + F.when(F.col("_row") == 4, 1.0).otherwise(0.0))))
    a.add(Sheet("Old", rivers.df, row="_row"))
    b.add(Sheet("New", rivers.df, row="_row"))
    assert {(r.sheet, r.status, r._row, r.after) for r in table.diff_workbooks(a, b).collect()} == {("Old", "removed", None, None), ("New", "added", None, None), ("R", "changed", 4, "452")}


def test_validation_kinds_and_conditional_formats(spark):
    import datetime

    rows = [(1, 3.0, "ab", datetime.date(2024, 5, 1)), (2, 3.5, "abcd", datetime.date(2025, 1, 1)), (3, None, None, None), (4, 9.0, "", datetime.date(2024, 1, 1))]
    s = Sheet("V", spark.createDataFrame(rows, "_row bigint, n double, t string, d date"), row="_row")
    wb = Workbook()
    wb.add(s)
    flags = lambda c: [r[0] for r in s.df.orderBy("_row").select(c).collect()]
    assert flags(table.validate(s, "n", "between", 1, 5)) == [True, True, True, False]
    assert flags(table.validate(s, "n", "between", 1, 5, kind="whole")) == [True, False, True, False]
    assert flags(table.validate(s, "t", "lessThanOrEqual", 2, kind="textLength")) == [True, False, True, True]
    assert flags(table.validate(s, "d", "lessThan", datetime.date(2024, 12, 31), kind="date")) == [True, False, True, True]
    assert flags(table.validate(s, "t", "greaterThan", 1)) == [False, False, True, False] and flags(table.validate(s, "t", "any")) == [True] * 4 and flags(table.validate(s, "t", "list", "ab", "")) == [True, False, True, True]
    assert [r.valid for r in table.validate_custom(wb, "V", "=LEN(B1)*2=A1+1").df.orderBy("_row").collect()] == [True, False, False, False]
    shown = lambda *a: [r.format for r in table.conditional_format(wb, "V", *a).orderBy("_row").collect()]
    assert shown("n", "greaterThan", 3.2) == [False, True, None, True] and shown("t", "contains", "BC") == [False, True, None, False] and shown("n", "top", 2) == [False, True, None, True]
    assert shown("n", "bottom", 1) == [True, False, None, False] and shown("n", "colorScale") == [0.0, 0.5 / 6, None, 1.0] and shown("n", "expression", "=A1*2>6") == [False, True, False, True]


def test_computed_addresses(spark):
    wb = Workbook()
    wb.add(Sheet("S", spark.createDataFrame([(1, 3.0, "B2", 10.0), (2, 1.0, "C1", 20.0), (3, 2.0, "zz", 30.0), (4, 0.0, None, 40.0)], "_row bigint, a double, b string, c double"), row="_row"))
    out = wb.fill_all("S", {"i": "=INDIRECT(B1)", "o": "=OFFSET($C$1,A1,0)", "p": "=OFFSET(C1,-1,-2)", "q": "=INDIRECT(\"C\"&A1)"}, errors=True).df.orderBy("_row").collect()
    assert [r.i for r in out] == ["C1", "10", None, None] and [r.i__err for r in out][2:] == ["#REF!", "#REF!"]
    assert [r.o for r in out] == ["40", "20", "30", "10"] or [r.o for r in out] == [40.0, 20.0, 30.0, 10.0]
    assert [r.q for r in out][:3] == ["30", "10", "20"] and out[3].q__err == "#REF!"
    assert wb.eval('=SUM(INDIRECT("C"&A2&":C"&A1))').first().value == 60.0 and wb.eval("=SUM(OFFSET(C1,A2,0,A3,1))").first().value == 50.0 and wb.eval("=INDIRECT(B3)").first().error == "#REF!"


def test_fraction_and_condition_formats(spark):
    from tests.test_formulas import hold

    wb = Workbook()
    wb.add(Sheet("S", spark.createDataFrame([(1, 1.0)], "_row bigint, a double"), row="_row"))
    hold(wb, {
        'TEXT(1.25,"# ?/?")': "1 1/4", 'TEXT(5.3,"# ??/??")': "5  3/10", 'TEXT(0.5,"# ??/??")': "  1/2 ", 'TEXT(1.5,"?/?")': "3/2", 'TEXT(3,"# ?/?")': "3    ", 'TEXT(0.3,"# ?/?")': " 2/7", 'TEXT(12.3,"# ?/?")': "12 1/3", 'TEXT(0.5,"# ?/8")': " 4/8", 'TEXT(-1.5,"# ?/?;(# ?/?)")': "(1 1/2)",
        'TEXT(150,"[>100]#,##0;[<=0]0.00;0.0")': "150", 'TEXT(-5,"[>100]#,##0;[<=0]0.00;0.0")': "-5.00", 'TEXT(7,"[>100]#,##0;[<=0]0.00;0.0")': "7.0", 'TEXT(50,"[Red][<=100]0;[Blue][>100]0.0")': "50", 'TEXT(500,"[Red][<=100]0;[Blue][>100]0.0")': "500.0", 'TEXT(5,"[>100]0;0.0")': "5.0", 'TEXT(3,"0"" a;b""")': "3 a;b",
    })


def test_formulas_names_and_dimension_in_files(spark, tmp_path):
    path = f"file://{tmp_path}/f.xlsx"
    df = spark.createDataFrame([(i, float(i), float(i * 2)) for i in range(1, 6)], "_row bigint, a double, twice double")
    xlsx.write_xlsx({"S": df}, path, formulas={"S": {"twice": "=A2*2"}}, names={"first": "=S!$A$2"}, dimension=True)
    assert xlsx.metadata(spark, path) == {"sheets": [("S", "A1:B6")], "names": [("first", "S!$A$2", None)]}
    got = {(r._row, r._col): (r.num, r.formula) for r in xlsx.read_cells(spark, path).where("_row > 1").collect()}
    assert got[4, 2][0] == 6.0 and "A4" in got[4, 2][1] and got[2, 1] == (1.0, None)
    assert [r.twice for r in xlsx.read_sheet(spark, path).df.orderBy("_row").collect()] == [2.0, 4.0, 6.0, 8.0, 10.0]


def test_transform_in_place(spark, tmp_path):
    source, target = f"file://{tmp_path}/a.xlsx", f"file://{tmp_path}/b.xlsx"
    df = spark.createDataFrame([(i, float(i), f"t{i}") for i in range(1, 6)], "_row bigint, a double, b string")
    xlsx.write_xlsx({"S": df, "Other": df}, source)
    xlsx.transform_xlsx(spark, source, target, "s", {"A3": 99.0, "B4": None, "C2": "=A2*2", "B9": "new", "A5": True})
    cells = {(r._row, r._col): r for r in xlsx.read_cells(spark, target, "S").collect()}
    assert cells[3, 1].num == 99.0 and (4, 2) not in cells and cells[2, 3].formula.endswith("A2*2") and cells[9, 2].txt == "new" and cells[5, 1].bool is True and cells[6, 2].txt == "t5"
    assert xlsx.read_sheet(spark, target, "Other").df.count() == 5 and xlsx.sheets_of(spark, target) == ["S", "Other"]
    with pytest.raises(ValueError):
        xlsx.transform_xlsx(spark, source, target, "none", {"A1": 1})


def test_sort_command_places_every_row_once(spark, tmp_path):
    """Range partitions of a sort are sampled anew at each evaluation; places must not come from them."""
    from lattica.queries import QUERIES

    rows = [(k, f"c{k}", k % 25, None if k % 97 == 0 else float(k * 7919 % 701), "AbBc"[k % 4]) for k in range(20_000)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as large tables have it: several partitions
    try:
        got = QUERIES["sort_command"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want = sorted(rows, key=lambda r: (r[4].lower(), r[3] is not None, -(r[3] or 0.0), r[0]))
    assert [(r.place, r.c_custkey) for r in sorted(got, key=lambda r: r.place)] == [(i, r[0]) for i, r in enumerate(want, 1)]


def test_places_by_keys_of_all_directions(spark):
    rows = [(n, None if n % 5 == 0 else "xYz"[n % 3], None if n % 7 == 0 else float(n % 11), n % 2 == 0) for n in range(1, 400)]
    s = Sheet("P", spark.createDataFrame(rows, "_row bigint, t string, v double, f boolean"), row="_row")
    for keys in ([("t", True), ("v", False)], [("v", True), ("t", False), ("f", True)], [("f", False), ("t", True)]):
        placed = sorted(table.sort_sheet(s, keys, "place").collect(), key=lambda r: r.place)
        assert [r.place for r in placed] == list(range(1, 400))
        assert [r._row for r in placed] == [r._row for r in table.sort_sheet(s, keys).collect()]


def test_asof_deals_crowded_keys(spark):
    """Probes beyond the table's keys, of one key or of none must not meet in one partition of the window."""
    probes = [5.0 + n / 7 for n in range(3000)] + [2.0] * 3000 + [None] * 2000 + [-1.0 - n for n in range(500)]
    df = spark.createDataFrame(list(enumerate(probes)), "i int, k double")
    keys = [0.0, 1.0, 2.0, 2.5, 3.0, 4.0]
    lookup = spark.createDataFrame([(k, int(k * 10)) for k in keys], "t double, v int")
    for forward in (False, True):
        out = ordered.asof(df, "k", lookup, "t", ["v"], "v", forward)
        want = {i: None if p is None else next((int(k * 10) for k in (keys if forward else keys[::-1]) if (k >= p if forward else k <= p)), None) for i, p in enumerate(probes)}
        assert {r.i: r.v for r in out.collect()} == want and out.count() == len(probes)
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        largest = max(r.n for r in ordered.asof(df, "k", lookup, "t", ["v"], "v").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("v")).collect())
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert largest < len(probes) / 10
