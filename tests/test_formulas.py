"""One formula, one hand-written value."""

import datetime

import pytest

from lattica.parser import FormulaError, parse, show
from lattica.sheet import Sheet, Workbook


def book(spark, rows, schema):
    wb = Workbook(today="2024-06-30")
    df = spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "_row bigint, " + schema)
    wb.add(Sheet("S", df, row="_row"))
    return wb


@pytest.fixture(scope="module")
def fruit(spark):
    return book(spark, [("Apple", 10.0, True), ("Apple", None, False), ("apple", 30.0, True), ("Pear", 4.0, None)], "a string, b double, c boolean")


@pytest.fixture(scope="module")
def numbers(spark):
    return book(spark, [(3.0, "a"), (1.0, "b"), (4.0, "c"), (1.0, "d"), (5.0, "e")], "x double, k string")


def many(wb, cases):
    """All formulas in one job."""
    from pyspark.sql import functions as F

    from lattica.binder import Binder

    b = Binder(wb, next(iter(wb.sheets.values())))
    cols = []
    for i, f in enumerate(cases):
        v = b.value(parse(f))
        cols.append((v.col if v.err is None else F.when(v.err.isNull(), v.col)).alias(f"v{i}"))
        cols.append((F.lit(None).cast("string") if v.err is None else v.err).alias(f"e{i}"))
    row = b.sheet.df.sparkSession.range(1).select(*cols).first()
    return {f: row[f"e{i}"] or row[f"v{i}"] for i, f in enumerate(cases)}


def hold(wb, cases):
    got = many(wb, cases)
    bad = {}
    for f, want in cases.items():
        x = got[f]
        same = abs(x - want) < 1e-6 if isinstance(want, float) and isinstance(x, int | float) else x == want
        if not same:
            bad[f] = (x, want)
    assert not bad


def test_conditional_aggregates(fruit):
    hold(fruit, {
        'SUMIF(A1:A4,"Apple",B1:B4)': 40.0, 'SUMIF(B1:B4,10)': 10.0, 'COUNTIF(A:A,"a*")': 3, 'COUNTIF(A:A,"<>apple")': 1, 'COUNTIF(B:B,"<>10")': 2, 'COUNTIF(B:B,"<>")': 3, 'COUNTIF(B:B,"")': 1,
        'COUNTIF(C:C,TRUE)': 2, 'COUNTIF(C:C,"true")': 2, 'COUNTIF(A:A,">b")': 1, 'COUNTIFS(A:A,"apple",B:B,">5")': 2, 'AVERAGEIF(A:A,"pear",B:B)': 4.0, 'AVERAGEIF(A:A,"x",B:B)': "#DIV/0!", 'MAXIFS(B:B,A:A,"x")': 0.0, 'MINIFS(B:B,A:A,"apple")': 10.0,
        'SUMPRODUCT((B1:B4>5)*B1:B4)': 40.0, "SUMPRODUCT(B:B,C:C)": 40.0,
    })


def test_aggregates_skip_text_and_blanks(fruit):
    hold(fruit, {"SUM(A1:C4)": 44.0, "COUNT(A1:C4)": 3, "COUNTA(A1:C4)": 10, "COUNTBLANK(A1:C4)": 2, "COUNTBLANK(A1:C6)": 8, "AVERAGE(B:B)": 44 / 3, "MIN(A:A)": 0.0, "SUM(B1:B4,5,TRUE)": 50.0, "MEDIAN(A:A)": "#HOST!", "AVERAGE(A:A)": "#DIV/0!"})


def test_order_statistics(numbers):
    hold(numbers, {"LARGE(A1:A5,1)": 5.0, "LARGE(A1:A5,2)": 4.0, "SMALL(A1:A5,1)": 1.0, "SMALL(A1:A5,3)": 3.0, "RANK(4,A1:A5)": 2, "RANK(4,A1:A5,1)": 4, "RANK(9,A1:A5)": "#N/A", "QUARTILE(A1:A5,2)": 3.0, "QUARTILE(A1:A5,4)": 5.0, "PERCENTILE(A1:A5,0.9)": 4.6, "LARGE(A1:A5,6)": "#NUM!", "QUARTILE(A1:A5,5)": "#NUM!"})


def test_lookups(numbers):
    hold(numbers, {
        'VLOOKUP(4,A:B,2,FALSE)': "c", 'VLOOKUP(4.5,A:B,2)': "c", 'VLOOKUP(1,A:B,2,TRUE)': "d", 'VLOOKUP("3",A:B,2,FALSE)': "a", 'VLOOKUP(9,A:B,2,FALSE)': "#HOST!", 'XLOOKUP(1,A:A,B:B)': "b", 'XLOOKUP(1,A:A,B:B,"",0,-1)': "d", 'XLOOKUP(2,A:A,B:B,"",-1)': "d",
        'XLOOKUP(2,A:A,B:B,"",1)': "a", 'XLOOKUP(9,A:A,B:B)': "#N/A", 'XLOOKUP(9,A:A,B:B,"none")': "none", 'XLOOKUP("?",B:B,A:A,0,2)': 3.0, "MATCH(1,A:A,0)": 2.0, "MATCH(2,A:A,1)": 2.0, "MATCH(2,A:A,-1)": 1.0, "MATCH(7,A:A,0)": "#HOST!", "INDEX(A1:B5,3,2)": "c", "INDEX(A1:B5,9,1)": "#HOST!",
        'INDEX(B:B,MATCH("D",B:B,0))': "d", "IFERROR(MATCH(7,A:A,0),-1)": -1.0, 'IFNA(XLOOKUP(9,A:A,B:B),"z")': "z",
    })


def test_operators_and_errors(fruit):
    hold(fruit, {
        "-2^2": -4.0, "2^3^2": 512.0, "50%": 0.5, '"a"&1.5&TRUE': "a1.5TRUE", "1/0": "#DIV/0!", "IFERROR(1/0,5)": 5.0, "IFNA(1/0,5)": "#DIV/0!", "ISERROR(1/0)": True, "ISERR(NA())": False, "ISNA(NA())": True, "A1=A3": True, "B2=0": True, 'B2=""': True, '5<"a"': True, '"a"<TRUE': True, "1=1 AND 2=3": False,
        "NOT 1=2": False, "TRUE OR FALSE AND FALSE": True, "ISBLANK(B2)": True, "ISNUMBER(B1)": True, "ISTEXT(A1)": True, "N(TRUE)": 1.0, 'N("x")': 0.0, '"x"+1': "#VALUE!", '"3"+1': 4.0, "SQRT(-1)": "#NUM!", "#REF!": "#REF!", "nothing": "#NAME?",
    })


def test_maths(fruit):
    hold(fruit, {
        "MOD(7,-3)": -2.0, "MOD(-7,3)": 2.0, "MOD(1,0)": "#DIV/0!", "ROUND(-2.5,0)": -3.0, "ROUND(1250,-2)": 1300.0, "ROUNDUP(2.1,0)": 3.0, "ROUNDUP(-2.1,0)": -3.0, "ROUNDDOWN(2.3,2)": 2.3, "FLOOR(0.3,0.1)": 0.3, "CEILING(2.1,0.5)": 2.5, "FLOOR(1,-1)": "#HOST!", "MROUND(7,5)": 5.0, "MROUND(7.5,5)": 10.0,
        "TRUNC(-1.79,1)": -1.7, "INT(-1.5)": -2.0, "SIGN(-3)": -1.0, "LOG(8,2)": 3.0, "LOG(100)": 2.0, "LOG(5,1)": "#DIV/0!", "LN(0)": "#NUM!", "POWER(2,0.5)": 2**0.5, "ABS(-3)": 3.0, "EXP(0)": 1.0,
    })


def test_text(fruit):
    hold(fruit, {
        'LEFT("abc",2)': "ab", 'RIGHT("abc",5)': "abc", 'MID("abc",2,9)': "bc", 'MID("abc",0,1)': "#HOST!", 'LEN("abc")': 3.0, 'TRIM("  a   b ")': "a b", 'FIND("c","abc")': 3.0, 'FIND("C","abc")': "#HOST!", 'FIND("","abc",2)': 2.0, 'SEARCH("C","abc")': 3.0, 'SEARCH("b?d","a bad")': 3.0, 'SEARCH("~?","a?")': 2.0, 'SEARCH("z","a")': "#VALUE!",
        'SUBSTITUTE("a-b-c","-","+")': "a+b+c", 'SUBSTITUTE("a-b-c","-","+",2)': "a-b+c", 'SUBSTITUTE("abc","","x")': "abc", 'VALUE("($1,200.50)")': -1200.5, 'VALUE("12%")': 0.12, 'VALUE("x")': "#VALUE!", 'VALUE("")': 0.0, 'UPPER("aé")': "AÉ", 'TEXT(1234.567,"#,##0.00")': "1,234.57", 'TEXT(0.256,"0.0%")': "25.6%",
        'TEXT(-5,"0.00")': "-5.00", 'TEXT(7,"000")': "007", 'TEXT(5,"0;(0)")': "5", 'TEXT(-5,"0;(0)")': "(5)", 'TEXT(12345,"0.00E+00")': "1.23E+04", 'TEXT(DATE(2024,3,5),"d mmm yyyy")': "5 Mar 2024",
    })


def test_dates(fruit):
    hold(fruit, {
        "DATE(2024,3,15)": datetime.date(2024, 3, 15), "DATE(2024,13,1)": "#HOST!", "DATE(2023,2,29)": "#HOST!", "DATE(2024,3,15)+0": 45366.0, "DATE(1900,1,1)+0": 1.0, "YEAR(45366)": 2024.0, "EOMONTH(DATE(2024,1,31),1)": datetime.date(2024, 2, 29), "EDATE(DATE(2024,1,31),1)": datetime.date(2024, 2, 29),
        'DATEDIF(DATE(2020,1,31),DATE(2024,2,29),"M")': 48.0, 'DATEDIF(DATE(2020,1,31),DATE(2024,2,29),"Y")': 4.0, 'DATEDIF(DATE(2020,1,1),DATE(2024,2,29),"YM")': 1.0, "NETWORKDAYS(DATE(2024,1,1),DATE(2024,1,31))": 23.0, "NETWORKDAYS(DATE(2024,1,31),DATE(2024,1,1))": -23.0, "NETWORKDAYS(DATE(2024,1,1),DATE(2024,1,31),DATE(2024,1,1))": 22.0,
        "WORKDAY(DATE(2024,1,5),1)": datetime.date(2024, 1, 8), "WORKDAY(DATE(2024,1,8),-1)": datetime.date(2024, 1, 5), "WORKDAY(DATE(2024,1,6),0)": datetime.date(2024, 1, 6), "WORKDAY(DATE(2024,1,5),3,DATE(2024,1,8))": datetime.date(2024, 1, 11), "YEARFRAC(DATE(2024,1,1),DATE(2024,7,1))": 0.5, "YEARFRAC(DATE(2024,1,1),DATE(2024,7,1),1)": 182 / 366, "TODAY()": datetime.date(2024, 6, 30),
    })


def test_logic_and_names(fruit):
    fruit.define("rate", "=0.25")
    fruit.define("amounts", "=S!$B$1:$B$4")
    hold(fruit, {
        "IFS(FALSE,1,TRUE,2)": 2.0, "IFS(FALSE,1)": "#N/A", 'SWITCH(3,1,"a",2,"b","z")': "z", 'SWITCH(3,1,"a")': "#N/A", "CHOOSE(2,10,20)": 20.0, "CHOOSE(9,1,2)": "#VALUE!", "AND(TRUE,1)": True, "OR(FALSE,0)": False, "LET(x,2,y,x+1,x*y)": 6.0, "SUM(amounts)*rate": 11.0, "IF(TRUE,1,1/0)": 1.0,
        "ROWS(A1:B3)": 3.0, "COLUMNS(A1:B3)": 2.0, "ROW(A7)": 7.0, "ADDRESS(3,28)": "$AB$3", "ADDRESS(1,1,4)": "A1", "ADDRESS(0,1)": "#VALUE!", 'CELL("address",B2)': "$B$2", "SUM(OFFSET(B1,0,0,3,1))": 40.0, 'SUM(INDIRECT("B1:B3"))': 40.0, 'INDIRECT("zz")': "#REF!", "OFFSET(A1,-1,0)": "#REF!",
    })


def test_financial(spark):
    wb = book(spark, [(100.0,), (200.0,), (300.0,)], "x double")
    hold(wb, {"NPV(0.1,A1:A3)": 481.592787, "PMT(0.05/12,360,200000)": -1073.643246, "FV(0,10,-5,0)": 50.0, "PV(0.01,12,-100)": 1125.507747, "NPER(0.01,-100,1000)": 10.588644, "ROUND(RATE(48,-200,8000),6)": 0.007701} | {"NPV(-1,A1:A3)": "#HOST!"})
    wb = book(spark, [(-1000.0, datetime.date(2024, 1, 1)), (400.0, datetime.date(2024, 7, 1)), (400.0, datetime.date(2025, 1, 1)), (400.0, datetime.date(2025, 7, 1))], "v double, d date")
    irr = wb.eval("=IRR(A:A)").first().value
    assert abs(sum(x / (1 + irr) ** i for i, x in enumerate([-1000, 400, 400, 400]))) < 1e-3
    xirr = wb.eval("=XIRR(A:A,B:B)").first().value
    assert abs(wb.eval(f"=XNPV({xirr!r},A:A,B:B)").first().value) < 1e-3
    assert wb.eval("=IRR(A2:A4)").first().error == "#HOST!"


def test_row_sets(fruit, numbers):
    rows = lambda wb, f: [tuple(r) for r in wb.eval(f).orderBy("_row").collect()]
    assert rows(numbers, "SORT(A1:B5,1)") == [(1.0, "b", 1), (1.0, "d", 2), (3.0, "a", 3), (4.0, "c", 4), (5.0, "e", 5)]
    assert [r[1] for r in rows(numbers, "SORT(A1:B5,1,-1)")] == ["e", "c", "a", "d", "b"]
    assert rows(fruit, "UNIQUE(A:A)") == [("Apple", 1), ("Pear", 4)]
    assert rows(fruit, "UNIQUE(A:A,FALSE,TRUE)") == [("Pear", 4)]
    assert rows(fruit, "FILTER(A:B,B:B>15)") == [("apple", 30.0, 3)]
    assert rows(fruit, "FILTER(B:B,B:B>99,-1)") == [(-1.0, 0)]
    assert rows(fruit, "SEQUENCE(2,3)") == [(1.0, 2.0, 3.0, 1), (4.0, 5.0, 6.0, 2)]
    assert rows(numbers, "TRANSPOSE(A1:A3)") == [(3.0, 1.0, 4.0, 1)]
    assert rows(fruit, "SORT(UNIQUE(A:A),1,-1)") == [("Pear", 1), ("Apple", 2)]


def test_fill_down(numbers):
    out = numbers.fill_all("S", {
        "run": "SUM($A$1:A1)", "slide": "AVERAGE(A1:A2)", "rank": "RANK(A1,A:A)", "same": "SUMIFS(A:A,B:B,B1)", "asof": "MATCH(A1,A:A,1)", "next": "A2", "share": "A1/SUM(A:A)", "mid": "MEDIAN(A1:A3)", "up": 'XLOOKUP(A1+0.5,A:A,B:B,"none",1)'})
    rows = out.df.orderBy("_row").collect()
    assert [r.run for r in rows] == [3, 4, 8, 9, 14]
    assert [r.slide for r in rows] == [2, 2.5, 2.5, 3, 5]
    assert [r["rank"] for r in rows] == [3, 4, 2, 4, 1]
    assert [r.same for r in rows] == [3, 1, 4, 1, 5]
    assert [r.asof for r in rows] == [1, 2, 3, 2, 5]
    assert [r["next"] for r in rows] == [1, 4, 1, 5, None]
    assert [r.mid for r in rows] == [3, 1, 4, 3, 5]
    assert [r.up for r in rows] == ["c", "a", "e", "a", "none"]


def test_error_columns(spark):
    wb = book(spark, [(1.0,), (0.0,), (None,)], "x double")
    out = wb.fill("S", "inv", "=1/A1", errors=True)
    assert [(r.inv, r.inv__err) for r in out.df.orderBy("_row").collect()] == [(1.0, None), (None, "#DIV/0!"), (None, "#DIV/0!")]
    assert wb.eval("=SUM(B:B)").first().error == "#DIV/0!"
    assert wb.eval("=COUNT(B:B)").first().value == 1
    assert wb.eval("=COUNTA(B:B)").first().value == 3


@pytest.mark.parametrize("text", ["1+2*3", "-A1^2", 'IF(A1>1,"x""y",B$2)', "SUM($A:B)*50%", "'My Sheet'!A1:B2", "NOT A1=1 AND B1"])
def test_show_parses_back(text):
    assert parse(show(parse(text))) == parse(text)


@pytest.mark.parametrize("text", ["SUM(", "1+", "FOO(1)", "IF(TRUE,1)", "LEFT(\"a\")", "A1:B", "1 2"])
def test_bad_formulas(fruit, text):
    with pytest.raises(FormulaError):
        fruit.eval("=" + text)


def test_newton_works_out_each_step_once(spark):
    """A fold is interpreted: what its expression repeats is computed again, in every step of every row."""
    from lattica.sheet import Sheet, Workbook

    wb = Workbook()
    wb.add(Sheet("f", spark.createDataFrame([(1, -1000.0, 600.0, 700.0)], "_row bigint, a double, b double, c double"), row="_row"))
    for formula, powers in (("=IRR(A1:C1)", 2), ("=ROUND(RATE(48,-30,1000),6)", 3), ("=XIRR(A1:C1,A1:C1)", 2)):
        plan = wb.fill("f", "x", formula).df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.upper().count("POWER(") == powers, (formula, plan.upper().count("POWER("))
