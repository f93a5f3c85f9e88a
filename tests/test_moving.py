"""Formulas filled down over ranges that move, and array formulas, against plain loops over the cells."""

import math
import statistics

import pytest

from lattica.parser import FormulaError
from lattica.sheet import Sheet, Workbook

X = [1.0, 1.0, 2.0, None, 2.0, 3.0, 3.0, 5.0, 4.0, 2.0, 7.0, 1.0]
K = ["a", "b", "A", "b", None, "c", "a", "b", "b", "c", "a", "d"]
Y = [10.0, 20.0, None, 40.0, 50.0, 60.0, 70.0, 80.0, 90.0, 100.0, 110.0, 120.0]
N = len(X)
SCHEMA = "x double, k string, y double, p double"


@pytest.fixture()
def wb(spark):
    wb = Workbook()
    wb.add(Sheet("S", spark.createDataFrame([(i + 1, x, k, y, float(i % 4 + 1)) for i, (x, k, y) in enumerate(zip(X, K, Y, strict=True))], "_row bigint, " + SCHEMA), row="_row"))
    wb.add(Sheet("T", spark.createDataFrame([(i + 1, float(i * i), -float(i)) for i in range(N)], "_row bigint, u double, v double"), row="_row"))
    return wb


def part(col, lo, hi):
    """Cells of rows lo to hi (1-based), empty ones outside the sheet."""
    return [col[i - 1] if 1 <= i <= N else None for i in range(lo, hi + 1)]


def nums(cells):
    return [c for c in cells if c is not None]


def hold(wb, cases):
    """cases: formula (written for row 1) -> function of the row number to its value or error code."""
    names = {f"f{i}": f for i, f in enumerate(cases)}
    rows = wb.fill_all("S", {n: "=" + f for n, f in names.items()}, errors=True).df.collect()
    assert len(rows) == N
    bad = {}
    for r in rows:
        for n, f in names.items():
            code = r[f"{n}__err"] if f"{n}__err" in r.asDict() else None
            got, want = code or r[n], cases[f](r._row)
            same = got is not None and not isinstance(got, str) and abs(got - want) < 1e-9 if isinstance(want, int | float) and not isinstance(want, bool) else got == want
            if not same:
                bad.setdefault(f, []).append((r._row, got, want))
    assert not bad, bad


def test_running_conditions(wb):
    same = lambda a, z: a is not None and z is not None and a.lower() == z.lower()
    at = lambda c, r: c[r - 1]
    hold(wb, {
        "COUNTIF($A$1:A1,A1)": lambda r: sum((x or 0 if x is None else x) == (at(X, r) or 0) and x is not None for x in X[:r]),
        'COUNTIF($A$1:A1,">1")': lambda r: sum(x is not None and x > 1 for x in X[:r]),
        'SUMIF($B$1:B1,B1,$C$1:C1)': lambda r: float(sum(y or 0 for k, y in zip(K[:r], Y[:r]) if same(k, at(K, r)))),
        'SUMIFS($C$1:C1,$B$1:B1,"b",$A$1:A1,">=1")': lambda r: float(sum(y or 0 for x, k, y in zip(X[:r], K[:r], Y[:r]) if same(k, "b") and x is not None and x >= 1)),
        'MAXIFS($C$1:C1,$B$1:B1,B1)': lambda r: max(nums(y for k, y in zip(K[:r], Y[:r]) if same(k, at(K, r))), default=0.0),
        'AVERAGEIF($B$1:B1,"a",$C$1:C1)': lambda r: (lambda v: sum(v) / len(v) if v else "#DIV/0!")(nums(y for k, y in zip(K[:r], Y[:r]) if same(k, "a"))),
        "COUNTIFS(A1:A$12,A1,B1:B$12,B1)": lambda r: sum(x is not None and x == (at(X, r) or 0) and same(k, at(K, r)) for x, k in zip(X[r - 1 :], K[r - 1 :])),
        "SUMPRODUCT($A$1:A1,$C$1:C1)": lambda r: sum((x or 0) * (y or 0) for x, y in zip(X[:r], Y[:r])),
        "SUMPRODUCT(($A$1:A1>1)*$C$1:C1)": lambda r: sum((y or 0) for x, y in zip(X[:r], Y[:r]) if (x or 0) > 1),
    })


def test_sliding_conditions(wb):
    same = lambda a, z: a is not None and z is not None and a.lower() == z.lower()
    at = lambda c, r: c[r - 1]
    w = lambda c, r: part(c, r, r + 2)
    hold(wb, {
        "COUNTIF(A1:A3,A1)": lambda r: sum(x is not None and x == (at(X, r) or 0) for x in w(X, r)),
        'COUNTIF(A1:A3,">"&A1)': lambda r: sum(x is not None and x > (at(X, r) or 0) for x in w(X, r)),
        'SUMIF(B1:B3,"b",C1:C3)': lambda r: float(sum(y or 0 for k, y in zip(w(K, r), w(Y, r)) if same(k, "b"))),
        'SUMIFS(C2:C4,A1:A3,">=2")': lambda r: float(sum(y or 0 for x, y in zip(w(X, r), part(Y, r + 1, r + 3)) if x is not None and x >= 2)),
        'MINIFS(C1:C3,A1:A3,">1")': lambda r: min(nums(y for x, y in zip(w(X, r), w(Y, r)) if x is not None and x > 1), default=0.0),
        'AVERAGEIFS(C1:C3,B1:B3,B1)': lambda r: (lambda v: sum(v) / len(v) if v else "#DIV/0!")(nums(y for k, y in zip(w(K, r), w(Y, r)) if same(k, at(K, r)))),
        "SUMPRODUCT(A1:A3,C1:C3)": lambda r: sum((x or 0) * (y or 0) for x, y in zip(w(X, r), w(Y, r))),
        "SUMPRODUCT(A1:A3,T!A1:A3)": lambda r: sum((x or 0) * (t or 0) for x, t in zip(w(X, r), part([float(i * i) for i in range(N)], r, r + 2))),
        'SUMIF(T!A1:A3,">3")': lambda r: float(sum(t for t in nums(part([float(i * i) for i in range(N)], r, r + 2)) if t > 3)),
        "SUM(T!A1:B2)": lambda r: sum(nums(part([float(i * i) for i in range(N)], r, r + 1)) + nums(part([-float(i) for i in range(N)], r, r + 1))),
        "COUNTBLANK(T!A1:A3)": lambda r: sum(x is None for x in part([1.0] * N, r, r + 2)),
    })


def test_fixed_conditions_by_row(wb):
    at = lambda c, r: c[r - 1] or 0
    hold(wb, {
        'COUNTIF($A$1:$A$12,">"&A1)': lambda r: sum(x is not None and x > at(X, r) for x in X),
        'COUNTIF($A$1:$A$12,">="&A1)': lambda r: sum(x is not None and x >= at(X, r) for x in X),
        'SUMIF($A$1:$A$12,"<"&A1,$C$1:$C$12)': lambda r: float(sum(y or 0 for x, y in zip(X, Y) if x is not None and x < at(X, r))),
        'MAXIFS($C$1:$C$12,$A$1:$A$12,"<="&A1,$B$1:$B$12,"b")': lambda r: max(nums(y for x, k, y in zip(X, K, Y) if x is not None and x <= at(X, r) and k == "b"), default=0.0),
    })


def test_sliding_order_statistics(wb):
    w = lambda r: sorted(nums(part(X, r, r + 3)))

    def share(v, p):
        i = p * (len(v) - 1)
        return v[math.floor(i)] + (v[math.ceil(i)] - v[math.floor(i)]) * (i - math.floor(i)) if v else "#NUM!"

    hold(wb, {
        "LARGE(A1:A4,1)": lambda r: w(r)[-1],
        "LARGE(A1:A4,D1)": lambda r: w(r)[-(int((r - 1) % 4) + 1)] if len(w(r)) > (r - 1) % 4 else "#NUM!",
        "SMALL(A1:A4,2)": lambda r: w(r)[1] if len(w(r)) > 1 else "#NUM!",
        "PERCENTILE(A1:A4,0.3)": lambda r: share(w(r), 0.3),
        "PERCENTILE(A1:A4,D1/4)": lambda r: share(w(r), ((r - 1) % 4 + 1) / 4),
        "QUARTILE(A1:A4,1)": lambda r: share(w(r), 0.25),
        "RANK(A1,A1:A4)": lambda r: "#N/A" if X[r - 1] is None else 1 + sum(x > X[r - 1] for x in w(r)),
        "RANK(A1,A1:A4,1)": lambda r: "#N/A" if X[r - 1] is None else 1 + sum(x < X[r - 1] for x in w(r)),
        "MEDIAN(A1:A4)": lambda r: statistics.median(w(r)),
        "STDEV(A1:A4)": lambda r: statistics.stdev(w(r)) if len(w(r)) > 1 else "#HOST!",
        "VARP(A1:A4)": lambda r: statistics.pvariance(w(r)),
        "PERCENTILE($A$1:$A$12,D1/4)": lambda r: share(sorted(nums(X)), ((r - 1) % 4 + 1) / 4),
        "LARGE($A$1:$A$12,D1)": lambda r: sorted(nums(X))[-int((r - 1) % 4 + 1)],
    })
    wide = lambda r: nums([v for i in (r, r + 1) for c in (X, K, Y) for v in part(c, i, i) if not isinstance(v, str)])
    hold(wb, {
        "STDEV(A1:C2)": lambda r: statistics.stdev(wide(r)) if len(wide(r)) > 1 else "#HOST!",
        "MEDIAN(A1:C2)": lambda r: statistics.median(wide(r)),
        "VAR(A1:C2)": lambda r: statistics.variance(wide(r)) if len(wide(r)) > 1 else "#HOST!",
    })


def test_moving_lookups(wb):
    w = lambda c, r: part(c, r, r + 3)

    def first(cells, f, code):
        return next((i for i, x in enumerate(cells) if x is not None and f(x)), code)

    def approx(r):
        v = [(x, -i) for i, x in enumerate(w(X, r)) if x is not None and x <= 2]
        return 1 - max(v)[1] if v else "#HOST!"

    got = lambda i, c, code: code if isinstance(i, str) else c[i]
    hold(wb, {
        "MATCH(2,A1:A4,0)": lambda r: (lambda i: i if isinstance(i, str) else i + 1)(first(w(X, r), lambda x: x == 2, "#HOST!")),
        "MATCH(2,A1:A4,1)": approx,
        'VLOOKUP("b",B1:C4,2,FALSE)': lambda r: got(first(w(K, r), lambda k: k.lower() == "b", "#HOST!"), w(Y, r), "#HOST!"),
        'XLOOKUP("b",B1:B4,C1:C4,-1)': lambda r: got(first(w(K, r), lambda k: k.lower() == "b", "-"), w(Y, r), -1.0),
        "INDEX(C1:C4,2)": lambda r: part(Y, r + 1, r + 1)[0],
        "INDEX(C1:C4,D1)": lambda r: w(Y, r)[int((r - 1) % 4)],
        "MATCH(2,$A$1:A1,0)": lambda r: 3.0 if r >= 3 else "#HOST!",
        'XLOOKUP("b",$B$1:B1,$C$1:C1)': lambda r: 20.0 if r >= 2 else "#N/A",
        "INDEX($C$1:C1,D1)": lambda r: Y[(r - 1) % 4] if (r - 1) % 4 + 1 <= r else "#HOST!",
    })
    hold(wb, {
        "MATCH(3,A1:D1,0)": lambda r: next((i + 1 for i, v in enumerate([X[r - 1], None, Y[r - 1], float((r - 1) % 4 + 1)]) if v == 3), "#HOST!"),
        "MATCH(60,$A$6:$D$6,0)": lambda r: 3,
        "XLOOKUP(3,C1:D1,C1:D1,0)": lambda r: 3.0 if (r - 1) % 4 + 1 == 3 else 0.0,
        "XLOOKUP(A1,$A$1:$A$12,T!$A$1:$A$12)": lambda r: float(X.index(X[r - 1]) ** 2) if X[r - 1] is not None else "#N/A",
    })


def test_moving_payments(spark):
    wb = Workbook()
    rows = [(-1000.0, 400.0, 400.0, 400.0), (-500.0, 100.0, 300.0, 300.0), (-50.0, 10.0, 20.0, 70.0)]
    wb.add(Sheet("S", spark.createDataFrame([(i + 1, *r) for i, r in enumerate(rows)], "_row bigint, a double, b double, c double, d double"), row="_row"))
    npv = lambda v, r=0.1: sum(x / (1 + r) ** (i + 1) for i, x in enumerate(v))

    def irr(v):
        low, high = -0.9, 2.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(x / (1 + mid) ** i for i, x in enumerate(v)) > 0 else (low, mid)
        return low

    got = wb.fill_all("S", {"n": "=NPV(0.1,A1:D1)", "i": "=IRR(A1:D1)", "s": "=NPV(0.1,A1:B2)", "g": "=NPV(0.1,$A$1:A1)", "q": "=NPV(A1/-1000,$A$1:$D$1)"}).df.orderBy("_row").collect()
    for k, r in enumerate(got):
        below = [*rows[k][:2], *(rows[k + 1][:2] if k + 1 < 3 else ())]
        assert abs(r.n - npv(rows[k])) < 1e-9 and abs(r.i - irr(rows[k])) < 1e-6 and abs(r.s - npv(below)) < 1e-9
        assert abs(r.g - npv([x[0] for x in rows[: k + 1]])) < 1e-9 and abs(r.q - npv(rows[0], -rows[k][0] / 1000)) < 1e-9
    assert abs(wb.eval("=NPV(0.1,A1:D1)").first().value - npv(rows[0])) < 1e-9 and abs(wb.eval("=IRR(A1:D1)").first().value - irr(rows[0])) < 1e-6
    assert abs(wb.eval("=NPV(0.1,A1:D2)").first().value - npv([*rows[0], *rows[1]])) < 1e-9


def test_what_has_no_form_is_an_error(wb):
    for f in ("MEDIAN($A$1:A1)", "LARGE($A$1:A1,1)", "PERCENTILE($A$1:A1,0.5)", "VLOOKUP(A1,$A$1:C1,3)", 'COUNTIF($A$1:A1,">"&A1)', "IRR($A$1:A1)", "IFERROR(MEDIAN($A$1:A1),0)", "SUMPRODUCT(A1:A3,$C$1:$C$3)", 'SUMIF(T!$A$1:A1,">3")', "INDEX(A1:A$12,2)+INDEX(A1:A$12,D1)"):
        with pytest.raises(FormulaError):
            wb.fill("S", "f", "=" + f)


def test_array_formulas(wb):
    from tests.test_formulas import hold as hold_scalars

    hold_scalars(wb, {
        "SUM(IF(A1:A12>2,A1:A12,0))": 22.0, "SUM(A1:A12*C1:C12)": float(sum((x or 0) * (y or 0) for x, y in zip(X, Y))), "MAX(IF(A1:A12>2,-C1:C12,-1000))": -60.0, "SUM(-A1:A3)": -4.0,
        'SUM(IF(B1:B12="b",C1:C12,""))': 230.0, "COUNT(IF(A1:A12>2,1,\"no\"))": 5, "AVERAGE(A1:A2+C1:C2)": 16.0, "SUM(A1:A3+C1:C2)": "#N/A", "IFERROR(SUM(A1:A3+C1:C2),-1)": -1.0, "SUM(IFERROR(A1:A3+C1:C2,100))": 132.0,
        "MEDIAN(IF(A1:A12>2,A1:A12,\"\"))": 4.0, "SUM(A1:A2%)": 0.02, "SUM((A1:A12>AVERAGE(A1:A12))*1)": float(sum((x or 0) > sum(nums(X)) / 11 for x in X)), "AND(C1:C2>5)": True, "OR(A1:A12>6)": True, "SUM(IF(NOT(A1:A3>1),1,0))": 2.0,
        "SUM(A1:A2*C1:D1)": 22.0, "SUM(10/A3:A5)": "#DIV/0!", "SUM(A1:A2*C1:C2+1)": 32.0, "SUM(SQRT(C4:C4))": 40.0**0.5, "SUM(ABS(-A1:A3))": 4.0, "LARGE(A1:A12*2,1)": 14.0, "SUM(LEN(B1:B3))": 3.0,
    })
    rows = wb.eval("=A1:A3+C1:C2", "S").orderBy("_row").collect()
    assert [(r._row, r.c1, r.e1) for r in rows] == [(1, 11.0, None), (2, 21.0, None), (3, None, "#N/A")]
    rows = wb.eval("=IF(A1:A3>1,A1:A3,99)", "S").orderBy("_row").collect()
    assert [r.c1 for r in rows] == [99.0, 99.0, 2.0]
    rows = wb.eval("=A1:A2*C1:D1", "S").orderBy("_row").collect()
    assert [(r.c1, r.c2) for r in rows] == [(10.0, 1.0), (10.0, 1.0)]
    hold(wb, {"SUM(IF(A1:A3>1,A1:A3,0))": lambda r: float(sum(x for x in nums(part(X, r, r + 2)) if x > 1)), "MAX(A1:A3*C1:C3)": lambda r: max((x or 0) * (y or 0) for x, y in zip(part(X, r, r + 2), part(Y, r, r + 2)))})


def test_filter_by_shifted_rows_and_unique_columns(spark, wb):
    rows = wb.eval("=FILTER(A1:A3,C2:C4>20)", "S").collect()
    assert sorted(r._row for r in rows) == [3]
    assert [r.x for r in wb.eval("=FILTER(A5:A7,(T!A1:A3>0)*(T!B1:B3>-2))", "S").collect()] == [3.0]
    w2 = Workbook()
    w2.add(Sheet("U", spark.createDataFrame([(1, 1.0, "a", 1.0, "A", 2.0), (2, None, "b", None, "B", 3.0)], "_row bigint, a double, b string, c double, d string, e double"), row="_row"))
    assert w2.eval("=UNIQUE(A:E,TRUE)", "U").columns == ["a", "b", "e", "_row"] and w2.eval("=UNIQUE(A:E,TRUE,TRUE)", "U").columns == ["e", "_row"]


def test_ranges_to_the_last_row_of_the_grid_go_to_the_end_of_the_table(spark):
    rows = [(n, float(n % 10), "k") for n in (1, 999_999, 1_000_001, 1_048_576, 1_048_577, 3_000_000)]
    wb = Workbook()
    wb.add(Sheet("L", spark.createDataFrame(rows, "_row bigint, a double, b string"), row="_row"))
    out = wb.fill_all("L", {"rest": "=SUM(A1:$A$1048576)", "n": "=COUNTIF(B1:B$1048576,B1)", "all": "=SUM($A$2:$A$1048576)", "at": "=MATCH(7,$A$1:$A$1048576,0)", "part": "=SUM(A1:$A$1048575)"})
    got = {r._row: r for r in out.df.collect()}
    for n, _, _ in rows:
        assert got[n].rest == sum(a for m, a, _ in rows if m >= n) and got[n].n == sum(m >= n for m, _, _ in rows)
        assert got[n].all == sum(a for m, a, _ in rows if m >= 2) and got[n].at == 1_048_577
        assert got[n].part == sum(a for m, a, _ in rows if n <= m <= 1_048_575)


def test_running_sum_beyond_a_million_rows(spark, tmp_path):
    from lattica.queries import QUERIES

    keys = [0, 5, 999_999, 1_000_000, 2_000_000]
    spark.createDataFrame([(k, 1, "O", k + 0.25, None, "") for k in keys], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.o_orderkey: r for r in QUERIES["running_sum"](spark, str(tmp_path)).collect()}
    assert {k: r.rest for k, r in got.items()} == {k: sum(x + 0.25 for x in keys if x >= k) for k in keys}
