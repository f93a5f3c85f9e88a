"""Registered queries over the driver's tables and the SQL that states the same.

Tables are sheets; where a key counts rows from 0, _row is the key plus one. Formulas go through the parser and binder like any user's. Sums and quotients are rounded on both sides, since the order of addition is free.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import table
from lattica.plans import ordered
from lattica.recalc import Model, data_table
from lattica.shared import shared_folder
from lattica.sheet import Sheet, Workbook
from lattica.sources import text, xlsx
from lattica.streaming import stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id"}


def book(spark: SparkSession, d: str, *names: str) -> Workbook:
    wb = Workbook(today="2024-06-30", seed=7)
    for n in names:
        df = spark.read.parquet(f"{d}/{n}.parquet")
        if n in KEYS:
            wb.add(Sheet(n, df.withColumn("_row", F.col(KEYS[n]) + 1), row="_row"))
        else:
            wb.add(Sheet(n, df))
    return wb


def query(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def shaped(col: Column, kind: str, places: int) -> Column:
    return F.round(col.cast("double"), places) + F.lit(0.0) if kind in ("double", "float") or kind.startswith("decimal") else col.cast("string") if kind in ("date", "timestamp", "timestamp_ntz") else col.cast("bigint") if kind in ("int", "bigint", "smallint", "tinyint") else col


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    return df.select(*[shaped(F.col(f"`{c}`"), t, places).alias(c) for c, t in df.dtypes])


def scalars(name: str, sheets: list[str], formulas: dict[str, str], sql: str, places: int = 4) -> None:
    """One row of scalar formulas. Columns of errors are kept where the SQL has them (<name>_error)."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        from lattica.binder import Binder
        from lattica.parser import parse

        wb = book(spark, d, *sheets)
        b = Binder(wb, wb.sheet(sheets[0]))
        out = []
        for n, f in formulas.items():
            v = b.value(parse(f))
            if n.endswith("_error"):
                out.append((F.lit(None).cast("string") if v.err is None else v.err).alias(n))
            else:
                out.append((v.col if v.err is None else F.when(v.err.isNull(), v.col)).alias(n))
        return rounded(spark.range(1).select(*out), places)

    query(name, sql)(run)


def fills(name: str, sheet: str, formulas: dict[str, str], keep: list[str], sql: str, others: tuple[str, ...] = (), places: int = 4, errors: tuple[str, ...] = ()) -> None:
    """Formulas filled down a sheet, written as for its first row."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        wb = book(spark, d, sheet, *others)
        out = wb.fill_all(sheet, formulas, errors=bool(errors))
        return rounded(out.df.select(*keep, *formulas, *[out.errors[c] for c in errors]), places)

    query(name, sql)(run)


def R(x: str, n: int = 4) -> str:
    return f"round(CAST({x} AS DOUBLE), {n})"


# --- aggregates --------------------------------------------------------------------

scalars("sumifs_scalar", ["lineitem"], {"value": '=SUMIFS(F:F, I:I, "R", E:E, ">24")'}, f"SELECT {R('coalesce(sum(l_extendedprice), 0)', 2)} AS value FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 24", 2)
for _fn, _sql in {
    "SUM": "coalesce(sum(l_extendedprice), 0)", "COUNT": "count(l_extendedprice)", "COUNTA": "count(l_returnflag)", "AVERAGE": "avg(l_extendedprice)", "MIN": "min(l_extendedprice)", "MAX": "max(l_extendedprice)",
    "MEDIAN": "median(l_extendedprice)", "STDEV": "stddev_samp(l_extendedprice)", "STDEVP": "stddev_pop(l_extendedprice)", "VAR": "var_samp(l_quantity)", "VARP": "var_pop(l_quantity)",
}.items():
    _col = "I:I" if _fn == "COUNTA" else "E:E" if _fn.startswith("VAR") else "F:F"
    scalars(f"agg_{_fn.lower()}", ["lineitem"], {"value": f"={_fn}({_col})"}, f"SELECT {_sql if _fn.startswith('COUNT') else R(_sql, 2)} AS value FROM lineitem", 2)


def _blanks(spark: SparkSession, d: str) -> Workbook:
    """lineitem with an emptied quantity wherever the line number is 3."""
    wb = Workbook()
    df = spark.read.parquet(f"{d}/lineitem.parquet")
    wb.add(Sheet("lines", df.select(F.when(F.col("l_linenumber") != 3, F.col("l_quantity")).alias("q"), F.when(F.col("l_linenumber") != 5, F.col("l_returnflag")).alias("f"), "l_shipdate", "l_extendedprice"), ["q", "f", "l_shipdate", "l_extendedprice"]))
    return wb


@query("agg_blanks", """SELECT count(q) AS n, count(*) - count(q) AS blank, count(f) AS texts, round(avg(q), 4) AS mean, CAST(count(*) FILTER (WHERE q IS NULL OR q <> 5) - count(*) FILTER (WHERE q IS NULL) AS BIGINT) AS not5, count(*) FILTER (WHERE f IS NULL OR lower(f) <> 'n') AS notn, count(f) AS nonblank, count(*) FILTER (WHERE f IS NULL) AS emptytext
FROM (SELECT CASE WHEN l_linenumber <> 3 THEN l_quantity END AS q, CASE WHEN l_linenumber <> 5 THEN l_returnflag END AS f FROM lineitem)""")
def _agg_blanks(spark: SparkSession, d: str) -> DataFrame:
    wb = _blanks(spark, d)
    forms = {"n": "COUNT(A:A)", "blank": "COUNTBLANK(A:A)", "texts": "COUNTA(B:B)", "mean": "AVERAGE(A:A)", "not5": 'COUNTIF(A:A,"<>5")', "notn": 'COUNTIF(B:B,"<>n")', "nonblank": 'COUNTIF(B:B,"<>")', "emptytext": 'COUNTIF(B:B,"")'}
    from lattica.binder import Binder
    from lattica.parser import parse

    b = Binder(wb, wb.sheet("lines"))
    return rounded(spark.range(1).select(*[b.value(parse(f)).col.alias(n) for n, f in forms.items()]))


scalars("agg_multi_range", ["lineitem"], {"total": "=SUM(E:F, 10)", "n": "=COUNT(E:H)", "low": "=MIN(G:H)", "high": "=MAX(E:E, G:G)", "mid": "=MEDIAN(G:H)"},
        f"SELECT {R('sum(l_quantity) + sum(l_extendedprice) + 10', 2)} AS total, 4 * count(*) AS n, {R('least(min(l_discount), min(l_tax))', 2)} AS low, {R('greatest(max(l_quantity), max(l_discount))', 2)} AS high, (SELECT {R('median(v)', 2)} FROM (SELECT l_discount AS v FROM lineitem UNION ALL SELECT l_tax FROM lineitem)) AS mid FROM lineitem", 2)

# --- order statistics --------------------------------------------------------------

scalars("large_small", ["customer"], {"l1": "=LARGE(D:D,1)", "l5": "=LARGE(D:D,5)", "s1": "=SMALL(D:D,1)", "s7": "=SMALL(D:D,7)", "far_error": "=LARGE(D:D,100000000)"},
        "SELECT (SELECT c_acctbal FROM customer ORDER BY c_acctbal DESC LIMIT 1) AS l1, (SELECT c_acctbal FROM customer ORDER BY c_acctbal DESC LIMIT 1 OFFSET 4) AS l5, (SELECT c_acctbal FROM customer ORDER BY c_acctbal LIMIT 1) AS s1, (SELECT c_acctbal FROM customer ORDER BY c_acctbal LIMIT 1 OFFSET 6) AS s7, '#NUM!' AS far_error")
scalars("percentile_quartile", ["lineitem"], {"p33": "=PERCENTILE(F:F,0.33)", "p99": "=PERCENTILE(F:F,0.99)", "q1": "=QUARTILE(F:F,1)", "q2": "=QUARTILE(F:F,2)", "q4": "=QUARTILE(F:F,4)", "bad_error": "=PERCENTILE(F:F,1.5)"},
        f"SELECT {R('quantile_cont(l_extendedprice, 0.33)')} AS p33, {R('quantile_cont(l_extendedprice, 0.99)')} AS p99, {R('quantile_cont(l_extendedprice, 0.25)')} AS q1, {R('quantile_cont(l_extendedprice, 0.5)')} AS q2, max(l_extendedprice) AS q4, '#NUM!' AS bad_error FROM lineitem")
fills("rank_filled", "part", {"size_rank": "=RANK(E1,$E:$E)", "price_up": "=RANK(F1,F:F,1)"}, ["p_partkey"], "SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS size_rank, rank() OVER (ORDER BY p_retailprice) AS price_up FROM part")

# --- conditional aggregates --------------------------------------------------------

scalars("sumif_family", ["lineitem"], {
    "sumif": '=SUMIF(I:I,"r",F:F)', "sumif2": '=SUMIF(E:E,">=49")', "countif": '=COUNTIF(G:G,0.05)', "countifs": '=COUNTIFS(I:I,"A",J:J,"F",E:E,"<10")', "averageif": '=AVERAGEIF(I:I,"N",E:E)', "averageifs": '=AVERAGEIFS(F:F,J:J,"O",G:G,"<>0.05")',
    "maxifs": '=MAXIFS(F:F,I:I,"<>R",E:E,"<=5")', "minifs": '=MINIFS(F:F,I:I,"R",H:H,0.02)', "none": '=SUMIFS(F:F,I:I,"Q")', "nomax": '=MAXIFS(F:F,I:I,"Q")', "noavg_error": '=AVERAGEIF(I:I,"Q",E:E)'},
    f"""SELECT {R("sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice END)", 2)} AS sumif, {R("sum(CASE WHEN l_quantity >= 49 THEN l_quantity END)", 2)} AS sumif2, count(*) FILTER (WHERE l_discount = 0.05) AS countif, count(*) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F' AND l_quantity < 10) AS countifs,
    {R("avg(CASE WHEN l_returnflag = 'N' THEN l_quantity END)", 2)} AS averageif, {R("avg(CASE WHEN l_linestatus = 'O' AND l_discount <> 0.05 THEN l_extendedprice END)", 2)} AS averageifs, max(CASE WHEN l_returnflag <> 'R' AND l_quantity <= 5 THEN l_extendedprice END) AS maxifs, min(CASE WHEN l_returnflag = 'R' AND l_tax = 0.02 THEN l_extendedprice END) AS minifs,
    CAST(0 AS DOUBLE) AS "none", CAST(0 AS DOUBLE) AS nomax, '#DIV/0!' AS noavg_error FROM lineitem""", 2)
scalars("criteria_wildcards", ["part"], {"starts": '=COUNTIF(B:B,"RED*")', "one": '=COUNTIF(C:C,"brand#?")', "not": '=COUNTIF(B:B,"<>*ring")', "text_gt": '=COUNTIF(B:B,">m")', "number_text": '=COUNTIF(E:E,"=11")', "exact": '=COUNTIF(B:B,"=red widget")', "digits": '=COUNTIF(E:E,"1?")', "escaped": '=COUNTIF(B:B,"red~*")'},
        "SELECT count(*) FILTER (WHERE lower(p_name) LIKE 'red%') AS starts, count(*) FILTER (WHERE length(p_brand) = 7 AND lower(p_brand) LIKE 'brand#%') AS one, count(*) FILTER (WHERE lower(p_name) NOT LIKE '%ring') AS \"not\", count(*) FILTER (WHERE lower(p_name) > 'm') AS text_gt, count(*) FILTER (WHERE p_size = 11) AS number_text, count(*) FILTER (WHERE lower(p_name) = 'red widget') AS exact, count(*) FILTER (WHERE p_size BETWEEN 10 AND 19) AS digits, CAST(0 AS BIGINT) AS escaped FROM part")
scalars("sumproduct", ["lineitem"], {"plain": "=SUMPRODUCT(E:E,F:F)", "masked": '=SUMPRODUCT((E:E>15)*(I:I="r")*F:F)', "three": "=SUMPRODUCT(F:F,1-G:G,1+H:H)", "texts": "=SUMPRODUCT(I:I,E:E)"},
        f"SELECT {R('sum(l_quantity * l_extendedprice)', 0)} AS plain, {R(chr(39).join(['sum(CASE WHEN l_quantity > 15 AND l_returnflag = ', 'R', ' THEN l_extendedprice ELSE 0 END)']), 0)} AS masked, {R('sum(l_extendedprice * (1 - l_discount) * (1 + l_tax))', 0)} AS three, CAST(0 AS DOUBLE) AS texts FROM lineitem", 0)
fills("sumifs_filled", "customer", {"spent": "=SUMIFS(orders!D:D,orders!B:B,A1)", "n": "=COUNTIF(orders!B:B,A1)", "mean": "=AVERAGEIF(orders!B:B,A1,orders!D:D)", "top": "=MAXIFS(orders!D:D,orders!B:B,A1)", "urgent": '=COUNTIFS(orders!B:B,A1,orders!F:F,"1-*")'}, ["c_custkey"],
      f"SELECT c_custkey, {R('coalesce(sum(o_totalprice), 0)', 6)} AS spent, count(o_orderkey) AS n, {R('avg(o_totalprice)', 6)} AS mean, coalesce(max(o_totalprice), 0) AS top, count(*) FILTER (WHERE o_orderpriority LIKE '1-%') AS urgent, CASE WHEN count(o_orderkey) = 0 THEN '#DIV/0!' END AS mean__err FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", ("orders",), 6, ("mean",))

# --- lookups -----------------------------------------------------------------------

fills("vlookup_exact", "orders", {"customer": "=VLOOKUP(B1,customer!A:B,2,FALSE)", "nation": "=VLOOKUP(VLOOKUP(B1,customer!A:C,3,FALSE),nation!A:B,2,FALSE)"}, ["o_orderkey"], "SELECT o_orderkey, c_name AS customer, n_name AS nation FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON n_nationkey = c_nationkey", ("customer", "nation"))
fills("xlookup_exact", "part", {"first_key": "=XLOOKUP(C1,C:C,A:A)", "last_key": "=XLOOKUP(C1,C:C,A:A,0,0,-1)", "missing": '=XLOOKUP(B1&"?",B:B,A:A,-1)'}, ["p_partkey"], "SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_brand) AS first_key, CAST(max(p_partkey) OVER (PARTITION BY p_brand) AS DOUBLE) AS last_key, CAST(-1 AS DOUBLE) AS missing FROM part")
fills("match_exact", "orders", {"place": "=MATCH(B1,customer!A:A,0)", "miss": "=IFERROR(MATCH(-1,customer!A:A,0),0)"}, ["o_orderkey"], "SELECT o_orderkey, CAST(o_custkey + 1 AS DOUBLE) AS place, CAST(0 AS DOUBLE) AS miss FROM orders", ("customer",))
fills("index_match", "orders", {"segment": "=INDEX(customer!E:E,MATCH(B1,customer!A:A,0))"}, ["o_orderkey"], "SELECT o_orderkey, c_mktsegment AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey", ("customer",))
fills("asof_backward", "orders", {"vlookup": "=VLOOKUP(D1/100,part!F:F,1,TRUE)", "match": "=MATCH(D1/100,part!F:F,1)", "xlookup": "=XLOOKUP(D1/100,part!F:F,part!A:A,-1,-1)"}, ["o_orderkey"],
      f"""WITH p AS (SELECT p_retailprice AS k, min(p_partkey) + 1 AS first, max(p_partkey) AS last FROM part GROUP BY 1)
      SELECT o_orderkey, {R('k')} AS vlookup, CAST(first AS DOUBLE) AS "match", CAST(coalesce(last, -1) AS DOUBLE) AS xlookup FROM orders ASOF LEFT JOIN p ON o_totalprice / 100 >= k""", ("part",))
fills("asof_forward", "orders", {"match": "=IFERROR(MATCH(D1/100,part!F:F,-1),0)", "xlookup": "=XLOOKUP(D1/100,part!F:F,part!A:A,-1,1)"}, ["o_orderkey"],
      """WITH p AS (SELECT p_retailprice AS k, min(p_partkey) AS first FROM part GROUP BY 1)
      SELECT o_orderkey, CAST(coalesce(first + 1, 0) AS DOUBLE) AS "match", CAST(coalesce(first, -1) AS DOUBLE) AS xlookup FROM orders ASOF LEFT JOIN p ON o_totalprice / 100 <= k""", ("part",))
scalars("lookup_scalars", ["part"], {"wild": '=XLOOKUP("red*",B:B,A:A,,2)'.replace(",,", ",-1,"), "wild_last": '=XLOOKUP("*ring",B:B,A:A,-1,2,-1)', "vl": "=VLOOKUP(950,F:F,1)", "cell": "=B5", "idx": "=INDEX(A:F,10,6)", "miss_error": '=XLOOKUP("zzz",B:B,A:A)', "ifna": '=IFNA(XLOOKUP("zzz",B:B,A:A),-5)', "host_error": '=VLOOKUP("zzz",B:C,2,FALSE)'},
        f"SELECT CAST(min(CASE WHEN lower(p_name) LIKE 'red%' THEN p_partkey END) AS DOUBLE) AS wild, CAST(max(CASE WHEN lower(p_name) LIKE '%ring' THEN p_partkey END) AS DOUBLE) AS wild_last, {R('max(CASE WHEN p_retailprice <= 950 THEN p_retailprice END)')} AS vl, max(CASE WHEN p_partkey = 4 THEN p_name END) AS cell, {R('max(CASE WHEN p_partkey = 9 THEN p_retailprice END)')} AS idx, '#N/A' AS miss_error, CAST(-5 AS DOUBLE) AS ifna, '#HOST!' AS host_error FROM part")
scalars("hlookup", ["nation"], {"exact": '=HLOOKUP("NATION_4",A5:C6,2,FALSE)', "rows": '=HLOOKUP(3,A4:A9,3,FALSE)', "approx": "=HLOOKUP(2.5,A3:A8,4)"}, "SELECT 'NATION_5' AS exact, CAST(5 AS BIGINT) AS rows, CAST(5 AS BIGINT) AS approx")
fills("semi_anti", "customer", {"has": "=COUNTIF(orders!B:B,A1)>0", "none": "=COUNTIF(orders!B:B,A1)=0"}, ["c_custkey"], 'SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has, c_custkey NOT IN (SELECT o_custkey FROM orders) AS "none" FROM customer', ("orders",))

# --- windows by fill-down ----------------------------------------------------------

fills("running_sum", "orders", {"total": "=SUM($D$1:D1)", "n": "=COUNT($D$1:D1)", "low": "=MIN($D$1:D1)", "high": "=MAX($D$1:D1)", "rest": "=SUM(D1:$D$1048576)"}, ["o_orderkey"],
      f"SELECT o_orderkey, {R('sum(o_totalprice) OVER w', 2)} AS total, count(*) OVER w AS n, min(o_totalprice) OVER w AS low, max(o_totalprice) OVER w AS high, {R('sum(o_totalprice) OVER (ORDER BY o_orderkey DESC)', 2)} AS rest FROM orders WINDOW w AS (ORDER BY o_orderkey)", (), 2)
fills("sliding_window", "orders", {"ahead": "=AVERAGE(D1:D7)", "wide": "=SUM(D1:D3)", "high": "=MAX(D2:D4)", "dev": "=STDEV(D1:D5)", "mid": "=MEDIAN(D1:D4)"}, ["o_orderkey"],
      f"SELECT o_orderkey, {R('avg(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)', 6)} AS ahead, {R('sum(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING)', 6)} AS wide, coalesce(max(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS high, {R('stddev_samp(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)', 6)} AS dev, {R('median(o_totalprice) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)', 6)} AS mid FROM orders", (), 6)


@query("lag_lead", f"SELECT o_orderkey, {R('o_totalprice - coalesce(lag(o_totalprice) OVER w, 0)', 2)} AS step, {R('coalesce(lead(o_totalprice) OVER w, 0)', 2)} AS next FROM orders WINDOW w AS (ORDER BY o_orderkey)")
def _lag_lead(spark: SparkSession, d: str) -> DataFrame:
    wb = book(spark, d, "orders")
    out = wb.fill_all("orders", {"step": "=D2-D1", "next": "=D3"}, base_row=2)
    return rounded(out.df.select("o_orderkey", "step", F.coalesce("next", F.lit(0.0)).alias("next")), 2)


fills("rowwise", "lineitem", {"net": "=F1*(1-G1)*(1+H1)", "band": '=IF(E1>40,"high",IF(E1>20,"mid","low"))', "share": "=F1/SUM(F:F)*1000000", "label": '=I1&"-"&J1&"-"&D1', "best": "=MAX(G1:H1)", "both": "=SUM(G1:H1)"}, ["l_orderkey", "l_partkey", "l_linenumber"],
      f"SELECT l_orderkey, l_partkey, l_linenumber, {R('l_extendedprice * (1 - l_discount) * (1 + l_tax)', 6)} AS net, CASE WHEN l_quantity > 40 THEN 'high' WHEN l_quantity > 20 THEN 'mid' ELSE 'low' END AS band, {R('l_extendedprice / sum(l_extendedprice) OVER () * 1000000', 6)} AS share, l_returnflag || '-' || l_linestatus || '-' || l_linenumber AS label, greatest(l_discount, l_tax) AS best, {R('l_discount + l_tax', 6)} AS both FROM lineitem", (), 6)

# --- scalar functions --------------------------------------------------------------

fills("math_functions", "customer", {
    "abs": "=ABS(D1)", "sqrt": "=SQRT(ABS(D1))", "round": "=ROUND(D1,-2)", "rup": "=ROUNDUP(D1,1)", "rdn": "=ROUNDDOWN(D1,1)", "mod": "=MOD(A1,-7)", "pow": "=POWER(C1,2)", "log": "=LOG(A1+1,2)", "ln": "=LN(A1+1)", "exp": "=EXP(C1/10)",
    "floor": "=FLOOR(A1,7)", "ceil": "=CEILING(A1,7)", "mround": "=MROUND(A1,5)", "trunc": "=TRUNC(D1)", "sign": "=SIGN(D1)", "int": "=INT(D1)", "pi": "=PI()", "neg": "=-2^2", "pct": "=C1%"}, ["c_custkey"],
    f"""SELECT c_custkey, abs(c_acctbal) AS abs, {R('sqrt(abs(c_acctbal))')} AS sqrt, {R('round(c_acctbal / 100) * 100')} AS round, {R('sign(c_acctbal) * ceil(round(abs(c_acctbal) * 10, 9)) / 10')} AS rup, {R('sign(c_acctbal) * floor(round(abs(c_acctbal) * 10, 9)) / 10')} AS rdn, {R('c_custkey - (-7) * floor(c_custkey / -7.0)')} AS mod, {R('c_nationkey * c_nationkey')} AS pow,
    {R('log2(c_custkey + 1)')} AS log, {R('ln(c_custkey + 1)')} AS ln, {R('exp(c_nationkey / 10.0)')} AS exp, {R('floor(c_custkey / 7.0) * 7')} AS floor, {R('ceil(c_custkey / 7.0) * 7')} AS ceil, {R('floor(c_custkey / 5.0 + 0.5) * 5')} AS mround, {R('trunc(c_acctbal)')} AS trunc, {R('sign(c_acctbal)')} AS sign, {R('floor(c_acctbal)')} AS int, {R('pi()')} AS pi, CAST(-4 AS DOUBLE) AS neg, {R('c_nationkey / 100.0')} AS pct FROM customer""")
fills("text_functions", "part", {
    "con": '=CONCATENATE(B1,"/",E1,"/",TRUE)', "left": "=LEFT(B1,3)", "right": "=RIGHT(B1,4)", "len": "=LEN(B1)", "up": "=UPPER(B1)", "low": "=LOWER(C1)", "trim": '=TRIM("  "&B1&"   x ")', "mid": "=MID(B1,2,4)", "find": '=IFERROR(FIND("r",B1),0)', "search": '=IFERROR(SEARCH("R?d",B1),0)',
    "sub": '=SUBSTITUTE(B1,"e","3")', "sub2": '=SUBSTITUTE(B1,"e","3",2)', "value": '=VALUE("$1,"&(200+E1))', "amp": '=B1&"-"&E1'}, ["p_partkey"],
    """SELECT p_partkey, p_name || '/' || p_size || '/TRUE' AS con, left(p_name, 3) AS "left", right(p_name, 4) AS "right", CAST(length(p_name) AS DOUBLE) AS len, upper(p_name) AS up, lower(p_brand) AS low, trim(regexp_replace(p_name, ' +', ' ', 'g')) || ' x' AS trim, substr(p_name, 2, 4) AS mid, CAST(instr(p_name, 'r') AS DOUBLE) AS find,
    CAST(CASE WHEN regexp_matches(lower(p_name), 'r.d') THEN length(regexp_extract(lower(p_name), '^(.*?)r.d', 1)) + 1 ELSE 0 END AS DOUBLE) AS search, replace(p_name, 'e', '3') AS sub, regexp_replace(p_name, '^([^e]*e[^e]*)e', '\\13') AS sub2, CAST(1200 + p_size AS DOUBLE) AS value, p_name || '-' || p_size AS amp FROM part""")
fills("text_formats", "orders", {"money": '=TEXT(D1,"#,##0.00")', "whole": '=TEXT(D1,"0")', "pct": '=TEXT(A1/30000,"0.00%")', "iso": '=TEXT(E1,"yyyy-mm-dd")', "us": '=TEXT(E1,"m/d/yy")', "dollar": '=TEXT(D1,"$#,##0.00")'}, ["o_orderkey"],
      "SELECT o_orderkey, format('{:,.2f}', round(o_totalprice, 2)) AS money, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS whole, printf('%.2f', o_orderkey / 300.0) || '%' AS pct, strftime(o_orderdate, '%Y-%m-%d') AS iso, strftime(o_orderdate, '%-m/%-d/%y') AS us, '$' || format('{:,.2f}', round(o_totalprice, 2)) AS dollar FROM orders")
fills("date_functions", "orders", {
    "y": "=YEAR(E1)", "m": "=MONTH(E1)", "d": "=DAY(E1)", "eom": "=EOMONTH(E1,1)", "ed": "=EDATE(E1,-3)", "mk": "=DATE(YEAR(E1),MONTH(E1),1)", "serial": "=E1+0", "months": '=DATEDIF(E1,DATE(2005,1,15),"m")', "days": '=DATEDIF(E1,DATE(2005,1,15),"d")', "years": '=DATEDIF(E1,DATE(2005,1,15),"y")',
    "net": "=NETWORKDAYS(E1,DATE(2002,3,31))", "work": "=WORKDAY(E1,10)", "yf3": "=YEARFRAC(E1,DATE(2002,3,31),3)", "yf4": "=YEARFRAC(E1,DATE(2002,3,31),4)", "yf2": "=YEARFRAC(E1,DATE(2002,3,31),2)", "now": "=TODAY()"}, ["o_orderkey"],
    f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS e, DATE '2002-03-31' AS z FROM orders)
    SELECT o_orderkey, CAST(year(e) AS DOUBLE) AS y, CAST(month(e) AS DOUBLE) AS m, CAST(day(e) AS DOUBLE) AS d, strftime(last_day(e + INTERVAL 1 MONTH), '%Y-%m-%d') AS eom, strftime(e - INTERVAL 3 MONTH, '%Y-%m-%d') AS ed, strftime(date_trunc('month', e), '%Y-%m-%d') AS mk, CAST(date_diff('day', DATE '1899-12-30', e) AS DOUBLE) AS serial,
    CAST((2005 - year(e)) * 12 + 1 - month(e) - CASE WHEN 15 < day(e) THEN 1 ELSE 0 END AS DOUBLE) AS months, CAST(date_diff('day', e, DATE '2005-01-15') AS DOUBLE) AS days, CAST(((2005 - year(e)) * 12 + 1 - month(e) - CASE WHEN 15 < day(e) THEN 1 ELSE 0 END) // 12 AS DOUBLE) AS years,
    CAST(CASE WHEN e <= z THEN (SELECT count(*) FROM range(e, z + 1, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) ELSE -(SELECT count(*) FROM range(z, e + 1, INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6) END AS DOUBLE) AS net,
    strftime(CASE WHEN isodow(e) < 6 THEN e + 14 ELSE e - CAST(isodow(e) - 5 AS INTEGER) + 14 END, '%Y-%m-%d') AS work, {R("abs(date_diff('day', e, z)) / 365.0")} AS yf3, {R("abs((2002 - year(e)) * 360 + (3 - month(e)) * 30 + 30 - least(day(e), 30)) / 360.0")} AS yf4, {R("abs(date_diff('day', e, z)) / 360.0")} AS yf2, '2024-06-30' AS now FROM o""")
fills("logic_functions", "orders", {
    "ifs": '=IFS(D1>400000,"big",D1>100000,"mid",TRUE,"small")', "switch": '=SWITCH(C1,"f","done","O","open","other")', "choose": '=CHOOSE(MOD(A1,3)+1,"x","y","z")', "both": '=AND(D1>100000,C1="F")', "any": '=OR(D1>400000,C1="p")', "no": '=NOT(C1="F")', "infix": "=D1>1000 AND D1<200000", "cmp": '=C1<D1', "let": "=LET(x,D1/2,y,x+1,ROUND(x*y,0))"}, ["o_orderkey"],
    f"SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS ifs, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS switch, CASE o_orderkey % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS choose, o_totalprice > 100000 AND o_orderstatus = 'F' AS \"both\", o_totalprice > 400000 OR o_orderstatus = 'P' AS \"any\", o_orderstatus <> 'F' AS no, o_totalprice > 1000 AND o_totalprice < 200000 AS infix, FALSE AS cmp, {R('round(o_totalprice / 2 * (o_totalprice / 2 + 1))', 0)} AS let FROM orders", (), 0)
fills("error_functions", "lineitem", {"inv": "=1/(D1-1)", "safe": "=IFERROR(1/(D1-1),-1)", "iserr": "=ISERROR(1/(D1-1))", "isna": "=ISNA(1/(D1-1))", "iserr2": "=ISERR(1/(D1-1))", "na": "=IFNA(IF(D1=2,NA(),D1),0)", "num": "=ISNUMBER(D1)", "txt": "=ISTEXT(I1)", "blank": "=ISBLANK(D1)", "n": "=N(I1)", "nt": "=N(D1=1)", "prop": "=IFERROR(SQRT(D1-3)+1/(D1-5),0)"}, ["l_orderkey", "l_partkey", "l_linenumber"],
      f"""SELECT l_orderkey, l_partkey, l_linenumber, {R('CASE WHEN l_linenumber <> 1 THEN 1.0 / (l_linenumber - 1) END')} AS inv, {R('CASE WHEN l_linenumber <> 1 THEN 1.0 / (l_linenumber - 1) ELSE -1 END')} AS safe, l_linenumber = 1 AS iserr, FALSE AS isna, l_linenumber = 1 AS iserr2, CAST(CASE WHEN l_linenumber = 2 THEN 0 ELSE l_linenumber END AS DOUBLE) AS na, TRUE AS num, TRUE AS txt, FALSE AS blank, CAST(0 AS DOUBLE) AS n, CAST(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS DOUBLE) AS nt,
      {R('CASE WHEN l_linenumber < 3 OR l_linenumber = 5 THEN 0 ELSE sqrt(greatest(l_linenumber - 3, 0)) + 1.0 / CASE WHEN l_linenumber = 5 THEN 1 ELSE l_linenumber - 5 END END')} AS prop, CASE WHEN l_linenumber = 1 THEN '#DIV/0!' END AS inv__err FROM lineitem""", errors=("inv",))
fills("reference_functions", "nation", {"row": "=ROW()", "row2": "=ROW(A3)", "col": "=COLUMN(B1)", "rows": "=ROWS($A$1:$A$9)", "cols": "=COLUMNS(A:C)", "addr": "=ADDRESS(ROW(),2)", "addr4": '=ADDRESS(ROW(),30,4,TRUE,"My Sheet")', "cell": '=CELL("address",B1)', "link": '=HYPERLINK("http://example.com/"&A1,B1)', "off": "=OFFSET($A$1,3,0)", "ind": '=INDIRECT("B2")', "offsum": "=SUM(OFFSET($A$1,0,0,5,1))"}, ["n_nationkey"],
      "SELECT n_nationkey, CAST(n_nationkey + 1 AS DOUBLE) AS row, CAST(n_nationkey + 3 AS DOUBLE) AS row2, CAST(2 AS DOUBLE) AS col, CAST(9 AS DOUBLE) AS rows, CAST(3 AS DOUBLE) AS cols, '$B$' || (n_nationkey + 1) AS addr, '''My Sheet''!AD' || (n_nationkey + 1) AS addr4, '$B$' || (n_nationkey + 1) AS cell, n_name AS link, CAST(3 AS BIGINT) AS off, 'NATION_1' AS ind, CAST(10 AS DOUBLE) AS offsum FROM nation")
fills("financial_functions", "customer", {"pmt": "=PMT(0.05/12,360,ABS(D1)*100)", "fv": "=FV(0.01,12,-100,D1)", "pv": "=PV(0.01,24,C1+1,100,1)", "nper": "=NPER(0.01,-200,ABS(D1))", "flat": "=PMT(0,10,D1)", "rate": "=ROUND(RATE(48,-(C1+30),1000),6)"}, ["c_custkey"],
      f"""SELECT c_custkey, {R('-(0.05/12) * abs(c_acctbal) * 100 * pow(1 + 0.05/12, 360) / (pow(1 + 0.05/12, 360) - 1)', 3)} AS pmt, {R('-(c_acctbal * pow(1.01, 12) - 100 * (pow(1.01, 12) - 1) / 0.01)', 3)} AS fv, {R('-(100 + (c_nationkey + 1) * 1.01 * (pow(1.01, 24) - 1) / 0.01) / pow(1.01, 24)', 3)} AS pv, {R('CASE WHEN abs(c_acctbal) * 0.01 < 200 THEN ln(-200 / (-200 + abs(c_acctbal) * 0.01)) / ln(1.01) END', 3)} AS nper, {R('-c_acctbal / 10', 3)} AS flat, r AS rate
      FROM customer JOIN (SELECT k, round((lo + hi) / 2, 6) AS r FROM (WITH RECURSIVE b(k, lo, hi, i) AS (SELECT range, CAST(1e-9 AS DOUBLE), CAST(1 AS DOUBLE), 0 FROM range(0, 30) UNION ALL SELECT k, CASE WHEN f > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f > 0 THEN hi ELSE (lo + hi) / 2 END, i + 1 FROM (SELECT *, (k + 30) * (1 - pow(1 + (lo + hi) / 2, -48)) / ((lo + hi) / 2) - 1000 AS f FROM b WHERE i < 50)) SELECT * FROM b WHERE i = 50)) ON k = c_nationkey""", (), 3)
ORACLE_SQL["financial_functions"] = ORACLE_SQL["financial_functions"].replace(" r AS rate", " round(r, 3) AS rate")
scalars("npv", ["orders"], {"npv": "=NPV(0.1,D1:D20)", "npv2": "=NPV(0.01,D1:D200)"}, f"SELECT (SELECT {R('sum(o_totalprice / pow(1.1, o_orderkey + 1))', 2)} FROM orders WHERE o_orderkey < 20) AS npv, (SELECT {R('sum(o_totalprice / pow(1.01, o_orderkey + 1))', 2)} FROM orders WHERE o_orderkey < 200) AS npv2", 2)


@query("irr_xirr", """
WITH RECURSIVE months AS (SELECT date_trunc('month', o_orderdate) AS d, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v FROM orders GROUP BY 1
), flows AS (SELECT min(d) - INTERVAL 1 MONTH AS d, CAST(-0.8 * sum(v) AS DOUBLE) AS v FROM months UNION ALL SELECT d, CAST(v AS DOUBLE) FROM months
), placed AS (SELECT v, row_number() OVER (ORDER BY d) - 1 AS i, date_diff('day', min(d) OVER (), d) / 365.0 AS t FROM flows
), whole AS (SELECT list({'v': v, 'i': i, 't': t}) AS p FROM placed
), halved(n, lo, hi, xlo, xhi) AS (
  SELECT 0, CAST(-0.9 AS DOUBLE), CAST(2 AS DOUBLE), CAST(-0.9 AS DOUBLE), CAST(2 AS DOUBLE)
  UNION ALL SELECT n + 1, CASE WHEN f > 0 THEN (lo + hi) / 2 ELSE lo END, CASE WHEN f > 0 THEN hi ELSE (lo + hi) / 2 END, CASE WHEN x > 0 THEN (xlo + xhi) / 2 ELSE xlo END, CASE WHEN x > 0 THEN xhi ELSE (xlo + xhi) / 2 END
  FROM (SELECT h.*, list_sum(list_transform(p, lambda y: y.v / pow(1 + (lo + hi) / 2, y.i))) AS f, list_sum(list_transform(p, lambda y: y.v / pow(1 + (xlo + xhi) / 2, y.t))) AS x FROM halved h, whole WHERE n < 60)
) SELECT round((lo + hi) / 2, 4) AS irr, round((xlo + xhi) / 2, 4) AS xirr, (SELECT round(sum(v / pow(1.1, t)), 4) FROM placed) AS xnpv FROM halved WHERE n = 60""")
def _irr(spark: SparkSession, d: str) -> DataFrame:
    """All orders as monthly totals, after an outlay of four fifths of their sum a month before the first. The SQL halves an interval."""
    wb = Workbook()
    months = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.trunc("o_orderdate", "month").alias("d")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    outlay = months.agg(F.add_months(F.min("d"), -1).alias("d"), (F.sum("v") * F.lit(-0.8).cast("decimal(3,1)")).alias("v"))
    place = F.expr("CAST(months_between(d, DATE'1900-01-01') AS BIGINT)").alias("_row")
    df = outlay.unionByName(months).select(place, F.col("v").cast("double").alias("v"), "d")
    wb.add(Sheet("flows", df, ["v", "d"], "_row"))
    return rounded(wb.eval("=IRR(A:A)").select(F.col("value").alias("irr")).crossJoin(wb.eval("=XIRR(A:A,B:B)").select(F.col("value").alias("xirr"))).crossJoin(wb.eval("=XNPV(0.1,A:A,B:B)").select(F.col("value").alias("xnpv"))))


@query("volatile_rand", "SELECT count(*) AS n, TRUE AS inside FROM customer")
def _rand(spark: SparkSession, d: str) -> DataFrame:
    out = book(spark, d, "customer").fill_all("customer", {"r": "=RAND()", "k": "=RANDBETWEEN(1.5,6)"})
    return out.df.agg(F.count(F.lit(1)).alias("n"), F.bool_and((F.col("r") >= 0) & (F.col("r") < 1) & F.col("k").isin(2, 3, 4, 5, 6)).alias("inside"))


# --- row sets ----------------------------------------------------------------------

def rows_of(name: str, sheets: list[str], formula: str, sql: str, rename: dict[str, str] | None = None) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        out = book(spark, d, *sheets).eval(formula)
        for a, b in (rename or {}).items():
            out = out.withColumnRenamed(a, b)
        return rounded(out.withColumnRenamed("_row", "place"))

    query(name, sql)(run)


rows_of("sort_function", ["part"], "=SORT(A:F,5,-1)", "SELECT *, row_number() OVER (ORDER BY p_size DESC, p_partkey DESC) AS place FROM part")
rows_of("sort_text", ["part"], "=SORT(A:C,2)", "SELECT p_partkey, p_name, p_brand, row_number() OVER (ORDER BY lower(p_name), p_partkey) AS place FROM part")
rows_of("unique_rows", ["part"], "=UNIQUE(C:D)", "SELECT p_brand, p_type, min(p_partkey) + 1 AS place FROM part GROUP BY 1, 2")
rows_of("unique_once", ["part"], "=UNIQUE(B:C,FALSE,TRUE)", "SELECT p_name, p_brand, min(p_partkey) + 1 AS place FROM part GROUP BY 1, 2 HAVING count(*) = 1")
rows_of("filter_function", ["customer"], '=FILTER(A:E,(D:D>5000)*(E:E="building"))', "SELECT *, c_custkey + 1 AS place FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
rows_of("filter_empty", ["customer"], "=FILTER(A:B,D:D>1000000,-1)", "SELECT CAST(-1 AS BIGINT) AS c_custkey, CAST(NULL AS VARCHAR) AS c_name, CAST(0 AS BIGINT) AS place")
rows_of("nested_arrays", ["part"], "=SORT(UNIQUE(D:D),1)", "SELECT p_type, row_number() OVER (ORDER BY lower(p_type)) AS place FROM (SELECT DISTINCT p_type FROM part)")
rows_of("sequence_function", ["region"], "=SEQUENCE(1000,3,10,5)", "SELECT CAST(10 + r * 15 AS DOUBLE) AS c1, CAST(15 + r * 15 AS DOUBLE) AS c2, CAST(20 + r * 15 AS DOUBLE) AS c3, r + 1 AS place FROM range(1000) t(r)")
rows_of("transpose_function", ["nation"], "=TRANSPOSE(A1:C4)", "SELECT * FROM (VALUES ('0', '1', '2', '3', 1), ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3', 2), ('0', '1', '2', '3', 3)) t(c1, c2, c3, c4, place)")

# --- ranges that a fill moves ------------------------------------------------------

AHEAD = "OVER (ORDER BY c_custkey ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)"
SIX = f"list_sort(list(c_acctbal) {AHEAD})"

fills("countif_running", "orders", {"n": "=COUNTIF($C$1:C1,C1)", "spent": "=SUMIF($B$1:B1,B1,$D$1:D1)", "big": '=COUNTIF($D$1:D1,">100000")', "most": '=MAXIFS($D$1:D1,$C$1:C1,"F")', "mean": "=AVERAGEIFS($D$1:D1,$B$1:B1,B1,$C$1:C1,C1)", "left": "=COUNTIF(C1:C$15000,C1)"}, ["o_orderkey"], f"""
SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n, {R('sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)', 6)} AS spent,
  count(*) FILTER (WHERE o_totalprice > 100000) OVER (ORDER BY o_orderkey) AS big, {R("coalesce(max(o_totalprice) FILTER (WHERE o_orderstatus = 'F') OVER (ORDER BY o_orderkey), 0)", 6)} AS most,
  {R('avg(o_totalprice) OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey)', 6)} AS mean, count(*) FILTER (WHERE o_orderkey < 15000) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey DESC) AS "left" FROM orders""", (), 6)

fills("sumif_sliding", "customer", {"b": '=SUMIF(E1:E6,"building",D1:D6)', "same": "=COUNTIF(C1:C6,C1)", "more": '=COUNTIF(D1:D6,">"&D1)', "least": '=MINIFS(D1:D6,E1:E6,"<>BUILDING")', "next": '=SUMIFS(D2:D7,E1:E6,E1)'}, ["c_custkey"], f"""
SELECT c_custkey, {R(f"coalesce(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') {AHEAD}, 0)", 2)} AS b, len(list_filter(list(c_nationkey) {AHEAD}, lambda x: x = c_nationkey)) AS same, len(list_filter(list(c_acctbal) {AHEAD}, lambda x: x > c_acctbal)) AS more,
  {R(f"coalesce(min(c_acctbal) FILTER (WHERE c_mktsegment <> 'BUILDING') {AHEAD}, 0)", 2)} AS least,
  {R(f"list_sum(list_transform(list_filter(list({{'s': c_mktsegment, 'v': after}}) {AHEAD}, lambda x: x.s = c_mktsegment), lambda x: x.v))", 2)} AS "next" FROM (SELECT *, coalesce(lead(c_acctbal) OVER (ORDER BY c_custkey), 0) AS after FROM customer)""", (), 2)

fills("large_sliding", "customer", {"second": "=LARGE(D1:D6,2)", "low": "=SMALL(D1:D6,1)", "kth": "=LARGE(D1:D6,MOD(A1,3)+1)", "quarter": "=PERCENTILE(D1:D6,0.25)", "q3": "=QUARTILE(D1:D6,3)", "mid": "=MEDIAN(D1:D6)", "place": "=RANK(D1,D1:D6)", "up": "=RANK(D1,D1:D6,1)"}, ["c_custkey"], f"""
SELECT c_custkey, {R('s[len(s) - 1]', 4)} AS second, {R('s[1]', 4)} AS low, CASE WHEN c_custkey % 3 + 1 <= len(s) THEN {R('s[len(s) - c_custkey % 3]', 4)} END AS kth, {R('list_aggregate(s, $$quantile_cont$$, 0.25)', 4)} AS quarter, {R('list_aggregate(s, $$quantile_cont$$, 0.75)', 4)} AS q3, {R('list_aggregate(s, $$median$$)', 4)} AS mid,
  {R('1 + len(list_filter(s, lambda x: x > c_acctbal))', 4)} AS place, {R('1 + len(list_filter(s, lambda x: x < c_acctbal))', 4)} AS up FROM (SELECT *, {SIX} AS s FROM customer)""".replace("s[len(s) - 1]", "CASE WHEN len(s) > 1 THEN s[len(s) - 1] END"), (), 4)

fills("stdev_sliding_columns", "part", {"sd": "=STDEV(E1:F3)", "va": "=VARP(E1:F3)", "md": "=MEDIAN(E1:F3)", "one": "=STDEVP(F1:F3)"}, ["p_partkey"], f"""
SELECT p_partkey, {R('list_aggregate(v, $$stddev_samp$$)', 3)} AS sd, {R('list_aggregate(v, $$var_pop$$)', 3)} AS va, {R('list_aggregate(v, $$median$$)', 3)} AS md, {R('list_aggregate(w, $$stddev_pop$$)', 3)} AS one
FROM (SELECT p_partkey, flatten(list([CAST(p_size AS DOUBLE), p_retailprice]) OVER r) AS v, list(p_retailprice) OVER r AS w FROM part WINDOW r AS (ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING))""", (), 3)

fills("match_moving", "customer", {"at": '=IFERROR(MATCH("BUILDING",E1:E6,0),0)', "got": '=XLOOKUP("BUILDING",E1:E6,D1:D6,0)', "v": '=IFERROR(VLOOKUP("building",E1:E6,1,FALSE),"none")', "first": "=MATCH(C1,$C$1:C1,0)", "below": "=IFERROR(MATCH(5000,D1:D6,1),0)"}, ["c_custkey"], f"""
SELECT c_custkey, CAST(coalesce(nullif(list_position(s, 'BUILDING'), 0), 0) AS DOUBLE) AS "at", {R("CASE WHEN list_position(s, 'BUILDING') > 0 THEN d[list_position(s, 'BUILDING')] ELSE 0 END", 2)} AS got, CASE WHEN list_position(s, 'BUILDING') > 0 THEN 'BUILDING' ELSE 'none' END AS v,
  CAST(min(c_custkey) OVER (PARTITION BY c_nationkey) + 1 AS DOUBLE) AS first, CAST(coalesce(list_position(d, list_max(list_filter(d, lambda x: x <= 5000))), 0) AS DOUBLE) AS below
FROM (SELECT *, list(c_mktsegment) {AHEAD} AS s, list(c_acctbal) {AHEAD} AS d FROM customer)""", (), 2)

fills("index_moving", "customer", {"third": "=INDEX(D1:D6,3)", "some": "=INDEX(D1:D6,MOD(A1,4)+1)", "up": "=IFERROR(INDEX($D$1:D1,MOD(A1,7)+1),-1)"}, ["c_custkey"], f"""
SELECT c_custkey, {R('d[3]', 2)} AS third, {R('d[c_custkey % 4 + 1]', 2)} AS some, {R('(SELECT y.c_acctbal FROM customer y WHERE y.c_custkey = x.c_custkey % 7)', 2)} AS up FROM (SELECT *, list(c_acctbal) {AHEAD} AS d FROM customer) x""", (), 2)

fills("sumproduct_sliding", "part", {"s": "=SUMPRODUCT(E1:E4,F1:F4)", "c": "=SUMPRODUCT((E1:E4>20)*F1:F4)", "r": "=SUMPRODUCT($E$1:E1,$F$1:F1)", "m": "=SUM(IF(E1:E4>20,F1:F4,0))"}, ["p_partkey"], f"""
SELECT p_partkey, {R('sum(p_size * p_retailprice) OVER w', 2)} AS s, {R('coalesce(sum(p_retailprice) FILTER (WHERE p_size > 20) OVER w, 0)', 2)} AS c, {R('sum(p_size * p_retailprice) OVER (ORDER BY p_partkey)', 2)} AS r, {R('coalesce(sum(p_retailprice) FILTER (WHERE p_size > 20) OVER w, 0)', 2)} AS m
FROM part WINDOW w AS (ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)""", (), 2)

fills("countif_compared", "customer", {"richer": '=COUNTIF($D:$D,">"&D1)', "upto": '=SUMIF($D:$D,"<="&D1,$D:$D)', "top": '=MAXIFS($D:$D,$D:$D,"<"&D1,$E:$E,"BUILDING")'}, ["c_custkey"], f"""
SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) - 1 AS richer, {R('sum(c_acctbal) OVER (ORDER BY c_acctbal)', 2)} AS upto, {R("coalesce(max(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING') OVER (ORDER BY c_acctbal RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0)", 2)} AS top FROM customer""", (), 2)

fills("percentile_by_row", "customer", {"p": "=PERCENTILE($D:$D,C1/25)", "k": "=LARGE($D:$D,C1+1)"}, ["c_custkey"], f"""
WITH s AS (SELECT list_sort(list(c_acctbal)) AS s FROM customer), q AS (SELECT s, len(s) AS n FROM s), p AS (SELECT range AS k, range / 25 * (n - 1) AS pos, s, n FROM range(0, 25), q)
SELECT c_custkey, {R('s[CAST(floor(pos) AS BIGINT) + 1] + (s[CAST(ceil(pos) AS BIGINT) + 1] - s[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos))', 2)} AS p, {R('s[n - k]', 2)} AS k FROM customer JOIN p ON c_nationkey = p.k""", (), 2)

fills("sliding_other_sheet", "nation", {"near": "=SUM(supplier!D1:D3)", "poor": '=COUNTIF(supplier!D1:D3,"<0")', "most": "=MAX(supplier!D1:D3)"}, ["n_nationkey"], f"""
SELECT n_nationkey, {R('coalesce(sum(s_acctbal), 0)', 2)} AS near, count(*) FILTER (WHERE s_acctbal < 0) AS poor, {R('coalesce(max(s_acctbal), 0)', 2)} AS most FROM nation LEFT JOIN supplier ON s_suppkey BETWEEN n_nationkey AND n_nationkey + 2 GROUP BY 1""", ("supplier",), 2)

fills("xlookup_across", "supplier", {"owner": "=XLOOKUP(A1,customer!A:A,customer!B:B)", "shifted": "=XLOOKUP(A1,customer!$A$1:$A$100,customer!$D$2:$D$101)", "wide": "=XLOOKUP(C1,A1:D1,A1:D1,-1)", "at": "=MATCH(D1,A1:D1,0)"}, ["s_suppkey"], f"""
SELECT s_suppkey, c_name AS owner, {R('(SELECT y.c_acctbal FROM customer y WHERE y.c_custkey = s_suppkey + 1 AND s_suppkey < 100)', 2)} AS shifted, CAST(s_nationkey AS VARCHAR) AS wide, CASE WHEN s_acctbal = s_suppkey THEN 1.0 WHEN s_acctbal = s_nationkey THEN 3.0 ELSE 4.0 END AS "at" FROM supplier JOIN customer ON c_custkey = s_suppkey""", ("customer",), 2)


@query("payments_in_rows", f"""SELECT c_custkey, {R('-1000 / 1.1 + (1500 + a) / 1.21 + (200 + b) / 1.331', 3)} AS npv, round(((1500 + a) + sqrt(pow(1500 + a, 2) + 4000 * (200 + b))) / 2000 - 1, 6) AS irr, round((1500 + a) / 1000 - 1, 6) AS year
FROM (SELECT c_custkey, abs(c_acctbal) / 10 AS a, c_nationkey AS b FROM customer)""")
def _payments(spark: SparkSession, d: str) -> DataFrame:
    """A series of payments in every row: NPV, IRR and, over a year, XIRR. The SQL solves the quadratic equation."""
    df = spark.read.parquet(f"{d}/customer.parquet")
    df = df.select("c_custkey", F.lit(-1000.0).alias("a"), (F.abs("c_acctbal") / 10 + 1500).alias("b"), (F.col("c_nationkey") + 200.0).alias("c"), F.lit("2023-01-01").cast("date").alias("d1"), F.lit("2024-01-01").cast("date").alias("d2"), (F.col("c_custkey") + 1).alias("_row"))
    wb = Workbook()
    wb.add(Sheet("flows", df, row="_row"))
    out = wb.fill_all("flows", {"npv": "=NPV(0.1,B1:D1)", "irr": "=IRR(B1:D1)", "year": "=XIRR(B1:C1,E1:F1)"})
    return out.df.select("c_custkey", F.round("npv", 3).alias("npv"), F.round("irr", 6).alias("irr"), F.round("year", 6).alias("year"))


# --- array formulas ----------------------------------------------------------------

scalars("sum_if_array", ["part"], {"a": "=SUM(IF(E1:E2000>20,F1:F2000,0))", "b": "=SUM(E1:E2000*F1:F2000)", "c": '=COUNT(IF(D1:D2000="PROMO",1,"no"))', "d": "=MAX(IF(E1:E2000<10,F1:F2000,0))", "e": "=SUM((E1:E2000>AVERAGE(E1:E2000))*1)", "f": "=MEDIAN(IF(E1:E2000>20,F1:F2000,\"\"))", "g": "=SUM(IFERROR(100/(E1:E2000-10),0)*(F1:F2000>0))"}, f"""
SELECT {R('coalesce(sum(p_retailprice) FILTER (WHERE p_size > 20), 0)', 2)} AS a, {R('sum(p_size * p_retailprice)', 2)} AS b, count(*) FILTER (WHERE upper(p_type) = 'PROMO') AS c, {R('coalesce(max(p_retailprice) FILTER (WHERE p_size < 10), 0)', 2)} AS d,
  CAST(count(*) FILTER (WHERE p_size > (SELECT avg(p_size) FROM part WHERE p_partkey < 2000)) AS DOUBLE) AS e, {R('median(p_retailprice) FILTER (WHERE p_size > 20)', 2)} AS f, {R('coalesce(sum(100.0 / (p_size - 10)) FILTER (WHERE p_size <> 10), 0)', 2)} AS g FROM part WHERE p_partkey < 2000""", 2)
rows_of("array_add", ["part"], "=E:E+F:F*2", f"SELECT {R('p_size + p_retailprice * 2')} AS c1, p_partkey + 1 AS place FROM part")
rows_of("array_padding", ["customer"], "=A1:A8+D1:D5", f"SELECT {R('CASE WHEN c_custkey < 5 THEN c_custkey + c_acctbal END')} AS c1, CASE WHEN c_custkey >= 5 THEN '#N/A' END AS e1, c_custkey + 1 AS place FROM customer WHERE c_custkey < 8")
rows_of("array_broadcast", ["supplier"], "=D1:D9*A2:C2", f"SELECT {R('s_acctbal * 1')} AS c1, place, CAST(NULL AS DOUBLE) AS c2, c3, e2 FROM (SELECT s_acctbal, s_suppkey + 1 AS place, {R('s_acctbal * (SELECT s_nationkey FROM supplier WHERE s_suppkey = 1)')} AS c3, '#VALUE!' AS e2, s_suppkey FROM supplier) WHERE s_suppkey < 9")
rows_of("filter_shifted", ["customer"], "=FILTER(A1:B1000,D2:D1001>5000)", "SELECT a.c_custkey, a.c_name, a.c_custkey + 1 AS place FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE b.c_acctbal > 5000 AND a.c_custkey < 1000")


@query("unique_columns", "SELECT c_custkey, c_name, c_mktsegment, c_custkey + 1 AS place FROM customer")
def _unique_columns(spark: SparkSession, d: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_name", F.lower("c_name").alias("again"), "c_mktsegment", F.col("c_custkey").alias("twice"), (F.col("c_custkey") + 1).alias("_row"))
    wb = Workbook()
    wb.add(Sheet("c", df, row="_row"))
    return rounded(wb.eval("=UNIQUE(A:E,TRUE)").withColumnRenamed("_row", "place"))

# --- table operators ---------------------------------------------------------------


def filtered(name: str, sheet: str, predicate: str, columns: str | None, sql: str) -> None:
    query(name, sql)(lambda spark, d: rounded(table.filter_sheet(book(spark, d, sheet).sheet(sheet), predicate, columns).drop("_row")))


filtered("filter_where", "orders", "o_totalprice >= 100000 AND (o_orderstatus = 'f' OR o_orderpriority LIKE '1-%')", None, "SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate) FROM orders WHERE o_totalprice >= 100000 AND (o_orderstatus = 'F' OR o_orderpriority LIKE '1-%')")
filtered("filter_in_between", "part", "E BETWEEN 10 AND 20 AND C IN ('brand#1','Brand#7') AND NOT B LIKE '%ring'", "A,C:E", "SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand IN ('Brand#1', 'Brand#7') AND p_name NOT LIKE '%ring'")
filtered("filter_two_valued", "customer", "NOT c_mktsegment = 5 AND NOT c_acctbal != 'x' AND c_name IS NOT EMPTY", "A", "SELECT c_custkey FROM customer")


@query("filter_limit", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 400000 ORDER BY o_orderkey LIMIT 50")
def _filter_limit(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the command's own."""
    return table.filter_sheet(book(spark, d, "orders").sheet("orders"), "D > 400000", "A,D", 50).drop("_row")


@query("sort_command", "SELECT c_custkey, c_mktsegment, c_acctbal, row_number() OVER (ORDER BY lower(c_mktsegment), c_acctbal DESC, c_custkey) AS place FROM customer")
def _sort_command(spark: SparkSession, d: str) -> DataFrame:
    """Each row's place in the order."""
    sheet = book(spark, d, "customer").sheet("customer")
    return table.sort_sheet(sheet, [("c_mktsegment", False), ("c_acctbal", True)], "place").select("c_custkey", "c_mktsegment", "c_acctbal", "place")


@query("stats_command", f"""SELECT * FROM (SELECT 'o_orderkey' AS "column", count(*) AS count, {R('sum(o_orderkey)', 2)} AS sum, CAST(min(o_orderkey) AS DOUBLE) AS min, CAST(max(o_orderkey) AS DOUBLE) AS max, {R('avg(o_orderkey)', 2)} AS mean FROM orders UNION ALL SELECT 'o_custkey', count(*), {R('sum(o_custkey)', 2)}, CAST(min(o_custkey) AS DOUBLE), CAST(max(o_custkey) AS DOUBLE), {R('avg(o_custkey)', 2)} FROM orders UNION ALL SELECT 'o_totalprice', count(*), {R('sum(o_totalprice)', 2)}, min(o_totalprice), max(o_totalprice), {R('avg(o_totalprice)', 2)} FROM orders)""")
def _stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table.stats(book(spark, d, "orders").sheet("orders")), 2)


@query("bounds_command", "SELECT CAST(1 AS BIGINT) AS min_row, CAST(count(*) AS BIGINT) AS max_row, CAST(1 AS BIGINT) AS min_col, CAST(6 AS BIGINT) AS max_col, CAST(6 * count(*) AS BIGINT) AS n_cells FROM part")
def _bounds(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table.bounds(book(spark, d, "part").sheet("part")))


@query("search_command", "SELECT 'part' AS sheet, p_partkey + 1 AS _row, CAST(2 AS BIGINT) AS _col, p_name AS value FROM part WHERE regexp_matches(p_name, '^re.*t$') UNION ALL SELECT 'customer', c_custkey + 1, CAST(5 AS BIGINT), c_mktsegment FROM customer WHERE regexp_matches(c_mktsegment, '^re.*t$')")
def _search(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table.search(book(spark, d, "part", "customer"), "^re.*t$"))


@query("view_range", "SELECT p_partkey + 1 AS _row, p_name, p_brand FROM part WHERE p_partkey BETWEEN 9 AND 29")
def _view(spark: SparkSession, d: str) -> DataFrame:
    return table.view(book(spark, d, "part").sheet("part"), "B10:C30")


@query("diff_command", """SELECT p_partkey + 1 AS _row, CAST(5 AS BIGINT) AS _col, 'changed' AS status, CAST(p_size AS VARCHAR) AS before, CAST(p_size + 1 AS VARCHAR) AS after FROM part WHERE p_size = 7
UNION ALL SELECT p_partkey + 1, c, 'removed', CASE c WHEN 1 THEN CAST(p_partkey AS VARCHAR) WHEN 2 THEN p_name WHEN 3 THEN p_brand WHEN 4 THEN p_type WHEN 5 THEN CAST(p_size AS VARCHAR) ELSE CASE WHEN p_retailprice = floor(p_retailprice) THEN CAST(CAST(p_retailprice AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.6f', p_retailprice), '0+$', '') END END, NULL FROM part, range(1, 7) t(c) WHERE p_partkey % 100 = 99 AND p_size <> 7""")
def _diff(spark: SparkSession, d: str) -> DataFrame:
    old = book(spark, d, "part").sheet("part")
    new = old.with_df(old.df.where("p_partkey % 100 != 99 OR p_size = 7").withColumn("p_size", F.when(F.col("p_size") == 7, 8).otherwise(F.col("p_size"))))
    return rounded(table.diff(old, new))


@query("append_rows", "SELECT row_number() OVER (ORDER BY s, k) AS _row, k AS n_nationkey, n AS n_name FROM (SELECT 1 AS s, n_nationkey AS k, n_name AS n FROM nation UNION ALL SELECT 2, r_regionkey, r_name FROM region)")
def _append(spark: SparkSession, d: str) -> DataFrame:
    wb = book(spark, d, "nation", "region")
    return rounded(table.append(wb.sheet("nation"), wb.sheet("region")).df.select("_row", "n_nationkey", "n_name"))


@query("put_cells", "SELECT c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 0 ELSE c_acctbal END AS c_acctbal FROM customer")
def _put(spark: SparkSession, d: str) -> DataFrame:
    sheet = book(spark, d, "customer").sheet("customer")
    patches = sheet.df.where("c_custkey % 10 = 3").select("_row", F.lit(0.0).alias("value"))
    return table.put(sheet, patches, "c_acctbal").df.select("c_custkey", "c_acctbal")


@query("insert_delete_rows", "SELECT CASE WHEN n_nationkey + 1 >= 5 THEN n_nationkey + 4 ELSE n_nationkey + 1 END AS _row, n_name FROM nation WHERE n_nationkey + 1 NOT BETWEEN 10 AND 11 AND n_nationkey < 9 UNION ALL SELECT n_nationkey + 2, n_name FROM nation WHERE n_nationkey >= 11")
def _structure(spark: SparkSession, d: str) -> DataFrame:
    sheet = book(spark, d, "nation").sheet("nation")
    moved = table.delete_rows(table.insert_rows(sheet, 5, 3), 13, 2)
    return rounded(moved.df.select("_row", "n_name"))


@query("validation_rule", "SELECT p_partkey, p_size BETWEEN 10 AND 40 AS ok, p_type IN ('ECONOMY', 'SMALL') AS listed FROM part")
def _validation(spark: SparkSession, d: str) -> DataFrame:
    sheet = book(spark, d, "part").sheet("part")
    return sheet.df.select("p_partkey", table.validate(sheet, "p_size", "between", 10, 40).alias("ok"), table.validate(sheet, "D", "list", "ECONOMY", "SMALL").alias("listed"))


@query("tabulate", "SELECT r AS _row, CAST(r * r AS BIGINT) AS square FROM range(1, 2001) t(r)")
def _tabulate(spark: SparkSession, d: str) -> DataFrame:
    return table.tabulate(spark, 2000, {"square": F.col("_row") * F.col("_row")}).df


# --- recalculation -----------------------------------------------------------------


@query("recalc_levels", f"SELECT o_orderkey, {R('o_totalprice * 0.1', 6)} AS tax, {R('o_totalprice * 1.1', 6)} AS gross, {R('sum(o_totalprice * 1.1) OVER (ORDER BY o_orderkey)', 4)} AS balance FROM orders")
def _recalc(spark: SparkSession, d: str) -> DataFrame:
    """Three templates in dependency order; the last is a recurrence that becomes a running window."""
    wb = book(spark, d, "orders")
    wb.define("rate", "=0.1")
    m = Model(wb, base_row=2)
    m.set("orders", "balance", "=I1+H2")
    m.set("orders", "gross", "=D2+J2")
    wb.sheet("orders").columns = [*wb.sheet("orders").columns[:6], "x", "gross", "balance"]
    wb.sheet("orders").df = wb.sheet("orders").df.withColumn("x", F.lit(None).cast("double"))
    m.set("orders", "tax", "=D2*rate")
    m.recalculate()
    return wb.sheet("orders").df.select("o_orderkey", F.round("tax", 6).alias("tax"), F.round("gross", 6).alias("gross"), F.round("balance", 4).alias("balance"))


@query("what_if_table", f"SELECT p.x AS \"B1\", q.x AS \"B2\", {R('(SELECT sum(o_totalprice) FROM orders) * p.x + q.x', 2)} AS value FROM (VALUES (0.1::DOUBLE), (0.2::DOUBLE), (0.5::DOUBLE)) p(x), (VALUES (1::DOUBLE), (1000::DOUBLE)) q(x)")
def _what_if(spark: SparkSession, d: str) -> DataFrame:
    return rounded(data_table(book(spark, d, "orders"), "orders", "=SUM(D:D)*B1+B2", {"B1": [0.1, 0.2, 0.5], "B2": [1, 1000]}), 2)


@query("recurrence_debt", """WITH RECURSIVE t(k, b, j) AS (SELECT 1, CAST(1000 AS DOUBLE), CAST(1000 - least(greatest(100 - 80, 0), 1000) AS DOUBLE) UNION ALL SELECT k + 1, j, j - least(100 * pow(1.1, k) - j * 0.08, j) FROM t WHERE k < 24) SELECT CAST(k AS BIGINT) AS _row, round(b, 4) AS opening, round(j, 4) AS closing FROM t""")
def _debt(spark: SparkSession, d: str) -> DataFrame:
    """A debt schedule whose payment is the lesser of cash and balance: no window states it, so rows run in order."""
    df = spark.range(1, 25).select(F.col("id").alias("_row"), (100 * F.pow(F.lit(1.1), F.col("id") - 1)).alias("cash"))
    wb = Workbook()
    wb.add(Sheet("debt", df, ["cash"], "_row"))
    m = Model(wb, base_row=2)
    m.set("debt", "opening", "=IF(A1=0,1000,C1)")
    m.set("debt", "closing", "=B2-MIN(A2-B2*0.08,B2)")
    m.recalculate()
    return rounded(wb.sheet("debt").df.select("_row", "opening", "closing"))


@query("iterative_cycle", "SELECT CAST(1 + n_nationkey AS BIGINT) AS _row, round((10 + n_nationkey) * 2, 1) AS price, round((10 + n_nationkey) * 2 * 0.5, 1) AS fee FROM nation")
def _cycle(spark: SparkSession, d: str) -> DataFrame:
    """price = cost + fee and fee = price / 2 settle by iteration."""
    wb = book(spark, d, "nation")
    s = wb.sheet("nation")
    s.df, s.columns = s.df.select("_row", (F.col("n_nationkey") + 10.0).alias("cost")), ["cost"]
    m = Model(wb)
    m.set("nation", "price", "=A1+C1")
    m.set("nation", "fee", "=B1*50%")
    m.recalculate(iterate=True)
    return rounded(wb.sheet("nation").df.select("_row", "price", "fee"), 1)


@query("targeted_recalc", f"SELECT o_orderkey, {R('o_totalprice * 2', 2)} AS twice, {R('o_totalprice * 2 + 1', 2)} AS more FROM orders")
def _targeted(spark: SparkSession, d: str) -> DataFrame:
    wb = book(spark, d, "orders")
    m = Model(wb)
    m.set("orders", "twice", "=D1*2")
    m.set("orders", "more", "=G1+1")
    m.recalculate(changed=[("orders", "o_totalprice")])
    return rounded(wb.sheet("orders").df.select("o_orderkey", "twice", "more"), 2)


# --- sources and streams -----------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("xlsx_round_trip", "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, n_name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation")
def _xlsx(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "book") + ".xlsx"
    xlsx.write_xlsx({"nation": book(spark, d, "nation").sheet("nation").df}, path)
    return xlsx.read_sheet(spark, path, "nation").df.select("n_nationkey", "n_name", "n_regionkey")


@query("xlsx_cells_in_range", "SELECT n_nationkey + 2 AS _row, CAST(2 AS BIGINT) AS _col, 'text' AS kind, n_name AS txt FROM nation WHERE n_nationkey + 2 BETWEEN 5 AND 9")
def _xlsx_range(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "book") + ".xlsx"
    xlsx.write_xlsx({"nation": book(spark, d, "nation").sheet("nation").df}, path)
    return rounded(xlsx.read_cells(spark, path, 0, rows=(5, 9), cols=(2, 2)).select("_row", "_col", "kind", "txt"))


@query("csv_round_trip", "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, p_name, p_brand, CAST(p_size AS DOUBLE) AS p_size FROM part")
def _csv(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "part")
    text.write_csv(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name", "p_brand", "p_size"), path)
    return text.read_csv(spark, path).df


@query("csv_misfits", "SELECT CAST(p_partkey AS DOUBLE) AS p_partkey, CASE WHEN p_partkey % 50 <> 33 THEN CAST(p_size AS DOUBLE) END AS p_size, CASE WHEN p_partkey % 50 = 33 THEN p_size || ' kg' END AS p_size__text FROM part")
def _csv_misfits(spark: SparkSession, d: str) -> DataFrame:
    """Cells that do not fit a column's type, none of them among its first."""
    path = scratch(spark, "part")
    size = F.when(F.col("p_partkey") % 50 == 33, F.concat(F.col("p_size").cast("string"), F.lit(" kg"))).otherwise(F.col("p_size").cast("string"))
    text.write_csv(spark.read.parquet(f"{d}/part.parquet").select("p_partkey", size.alias("p_size")).orderBy("p_partkey"), path)
    return text.read_csv(spark, path).df


@query("markdown_table", "SELECT * FROM (VALUES (1, 'North', '12'), (2, 'South', '7')) t(_row, Region, Units)")
def _markdown(spark: SparkSession, d: str) -> DataFrame:
    return text.read_markdown(spark, "| Region | Units |\n|---|--:|\n| North | 12 |\n| South | 7 |").df


@query("json_rows", "SELECT '{\"row\":' || (r_regionkey + 1) || ',\"cells\":{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}}' AS value FROM region")
def _json(spark: SparkSession, d: str) -> DataFrame:
    return text.json_rows(book(spark, d, "region").sheet("region").df)


def streamed(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = f"{d}/{name}.parquet"
    return stream.source(spark, path + "*", spark.read.parquet(path).schema)  # a pattern, since a stream's own path must be a folder


@query("stream_stats", f"SELECT 'event_id' AS \"column\", count(*) AS count, {R('sum(event_id)', 2)} AS sum, CAST(min(event_id) AS DOUBLE) AS min, CAST(max(event_id) AS DOUBLE) AS max, {R('avg(event_id)', 2)} AS mean FROM events UNION ALL SELECT 'value', count(value), {R('sum(value)', 2)}, min(value), max(value), {R('avg(value)', 2)} FROM events")
def _stream_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stream.drain(stream.stats(streamed(spark, d, "events"), "A,E"), f"s{uuid.uuid4().hex}", "complete"), 2)


@query("stream_filter", "SELECT event_id, event_type, value FROM events WHERE value > 50 AND event_type = 'click'")
def _stream_filter(spark: SparkSession, d: str) -> DataFrame:
    out = stream.filtered(streamed(spark, d, "events"), "value > 50 AND event_type = 'CLICK'", "event_id,event_type,value")
    return stream.to_files(out, scratch(spark, "clicks"), scratch(spark, "clicks-state"))


@query("stream_windows", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows: an extension."""
    out = stream.drain(stream.counts(streamed(spark, d, "events"), "event_type", "ts"), f"w{uuid.uuid4().hex}", "complete")
    return out.select(F.col("window.start").cast("string").alias("start"), "event_type", "n")


# --- addresses, rules and formats ------------------------------------------------------

fills("computed_addresses", "customer", {"there": "=VALUE(OFFSET($D$1,C1,0))", "back": "=IFERROR(VALUE(OFFSET(D1,-1,0)),0)", "named": '=VALUE(INDIRECT("D"&(C1+1)))'}, ["c_custkey"], f"""
SELECT x.c_custkey, {R('y.c_acctbal', 2)} AS there, {R('coalesce(lag(x.c_acctbal) OVER (ORDER BY x.c_custkey), 0)', 2)} AS back, {R('y.c_acctbal', 2)} AS named FROM customer x JOIN customer y ON y.c_custkey = x.c_nationkey""", (), 2)
scalars("computed_ranges", ["customer"], {"s": '=SUM(OFFSET(D1,0,0,COUNTIF(E:E,"BUILDING"),1))', "n": '=COUNT(INDIRECT("D1:D"&COUNTIF(D:D,">0")))'}, f"""
SELECT {R("sum(c_acctbal) FILTER (WHERE c_custkey < (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING'))", 2)} AS s, count(*) FILTER (WHERE c_custkey < (SELECT count(*) FROM customer WHERE c_acctbal > 0)) AS n FROM customer""", 2)
fills("text_fractions", "part", {"eighths": '=TEXT(E1/8,"# ?/8")', "either": '=TEXT(F1,"[>900]0.0;[<=500]""low"";0")'}, ["p_partkey"], """
SELECT p_partkey, CASE WHEN p_size % 8 = 0 THEN (p_size // 8) || '    ' ELSE CASE WHEN p_size < 8 THEN '' ELSE CAST(p_size // 8 AS VARCHAR) END || ' ' || (p_size % 8) || '/8' END AS eighths,
  CASE WHEN p_retailprice > 900 THEN format('{:.1f}', round(p_retailprice, 1)) WHEN p_retailprice <= 500 THEN 'low' ELSE format('{:.0f}', round(p_retailprice, 0)) END AS either FROM part""")


@query("validation_kinds", "SELECT p_partkey, p_size BETWEEN 5 AND 20 AS size, length(p_name) <= 16 AS name, p_retailprice > 10 * p_size AS custom FROM part")
def _validation_kinds(spark: SparkSession, d: str) -> DataFrame:
    wb = book(spark, d, "part")
    s = table.validate_custom(wb, "part", "F1>10*E1", "custom")
    return s.df.select("p_partkey", table.validate(s, "p_size", "between", 5, 20, kind="whole").alias("size"), table.validate(s, "p_name", "lessThanOrEqual", 16, kind="textLength").alias("name"), "custom")


@query("conditional_formats", f"SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC) <= 10 AS top, {R('(c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ())')} AS scale, c_mktsegment LIKE 'BU%' AS starts FROM customer")
def _formats(spark: SparkSession, d: str) -> DataFrame:
    wb = book(spark, d, "customer")
    for column, rule, given, out in (("c_acctbal", "top", 10, "top"), ("c_acctbal", "colorScale", None, "scale"), ("c_mktsegment", "beginsWith", "bu", "starts")):
        wb.add(wb.sheet("customer").with_df(table.conditional_format(wb, "customer", column, rule, given, out=out)))
    return rounded(wb.sheet("customer").df.select("c_custkey", "top", "scale", "starts"))


@query("cells_sorted", "SELECT n_nationkey + 1 AS _row, c AS _col, CASE c WHEN 1 THEN CAST(n_nationkey AS VARCHAR) WHEN 2 THEN n_name ELSE CAST(n_regionkey AS VARCHAR) END AS shown FROM nation, range(1, 4) t(c)")
def _cells_sorted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(table.cells_sorted(book(spark, d, "nation").sheet("nation")).select("_row", "_col", "shown"))


@query("put_ranges", "SELECT r_regionkey, CASE r_regionkey WHEN 1 THEN 'here' WHEN 2 THEN 'there' ELSE r_name END AS r_name FROM region")
def _put_ranges(spark: SparkSession, d: str) -> DataFrame:
    s = book(spark, d, "region").sheet("region")
    return rounded(table.put_range(s, "B2:B3", ["here", "there"]).df.select("r_regionkey", "r_name"))


@query("external_reference", "SELECT n_nationkey, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey")
def _external(spark: SparkSession, d: str) -> DataFrame:
    wb = book(spark, d, "nation")
    wb.link("world.xlsx", book(spark, d, "region").sheet("region"))
    return rounded(wb.fill("nation", "region", "=XLOOKUP(C1,[world.xlsx]region!A:A,[world.xlsx]region!B:B)").df.select("n_nationkey", "region"))


@query("recurrence_errors", "SELECT CAST(k AS BIGINT) AS _row, CASE WHEN k < 4 THEN round(1.0 / (4 - k), 4) END AS share, CASE WHEN k >= 4 THEN '#DIV/0!' END AS share__err, CASE WHEN k = 4 THEN 0.0 ELSE round(1.0 / (4 - k), 4) END AS kept FROM range(1, 9) t(k)")
def _recurrence_errors(spark: SparkSession, d: str) -> DataFrame:
    """A quotient that fails in one row: the error stays in all rows that build on it, and IFERROR ends it."""
    wb = Workbook()
    wb.add(Sheet("t", spark.range(1, 9).select(F.col("id").alias("_row"), (4 - F.col("id")).cast("double").alias("x")), ["x"], "_row"))
    m = Model(wb, base_row=2)
    m.set("t", "share", "=MIN(1/A2,9)+B1*0")
    m.set("t", "kept", "=IFERROR(1/A2,0)+C1*0")
    m.recalculate()
    return wb.sheet("t").df.select("_row", F.round("share", 4).alias("share"), "share__err", F.round("kept", 4).alias("kept"))


@query("xlsx_formulas", "SELECT CAST(n_nationkey AS DOUBLE) AS n_nationkey, CAST(n_nationkey * 2 + 1 AS DOUBLE) AS odd, '(A' || (n_nationkey + 2) || '*2)+1' AS f FROM nation")
def _xlsx_formulas(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "book") + ".xlsx"
    df = spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", (F.col("n_nationkey") * 2 + 1).alias("odd"), (F.col("n_nationkey") + 1).alias("_row"))
    xlsx.write_xlsx({"nation": df}, path, formulas={"nation": {"odd": "=A2*2+1"}}, dimension=True)
    long = xlsx.read_cells(spark, path).where("_row > 1")
    return long.groupBy("_row").agg(F.max(F.when(F.col("_col") == 1, F.col("num"))).alias("n_nationkey"), F.max(F.when(F.col("_col") == 2, F.col("num"))).alias("odd"), F.regexp_replace(F.max("formula"), r"^=|^\((.*)\)$", "$1").alias("f")).drop("_row")


@query("xlsx_transform", "SELECT CAST(r_regionkey AS DOUBLE) AS r_regionkey, CASE WHEN r_regionkey = 1 THEN 'changed' ELSE r_name END AS r_name FROM region")
def _xlsx_transform(spark: SparkSession, d: str) -> DataFrame:
    source, target = (scratch(spark, n) + ".xlsx" for n in ("before", "after"))
    xlsx.write_xlsx({"region": book(spark, d, "region").sheet("region").df}, source)
    xlsx.transform_xlsx(spark, source, target, "region", {"B3": "changed"})
    return xlsx.read_sheet(spark, target, "region").df.select("r_regionkey", "r_name")


@query("stream_limit", "SELECT 1000 AS n, 1000 AS ids")
def _stream_limit(spark: SparkSession, d: str) -> DataFrame:
    out = stream.first_rows(streamed(spark, d, "events"), 1000, scratch(spark, "first"), scratch(spark, "first-state"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


# --- extensions: what the sheet language has no form for, by Spark itself ----------------


@query("group_pivot", "SELECT l_returnflag, sum(CASE WHEN l_linestatus = 'F' THEN l_quantity END) AS \"F\", sum(CASE WHEN l_linestatus = 'O' THEN l_quantity END) AS \"O\" FROM lineitem GROUP BY 1")
def _pivot(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).sum("l_quantity")
