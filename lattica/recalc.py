"""Recalculation: formulas filled down whole columns are templates, and the dependency graph is over templates, not cells.

Levels of the graph become chained projections. A template that reads its own column in rows above is a recurrence: sums become running windows, others run in row order (in one task for each group, being sequential by nature). Templates that read each other in the same row are a cycle, isolated unless iteration is asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.binder import fill_down
from lattica.parser import Binary, FormulaError, Name, Node, Num, parse, references, rewrite, show
from lattica.plans import interpret, ordered
from lattica.refs import Range, Ref
from lattica.shared import shared_folder
from lattica.sheet import Sheet, Workbook
from lattica.values import serial

Key = tuple[str, str]
ROW_EPSILON, MAX_ITERATIONS = 0.001, 100


@dataclass
class Result:
    workbook: Workbook
    evaluated: list[Key] = field(default_factory=list)
    errors: dict[Key, str] = field(default_factory=dict)
    cycles: list[list[Key]] = field(default_factory=list)
    converged: bool = True


@dataclass
class Model:
    """A workbook and its formula columns: (sheet, column) -> formula as for base_row."""

    wb: Workbook
    formulas: dict[Key, str] = field(default_factory=dict)
    base_row: int = 1

    def set(self, sheet: str, column: str, formula: str) -> None:
        s = self.wb.sheet(sheet)
        if column not in s.columns:
            s.columns.append(column)
            if column not in s.df.columns:
                s.df = s.df.withColumn(column, F.lit(None).cast("double"))
        self.formulas[s.name.lower(), column] = formula

    # --- graph ------------------------------------------------------------

    def reads(self, key: Key) -> set[Key]:
        """Formula columns that a template reads."""
        sheet = self.wb.sheet(key[0])
        out: set[Key] = set()
        node = self.expanded(parse(self.formulas[key]), sheet.name)
        for r in references(node):
            other = self.wb.sheet(r.sheet) if r.sheet else sheet
            a, b = (r.start.col, r.end.col) if isinstance(r, Range) else (r.col, r.col)
            for c in range(a or 1, (b or len(other.columns)) + 1):
                if other.has(c) and (k := (other.name.lower(), other.columns[c - 1])) in self.formulas:
                    out.add(k)
        return out

    def expanded(self, node: Node, sheet: str) -> Node:
        """Names replaced by what they stand for."""

        def one(x: Node) -> Node:
            text = self.wb.name_text(x.name, sheet) if isinstance(x, Name) else None
            return x if text is None else self.expanded(parse(text), sheet)

        return rewrite(node, one)

    def graph(self) -> dict[Key, set[Key]]:
        return {k: self.reads(k) for k in self.formulas}

    def precedents(self, key: Key, transitive: bool = False) -> set[Key]:
        return reach(self.graph(), key) if transitive else self.graph()[key]

    def dependents(self, key: Key, transitive: bool = False) -> set[Key]:
        back: dict[Key, set[Key]] = {k: set() for k in self.formulas}
        for k, vs in self.graph().items():
            for v in vs:
                back[v].add(k)
        return reach(back, key) if transitive else back.get(key, set())

    # --- evaluation -------------------------------------------------------

    def recalculate(self, changed: list[Key] | None = None, iterate: bool = False, max_change: float = ROW_EPSILON, max_iterations: int = MAX_ITERATIONS) -> Result:
        """All templates, or those that depend on changed columns (formula or input), in dependency order. A template that fails to bind is reported and blocks its dependents."""
        out = Result(self.wb)
        graph = self.graph()
        todo = set(self.formulas)
        if changed is not None:
            todo = {k for k in self.formulas if k in changed or self.touches(k, changed, graph)}
        dead: set[Key] = set()
        for group in components(graph):
            group = [k for k in group if k in todo]
            if not group:
                continue
            if any(v in dead for k in group for v in graph[k] if v not in group):
                dead.update(group)
                out.errors.update(dict.fromkeys(group, "blocked"))
                continue
            cyclic = len(group) > 1 or group[0] in graph[group[0]]
            try:
                if not cyclic:
                    self.fill(group)
                elif self.backward(group):
                    self.recur(group)
                elif iterate:
                    out.converged &= self.settle(group, max_change, max_iterations)
                else:
                    out.cycles.append(group)
                    dead.update(group)
                    continue
                out.evaluated += group
            except FormulaError as e:
                out.errors.update(dict.fromkeys(group, str(e)))
                dead.update(group)
        return out

    def touches(self, key: Key, changed: list[Key], graph: dict[Key, set[Key]]) -> bool:
        return any(self.reads_input(k, changed) for k in {key, *reach(graph, key)})

    def reads_input(self, key: Key, changed: list[Key]) -> bool:
        sheet = self.wb.sheet(key[0])
        for r in references(self.expanded(parse(self.formulas[key]), sheet.name)):
            other = self.wb.sheet(r.sheet) if r.sheet else sheet
            a, b = (r.start.col, r.end.col) if isinstance(r, Range) else (r.col, r.col)
            if any(other.has(c) and (other.name.lower(), other.columns[c - 1]) in changed for c in range(a or 1, (b or len(other.columns)) + 1)):
                return True
        return False

    def fill(self, keys: list[Key]) -> None:
        by_sheet: dict[str, dict[str, str]] = {}
        for s, c in keys:
            by_sheet.setdefault(s, {})[c] = self.formulas[s, c]
        for s, formulas in by_sheet.items():
            sheet = self.wb.sheet(s)
            self.wb.add(fill_down(self.wb, sheet, formulas, self.base_row, True))
            self.wb.sheet(s).columns = list(sheet.columns)

    def own_refs(self, group: list[Key], key: Key) -> list[Ref]:
        """References of a template to columns of its group, cell by cell; a range among them has no row order."""
        sheet = self.wb.sheet(key[0])
        out = []
        for r in references(self.expanded(parse(self.formulas[key]), sheet.name)):
            other = self.wb.sheet(r.sheet) if r.sheet else sheet
            a, b = (r.start.col, r.end.col) if isinstance(r, Range) else (r.col, r.col)
            if any(other.has(c) and (other.name.lower(), other.columns[c - 1]) in group for c in range(a or 1, (b or len(other.columns)) + 1)):
                out.append(r)
        return out

    def backward(self, group: list[Key]) -> bool:
        """Every circle of the group goes through an earlier row: same-row edges alone have none."""
        same: dict[Key, set[Key]] = {k: set() for k in group}
        for k in group:
            for r in self.own_refs(group, k):
                if isinstance(r, Range) or r.abs_row or r.row > self.base_row:
                    return False
                if r.row == self.base_row:
                    other = self.wb.sheet(r.sheet) if r.sheet else self.wb.sheet(k[0])
                    same[k].add((other.name.lower(), other.columns[r.col - 1]))
        return len({k[0] for k in group}) == 1 and all(len(g) == 1 and g[0] not in same[g[0]] for g in components(same))

    def recur(self, group: list[Key]) -> None:
        sheet = self.wb.sheet(group[0][0]).numbered()
        if len(group) == 1 and self.running_sum(sheet, group[0]):
            return
        trees = {k[1]: self.expanded(parse(self.formulas[k]), sheet.name) for k in group}
        for t in trees.values():
            interpret.check(t)
        same = {k: {(k[0], sheet.columns[r.col - 1]) for r in self.own_refs(group, k) if r.row == self.base_row} for k in group}
        order = [g[0][1] for g in components(same)]
        columns, row, base = list(sheet.columns), sheet.row, self.base_row
        reads = {columns[r.col - 1] for t in trees.values() for r in references(t) if 1 <= r.col <= len(columns)}
        inputs = [c for c in columns if c in reads and c not in order]
        kinds = {c: sheet.val(columns.index(c) + 1) for c in inputs}
        cells = [(serial(v.col) if v.kind == "date" else v.col.cast("double") if v.kind == "num" else v.col).alias(f"v{i}") for i, v in enumerate(kinds.values())]
        errs = [(F.lit(None).cast("string") if v.err is None else v.err).alias(f"e{i}") for i, v in enumerate(kinds.values())]

        def work(pdf: pd.DataFrame) -> pd.DataFrame:
            """One ordered pass: a recurrence is sequential. Only the row numbers and the columns that it reads come here."""
            pdf = pdf.sort_values("r", kind="stable").reset_index(drop=True)
            rows = pdf["r"].tolist()
            data: dict[str, list] = {c: [interpret.Error(e) if isinstance(e, str) else v for v, e in zip(pdf[f"v{i}"].tolist(), pdf[f"e{i}"].tolist(), strict=True)] for i, c in enumerate(inputs)}
            data |= {c: [None] * len(rows) for c in order}
            place = {r: i for i, r in enumerate(rows)}
            for i, r in enumerate(rows):
                def cell(ref: Ref, r: int = r) -> object:
                    at = place.get(ref.row if ref.abs_row else r + ref.row - base)
                    return None if at is None or not 1 <= ref.col <= len(columns) else data[columns[ref.col - 1]][at]

                for c in order:
                    got = interpret.run(trees[c], cell)
                    data[c][i] = 0.0 if got is None else got
            out = {"r": rows}
            for i, c in enumerate(order):
                bad = [x.code if isinstance(x, interpret.Error) else "#VALUE!" if isinstance(x, str) else None for x in data[c]]
                out |= {f"o{i}": [None if b else float(x) for x, b in zip(data[c], bad, strict=True)], f"x{i}": bad}
            return pd.DataFrame(out).astype({f"o{i}": "float64" for i in range(len(order))})

        types = "r bigint, " + ", ".join(f"o{i} double, x{i} string" for i in range(len(order)))
        light = sheet.df.select(F.col(f"`{row}`").cast("bigint").alias("r"), *cells, *errs)
        done = light.groupBy().applyInPandas(work, types)
        stale = {sheet.errors[c] for c in order if c in sheet.errors}
        keep = sheet.df.select(*[F.col(f"`{c}`") for c in sheet.df.columns if c not in order and c not in stale])
        made = [F.when(F.col(f"x{i}").isNull(), F.col(f"o{i}")).alias(c) for i, c in enumerate(order)] + [F.col(f"x{i}").alias(f"{c}__err") for i, c in enumerate(order)]
        met = keep.join(done, F.col(f"`{row}`").cast("bigint") == F.col("r"), "left").select(*[F.col(f"`{c}`") for c in keep.columns], *made)
        errors = {k: v for k, v in sheet.errors.items() if k not in order} | {c: f"{c}__err" for c in order}
        self.wb.add(sheet.with_df(met, columns, errors))

    def running_sum(self, sheet: Sheet, key: Key) -> bool:
        """`X above + expression` (or minus) as a running window. An error of the expression stays from its row on."""
        node = parse(self.formulas[key])
        col = sheet.columns.index(key[1]) + 1
        above = Ref(col, self.base_row - 1)
        if not isinstance(node, Binary) or node.op not in "+-" or node.left != above or above in references(node.right):
            if not (isinstance(node, Binary) and node.op == "+" and node.right == above and above not in references(node.left)):
                return False
            node = Binary("+", above, node.left)
        if any((r.start.col <= col <= r.end.col) if isinstance(r, Range) else r.col == col for r in references(node.right)):
            return False
        step = "__step"
        made = fill_down(self.wb, sheet, {step: "=" + show(Binary("+", Num(0.0), node.right))}, self.base_row, True)  # a number, or the error of what is none
        sign, err = -1 if node.op == "-" else 1, made.errors.get(step)
        wanted = {key[1]: ("sum", F.col(step) * sign)}
        if err:
            wanted["__first"] = ("min", F.when(F.col(err).isNotNull(), F.struct(F.col(sheet.row).alias("r"), F.col(err).alias("e"))))
        stale = [sheet.errors[key[1]]] if key[1] in sheet.errors else []
        df = ordered.running(made.df.drop(key[1], *stale), sheet.row, wanted).drop(step)
        errors = {k: v for k, v in sheet.errors.items() if k != key[1]}
        if err:
            code = f"{key[1]}__err"
            df = df.withColumn(code, F.col("__first")["e"]).withColumn(key[1], F.when(F.col(code).isNull(), F.col(f"`{key[1]}`"))).drop("__first", err)
            errors[key[1]] = code
        self.wb.add(sheet.with_df(df, list(sheet.columns), errors))
        return True

    def settle(self, group: list[Key], max_change: float, most: int) -> bool:
        """Jacobi iteration of a cycle: all columns anew from the last values until none changes by max_change. Every round goes to the checkpoint folder, so that none is computed twice."""
        for name in {k[0] for k in group}:
            s = self.wb.sheet(name)
            s.df = s.df.select(*[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c) if (name, c) in group else F.col(f"`{c}`") for c in s.df.columns])
        for i in range(most):
            before = {n: self.wb.sheet(n) for n in {k[0] for k in group}}
            fresh: dict[str, Sheet] = {}
            for n, s in before.items():
                old = s.df
                for c in [k[1] for k in group if k[0] == n]:
                    old = old.withColumn(f"__old_{c}", F.col(f"`{c}`"))
                fresh[n] = fill_down(self.wb, Sheet(s.name, old, list(s.columns), s.row, s.order, dict(s.errors)), {k[1]: self.formulas[k] for k in group if k[0] == n}, self.base_row, False)
            change = 0.0
            for n, s in fresh.items():
                cols = [k[1] for k in group if k[0] == n]
                df = s.df
                df = cut(df)
                change = max(change, df.agg(F.max(F.greatest(*[F.abs(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) - F.col(f"`__old_{c}`")) for c in cols], F.lit(0.0)))).first()[0] or 0.0)
                done = before[n].with_df(df.drop(*[f"__old_{c}" for c in cols]), None, {k: v for k, v in before[n].errors.items() if k not in cols})
                done.columns = list(before[n].columns)
                self.wb.add(done)
            if change < max_change:
                return True
        return False


def cut(df: DataFrame) -> DataFrame:
    """Ends the lineage in the shared checkpoint folder."""
    folder, sc = shared_folder(df.sparkSession), df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def reach(graph: dict[Key, set[Key]], key: Key) -> set[Key]:
    seen: set[Key] = set()
    todo = list(graph.get(key, ()))
    while todo:
        k = todo.pop()
        if k not in seen:
            seen.add(k)
            todo += graph.get(k, ())
    return seen


def components(graph: dict[Key, set[Key]]) -> Iterator[list[Key]]:
    """Strongly connected components, what is read first."""
    number: dict[Key, int] = {}
    low: dict[Key, int] = {}
    stack: list[Key] = []
    on: set[Key] = set()
    for root in graph:
        if root in number:
            continue
        work = [(root, iter(sorted(graph[root])))]
        number[root] = low[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            k, rest = work[-1]
            nxt = next((v for v in rest if v in graph and (v not in number or v in on)), None)
            if nxt is not None and nxt not in number:
                number[nxt] = low[nxt] = len(number)
                stack.append(nxt)
                on.add(nxt)
                work.append((nxt, iter(sorted(graph[nxt]))))
                continue
            if nxt is not None:
                low[k] = min(low[k], number[nxt])
                continue
            work.pop()
            if work:
                low[work[-1][0]] = min(low[work[-1][0]], low[k])
            if low[k] == number[k]:
                group = []
                while not group or group[-1] != k:
                    group.append(stack.pop())
                    on.discard(group[-1])
                yield group[::-1]


def data_table(wb: Workbook, sheet: str, formula: str, inputs: dict[str, list[float]]) -> DataFrame:
    """A what-if table: the formula for every combination of input values. inputs: cell -> values; one gives a row or column table, two a grid. Columns: the input cells, value."""
    s = wb.sheet(sheet)
    spark = s.df.sparkSession
    names = list(inputs)
    grid = None
    for n in names:
        axis = spark.createDataFrame([(float(v),) for v in inputs[n]], f"`{n}` double")
        grid = axis if grid is None else grid.crossJoin(F.broadcast(axis))  # axes are typed in by hand
    cells = {(r.col, r.row): i for i, n in enumerate(names, 1) for r in [parse(n)]}

    def one(x: Node) -> Node:
        if isinstance(x, Name):
            return x
        if isinstance(x, Ref) and (x.sheet or sheet).lower() == sheet.lower() and (x.col, x.row) in cells:
            return Ref(cells[x.col, x.row], 1)
        fixed = lambda r: Ref(r.col, r.row, True, True, r.sheet or sheet)
        return fixed(x) if isinstance(x, Ref) else Range(fixed(x.start), fixed(x.end))

    table = Sheet("__grid", grid, names)
    wb2 = Workbook({**wb.sheets, "__grid": table}, wb.names, wb.sheet_names, wb.today, wb.seed, wb.path)
    node = rewrite(parse(formula), one)
    return fill_down(wb2, table, {"value": "=" + show(node)}, 1, False).df.select(*[F.col(f"`{n}`") for n in names], "value")


def with_overrides(formula: str, overrides: dict[str, float | str | bool]) -> str:
    """Scenario evaluation: cells replaced by given values."""
    from lattica.parser import Logical, Num, Text

    make = lambda v: Logical(v) if isinstance(v, bool) else Num(float(v)) if isinstance(v, int | float) else Text(v)
    given = {(p.col, p.row): make(v) for k, v in overrides.items() for p in [parse(k)] if isinstance(p, Ref)}
    return "=" + show(rewrite(parse(formula), lambda x: given.get((x.col, x.row), x) if isinstance(x, Ref) else x))


