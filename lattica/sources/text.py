"""CSV and Markdown tables in, CSV, JSON and Markdown out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.sheet import Sheet

SAMPLE_ROWS, MAJORITY = 10, 0.8
DATE = r"^\d{4}-\d{2}-\d{2}$"


def typed(df: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """Text columns given types by the majority of their first cells that are not empty. A cell that does not fit, wherever it stands, stays as text in <column>__text; a column all of whose cells fit has none."""
    rows = df.limit(sample).collect()
    out: list[tuple[Column, Column | None]] = []  # column, and whether it is there
    for c in df.columns:
        seen = [r[c].strip() for r in rows if r[c] is not None and r[c].strip()]
        kinds = {"double": [bool(re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", x)) for x in seen], "boolean": [x.lower() in ("true", "false") for x in seen], "date": [bool(re.fullmatch(DATE[1:-1], x)) for x in seen]}
        kind = next((k for k, ok in kinds.items() if seen and sum(ok) / len(seen) >= MAJORITY), None)
        if kind is None:
            out.append((F.col(f"`{c}`"), None))
            continue
        value = F.trim(F.col(f"`{c}`")).try_cast(kind)
        out.append((value.alias(c), None))
        misfit = F.when(value.isNull() & (F.trim(F.col(f"`{c}`")) != ""), F.col(f"`{c}`"))
        out.append((misfit.alias(f"{c}__text"), F.count(misfit) > 0))
    asked = [there for _, there in out if there is not None]
    found = iter(df.agg(*[there.alias(str(i)) for i, there in enumerate(asked)]).first() if asked else ())  # one scan over all rows
    return df.select(*[col for col, there in out if there is None or next(found)])


def read_csv(spark: SparkSession, path: str, name: str = "Sheet1", delimiter: str = ",", encoding: str = "UTF-8", header: bool = True, infer: bool = True) -> Sheet:
    df = spark.read.csv(path, sep=delimiter, encoding=encoding, header=header, inferSchema=False, quote='"', escape='"', multiLine=True, ignoreLeadingWhiteSpace=False)
    return Sheet(name, typed(df) if infer else df)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.csv(path, header=header, quote='"', escape='"', quoteAll=False)


def read_markdown(spark: SparkSession, text: str, name: str = "Sheet1") -> Sheet:
    """A pipe table with its alignment row."""
    lines = [x.strip() for x in text.strip().splitlines() if x.strip().startswith("|")]
    cells = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", x.strip("|"))] for x in lines]
    if len(cells) < 2 or not all(re.fullmatch(r":?-+:?", c) for c in cells[1]):
        raise ValueError("not a pipe table")
    head, body = cells[0], cells[2:]
    rows = [(i + 1, *[(r[k] or None) if k < len(r) else None for k in range(len(head))]) for i, r in enumerate(body)]
    df = spark.createDataFrame(rows, "_row bigint, " + ", ".join(f"`{h}` string" for h in head))
    return Sheet(name, df, head, "_row")


def markdown(df: DataFrame, limit: int = 50) -> str:
    """The first rows as a pipe table, for display."""
    rows = df.limit(limit).collect()
    show = lambda x: "" if x is None else str(x).replace("|", "\\|")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "|".join("---" for _ in df.columns) + "|"]
    return "\n".join(lines + ["| " + " | ".join(show(x) for x in r) + " |" for r in rows])


def json_rows(df: DataFrame, row: str = "_row") -> DataFrame:
    """One JSON object for each row: {row, cells}, values typed, empty cells left out."""
    cells = [c for c in df.columns if c != row]
    return df.select(F.to_json(F.struct(F.col(row).alias("row"), F.struct(*[F.col(f"`{c}`") for c in cells]).alias("cells"))).alias("value"))
