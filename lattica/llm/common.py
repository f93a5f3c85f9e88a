"""What several operators share: shared-folder tables, word rules, row packing, distributed ranks."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.shared import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: bytes -> the same bytes with A-Z lowered.
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, so a lost executor costs no rerun of what stands before. The table goes when the session's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lattica-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def column(df: DataFrame, name: str) -> Column:
    """Column by its literal name, dots and backticks included."""
    return df["`" + name.replace("`", "``") + "`"]


def packed(df: DataFrame, row: str = "row") -> DataFrame:
    """The whole row as one struct, so that what an operator adds cannot clash with its columns; the inverse is select("row.*")."""
    return df.select(F.struct(*[column(df, c).alias(c) for c in df.columns]).alias(row))


def content_key(*parts: Column) -> Column:
    """128 bits of a row's content; NULL counts as a value of its own, and each part's length is its own."""
    each = [F.when(p.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), F.unhex(F.md5(p.cast("string").cast("binary"))))) for p in parts]
    return F.unhex(F.md5(F.concat(*each)))


def fields(given: dict[str, T.DataType], ddl: str) -> T.StructType:
    """A schema of given types, under any names, and what the DDL text adds."""
    return T.StructType([*(T.StructField(n, t) for n, t in given.items()), *T.StructType.fromDDL(ddl).fields])


def arrow_map(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    return df.mapInArrow(work, schema)


def ascii_lower(text: Column) -> Column:
    """Lowers A-Z alone. lower() does the same, and faster, where a text has ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def json_table(spark: SparkSession, rows_json: str, ddl: str) -> DataFrame:
    """A small driver-made table as one constant that the JVM parses."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(rows_json), f"array<struct<{ddl}>>")).alias("r")).select("r.*")


#: Buckets into which a distributed rank splits each group, by the leading bits of the order hash.
RANK_BITS = 10


def ranked(df: DataFrame, group: list[str], order: str, rank: str, bits: int = RANK_BITS) -> DataFrame:
    """Adds `rank`: the row's 0-based place within its group by the long hash `order`. No group meets in one task: each is split into 2**bits ranges of the hash, rows are numbered inside a range, and the counts of the ranges before are added. A range's share of a group is fixed by the hash, so a source with a third of all rows is 2**bits tasks' worth. df is read twice; give it cheap or materialized."""
    part = F.shiftright(F.col(order), 64 - bits)
    cut = df.withColumn("__part", part)
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    numbered = cut.withColumn("__i", F.row_number().over(Window.partitionBy(*group, "__part").orderBy(order)) - 1)
    return numbered.join(offsets, same).withColumn(rank, F.col("__i") + F.col("__before")).drop("__part", "__p", "__i", "__before", *[f"__g{i}" for i in range(len(group))])


def part_order(path: str) -> tuple[int, int, str]:
    """Sorts the files of one write as their tasks wrote them."""
    found = re.search(r"part-(\d+)[^/]*?(?:-c(\d+))?(?:\.[^/]*)?$", path)
    return (int(found[1]), int(found[2] or 0), path) if found else (-1, 0, path)


def in_written_order(df: DataFrame) -> DataFrame:
    """row (the whole row), __position: its place, gapless from 0, in the order in which the table was written, so that a sort before the write is known after it. A row's place is its number in its Parquet file and the counts of the files before, which the driver holds as it holds their listing. What is not a written Parquet table as it stands is written first."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or plan.relation().toString().lower() != "parquet":
        df = materialize(df, "ordered")
    at = df.metadataColumn("_metadata")
    rows = df.select(F.struct(*[column(df, c).alias(c) for c in df.columns]).alias("row"), at["file_path"].alias("__file"), at["row_index"].alias("__i"))
    counts = {r[0]: r[1] for r in rows.groupBy("__file").agg(F.count(F.lit(1))).collect()}
    files, total = [], 0
    for path in sorted(counts, key=part_order):
        files.append({"f": path, "before": total})
        total += counts[path]
    known = F.broadcast(json_table(df.sparkSession, json.dumps(files), "f:string,before:bigint"))
    return rows.join(known, F.col("__file") == F.col("f")).select("row", (F.col("before") + F.col("__i")).alias("__position"))
