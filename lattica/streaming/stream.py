"""File streams: filter, running stats and bounds over files as they come, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.operators import table
from lattica.predicate import where
from lattica.sheet import Sheet


def source(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int | None = None, **options) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def filtered(stream: DataFrame, predicate: str, columns: str | None = None) -> DataFrame:
    sheet = Sheet("stream", stream)
    return stream.where(where(sheet, predicate)).select(*table.selected(sheet, columns))


def stats(stream: DataFrame, columns: str | None = None) -> DataFrame:
    """Constant-size state: one row of sums for each column."""
    return table.stats(Sheet("stream", stream), columns)


def counts(stream: DataFrame, key: str, time: str | None = None, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by key, within windows of event time where a time column is given (an extension)."""
    if time is None:
        return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    return stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"))


def to_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet") -> DataFrame:
    """Runs an appending stream over what is there now into files, and reads them; a later call with the same checkpoint goes on where this one ended, and a lost run is resumed without doubled rows."""
    writer = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    writer.start().awaitTermination()
    return df.sparkSession.read.format(fmt).schema(df.schema).load(path)


def first_rows(df: DataFrame, n: int, path: str, checkpoint: str, fmt: str = "parquet") -> DataFrame:
    """The first n rows that come, in files; the stream ends with the batch that has the last of them, and what lies beyond is never read. The size of a batch is the source's (files_per_trigger)."""
    spark = df.sparkSession
    taken = 0

    def take(batch: DataFrame, number: int) -> None:
        nonlocal taken
        if taken >= n:
            return
        part = f"{path}/batch={number}"
        batch.limit(n - taken).write.format(fmt).mode("overwrite").save(part)  # a batch that is run again replaces itself
        taken += spark.read.format(fmt).schema(df.schema).load(part).count()

    query = df.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    while not query.awaitTermination(1):
        if taken >= n:
            query.stop()
            break
    return spark.read.format(fmt).schema(df.schema).option("basePath", path).load(f"{path}/batch=*") if taken else spark.createDataFrame([], df.schema)


def drain(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream of few result rows (sums, windows) over what is there now and gives the in-memory result table, which the driver holds; `to_files` is for results that grow with the input."""
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    writer.start().awaitTermination()
    return df.sparkSession.table(name)
