"""Streams: new source files to atoms as they land, and windowed counts of events with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corrobora.sources.formats import Tools, parse_batches
from corrobora.sources.scan import _OUT, source_type


def atom_stream(spark: SparkSession, folder: str, tools: Tools | None = None, files_per_batch: int = 1000) -> DataFrame:
    """Atoms of the files that land in a folder, parsed as in a batch scan; broken files give none."""
    tools = tools or Tools()
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("maxFilesPerTrigger", files_per_batch).load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("source_id"), "content").withColumn("source_type", source_type(F.col("source_id"))).where(F.col("source_type").isNotNull())
    parsed = named.select("source_id", "source_type", "content").mapInPandas(lambda b: parse_batches(b, tools, False), _OUT)
    return parsed.select("source_id", "source_type", F.explode("atoms").alias("a")).select("source_id", "source_type", "a.*")


def append_atoms(atoms: DataFrame, table_path: str, checkpoint: str) -> StreamingQuery:
    """Append new atoms to a table, each file once, stopping when all that has landed is done."""
    return atoms.writeStream.format("parquet").option("path", table_path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(event_type, start, n, total): counts and sums per tumbling window; rows later than the watermark are dropped."""
    e = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    g = e.groupBy("event_type", F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select("event_type", F.col("w.start").alias("start"), "n", "total")
