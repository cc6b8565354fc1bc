"""Folders of source files as tables: sources, atoms, unreadable values and unrecognised files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.operators.layout import spread
from corrobora.session import cut
from corrobora.sources.formats import ADAPTERS, Adapter, Tools, parse_batches

ATOM = "record_id string, updated_at string, field_path string, value string, raw_value string, method string, order_index int, normalized boolean, locator string"
_OUT = (
    "source_id string, source_type string, status string, records_read int, errors array<string>, "
    f"atoms array<struct<{', '.join(':'.join(x.split()) for x in ATOM.split(', '))}>>, unreadable array<struct<field:string,raw_value:string,reason:string>>"
)


def source_type(name: Column, adapters: tuple[Adapter, ...] | None = None) -> Column:
    """Kind of a file by its name, null if no adapter claims it; the first that fits counts."""
    n = F.lower(name)
    return F.coalesce(*[F.when(n.rlike(a.names), F.lit(a.kind)) for a in adapters or ADAPTERS])


@dataclass
class Scan:
    sources: DataFrame
    atoms: DataFrame
    unreadable: DataFrame
    unrecognized: DataFrame


def raw_files(spark: SparkSession, path: str) -> DataFrame:
    """(source_id, source_type, content) of the files of a folder, or of one file.

    Spark reads no rows from empty files, so those come from the listing that the reader holds.
    """
    f = spark.read.format("binaryFile").load(path)
    name = lambda c: F.url_decode(F.replace(F.element_at(F.split(c, "/"), -1), F.lit("+"), F.lit("%2B")))
    read = f.select(name("path").alias("source_id"), "content")
    listed = spark.createDataFrame([(x,) for x in f.inputFiles()], "path string").select(name("path").alias("source_id"))
    empty = listed.join(f.select(name("path").alias("source_id")), "source_id", "left_anti").select("source_id", F.lit(b"").alias("content"))
    return read.unionByName(empty).withColumn("source_type", source_type(F.col("source_id")))


def scan(files: DataFrame, tools: Tools | None = None, strict: bool = False, shuffled: bool = False) -> Scan:
    """files (source_id, source_type, content) parsed where they lie, one row per file, then laid out as tables.

    A broken file is skipped and reported, broken rows make it partial; strict raises instead. Files of no known kind are
    listed. Nothing depends on the order or the times of the files. shuffled: files come out of a shuffle or a join.
    """
    tools = tools or Tools()
    known = files.where(F.col("source_type").isNotNull()).select("source_id", "source_type", "content")
    parsed = cut(spread(known, shuffled).mapInPandas(lambda b: parse_batches(b, tools, strict), _OUT))
    sources = parsed.select("source_id", "source_type", "status", "records_read", F.size("atoms").alias("evidence_emitted"), "errors")
    atoms = parsed.select("source_id", "source_type", F.explode("atoms").alias("a")).select("source_id", "source_type", "a.*")
    unreadable = parsed.select("source_id", F.explode("unreadable").alias("u")).select("source_id", "u.*")
    return Scan(sources, atoms, unreadable, files.where(F.col("source_type").isNull()).select("source_id"))


def scan_folder(spark: SparkSession, path: str, tools: Tools | None = None, strict: bool = False) -> Scan:
    return scan(raw_files(spark, path), tools, strict, shuffled=True)
