"""Sinks: pinned JSON, the run report, the output hash and the run itself."""

from __future__ import annotations

import hashlib
import json
import logging
import time
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corrobora.functions import dictionaries as D
from corrobora.functions import partial_dates as dates
from corrobora.operators.identity import resolve
from corrobora.operators.merge import derive_as_of, merge
from corrobora.plans.config import Query, compile_query
from corrobora.plans.projection import project
from corrobora.plans.telemetry import tell_run
from corrobora.session import cut
from corrobora.sources.formats import Tools
from corrobora.sources.scan import Scan, scan_folder

log = logging.getLogger("corrobora")
ENGINE_VERSION = "0.1.0"


def dumps(doc: object) -> str:
    """Sorted keys, two blanks of indent, characters kept, a newline at the end."""
    return json.dumps(doc, sort_keys=True, indent=2, ensure_ascii=False) + "\n"


def write_json(path: str | Path, doc: object) -> None:
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_bytes(dumps(doc).encode("utf-8"))


def _unquoted(text: str) -> object:
    try:
        return json.loads(text) if text[:1] in "{[" else text
    except ValueError:
        return text


def as_documents(records: DataFrame, query: Query) -> list[dict]:
    """The records as output documents in the order of candidate_id; for bounded results, the scale path is write.json or parquet."""
    docs = []
    for row in records.orderBy("candidate_key").toLocalIterator():
        d = row.asDict(True)
        d.pop("candidate_key")
        lexeme = d.pop("__years_lexeme", None)
        for f in query.fields:
            if f.source == "years_experience" and lexeme is not None:
                _set(d, f.out, json.loads(lexeme))
            if query.on_missing == "omit":
                _drop_null(d, f.out)
        for p in d.get("provenance", ()):
            p["alternatives"] = [_unquoted(a) for a in p["alternatives"]]
        docs.append(d)
    return docs


def _set(d: dict, path: tuple[str, ...], value: object) -> None:
    for n in path[:-1]:
        d = d[n]
    d[path[-1]] = value


def _drop_null(d: dict, path: tuple[str, ...]) -> None:
    for n in path[:-1]:
        d = d[n]
    if d.get(path[-1]) is None:
        d.pop(path[-1], None)


@dataclass
class Run:
    """Tables of one run; documents and report are made on demand."""

    query: Query
    scan: Scan
    profiles: DataFrame
    records: DataFrame
    validation: DataFrame
    unreadable: DataFrame
    clusters: DataFrame
    refusals: DataFrame
    record_flags: DataFrame
    as_of: dates.PartialDate | None
    region: str | None

    def documents(self) -> list[dict]:
        return as_documents(self.records, self.query)

    def output_hash(self) -> str:
        return hashlib.sha256(dumps(self.documents()).encode("utf-8")).hexdigest()[:16]

    def source_table(self) -> DataFrame:
        """sources with the flags of their records."""
        of = self.scan.atoms.select("record_id", "source_id").distinct().join(self.record_flags, "record_id")
        flags = of.groupBy("source_id").agg(F.array_sort(F.collect_set("flag")).alias("flags"))
        return self.scan.sources.join(flags, "source_id", "left").withColumn("flags", F.coalesce("flags", F.array().cast("array<string>")))

    def report(self) -> dict:
        rows = lambda df, *order: [{k: v for k, v in r.asDict(True).items() if v is not None or k not in ("source_id", "candidate_id")} for r in df.orderBy(*order).toLocalIterator()]
        return {
            "run": {
                "as_of": dates.render(self.as_of), "default_region": self.region, "config_fields": [f.path for f in self.query.fields], "engine_version": ENGINE_VERSION,
                "scoring_version": D.VERSION, "dictionary_versions": {"skill_aliases": D.VERSION, "country_aliases": D.VERSION},
            },
            "sources": rows(self.source_table(), "source_id"),
            "unrecognized_files": [r[0] for r in self.scan.unrecognized.orderBy("source_id").collect()],
            "merges": {
                "clusters": rows(self.clusters, "cluster_id"),
                "refusals": [{"records": r.records, "key": r.key, "reason": r.reason} for r in self.refusals.orderBy("rank", "key", "other").toLocalIterator()],
            },
            "validation": rows(self.validation, "candidate_id", "field"),
            "unparseable": rows(self.unreadable, F.coalesce("source_id", F.lit("")), F.coalesce("candidate_id", F.lit("")), "field", "raw_value"),
        }


    def tables(self) -> dict[str, DataFrame]:
        """Everything the run found, as tables."""
        return {
            "records": self.records, "sources": self.source_table(), "clusters": self.clusters, "refusals": self.refusals, "validation": self.validation, "unreadable": self.unreadable,
            "unrecognized": self.scan.unrecognized,
        }

    def write_tables(self, path: str, kind: str = "parquet") -> None:
        """All tables under a folder, written by the executors; nothing is collected."""
        for name, df in self.tables().items():
            df.write.mode("overwrite").format(kind).save(f"{path.rstrip('/')}/{name}")


def run_scan(scan: Scan, query: Query, as_of: dates.PartialDate | None = None, region: str | None = None) -> Run:
    """Identity, merge and projection of scanned sources."""
    if as_of is None:
        as_of, tier = derive_as_of(scan.atoms)
        if as_of and tier == "claims":
            log.warning("as_of_derived_from_claims as_of=%s", dates.render(as_of))
    who = resolve(scan.atoms)
    merged = merge(scan.atoms, who.members, who.clusters, who.refusals.select("key").distinct(), as_of)
    records, validation, notes = project(merged.profiles, query)
    none = F.lit(None).cast("string")
    unreadable = (
        scan.unreadable.select("source_id", none.alias("candidate_id"), "field", "raw_value", "reason")
        .unionByName(merged.notes.select("source_id", none.alias("candidate_id"), "field", "raw_value", "reason"))
        .unionByName(notes.select(none.alias("source_id"), "candidate_id", "field", "raw_value", "reason"))
    )
    return Run(query, scan, merged.profiles, cut(records), validation, unreadable, who.clusters, who.refusals, who.record_flags, as_of, region)


def run(spark: SparkSession, path: str, config: str | Path | dict, *, default_region: str | None = None, as_of: str | None = None, strict: bool = False, tools: Tools | None = None) -> Run:
    """A folder of source files under a query. The config is compiled before any data is read."""
    query = compile_query(config)
    month = dates.parse(as_of) if as_of else None
    if as_of and month is None:
        raise ValueError(f"not a month: {as_of!r}")
    tools = tools or Tools(region=default_region)
    began = time.monotonic()
    done = run_scan(scan_folder(spark, path, tools, strict), query, month, default_region)
    tell_run(done, time.monotonic() - began)
    return done
