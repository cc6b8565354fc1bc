"""What a run did, as log events on standard error; outputs never hold any of it. Clock times stand here alone."""

from __future__ import annotations

import json
import logging
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger("corrobora.events")


class Lines(logging.Formatter):
    """One line an event: its name and details, as text or as one JSON object."""

    def __init__(self, as_json: bool):
        super().__init__()
        self.as_json = as_json

    def format(self, record: logging.LogRecord) -> str:
        details = dict(sorted(getattr(record, "details", {}).items()))
        if self.as_json:
            return json.dumps({"event": record.getMessage(), "level": record.levelname.lower(), "time": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created)), **details}, ensure_ascii=False)
        return " ".join([record.levelname.lower(), record.getMessage(), *(f"{k}={v}" for k, v in details.items())])


def listen(level: str = "warning", as_json: bool = False) -> None:
    """Send events of at least that level to standard error."""
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(Lines(as_json))
    log.handlers[:] = [handler]
    log.setLevel(level.upper())
    log.propagate = False


def tell(name: str, level: int = logging.INFO, **details: object) -> None:
    log.log(level, name, extra={"details": details})


def counts_by(df: DataFrame, column: str) -> dict[str, int]:
    """Rows by the values of a column that has few."""
    return {r[0]: r[1] for r in df.groupBy(column).count().orderBy(column).collect()}


def tell_run(run: object, seconds: float) -> None:
    """The events of a finished run. What has to be counted for them is counted only if somebody listens.

    Skipped sources, refused unions and merges by soft keys are warnings; the rest is information.
    """
    if log.isEnabledFor(logging.WARNING):
        for r in run.scan.sources.where("status = 'skipped'").orderBy("source_id").toLocalIterator():
            tell("source_skipped", logging.WARNING, source_id=r.source_id, errors=list(r.errors))
        if refused := counts_by(run.refusals, "reason"):
            tell("unions_refused", logging.WARNING, **refused)
        if soft := run.clusters.where(F.array_contains("flags", "soft_key_merge")).count():
            tell("soft_key_merges", logging.WARNING, clusters=soft)
    if log.isEnabledFor(logging.INFO):
        tell("sources_read", **counts_by(run.scan.sources, "status"))
        tell("values_unreadable", **counts_by(run.unreadable, "reason"))
        left_out = run.validation.agg(F.count_distinct("candidate_id")).first()[0]
        tell("run_done", profiles=run.records.count(), clusters=run.clusters.count(), excluded=left_out, output=run.output_hash(), milliseconds=int(seconds * 1000))
