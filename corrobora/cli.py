"""python -m corrobora run: source files to profiles and report. Exit code 2 for bad configs, dates and inputs.

Runs in the session it is submitted to (spark-submit), else in a local one. --out and --report are single files for results that a
driver can hold; --tables has the executors write everything as tables.
"""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import SparkSession

from corrobora.functions.dictionaries import load_aliases
from corrobora.plans.config import DEFAULT, RECRUITER_VIEW, ConfigError
from corrobora.plans.report import dumps, run, write_json
from corrobora.plans.telemetry import listen
from corrobora.session import local_session
from corrobora.sources.formats import Tools


def session() -> SparkSession:
    """The session at hand, or that of spark-submit, or a local one."""
    given = SparkSession.getActiveSession()
    if given is not None:
        return given
    return SparkSession.builder.getOrCreate() if SparkConf().get("spark.master") else local_session()


def _input(given: str) -> str | None:
    """What to read: the files of a folder, a file, or a path of another file system as it stands; None if there is none."""
    if "://" in given:
        return given
    p = Path(given)
    return None if not p.exists() else str(p / "*") if p.is_dir() else str(p)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="corrobora")
    r = p.add_subparsers(dest="command", required=True).add_parser("run")
    r.add_argument("--input", required=True, help="a folder, a file, or a path or glob of a shared file system")
    r.add_argument("--config", default="default", help="a JSON file, default or recruiter_view")
    r.add_argument("--out", help="file for the profiles; standard output without it and --tables")
    r.add_argument("--report", help="file for the run report")
    r.add_argument("--tables", help="folder for all results as tables")
    r.add_argument("--default-region")
    r.add_argument("--as-of", help="YYYY-MM; derived from the records without it")
    r.add_argument("--skills", help="JSON file of skill aliases")
    r.add_argument("--countries", help="JSON file of country aliases")
    r.add_argument("--strict", action="store_true")
    r.add_argument("--log-level", default="warning")
    r.add_argument("--log-json", action="store_true")
    a = p.parse_args(argv)
    logging.basicConfig(level=a.log_level.upper(), stream=sys.stderr)
    listen(a.log_level, a.log_json)
    if (path := _input(a.input)) is None:
        print(f"no such input: {a.input}", file=sys.stderr)
        return 2
    config = {"default": DEFAULT, "recruiter_view": RECRUITER_VIEW}.get(a.config, a.config)
    try:
        aliases = [load_aliases(f) if f else None for f in (a.skills, a.countries)]
        done = run(session(), path, config, default_region=a.default_region, as_of=a.as_of, strict=a.strict, tools=Tools(a.default_region, *aliases))
    except (ConfigError, ValueError, OSError) as e:
        print("\n".join(getattr(e, "errors", [str(e)])), file=sys.stderr)
        return 2
    if not done.scan.sources.where("status <> 'skipped'").limit(1).count():
        print("no readable sources", file=sys.stderr)
        return 2
    if a.tables:
        done.write_tables(a.tables)
    if a.out:
        write_json(a.out, done.documents())
    elif not a.tables:
        sys.stdout.write(dumps(done.documents()))
    if a.report:
        write_json(a.report, done.report())
    return 0
