"""Command line: ``python -m skyloom run --config FILE --tables FOLDER --models MODULE:NAME [--date DAY] [--stage STAGE] [--dry-run]``."""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import SparkSession

from .plans import nightly, settings


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser("skyloom")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="the stages of a night")
    run.add_argument("--config", required=True, help="settings (TOML, JSON or YAML)")
    run.add_argument("--tables", required=True, help="folder of the tables, in any store that Spark opens")
    run.add_argument("--models", help="MODULE:NAME of a mapping from role (light, heavy) to a model")
    run.add_argument("--date", help="day of the run, YYYY-MM-DD; today without")
    run.add_argument("--stage", help=f"one of {', '.join(nightly.STAGES)}; all without, and what is too old is pruned then")
    run.add_argument("--dry-run", action="store_true", help="shows what scout finds and writes nothing")
    return out


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    asked = parser().parse_args(args)
    try:
        own, day = settings.load(asked.config), nightly.day_of(asked.date)
        nightly.chosen(asked.stage, asked.dry_run)
        if not asked.dry_run and not asked.models and asked.stage not in ("scout", "rank"):
            raise settings.SettingsError("--models is missing")
    except settings.SettingsError as error:
        print(error, file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("skyloom").getOrCreate()
    if asked.dry_run:
        found = nightly.candidates(spark, own, day)
        print(f"{found.count()} papers")
        found.select("published", "arxiv_id", "title").orderBy("published", "arxiv_id").show(own.scout.max_results, 88)
        return 0
    module, _, name = (asked.models or "").partition(":")
    models = getattr(importlib.import_module(module), name) if module else {}
    print(nightly.run(spark, own, asked.tables, day, models, asked.stage))
    return 0


if __name__ == "__main__":
    sys.exit(main())
