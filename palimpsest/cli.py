"""Command line: scan, plan, approve, mask, validate, history and strategies. Nothing is written to a target without --apply."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from palimpsest.functions.strategies import STRATEGIES
from palimpsest.operators import mask as masking
from palimpsest.operators.validate import TableMeta
from palimpsest.plans import config as settings
from palimpsest.plans import decide, history, llmclassify, runs
from palimpsest.sources.catalog import Catalog


def _catalog(spark: SparkSession, config: settings.Config, path: str) -> Catalog:
    names = {*config.keys, *config.generated}
    return Catalog(spark, path, {t: TableMeta(keys=config.keys.get(t, []), generated=config.generated.get(t, [])) for t in names}, schemas=config.schemas or None)


def _store(config: settings.Config) -> history.Store | None:
    """JSON keeps records and suggestions; any other file is a reviewed sheet that only history-writeback changes."""
    if not config.history:
        return None
    return history.History(config.history) if config.history.endswith(".json") else history.FileHistory(config.history)


def _scan(spark: SparkSession, config: settings.Config) -> decide.Report:
    return decide.scan(_catalog(spark, config, config.source), config.detection, history=_store(config), classifier=llmclassify.from_settings(config.llm))


def _review(path: str, store: history.Store | None, report: decide.Report, config: settings.Config) -> None:
    records = [decide.as_record(report.catalog.name, d, config.detection.user_id) for d in report.found]
    if isinstance(store, history.FileHistory):
        known = {r.place: r for r in store.for_review()}
        history.export_review(store, path, [known.get(r.place, r) for r in records])
    else:
        history.write_file(path, records)


def _history(args: argparse.Namespace, store: history.Store) -> int:
    if args.command == "history-import":
        print(json.dumps(store.import_records(history.read_file(args.file), args.overwrite_approved, preview=not args.apply)))
    elif args.command == "history-export":
        if isinstance(store, history.FileHistory):
            history.export_review(store, args.file, store.for_review())
        else:
            history.write_file(args.file, store.for_review())
    elif args.command == "history-writeback":
        if not isinstance(store, history.FileHistory):
            print("only a history that is a review file can be written back to", file=sys.stderr)
            return 2
        print(json.dumps(history.write_back(store, args.file, args.reviewed_by, args.apply)))
    else:
        for r in store.for_review():
            print(r.table, r.column, r.decision, r.review_status)
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="palimpsest")
    parser.add_argument("--config", default="palimpsest.yaml")
    commands = parser.add_subparsers(dest="command", required=True)
    scan = commands.add_parser("scan")
    scan.add_argument("--json", action="store_true")
    scan.add_argument("--output", help="a new sheet for review")
    scan.add_argument("--run-file", help="also save the plan there")
    commands.add_parser("plan")
    approve = commands.add_parser("approve")
    approve.add_argument("run_file")
    approve.add_argument("--reviewer", required=True)
    mask = commands.add_parser("mask")
    mask.add_argument("--apply", action="store_true")
    mask.add_argument("--run-file")
    mask.add_argument("--show-values", action="store_true")
    mask.add_argument("--allow-partial", action="store_true")
    mask.add_argument("--resumable", action="store_true", help="every run is: finished tables are recorded")
    mask.add_argument("--resume", action="store_true", help="go on with a run that broke off")
    mask.add_argument("--remask-reason", help="mask again, in place of what a recorded run wrote")
    check = commands.add_parser("validate")
    check.add_argument("--json", action="store_true")
    check.add_argument("--strict", action="store_true")
    check.add_argument("--run-file")
    commands.add_parser("history")
    for name in ("history-import", "history-export"):
        sub = commands.add_parser(name)
        sub.add_argument("file")
        sub.add_argument("--apply", action="store_true")
        sub.add_argument("--overwrite-approved", action="store_true")
    back = commands.add_parser("history-writeback")
    back.add_argument("file")
    back.add_argument("--reviewed-by", required=True)
    back.add_argument("--apply", action="store_true")
    commands.add_parser("seeds")
    commands.add_parser("strategies")
    args = parser.parse_args(argv)
    if args.command == "strategies":
        print("\n".join(sorted(STRATEGIES)))
        return 0
    config = settings.load(args.config)
    if args.command.startswith("history"):
        return _history(args, _store(config) or history.History("history.json"))
    if args.command == "approve":
        runs.Run.load(args.run_file).approve(args.reviewer)
        return 0
    spark = spark or SparkSession.builder.appName("palimpsest").getOrCreate()
    if args.command == "seeds":
        pairs = runs.seed_map(spark, config)
        if pairs is None:
            print("no seed map is configured", file=sys.stderr)
            return 2
        for r in pairs.all_pairs().collect():
            print(r["scope"], r["value_hash"][:16], r["masked_value"])
        return 0
    if args.command in ("scan", "plan"):
        report = _scan(spark, config)
        if args.command == "plan":
            print(runs.Run.create(config.runs, report, config).path)
        elif args.json:
            print(json.dumps({"decisions": [asdict(d) for d in report.found], "evidence": report.evidence, "errors": report.errors, "stats": report.stats()}))
        else:
            for d in report.found:
                print(d.table, d.column, d.sensitivity, d.rule or "-", d.source)
        if args.command == "scan" and args.output:
            _review(args.output, _store(config), report, config)
        if args.command == "scan" and args.run_file:
            runs.Run.create(config.runs, report, config, args.run_file)
        return 3 if report.errors else 0
    source = _catalog(spark, config, config.source)
    if args.command == "mask":
        if (args.resume or args.resumable) and (not args.apply or args.remask_reason is not None or args.resume and args.resumable):
            print("--resumable and --resume go with --apply, and neither with the other nor with --remask-reason", file=sys.stderr)
            return 2
        if args.apply:
            if not args.run_file:
                print("--apply needs the run file of an approved plan", file=sys.stderr)
                return 2
            for t, r in runs.apply(runs.Run.load(args.run_file), source, config, args.resume, args.remask_reason).items():
                print(t, r.rows, "masked:", ",".join(r.columns) or "-", "left as keys:", ",".join(r.skipped_columns) or "-")
            return 0
        report = _scan(spark, config)
        if report.errors and not args.allow_partial:
            print("tables could not be scanned: " + ", ".join(report.errors), file=sys.stderr)
            return 2
        if config.masking.seed == settings.Masking().seed:
            print("warning: the default seed is in use", file=sys.stderr)
        pairs = runs.seed_map(spark, config)
        for t in source.tables():
            plans = decide.plan_table(report.found, t, config.masking)
            if plans:
                result = masking.dry_run(source.table(t), plans, source.keys(t), config.masking.seed, read_only=source.read_only(t), pairs=pairs, show_values=args.show_values)
                print(t, result.rows, "would be masked:", ",".join(result.columns) or "-")
                for row in result.preview:
                    print("  before:", {c: before for c, (before, _) in row.items()}, "after:", {c: after for c, (_, after) in row.items()})
                if result.skipped_columns:
                    print(f"warning: {t} keeps its key columns {', '.join(result.skipped_columns)}", file=sys.stderr)
        if unknown := [f"{d.table}.{d.column}" for d in report.found if d.sensitivity == decide.UNKNOWN]:
            print(f"warning: {len(unknown)} undecided columns stay as they are: {', '.join(unknown)}", file=sys.stderr)
        return 0
    target = _catalog(spark, config, config.target)
    if args.run_file:
        issues = runs.validate_run(runs.Run.load(args.run_file), source, target, config)
    else:
        report = _scan(spark, config)
        issues = runs.check(source, target, report.found, config, errors=report.errors)
    print(json.dumps([asdict(i) for i in issues]) if args.json else "\n".join(f"{i.check} {i.status} {i.table} {i.column} {i.message} {i.detail or ''}" for i in issues))
    return 0 if runs.passed(issues, args.strict) else 1


if __name__ == "__main__":
    sys.exit(main())
