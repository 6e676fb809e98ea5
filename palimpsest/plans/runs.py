"""Run records: a frozen plan, its approval, what was done and what was checked, in one JSON file each."""

from __future__ import annotations

import contextlib
import glob
import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from palimpsest.operators import mask as masking
from palimpsest.operators import validate
from palimpsest.operators.seedmap import SeedMap
from palimpsest.plans.config import Config
from palimpsest.plans.decide import SENSITIVE, UNKNOWN, Decision, Report, plan_table
from palimpsest.plans.documents import now, pairs_once, safe
from palimpsest.plans.history import atomic_write
from palimpsest.sources import files
from palimpsest.sources.catalog import Catalog, location, split

VERSION = 2
SAFE_DETAIL = {"source", "target", "difference", "source_only", "target_only", "compared", "unmasked", "source_rows", "target_rows"}


class RunError(RuntimeError):
    pass


def digest(value) -> str:
    """SHA-256 of canonical JSON; numbers that aren't finite are refused."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


def config_digest(config: Config) -> str:
    given = asdict(config)
    given["masking"]["seed"] = digest(config.masking.seed)
    given["seed_map"]["salt"] = digest(config.seed_map.salt)
    return digest(given)


def identity(spark: SparkSession, path: str) -> str | None:
    """A digest of where a path really is, so that spellings of one place agree on any file system."""
    return digest(files.qualified(spark, path)) if path else None


def seed_map(spark: SparkSession, config: Config) -> SeedMap | None:
    """The configured map of seeds; None if it is off or has no folder."""
    given = config.seed_map
    return SeedMap(spark, given.path, given.salt, tuple(given.untracked)) if given.enabled and given.path else None


class Run:
    def __init__(self, path: str, data: dict):
        self.path, self.data = path, data

    @classmethod
    def create(cls, folder: str, report: Report, config: Config, path: str | None = None) -> Run:
        spark = report.catalog.spark
        plan = {
            "inventory": report.catalog.inventory(),
            "decisions": [asdict(d) for d in report.found],
            "scan_errors": report.errors,
            "strategies": {t: [asdict(p) for p in plan_table(report.found, t, config.masking)] for t in report.catalog.tables()},
            "config": config_digest(config),
            "source": identity(spark, report.catalog.path),
            "target": identity(spark, config.target),
        }
        plan = json.loads(json.dumps(plan))
        run_id = uuid.uuid4().hex
        path = path or os.path.join(folder, f"{run_id}.json")
        if os.path.exists(path):
            raise RunError("the run file exists")
        run = cls(path, {"version": VERSION, "id": run_id, "created_at": now(), "plan": plan, "plan_sha256": digest(plan), "approval": None, "execution": {"status": "planned", "tables": {}}, "repeats": [], "validations": []})
        run.save()
        return run

    @classmethod
    def load(cls, path: str) -> Run:
        def refused(text: str):
            raise ValueError(f"{text} isn't finite")

        try:
            with open(path, encoding="utf-8") as f:
                data = json.load(f, object_pairs_hook=pairs_once, parse_constant=refused)
        except ValueError as e:
            raise RunError(f"not a run file: {type(e).__name__}") from None
        if data.get("version") != VERSION:
            raise RunError("unknown version")
        if digest(data["plan"]) != data["plan_sha256"]:
            raise RunError("the frozen plan was changed")
        return cls(path, data)

    def save(self) -> None:
        atomic_write(self.path, json.dumps(self.data, indent=1, allow_nan=False))

    @property
    def decisions(self) -> list[Decision]:
        return [Decision(**d) for d in self.data["plan"]["decisions"]]

    @property
    def scope(self) -> set[tuple[str, str]]:
        """The sensitive columns."""
        return {(d.table, d.column) for d in self.decisions if d.sensitivity == SENSITIVE}

    @property
    def may_have_written(self) -> bool:
        return self.data["execution"]["status"] != "planned"

    def approve(self, reviewer: str) -> None:
        if not reviewer.strip():
            raise RunError("a reviewer is required")
        if self.may_have_written:
            raise RunError("the run was carried out already")
        if self.data["plan"]["scan_errors"]:
            raise RunError("tables could not be scanned: " + ", ".join(sorted(self.data["plan"]["scan_errors"])))
        if any(d.sensitivity == UNKNOWN for d in self.decisions):
            raise RunError("columns are undecided")
        decided = {(d.table, d.column) for d in self.decisions}
        listed = {(t, c) for t, x in self.data["plan"]["inventory"].items() for c in x["columns"]}
        if decided != listed:
            raise RunError("decisions and columns don't match")
        self.data["approval"] = {"by": reviewer, "at": now(), "plan_sha256": self.data["plan_sha256"]}
        self.save()

    def require_approved(self, catalog: Catalog, config: Config) -> None:
        approval, plan = self.data["approval"], self.data["plan"]
        if not approval or approval["plan_sha256"] != self.data["plan_sha256"]:
            raise RunError("the plan isn't approved")
        if plan["config"] != config_digest(config):
            raise RunError("the configuration has changed")
        if plan["source"] != identity(catalog.spark, catalog.path):
            raise RunError("this is another source")
        if json.loads(json.dumps(catalog.inventory())) != plan["inventory"]:
            raise RunError("the source's tables have changed")


@contextlib.contextmanager
def lock(spark: SparkSession, target: str) -> Iterator[None]:
    """One writer for a target; a second one fails at once."""
    try:
        with files.lock(spark, f"{target.rstrip('/')}.lock"):
            yield
    except files.LockedError as e:
        raise RunError(f"another run is writing to the target, or one that broke off left its lock: {e}") from None


def guard(run: Run, reason: str | None, resume: bool) -> None:
    """Refuse to mask columns of a target that a recorded run may have masked already, unless a reason is given, which is
    recorded, or this very run broke off and is resumed. The runs of one folder know of each other."""
    if reason is not None and not reason.strip():
        raise RunError("a reason must not be blank")
    for path in sorted(glob.glob(os.path.join(os.path.dirname(os.path.abspath(run.path)), "*.json"))):
        own = os.path.samefile(path, run.path)
        prior = run if own else Run.load(path)
        if prior.data["plan"]["target"] != run.data["plan"]["target"] or not prior.may_have_written or not prior.scope & run.scope:
            continue
        if own and resume or reason is not None:
            continue
        raise RunError("this run was begun before: resume it, or give a reason to repeat it" if own else "another run has masked these columns of the target: give a reason to repeat it")
    if reason is not None:
        run.data["repeats"].append({"reason": reason.strip(), "at": now()})
        run.save()


def apply(run: Run, catalog: Catalog, config: Config, resume: bool = False, reason: str | None = None) -> dict[str, masking.MaskResult]:
    """Write every table's masked copy; all are checked before any is written. resume: skip tables that an earlier try
    finished. reason: mask again what a recorded run has masked, in place of its tables."""
    spark = catalog.spark
    if identity(spark, config.target) == identity(spark, catalog.path):
        raise RunError("source and target are the same")
    if not config.target or identity(spark, config.target) != run.data["plan"]["target"]:
        raise RunError("this is another target")
    out = {}
    with lock(spark, config.target):
        run.data = Run.load(run.path).data  # as it is now that no one else writes
        run.require_approved(catalog, config)
        guard(run, reason, resume)
        plans = {t: [masking.ColumnPlan(**{**p, "null_markers": tuple(p["null_markers"])}) for p in ps] for t, ps in run.data["plan"]["strategies"].items()}
        for t, ps in plans.items():
            masking.preflight(catalog.table(t), ps, catalog.keys(t), catalog.read_only(t))
        pairs = seed_map(spark, config)
        attempt = len(run.data["repeats"])
        if reason is not None:
            run.data["execution"] = {"status": "planned", "tables": {}}
        done = run.data["execution"]["tables"]
        run.data["execution"]["status"] = "in_flight"
        for t, ps in plans.items():
            if done.get(t, {}).get("status") == "applied":
                continue
            done[t] = {"status": "in_flight", "at": now()}
            run.save()
            tag = digest([run.data["id"], run.data["plan_sha256"], attempt, t])
            out[t] = masking.apply(catalog.table(t), ps, catalog.keys(t), config.masking.seed, location(config.target, t), catalog.read_only(t), pairs, tag, replace_old=reason is not None)
            done[t] = {"status": "applied", "at": now(), "rows": out[t].rows, "columns": out[t].columns, "skipped": out[t].skipped_columns}
            run.save()
        run.data["execution"]["status"] = "applied"
        run.save()
    return out


def full_name(table: str, column: str) -> str:
    return ".".join((*split(table), column))


def coverage(spark: SparkSession, decisions: list[Decision], selected: set[str], errors: dict[str, str] | None = None) -> list[validate.Issue]:
    """What the comparison of values leaves out: unscanned tables, undecided columns, sensitive ones outside selected."""
    out = [validate.Issue("coverage", validate.ERROR, t, message=f"could not be scanned: {e}") for t, e in sorted((errors or {}).items())]
    if decisions:
        rows = spark.createDataFrame([(full_name(d.table, d.column), d.sensitivity, d.source) for d in decisions], "column_name string, sensitivity string, source string")
        names = spark.createDataFrame([(c,) for c in selected], "column_name string")
        found = {r["column_name"]: r["status"] for r in validate.coverage(rows, names).collect()}  # a row for each column
        for d in decisions:
            if (status := found[full_name(d.table, d.column)]) != validate.PASS:
                out.append(validate.Issue("coverage", status, d.table, d.column, "undecided" if d.sensitivity == UNKNOWN else "sensitive, but not compared"))
    return out or [validate.Issue("coverage", validate.PASS, detail={"compared": len(decisions)})]


def _opened(catalog: Catalog) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The tables that can be read, and why others can't."""
    found, lost = {}, {}
    for t in catalog.tables():
        try:
            found[t] = catalog.table(t)
        except Exception as e:  # the text may hold values
            lost[t] = safe(e)
    return found, lost


def check(source: Catalog, target: Catalog, decisions: list[Decision], config: Config, frozen: bool = False, errors: dict[str, str] | None = None) -> list[validate.Issue]:
    """All checks of a masked copy. frozen: a passed overlap heuristic is a warning, as nothing proves it. errors: tables
    that could not be scanned."""
    settings = config.validation
    (a, lost), (b, lost_there) = _opened(source), _opened(target)
    known = {full_name(t, c): (t, c) for t, df in a.items() for c in df.columns}
    if unknown := sorted(set(settings.columns) - set(known)):
        raise RunError("columns to validate that the source doesn't have: " + ", ".join(unknown))
    sensitive = [known[c] for c in settings.columns] or [(d.table, d.column) for d in decisions if d.sensitivity == SENSITIVE]
    issues = validate.presence(a, b) + [validate.Issue("tables", validate.ERROR, t, message=f"can't be read: {e}") for t, e in sorted([*lost.items(), *lost_there.items()])]
    if settings.check_row_count:
        issues += validate.row_counts(a, b)
    for t in sorted(a.keys() & b.keys()):
        if settings.check_schema:
            issues += validate.schema_elements(t, a[t], b[t], source.meta_of(t), target.meta_of(t))
        columns = [c for table, c in sensitive if table == t and c in b[t].columns]
        if not settings.check_completeness or not columns:
            continue
        keys = source.keys(t)
        if keys and keys == target.keys(t):
            for r in validate.completeness(a[t], b[t], keys, columns, settings.pk_row_limit, settings.ignore_test_data).collect():
                issues.append(validate.Issue("completeness", r["status"], t, r["column_name"], detail={k: r[k] for k in ("compared", "unmasked", "source_only", "target_only")}))
            continue
        for c in columns:
            status = validate.overlap(a[t], b[t], c).first()["status"]
            issues.append(validate.Issue("completeness", validate.WARNING if frozen and status == validate.PASS else status, t, c, "overlap"))
    if settings.check_completeness:
        issues += coverage(source.spark, decisions, {full_name(t, c) for t, c in sensitive}, errors)
    return issues


def validate_run(run: Run, source: Catalog, target: Catalog, config: Config) -> list[validate.Issue]:
    """Checks of an applied run against its frozen plan, recorded in the run file, whatever comes of them."""
    attempt = {"at": now(), "status": "running", "issues": []}
    run.data["validations"].append(attempt)
    run.save()
    try:
        run.require_approved(source, config)
        if identity(target.spark, target.path) != run.data["plan"]["target"]:
            raise RunError("this is another target")
        issues = check(source, target, run.decisions, config, frozen=True)
        frozen = run.data["plan"]["inventory"]
        if (actual := json.loads(json.dumps(target.inventory()))) != frozen:
            changed = sorted(t for t in frozen.keys() | actual.keys() if frozen.get(t) != actual.get(t))
            issues.append(validate.Issue("scope", validate.ERROR, message="the target's tables aren't those of the plan: " + ", ".join(changed)))
        if run.data["execution"]["status"] != "applied":
            issues.append(validate.Issue("execution", validate.ERROR, message="the run wasn't applied to its end"))
        for name in ("check_row_count", "check_schema", "check_completeness"):
            if not getattr(config.validation, name):
                issues.append(validate.Issue("coverage", validate.ERROR, message=f"{name} is switched off"))
    except BaseException as e:
        attempt |= {"status": "error", "error": safe(e)}
        run.save()
        raise
    shown = [{**asdict(i), "detail": {k: v for k, v in i.detail.items() if k in SAFE_DETAIL}} for i in issues]
    attempt |= {"status": "passed" if passed(issues, strict=True) else "failed", "ended_at": now(), "issues": shown}
    run.save()
    return issues


def passed(issues: list[validate.Issue], strict: bool = False) -> bool:
    bad = {validate.FAIL, validate.ERROR} | ({validate.WARNING, validate.SKIPPED} if strict else set())
    return not any(i.status in bad for i in issues)
