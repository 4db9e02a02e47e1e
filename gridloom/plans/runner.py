"""Run control: plans, publication runs, command line."""

from __future__ import annotations

import datetime as dt
import importlib
import json
import os
import shutil
import sys
import time
import tomllib
import uuid
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import verify
from gridloom.operators.metric import MetricGroup, compute, labelled
from gridloom.sources import dayfiles, published
from gridloom.sources.paths import date_text, input_path, matching_dates
from gridloom.sources.published import RunConfig

#: Exit codes of the command line.
OK, FAILED, BAD_ARGUMENTS, NOT_READY, LOCKED = 0, 1, 2, 3, 4
TEXT, CHOICE = "text", "choice"
#: What a plan may say: key -> (kind, whether needed, allowed values).
RUN_KEYS = {
    "input_root": (TEXT, True, ()),
    "output_root": (TEXT, True, ()),
    "state_root": (TEXT, True, ()),
    "mode": (CHOICE, False, ("daily", "full", "repair")),
    "validation": (CHOICE, False, ("none", "structure", "light", "full")),
    "start": ("day", False, ()),
    "end": ("day", False, ()),
    "compression": (TEXT, False, ()),
    "compression_level": ("whole", False, ()),
}
TASK_KEYS = {"name": (TEXT, False, ()), "group": (TEXT, True, ()), "columns": ("table", False, ())}


def _checked(section: str, given: dict[str, object], schema: dict[str, tuple[str, bool, tuple[str, ...]]]) -> dict[str, object]:
    """A section of a plan against its keys: all faults in one error; days as text."""
    faults = [f"unknown keys in the plan: {section}.{k}" for k in given if k not in schema]
    out: dict[str, object] = {}
    for key, (kind, needed, allowed) in schema.items():
        value = given.get(key)
        if value in (None, ""):
            faults += [f"the plan needs {section}.{key}"] if needed else []
        elif allowed and value not in allowed:
            faults.append(f"{section}.{key} must be {', '.join(allowed)}: {value}")
        else:
            out[key] = date_text(value) if kind == "day" else value
    if faults:
        raise ValueError("; ".join(faults))
    return out


@dataclass(frozen=True)
class TaskGroup:
    """A metric group with the columns it reads per data set, and how its results are checked."""

    name: str
    group: MetricGroup
    columns: dict[str, list[str]]
    reference: verify.DayReference | None = None


@dataclass(frozen=True)
class RunPlan:
    input_root: str
    output_root: str
    state_root: str
    mode: str = "daily"
    validation: str = "structure"
    start: str | None = None
    end: str | None = None
    compression: str = "snappy"
    compression_level: int | None = None
    tasks: tuple[TaskGroup, ...] = field(default=())

    def config(self) -> RunConfig:
        return RunConfig(self.input_root, self.output_root, resume=self.mode == "daily", overwrite_dates=self.mode in {"full", "repair"}, compression=self.compression, compression_level=self.compression_level)


def load_plan(path: str | Path) -> RunPlan:
    """A TOML plan, ``[run]`` and ``[[task]]``. Unknown keys, modes and overlapping folders are errors."""
    raw = tomllib.loads(Path(path).read_text())
    run = _checked("run", raw.pop("run", {}), RUN_KEYS)
    entries = [_checked("task", t, TASK_KEYS) for t in raw.pop("task", [])]
    if raw or not entries:
        raise ValueError(f"unknown keys in the plan: {', '.join(sorted(raw))}" if raw else "the plan has no task")
    if Path(str(run["state_root"])).resolve().is_relative_to(Path(str(run["output_root"])).resolve()):
        raise ValueError("state_root must not lie in output_root")
    plan = RunPlan(**run, tasks=tuple(task for t in entries for task in build_tasks(t)))
    publishes = Counter(m.name for t in plan.tasks for m in t.group.metrics)
    if twice := [n for n, k in publishes.items() if k > 1]:
        raise ValueError(f"two tasks publish the same metric: {', '.join(twice)}")
    return plan


def build_tasks(entry: dict[str, object]) -> list[TaskGroup]:
    """A task's groups: one of the catalogue by name, or ``module:function`` returning TaskGroups."""
    from gridloom.plans.catalogue import GROUPS

    spec = str(entry.get("group", ""))
    if ":" in spec:
        module, function = spec.split(":", 1)
        found = getattr(importlib.import_module(module), function)()
        if not found or not all(isinstance(t, TaskGroup) for t in found):
            raise ValueError(f"{spec} must return TaskGroups")
        return list(found)
    if spec not in GROUPS:
        raise ValueError(f"unknown group {spec!r}")
    group = GROUPS[spec]()
    columns = entry.get("columns") or {}
    return [TaskGroup(str(entry.get("name", spec)), group, {d: list(columns.get(d, ["symbol", "trade_date", "time_ms", "volume"])) for d in group.metrics[0].inputs})]


def representative_days(days: DataFrame) -> DataFrame:
    """Of ``day, n_rows`` the day with most input rows (of equal ones the last), the first and the last, without repeats."""
    picked = days.agg(F.array_distinct(F.array(F.max_by("day", F.struct("n_rows", "day")), F.min("day"), F.max("day"))).alias("d"))
    return picked.select(F.explode("d").alias("day")).where(F.col("day").isNotNull())


def sampled_days(days: DataFrame, most: int = 5) -> DataFrame:
    """Of the column ``day`` up to ``most`` days, evenly spaced over all, ends included.

    The k-th of them is the day whose place is nearest to k steps of (n - 1) / (most - 1), of two the even one.
    """
    one = days.select("day").distinct()
    w = Window.partitionBy(F.lit(1)).orderBy("day")  # a short text for each day
    placed = one.select("day", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n"))
    marks = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("n") - 1) / F.lit(most - 1), 0).cast("int"))
    return placed.where((F.col("n") <= most) | F.array_contains(marks, F.col("i"))).select("day")


@dataclass
class RunReport:
    """What a run did."""

    task: str
    status: str
    days: list[str]
    seconds: float = 0.0
    input_rows: int = 0
    problems: dict[str, dict[str, int]] = field(default_factory=dict)


def run_group(spark: SparkSession, plan: RunPlan, task: TaskGroup, days: Sequence[str] | None = None) -> RunReport:
    """Computes and publishes one group's pending days, all in one plan; checks sources before and after.

    Pending days are kept per metric: a metric published earlier is not computed again. Publication is per metric, not atomic
    across the group.
    """
    began = time.time()
    config = plan.config()
    inputs = list(task.group.metrics[0].inputs)
    requested = sorted(map(date_text, days)) if days is not None else matching_dates(plan.input_root, inputs, plan.start, plan.end)
    pending = {m.name: published.pending_dates(requested, published.published_dates(plan.output_root, m.name), config) for m in task.group.metrics}
    todo = sorted(set().union(*pending.values()))
    if not todo:
        # a repeated run does nothing but look again at what is published
        found = revalidate(spark, plan, task, requested) if plan.mode == "daily" else {}
        return RunReport(task.name, "failed" if any(found.values()) else "no_work", [], time.time() - began, problems=found)
    paths = [str(input_path(plan.input_root, d, day)) for d in inputs for day in todo]
    missing = [p for p in paths if not os.path.exists(p)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    policy = next((m.price_policy for m in task.group.metrics if m.price_policy), None)
    before = published.source_identity(paths)
    frames = {d: dayfiles.read_days(spark, plan.input_root, d, todo, task.columns[d], policy) for d in inputs}
    # written, not cached: what is published is what was there when the sources were checked, even if executors are lost
    staging = f"{plan.state_root}/staging/{uuid.uuid4().hex}"
    try:
        labelled(compute(frames, task.group)).write.parquet(staging)
        dense = spark.read.parquet(staging)
        if published.source_identity(paths) != before:
            raise RuntimeError("a source changed during the run; nothing is published")
        for m in task.group.metrics:
            mine = [dt.datetime.strptime(d, "%Y%m%d").date() for d in pending[m.name]]
            if mine:
                published.write_days(dense.where(F.col("trade_date").isin(mine)), plan.output_root, m.name, config)
    finally:
        shutil.rmtree(staging, ignore_errors=True)
    rows = {d: sum(dayfiles.row_count([str(input_path(plan.input_root, x, d))]) for x in inputs) for d in todo}
    problems = validate(spark, plan, task, frames, todo, rows)
    skipped = sorted(set(requested) - set(todo))
    if skipped and plan.mode == "daily":
        for name, found in revalidate(spark, plan, task, skipped).items():
            problems[name] = {**problems.get(name, {}), **found}
    status = "failed" if any(problems.values()) else "ok"
    report = RunReport(task.name, status, todo, time.time() - began, sum(rows.values()), problems)
    for m in task.group.metrics:
        published.write_manifest(plan.state_root, f"{m.name}_manifest", {"metric": m.name, "status": status, "days": pending[m.name], "sources": before, "months": sorted({d[:6] for d in pending[m.name]})})
    return report


def revalidate(spark: SparkSession, plan: RunPlan, task: TaskGroup, days: Sequence[str]) -> dict[str, dict[str, int]]:
    """Structure of days that an earlier run published, ``skipped_incomplete_days`` per metric; sources are not read."""
    if plan.validation == "none" or not days:
        return {}
    dates = [dt.datetime.strptime(d, "%Y%m%d").date() for d in days]
    out = {}
    for m in task.group.metrics:
        bad = verify.structure(published.read_metric(spark, plan.output_root, m.name).where(F.col("trade_date").isin(dates))).where(~F.col("complete")).count()
        out[m.name] = {"skipped_incomplete_days": bad} if bad else {}
    return out


def validate(spark: SparkSession, plan: RunPlan, task: TaskGroup, frames: dict[str, DataFrame], days: Sequence[str], rows: dict[str, int]) -> dict[str, dict[str, int]]:
    """Structure of every published day; with a reference also values - of representative days (light) or all (full)."""
    if plan.validation == "none":
        return {}
    out: dict[str, dict[str, int]] = {}
    chosen = list(days)
    if plan.validation == "light":
        chosen = [r.day for r in representative_days(spark.createDataFrame(list(rows.items()), "day string, n_rows bigint")).collect()]
    dates = [dt.datetime.strptime(d, "%Y%m%d").date() for d in chosen]
    for m in task.group.metrics:
        df = published.read_metric(spark, plan.output_root, m.name)
        of_run = df.where(F.col("trade_date").isin([dt.datetime.strptime(d, "%Y%m%d").date() for d in days]))
        bad = verify.structure(of_run).where(~F.col("complete")).count()
        found = {"incomplete_days": bad} if bad else {}
        if plan.validation in {"light", "full"}:
            if task.reference is None:
                raise ValueError(f"{task.name}: {plan.validation} validation needs a reference")
            expected = task.reference.function(frames).where(F.col("trade_date").isin(dates)).select(*verify.KEYS, m.name)
            found |= {r.problem: r.n for r in verify.compare_summary(expected, df.where(F.col("trade_date").isin(dates)), m.name, task.reference.rtol, task.reference.atol).collect()}
        out[m.name] = found
    return out


class Lock:
    """A lock file, never stolen."""

    def __init__(self, path: str | Path) -> None:
        self.path = Path(path)

    def take(self) -> Lock:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.handle = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        os.write(self.handle, str(os.getpid()).encode())
        return self

    def __enter__(self) -> Lock:
        return self

    def __exit__(self, *_: object) -> None:
        os.close(self.handle)
        self.path.unlink(missing_ok=True)


def run_plan(spark: SparkSession, plan: RunPlan, execute: bool = False, check_ready: Callable[[list[str]], str | None] | None = None, validate_output: Callable[[list[str]], str | None] | None = None) -> tuple[int, list[RunReport]]:
    """A dry run by default. A failed task does not stop the others; a file ``STOP`` in state_root does. Hooks get copies of the days."""
    reports: list[RunReport] = []
    if not execute:
        for task in plan.tasks:
            inputs = list(task.group.metrics[0].inputs)
            days = matching_dates(plan.input_root, inputs, plan.start, plan.end)
            config = plan.config()
            todo = sorted({d for m in task.group.metrics for d in published.pending_dates(days, published.published_dates(plan.output_root, m.name), config)})
            reports.append(RunReport(task.name, "planned" if todo else "no_work", todo))
        return OK, reports
    try:
        lock = Lock(Path(plan.state_root) / "run.lock").take()
    except FileExistsError:
        return LOCKED, reports
    try:
        with lock:
            for task in plan.tasks:
                if (Path(plan.state_root) / "STOP").exists():
                    reports.append(RunReport(task.name, "stopped", []))
                    continue
                try:
                    days = matching_dates(plan.input_root, list(task.group.metrics[0].inputs), plan.start, plan.end)
                except FileNotFoundError as e:
                    reports.append(RunReport(task.name, f"failed: {e}"[:500], []))
                    continue
                if check_ready and (reason := check_ready(list(days))) is not None:
                    reports.append(RunReport(task.name, f"not_ready: {reason}", []))
                    return NOT_READY, reports
                try:
                    reports.append(run_group(spark, plan, task))
                except Exception as e:  # noqa: BLE001 - one task's failure is reported, the others run
                    reports.append(RunReport(task.name, f"failed: {e}"[:500], []))
                    continue
                if validate_output and (reason := validate_output(list(days))) is not None:
                    reports[-1].status = f"failed: {reason}"
    finally:
        shutil.rmtree(Path(plan.state_root) / "staging", ignore_errors=True)  # what a broken run left
    published.write_manifest(plan.state_root, f"run_report_{uuid.uuid4().hex[:8]}", {"tasks": [vars(r) for r in reports]})
    return (FAILED if any(r.status.startswith("failed") for r in reports) else OK), reports


def bench_day(spark: SparkSession, plan: RunPlan, task: TaskGroup, day: str) -> dict[str, object]:
    """One real day in its own folder: seconds, rows and rows per second."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        own = RunPlan(plan.input_root, f"{folder}/out", f"{folder}/state", "full", "structure", day, day, tasks=(task,))
        report = run_group(spark, own, task)
    return {"task": task.name, "day": day, "rows": report.input_rows, "elapsed_seconds": round(report.seconds, 3), "rows_per_second": round(report.input_rows / max(report.seconds, 1e-9))}


def main(argv: Sequence[str] | None = None) -> int:
    """``python -m gridloom run PLAN [--execute]`` and ``python -m gridloom bench PLAN DAY``."""
    args = list(sys.argv[1:] if argv is None else argv)
    try:
        command, path, *rest = args
        if command not in {"run", "bench"} or (command == "run" and set(rest) - {"--execute"}) or (command == "bench" and len(rest) != 1):
            raise ValueError("usage: run PLAN [--execute] | bench PLAN DAY")
        plan = load_plan(path)
    except (ValueError, OSError) as e:
        print(json.dumps({"error": str(e)}), file=sys.stderr)
        return BAD_ARGUMENTS
    from gridloom.session import local_session

    spark = SparkSession.getActiveSession() or local_session()
    if command == "bench":
        for task in plan.tasks:
            print(json.dumps(bench_day(spark, plan, task, date_text(rest[0]))))
        return OK
    code, reports = run_plan(spark, plan, "--execute" in rest)
    for r in reports:
        print(json.dumps(vars(r)))
    return code
