"""Several tables made visible at once: a chain of stages with one commit, and a partial result when a stage fails.

Stages write apart, under names that nobody reads.  One rename of a manifest then shows the
tables of all stages that completed, the status, the failed stage and its issues.  A later
run takes over what the last manifest shows and goes on with the first stage that isn't
there.  Readers see the last manifest, and with it a state that some run left as a whole.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillage.workspace import files

COMPLETE, PARTIAL_FAILED = "COMPLETE", "PARTIAL_FAILED"
ISSUES = "severity string, code string, about string"

#: Gets the tables of the stages before, by name; gives a table, or a table and issues (severity, code, about).
Run = Callable[[dict[str, DataFrame]], DataFrame | tuple[DataFrame, DataFrame]]


@dataclass
class Bundle:
    """What the last manifest shows."""

    status: str | None = None
    failed: str | None = None
    version: int = 0
    stages: dict[str, dict] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)
    issues: DataFrame | None = None


def _manifests(spark: SparkSession, folder: str) -> list[str]:
    fs, _ = files(spark, folder)
    found = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest-*.json")) or []
    return sorted(s.getPath().toString() for s in found)


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))


def open_bundle(spark: SparkSession, folder: str) -> Bundle:
    """The tables, issues and state of a bundle; empty if no run has ended yet."""
    known = _manifests(spark, folder)
    if not known:
        return Bundle(issues=spark.createDataFrame([], f"stage string, {ISSUES}"))
    state = _read(spark, known[-1])
    tables = {name: spark.read.schema(s["schema"]).parquet(f"{folder}/{s['path']}") for name, s in state["stages"].items()}
    issues = spark.createDataFrame([], f"stage string, {ISSUES}")
    for name, path in state["issues"].items():
        issues = issues.unionByName(spark.read.schema(ISSUES).parquet(f"{folder}/{path}").select(F.lit(name).alias("stage"), "*"))
    return Bundle(state["status"], state["failed"], state["version"], state["stages"], tables, issues)


def _commit(spark: SparkSession, folder: str, state: dict) -> None:
    """Show ``state``: a name that a run before has not taken, by one rename."""
    fs, _ = files(spark, folder)
    hidden, final = (files(spark, f"{folder}/{n}")[1] for n in (f".manifest-{uuid.uuid4().hex}", f"manifest-{state['version']:06d}.json"))
    out = fs.create(hidden, False)
    out.write(bytearray(json.dumps(state, indent=1).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(hidden, final):
        fs.delete(hidden, False)
        raise RuntimeError(f"{folder}: another run has committed version {state['version']}")


def run_stages(spark: SparkSession, folder: str, stages: dict[str, Run]) -> Bundle:
    """Run the stages that the bundle lacks, in order, and show the outcome.

    A stage fails by an issue of severity FAIL or by an exception, which becomes one.
    Its table and those of later stages are not shown, the issues of all stages are.
    Tables of stages that are no longer asked for go out of sight.  A stage that the
    bundle shows is not run again, unless one before it is.
    """
    before = open_bundle(spark, folder)
    fs, _ = files(spark, folder)
    run, shown, issues, tables = uuid.uuid4().hex, {}, {}, {}
    kept, failed = before.status is not None, None
    state = _read(spark, _manifests(spark, folder)[-1]) if kept else {"issues": {}}
    for name, make in stages.items():
        if kept and name in before.stages:
            shown[name], tables[name] = before.stages[name], before.tables[name]
            issues |= {name: state["issues"][name]} if name in state["issues"] else {}
            continue
        kept, path, found = False, f"data/{run}/{name}", None
        try:
            made = make(dict(tables))
            table, found = made if isinstance(made, tuple) else (made, None)
            table.write.parquet(f"{folder}/{path}")
        except Exception as error:  # noqa: BLE001 - what a stage raises is its outcome
            found, failed = spark.createDataFrame([("FAIL", type(error).__name__, str(error)[:2000])], ISSUES), name
        if found is not None:
            found.select(*(F.col(c).cast("string").alias(c) for c in ("severity", "code", "about"))).write.parquet(f"{folder}/{path}.issues")
            issues[name] = f"{path}.issues"
            if not spark.read.schema(ISSUES).parquet(f"{folder}/{path}.issues").filter("severity = 'FAIL'").isEmpty():
                failed = name
        if failed:
            fs.delete(files(spark, f"{folder}/{path}")[1], True)
            break
        written = spark.read.parquet(f"{folder}/{path}")
        shown[name], tables[name] = {"path": path, "rows": written.count(), "schema": written._jdf.schema().toDDL()}, written
    _commit(spark, folder, {"version": before.version + 1, "status": PARTIAL_FAILED if failed else COMPLETE, "failed": failed, "stages": shown, "issues": issues})
    return open_bundle(spark, folder)
