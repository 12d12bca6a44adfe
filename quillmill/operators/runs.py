"""Run logs: newest state per run, bounded logs, the latest per automation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmill.functions.text import filled

# fixed values: how many runs are kept, and the states of a run
KEEP = 30
ACTIVE = ("planning", "collecting", "generating", "writing")
TERMINAL = ("completed", "failed", "blocked")


def is_active(status: Column) -> Column:
    return status.isin(*ACTIVE)


def newest(log: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The last entry of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order]))
    return log.withColumn("__n", n).where("__n = 1").drop("__n")


def keep_newest(log: DataFrame, key: str, time: str, keep: int = KEEP) -> DataFrame:
    """The last entry of each key, newest first, at most `keep`."""
    return newest(log, key, time).orderBy(F.desc(time), key).limit(keep)


def latest_per(log: DataFrame, by: str, time: str, tie: str) -> DataFrame:
    return newest(log, by, time, tie)


def first_active(log: DataFrame, by: str, time: str) -> DataFrame:
    return newest(log.where(is_active(F.col("status"))), by, time)


def availability(definitions: DataFrame, has_token: Column, destination: Column, mapped: Column, content_table: Column, tasks_table: Column, courses: Column) -> DataFrame:
    """definitions: (enabled, input_sources, target_scope, ...). Adds state and label: the first reason why an automation
    cannot run, else ready."""
    needs = lambda *v: F.col("input_sources").isin(*v)
    label = (
        F.when(~F.coalesce("enabled", F.lit(False)), "Disabled").when(~has_token, "Token needed").when(~filled(destination), "Destination needed").when(filled(mapped) & (mapped != destination), "Sync needed")
        .when(needs("content", "both") & ~filled(content_table), "Content DB missing").when(needs("tasks", "both") & ~filled(tasks_table), "Deliverables DB missing").when((F.col("target_scope") == "course") & (courses == 0), "Course needed").otherwise("Ready")
    )
    return definitions.withColumn("label", label).withColumn("state", F.when(F.col("label") == "Ready", "ready").otherwise("blocked"))


def run(definition: dict, run_id: str, collect: Callable[[], DataFrame], generate: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], int], log: Callable[[dict], None]) -> dict:
    """One run: collecting, generating, writing; every change of state goes to the log. A run of a disabled definition is
    blocked; an error ends it as failed."""
    state = {"run_id": run_id, "automation_id": definition["automation_id"], "status": "planning", "written": 0, "message": ""}
    log(dict(state))
    if not definition.get("enabled", True):
        state |= {"status": "blocked", "message": "The automation is disabled."}
        log(dict(state))
        return state
    try:
        for status, step in (("collecting", collect), ("generating", generate), ("writing", write)):
            state["status"] = status
            log(dict(state))
            result = step() if status == "collecting" else step(result)  # noqa: F821
        state |= {"status": "completed", "written": result}
    except Exception as e:
        state |= {"status": "failed", "message": str(e).splitlines()[0] if str(e) else type(e).__name__}
    log(dict(state))
    return state
