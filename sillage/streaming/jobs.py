"""Jobs as events: the state that a job's events lead to, and its progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a job and which action leads from where to where.
TRANSITIONS = [
    ("created", "run", "running"),
    ("running", "wait", "waiting_review"),
    ("waiting_review", "run", "running"),
    ("running", "complete", "complete"),
    ("created", "fail", "failed"),
    ("running", "fail", "failed"),
    ("waiting_review", "fail", "failed"),
    ("failed", "run", "running"),
]


def after(state: Column, action: Column) -> Column:
    """The state after an action; an action that does not fit changes nothing."""
    out = state
    for start, name, end in TRANSITIONS:
        out = F.when((state == start) & (action == name), end).otherwise(out)
    return out


def final_states(events: DataFrame, job: str, order: list[str], action: str = "action") -> DataFrame:
    """(job, state, steps): each job's state after its events in order, and how many of them changed it."""
    listed = F.array_sort(F.collect_list(F.struct(*order, F.col(action).alias("_a"))))
    rows = events.groupBy(job).agg(F.transform(listed, lambda x: x["_a"]).alias("_actions"))

    def step(s: Column, a: Column) -> Column:
        new = after(s["state"], a)
        return F.struct(new.alias("state"), (s["steps"] + F.when(new != s["state"], 1).otherwise(0)).alias("steps"))

    folded = F.aggregate("_actions", F.struct(F.lit("created").alias("state"), F.lit(0).alias("steps")), step)
    return rows.select(job, folded.alias("f")).select(job, "f.state", "f.steps")


def progress(stages: DataFrame, job: str, stage: str = "stage", status: str = "status") -> DataFrame:
    """(job, done, total, percent, current): finished stages of each job and the first one that is not."""
    done = F.count_if(F.col(status) == "complete")
    out = stages.groupBy(job).agg(done.alias("done"), F.count("*").alias("total"), F.min(F.when(F.col(status) != "complete", F.col(stage))).alias("current"))
    return out.withColumn("percent", F.floor(F.col("done") * 100 / F.col("total")).cast("int"))
