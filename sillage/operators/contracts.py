"""Contracts of tables: exact columns, a unique key and no nulls, checked in the pass that writes or reads the table anyway."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

ISSUES = "code string, severity string, about string, rows long, first string, last string"


@dataclass(frozen=True)
class Rule:
    """A row breaks the rule where ``broken`` is true (null is not)."""

    code: str
    about: str
    broken: Column
    severity: str = "FAIL"


@dataclass
class Contract:
    """What is promised of a table; ``check`` goes along with the table's next action, ``issues`` after it."""

    columns: list[str]
    key: list[str]
    filled: list[str]
    rules: tuple[Rule, ...] = ()

    def _missing(self, df: DataFrame) -> list[tuple[str, str]]:
        """Codes and columns that the schema alone shows."""
        lost = [("MISSING_COLUMN", c) for c in self.columns if c not in df.columns]
        more = [("UNEXPECTED_COLUMN", c) for c in df.columns if c not in self.columns]
        order = [("COLUMN_ORDER", ",".join(df.columns))] if not lost and not more and df.columns != self.columns else []
        return lost + more + order

    def check(self, df: DataFrame) -> tuple[DataFrame, Checked]:
        """``df`` with its rows unchanged, and what its next action will have seen.

        One pass, no second scan: rules are counted by an observation, and repeats of
        the key by a window, which deals the rows by their key (a row whose key holds a
        null by itself, so that null keys don't meet in one task; they are no repeats).
        """
        key = [F.col(f"`{c}`") for c in self.key if c in df.columns]
        rules = [Rule("NULL_VALUE", c, F.col(f"`{c}`").isNull()) for c in self.filled if c in df.columns]
        rules += [r for r in self.rules]
        work = df
        if len(key) == len(self.key) and key:
            unnamed = F.greatest(*(k.isNull() for k in key)) if len(key) > 1 else key[0].isNull()
            alone = F.when(unnamed, F.monotonically_increasing_id())
            work = df.withColumn("_alone", alone)
            work = work.withColumn("_times", F.when(~unnamed, F.count(F.lit(1)).over(_window(key)))).drop("_alone")
            rules.append(Rule("REPEATED_KEY", ",".join(self.key), F.col("_times") > 1))
        named = F.concat_ws("|", *(F.coalesce(k.cast("string"), F.lit("")) for k in key)) if key else F.lit("")
        seen, metrics = Observation(), [F.count(F.lit(1)).alias("rows")]
        for i, rule in enumerate(rules):
            hit = F.coalesce(rule.broken, F.lit(False))
            metrics += [F.count_if(hit).alias(f"n{i}"), F.min(F.when(hit, named)).alias(f"first{i}"), F.max(F.when(hit, named)).alias(f"last{i}")]
        return work.observe(seen, *metrics).select(*(F.col(f"`{c}`") for c in df.columns)), Checked(df.sparkSession, seen, rules, self._missing(df))


def _window(key: list[Column]):
    from pyspark.sql import Window

    return Window.partitionBy(*key, F.col("_alone"))


@dataclass
class Checked:
    spark: object
    seen: Observation
    rules: list[Rule]
    schema: list[tuple[str, str]]

    def issues(self) -> DataFrame:
        """A row for each broken promise: code, severity, about, how many rows, and the first and last key; waits for the action."""
        found = self.seen.get
        rows = [(code, "FAIL", about, None, None, None) for code, about in self.schema]
        rows += [(r.code, r.severity, r.about, found[f"n{i}"], found[f"first{i}"], found[f"last{i}"]) for i, r in enumerate(self.rules) if found[f"n{i}"]]
        return self.spark.createDataFrame(rows, ISSUES)

    @property
    def rows(self) -> int:
        return self.seen.get["rows"]
