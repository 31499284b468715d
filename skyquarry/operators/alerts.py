"""Alerts: windows of a rule, episodes of each group, and another look when rows come late."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import COMPARE, compare


@dataclass(frozen=True)
class Rule:
    """A window ends at each multiple of `every`; value `op` threshold holds; fires after `hold` of holding."""

    name: str
    window: int
    every: int
    op: str
    threshold: float
    hold: int = 0
    on_no_rows: str = "ok"
    late: str = "ignore"
    service_late: int = 0
    rule_late: int = 0

    def __post_init__(self):
        if self.op not in COMPARE:
            raise ValueError(f"unknown comparison {self.op!r}")
        if self.window <= 0 or self.every <= 0 or self.every > self.window or self.hold < 0:
            raise ValueError("0 < every <= window and hold >= 0")
        if self.on_no_rows not in ("ok", "fire") or self.late not in ("ignore", "reevaluate", "page"):
            raise ValueError("on_no_rows is ok or fire, late is ignore, reevaluate or page")


def rules_from_json(text: str) -> list[Rule]:
    return [Rule(**r) for r in json.loads(text)]


def hopping(rows: DataFrame, time: str, window: int, every: int) -> DataFrame:
    """A row for each window [end - window, end) that holds its time; ends are multiples of `every`."""
    first = F.col(time) - F.pmod(F.col(time), F.lit(every)) + every
    last = F.col(time) + window - F.pmod(F.col(time) + window, F.lit(every))
    return rows.withColumn("end", F.explode(F.sequence(first, F.greatest(last, first), F.lit(every)))) if window != every else rows.withColumn("end", first)


def evaluate(rows: DataFrame, rule: Rule, time: str, by: list[str], value: Column | None = None) -> DataFrame:
    """(by.., end, value) where the condition holds."""
    w = hopping(rows, time, rule.window, rule.every).groupBy(*by, "end").agg((F.count("*") if value is None else value).cast("double").alias("value"))
    return w.filter(compare(F.col("value"), rule.op, rule.threshold))


def absent(rows: DataFrame, rule: Rule, time: str, lo: int, hi: int) -> DataFrame:
    """Ends in (lo, hi] of windows without a row."""
    spark = rows.sparkSession
    ends = spark.range(lo - lo % rule.every + rule.every, hi + 1, rule.every).select(F.col("id").alias("end"))
    return ends.join(hopping(rows, time, rule.window, rule.every).select("end").distinct(), "end", "left_anti")


def episodes(holds: DataFrame, rule: Rule, by: list[str]) -> DataFrame:
    """Runs of windows in a row that hold: since, until, and when each fired (null if it didn't last for `hold`)."""
    w = Window.partitionBy(*by).orderBy("end") if by else Window.partitionBy(F.lit(0)).orderBy("end")
    rows = holds.withColumn("run_", F.col("end") - rule.every * F.row_number().over(w))
    runs = rows.groupBy(*by, "run_").agg(F.min("end").alias("since"), F.max("end").alias("until"), F.count("*").alias("windows")).drop("run_")
    # the first end at which end - since >= hold
    steps = -(-rule.hold // rule.every) * rule.every
    return runs.withColumn("fired_at", F.when(F.col("until") - F.col("since") >= rule.hold, F.col("since") + steps))


def verdict(complete: bool, partial: bool, watermark_ok: bool, same_window: bool, c: int, hi: int, rule: Rule) -> str:
    """Only a complete answer moves a rule on."""
    if not (complete and watermark_ok and same_window) or partial or c < hi + rule.service_late:
        return "unknown"
    return "complete" if c >= hi + rule.service_late + rule.rule_late else "partial"


def late_changes(old: DataFrame, new: DataFrame, rule: Rule, by: list[str]) -> DataFrame:
    """Windows that hold only now that late rows are here, with the episodes they belong to.

    Whole windows are evaluated again; holds that are gone change nothing.
    """
    fresh = new.join(old.select(*by, "end"), [*by, "end"], "left_anti")
    runs = episodes(new, rule, by)
    # a run's name is its last window less its length; each window of the new answer knows its run
    w = Window.partitionBy(*by).orderBy("end") if by else Window.partitionBy(F.lit(0)).orderBy("end")
    run = new.select(*by, "end").withColumn("run_", F.col("end") - rule.every * F.row_number().over(w))
    since = F.min("end").over(Window.partitionBy(*by, "run_"))
    touched = run.withColumn("since", since).join(fresh.select(*by, "end"), [*by, "end"], "left_semi").join(runs, [*by, "since"])
    return touched.groupBy(*by, "since", "until", "fired_at").agg(F.count("*").alias("added"))


@dataclass(frozen=True)
class Group:
    phase: str
    since: int


@dataclass(frozen=True)
class State:
    """A rule's groups between windows. advance() is given the groups that hold in one complete window."""

    next_end: int
    groups: dict = field(default_factory=dict)

    def due(self, now: int, rule: Rule, most: int) -> State:
        """Skip ahead if more than `most` windows wait."""
        waiting = (now - self.next_end) // rule.every + 1
        return replace(self, next_end=self.next_end + (waiting - most) * rule.every) if waiting > most else self

    def advance(self, holding: set[str], rule: Rule) -> tuple[State, list[tuple[str, str, int]]]:
        """(next state, notices (kind, group, since)). A group fires once held for rule.hold, resolves when it doesn't hold."""
        end, groups, notices = self.next_end, {}, []
        for g, x in sorted(self.groups.items()):
            if g not in holding and x.phase == "firing":
                notices.append(("resolved", g, x.since))
        for g in sorted(holding):
            x = self.groups.get(g, Group("pending", end))
            if x.phase == "pending" and end - x.since >= rule.hold:
                x = Group("firing", x.since)
                notices.append(("firing", g, x.since))
            groups[g] = x
        return State(end + rule.every, groups), notices


def notice_key(rule: str, group: str, since: int, kind: str) -> str:
    return f"{rule}/{group}/{since}/{kind}"


def template(text: str, value: float, labels: dict[str, str]) -> str:
    """{{value}} and {{labels.X}}; an unknown label is empty."""
    return re.sub(r"\{\{\s*(value|labels\.([\w.]+))\s*\}\}", lambda m: f"{value:g}" if m[1] == "value" else labels.get(m[2], ""), text)
