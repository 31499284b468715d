"""A stateful stream operator: the state machine of an alert rule over a stream of rows, one state for each group."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.columns import COMPARE
from ..operators.alerts import Group, Rule, State

NOTICES = "group string, kind string, since long, at long"
_KEPT = "kept string"
#: A state belongs to one group, whose name may be null; inside it is this.
OWN = "own"


def notices(stream: DataFrame, rule: Rule, group: str, time: str, lateness: str) -> DataFrame:
    """stream (group, time as a timestamp) -> firing and resolved notices of each group.

    A window is decided once the watermark has passed its end, so rows within `lateness` count; later ones are dropped by
    the watermark, as the stream can't tell what it has already said. A group's state is a count for each open window
    (window / every + lateness / every of them), and its phase; it goes when the group is quiet. Times are whole seconds.
    """
    rows = stream.withWatermark(time, lateness).select(F.col(group).cast("string").alias("g"), F.unix_seconds(time).alias("t"), F.col(time).alias("event_time"))

    def step(key, batches, state):
        kept = json.loads(state.get[0]) if state.exists else {"n": {}, "next": None, "groups": {}}
        n = {int(k): v for k, v in kept["n"].items()}
        if not state.hasTimedOut:
            for df in batches:
                for t in df["t"].tolist():
                    first = t - t % rule.every + rule.every
                    for end in range(first, t + rule.window + 1, rule.every):
                        n[end] = n.get(end, 0) + 1
        passed = state.getCurrentWatermarkMs() // 1000
        machine = State(kept["next"], {g: Group(**x) for g, x in kept["groups"].items()})
        out = []
        while n or machine.groups:
            end = machine.next_end if machine.groups else min(n)
            if end > passed:
                break
            count = n.pop(end, 0)
            holds = count > 0 and getattr(float(count), COMPARE[rule.op])(float(rule.threshold))
            machine, said = State(end, machine.groups).advance({OWN} if holds else set(), rule)
            out += [(key[0], kind, since, end) for kind, _, since in said]
        if n or machine.groups:
            groups = {g: {"phase": x.phase, "since": x.since} for g, x in machine.groups.items()}
            state.update((json.dumps({"n": n, "next": machine.next_end, "groups": groups}),))
            due = machine.next_end if machine.groups else min(n)
            state.setTimeoutTimestamp(max(due * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["group", "kind", "since", "at"])

    return rows.groupBy("g").applyInPandasWithState(step, NOTICES, _KEPT, "append", GroupStateTimeout.EventTimeTimeout)


PROGRESS = "lane string, version long, position long, watermark long, complete long, open long"


def lane_progress(stream: DataFrame, lane: list[str]) -> DataFrame:
    """stream (lane.., seq, passed, low, received) of slots, in any order and as often as it likes -> how far each lane has come.

    A row for each lane and batch in which it has news: position, the last slot of an unbroken run of passed ones from 0 on;
    watermark, as operators.control.lane_watermarks() has it of all slots seen so far; complete, the highest watermark so far,
    which never falls; open, the slots seen that aren't passed; version grows with a lane's rows. A slot that was passed stays
    so, whatever comes later. A lane's state is what is open, what was passed beyond a gap, and three numbers. Names of lanes
    are joined by "/" in the result.
    """
    rows = stream.select(F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in lane)).alias("lane"), "seq", "passed", *(F.col(c).cast("string").alias(c) for c in ("low", "received")))  # as text, since pandas has no whole numbers with nulls

    def step(key, batches, state):
        kept = json.loads(state.get[0]) if state.exists else {"position": -1, "beyond": [], "open": {}, "low": None, "complete": None, "version": 0}
        beyond, waiting = set(kept["beyond"]), {int(k): v for k, v in kept["open"].items()}
        position, high = kept["position"], kept["low"]
        for df in batches:
            for seq, passed, low, received in zip(df["seq"].tolist(), df["passed"].tolist(), df["low"].tolist(), df["received"].tolist()):
                low, received = (None if x is None else int(x) for x in (low, received))
                if passed:
                    waiting.pop(seq, None)
                    if low is not None:
                        high = low if high is None else max(high, low)
                    if seq > position:
                        beyond.add(seq)
                elif seq > position and seq not in beyond:
                    old = waiting.get(seq, received)
                    # of two receive times of a slot the earlier counts, and an unknown one before both
                    waiting[seq] = None if old is None or received is None else min(old, received)
        while position + 1 in beyond:
            position += 1
            beyond.discard(position)
        first = min((x for x in waiting.values() if x is not None), default=None)
        mark = None if high is None or None in waiting.values() else high if first is None else min(high, first)
        complete = kept["complete"] if mark is None else mark if kept["complete"] is None else max(mark, kept["complete"])
        version = kept["version"] + 1
        state.update((json.dumps({"position": position, "beyond": sorted(beyond), "open": waiting, "low": high, "complete": complete, "version": version}),))
        yield pd.DataFrame([(key[0], version, position, mark, complete, len(waiting))], columns=["lane", "version", "position", "watermark", "complete", "open"]).astype({"watermark": "Int64", "complete": "Int64"})

    return rows.groupBy("lane").applyInPandasWithState(step, PROGRESS, _KEPT, "append", GroupStateTimeout.NoTimeout)
