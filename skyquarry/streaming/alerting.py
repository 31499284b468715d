"""Running alert rules: due windows in order, each decided once, with state that survives a restart."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import SparkSession

from ..operators.alerts import Group, Rule, State, notice_key, verdict


@dataclass
class Evaluation:
    """What a query said about a window: the groups that hold with their values, and how complete it was."""

    holding: dict[str, float]
    complete: bool
    c: int
    partial: bool = False
    watermark_ok: bool = True
    window: tuple[int, int] | None = None


class Conflict(RuntimeError):
    """Another runner has written the state meanwhile."""


class Store:
    """States in a folder that all see, a file for each version. Creating a version that exists fails: of two runners one wins.

    Needs a file system whose rename is atomic."""

    def __init__(self, spark: SparkSession, path: str):
        self.fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.fs_path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self.path, self.jvm = path, spark._jvm
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        self.no_overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        self.fs.mkdirs(self.fs_path(path))

    def _versions(self, rule: str) -> list[int]:
        prefix = f"{rule}."
        names = [x.getPath().getName() for x in self.fs.listStatus(self.fs_path(self.path))]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def load(self, rule: str) -> tuple[int, dict | None]:
        versions = self._versions(rule)
        if not versions:
            return 0, None
        stream = self.fs.open(self.fs_path(f"{self.path}/{rule}.{versions[-1]}"))
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return versions[-1], json.loads(text)

    def save(self, rule: str, version: int, value: dict) -> None:
        """Written aside and renamed, so that a version is there whole or not at all."""
        target, aside = self.fs_path(f"{self.path}/{rule}.{version}"), self.fs_path(f"{self.path}/.{rule}.{version}.{uuid.uuid4().hex}")
        stream = self.fs.create(aside, False)
        stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        stream.close()
        try:
            self.files.rename(aside, target, self.no_overwrite)
        except Exception as e:
            self.fs.delete(aside, False)
            raise Conflict(str(e).splitlines()[0]) from None
        for old in self._versions(rule):
            if old < version - 3:
                self.fs.delete(self.fs_path(f"{self.path}/{rule}.{old}"), False)


@dataclass
class Notice:
    """A notice in the ledger: it stays until the receiver has it, and is tried again with the same key, later each time."""

    kind: str
    group: str
    since: int
    attempts: int = 0
    next: int = 0


@dataclass
class Ledger:
    """Notices by key. base and most: seconds to wait after a first failure, doubled at each further one, and at most."""

    notices: dict[str, Notice] = field(default_factory=dict)
    base: int = 2
    most: int = 120

    def add(self, rule: str, new: list[tuple[str, str, int]]) -> None:
        for kind, group, since in new:
            self.notices.setdefault(notice_key(rule, group, since, kind), Notice(kind, group, since))

    def due(self, now: int) -> list[str]:
        """Keys to send now. A resolution waits until the receiver has its firing."""
        waiting = {(n.group, n.since) for n in self.notices.values() if n.kind == "firing"}
        ready = [k for k, n in self.notices.items() if n.next <= now and not (n.kind == "resolved" and (n.group, n.since) in waiting)]
        return sorted(ready, key=lambda k: (self.notices[k].since, self.notices[k].kind == "resolved", k))

    def told(self, key: str, ok: bool, now: int) -> None:
        """Only a definite answer takes a notice out."""
        if ok:
            self.notices.pop(key, None)
        elif n := self.notices.get(key):
            n.attempts += 1
            n.next = now + min(self.base << min(n.attempts - 1, 16), self.most)


@dataclass
class Runner:
    """evaluate(rule, lo, hi) asks; send(key, kind, group, since) tells, and says False or raises if nobody was told.

    New notices are saved in the ledger together with the state that they follow from, and leave it once sent; so a
    runner that dies in between sends again with the same key, by which a receiver drops what it has.
    late_ends(rule, {end: completeness at which it was decided}) names the windows that have got rows since; without it
    every kept window is asked again.
    """

    store: Store
    evaluate: Callable[[Rule, int, int], Evaluation]
    send: Callable[[str, str, str, int], bool | None]
    late_ends: Callable[[Rule, dict[int, int]], set[int]] | None = None
    backlog: int = 60
    keep: int = 360
    horizon: int = 86_400
    log: list = field(default_factory=list)

    def process(self, rule: Rule, now: int) -> State:
        """Decide the windows that are due and complete; stop at the first that isn't. Then look again at late ones, and
        send what the ledger holds."""
        version, saved = self.store.load(rule.name)
        state = _state(saved) if saved else State(now - now % rule.every)
        seen = {int(k): v for k, v in (saved or {}).get("seen", {}).items()}
        at = {int(k): v for k, v in (saved or {}).get("at", {}).items()}
        fired_late = set((saved or {}).get("late", []))
        ledger = Ledger({k: Notice(**x) for k, x in (saved or {}).get("notices", {}).items()})
        before, notices = state, []
        state = state.due(now, rule, self.backlog)
        while state.next_end <= now:
            end = state.next_end
            x = self.evaluate(rule, end - rule.window, end)
            said = verdict(x.complete, x.partial, x.watermark_ok, x.window in (None, (end - rule.window, end)), x.c, end, rule)
            self.log.append((rule.name, end, said))
            if said != "complete":
                break
            holding = set(x.holding) or ({""} if rule.on_no_rows == "fire" else set())
            state, new = state.advance(holding, rule)
            notices += new
            seen[end], at[end] = sorted(holding), x.c
        seen = {e: v for e, v in sorted(seen.items())[-self.keep :] if e >= now - self.horizon}
        at = {e: at.get(e, 0) for e in seen}
        late, state = self._late(rule, state, seen, at, fired_late) if rule.late != "ignore" and seen else ([], state)
        ledger.add(rule.name, [*notices, *late])

        def save():
            nonlocal version
            version += 1
            value = {"next_end": state.next_end, "groups": {g: asdict(x) for g, x in state.groups.items()}, "seen": seen, "at": at, "late": sorted(fired_late), "notices": {k: asdict(n) for k, n in ledger.notices.items()}}
            self.store.save(rule.name, version, value)

        if state != before or notices or late or not saved:
            save()
        tried = False
        while keys := ledger.due(now):  # a resolution is due once its firing has gone
            key, tried = keys[0], True
            n = ledger.notices[key]
            try:
                ok = self.send(key, n.kind, n.group, n.since) is not False
            except Exception as e:
                ok = False
                self.log.append((rule.name, key, f"not sent: {e}"))
            ledger.told(key, ok, now)
        if tried:
            save()
        return state

    def _late(self, rule: Rule, state: State, seen: dict[int, list[str]], at: dict[int, int], fired: set[str]):
        """Evaluate past windows again as a whole. Holds that are gone change nothing; new ones may move `since` of a live
        group back, or make one late episode of a run that lasted long enough."""
        out, groups, fresh = [], dict(state.groups), {}
        asked = sorted(set(seen) & set(self.late_ends(rule, at))) if self.late_ends else sorted(seen)
        for end in asked:
            x = self.evaluate(rule, end - rule.window, end)
            now_holding, at[end] = set(x.holding), x.c
            for g in sorted(now_holding - set(seen[end])):
                fresh.setdefault(g, []).append(end)
            seen[end] = sorted(now_holding | set(seen[end]))
        if fresh and rule.late == "page":
            out.append(("changed", ",".join(sorted(fresh)), min(min(v) for v in fresh.values())))
        last = state.next_end - rule.every
        for g, ends in fresh.items() if rule.late == "reevaluate" else ():
            for since, until in _runs([e for e in seen if g in seen[e]], rule.every):
                if not any(since <= e <= until for e in ends):
                    continue
                if g in groups and until == last:
                    x = groups[g]
                    x = Group(x.phase, min(x.since, since))
                    if x.phase == "pending" and last - x.since >= rule.hold:
                        x = Group("firing", x.since)
                        out.append(("firing", g, x.since))
                    groups[g] = x
                elif until - since >= rule.hold and not fired & {f"{g}/{e}" for e in range(since, until + 1, rule.every)}:
                    fired |= {f"{g}/{e}" for e in range(since, until + 1, rule.every)}
                    out.append(("late", g, since))
        return out, State(state.next_end, groups)


def _runs(ends: list[int], every: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for e in sorted(ends):
        if out and e == out[-1][1] + every:
            out[-1] = (out[-1][0], e)
        else:
            out.append((e, e))
    return out


def _state(saved: dict) -> State:
    return State(saved["next_end"], {g: Group(**x) for g, x in saved["groups"].items()})
