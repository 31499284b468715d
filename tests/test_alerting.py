"""The runner of alert rules: order, gates, restarts, two runners, late rows."""

import random

import pytest

from skyquarry.operators.alerts import Rule
from skyquarry.streaming.alerting import Conflict, Evaluation, Runner, Store


class World:
    """Rows (time, received) of one group; a window is complete once its end is behind the watermark."""

    def __init__(self, rows, watermark):
        self.rows, self.watermark, self.sent = rows, watermark, []

    def evaluate(self, rule, lo, hi):
        n = sum(lo <= t < hi and r < self.watermark for t, r in self.rows)
        return Evaluation({"g": n} if n > rule.threshold else {}, hi <= self.watermark, self.watermark)

    def send(self, key, kind, group, since):
        self.sent.append((kind, since))


def runner(spark, path, world):
    return Runner(Store(spark, str(path)), world.evaluate, world.send)


RULE = Rule("r", 10, 10, ">", 0, hold=10, late="reevaluate")


def test_only_complete_windows_decide(spark, tmp_path):
    w = World([(t, t) for t in range(100, 140)], 0)
    r = runner(spark, tmp_path / "s", w)
    r.process(RULE, 100)
    assert r.process(RULE, 150).next_end == 100 and w.sent == []
    w.watermark = 121
    assert runner(spark, tmp_path / "s", w).process(RULE, 150).next_end == 130  # after a restart
    assert w.sent == [("firing", 110)]
    w.watermark = 200
    runner(spark, tmp_path / "s", w).process(RULE, 160)
    assert w.sent == [("firing", 110), ("resolved", 110)]


def test_two_runners(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.save("r", 1, {"a": 1})
    with pytest.raises(Conflict):
        store.save("r", 1, {"a": 2})
    assert store.load("r") == (1, {"a": 1})


def test_late_rows_fire_once(spark, tmp_path):
    w = World([(105, 105), (115, 900), (125, 125)], 1)
    r = runner(spark, tmp_path / "s", w)
    r.process(RULE, 100)
    w.watermark = 150
    r.process(RULE, 150)
    assert w.sent == []  # 110 and 130 hold, each alone
    w.watermark = 1000
    r.process(RULE, 155)
    assert w.sent == [("late", 110)]
    r.process(RULE, 158)
    assert w.sent == [("late", 110)]


def test_pages_and_backlog(spark, tmp_path):
    page = Rule("p", 10, 10, ">", 0, late="page")
    w = World([(105, 900)], 1)
    r = runner(spark, tmp_path / "s", w)
    r.process(page, 100)
    w.watermark = 150
    r.process(page, 150)
    w.watermark = 1000
    r.process(page, 150)
    assert [k for k, _ in w.sent] == ["changed"]
    r.backlog = 3
    assert r.process(page, 900).next_end == 910 and len([x for x in r.log if x[1] > 150]) == 3


def test_simulation(spark, tmp_path):
    """Whatever the pace of the watermark, what is sent is what a single look at the end gives."""
    rng = random.Random(3)
    rows = [(t, t) for t in range(100, 400) if rng.random() < 0.08]
    rule = Rule("r", 10, 10, ">", 0, hold=20)
    w = World(rows, 0)
    runner(spark, tmp_path / "a", w).process(rule, 100)
    now = 100
    while now < 500:
        now += rng.randint(1, 30)
        w.watermark = max(w.watermark, now - rng.randint(0, 40))
        runner(spark, tmp_path / "a", w).process(rule, now)
    w.watermark = 10_000
    runner(spark, tmp_path / "a", w).process(rule, 500)
    v = World(rows, 10_000)
    runner(spark, tmp_path / "b", v).process(rule, 100)
    runner(spark, tmp_path / "b", v).process(rule, 500)
    assert w.sent == v.sent and w.sent


def test_ledger():
    """A notice stays until it is acknowledged, is tried again later and later, and a resolution waits for its firing."""
    from skyquarry.streaming.alerting import Ledger

    x = Ledger(base=2, most=16)
    x.add("r", [("firing", "a", 5)])
    (key,) = x.due(1000)
    x.told(key, False, 1000)
    assert x.due(1001) == [] and x.due(1002) == [key]
    x.add("r", [("resolved", "a", 5), ("firing", "a", 5)])
    assert x.due(1002) == [key] and len(x.notices) == 2
    for wait in (4, 8, 16, 16):
        x.told(key, False, 2000)
        assert x.due(2000 + wait - 1) == [] and x.due(2000 + wait) == [key]
    x.told(key, True, 3000)
    (after,) = x.due(3000)
    assert after.endswith("resolved")
    x.told(after, False, 3000)
    assert after in x.notices
    x.told(after, True, 3002)
    assert not x.notices and x.due(9999) == []


@pytest.mark.parametrize("dies", range(2, 10))
def test_no_notice_is_lost(spark, tmp_path, dies):
    """A runner that dies at any of its saves and sends, and is started again: the receiver gets each key, firing first."""
    w = World([(t, t) for t in range(100, 140)], 200)
    steps, got = [0], []

    def step():
        steps[0] += 1
        if steps[0] == dies:
            raise KeyboardInterrupt

    def send(key, kind, group, since):
        step()
        if key not in got:
            got.append(key)
        step()

    for now in (100, 160, 170, 180, 190):
        store = Store(spark, str(tmp_path / "s"))
        plain = store.save
        store.save = lambda *a: (step(), plain(*a), step())
        try:
            Runner(store, w.evaluate, send).process(RULE, now)
        except KeyboardInterrupt:
            continue
    assert got == ["r/g/110/firing", "r/g/110/resolved"]


def test_unsent_notices_stay(spark, tmp_path):
    w, down = World([(t, t) for t in range(100, 140)], 200), [True]
    send = lambda key, kind, group, since: False if down[0] else w.send(key, kind, group, since)
    run = lambda now: Runner(Store(spark, str(tmp_path / "s")), w.evaluate, send).process(RULE, now)
    run(100)
    run(160)
    assert w.sent == []
    down[0] = False
    run(161)
    assert w.sent == []  # not yet: it was tried a second ago
    run(170)
    assert w.sent == [("firing", 110), ("resolved", 110)]


def test_late_windows_are_named(spark, tmp_path):
    """Only windows that got rows since they were decided are asked again."""
    w = World([(105, 105), (115, 900), (125, 125)], 150)
    asked = []

    def evaluate(rule, lo, hi):
        asked.append(hi)
        return w.evaluate(rule, lo, hi)

    late = lambda rule, at: {e for e, c in at.items() if any(e - 10 <= t < e and c <= r < w.watermark for t, r in w.rows)}
    r = Runner(Store(spark, str(tmp_path / "s")), evaluate, w.send, late_ends=late)
    r.process(RULE, 100)
    r.process(RULE, 150)
    assert w.sent == []
    asked.clear()
    w.watermark = 1000
    r.process(RULE, 155)
    assert asked == [120] and ("late", 110) in w.sent
    asked.clear()
    r.process(RULE, 158)
    assert asked == [] or asked == [120]
