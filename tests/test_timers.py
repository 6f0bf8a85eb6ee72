"""The keyed processors without Spark: many keys a group, few messages to the state store."""

import datetime as dt
import random

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from tollgate.streaming import timers


class Handle:
    """State and timers of one group, counting the messages that they would cost."""

    def __init__(self):
        self.calls, self.timers, self.kept = 0, set(), []

    def _state(self, *a):
        self.kept.append(State(self))
        return self.kept[-1]

    getValueState = getListState = _state

    def registerTimer(self, ms):
        self.calls += 1
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.calls += 1
        self.timers.remove(ms)


class State:
    def __init__(self, handle):
        self.handle, self.value = handle, None

    def _call(self, value=None):
        self.handle.calls += 1
        self.value = value

    def get(self):
        self._call(self.value)
        return self.value

    def exists(self):
        return self.get() is not None

    def appendValue(self, value):
        self._call([*(self.value or []), value])

    update = put = _call
    clear = _call


def batch(processor, handle, rows, watermark):
    """One micro-batch of one group: its rows, then the timers that the watermark passed."""
    at = TimerValues(0, watermark)
    out = list(processor.handleInputRows((0,), iter(rows), at)) if rows else []
    for ms in sorted(t for t in handle.timers if t < watermark):
        out += processor.handleExpiredTimer((0,), at, ExpiredTimerInfo(ms))
        handle.timers.discard(ms)
    return out


def test_awaited_keys_of_a_bucket_share_state_and_timer():
    rnd, minute, lateness = random.Random(7), 60_000_000, 15
    starts = {f"k{i}": (s := rnd.randrange(0, 600) * minute + i, s + rnd.randrange(1, 200) * minute) for i in range(500)} | {None: (5, 9)}
    stops = [(k, s + rnd.randrange(-5, 220) * minute) for k, (s, _) in starts.items() for _ in range(rnd.randrange(3))]
    events = [Row(key=k, kind="start", at=s, deadline=d, extra=None if s % 7 == 0 else s) for k, (s, d) in starts.items()]
    events += [Row(key=k, kind="stop", at=at, deadline=None, extra=None) for k, at in stops]
    events.sort(key=lambda r: (r["at"] + rnd.randrange(lateness) * minute, str(r["key"])))  # late by less than the lateness
    handle, p, got, newest, batches = Handle(), timers.Awaited(lateness), [], 0, 0
    p.init(handle)
    for i in range(0, len(events), 100):
        some, watermark = events[i:i + 100], max(newest // 1000 - lateness * 60_000, 0)
        emitted = batch(p, handle, some, watermark)
        assert all(p._due(r["deadline"]) < watermark for r in emitted)
        got, newest, batches = got + emitted, max(newest, *(r["at"] for r in some)), batches + 1
        assert len(handle.timers) <= 1
    got += batch(p, handle, [], 10**9)
    want = {k: (s, d) for k, (s, d) in starts.items() if not any(j == k and s <= at <= d for j, at in stops)}
    assert {r["key"]: (r["started"], r["deadline"]) for r in got} == want and len(got) == len(want) > 100
    assert all(r["extra"] == (None if r["started"] % 7 == 0 else r["started"]) for r in got)
    assert handle.kept[0].value is None and not handle.timers  # nothing is left of what was answered or emitted
    assert handle.calls <= 8 * (batches + 1)  # however many keys a batch brings


def test_first_deliveries_of_a_bucket_share_state_and_timer():
    t0 = dt.datetime(2024, 1, 20)
    handle, p = Handle(), timers.FirstDelivery(["checkout_request_id", "event_id"], 1000)
    p.init(handle)

    def run(arrived, watermark, *rows):
        return sorted((r["checkout_request_id"] or "", r["event_id"]) for r in batch(
            p, handle, [Row(checkout_request_id=c, event_id=e, received_at=at, arrived_ms=arrived) for c, e, at in rows], watermark))

    many = [(f"c{i}", i, t0) for i in range(300)]
    assert run(100, 0, *many, ("c1", -1, t0 + dt.timedelta(1)), ("c2", 900, None), (None, 7, t0)) == sorted(
        [(c, 900 if c == "c2" else e) for c, e, _ in many] + [("", 7)])
    assert run(600, 100, ("c5", 901, t0), ("d", 902, t0), (None, 903, t0)) == [("d", 902)]
    assert run(1200, 1101, ("c6", 904, t0)) == []  # remembered until the batch's own timers
    assert run(1300, 1200, ("c6", 905, t0), ("d", 906, t0)) == [("c6", 905)]  # the first batch is forgotten, the second is not
    assert handle.calls <= 30
    assert run(9000, 0) == [] and batch(p, handle, [], 9000) == [] and handle.kept[0].value is None
