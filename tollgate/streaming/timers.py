"""T3 and T5 with timers, T1 with a remembered hour: ``transformWithState`` over buckets of keys.

A session (T3) or an awaited payment (T5) is a few numbers of state and a moment of event time.
When the watermark passes that moment its row comes out; a disconnect or callback that comes
first removes it.  So the state holds the open sessions and the payments still awaited, and
nothing else, for whatever time the stream runs.

Each call of a Python processor on its state or timers is a message to the JVM and back, and each
group an Arrow batch, which costs far more than the row itself.  So a group is a hash bucket of
keys: a batch reads a bucket's state once and writes it once, and one event-time timer stands at
the earliest moment of the bucket.  It fires for all that is due, moment by moment the same rows as a timer
per key, and is set again at the next.  The number of buckets is fixed for the life of a checkpoint;
a batch rewrites the buckets that it touches, so there should be one for every few thousand keys held.

A stop that arrives before its start (within the lateness) waits beside the open ones, until no
start for it can arrive any more.

Starts and stops are one union with one watermark, ``lateness`` behind the newest event, on
the time the event happened (a start's ``started_at``, a payment's ``created_at``).  Rows later
than that are Spark's late rows.  The processors hold no Python state: all of it is in
the state store (RocksDB, which ``transformWithState`` needs), so a restarted or moved task goes on from there.
"""

from __future__ import annotations

import contextlib
import datetime as dt
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .. import clock
from ..functions.callbacks import parse_callbacks
from . import runner

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER, PARTITIONS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"
LATENESS_MINUTES = 15
EPOCH = dt.datetime(1970, 1, 1)


BUCKETS = 4096  # of a stream whose size is not known
EVENTS_PER_BUCKET, LEAST_BUCKETS = 5_000, 256
EVENTS_PER_PARTITION = 400_000


def buckets_for(events: int) -> int:
    """Buckets for a stream of so many events."""
    return max(-(-events // EVENTS_PER_BUCKET), LEAST_BUCKETS)


def bucketed(df: DataFrame, key: str, buckets: int):
    """``df`` grouped by hash buckets of ``key``, as the processors below take it."""
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(int(buckets)))).groupBy("bucket")


@contextlib.contextmanager
def rocksdb(spark: SparkSession, events: int | None = None):
    """The state store that timers need, for the queries started inside.

    State is in as many parts as the session shuffles in, or as many as the ``events`` need where their
    number is known: each part is a store and a Python worker of its own, in every batch, and a part's
    size does not grow with the stream."""
    session = int(spark.conf.get(PARTITIONS))
    wanted = {PROVIDER: ROCKSDB, PARTITIONS: str(session if events is None else max(-(-events // EVENTS_PER_PARTITION), min(session, 4)))}
    before = {c: spark.conf.get(c, None) for c in wanted}
    for c, v in wanted.items():
        spark.conf.set(c, v)
    try:
        yield
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


class Awaited(StatefulProcessor):
    """Emits a start's row at its deadline unless a stop from its start to its deadline came first.

    Input rows, grouped by a bucket of keys: (key, kind start|stop, at, deadline, extra), times in
    microseconds; output: (key, extra, started, deadline).  The state of a bucket is its open starts, its
    early stops and where its timer stands, column by column."""

    HELD = ("timer bigint, key array<string>, started array<bigint>, deadline array<bigint>, extra array<bigint>, "
            "early_key array<string>, early_at array<bigint>")

    def __init__(self, lateness_minutes: int):
        self.keep_ms = lateness_minutes * 60_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", self.HELD)

    @staticmethod
    def _due(deadline: int) -> int:
        return -(-deadline // 1000)  # the first millisecond at or past it

    def _gone(self, stop: int) -> int:
        return stop // 1000 + self.keep_ms  # no start of a stop can come any more

    def _read(self) -> tuple[int | None, dict, dict]:
        """The bucket's timer, its open starts {key: (started, deadline, extra)} and early stops {key: [at]}."""
        held, early = self.held.get(), {}
        if held is None:
            return None, {}, early
        timer, key, started, deadline, extra, early_key, early_at = held
        for k, at in zip(early_key, early_at):
            early.setdefault(k, []).append(at)
        return timer, dict(zip(key, zip(started, deadline, extra))), early

    def _write(self, timer: int | None, opened: dict, early: dict, fired: bool = False) -> None:
        """Keep what is left and set the timer at its earliest moment (Spark itself removes one that fired)."""
        waiting = [(k, at) for k, stops in early.items() for at in stops]
        first = min([*(self._due(x[1]) for x in opened.values()), *(self._gone(at) for _, at in waiting)], default=None)
        if first != timer:
            if timer is not None and not fired:
                self.handle.deleteTimer(timer)
            if first is not None:
                self.handle.registerTimer(first)
        if first is None:
            self.held.clear()
            return
        started, deadline, extra = zip(*opened.values()) if opened else ((), (), ())
        self.held.update((first, list(opened), list(started), list(deadline), list(extra), [k for k, _ in waiting], [at for _, at in waiting]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        timer, opened, early = self._read()
        starts, stops = {}, {}
        for r in rows:
            if r["kind"] == "start":
                starts.setdefault(r["key"], []).append((r["at"], r["deadline"], r["extra"]))
            else:
                stops.setdefault(r["key"], []).append(r["at"])
        for k in dict.fromkeys([*starts, *stops]):
            its = early.pop(k, []) + stops.get(k, [])
            if k in starts and k not in opened:
                opened[k] = min(starts[k])
            mine = opened.get(k)
            if mine is None:
                early[k] = its  # their start may still come
            elif any(mine[0] <= s <= mine[1] for s in its):
                del opened[k]
        self._write(timer, opened, early)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        timer, opened, early = self._read()
        now = timerValues.getCurrentWatermarkInMs()
        for k in [k for k, x in opened.items() if self._due(x[1]) < now]:
            started, deadline, extra = opened.pop(k)
            yield Row(key=k, extra=extra, started=started, deadline=deadline)
        left = {k: [at for at in stops if self._gone(at) >= now] for k, stops in early.items()}
        self._write(timer, opened, {k: stops for k, stops in left.items() if stops}, fired=True)

    def close(self) -> None:
        pass


EVENT = "key string, kind string, at bigint, deadline bigint, extra bigint, ts timestamp"
OUT = "key string, extra bigint, started bigint, deadline bigint"


def awaited(events: DataFrame, lateness_minutes: int = LATENESS_MINUTES, buckets: int = BUCKETS) -> DataFrame:
    """The starts among ``events`` that no stop answered in time."""
    return (bucketed(events.withWatermark("ts", f"{int(lateness_minutes)} minutes"), "key", buckets)
            .transformWithState(Awaited(int(lateness_minutes)), OUT, "Append", "EventTime"))


def _event(df: DataFrame, key: str, kind: str, at: str, deadline=None, extra: str | None = None) -> DataFrame:
    none = F.lit(None).cast("bigint")
    return df.select(F.col(key).cast("string").alias("key"), F.lit(kind).alias("kind"), runner.epoch_micros(at).alias("at"),
                     (none if deadline is None else runner.epoch_micros(deadline)).alias("deadline"),
                     (none if extra is None else F.col(extra).cast("bigint")).alias("extra"), F.col(at).cast("timestamp").alias("ts"))


def from_micros(us: str):
    return F.timestamp_add("MICROSECOND", F.col(us), F.to_timestamp_ntz(F.lit(runner.EPOCH)))


def _run(spark: SparkSession, name: str, starts: DataFrame, stops: DataFrame, at: str, slices: int, lateness_minutes: int) -> DataFrame:
    """Replay the events in time order; event time ends at the clock (a stop of no one, ``lateness`` after it)."""
    base = runner.run_folder(spark, name)
    end = F.timestamp_add("SECOND", F.lit(60 * int(lateness_minutes)), clock.at(at))
    tick = spark.range(1).select(F.lit("").alias("key"), F.lit("stop").alias("kind"), runner.epoch_micros(end).alias("at"),
                                 F.lit(None).cast("bigint").alias("deadline"), F.lit(None).cast("bigint").alias("extra"), end.cast("timestamp").alias("ts"))
    events = starts.unionByName(stops).unionByName(tick).withColumn("happened", F.col("ts").cast("timestamp_ntz"))
    replay = runner.Replay([(events, "happened")], base, slices)
    n = replay.rows[0].count()
    with rocksdb(spark, n):
        replay.drain(lambda: runner.run_to_parquet(awaited(runner.read_files(spark, replay.paths[0], EVENT), lateness_minutes, buckets_for(n)), base))
    return spark.read.schema(OUT).parquet(f"{base}/out").where(F.col("key") != "")


def run_expiry_timers(spark: SparkSession, sessions: DataFrame, at: str, slices: int = 3, lateness_minutes: int = LATENESS_MINUTES) -> DataFrame:
    """Sessions whose expires_at event time has passed, unless disconnected first."""
    now = clock.at(at)
    starts = _event(sessions.where(F.col("started_at") <= now), "session_id", "start", "started_at", "expires_at", "user_id")
    stops = _event(sessions.where((F.col("status") == "disconnected") & (F.col("ended_at") <= now)), "session_id", "stop", "ended_at")
    out = _run(spark, "expiry_timers", starts, stops, at, slices, lateness_minutes)
    return out.select(F.col("key").cast("bigint").alias("session_id"), F.col("extra").alias("user_id"), from_micros("deadline").alias("expired_at"))


def run_deadline_timers(spark: SparkSession, payments: DataFrame, callbacks: DataFrame, at: str, minutes: int = 5, slices: int = 3,
                        lateness_minutes: int = LATENESS_MINUTES) -> DataFrame:
    """T5: payments with no callback within ``minutes``."""
    now = clock.at(at)
    due = payments.where(F.col("created_at") <= now).withColumn("deadline", F.timestamp_add("MINUTE", F.lit(minutes), F.col("created_at")))
    starts = _event(due, "checkout_request_id", "start", "created_at", "deadline", "payment_id")
    stops = _event(parse_callbacks(callbacks.where(F.col("received_at") <= now)), "checkout_request_id", "stop", "received_at")
    out = _run(spark, "deadline_timers", starts, stops, at, slices, lateness_minutes)
    return out.select(F.col("extra").alias("payment_id"), F.col("key").alias("checkout_request_id"), from_micros("started").alias("created_at"),
                      from_micros("deadline").alias("deadline"))


class FirstDelivery(StatefulProcessor):
    """T1's dedup in the state store: of a checkout's rows the first of its first batch, then none while it is remembered.

    Input rows are grouped by a bucket of checkouts.  Its state has one entry a batch, the checkouts
    that the batch brought, and a timer that forgets them."""

    def __init__(self, fields: list[str], remember_ms: int):
        self.fields, self.remember_ms = fields, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "until bigint, checkouts array<string>")

    def _seen(self) -> list[tuple]:
        return list(self.seen.get()) if self.seen.exists() else []

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = {c for _, checkouts in self._seen() for c in checkouts}
        first = {}
        for r in rows:
            c = r["checkout_request_id"]
            if c in known:
                continue
            order = (r["received_at"] is not None, r["received_at"] or EPOCH, r["event_id"])
            if c not in first or order < first[c][0]:
                first[c] = (order, r)
        if first:
            until = max(r["arrived_ms"] for _, r in first.values()) + self.remember_ms  # rows of one batch arrive at one moment
            self.seen.appendValue((until, list(first)))
            self.handle.registerTimer(until)
        for _, r in first.values():
            yield Row(**{f: r[f] for f in self.fields})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        left = [x for x in self._seen() if x[0] > expiredTimerInfo.getExpiryTimeInMs()]
        self.seen.put(left) if left else self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_deliveries(parsed: DataFrame, remember: dt.timedelta, buckets: int = BUCKETS) -> DataFrame:
    """Each checkout's first delivery among those that arrive while it is remembered (``remember`` after it arrived).

    Bounded state in front of the ledger: most retries come within minutes and end here.  Event
    time is the batch's own arrival time, so no row is ever late, however old its callback; a retry
    that arrives after ``remember`` passes and is stopped by the ledger."""
    now = F.current_timestamp()
    rows = parsed.withColumn("arrived", now).withColumn("arrived_ms", F.unix_millis(now)).withWatermark("arrived", "0 seconds")
    processor = FirstDelivery(parsed.columns, int(remember.total_seconds() * 1000))
    return bucketed(rows, "checkout_request_id", buckets).transformWithState(processor, parsed.schema, "Append", "EventTime")


def run_dedup_state(spark: SparkSession, callbacks: DataFrame, slices: int = 3, remember: dt.timedelta = dt.timedelta(hours=1),
                    step: Callable | None = None) -> DataFrame:
    """T1 with the state-store dedup in front of the ledger."""
    from . import callbacks as SC
    base = runner.run_folder(spark, "callback_dedup_state")
    replay = SC.JsonReplay(callbacks, base, slices)
    n = replay.rows[0].count()
    with rocksdb(spark, n):
        replay.drain(lambda: runner.run_foreach_batch(first_deliveries(SC.callback_lines(spark, replay.paths[0]).select(*SC.PARSED_COLS), remember, buckets_for(n)), base,
                                                      step or SC.dedup_batches(spark, base)))
    return spark.read.parquet(f"{base}/first").drop("batch_id")
