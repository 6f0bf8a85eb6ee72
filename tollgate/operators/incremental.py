"""A6, A6s, A7 and A9 from maintained facts: a transition costs its changed rows, not the history.

The reports are sums over (user, day).  Those sums are kept as a table, and when rows change,
the facts of their old values are subtracted and those of their new values added:

    facts' = facts - facts(old rows that changed) + facts(new rows that changed)

Counts go with every sum, so "no value" (NULL) and 0 stay apart, and a (user, day) whose measures
all return to 0 disappears.  The table is published as versions, partitioned by
day; a delta rewrites only the days it touches (a settlement: the payment's days; a new session: today).

Measures: sessions by the day they started (``n_all``; those of the report's statuses: ``n_sess``,
``dur_s``, ``n_dur``, ``bytes``), payments by the day of their last update (``n_pay``,
``paid``), and completed payments by the day they were created (``spent``, ``n_spent``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock
from ..columns import money, seconds_between
from ..sources.versioned import VersionedTable
from .aggregates import LIVE_STATUSES, _daily

MEASURES = {"n_all": "bigint", "n_sess": "bigint", "dur_s": "bigint", "n_dur": "bigint", "bytes": "decimal(38,0)", "n_pay": "bigint",
            "paid": "decimal(38,2)", "spent": "decimal(38,2)", "n_spent": "bigint"}


def _summed(rows: DataFrame, sign: int = 1) -> DataFrame:
    """Per (user, day) the sums of all measures (absent ones 0), times ``sign``."""
    have = [c for c in MEASURES if c in rows.columns]
    sums = rows.groupBy("user_id", "day").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in have])
    return sums.select("user_id", "day", *[((F.col(c) * sign) if c in have else F.lit(0)).cast(t).alias(c) for c, t in MEASURES.items()])


def session_facts(sessions: DataFrame, sign: int = 1) -> DataFrame:
    live = F.col("status").isin(*LIVE_STATUSES)
    secs = F.when(live, seconds_between("started_at", "ended_at"))
    total = F.col("bytes_downloaded").cast("decimal(38,0)") + F.col("bytes_uploaded").cast("decimal(38,0)")
    return _summed(sessions.select("user_id", F.to_date("started_at").alias("day"), F.lit(1).alias("n_all"), live.cast("int").alias("n_sess"),
                                   secs.alias("dur_s"), secs.isNotNull().cast("int").alias("n_dur"), F.when(live, total).cast("decimal(38,0)").alias("bytes")), sign)


def payment_facts(payments: DataFrame, sign: int = 1) -> DataFrame:
    """Payments without a user belong to no report."""
    p, done = payments.where(F.col("user_id").isNotNull()), F.col("status") == "completed"
    updated = p.where(F.col("updated_at").isNotNull()).select(
        "user_id", F.to_date("updated_at").alias("day"), F.lit(1).alias("n_pay"), F.when(done, F.col("amount_kes")).alias("paid"))
    created = p.where(done).select("user_id", F.to_date("created_at").alias("day"), F.col("amount_kes").alias("spent"), F.lit(1).alias("n_spent"))
    return _summed(updated.unionByName(created, allowMissingColumns=True), sign)


def merged(*parts: DataFrame) -> DataFrame:
    """The sum of facts; what adds up to nothing is gone."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    kept = F.lit(False)
    for c in MEASURES:
        kept = kept | (F.col(c) != 0)
    return _summed(rows).where(kept)


def delta(old: DataFrame, new: DataFrame, facts) -> DataFrame:
    """The signed facts of a change: ``old`` rows leave, ``new`` rows come (``facts``: session_facts or payment_facts)."""
    return merged(facts(old, -1), facts(new))


class Maintained:
    """The facts at ``path``, one partition a day."""

    def __init__(self, spark: SparkSession, path: str):
        self.table = VersionedTable(spark, path, F.col("day"))

    def build(self, sessions: DataFrame, payments: DataFrame) -> int:
        return self.table.replace(merged(session_facts(sessions), payment_facts(payments)))

    def apply(self, change: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """The next version: ``change`` added to the days it touches, all other days untouched."""
        base = self.table.manifest()
        days = self.table.partitions_of(change)
        if not days or self.table.done(base, batch):
            return base["version"]
        return self.table.rewrite(merged(self.table.read(base["version"], only=days), change), days, batch)

    def facts(self, version: int | None = None) -> DataFrame:
        return self.table.read(version)


def daily_stats(facts: DataFrame, safe: bool = False) -> DataFrame:
    """A6 (as written) or A6s from the facts."""
    ud = facts.where(F.col("n_sess") > 0)
    if safe:
        return _daily(ud, F.lit(1), F.col("paid"))
    return _daily(ud, F.greatest(F.col("n_pay"), F.lit(1)), F.col("paid") * F.col("n_sess"))


def user_totals(users: DataFrame, facts: DataFrame, safe: bool = False) -> DataFrame:
    """A7 or A7s from the facts."""
    per = facts.groupBy("user_id").agg(F.sum("n_all").alias("n"), F.sum("spent").alias("spent"))
    n, spent = F.coalesce("n", F.lit(0)), F.coalesce("spent", F.lit(0))
    total = spent if safe else spent * F.greatest(n, F.lit(1))
    return users.join(per, "user_id", "left").select("user_id", "phone_number", "name", "role", "is_active", "created_at",
                                                     n.alias("total_sessions"), money(total).alias("total_spent"))


def weekly_spend(users: DataFrame, facts: DataFrame, at: str) -> DataFrame:
    """A9 from the facts: per user the 7 calendar days that end on the clock's, zero-filled."""
    today = F.to_date(clock.at(at))
    first = F.date_sub(today, 6)
    spend = facts.where((F.col("day") >= first) & (F.col("day") <= today) & (F.col("n_spent") > 0)).select("user_id", F.col("day").alias("day_date"), "spent")
    spine = users.select("user_id", F.explode(F.sequence(first, today)).alias("day_date"))
    return spine.join(spend, ["user_id", "day_date"], "left").select(
        "user_id", "day_date", F.date_format("day_date", "E").alias("day_name"), money(F.coalesce("spent", F.lit(0))).alias("total_spent"))
