"""A: reports and aggregates.

Fan-out joins of the service (sessions x payments per user) are computed
algebraically from per-key partial aggregates, so no query ever emits all pairs
within a group; the "as written" numbers still come out exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import clock
from ..columns import GB, MB, floor_div, micros_between, money, round_half_up_div, seconds_between

LIVE_STATUSES = ("active", "expired", "disconnected")


def kpi(users: DataFrame, sessions: DataFrame, payments: DataFrame, at: str) -> DataFrame:
    """A1: dashboard counters in one pass over each source, no cross join.

    The three sources are projected to their measure columns and unioned, so a
    single global aggregate (partial per partition, one tiny merge) answers all.
    """
    now, today = clock.at(at), clock.day_start(at)
    u = users.select((F.col("role") == "user").alias("is_user"))
    s = sessions.select((F.col("status") == "active").alias("is_active"),
                        ((F.col("status") == "active") & (F.col("expires_at") > now)).alias("is_live"))
    p = payments.where(F.col("status") == "completed").select(
        "amount_kes", (F.col("created_at") >= today).alias("is_today"))
    allrows = u.unionByName(s, allowMissingColumns=True).unionByName(p, allowMissingColumns=True)
    return allrows.agg(
        F.count_if(F.col("is_user")).alias("total_users"),
        F.count_if(F.col("is_live")).alias("active_sessions"),
        F.count_if(F.col("is_active")).alias("active_sessions_any_expiry"),
        money(F.coalesce(F.sum("amount_kes"), F.lit(0))).alias("total_revenue_kes"),
        money(F.coalesce(F.sum(F.when(F.col("is_today"), F.col("amount_kes"))), F.lit(0)))
        .alias("today_revenue_kes"),
    )


def active_count(sessions: DataFrame) -> DataFrame:
    """A2: sessions whose status is active (router count)."""
    return sessions.where(F.col("status") == "active").agg(F.count(F.lit(1)).alias("active_sessions"))


def _bytes(s: DataFrame):
    """Bytes both ways, as DECIMAL: sums over any number of rows stay exact."""
    return (F.col("bytes_downloaded").cast("decimal(38,0)") + F.col("bytes_uploaded").cast("decimal(38,0)")).cast("decimal(38,0)")


def last_hour(sessions: DataFrame, at: str) -> DataFrame:
    """A3: sessions started in the last hour: count, GB and mean MB (2 places, blanks 0)."""
    s = sessions.where(F.col("status").isin(*LIVE_STATUSES) & (F.col("started_at") >= clock.minus(at, hours=1)))
    agg = s.agg(F.count(F.lit(1)).alias("n"), F.sum(_bytes(s)).alias("b"), F.count(_bytes(s)).alias("nb"))
    return agg.select(
        F.col("n").alias("sessions_count"),
        round_half_up_div(F.coalesce("b", F.lit(0)), F.lit(GB)).alias("total_data_gb"),
        F.when(F.col("nb") > 0, round_half_up_div(F.col("b"), F.col("nb") * F.lit(MB)))
         .otherwise(F.lit(0).cast("decimal(18,2)")).alias("avg_data_mb"),
    )


def today_usage(sessions: DataFrame, at: str) -> DataFrame:
    """A4: today's sessions, distinct users and GB; today is a pushed-down range."""
    s = sessions.where(F.col("status").isin(*LIVE_STATUSES) & (F.col("started_at") >= clock.day_start(at)))
    return s.agg(
        F.count(F.lit(1)).alias("sessions_count"),
        F.count_distinct("user_id").alias("unique_users"),
        round_half_up_div(F.coalesce(F.sum(_bytes(s)), F.lit(0)), F.lit(GB)).alias("total_data_gb"),
    )


def closed_last_hour(sessions: DataFrame, at: str) -> DataFrame:
    """A5: closed sessions of the last hour: count, total minutes, mean MB (floored)."""
    s = sessions.where((F.col("started_at") > clock.minus(at, hours=1))
                       & F.col("status").isin("expired", "disconnected"))
    agg = s.agg(F.count(F.lit(1)).alias("n"),
                F.sum(micros_between("started_at", "ended_at").cast("decimal(38,0)")).alias("us"),
                F.sum(_bytes(s)).alias("b"), F.count(_bytes(s)).alias("nb"))
    return agg.select(
        F.col("n").alias("total_sessions"),
        F.coalesce(floor_div("us", 60_000_000), F.lit(0)).alias("total_session_minutes"),
        F.when(F.col("nb") > 0, floor_div("b", F.col("nb") * F.lit(MB))).otherwise(F.lit(0)).alias("avg_data_mb"),
    )


def _user_day_facts(sessions: DataFrame, payments: DataFrame) -> DataFrame:
    """Per (user, day): session facts and payment facts, one shuffle on the pair.

    Map-side partial aggregation absorbs a hot user before the shuffle.
    """
    s = sessions.where(F.col("status").isin(*LIVE_STATUSES)).select(
        "user_id", F.to_date("started_at").alias("day"), F.lit(1).alias("n_sess"),
        seconds_between("started_at", "ended_at").alias("dur_s"), _bytes(sessions).alias("bytes"))
    # an equi-join never matches NULL keys, so payments without user or day match no session
    p = payments.where(F.col("user_id").isNotNull() & F.col("updated_at").isNotNull()).select(
        "user_id", F.to_date("updated_at").alias("day"), F.lit(1).alias("n_pay"),
        F.when(F.col("status") == "completed", F.col("amount_kes")).alias("paid"))
    facts = s.unionByName(p, allowMissingColumns=True)
    return facts.groupBy("user_id", "day").agg(
        F.coalesce(F.sum("n_sess"), F.lit(0)).alias("n_sess"),
        F.sum("dur_s").alias("dur_s"), F.count("dur_s").alias("n_dur"),
        F.sum("bytes").alias("bytes"),
        F.coalesce(F.sum("n_pay"), F.lit(0)).alias("n_pay"),
        F.sum("paid").alias("paid"),
    ).where(F.col("n_sess") > 0)


def _daily(ud: DataFrame, weight, revenue) -> DataFrame:
    """Per day from the (user, day) facts: session measures times ``weight``, revenue as given."""
    agg = ud.groupBy("day").agg(
        F.count("user_id").alias("unique_users"),  # like COUNT(DISTINCT), skips a NULL user
        F.sum(F.col("n_sess") * weight).alias("total_sessions"),
        F.sum(F.col("dur_s") * weight).alias("dur_sum"), F.sum(F.col("n_dur") * weight).alias("dur_n"),
        F.sum(F.col("bytes") * weight).alias("bytes"),
        F.sum(revenue).alias("revenue"),
    )
    return agg.select(
        F.col("day").alias("date"), "unique_users", "total_sessions",
        F.when(F.col("dur_n") > 0, floor_div("dur_sum", "dur_n")).alias("avg_session_seconds"),
        round_half_up_div(F.coalesce("bytes", F.lit(0)), F.lit(GB)).alias("total_data_gb"),
        money(F.coalesce("revenue", F.lit(0))).alias("revenue_kes"),
    )


def daily_stats(sessions: DataFrame, payments: DataFrame) -> DataFrame:
    """A6 as written: sessions LEFT JOIN payments on (user, day), then per day.

    Each session row repeats once per payment of its user that day (at least
    once), so every session measure is weighted by max(n_pay, 1) and revenue by
    the session count.  Same numbers as the join, without materialising it.
    """
    ud = _user_day_facts(sessions, payments)
    return _daily(ud, F.greatest(F.col("n_pay"), F.lit(1)), F.col("paid") * F.col("n_sess"))


def daily_stats_safe(sessions: DataFrame, payments: DataFrame) -> DataFrame:
    """A6s: per day, each user's completed payments counted once (no fan-out)."""
    ud = _user_day_facts(sessions, payments)
    return _daily(ud, F.lit(1), F.col("paid"))


def _user_facts(sessions: DataFrame, payments: DataFrame) -> DataFrame:
    s = sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sess"))
    p = payments.where(F.col("status") == "completed").groupBy("user_id").agg(F.sum("amount_kes").alias("spent"))
    return s.join(p, "user_id", "full")


def user_totals(users: DataFrame, sessions: DataFrame, payments: DataFrame, safe: bool = False) -> DataFrame:
    """A7 / A7s: per user, distinct sessions and completed spend.

    As written the two LEFT JOINs multiply spend by the session count; ``safe``
    reports it once.  Both are two per-user aggregates joined on user_id.
    """
    f = _user_facts(sessions, payments)
    j = users.join(f, "user_id", "left")
    n = F.coalesce(F.col("n_sess"), F.lit(0))
    spent = F.coalesce(F.col("spent"), F.lit(0))
    if not safe:
        spent = spent * F.greatest(n, F.lit(1))
    return j.select("user_id", "phone_number", "name", "role", "is_active", "created_at",
                    n.alias("total_sessions"), money(spent).alias("total_spent"))


def stats_columns() -> list:
    """The A8 row from its raw measures (active count, hour bytes, today's users, duration
    sum in microseconds and count); the mean is rounded half up to whole seconds."""
    avg = F.when(F.col("dur_n") > 0, floor_div(F.col("dur_us") * 2 + F.col("dur_n") * 1_000_000,
                                                F.col("dur_n") * 2_000_000))
    return [F.col("active_sessions_count"), F.col("total_bytes_hour").cast("bigint").alias("total_bytes_hour"), F.col("unique_users_today"),
            avg.alias("avg_session_duration_seconds")]


def system_stats(sessions: DataFrame, at: str, users: DataFrame | None = None, full: bool = False) -> DataFrame:
    """A8 / A8x: the stats snapshot row, all filtered aggregates in one pass.

    ``full`` adds the declared-but-never-computed columns: bytes today and last
    minute, new users today, median duration.  The median is exact: durations
    are bucketed to whole seconds first (map-side), then ``percentile`` with a
    frequency column runs over the bounded histogram only.
    """
    now, today = clock.at(at), clock.day_start(at)
    tomorrow = F.timestamp_add("DAY", F.lit(1), today)
    b = _bytes(sessions)
    is_today = (F.col("started_at") >= today) & (F.col("started_at") < tomorrow)
    dur_us = micros_between("started_at", "ended_at")
    aggs = [
        F.count_if(F.col("status") == "active").alias("active_sessions_count"),
        F.coalesce(F.sum(F.when(F.col("started_at") > clock.minus(at, hours=1), b)), F.lit(0))
         .alias("total_bytes_hour"),
        F.count_distinct(F.when(is_today, F.col("user_id"))).alias("unique_users_today"),
        F.sum(F.when(F.col("ended_at").isNotNull(), dur_us.cast("decimal(38,0)"))).alias("dur_us"),
        F.count(F.when(F.col("ended_at").isNotNull(), F.lit(1))).alias("dur_n"),
    ]
    if full:
        aggs += [
            F.coalesce(F.sum(F.when(is_today, b)), F.lit(0)).alias("total_bytes_today"),
            F.coalesce(F.sum(F.when(F.col("started_at") > clock.minus(at, minutes=1), b)), F.lit(0))
             .alias("total_bytes_minute"),
        ]
    row = sessions.agg(*aggs)
    cols = stats_columns()
    if not full:
        return row.select(*cols, clock.at(at).alias("recorded_at"))
    hist = (sessions.where(F.col("ended_at").isNotNull())
            .groupBy(seconds_between("started_at", "ended_at").alias("secs")).agg(F.count(F.lit(1)).alias("n")))
    # one-value results enter as scalar subqueries: no join at all
    med = hist.agg(F.percentile(F.col("secs"), F.lit(0.5), F.col("n"))).scalar()
    new_users = users.where((F.col("created_at") >= today) & (F.col("created_at") < tomorrow)) \
        .agg(F.count(F.lit(1))).scalar()
    return row.select(*cols, F.col("total_bytes_today").cast("bigint").alias("total_bytes_today"),
                      F.col("total_bytes_minute").cast("bigint").alias("total_bytes_minute"), new_users.alias("new_users_today"),
                      F.floor(med).cast("bigint").alias("median_session_duration_seconds"),
                      clock.at(at).alias("recorded_at"))


def weekly_spend(users: DataFrame, payments: DataFrame, at: str) -> DataFrame:
    """Per user, the 7 calendar days ending on the clock's day, zero-filled.

    The spine is generated per user with ``explode(sequence)`` (7 rows each, no
    cross join) and left-joined to the per (user, day) sums.
    """
    today = F.to_date(clock.at(at))
    first = F.date_sub(today, 6)
    start = F.to_timestamp_ntz(first)
    end = F.timestamp_add("DAY", F.lit(1), clock.day_start(at))
    spend = (payments.where((F.col("status") == "completed") & (F.col("created_at") >= start)
                            & (F.col("created_at") < end))
             .groupBy("user_id", F.to_date("created_at").alias("day_date"))
             .agg(F.sum("amount_kes").alias("spent")))
    spine = users.select("user_id", F.explode(F.sequence(first, today)).alias("day_date"))
    j = spine.join(spend, ["user_id", "day_date"], "left")
    return j.select("user_id", "day_date", F.date_format("day_date", "E").alias("day_name"),
                    money(F.coalesce("spent", F.lit(0))).alias("total_spent"))


def weekly_total_max(users: DataFrame, payments: DataFrame, at: str) -> DataFrame:
    """A10: week total, largest day (at least 1), bar height in basis points, max flag.

    Bars are max(total / max * 10000, 200) basis points, in integer cents.
    Each user's window holds exactly 7 rows.
    """
    from pyspark.sql import Window
    w = weekly_spend(users, payments, at)
    per_user = Window.partitionBy("user_id")
    cents = (F.col("total_spent") * 100).cast("bigint")
    w = w.withColumn("c", cents).withColumn("max_c", F.greatest(F.max("c").over(per_user), F.lit(100))) \
        .withColumn("week_c", F.sum("c").over(per_user))
    return w.select(
        "user_id", "day_date", "total_spent",
        (F.col("week_c") / 100).cast("decimal(18,2)").alias("week_total"),
        (F.col("max_c") / 100).cast("decimal(18,2)").alias("max_day"),
        F.greatest(floor_div(F.col("c") * 10000, "max_c"), F.lit(200)).alias("bar_bp"),
        ((F.col("c") == F.col("max_c")) & (F.col("c") > 0)).alias("is_max"),
    )


def status_counts(sessions: DataFrame, status_limit: int = 20, user_limit: int = 10) -> DataFrame:
    """Totals behind each page: per status (admin list) and per user (history)."""
    by_status = sessions.groupBy("status").agg(F.count(F.lit(1)).alias("total")).select(
        F.lit("status").alias("scope"), F.col("status").alias("key"), "total",
        F.ceil(F.col("total") / F.lit(status_limit)).cast("bigint").alias("pages"))
    by_user = sessions.groupBy("user_id").agg(F.count(F.lit(1)).alias("total")).select(
        F.lit("user").alias("scope"), F.col("user_id").cast("string").alias("key"), "total",
        F.ceil(F.col("total") / F.lit(user_limit)).cast("bigint").alias("pages"))
    return by_status.unionByName(by_user)


def favourite_package(sessions: DataFrame, packages: DataFrame) -> DataFrame:
    """Most frequent package per user; ties to the smaller name, then id.

    Counts per (user, package) first, names joined to that (smaller) result, then
    one ``min(struct)`` per user: a partial aggregate, so a hot user cannot pin a task.
    """
    c = sessions.groupBy("user_id", "package_id").agg(F.count(F.lit(1)).alias("n"))
    c = c.join(packages.select("package_id", "package_name"), "package_id", "inner")
    best = c.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("neg"), "package_name",
                                                   "package_id")).alias("b"))
    return best.select("user_id", F.col("b.package_id").alias("package_id"),
                       F.col("b.package_name").alias("package_name"), (-F.col("b.neg")).alias("n_sessions"))


def user_spend(sessions: DataFrame, payments: DataFrame) -> DataFrame:
    """Per user, all sessions and the spend of the paid ones, over all history."""
    j = sessions.select("user_id", "payment_id").join(
        payments.select("payment_id", "amount_kes"), "payment_id", "left")
    return j.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_sessions"),
                                    money(F.coalesce(F.sum("amount_kes"), F.lit(0))).alias("total_spent"))


def capacity_health(sessions: DataFrame, capacity: int = 1000) -> DataFrame:
    """Active sessions against capacity; healthy, warning (>75 %), critical (>90 %)."""
    n = F.col("active_sessions")
    a = active_count(sessions)
    return a.select(
        n, F.lit(capacity).alias("max_capacity"),
        (floor_div(n * 2000 + capacity, F.lit(2 * capacity)) / 10).cast("decimal(10,1)").alias("capacity_percent"),
        F.when(n * 100 > 90 * capacity, "critical").when(n * 100 > 75 * capacity, "warning")
         .otherwise("healthy").alias("status"))


def _bw_measures(logs: DataFrame):
    secs = seconds_between("period_start", "period_end")
    def total(c):
        return F.sum(c).alias(c)  # a bigint sum: under pinned ANSI an overflow is an error, and partial sums stay 8 bytes
    return [F.count(F.lit(1)).alias("n_periods"), total("bytes_downloaded"), total("bytes_uploaded"), total("packets_in"), total("packets_out"),
            F.sum(secs).alias("seconds")]


def _bw_speeds(df: DataFrame, keys: list[str]) -> DataFrame:
    den = F.col("seconds") * 1024
    return df.select(*keys, "n_periods", "bytes_downloaded", "bytes_uploaded", "packets_in", "packets_out",
                     "seconds",
                     F.when(F.col("seconds") > 0, round_half_up_div(F.col("bytes_downloaded") * 8, den))
                      .alias("avg_down_kbps"),
                     F.when(F.col("seconds") > 0, round_half_up_div(F.col("bytes_uploaded") * 8, den))
                      .alias("avg_up_kbps"))


def bandwidth_by_session(logs: DataFrame) -> DataFrame:
    """Bytes, packets, seconds and mean kbps per session from the log."""
    return _bw_speeds(logs.groupBy("session_id").agg(*_bw_measures(logs)), ["session_id"])


def bandwidth_by_user_hour(logs: DataFrame) -> DataFrame:
    """A15h: the same per (user, hour of period start)."""
    g = logs.groupBy("user_id", F.date_trunc("hour", "period_start").alias("hour")).agg(*_bw_measures(logs))
    return _bw_speeds(g, ["user_id", "hour"])


def revenue_series(spark: SparkSession, payments: DataFrame, at: str, days: int = 30) -> DataFrame:
    """30 calendar days of completed revenue, zero-filled, with weekly totals."""
    from pyspark.sql import Window
    today = F.to_date(clock.at(at))
    first = F.date_sub(today, days - 1)
    start = F.to_timestamp_ntz(first)
    end = F.timestamp_add("DAY", F.lit(1), clock.day_start(at))
    daily = (payments.where((F.col("status") == "completed") & (F.col("created_at") >= start)
                            & (F.col("created_at") < end))
             .groupBy(F.to_date("created_at").alias("day")).agg(F.sum("amount_kes").alias("revenue")))
    spine = spark.range(1).select(F.explode(F.sequence(first, today)).alias("day"))
    j = spine.join(daily, "day", "left")
    j = j.withColumn("revenue", money(F.coalesce("revenue", F.lit(0)))) \
        .withColumn("week_start", F.to_date(F.date_trunc("week", "day")))
    return j.select("day", F.col("revenue").alias("revenue_kes"), "week_start",
                    money(F.sum("revenue").over(Window.partitionBy("week_start"))).alias("week_revenue_kes"))


def package_breakdown(payments: DataFrame, packages: DataFrame) -> DataFrame:
    """Share of completed sales per package, in basis points of revenue.

    The grand total is a scalar subquery (one value), not a window over everything.
    """
    per = (payments.where(F.col("status") == "completed").groupBy("package_id")
           .agg(F.count(F.lit(1)).alias("n_sales"), F.sum("amount_kes").alias("revenue")))
    total = per.agg(F.sum("revenue")).scalar()
    j = per.join(packages.select("package_id", "package_name"), "package_id", "left")
    cents = (F.col("revenue") * 100).cast("decimal(38,0)")
    tot = (total * 100).cast("decimal(38,0)")
    return j.select("package_id", "package_name", "n_sales", money("revenue").alias("revenue_kes"),
                    floor_div(cents * 10000, tot).alias("share_bp"))


def seed_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per table, and the 'name: n' text line."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("table_name", "row_count",
                      F.concat(F.col("table_name"), F.lit(": "), F.col("row_count").cast("string")).alias("label"))
