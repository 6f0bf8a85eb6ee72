"""P: session views with derived time and volume columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import clock
from ..columns import floor_div, micros_between, round_half_up_div, seconds_between


def active_view(sessions: DataFrame, users: DataFrame, packages: DataFrame, hotspot_users: DataFrame,
                at: str, devices: DataFrame | None = None) -> DataFrame:
    """The union of both active-session views.

    ``devices`` (session_id, ip_address, mac_address): where the sessions were opened from, if known.

    hours and percent remaining are exact 2-place decimals; percent is NULL when
    a session has zero length (no division by zero).
    """
    now = clock.at(at)
    s = sessions.where((F.col("status") == "active") & (F.col("expires_at") > now))
    j = (s.join(users.select("user_id", "phone_number", "name"), "user_id")
         .join(packages.select("package_id", "package_name", "speed_mbps"), "package_id")
         .join(hotspot_users.select("hotspot_user_id", F.col("username").alias("hotspot_username")),
               "hotspot_user_id", "left"))
    where = []
    if devices is not None:
        j, where = j.join(devices.select("session_id", "ip_address", "mac_address"), "session_id", "left"), ["ip_address", "mac_address"]
    rem = micros_between(now, "expires_at")
    total = micros_between("started_at", "expires_at")
    return j.select(
        "session_id", "user_id", "package_id", "status", "started_at", "expires_at", "bytes_downloaded",
        "bytes_uploaded", "data_used_mb", "phone_number", "name", "package_name", "speed_mbps", "hotspot_username", *where,
        seconds_between(now, "expires_at").alias("time_remaining_seconds"),
        round_half_up_div(rem, F.lit(3_600_000_000)).alias("hours_remaining"),
        F.when(total > 0, round_half_up_div(rem * 100, total)).alias("percent_remaining"),
    )


def session_status(sessions: DataFrame, packages: DataFrame, at: str) -> DataFrame:
    """All active sessions: ms left floored at 0, percent of the package's time."""
    now = clock.at(at)
    s = sessions.where(F.col("status") == "active").join(
        packages.select("package_id", "package_name", "speed_mbps", "duration_hours"), "package_id")
    left_ms = F.greatest(F.lit(0), floor_div(F.greatest(micros_between(now, "expires_at"), F.lit(0)), 1000))
    return s.select("session_id", "user_id", "package_name", "speed_mbps", "status", "started_at", "expires_at",
                    left_ms.alias("time_remaining_ms"),
                    round_half_up_div(left_ms * 100, F.col("duration_hours").cast("bigint") * 3_600_000)
                    .alias("percent_remaining"))


def session_history(sessions: DataFrame, users: DataFrame, packages: DataFrame) -> DataFrame:
    """Every session with duration and total MB (integer MB, divided twice)."""
    j = (sessions.join(users.select("user_id", "phone_number", "name"), "user_id")
         .join(packages.select("package_id", "package_name"), "package_id"))
    return j.select(
        "session_id", "user_id", "phone_number", "name", "package_name", "status", "started_at", "ended_at",
        seconds_between("started_at", "ended_at").alias("session_duration_seconds"),
        "bytes_downloaded", "bytes_uploaded",
        floor_div(floor_div(F.col("bytes_downloaded") + F.col("bytes_uploaded"), 1024), 1024).alias("total_data_mb"),
    )


def active_list(sessions: DataFrame, packages: DataFrame, users: DataFrame) -> DataFrame:
    """All active sessions with package name and phone, newest first."""
    j = (sessions.where(F.col("status") == "active")
         .join(packages.select("package_id", "package_name"), "package_id")
         .join(users.select("user_id", "phone_number"), "user_id"))
    return j.select("session_id", "user_id", "package_id", "started_at", "expires_at", "status", "package_name",
                    "phone_number").orderBy(F.col("started_at").desc(), "session_id")
