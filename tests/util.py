from pyspark.sql import functions as F

SESSION_SCHEMA = ("session_id bigint, user_id bigint, package_id bigint, payment_id bigint, hotspot_user_id bigint, "
                  "started_at timestamp_ntz, expires_at timestamp_ntz, status string, ended_at timestamp_ntz, "
                  "bytes_downloaded bigint, bytes_uploaded bigint, data_used_mb decimal(12,2)")
PAYMENT_SCHEMA = ("payment_id bigint, user_id bigint, package_id bigint, amount_kes decimal(10,2), status string, "
                  "checkout_request_id string, created_at timestamp_ntz, updated_at timestamp_ntz")
PACKAGE_SCHEMA = ("package_id bigint, package_name string, duration_hours int, price_kes decimal(10,2), "
                  "speed_mbps int, is_active boolean, sort_order bigint")
USER_SCHEMA = ("user_id bigint, phone_number string, name string, role string, is_active boolean, "
               "created_at timestamp_ntz")


def ts(s):
    import datetime as dt
    return None if s is None else dt.datetime.fromisoformat(s)


def sessions(spark, rows):
    """rows: (id, user, package, payment, hotspot, start, expires, status, ended, down, up)"""
    out = [(r[0], r[1], r[2], r[3], r[4], ts(r[5]), ts(r[6]), r[7], ts(r[8]), r[9], r[10], None) for r in rows]
    return spark.createDataFrame(out, SESSION_SCHEMA)


def payments(spark, rows):
    """rows: (id, user, package, amount, status, checkout, created, updated)"""
    import decimal
    out = [(r[0], r[1], r[2], decimal.Decimal(str(r[3])), r[4], r[5], ts(r[6]), ts(r[7])) for r in rows]
    return spark.createDataFrame(out, PAYMENT_SCHEMA)


def packages(spark, rows):
    import decimal
    out = [(r[0], r[1], r[2], decimal.Decimal(str(r[3])), r[4], r[5], r[6]) for r in rows]
    return spark.createDataFrame(out, PACKAGE_SCHEMA)


def users(spark, rows):
    out = [(r[0], r[1], r[2], r[3], r[4], ts(r[5])) for r in rows]
    return spark.createDataFrame(out, USER_SCHEMA)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect()) if cols else sorted(tuple(r) for r in df.collect())


__all__ = ["F", "sessions", "payments", "packages", "users", "rows", "ts"]
