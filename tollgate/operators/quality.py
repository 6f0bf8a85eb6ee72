"""Q: data-quality jobs for the constraints the database used to enforce."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import phones


def _union(dfs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), dfs)


def orphan_keys(fks: list[tuple[str, str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Q1: per foreign key, the missing parent keys and how many child rows point at each.

    ``fks``: (fk name, on-delete rule, child df, child column, parent df, parent column).
    NULL references are allowed, as in SQL.  All keys of one child come from one scan of
    it, counted per (foreign key, value) before anything else is shuffled, so a hot key is
    one row per map task; the counted keys of all foreign keys to one parent are anti-joined
    with that parent's column together, which is read once and as it is."""
    by_child: dict[int, list] = {}
    for fk in fks:
        by_child.setdefault(id(fk[2]), []).append(fk)
    counted: dict[tuple[int, str], list[DataFrame]] = {}
    for group in by_child.values():
        child = group[0][2]
        pairs = F.explode(F.array(*[F.struct(F.lit(name).alias("fk"), F.lit(rule).alias("on_delete"), F.col(ccol).alias("missing_key"))
                                    for name, rule, _, ccol, _, _ in group])).alias("r")
        keys = (child.select(pairs).select("r.*").where(F.col("missing_key").isNotNull())
                .groupBy("fk", "on_delete", "missing_key").agg(F.count(F.lit(1)).alias("n_rows")))
        targets = {(id(fk[4]), fk[5]) for fk in group}
        for t in targets:
            names = [fk[0] for fk in group if (id(fk[4]), fk[5]) == t]
            counted.setdefault(t, []).append(keys if len(targets) == 1 else keys.where(F.col("fk").isin(*names)))
    parents = {(id(fk[4]), fk[5]): fk[4] for fk in fks}
    missing = [_union(rows).join(parents[t].select(F.col(t[1]).alias("missing_key")), "missing_key", "left_anti") for t, rows in counted.items()]
    return _union(missing).select("fk", "on_delete", "missing_key", "n_rows")


def duplicate_keys(uniques: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """Q2: values of a UNIQUE column that occur more than once (NULLs are not compared)."""
    out = []
    for name, df, col in uniques:
        g = (df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("key_value"))
             .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
        out.append(g.select(F.lit(name).alias("constraint"), "key_value", "n"))
    return _union(out)


def _checks(table: str, df: DataFrame, checks: dict) -> DataFrame:
    """One pass over ``df``: count rows and each check's violations, then one row per check."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.count_if(~F.coalesce(cond, F.lit(False))).alias(name)
                                             for name, cond in checks.items()]
    row = df.agg(*aggs)
    stack = ", ".join(f"'{n}', `{n}`" for n in checks)
    return row.select(F.lit(table).alias("table_name"), F.col("_n").alias("n_checked"),
                      F.expr(f"stack({len(checks)}, {stack}) as (check_name, n_violations)"))


def domain_checks(users: DataFrame, packages: DataFrame, payments: DataFrame, sessions: DataFrame,
                  logs: DataFrame) -> DataFrame:
    """Q3: enum domains, positive package terms and log periods, with violation counts."""
    return _union([
        _checks("users", users, {"role_enum": F.col("role").isin("user", "admin")}),
        _checks("packages", packages, {"duration_positive": F.col("duration_hours") > 0,
                                       "price_positive": F.col("price_kes") > 0,
                                       "speed_positive": F.col("speed_mbps") > 0}),
        _checks("payments", payments, {"status_enum": F.col("status").isin("pending", "completed", "failed",
                                                                           "cancelled")}),
        _checks("sessions", sessions, {"status_enum": F.col("status").isin("active", "expired", "paused",
                                                                           "disconnected")}),
        _checks("bandwidth_logs", logs, {"valid_period": F.col("period_end") > F.col("period_start")}),
    ]).select("table_name", "check_name", "n_checked", "n_violations")


# Fixed value: the shape of a UUID in a request path (versions 1 to 5, either case).
UUID_SHAPE = "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}$"


def input_rules(packages: DataFrame, users: DataFrame, logins: DataFrame, path_ids: DataFrame) -> DataFrame:
    """Q4: request validation rules applied to whole tables, failures counted per rule."""
    return _union([
        _checks("packages", packages, {
            "duration_int_ge_1": F.col("duration_hours") >= 1,
            "price_ge_1": F.col("price_kes") >= 1,
            "speed_int_ge_1": F.col("speed_mbps") >= 1,
            "name_not_empty": F.length(F.trim(F.col("package_name"))) > 0}),
        _checks("users", users, {"name_len_le_100": F.length(F.trim(F.col("name"))) <= 100}),
        _checks("logins", logins, {"phone_valid": phones.normalise("raw_phone").isNotNull()}),
        _checks("path_ids", path_ids, {"uuid_shape": F.col("path_id").rlike(UUID_SHAPE)}),
    ]).select("table_name", "check_name", "n_checked", "n_violations")
