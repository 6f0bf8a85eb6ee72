"""S3 callback_source with its side output, T1 callback_dedup and T2 settle_stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.callbacks import parse_callbacks, rejected_callbacks
from ..operators import publishing as PB
from ..operators import transitions as U
from ..operators.joins import first_callbacks
from ..sources.versioned import VersionedTable
from . import runner

LEDGER_BUCKETS = 64
WRITER = "dedup"  # whose batches the ledger of settled ids records
DAYS_BACK = 7  # payments this much older than their callback are looked up in a second step

TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"  # of received_at in the JSON lines
PARSED_COLS = ["event_id", "received_at", "checkout_request_id", "result_code", "result_desc", "amount_kes",
               "receipt_number", "transaction_date", "phone_number"]


def callback_documents(spark: SparkSession, path: str, files_per_batch: int | None = 1000) -> DataFrame:
    """S3 for raw deliveries: one JSON document per file, as the webhook stores them.

    The whole file is the body; it is received when the file was written (file
    metadata), and the delivery id is derived from the file path.  Parsed with
    the same schema as every other callback (C8)."""
    reader = spark.readStream.option("wholetext", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = (reader.text(path)
           .select(F.xxhash64(F.col("_metadata.file_path")).alias("event_id"),
                   F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("received_at"),
                   F.col("value").alias("body")))
    return parse_callbacks(raw)


def callback_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """S3 for collected deliveries: JSON lines {event_id, received_at, body}, ``body`` being the document's text."""
    return parse_callbacks(raw_lines(spark, path, files_per_batch))


class JsonReplay(runner.Replay):
    """Recorded callbacks, delivered as the JSON files that the source reads."""

    def __init__(self, callbacks: DataFrame, base: str, slices: int = 3):
        super().__init__([(callbacks.select("event_id", "received_at", "body"), "received_at")], base, slices)

    def deliver(self, k: int) -> None:
        self.rows[0].where(self.slices[k]).drop("_us").write.mode("append") \
            .option("timestampNTZFormat", TIME_FORMAT).json(self.paths[0])


def run_source(spark: SparkSession, callbacks: DataFrame, slices: int = 3) -> DataFrame:
    """S3 end to end: JSON documents delivered in slices, read as a file stream, parsed, into a file sink."""
    base = runner.run_folder(spark, "callback_source")
    replay = JsonReplay(callbacks, base, slices)
    replay.drain(lambda: runner.run_to_parquet(callback_lines(spark, replay.paths[0]), base))
    return spark.read.parquet(f"{base}/out")


def raw_lines(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The JSON lines of :func:`callback_lines` with their bodies unparsed."""
    reader = spark.readStream.schema("event_id bigint, received_at timestamp_ntz, body string").option("timestampNTZFormat", TIME_FORMAT)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.json(path)


def side_output_batches(base: str) -> Callable[[DataFrame, int], None]:
    """S3 with its side output: what can be read into ``parsed``, everything else, raw and with the reason, into ``rejects``."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        parse_callbacks(batch).write.mode("overwrite").parquet(f"{base}/parsed/batch_id={batch_id}")
        rejected_callbacks(batch).write.mode("overwrite").parquet(f"{base}/rejects/batch_id={batch_id}")
        batch.unpersist()
    return step


def run_side_output(spark: SparkSession, deliveries: DataFrame, slices: int = 3) -> tuple[DataFrame, DataFrame]:
    """S3 end to end over deliveries of any shape: (parsed, rejected); together they are all that was delivered."""
    base = runner.run_folder(spark, "callback_rejects")
    replay = JsonReplay(deliveries, base, slices)
    replay.drain(lambda: runner.run_foreach_batch(raw_lines(spark, replay.paths[0]), base, side_output_batches(base)))
    return spark.read.parquet(f"{base}/parsed").drop("batch_id"), spark.read.parquet(f"{base}/rejects").drop("batch_id")


def ledger(spark: SparkSession, base: str, buckets: int = LEDGER_BUCKETS) -> VersionedTable:
    """The ids of all checkouts seen, one column, in hash buckets."""
    return VersionedTable(spark, f"{base}/seen", F.pmod(F.xxhash64("checkout_request_id"), F.lit(buckets)))


def unseen_first(batch: DataFrame, seen: VersionedTable, batch_id: int) -> tuple[DataFrame, Callable[[], None]]:
    """T1 for one micro-batch: (the first delivery of each checkout that no earlier batch brought, how to record them).

    Within a batch the first is by (received_at, event_id), as in W4; an earlier batch always
    wins, however long ago it was.  Only the hash buckets that the batch's ids fall into are
    read and written again, one file each, so a batch's work follows its own ids and the size
    of a bucket (more buckets for more ids), not the number of batches before it.  A replayed batch starts
    from the ledger as it was before it, and gives the same rows."""
    before = seen.before((WRITER, batch_id))
    first = first_callbacks(batch.select(*PARSED_COLS))
    buckets = seen.partitions_of(first)
    if before["schema"] is None:
        old, new = None, first
    else:
        old = seen.read(before["version"], only=buckets)
        new = first.join(old, first["checkout_request_id"].eqNullSafe(old["checkout_request_id"]), "left_anti")

    def record() -> None:
        if buckets:
            found = new.select("checkout_request_id")
            seen.rewrite(found if old is None else old.unionByName(found), buckets, (WRITER, batch_id))

    return new.select(*PARSED_COLS), record


def dedup_batches(spark: SparkSession, base: str, buckets: int = LEDGER_BUCKETS) -> Callable[[DataFrame, int], None]:
    """Write each batch's new first deliveries into its own folder, then enter them in the ledger."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        first, record = unseen_first(batch, ledger(spark, base, buckets), batch_id)
        first.write.mode("overwrite").parquet(f"{base}/first/batch_id={batch_id}")
        record()
        batch.unpersist()
    return step


def answered_payments(payments: DataFrame, cb: DataFrame, days_back: int = DAYS_BACK) -> DataFrame:
    """The payments that the callbacks ``cb`` answer, looked for among recent ones first.

    A callback follows its payment closely, so payments created from ``days_back`` days before the
    batch's earliest callback to its last one are read (the range reaches the scan and prunes
    files and day partitions).  Only if callbacks remain without a payment, the rest is read too."""
    span = cb.agg(F.min("received_at").alias("lo"), F.max("received_at").alias("hi")).first()
    ids = cb.select("checkout_request_id")
    if span.lo is None:
        return payments.join(ids, "checkout_request_id", "left_semi")
    recent = ((F.col("created_at") >= F.timestamp_add("DAY", F.lit(-days_back), F.lit(span.lo).cast("timestamp_ntz")))
              & (F.col("created_at") <= F.lit(span.hi).cast("timestamp_ntz")))
    near = payments.where(recent).join(ids, "checkout_request_id", "left_semi")
    rest = ids.join(near.select("checkout_request_id"), "checkout_request_id", "left_anti")
    if rest.isEmpty():
        return near
    return near.unionByName(payments.where(~F.coalesce(recent, F.lit(False))).join(rest, "checkout_request_id", "left_semi"))


def settle_batches(spark: SparkSession, base: str, payments: DataFrame, packages: DataFrame) -> Callable[[DataFrame, int], None]:
    """Each batch's new first deliveries settle their payments (U5) and open sessions.

    A checkout is settled by its first delivery alone: later ones, in whatever batch, are
    removed by T1's ids before they reach a payment, so no payment settles twice and no
    second session opens.  Each batch overwrites its own ``batch_id=`` folders."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        first, record = unseen_first(batch, ledger(spark, base), batch_id)
        first.write.mode("overwrite").parquet(f"{base}/first/batch_id={batch_id}")
        cb = spark.read.schema(first.schema).parquet(f"{base}/first/batch_id={batch_id}")
        hit = answered_payments(payments, cb)
        U.settle_payments(hit, cb).where(F.col("changed")).write.mode("overwrite").parquet(f"{base}/payments/batch_id={batch_id}")
        changed = spark.read.parquet(f"{base}/payments/batch_id={batch_id}")
        done = changed.where(F.col("status") == "completed").select("payment_id", "user_id", "package_id",
                                                                    F.col("updated_at").alias("opened_at"))
        opened = done.join(packages.select("package_id", "duration_hours"), "package_id").select(
            (-F.col("payment_id")).alias("session_id"), "user_id", "package_id", "payment_id",
            F.col("opened_at").alias("started_at"),
            F.timestamp_add("HOUR", F.col("duration_hours"), F.col("opened_at")).alias("expires_at"),
            F.lit("active").alias("status"))
        opened.write.mode("overwrite").parquet(f"{base}/sessions/batch_id={batch_id}")
        record()
        batch.unpersist()
    return step


def publish_batches(spark: SparkSession, base: str, payments: VersionedTable, sessions: VersionedTable, packages: DataFrame) -> Callable[[DataFrame, int], None]:
    """T2 into published tables: each batch is one version of the payments (U5) and one of the sessions.

    Both are published under the batch's id, so whatever a crash left undone the replayed batch
    does, and what was done it leaves: a version that holds the batch is not written again."""
    def step(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        first, record = unseen_first(batch, ledger(spark, base), batch_id)
        first.write.mode("overwrite").parquet(f"{base}/first/batch_id={batch_id}")
        cb = spark.read.schema(first.schema).parquet(f"{base}/first/batch_id={batch_id}")
        PB.settle(payments, cb, ("settle", batch_id))
        paid = cb.where(F.col("result_code") == 0).select("checkout_request_id", F.col("received_at").alias("opened_at"))
        done = answered_payments(payments.read(), paid.withColumnRenamed("opened_at", "received_at")).where(F.col("status") == "completed")
        done = done.select("payment_id", "user_id", "package_id", "checkout_request_id").join(paid, "checkout_request_id")
        now = sessions.read()
        opened = (done.join(now.select("payment_id").where(F.col("payment_id").isNotNull()), "payment_id", "left_anti")
                  .join(packages.select("package_id", "duration_hours"), "package_id")
                  .select((-F.col("payment_id")).alias("session_id"), "user_id", "package_id", "payment_id", F.col("opened_at").alias("started_at"),
                          F.timestamp_add("HOUR", F.col("duration_hours"), F.col("opened_at")).alias("expires_at"), F.lit("active").alias("status")))
        rest = [F.lit(None if f.name in ("hotspot_user_id", "ended_at") else 0).cast(f.dataType).alias(f.name) for f in now.schema.fields if f.name not in opened.columns]
        sessions.append(opened.select("*", *rest).select(*now.columns), ("settle", batch_id))
        record()
        batch.unpersist()
    return step


def run_published(spark: SparkSession, callbacks: DataFrame, payments: DataFrame, sessions: DataFrame, packages: DataFrame,
                  slices: int = 3) -> tuple[DataFrame, DataFrame]:
    """T2 end to end into published tables: (payments, sessions) as the last version has them."""
    base = runner.run_folder(spark, "settle_published")
    pay, ses = PB.payments_table(spark, f"{base}/payments-table"), PB.sessions_table(spark, f"{base}/sessions-table")
    pay.replace(PB.with_settlement(payments)), ses.replace(sessions)
    replay = JsonReplay(callbacks, base, slices)
    replay.drain(lambda: runner.run_foreach_batch(callback_lines(spark, replay.paths[0]), base, publish_batches(spark, base, pay, ses, packages)))
    return pay.read(), ses.read()


def run_dedup(spark: SparkSession, callbacks: DataFrame, slices: int = 3) -> DataFrame:
    """T1 end to end: documents delivered in slices, the first delivery of each checkout kept."""
    base = runner.run_folder(spark, "callback_dedup")
    replay = JsonReplay(callbacks, base, slices)
    replay.drain(lambda: runner.run_foreach_batch(callback_lines(spark, replay.paths[0]), base, dedup_batches(spark, base)))
    return spark.read.parquet(f"{base}/first").drop("batch_id")


def run_settle(spark: SparkSession, callbacks: DataFrame, payments: DataFrame, packages: DataFrame, slices: int = 3) -> DataFrame:
    """T2 end to end: the payments that the delivered callbacks changed, each once."""
    base = runner.run_folder(spark, "settle_stream")
    replay = JsonReplay(callbacks, base, slices)
    replay.drain(lambda: runner.run_foreach_batch(callback_lines(spark, replay.paths[0]), base,
                                                  settle_batches(spark, base, payments, packages)))
    return spark.read.parquet(f"{base}/payments").drop("batch_id")
