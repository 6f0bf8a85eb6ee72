"""Settlement callback parsing and result-code classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..columns import as_col

_ITEM = T.StructType([T.StructField("Name", T.StringType()), T.StructField("Value", T.StringType())])
CALLBACK_SCHEMA = T.StructType([T.StructField("Body", T.StructType([T.StructField("stkCallback", T.StructType([
    T.StructField("MerchantRequestID", T.StringType()),
    T.StructField("CheckoutRequestID", T.StringType()),
    T.StructField("ResultCode", T.LongType()),
    T.StructField("ResultDesc", T.StringType()),
    T.StructField("CallbackMetadata", T.StructType([T.StructField("Item", T.ArrayType(_ITEM))])),
]))]))])

# Result codes the status poll treats as final failures.
FAILURE_CODES = (1, 1032, 1037, 2001, 1001, 1019, 9999, 17)


def item(items: Column, name: str) -> Column:
    """Value of the first metadata item called ``name`` (NULL when absent)."""
    return F.get(F.filter(items, lambda x: x["Name"] == F.lit(name)), 0)["Value"]


_AMOUNT = "decimal(10,2)"


def _read(raw: DataFrame, body_col: str) -> DataFrame:
    """``raw`` with the parsed document ``_cb`` and ``_reason``, why it cannot be read (NULL: it can).

    A wrong type makes only its own field NULL, so a field that is NULL is compared with the
    raw text: absent is fine, present and unreadable is a reason."""
    body = F.col(body_col)

    def given(path: str) -> Column:
        return F.get_json_object(body, f"$.Body.stkCallback{path}").isNotNull()

    cb = F.col("_cb")
    amount = item(cb["CallbackMetadata"]["Item"], "Amount")
    reason = (F.when(cb.isNull(), F.when(F.get_json_object(body, "$").isNull(), "not_json").otherwise("no_body"))
              .when(cb["ResultCode"].isNull() & given(".ResultCode"), "bad_result_code")
              .when(cb["CallbackMetadata"].isNull() & given(".CallbackMetadata"), "bad_metadata")
              .when(cb["CallbackMetadata"]["Item"].isNull() & given(".CallbackMetadata.Item"), "bad_metadata")
              .when(amount.isNotNull() & amount.try_cast(_AMOUNT).isNull(), "bad_amount"))
    # as a generated row, so that a filter on the reason is not turned into further parses of the body
    doc = F.explode(F.array(F.from_json(body, CALLBACK_SCHEMA)["Body"]["stkCallback"]))
    return raw.select("*", doc.alias("_cb")).withColumn("_reason", reason)


def parse_callbacks(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """Callback JSON -> typed columns; items pivoted by name.

    ``Value`` is read as STRING because the items mix numbers and text.  Documents that cannot
    be read are skipped here and returned by :func:`rejected_callbacks`; none fails the job."""
    items = F.col("_cb")["CallbackMetadata"]["Item"]
    keep = [c for c in raw.columns if c != body_col]
    return _read(raw, body_col).where(F.col("_reason").isNull()).select(
        *keep,
        F.col("_cb")["CheckoutRequestID"].alias("checkout_request_id"),
        F.col("_cb")["ResultCode"].alias("result_code"),
        F.col("_cb")["ResultDesc"].alias("result_desc"),
        item(items, "Amount").try_cast(_AMOUNT).alias("amount_kes"),
        item(items, "MpesaReceiptNumber").alias("receipt_number"),
        item(items, "TransactionDate").alias("transaction_date"),
        item(items, "PhoneNumber").alias("phone_number"),
    )


def rejected_callbacks(raw: DataFrame, body_col: str = "body") -> DataFrame:
    """C8's side output: the documents that :func:`parse_callbacks` skips, with reason and raw body."""
    return _read(raw, body_col).where(F.col("_reason").isNotNull()).select(*raw.columns, F.col("_reason").alias("reason"))


def poll_outcome(code: Column | str) -> Column:
    """C10, status-poll path: 0 completed, listed codes failed, anything else still pending."""
    c = as_col(code)
    return F.when(c == 0, "completed").when(c.isin(*FAILURE_CODES), "failed").otherwise("pending")


def callback_outcome(code: Column | str) -> Column:
    """C10, callback path: 0 completed, any other code failed."""
    c = as_col(code)
    return F.when(c == 0, "completed").otherwise("failed")
