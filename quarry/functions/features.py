"""The 14 features of a request, in single precision."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.times import is_time, minutes_between, part, weekday
from quarry.functions.vectors import clamp, f32, quantize
from quarry.schemas import AMOUNT_RATIO, DEFAULT_RISK, MAX_AMOUNT, MAX_HOUR, MAX_INSTALLMENTS, MAX_KM, MAX_MERCHANT_AMOUNT, MAX_MINUTES, MAX_TX_24H, MAX_WEEKDAY, MCC_RISK, UINT32_MAX, Q, V


def _share(x: Column, most: float) -> Column:
    return x.cast("float") * f32(1 / most)


def mcc_risk(mcc: Column) -> Column:
    known = F.create_map(*chain.from_iterable((F.lit(k), f32(v)) for k, v in MCC_RISK.items()))
    return F.coalesce(F.element_at(known, F.coalesce(mcc, F.lit(""))), f32(DEFAULT_RISK))


def is_known(merchant: Column, known: Column) -> Column:
    """Whether a merchant is in a list; a null list is empty, and a null element an empty name."""
    name = F.coalesce(merchant, F.lit(""))
    # null where it is not found but might be a null element
    return F.coalesce(F.array_contains(F.coalesce(known, F.array().cast("array<string>")), name), name == "")


def amount_ratio(amount: Column, average: Column) -> Column:
    """Amount over the customer's average, over AMOUNT_RATIO; 1 without an average."""
    return F.when(average > 0, clamp((amount / average).cast("float") * f32(1 / AMOUNT_RATIO))).otherwise(f32(1))


def _number(name: str, kind: str = "float") -> Column:
    return F.coalesce(F.col(name), F.lit(0)).cast(kind)


def request_status() -> Column:
    """400 for a blank or misshapen time of the request or of a last transaction that is there, or a count out of range; else 200."""
    bad = [~is_time(F.col("transaction.requested_at")), F.col("last_transaction").isNotNull() & ~is_time(F.col("last_transaction.timestamp"))]
    bad += [~_number(c, "long").between(0, UINT32_MAX) for c in ("transaction.installments", "customer.tx_count_24h")]
    out = F.lit(False)
    for b in bad:
        out = out | b
    return F.when(out, 400).otherwise(200)


def features() -> list[Column]:
    """v0..v13 of a request; only for rows whose status is 200."""
    at, last = F.col("transaction.requested_at"), F.col("last_transaction")
    amount = _number("transaction.amount")
    missing = last.isNull()
    return [
        clamp(_share(amount, MAX_AMOUNT)),
        clamp(_share(_number("transaction.installments", "long"), MAX_INSTALLMENTS)),
        amount_ratio(amount, _number("customer.avg_amount")),
        _share(part(at, "hour"), MAX_HOUR),
        _share(weekday(at), MAX_WEEKDAY),
        F.when(missing, f32(-1)).otherwise(clamp(_share(minutes_between(at, F.col("last_transaction.timestamp")), MAX_MINUTES))),
        F.when(missing, f32(-1)).otherwise(clamp(_share(_number("last_transaction.km_from_current"), MAX_KM))),
        clamp(_share(_number("terminal.km_from_home"), MAX_KM)),
        clamp(_share(_number("customer.tx_count_24h", "long"), MAX_TX_24H)),
        F.coalesce(F.col("terminal.is_online"), F.lit(False)).cast("float"),
        F.coalesce(F.col("terminal.card_present"), F.lit(False)).cast("float"),
        (~is_known(F.col("merchant.id"), F.col("customer.known_merchants"))).cast("float"),
        mcc_risk(F.col("merchant.mcc")),
        clamp(_share(_number("merchant.avg_amount"), MAX_MERCHANT_AMOUNT)),
    ]


def vectorize(requests: DataFrame) -> DataFrame:
    """requests with status, v0..v13 and q0..q13; vectors are null where the status is not 200."""
    df = requests if "status" in requests.columns else requests.withColumn("status", request_status())
    ok = F.col("status") == 200
    df = df.withColumns({n: F.when(ok, x) for n, x in zip(V, features(), strict=True)})
    return df.withColumns({q: quantize(F.col(v)) for q, v in zip(Q, V, strict=True)})
