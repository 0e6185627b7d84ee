"""Add the first and last message-74 readings to refined charges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voltrail.operators.intervals import points_inside
from voltrail.operators.refine import BIN, TIME_BIN
from voltrail.schemas import CHARGE_ENRICHED_COLUMNS

READINGS = {"temperature": "temperature", "range": "range_km", "soc": "soc"}


def charge_endpoints(charges: DataFrame, messages: DataFrame) -> DataFrame:
    """First and last message, by (session, msg), among those inside the charges of each start."""
    spans = charges.select("vehicle", "start", "stop").distinct()
    bins = [BIN] if BIN in messages.columns else []
    points = messages.select("vehicle", "session", "msg", "ts", *READINGS.values(), *bins)
    inside = points_inside(points, spans, ["vehicle"], F.unix_seconds("ts"), F.unix_seconds("start"),
                           F.unix_seconds("stop"), TIME_BIN, F.col("ts").between(F.col("start"), F.col("stop")), *bins)
    row, place = F.struct("session", "msg", *READINGS.values()), F.struct("session", "msg")
    ends = inside.groupBy("vehicle", "start").agg(F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"))
    columns = []
    for end in ("first", "last"):
        columns += [F.col(f"{end}.session").alias(f"session_{end}"), F.col(f"{end}.msg").alias(f"msg_{end}")]
        columns += [F.col(f"{end}.{source}").alias(f"{name}_{end}") for name, source in READINGS.items()]
    return ends.select("vehicle", "start", *columns)


def enrich(charges: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Refined charges with their end readings; a charge without messages keeps nulls."""
    return charges.join(endpoints, ["vehicle", "start"], "left").select(*CHARGE_ENRICHED_COLUMNS).distinct()
