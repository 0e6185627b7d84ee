"""Vehicle lists and equipment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voltrail.functions.codes import configured_secret, pseudonym, slot_index, slot_value


def only_vehicles(df: DataFrame, vehicles: DataFrame) -> DataFrame:
    """Rows of the listed vehicles; Spark broadcasts the list when it is small enough."""
    return df.join(vehicles.select("vehicle"), "vehicle", "left_semi")


def equipped(vehicles: DataFrame, positions: DataFrame, labels: DataFrame, characteristic: str, value: str) -> DataFrame:
    """Vehicles whose code holds ``value`` for one characteristic, with its label for their family."""
    chosen = positions.filter(F.col("characteristic") == characteristic)
    where = chosen.agg(F.min("position")).scalar()
    decoded = vehicles.withColumn("_position", where).withColumn("value", slot_value(F.col("code"), F.col("_position")))
    decoded = decoded.filter(F.col("value") == value).withColumn("index", slot_index(F.col("code"), F.col("_position")))
    names = labels.filter(F.col("characteristic") == characteristic).select("value", "family", "designation")
    return decoded.drop("_position").join(names, ["value", "family"], "left")


def family_labels(vehicles: DataFrame, families: DataFrame) -> DataFrame:
    return vehicles.join(families, "family")


def anonymised(df: DataFrame, secret: str | None = None, column: str = "vehicle", name: str = "pseudonym", algorithm: str = "md5") -> DataFrame:
    """Replace an id by its keyed hash, at the same place among the columns.

    Without ``secret`` the session's setting is used.
    """
    secret = secret or configured_secret(df.sparkSession)
    return df.select([pseudonym(F.col(c), secret, algorithm).alias(name) if c == column else F.col(c) for c in df.columns])
