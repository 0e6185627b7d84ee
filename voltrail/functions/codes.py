"""Vehicle ids and fixed-width equipment codes."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, functions as F

SECRET_SETTING = "spark.voltrail.pseudonym.secret"


def configured_secret(spark: SparkSession) -> str:
    """The secret of the session's settings; there is no default."""
    secret = spark.conf.get(SECRET_SETTING, None)
    if not secret:
        raise ValueError(f"set {SECRET_SETTING}")
    return secret


def pseudonym(value: Column, secret: str, algorithm: str = "md5") -> Column:
    """Keyed hash of an id; null stays null. ``algorithm`` is md5 or sha2."""
    keyed = F.concat(value.cast("string"), F.lit(secret))
    if algorithm == "md5":
        return F.md5(keyed)
    if algorithm == "sha2":
        return F.sha2(keyed, 256)
    raise ValueError(f"unknown algorithm {algorithm!r}")


def slot_value(code: Column, position: Column) -> Column:
    """The two value characters of one three-character slot (positions from 1)."""
    return F.substring(code, 3 * (position - 1) + 1, F.lit(2))


def slot_index(code: Column, position: Column) -> Column:
    """The index character that ends the slot."""
    return F.substring(code, 3 * (position - 1) + 3, F.lit(1))
