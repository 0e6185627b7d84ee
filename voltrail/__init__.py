"""Charging analytics for electric vehicles, written as Spark DataFrame jobs."""
