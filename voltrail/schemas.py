"""Column types of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, types as T


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(name, T._parse_datatype_string(kind)) for name, kind in fields.items()])


def battery_remote() -> T.StructType:
    """Message 68."""
    return _struct(vehicle="string", session="bigint", msg="bigint", ts="timestamp", session_clock="string",
                   vtype="int", load_level="bigint", charge_mode="int", status="int")


def battery_summary() -> T.StructType:
    """Message 79."""
    return _struct(vehicle="string", session="bigint", msg="bigint", ts="timestamp", session_clock="string",
                   vtype="int", summary_soc="double", charge_mode="int", status="int")


def vehicle_status() -> T.StructType:
    """Message 74."""
    return _struct(vehicle="string", session="bigint", msg="bigint", ts="timestamp", km="double",
                   soc="double", temperature="double", range_km="double")


def trips() -> T.StructType:
    return _struct(vehicle="string", msg_first="bigint", msg_last="bigint",
                   trip_start="timestamp", trip_stop="timestamp")


def code_map() -> T.StructType:
    return _struct(standard_name="string", short_code="string")


CHARGE_STATUS_COLUMNS = (
    "vtype", "vehicle",
    "session_start", "msg_type_start", "msg_start", "ts_start", "rts_start", "load_level_start",
    "summary_soc_start", "soc_start", "charge_mode_start", "status_start", "next_msg_start",
    "session_stop", "msg_type_stop", "msg_stop", "ts_stop", "rts_stop", "load_level_stop",
    "summary_soc_stop", "soc_stop", "charge_mode_stop", "status_stop",
    "soc_gain", "duration", "speed", "power", "power_class",
)

CHARGE_ENRICHED_COLUMNS = (
    "vehicle", "session_first", "session_last", "msg_first", "msg_last", "start", "stop",
    "soc_start", "soc_stop", "soc_first", "soc_last",
    "temperature_first", "temperature_last", "range_first", "range_last",
)

COMMON_COLUMNS = (
    "vehicle", "session_start", "session_stop", "msg_start", "msg_stop", "start", "stop",
    "soc_start", "soc_stop", "hours", "soc_gain",
)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fail early, with the missing names, when a table lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
