"""State of charge, charging speed and power."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values of the telemetry standard.
BEV = 25
PHEV = 26
INVALID_SOC = 999
SUMMARY_INVALID = (102.2, 102.3)
SUMMARY_INVALID_BEV = (0.0,)
REMOTE_INVALID = (127,)
REMOTE_INVALID_PHEV = (66,)
PHEV_OFFSET = 21.897
PHEV_SCALE = 0.7246
KW_PER_SPEED = {BEV: 0.56, PHEV: 0.12}
POWER_CLASSES = (
    (1.2, "0-Uncertain <1.2kW"),
    (2.7, "1-Standard 1.8kW(<2.7)"),
    (5.5, "2-GreenUp 3.7kW(<5.5)"),
    (9.2, "3-WallBox 7kW(<9.2)"),
    (20.0, "4-WallBox 11kW(<20)"),
    (80.0, "5-DCcharger<80kW"),
)
POWER_UNCLASSED = "6-not classified"


def clean_sentinel(vtype: Column, value: Column, invalid: Sequence[float],
                   bev: Sequence[float] = (), phev: Sequence[float] = ()) -> Column:
    """999 where the value is one of the vehicle type's sentinels; null stays null."""
    listed = value.isin(*invalid)
    if bev:
        listed = listed | ((vtype == BEV) & value.isin(*bev))
    if phev:
        listed = listed | ((vtype == PHEV) & value.isin(*phev))
    return F.when(listed, F.lit(INVALID_SOC)).otherwise(value)


def displayed_soc(vtype: Column, soc: Column) -> Column:
    """The percentage the driver sees, from the battery summary's raw percentage."""
    scaled = F.greatest(F.lit(0.0), F.least(F.lit(100.0), (soc - PHEV_OFFSET) / PHEV_SCALE))
    return (F.when(soc.isNull() | (soc == INVALID_SOC), INVALID_SOC)
            .when(vtype == BEV, soc.cast("long"))
            .when(vtype == PHEV, F.bround(scaled).cast("long"))
            .otherwise(INVALID_SOC).cast("long"))


def charge_speed(gain: Column, seconds: Column) -> Column:
    """Percent per hour with one decimal, cut toward zero."""
    tenths = (36000 * gain.cast("double") / seconds).cast("long")
    return F.when(seconds > 0, tenths / 10).cast("float")


def charge_kw(vtype: Column, speed: Column) -> Column:
    """Power from speed; kept in float32, which decides the class at the cut points."""
    kw = F.when(vtype == BEV, KW_PER_SPEED[BEV] * speed.cast("double"))
    return kw.when(vtype == PHEV, KW_PER_SPEED[PHEV] * speed.cast("double")).cast("float")


def power_class(kw: Column) -> Column:
    value = kw.cast("double")
    label = F.when(value.isNull() | (value < 0), POWER_UNCLASSED)
    for limit, name in POWER_CLASSES:
        label = label.when(value < limit, name)
    return label.otherwise(POWER_UNCLASSED)
