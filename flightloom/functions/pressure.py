"""Barometric height. Out-of-range readings give null instead of an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flightloom import params as P

_SCALE_M = 44330.0
_EXPONENT = 5.255


def altitude_from_pressure(hpa: Column, sea_level: Column) -> Column:
    fine = hpa.between(P.PRESSURE_MIN_HPA, P.PRESSURE_MAX_HPA) & sea_level.between(
        P.SEA_LEVEL_MIN_HPA, P.SEA_LEVEL_MAX_HPA
    )
    return F.when(fine, (1.0 - F.pow(hpa / F.nullif(sea_level, F.lit(0.0)), F.lit(1.0 / _EXPONENT))) * _SCALE_M)


def sea_level_pressure(hpa: Column, altitude: Column) -> Column:
    level = hpa / F.pow(1.0 - altitude / _SCALE_M, F.lit(_EXPONENT))
    fine = hpa.between(P.PRESSURE_MIN_HPA, P.PRESSURE_MAX_HPA) & level.between(
        P.SEA_LEVEL_MIN_HPA, P.SEA_LEVEL_MAX_HPA
    )
    return F.when(fine, level)


def pressure_from_altitude(altitude: Column) -> Column:
    return F.pow(1.0 - altitude / _SCALE_M, F.lit(_EXPONENT)) * P.STANDARD_SEA_LEVEL_HPA
