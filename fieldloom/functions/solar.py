"""The sun: declination, equation of time, altitude and azimuth, and day length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_angle(day: Column, hour: Column) -> Column:
    """Angle of the year in radians from the day of the year and the hour in UTC."""
    return 2 * F.pi() / 365 * (day - 1 + (hour - 12) / 24)


def declination(angle: Column) -> Column:
    """Radians, by a Fourier series."""
    c, s = (lambda k: F.cos(k * angle)), (lambda k: F.sin(k * angle))
    return 0.006918 - 0.399912 * c(1) + 0.070257 * s(1) - 0.006758 * c(2) + 0.000907 * s(2) - 0.002697 * c(3) + 0.00148 * s(3)


def equation_of_time(angle: Column) -> Column:
    """Minutes."""
    return 229.18 * (0.000075 + 0.001868 * F.cos(angle) - 0.032077 * F.sin(angle) - 0.014615 * F.cos(2 * angle) - 0.040849 * F.sin(2 * angle))


def altitude(lat: Column, lon: Column, day: Column, hour: Column) -> Column:
    """Degrees above the horizon."""
    angle = year_angle(day, hour)
    turn = F.radians((hour * 60 + equation_of_time(angle) + 4 * lon) / 4 - 180)
    dec, phi = declination(angle), F.radians(lat)
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(phi) * F.sin(dec) + F.cos(phi) * F.cos(dec) * F.cos(turn)))))


def day_length(lat: Column, day: Column) -> Column:
    """Minutes between rise and set; 0 in the polar night, 1440 on a polar day."""
    dec, phi = declination(year_angle(day, F.lit(12.0))), F.radians(lat)
    x = (F.cos(F.radians(F.lit(90.833))) - F.sin(phi) * F.sin(dec)) / (F.cos(phi) * F.cos(dec))
    return F.when(x >= 1, 0.0).when(x <= -1, 1440.0).otherwise(8 * F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))))
