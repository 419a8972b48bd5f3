"""Local east, north, up coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Equatorial radius (m) and eccentricity of the ellipsoid.
RADIUS, ECCENTRICITY = 6378137.0, 0.08181919
NO_FIX = 0.001


def radii(lat: Column) -> tuple[Column, Column]:
    """Radii of curvature along the meridian and across it, at a latitude in radians."""
    w = 1 - ECCENTRICITY**2 * F.pow(F.sin(lat), F.lit(2.0))
    return RADIUS * (1 - ECCENTRICITY**2) / F.pow(w, F.lit(1.5)), RADIUS / F.sqrt(w)


def enu(lat: Column, lon: Column, alt: Column, lat0: Column, lon0: Column, alt0: Column, flat: bool = False) -> tuple[Column, ...]:
    """East, north and, unless flat, up in metres from an origin; angles in radians."""
    along, across = radii(lat0)
    east, north = (lon - lon0) * (across + alt0) * F.cos(lat0), (lat - lat0) * (along + alt0)
    return (east, north) if flat else (east, north, alt - alt0)


def series_to_enu(positions: DataFrame) -> DataFrame:
    """positions(log_id, t, seq, lat, lon, alt) -> (log_id, t, seq, E, N, U, lat0, lon0, alt0).

    Degrees; a log whose largest value is over 180 has 1e-7 degrees.  The origin is the first row with values and a fix
    (both angles over 0.001), else the first with values, else 0.  Rows without values or fix are null.
    """
    w = Window.partitionBy("log_id")
    scaled = positions
    for c in ("lat", "lon"):
        scaled = scaled.withColumn(c, F.when(F.max(F.abs(F.nanvl(c, F.lit(None)))).over(w) > 180, F.col(c) / 1e7).otherwise(F.col(c)))
    valid = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("alt").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon") & ~F.isnan("alt")
    fix = valid & (F.abs("lat") > NO_FIX) & (F.abs("lon") > NO_FIX)
    place, order = F.struct("lat", "lon", "alt"), F.struct("t", "seq")
    first = F.coalesce(F.min_by(F.when(fix, place), F.when(fix, order)).over(w), F.min_by(F.when(valid, place), F.when(valid, order)).over(w))
    rows = scaled.withColumn("o", first)
    lat0, lon0, alt0 = (F.coalesce(F.col(f"o.{c}"), F.lit(0.0)) for c in ("lat", "lon", "alt"))
    shown = valid & ~((F.abs("lat") < NO_FIX) & (F.abs("lon") < NO_FIX))
    east, north, up = enu(F.radians("lat"), F.radians("lon"), F.col("alt"), F.radians(lat0), F.radians(lon0), alt0)
    return rows.select("log_id", "t", "seq", F.when(shown, east).alias("E"), F.when(shown, north).alias("N"), F.when(shown, up).alias("U"), lat0.alias("lat0"), lon0.alias("lon0"), alt0.alias("alt0"))
