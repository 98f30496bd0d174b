"""WGS-84 positions, local frames and fault-profile projection (Column -> Column)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
POLAR = AXIS * (1 - FLATTENING)
EP2 = E2 / (1 - E2)


def geodetic_to_ecef(lat: Column, lon: Column, height: Column) -> tuple[Column, Column, Column]:
    """Degrees and metres -> X, Y, Z."""
    p, l = F.radians(lat), F.radians(lon)
    n = AXIS / F.sqrt(1 - E2 * F.sin(p) * F.sin(p))
    return (n + height) * F.cos(p) * F.cos(l), (n + height) * F.cos(p) * F.sin(l), (n * (1 - E2) + height) * F.sin(p)


def ecef_to_geodetic(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """X, Y, Z -> latitude, longitude (degrees) and height, by the closed form over the reduced latitude."""
    r = F.hypot(x, y)
    reduced = F.atan2(z * AXIS, r * POLAR)
    lat = F.atan2(z + EP2 * POLAR * F.pow(F.sin(reduced), 3), r - E2 * AXIS * F.pow(F.cos(reduced), 3))
    # One correction step brings the latitude of points near the surface to rounding error.
    again = F.atan2((1 - FLATTENING) * F.sin(lat), F.cos(lat))
    lat = F.atan2(z + EP2 * POLAR * F.pow(F.sin(again), 3), r - E2 * AXIS * F.pow(F.cos(again), 3))
    n = AXIS / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    height = r * F.cos(lat) + z * F.sin(lat) - AXIS * AXIS / n
    return F.degrees(lat), F.degrees(F.atan2(y, x)), height


def ecef_to_enu(x: Column, y: Column, z: Column, origin: tuple[Column, Column, Column], at: tuple[Column, Column]) -> tuple[Column, Column, Column]:
    """East, north and up of X, Y, Z about an origin (X, Y, Z) whose latitude and longitude in degrees are at."""
    dx, dy, dz = x - origin[0], y - origin[1], z - origin[2]
    p, l = F.radians(at[0]), F.radians(at[1])
    inward = F.cos(l) * dx + F.sin(l) * dy
    return F.cos(l) * dy - F.sin(l) * dx, F.cos(p) * dz - F.sin(p) * inward, F.cos(p) * inward + F.sin(p) * dz


def geodetic_to_enu(lat: Column, lon: Column, height: Column, lat0: Column, lon0: Column, height0: Column) -> tuple[Column, Column, Column]:
    return ecef_to_enu(*geodetic_to_ecef(lat, lon, height), geodetic_to_ecef(lat0, lon0, height0), (lat0, lon0))


def km_to_degrees(east: Column, north: Column, lon0: Column, lat0: Column, km: float = 111.325) -> tuple[Column, Column]:
    """Local kilometres about lon0, lat0 -> longitude, latitude."""
    lat = lat0 + north / km
    return lon0 + east / (km * F.cos(F.radians(lat0))), lat


#: C and VO of each antenna model in metres.
ANTENNAS = {"TRM22020.00+gp": (0.2334, 0.0591), "TRM41249.00": (0.1698, 0.0443), "TRM55971-00": (0.1698, 0.0444), "TRM57971-00": (0.1698, 0.04435), "TRM115000": (0.16981, 0.04434)}


def antenna_height(model: Column, slants: list[Column]) -> Column:
    """sqrt(slant^2 - C^2) - VO of the mean slant height, by the model's constants; null for an unknown model."""
    mean = sum(slants[1:], slants[0]) / len(slants)
    own = F.try_element_at(F.create_map(*[x for name, pair in ANTENNAS.items() for x in (F.lit(name), F.array(*map(F.lit, pair)))]), model)
    return F.sqrt(mean * mean - F.get(own, 0) * F.get(own, 0)) - F.get(own, 1)


def azimuth_components(east: Column, north: Column, azimuth_deg: float) -> tuple[Column, Column]:
    """Components along an azimuth (clockwise from north) and to its right."""
    s, c = math.sin(math.radians(azimuth_deg)), math.cos(math.radians(azimuth_deg))
    return east * s + north * c, east * c - north * s
