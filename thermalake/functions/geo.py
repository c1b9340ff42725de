"""Geodesy of geostationary views as column functions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """A geostationary view over an ellipsoid: radii and height from the Earth's centre in metres, longitude in degrees."""

    longitude: float
    equatorial: float = 6378137.0
    polar: float = 6356752.31414
    distance: float = 42164160.0


def normalize_longitude(degrees: Column) -> Column:
    """Degrees in [-180, 180)."""
    shifted = degrees + 180.0
    return shifted - 360.0 * F.floor(shifted / 360.0) - 180.0


def geocentric(latitude: Column, view: View) -> tuple[Column, Column]:
    """Geocentric latitude in radians and the distance of the surface from the centre."""
    ratio = (view.polar / view.equatorial) ** 2
    phi = F.atan(F.tan(F.radians(latitude)) * ratio)
    flat = 1 - ratio
    return phi, F.lit(view.polar) / F.sqrt(1.0 - flat * F.pow(F.cos(phi), F.lit(2.0)))


def to_scan_angles(latitude: Column, longitude: Column, view: View) -> tuple[Column, Column]:
    """Scan angles x and y in radians; null where the point is beyond the horizon."""
    phi, radius = geocentric(latitude, view)
    east = F.radians(longitude - view.longitude)
    sx = F.lit(view.distance) - radius * F.cos(phi) * F.cos(east)
    sy = -radius * F.cos(phi) * F.sin(east)
    sz = radius * F.sin(phi)
    ratio = (view.equatorial / view.polar) ** 2
    seen = F.lit(view.distance) * (F.lit(view.distance) - sx) >= sy * sy + ratio * sz * sz
    x = F.asin(-sy / F.sqrt(sx * sx + sy * sy + sz * sz))
    return F.when(seen, x), F.when(seen, F.atan(sz / sx))


def from_scan_angles(x: Column, y: Column, view: View, height: Column | None = None) -> tuple[Column, Column]:
    """Latitude and longitude in degrees of the first point that a ray meets, on an ellipsoid raised by `height` metres."""
    rise = F.coalesce(height, F.lit(0.0)) if height is not None else F.lit(0.0)
    equatorial, polar = F.lit(view.equatorial) + rise, F.lit(view.polar) + rise
    ratio = F.pow(equatorial / polar, F.lit(2.0))
    cx, cy, sn_x, sn_y = F.cos(x), F.cos(y), F.sin(x), F.sin(y)
    a = sn_x * sn_x + cx * cx * (cy * cy + ratio * sn_y * sn_y)
    b = -2.0 * view.distance * cx * cy
    c = F.lit(view.distance**2) - equatorial * equatorial
    inner = b * b - 4.0 * a * c
    r = (-b - F.sqrt(F.when(inner >= 0, inner))) / (2.0 * a)
    sx, sy, sz = r * cx * cy, -r * sn_x, r * cx * sn_y
    latitude = F.degrees(F.atan(ratio * sz / F.sqrt(F.pow(F.lit(view.distance) - sx, F.lit(2.0)) + sy * sy)))
    longitude = F.lit(view.longitude) - F.degrees(F.atan(sy / (F.lit(view.distance) - sx)))
    return latitude, longitude


def local_zenith(latitude: Column, longitude: Column, view: View) -> Column:
    """Zenith angle of the satellite in degrees, on a sphere of the local radius."""
    phi, radius = geocentric(latitude, view)
    beta = F.acos(F.cos(phi) * F.cos(F.radians(longitude - view.longitude)))
    distance = F.sqrt(
        F.lit(view.distance**2) + radius * radius - 2.0 * view.distance * radius * F.cos(beta)
    )
    sine = F.lit(view.distance) * F.sin(beta) / distance
    return F.degrees(F.asin(F.least(sine, F.lit(1.0))))


def authalic_radius(equatorial: float, polar: float) -> float:
    """Radius of the sphere with the ellipsoid's surface."""
    e = math.sqrt(1 - (polar / equatorial) ** 2)
    part = math.atanh(e) / e if e > 1e-12 else 1.0
    return equatorial * math.sqrt((1 + (1 - e * e) * part) / 2)


def sinusoidal(latitude: Column, longitude: Column, central: float, radius: float) -> tuple[Column, Column]:
    """Equal-area plane coordinates in metres."""
    return radius * F.radians(longitude - central) * F.cos(F.radians(latitude)), radius * F.radians(latitude)


def inverse_sinusoidal(x: Column, y: Column, central: float, radius: float) -> tuple[Column, Column]:
    latitude = y / radius
    return F.degrees(latitude), F.lit(central) + F.degrees(x / (radius * F.cos(latitude)))


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float) -> Column:
    """Distance by the haversine formula, in the unit of the radius."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2.0), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2.0 * radius * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def parallax(latitude: Column, longitude: Column, height: Column, view: View) -> tuple[Column, Column]:
    """Where a cloud top of a height in metres, seen at a place, stands; a height that is null or NaN counts as 0.

    The ray of the place's scan angles meets the ellipsoid raised by the height.
    """
    x, y = to_scan_angles(latitude, longitude, view)
    return from_scan_angles(x, y, view, F.when(height.isNull() | F.isnan(height), 0.0).otherwise(height))
