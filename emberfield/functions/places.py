"""Positions: grid keys, planar projections, polygon tests, zones and links."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import fixed_text

# Sphere radii (metres) of the two planar projections.
SINUSOIDAL_RADIUS_M = 6371000.0
MERCATOR_RADIUS_M = 6378137.0

# West, south, east, north of the fetch area and of the wider plausibility area.
FETCH_BOX = (68.1, 7.9, 97.4, 35.5)
PLAUSIBLE_BOX = (68.0, 6.5, 97.5, 37.5)


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Inclusive bounding-box test; false for missing coordinates."""
    west, south, east, north = box
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def round_cell(value: Column, size: float = 0.01) -> Column:
    """Index of the nearest multiple of ``size``, ties to even."""
    return F.rint(value / size).cast("bigint")


def floor_cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("bigint")


def sinusoidal(lat: Column, lon: Column) -> tuple[Column, Column]:
    x = F.radians(lon) * SINUSOIDAL_RADIUS_M * F.cos(F.radians(lat))
    return x, F.radians(lat) * SINUSOIDAL_RADIUS_M


def mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    x = F.radians(lon) * MERCATOR_RADIUS_M
    y = F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * MERCATOR_RADIUS_M
    return x, y


def crossing_x(y: Column, e: Column) -> Column:
    """Where the line through an edge (x1, y1, x2, y2) meets the height ``y``."""
    return (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]


def touches_edge(x: Column, y: Column, e: Column) -> Column:
    """Whether a point lies on an edge."""
    turn = (e["x2"] - e["x1"]) * (y - e["y1"]) - (e["y2"] - e["y1"]) * (x - e["x1"])
    return (
        (turn == 0)
        & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )


def edge_distance(x: Column, y: Column, edges: Column) -> Column:
    """Distance from a point to the nearest edge, in the units of the coordinates."""

    def one(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        along = F.coalesce(
            F.try_divide((x - e["x1"]) * dx + (y - e["y1"]) * dy, dx * dx + dy * dy), F.lit(0.0)
        )
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), along))
        px, py = x - (e["x1"] + t * dx), y - (e["y1"] + t * dy)
        return F.sqrt(px * px + py * py)

    return F.array_min(F.transform(edges, one))


# Zone names, from south to north.
DEFAULT_ZONE = "Gangetic Plain (UP/BR/WB)"
SOUTH = "Southern Zone (TN/KL/KA)"
WEST_GHATS = "Maharashtra / Western Ghats"
EAST_DECCAN = "Eastern Deccan (AP/Telangana)"
WEST_COAST = "Gujarat / West Coast"
CENTRAL = "Central India (MP/CG/OD)"
NORTHWEST = "Northwest (PB/HR/RJ)"


def zone(lat: Column, lon: Column) -> Column:
    """Geographic zone; positions that meet no condition, also missing ones, get the default."""
    return (
        F.when(lat < 14.0, SOUTH)
        .when((lat < 20.0) & (lon < 78.0), WEST_GHATS)
        .when((lat < 20.0) & (lon >= 78.0), EAST_DECCAN)
        .when((lat < 25.0) & (lon < 75.0), WEST_COAST)
        .when((lat < 25.0) & (lon >= 75.0), CENTRAL)
        .when((lat >= 25.0) & (lon < 78.0), NORTHWEST)
        .otherwise(DEFAULT_ZONE)
    )


# The two link forms.
ALERT_LINK = "https://www.google.com/maps?q="
FEED_LINK = "https://maps.google.com/?q="


def map_link(lat: Column, lon: Column, base: str = ALERT_LINK) -> Column:
    """Map URL with five decimals; null when a coordinate is missing."""
    return F.concat(F.lit(base), fixed_text(lat, 5), F.lit(","), fixed_text(lon, 5))
