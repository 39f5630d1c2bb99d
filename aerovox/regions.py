"""Named bounding boxes."""

from __future__ import annotations

from typing import NamedTuple


class Box(NamedTuple):
    lamin: float
    lamax: float
    lomin: float
    lomax: float


# Latitude and longitude limits per region name.
REGIONS = {
    "EUROPE": Box(35.0, 72.0, -25.0, 45.0),
    "NORTH_AMERICA": Box(7.0, 72.0, -168.0, -60.0),
    "SOUTH_AMERICA": Box(-56.0, 15.0, -90.0, -30.0),
    "ASIA": Box(-10.0, 82.0, 45.0, 180.0),
    "AUSTRALIA": Box(-50.0, -10.0, 110.0, 180.0),
    "AFRICA": Box(-35.0, 37.0, -20.0, 52.0),
    "GLOBAL": Box(-90.0, 90.0, -180.0, 180.0),
}

DEFAULT_REGION = "NORTH_AMERICA"


def region_box(name: str | None) -> Box:
    """Box of a region, by name in any case; no name means the default region."""
    key = (name or DEFAULT_REGION).upper()
    if key not in REGIONS:
        raise ValueError(f"unknown region {name!r}; choose one of {', '.join(REGIONS)}")
    return REGIONS[key]
