"""Output units and the rounding of answers."""

from __future__ import annotations

TEMPERATURES = ("TAVG", "TMAX", "TMIN")
UNIT_NAMES = {"TAVG": "F", "TMAX": "F", "TMIN": "F", "PRCP": "in", "SNOW": "in", "SNWD": "in", "AWND": "mph", "HDD": "degree days", "CDD": "degree days"}


def converted(value: float | None, metric: str, unit: str | None = None, spread: bool = False) -> float | None:
    """A temperature in Celsius if asked; a spread has no offset."""
    if value is None or unit != "C" or metric not in TEMPERATURES:
        return value
    return value * 5 / 9 if spread else (value - 32) * 5 / 9


def shown(value: float | None, aggregation: str, event_value: str | None = None) -> float | int | None:
    """Counts and durations whole, all else to one decimal."""
    if value is None:
        return None
    return round(value) if aggregation in ("count", "record_high", "record_low") or event_value == "duration" else round(value, 1)


def percent(share: float | None) -> float | None:
    return None if share is None else round(100 * share, 1)
