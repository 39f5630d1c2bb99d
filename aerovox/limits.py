"""Bounds of numeric arguments."""

from __future__ import annotations


def check_range(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must be between {low} and {high}, not {value}")
