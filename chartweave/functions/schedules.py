"""Schedules of weights over training, as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def progress(epoch: Column, epochs: int) -> Column:
    return epoch / F.lit(float(max(epochs - 1, 1)))


def ramp(kind: str, epoch: Column, epochs: int, low: float, high: float) -> Column:
    """none: high; linear; exponential: low (high / low)^t; cosine: half a period from low to high."""
    t = progress(epoch, epochs)
    if kind == "none":
        return F.lit(high) + 0.0 * t
    if kind == "linear":
        return low + (high - low) * t
    if kind == "exponential":
        if low <= 0:
            raise ValueError("an exponential ramp needs a positive start")
        return low * F.pow(F.lit(high / low), t)
    if kind == "cosine":
        return low + (high - low) * (1 - F.cos(math.pi * t)) / 2
    raise ValueError(f"unknown ramp: {kind}")


def sigmoid_ramp(epoch: Column, epochs: int, steepness: float) -> Column:
    """The share of the later loss: a logistic step at half of training."""
    return 1 / (1 + F.exp(-F.lit(steepness) * (epoch - epochs / 2)))


def fold_bounds(folds: int, low: float, high: float) -> list[tuple[float, float]]:
    """Each fold's part of the cosine ramp from low to high."""
    at = lambda k: low + (high - low) * (1 - math.cos(math.pi * k / folds)) / 2
    return [(at(k), at(k + 1)) for k in range(folds)]
