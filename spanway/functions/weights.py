"""Profiles (densities over an event) and decay functions (weights by step)."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(t: Column) -> Column:
    return t


def triangular(t: Column) -> Column:
    return F.when(t < 0.5, 2 * t * t).otherwise(-2 * t * t + 4 * t - 1)


def parabolic(t: Column) -> Column:
    return 3 * t * t - 2 * t * t * t


def trapezoidal(ramp: float = 0.25) -> Callable[[Column], Column]:
    if not 0 < ramp <= 0.5:
        raise ValueError("ramp must lie in (0, 0.5]")
    top = 1 / (1 - ramp)
    return lambda t: F.when(t < ramp, top * t * t / (2 * ramp)).when(t <= 1 - ramp, top * (t - ramp / 2)).otherwise(top * (1 - ramp - (1 - t) * (1 - t) / (2 * ramp)))


PROFILES: dict[str, Callable[[Column], Column]] = {"uniform": uniform, "triangular": triangular, "parabolic": parabolic, "trapezoidal": trapezoidal()}


def resolve_profile(profile) -> Callable[[Column], Column]:
    """The antiderivative of a profile, from its name (any case), itself or None."""
    if profile is None:
        return uniform
    if isinstance(profile, str):
        if profile.lower() not in PROFILES:
            raise ValueError(f"unknown profile {profile!r}; known are {sorted(PROFILES)}")
        return PROFILES[profile.lower()]
    if callable(profile):
        return profile
    raise TypeError("a profile is a name or a function of a column")


def profile_integral(profile, low: Column, high: Column) -> Column:
    """Share of the event between two places in [0, 1]; null outside."""
    f = resolve_profile(profile)
    return F.when((low >= 0) & (high <= 1) & (low <= high), f(high) - f(low))


def linear_decay(step: int, size: int) -> float:
    return 1 - step / (size + 1)


def exponential_decay(step: int, size: int) -> float:
    return math.exp(-5 * step / (size + 1))


def gaussian_decay(step: int, size: int) -> float:
    return math.exp(-((3 * step / size) ** 2) / 2)


def flat_decay(step: int, size: int) -> float:
    return 1.0


DECAYS: dict[str, Callable[[int, int], float]] = {"linear": linear_decay, "exponential": exponential_decay, "gaussian": gaussian_decay, "flat": flat_decay}


def decay_weights(decay, size: int) -> list[float]:
    """Weights of steps 0 to size."""
    if size < 0:
        raise ValueError("a decay's size can't be negative")
    f = DECAYS[decay.lower()] if isinstance(decay, str) else decay
    return [1.0, *(float(f(k, size)) for k in range(1, size + 1))]
