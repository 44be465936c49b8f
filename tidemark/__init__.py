"""Anomaly detection over keyed event data, on Spark tables and streams."""

from tidemark.plans.detect import Detection, detect
from tidemark.profiles import (
    GeoVelocity,
    Profile,
    Stall,
    Threshold,
    Velocity,
    ZScore,
    default_profiles,
)

__all__ = [
    "Detection",
    "GeoVelocity",
    "Profile",
    "Stall",
    "Threshold",
    "Velocity",
    "ZScore",
    "default_profiles",
    "detect",
]
