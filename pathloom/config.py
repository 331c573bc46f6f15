"""Constants that define the semantics of the trajectory operators, and the names of data sets."""

from __future__ import annotations

import math
import os
from dataclasses import dataclass

# Fixed values of the domain.
GPS_INTERVAL_SEC = 15
LON_BOX, LAT_BOX = (-8.75, -8.45), (41.05, 41.30)
MIN_POINTS, MAX_POINTS, MAX_SPEED_KMH = 2, 4000, 200.0
METRO_MARGIN_DEG = 0.05
EARTH_RADIUS_KM = 6371.0088
HEX_EDGE_KM = 0.174
LENGTH_BANDS_KM = (1.0, 3.0, 5.0, 10.0, 20.0, 40.0)
TOP_K = 100
MAX_SUBROUTE_KM = 60.0
MIN_SUBROUTE_KM = 1.0
EXACT_MAX_TRIPS = 50_000
SUPPORT_X_PCT = 0.5
SUPPORT_FLOORS = (2, 3, 5, 10, 20, 50, 100, 250, 500, 1000, 2500, 5000)
TIME_BUCKETS = (("night", 0, 6), ("morning_peak", 6, 10), ("midday", 10, 16), ("evening_peak", 16, 20), ("evening", 20, 24))
LSH_FEATURES, LSH_TABLES, LSH_MAX_DISTANCE = 1 << 18, 5, 0.3
CLUSTER_CAP, CLUSTER_MIN_SIZE, CLUSTER_SHARE = 50_000, 3, 0.6
MIN_EDGE_SUPPORT, PAGERANK_ITERATIONS, DAMPING, PATH_SEEDS, MIN_FLOW_SHARE, TOP_ZONES = 5, 15, 0.85, 3000, 0.4, 50
SUFFIX_PREFIX_CELLS, SUFFIX_MAX_CELLS = 3, 200
MAX_CELL_REVISITS = 2
ANOMALY_QUANTILE = 0.99
MAX_HOP_KM = MAX_SPEED_KMH * GPS_INTERVAL_SEC / 3600 + 2 * HEX_EDGE_KM
TIME_ZONE = "Europe/Lisbon"
SCALES = {"sample": 5_000, "mid": 200_000, "s400k": 400_000, "s800k": 800_000, "full": None}


class LimitExceeded(RuntimeError):
    """A guarded operator was given more than it is meant for."""


@dataclass(frozen=True)
class DataPaths:
    """The tables of one scale under one base folder, local or remote."""

    raw: str
    clean: str
    features: str
    encoded: str


def join_path(base: str, *parts: str) -> str:
    """Joins path parts and leaves a scheme such as s3:// or gs:// whole."""
    scheme, sep, rest = base.partition("://")
    body = "/".join([(rest if sep else base).rstrip("/"), *(p.strip("/") for p in parts)])
    return f"{scheme}://{body}" if sep else body


def first_existing(variable: str, *candidates: str) -> str:
    """The variable's value if it is set, else the first candidate that exists, else the first."""
    if value := os.environ.get(variable):
        return value
    return next((c for c in candidates if os.path.exists(c)), candidates[0])


def data_paths(base: str, scale: str = "sample") -> DataPaths:
    if scale not in SCALES:
        raise ValueError(f"unknown scale {scale!r}: one of {', '.join(SCALES)}")
    return DataPaths(*(join_path(base, f"{name}_{scale}") for name in ("raw", "clean", "features", "encoded")))


def percent_of(support: int, n: int) -> float:
    return 100.0 * support / n if n else 0.0


def min_support_for(percent: float, n: int) -> int:
    return max(2, math.ceil(percent / 100.0 * n))
