"""WGS 84 to S-JTSK / Krovak East North (EPSG:5514) and back.

Forward is a chain of projections of Column expressions; all constants are folded on
the driver. Backward iterates, so it is an Arrow function meant for the few distinct
zones, never for measurements.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Ellipsoids (semi-major axis, inverse flattening), datum shift
# S-JTSK to WGS 84 (4) in metres and arc seconds, and the projection's parameters.
WGS84 = (6378137.0, 298.257223563)
BESSEL = (6377397.155, 299.1528128)
SHIFT_M = (485.0, 169.5, 483.8)
TURN_SEC = (7.786, 4.398, 4.103)
CENTRE_LAT = 49.5
CENTRE_LON = 24.8333333333333
PARALLEL = 78.5
SCALE = 0.9999
AXIS = 1.04216856380474

QUARTER = math.pi / 4


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    e2: float

    @classmethod
    def of(cls, axis: float, inverse_flattening: float) -> Ellipsoid:
        f = 1 / inverse_flattening
        return cls(axis, f * (2 - f))

    @property
    def e(self) -> float:
        return math.sqrt(self.e2)

    @property
    def b(self) -> float:
        return self.a * math.sqrt(1 - self.e2)


GLOBE, LOCAL = Ellipsoid.of(*WGS84), Ellipsoid.of(*BESSEL)
_rx, _ry, _rz = (s * math.pi / 648000 for s in TURN_SEC)
#: Small-angle rotation from the local to the global frame, and its true inverse.
TURN = np.array([[1, -_rz, _ry], [_rz, 1, -_rx], [-_ry, _rx, 1]])
TURN_BACK = np.linalg.inv(TURN)


def _cone() -> dict[str, float]:
    """Constants of the oblique cone."""
    e, e2 = LOCAL.e, LOCAL.e2
    lat = math.radians(CENTRE_LAT)
    alpha = math.sqrt(1 + e2 * math.cos(lat) ** 4 / (1 - e2))
    sphere_lat = math.asin(math.sin(lat) / alpha)
    g = ((1 + e * math.sin(lat)) / (1 - e * math.sin(lat))) ** (alpha * e / 2)
    k = math.tan(sphere_lat / 2 + QUARTER) / math.tan(lat / 2 + QUARTER) ** alpha * g
    s0 = math.radians(PARALLEL)
    radius = LOCAL.a * math.sqrt(1 - e2) / (1 - e2 * math.sin(lat) ** 2)
    return {"alpha": alpha, "k": k, "n": math.sin(s0), "s0": s0, "rho0": SCALE * radius / math.tan(s0), "tilt": math.pi / 2 - AXIS}


CONE = _cone()


def reproject(df: DataFrame, lon: str = "lon", lat: str = "lat", x: str = "x", y: str = "y") -> DataFrame:
    """``df`` with x and y in metres from degrees; null where a coordinate is null.

    Each step is a projection of its own, so that later steps refer to columns and
    expressions don't multiply.
    """
    own = [c for c in df.columns if c not in (x, y)]
    at = df.select(*own, F.radians(F.col(lon)).alias("_l"), F.radians(F.col(lat)).alias("_f"))

    def step(frame: DataFrame, **cols: Column) -> DataFrame:
        return frame.withColumns(cols)

    clamp = lambda v: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v))
    at = step(at, _n=GLOBE.a / F.sqrt(1 - GLOBE.e2 * F.pow(F.sin("_f"), 2)))
    at = step(at, _x=F.col("_n") * F.cos("_f") * F.cos("_l") - SHIFT_M[0], _y=F.col("_n") * F.cos("_f") * F.sin("_l") - SHIFT_M[1], _z=F.col("_n") * (1 - GLOBE.e2) * F.sin("_f") - SHIFT_M[2])
    turned = [sum((F.lit(float(m)) * F.col(c) for m, c in zip(row[1:], ("_y", "_z"), strict=True)), F.lit(float(row[0])) * F.col("_x")) for row in TURN_BACK]
    at = step(at, _x2=turned[0], _y2=turned[1], _z2=turned[2])
    at = step(at, _p=F.hypot("_x2", "_y2"), _l=F.atan2("_y2", "_x2"))
    at = step(at, _t=F.atan2(F.col("_z2") * LOCAL.a, F.col("_p") * LOCAL.b))
    second = (LOCAL.a**2 - LOCAL.b**2) / LOCAL.b**2
    at = step(at, _f=F.atan2(F.col("_z2") + second * LOCAL.b * F.pow(F.sin("_t"), 3), F.col("_p") - LOCAL.e2 * LOCAL.a * F.pow(F.cos("_t"), 3)))
    for _ in range(3):
        at = step(at, _n=LOCAL.a / F.sqrt(1 - LOCAL.e2 * F.pow(F.sin("_f"), 2)))
        at = step(at, _h=F.col("_p") / F.cos("_f") - F.col("_n"))
        at = step(at, _f=F.atan2(F.col("_z2"), F.col("_p") * (1 - LOCAL.e2 * (F.col("_n") / (F.col("_n") + F.col("_h"))))))
    c, e = CONE, LOCAL.e
    at = step(at, _g=F.pow((1 + e * F.sin("_f")) / (1 - e * F.sin("_f")), c["alpha"] * e / 2))
    at = step(at, _u=2 * (F.atan(c["k"] * F.pow(F.tan(F.col("_f") / 2 + QUARTER), c["alpha"]) / F.col("_g")) - QUARTER), _v=(math.radians(CENTRE_LON) - F.col("_l")) * c["alpha"])
    at = step(at, _s=F.asin(clamp(math.cos(c["tilt"]) * F.sin("_u") + math.sin(c["tilt"]) * F.cos("_u") * F.cos("_v"))))
    at = step(at, _d=c["n"] * F.asin(clamp(F.cos("_u") * F.sin("_v") / F.cos("_s"))))
    at = step(at, _r=c["rho0"] * (math.tan(c["s0"] / 2 + QUARTER) ** c["n"]) / F.pow(F.tan(F.col("_s") / 2 + QUARTER), c["n"]))
    return at.select(*own, (-F.col("_r") * F.sin("_d")).alias(x), (-F.col("_r") * F.cos("_d")).alias(y))


def _forward(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same chain on arrays of degrees, for the backward iteration."""
    lo, la = np.radians(lon), np.radians(lat)
    n = GLOBE.a / np.sqrt(1 - GLOBE.e2 * np.sin(la) ** 2)
    xyz = np.stack([n * np.cos(la) * np.cos(lo), n * np.cos(la) * np.sin(lo), n * (1 - GLOBE.e2) * np.sin(la)])
    x, y, z = TURN_BACK @ (xyz - np.array(SHIFT_M)[:, None])
    p, lo = np.hypot(x, y), np.arctan2(y, x)
    t = np.arctan2(z * LOCAL.a, p * LOCAL.b)
    second = (LOCAL.a**2 - LOCAL.b**2) / LOCAL.b**2
    la = np.arctan2(z + second * LOCAL.b * np.sin(t) ** 3, p - LOCAL.e2 * LOCAL.a * np.cos(t) ** 3)
    for _ in range(3):
        n = LOCAL.a / np.sqrt(1 - LOCAL.e2 * np.sin(la) ** 2)
        la = np.arctan2(z, p * (1 - LOCAL.e2 * n / (p / np.cos(la))))
    c, e = CONE, LOCAL.e
    g = ((1 + e * np.sin(la)) / (1 - e * np.sin(la))) ** (c["alpha"] * e / 2)
    u = 2 * (np.arctan(c["k"] * np.tan(la / 2 + QUARTER) ** c["alpha"] / g) - QUARTER)
    v = (math.radians(CENTRE_LON) - lo) * c["alpha"]
    s = np.arcsin(np.clip(math.cos(c["tilt"]) * np.sin(u) + math.sin(c["tilt"]) * np.cos(u) * np.cos(v), -1, 1))
    d = c["n"] * np.arcsin(np.clip(np.cos(u) * np.sin(v) / np.cos(s), -1, 1))
    r = c["rho0"] * (math.tan(c["s0"] / 2 + QUARTER) / np.tan(s / 2 + QUARTER)) ** c["n"]
    return -r * np.sin(d), -r * np.cos(d)


def _backward(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Degrees by Newton's method on the forward chain, from the projection's centre outwards."""
    lon, lat = np.full(len(x), 19.0), np.full(len(x), 48.7)
    step = 1e-6
    for _ in range(30):
        fx, fy = _forward(lon, lat)
        rx, ry = x - fx, y - fy
        if not len(x) or np.nanmax(np.hypot(rx, ry), initial=0) < 1e-6:
            break
        ex, ey = _forward(lon + step, lat)
        nx, ny = _forward(lon, lat + step)
        a, b, c, d = (ex - fx) / step, (nx - fx) / step, (ey - fy) / step, (ny - fy) / step
        det = a * d - b * c
        lon, lat = lon + (rx * d - ry * b) / det, lat + (ry * a - rx * c) / det
    return lon, lat


def unproject(x: Column, y: Column) -> Column:
    """struct<lon, lat> in degrees of metres; for distinct zones only."""

    @arrow_udf("struct<lon: double, lat: double>")
    def run(xs: pa.Array, ys: pa.Array) -> pa.Array:
        lon, lat = _backward(xs.to_numpy(zero_copy_only=False).astype(float), ys.to_numpy(zero_copy_only=False).astype(float))
        return pa.StructArray.from_arrays([pa.array(lon), pa.array(lat)], names=["lon", "lat"])

    return run(x, y)
