"""Lengths and areas on the WGS 84 ellipsoid."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.kernels.codecs import G
from tessera.kernels.planar import _lines, _polygons

A, FLAT = 6_378_137.0, 1 / 298.257223563
B = A * (1 - FLAT)
E2 = FLAT * (2 - FLAT)
E = math.sqrt(E2)
#: Nodes and weights of Gauss-Legendre quadrature on -1 to 1.
_NODES = ((0.1488743389816312, 0.2955242247147529), (0.4333953941292472, 0.2692667193099963), (0.6794095682990244, 0.2190863625159821), (0.8650633666889845, 0.1494513491505806), (0.9739065285171717, 0.0666713443086881))


def inverse(p: tuple, q: tuple) -> tuple[float, float, float] | None:
    """Distance in metres, azimuth at p and arc length on the auxiliary sphere of the geodesic between two points in degrees, by Vincenty's iteration; null if it does not converge, near antipodes."""
    if p[:2] == q[:2]:
        return 0.0, 0.0, 0.0
    l = math.radians((q[0] - p[0] + 540) % 360 - 180)
    u1, u2 = (math.atan((1 - FLAT) * math.tan(math.radians(x[1]))) for x in (p, q))
    s1, c1, s2, c2 = math.sin(u1), math.cos(u1), math.sin(u2), math.cos(u2)
    lam = l
    for _ in range(200):
        sl, cl = math.sin(lam), math.cos(lam)
        ss = math.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        if ss == 0:
            return 0.0, 0.0, 0.0
        cs = s1 * s2 + c1 * c2 * cl
        sigma = math.atan2(ss, cs)
        sa = c1 * c2 * sl / ss
        ca2 = 1 - sa * sa
        c2m = cs - 2 * s1 * s2 / ca2 if ca2 > 1e-16 else 0.0
        k = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
        new = l + (1 - k) * FLAT * sa * (sigma + k * ss * (c2m + k * cs * (-1 + 2 * c2m * c2m)))
        if abs(new - lam) < 1e-13:
            lam = new
            break
        lam = new
        if abs(lam) > math.pi + 1e-9:
            return None
    else:
        return None
    w = ca2 * (A * A - B * B) / (B * B)
    x = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    y = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    d = y * ss * (c2m + y / 4 * (cs * (-1 + 2 * c2m * c2m) - y / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)))
    azimuth = math.atan2(c2 * math.sin(lam), c1 * s2 - s1 * c2 * math.cos(lam))
    return B * x * (sigma - d), azimuth, sigma


def inverse_many(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances in metres between rows of points in degrees, all steps of the iteration at once; NaN where it does not converge."""
    l = np.radians((q[:, 0] - p[:, 0] + 540) % 360 - 180)
    u1, u2 = np.arctan((1 - FLAT) * np.tan(np.radians(p[:, 1]))), np.arctan((1 - FLAT) * np.tan(np.radians(q[:, 1])))
    out = np.where((p[:, :2] == q[:, :2]).all(1), 0.0, np.nan)
    at, lam = np.flatnonzero(np.isnan(out) & np.isfinite(l) & np.isfinite(u1) & np.isfinite(u2)), l.copy()
    for _ in range(200):
        if not len(at):
            break
        s1, c1, s2, c2 = np.sin(u1[at]), np.cos(u1[at]), np.sin(u2[at]), np.cos(u2[at])
        sl, cl = np.sin(lam[at]), np.cos(lam[at])
        ss = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
        out[at[ss == 0]] = 0.0
        some = ss != 0
        at, s1, c1, s2, c2, sl, cl, ss = (x[some] for x in (at, s1, c1, s2, c2, sl, cl, ss))
        cs = s1 * s2 + c1 * c2 * cl
        sigma, sa = np.arctan2(ss, cs), c1 * c2 * sl / ss
        ca2 = 1 - sa * sa
        c2m = np.where(ca2 > 1e-16, cs - 2 * s1 * s2 / np.where(ca2 > 1e-16, ca2, 1.0), 0.0)
        k = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
        new = l[at] + (1 - k) * FLAT * sa * (sigma + k * ss * (c2m + k * cs * (-1 + 2 * c2m * c2m)))
        done = np.abs(new - lam[at]) < 1e-13
        lam[at] = new
        w = ca2 * (A * A - B * B) / (B * B)
        x = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
        y = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
        d = y * ss * (c2m + y / 4 * (cs * (-1 + 2 * c2m * c2m) - y / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)))
        out[at[done]] = (B * x * (sigma - d))[done]
        at = at[~done & (np.abs(new) <= math.pi + 1e-9)]
    return out


def lengths(values: pa.Array, depth: int, over_antipodes: bool) -> pa.Array | None:
    """Lengths of a native column of lines (depth 1) or multilines (depth 2). Steps that do not converge are sought one by one, or make the length null. None if there are nulls within geometries."""
    paths, of = values, np.arange(len(values))
    for _ in range(depth):
        n = pc.fill_null(pc.list_value_length(paths), 0).to_numpy(zero_copy_only=False)
        path = np.repeat(np.arange(len(n)), n)
        of, paths = np.repeat(of, n), paths.flatten()
        if paths.null_count:
            return None
    x, y = paths.field("x"), paths.field("y")
    if x.null_count or y.null_count:
        return None
    xy = np.stack([x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False)], 1)
    step = np.flatnonzero(path[1:] == path[:-1])
    d = inverse_many(xy[step], xy[step + 1])
    finite = np.isfinite(xy).all(1)
    for k in np.flatnonzero(np.isnan(d) & finite[step] & finite[step + 1]).tolist() if over_antipodes else ():
        d[k] = _step(tuple(xy[step[k]]), tuple(xy[step[k] + 1]))
    total = np.bincount(of[step], d, len(values))
    return pa.array(total, mask=~values.is_valid().to_numpy(zero_copy_only=False) | np.isnan(total))


def vincenty_length(g: G) -> float | None:
    """Of lines, in metres; null if a step does not converge; 0 for other kinds."""
    total = 0.0
    for v in _lines(g):
        for p, q in zip(v, v[1:]):
            step = inverse(p, q)
            if step is None:
                return None
            total += step[0]
    return total


def _direct(p: tuple, azimuth: float, s: float) -> tuple[float, float]:
    """Where a geodesic gets after s metres: Vincenty's direct formula."""
    u1 = math.atan((1 - FLAT) * math.tan(math.radians(p[1])))
    s1, c1, sa1, ca1 = math.sin(u1), math.cos(u1), math.sin(azimuth), math.cos(azimuth)
    sigma1, sa = math.atan2(math.tan(u1), ca1), c1 * sa1
    ca2 = 1 - sa * sa
    w = ca2 * (A * A - B * B) / (B * B)
    x = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
    y = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
    sigma = s / (B * x)
    for _ in range(100):
        c2m, ss, cs = math.cos(2 * sigma1 + sigma), math.sin(sigma), math.cos(sigma)
        new = s / (B * x) + y * ss * (c2m + y / 4 * (cs * (-1 + 2 * c2m * c2m) - y / 6 * c2m * (-3 + 4 * ss * ss) * (-3 + 4 * c2m * c2m)))
        done = abs(new - sigma) < 1e-14
        sigma = new
        if done:
            break
    c2m, ss, cs = math.cos(2 * sigma1 + sigma), math.sin(sigma), math.cos(sigma)
    t = s1 * ss - c1 * cs * ca1
    lat = math.atan2(s1 * cs + c1 * ss * ca1, (1 - FLAT) * math.hypot(sa, t))
    lam = math.atan2(ss * sa1, c1 * cs - s1 * ss * ca1)
    k = FLAT / 16 * ca2 * (4 + FLAT * (4 - 3 * ca2))
    lon = lam - (1 - k) * FLAT * sa * (sigma + k * ss * (c2m + k * cs * (-1 + 2 * c2m * c2m)))
    return p[0] + math.degrees(lon), math.degrees(lat)


def _step(p: tuple, q: tuple) -> float:
    """Geodesic distance. Near antipodes, where the iteration fails, the shortest way over a point in between is sought."""
    d = inverse(p, q)
    if d is not None:
        return d[0]
    best = math.inf
    span = 90.0
    centre = 0.0
    for _ in range(40):  # the way crosses the meridian halfway at some latitude
        for k in range(-4, 5):
            lat = max(-90.0, min(90.0, centre + span * k / 4))
            m = (p[0] + ((q[0] - p[0] + 540) % 360 - 180) / 2, lat)
            x, y = inverse(p, m), inverse(m, q)
            if x and y and x[0] + y[0] < best:
                best, at = x[0] + y[0], lat
        centre, span = at, span / 2
    return best


def geodesic_length(g: G) -> float:
    """Of lines, in metres along geodesics; 0 for other kinds."""
    return sum(_step(p, q) for v in _lines(g) for p, q in zip(v, v[1:]))


def _zone(lat: float) -> float:
    """Area between the equator and a latitude in radians, for each radian of longitude."""
    s = math.sin(lat)
    return B * B / 2 * (s / (1 - E2 * s * s) + math.atanh(E * s) / E)


def _under(p: tuple, q: tuple) -> float:
    """Signed area between a geodesic and the equator, by quadrature over longitude along it."""
    dl = (q[0] - p[0] + 540) % 360 - 180
    if dl == 0:
        return 0.0
    step = inverse(p, q)
    if step is None or step[2] > 0.2:  # long ways are halved first
        if step is None:
            m = ((p[0] + dl / 2), (p[1] + q[1]) / 2)
        else:
            m = _direct(p, step[1], step[0] / 2)
        return _under(p, m) + _under(m, q)
    # along the geodesic, clairaut's constant gives the longitude's pace
    u1 = math.atan((1 - FLAT) * math.tan(math.radians(p[1])))
    sa = math.cos(u1) * math.sin(step[1])
    total, half = 0.0, step[0] / 2
    for node, weight in _NODES:
        for sign in (-1, 1):
            lat = math.radians(_direct(p, step[1], half * (1 + sign * node))[1])
            u = math.atan((1 - FLAT) * math.tan(lat))
            # d lon / d s = sin(azimuth) / (N cos lat), sin(azimuth) = sa / cos u
            n = A / math.sqrt(1 - E2 * math.sin(lat) ** 2)
            total += weight * _zone(lat) * sa / (math.cos(u) * n * math.cos(lat))
    return total * half


def _ring(r: list) -> tuple[float, float]:
    """Signed area, counter-clockwise positive, and length."""
    return -sum(_under(p, q) for p, q in zip(r, r[1:])), sum(_step(p, q) for p, q in zip(r, r[1:]))


def geodesic(g: G) -> tuple[float, float, float]:
    """Perimeter in metres, signed and unsigned area in square metres; all 0 for points and lines. Rings must not hold a pole."""
    perimeter = signed = unsigned = 0.0
    for rings in _polygons(g):
        area = 0.0
        for k, r in enumerate(rings):
            a, n = _ring(r)
            perimeter += n
            area = a if k == 0 else area - math.copysign(abs(a), area)
        signed += area
        unsigned += abs(area)
    return perimeter, signed, unsigned
