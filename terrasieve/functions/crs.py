"""Map projections in numpy: UTM (Krueger series to the fourth order), Web Mercator and geographic coordinates."""

from __future__ import annotations

import re

import numpy as np

A, FLATTENING = 6378137.0, 1 / 298.257223563
N = FLATTENING / (2 - FLATTENING)
_RECTIFYING = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
_ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
_BETA = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)
_E = np.sqrt(FLATTENING * (2 - FLATTENING))
K0, FALSE_EASTING, FALSE_NORTHING = 0.9996, 500000.0, 10000000.0


def epsg(crs: int | str) -> int:
    """The EPSG number of "EPSG:n" or n; ValueError where this engine has no such projection."""
    found = re.fullmatch(r"(?i)(?:epsg:)?(\d+)", str(crs).strip())
    code = int(found[1]) if found else -1
    if code in (4326, 3857) or 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return code
    raise ValueError(f"unknown coordinate system: {crs}")


def _utm(code: int) -> tuple[float, float]:
    return np.radians((code % 100) * 6 - 183), FALSE_NORTHING if code // 100 == 327 else 0.0


def from_lonlat(lon: np.ndarray, lat: np.ndarray, crs: int | str) -> tuple[np.ndarray, np.ndarray]:
    lon, lat, code = np.asarray(lon, float), np.asarray(lat, float), epsg(crs)
    if code == 4326:
        return lon, lat
    if code == 3857:
        return A * np.radians(lon), A * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))
    center, north = _utm(code)
    d = (np.radians(lon) - center + np.pi) % (2 * np.pi) - np.pi
    s = np.sin(np.radians(lat))
    t = np.sinh(np.arctanh(s) - _E * np.arctanh(_E * s))
    xi, eta = np.arctan2(t, np.cos(d)), np.arctanh(np.sin(d) / np.sqrt(1 + t * t))
    x = eta + sum(a * np.cos(2 * j * xi) * np.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    y = xi + sum(a * np.sin(2 * j * xi) * np.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return FALSE_EASTING + K0 * _RECTIFYING * x, north + K0 * _RECTIFYING * y


def to_lonlat(x: np.ndarray, y: np.ndarray, crs: int | str) -> tuple[np.ndarray, np.ndarray]:
    x, y, code = np.asarray(x, float), np.asarray(y, float), epsg(crs)
    if code == 4326:
        return x, y
    if code == 3857:
        return np.degrees(x / A), np.degrees(2 * np.arctan(np.exp(y / A)) - np.pi / 2)
    center, north = _utm(code)
    xi0, eta0 = (y - north) / (K0 * _RECTIFYING), (x - FALSE_EASTING) / (K0 * _RECTIFYING)
    xi = xi0 - sum(b * np.sin(2 * j * xi0) * np.cosh(2 * j * eta0) for j, b in enumerate(_BETA, 1))
    eta = eta0 - sum(b * np.cos(2 * j * xi0) * np.sinh(2 * j * eta0) for j, b in enumerate(_BETA, 1))
    t0 = np.sin(xi) / np.sqrt(np.sinh(eta) ** 2 + np.cos(xi) ** 2)
    t = t0.copy() if isinstance(t0, np.ndarray) else t0
    for _ in range(6):  # conformal to geographic latitude, by Newton's method
        s = np.sinh(_E * np.arctanh(_E * t / np.sqrt(1 + t * t)))
        f = t * np.sqrt(1 + s * s) - s * np.sqrt(1 + t * t) - t0
        t = t - f / ((np.sqrt(1 + s * s) * np.sqrt(1 + t * t) - s * t) * (1 - _E**2) * np.sqrt(1 + t * t) / (1 + (1 - _E**2) * t * t))
    t0 = np.arctan(t)
    lon = np.degrees(center + np.arctan2(np.sinh(eta), np.cos(xi)))
    return (lon + 180) % 360 - 180, np.degrees(t0)


def transformed(x, y, source: int | str, target: int | str) -> tuple[np.ndarray, np.ndarray]:
    return (np.asarray(x, float), np.asarray(y, float)) if epsg(source) == epsg(target) else from_lonlat(*to_lonlat(x, y, source), target)


def transformed_bounds(left: float, bottom: float, right: float, top: float, source: int | str, target: int | str, points: int = 21) -> list[tuple[float, float, float, float]]:
    """Bounds that hold the densified outline in the target system; two boxes where geographic bounds cross the antimeridian."""
    u = np.linspace(0, 1, points)
    x = np.concatenate([left + u * (right - left)] * 2 + [np.full(points, left), np.full(points, right)])
    y = np.concatenate([np.full(points, bottom), np.full(points, top)] + [bottom + u * (top - bottom)] * 2)
    tx, ty = transformed(x, y, source, target)
    low, high = float(ty.min()), float(ty.max())
    if epsg(target) == 4326 and epsg(source) != 4326 and tx.max() - tx.min() > 180:
        return [(float(tx[tx > 0].min()), low, 180.0, high), (-180.0, low, float(tx[tx <= 0].max()), high)]
    return [(float(tx.min()), low, float(tx.max()), high)]
