"""Track fits: a two-state Kalman filter and smoother for each track and view, in grouped Arrow batches.

A track has at most a few dozen planes, so a group is small; the event guard bounds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

COLUMNS = "event long, view int, n long, position double, slope double, var_position double, chi2_filter double, chi2_smooth double"


def kalman_line(z: np.ndarray, m: np.ndarray, error: float, noise: float) -> tuple[float, float, float, float, float]:
    """Position, slope and variance of the position at the first plane after smoothing, and both chi-squareds.

    noise: variance of the slope's change per unit of z (scattering).
    """
    x, c = np.array([m[0], 0.0]), np.diag([error, 1e4])
    held, chi2 = [(x, c, x, c, np.eye(2))], 0.0
    for dz, value in zip(np.diff(z), m[1:], strict=True):
        f = np.array([[1.0, dz], [0.0, 1.0]])
        q = noise * abs(dz) * np.array([[dz * dz / 3, dz / 2], [dz / 2, 1.0]])
        px, pc = f @ x, f @ c @ f.T + q
        s = pc[0, 0] + error
        k = pc[:, 0] / s
        chi2 += (value - px[0]) ** 2 / s
        x, c = px + k * (value - px[0]), pc - np.outer(k, pc[0])
        held.append((x, c, px, pc, f))
    sx, sc, smooth = x, c, 0.0
    for k in range(len(held) - 1, -1, -1):
        if k < len(held) - 1:
            fx, fc, (_, _, px, pc, f) = held[k][0], held[k][1], held[k + 1]
            a = fc @ f.T @ np.linalg.inv(pc)
            sx, sc = fx + a @ (sx - px), fc + a @ (sc - pc) @ a.T
        smooth += (m[k] - sx[0]) ** 2 / error
    return float(sx[0]), float(sx[1]), float(sc[0, 0]), chi2, float(smooth)


def track_fits(hits: DataFrame, error: float = 4.0, noise: float = 0.01, least: int = 4) -> DataFrame:
    """hits: event, view, layer, hit, m. Layers are fitted from the top down; hits of one layer are averaged; tracks under `least` planes are left out."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        layer, m = table.column("layer").to_numpy(), table.column("m").to_numpy()
        planes, at = np.unique(-layer, return_inverse=True)
        empty = [pa.array([], f.type) for f in SCHEMA]
        if len(planes) < least:
            return pa.Table.from_arrays(empty, schema=SCHEMA)
        order = np.lexsort((table.column("hit").to_numpy(), at))
        mean = np.bincount(at[order], m[order]) / np.bincount(at)
        found = kalman_line(planes.astype(float), mean, error, noise)
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((key[0].as_py(), key[1].as_py(), len(planes), *found), SCHEMA, strict=True)], schema=SCHEMA)

    return hits.select("event", "view", "layer", "hit", "m").groupBy("event", "view").applyInArrow(run, COLUMNS)


SCHEMA = pa.schema([("event", pa.int64()), ("view", pa.int32()), ("n", pa.int64()), *((c, pa.float64()) for c in ("position", "slope", "var_position", "chi2_filter", "chi2_smooth"))])
