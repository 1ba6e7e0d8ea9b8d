"""Greedy vertices of made-up tracks against a plain version with matrices."""

import math
import random

import numpy as np
import pytest

from stripweave.operators import vertices
from stripweave.operators.vertices import TRACK, Vertexing

SCHEMA = "event long, track int, layer int, cluster string, width int, energy double, chi2 double, z double, xp double, xs double, xpp double, xps double, xss double, yp double, ys double, ypp double, yps double, yss double"


def covariance(t):
    m = np.zeros((4, 4))
    m[:2, :2] = [[t["xpp"], t["xps"]], [t["xps"], t["xss"]]]
    m[2:, 2:] = [[t["ypp"], t["yps"]], [t["yps"], t["yss"]]]
    return m


def trial(a, b, r):
    """Quality, second track, status of a pair; None if it is no vertex."""
    p, q = (np.array([t["xp"], t["yp"], t["z"]]) for t in (a, b))
    d, e = (np.array([-t["xs"], -t["ys"], -1.0]) / math.sqrt(t["xs"] ** 2 + t["ys"] ** 2 + 1) for t in (a, b))
    s1, s2 = np.linalg.lstsq(np.stack([d, -e], 1), q - p, rcond=None)[0]
    doca = np.linalg.norm(p + s1 * d - q - s2 * e)
    if doca * math.sqrt(min(a["energy"] + b["energy"], 5000) / 100) > r.most_doca:
        return None
    zd, same, status, z = (p[2] + s1 * d[2] + q[2] + s2 * e[2]) / 2, a["cluster"] is not None and a["cluster"] == b["cluster"], vertices.TWO, a["z"]
    if not same:
        status |= (vertices.CROSS if s1 > 0 and s2 > 0 else 0) | (vertices.STAGGERED if abs(a["z"] - b["z"]) > r.tray / 2 else 0)
        if 0 < zd - z < r.tray:
            z, status = zd, status | vertices.DOCA
    elif a["width"] * abs(d[2]) < r.widest:
        z += r.converter
    else:
        status |= vertices.WIDE
    if max(abs(z - a["z"]), abs(z - b["z"])) > r.reach:
        return None
    states, covs = [], []
    for t in (a, b):
        step = z - t["z"] + r.material[a["layer"] >= r.thin_from]
        f = np.kron(np.eye(2), [[1, step], [0, 1]])
        states.append(f @ [t["xp"], t["xs"], t["yp"], t["ys"]])
        covs.append(f @ covariance(t) @ f.T)
    inv = [np.linalg.inv(m) for m in covs]
    mean = np.linalg.inv(inv[0] + inv[1])
    best = mean @ (inv[0] @ states[0] + inv[1] @ states[1])
    chi2 = sum((s - best) @ np.linalg.inv(m - mean) @ (s - best) for s, m in zip(states, covs, strict=True))
    quality = -abs(s1 - s2) - chi2 * max(a["chi2"], 0.1) * max(b["chi2"], 0.1) / 3
    det = mean[1, 1] * mean[3, 3]
    if quality <= r.least_quality or not 0 < det < a["xss"] * a["yss"]:
        return None
    return quality, status


def plain(tracks, r):
    used, out = set(), []
    for k, a in enumerate(tracks):
        if a["track"] in used:
            continue
        best = None
        for b in tracks[k + 1 :]:
            found = trial(a, b, r) if b["track"] not in used else None
            if found and (best is None or found[0] > best[1]):
                best = (b["track"], *found)
        out.append((a["track"], *(best or (None, None, vertices.ONE))))
        used |= {a["track"], best[0] if best else a["track"]}
    return out


def made_up(r, event):
    rows = []
    for _ in range(r.randint(1, 3)):
        x, y, z = r.uniform(0, 350), r.uniform(0, 350), r.choice([300.0, 320.0, 310.0])
        for _ in range(r.randint(1, 3)):
            sx, sy, drop = r.uniform(-0.5, 0.5), r.uniform(-0.5, 0.5), r.choice([0.0, 10.0, 33.0])
            rows.append([event, len(rows), r.choice([3, 9]), r.choice([None, "a", "b", "c"]), r.choice([1, 2, 5]), r.choice([50.0, 500.0, 9000.0]), r.uniform(0, 2), z - drop, x - sx * drop + r.gauss(0, 0.05), sx, 0.01, 1e-5, 1e-4, y - sy * drop + r.gauss(0, 0.05), sy, 0.01, 1e-5, 1e-4])
    return rows


@pytest.mark.parametrize("rules", [Vertexing(), Vertexing(most_doca=20.0, least_quality=-1e6, thin_from=0)])
def test_vertices_equal_plain(spark, rules):
    r = random.Random(3)
    rows = [x for event in range(80) for x in made_up(r, event)]
    got = {}
    for v in vertices.vertices(spark.createDataFrame(rows, SCHEMA).repartition(4), rules).collect():
        got.setdefault(v["event"], []).append((v["first"], v["second"], v["quality"], v["status"]))
    two = 0
    for event in range(80):
        tracks = [dict(zip(TRACK, x[1:], strict=True)) for x in rows if x[0] == event]
        expected = plain(tracks, rules)
        assert [(a, b, s) for a, b, _, s in sorted(got[event])] == [(a, b, s) for a, b, _, s in sorted(expected)]
        assert [q for _, _, q, _ in sorted(got[event])] == [q if q is None else pytest.approx(q, rel=1e-6) for _, _, q, _ in sorted(expected)]
        two += sum(b is not None for _, b, *_ in expected)
    assert two > 10


def test_empty_table(spark):
    assert vertices.vertices(spark.createDataFrame([], SCHEMA)).count() == 0
