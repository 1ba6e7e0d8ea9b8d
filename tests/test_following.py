"""Tracks followed through made-up planes, against a plain loop."""

import math
import random

import pytest

from stripweave.functions.geometry import LAYER_PITCH, STRIP_PITCH, TRAY_WIDTH
from stripweave.operators.following import Following, follow


def plain(seed, clusters, f):
    """seed: plane, x, y, sx, sy; clusters: (id, plane, position, width, first strip)."""
    plane, x, y, sx, sy = seed
    at, slope = [x, y], [sx, sy]

    def nearest(plane, variance):
        v = plane % 2
        far = min(f.sigmas * math.sqrt(variance + (f.thickness * slope[v]) ** 2), TRAY_WIDTH / 4)
        width = int(max(f.thickness * abs(slope[v]) / STRIP_PITCH - 1, 1))
        fits = [(abs(c[2] - at[v]), c[0], c[2]) for c in clusters if c[1] == plane and abs(c[2] - at[v]) < far and (c[3] >= width or c[4] % f.ladder == 0 or (c[4] + c[3]) % f.ladder == 0)]
        return min(fits, default=None)

    first = nearest(plane, f.first_variance)
    if first is None:
        return None
    cov = [[f.unmeasured, 0.0, f.slope_error**2], [f.unmeasured, 0.0, f.slope_error**2]]
    cov[plane % 2][0] = f.resolution**2
    hits, n, gaps, row, last = [(plane, first[1])], [0, 0], 0, 0, plane
    n[plane % 2] = 1
    for k in range(plane - 1, -1, -1):
        dz, v = (last // 2 - k // 2) * LAYER_PITCH, k % 2
        for w in (0, 1):
            pp, ps, ss = cov[w]
            at[w] -= slope[w] * dz
            cov[w] = [pp - 2 * dz * ps + dz * dz * ss, ps - dz * ss, ss + (f.noise if dz else 0.0)]
        if not all(0 <= a <= f.extent for a in at):
            break
        c = nearest(k, cov[v][0])
        if c is None:
            gaps, row = gaps + 1, row + 1
            if gaps > f.gaps or row > f.gaps_in_a_row:
                break
        else:
            row = 0
            pp, ps, ss = cov[v]
            whole, off = pp + f.resolution**2, c[2] - at[v]
            at[v] += pp / whole * off
            slope[v] += ps / whole * off
            cov[v] = [pp - pp * pp / whole, ps - pp * ps / whole, ss - ps * ps / whole]
            n[v] += 1
        hits.append((k, c and c[1]))
        last = k
        if c and max(abs(s) for s in slope) > f.steepest:
            break
    while hits[-1][1] is None:
        hits.pop()
    return sum(n) >= f.least_hits and min(n) >= f.least_of_view, hits


def made_up(r, event):
    """Two tracks in an event with smeared, missing and foreign clusters."""
    clusters, seeds = [], []
    for track in range(2):
        x, y, sx, sy = r.uniform(100, 250), r.uniform(100, 250), r.uniform(-0.4, 0.4), r.uniform(-0.4, 0.4)
        top = r.choice([35, 34, 29])
        seeds.append((event, track, top, x + r.gauss(0, 0.5), y + r.gauss(0, 0.5), sx + r.gauss(0, 0.01), sy + r.gauss(0, 0.01)))
        for plane in range(top, -1, -1):
            down = (top // 2 - plane // 2) * LAYER_PITCH
            if r.random() < 0.9:
                where = (x - sx * down, y - sy * down)[plane % 2] + r.gauss(0, 0.07)
                clusters.append((event, len(clusters), plane, where, r.choice([1, 1, 2]), r.randint(0, 1535)))
    for _ in range(60):
        clusters.append((event, len(clusters), r.randint(0, 35), r.uniform(0, 350), 1, r.randint(0, 1535)))
    return seeds, clusters


@pytest.mark.parametrize("f", [Following(), Following(sigmas=3.0, gaps=4, gaps_in_a_row=2, energy=100.0)])
def test_following_equals_plain(spark, f):
    r, seeds, clusters = random.Random(1), [], []
    for event in range(40):
        s, c = made_up(r, event)
        seeds += s
        clusters += c
    seeds += [(0, 9, 3, 1e6, 1e6, 0.0, 0.0), (0, 10, 0, 175.0, 175.0, 0.1, 0.1), (77, 0, 35, 1.0, 1.0, 0.0, 0.0)]
    s = spark.createDataFrame(seeds, "event long, track long, plane int, x double, y double, sx double, sy double").repartition(3)
    c = spark.createDataFrame(clusters, "event long, cluster long, plane int, position double, width int, first_strip int")
    got = {(x["event"], x["track"]): (x["found"], [(h["plane"], h["cluster"]) for h in x["hits"]]) for x in follow(s, c, f).collect()}
    expected = {}
    for event, track, *seed in seeds:
        found = plain(seed, [k[1:] for k in clusters if k[0] == event], f)
        if found:
            expected[event, track] = found
    assert got == expected
    assert sum(found for found, _ in got.values()) > 40


def test_empty_tables(spark):
    s = spark.createDataFrame([], "event long, track long, plane int, x double, y double, sx double, sy double")
    c = spark.createDataFrame([], "event long, cluster long, plane int, position double, width int, first_strip int")
    assert follow(s, c).count() == 0
