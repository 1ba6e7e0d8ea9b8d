"""Packing of paths against a plain greedy that marks statuses, on made-up events."""

import random

import pytest

from stripweave.operators import packing

SCHEMA = "event long, path_id string, rank int, start_layer int, hits array<struct<a: string, b: string, wide: boolean>>"


def plain(paths, rules):
    """paths of one event in order: (id, start_layer, hits)."""
    out, marks, taken = set(), {p[0]: 0 for p in paths}, []
    least, top = rules.least_links, paths[0][1]
    for path_id, start, hits in paths:
        n = len(hits) - 1
        legal = marks[path_id] == 0 or marks[path_id] & 1
        if len(taken) == rules.most or path_id in out or not legal or n < 1 or (n < least and start < top - 2):
            continue
        taken.append(path_id)
        least = max(least, n - 4)
        shared, until = (0, 1) if n < 4 else (rules.shared, rules.wide_until)
        for k, (a, b, wide) in enumerate(hits):
            if shared < k < until and wide:
                continue
            for other, _, theirs in paths:
                if other != path_id and any((a is not None and a == x) or (b is not None and b == y) for x, y, _ in theirs):
                    if k <= shared:
                        marks[other] |= 1 << k
                    else:
                        out.add(other)
    return taken


@pytest.mark.parametrize("rules", [packing.Packing(), packing.Packing(shared=0), packing.Packing(shared=1, wide_until=6, most=3)])
def test_packing_equals_plain(spark, rules):
    r, rows = random.Random(rules.shared), []
    for event in range(60):
        paths = []
        for k in range(r.randint(1, 25)):
            top = r.randint(8, 15)
            hits = [(r.choice([None, *"abcdefgh"[: 3 + event % 6]]) and f"{layer}{r.choice('abcdefgh'[: 3 + event % 6])}", f"{layer}{r.choice('abcdefgh')}", r.random() < 0.3) for layer in range(top, top - r.randint(1, 8), -1)]
            paths.append((event, f"p{k}", k, top, hits))
        rows += paths
    got = {}
    for x in packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(4), rules).orderBy("event", "track").collect():
        got.setdefault(x["event"], []).append(x["path_id"])
    for event in range(60):
        assert got.get(event, []) == plain([(i, s, h) for e, i, _, s, h in rows if e == event], rules)


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0
