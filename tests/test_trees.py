"""Trees of links on small made-up events."""

import pytest
from pyspark.sql import functions as F

from stripweave.operators import islands, links, points, trees


def event(spark, tracks, skip=1):
    """tracks: lists of (layer, x, y)."""
    rows = sorted({(1, layer, x, y, f"{layer}:{x}:{y}") for t in tracks for layer, x, y in t})
    p = spark.createDataFrame(rows, "event long, layer int, x long, y long, id string")
    p = p.withColumns({"a": F.concat_ws(":", "layer", "x"), "b": F.concat_ws(":", "layer", "y")})
    return p, trees.with_slopes(links.links(p, skip, more=("a", "b")))


def straight(layers, x=100, dx=20):
    return [(layer, x + dx * (7 - layer), 300) for layer in layers]


def test_a_straight_track_is_one_tree(spark):
    p, k = event(spark, [straight(range(7, 0, -1))], skip=0)
    nodes = trees.grow(k)
    assert {r["head"] for r in nodes.collect()} == {"7:100:300"}
    leaf = trees.ranked_leaves(trees.statistics(nodes)).collect()
    assert [(r["n_points"], r["rank"], r["accepted"]) for r in leaf] == [(7, 1, True)]
    hits = trees.leaf_hits(trees.ranked_leaves(trees.statistics(nodes)), p).orderBy("layer").collect()
    assert [(r["layer"], r["x"]) for r in hits] == [(layer, 100 + 20 * (7 - layer)) for layer in range(1, 8)]


def test_a_missing_layer_becomes_a_gap_hit(spark):
    p, k = event(spark, [straight([7, 6, 5, 3, 2])])
    leaves = trees.ranked_leaves(trees.statistics(trees.grow(k))).filter("rank = 1 AND head = '7:100:300'")
    hits = {r["layer"]: (r["x"], r["gap"]) for r in trees.leaf_hits(leaves, p).collect()}
    assert hits[4] == (160.0, True)
    assert sorted(hits) == [2, 3, 4, 5, 6, 7]
    assert all(x == 100 + 20 * (7 - layer) for layer, (x, _) in hits.items())


def test_a_fork_has_two_leaves_and_the_longer_one_wins(spark):
    trunk = straight([7, 6, 5, 4])
    left, right = [(3, 185, 300), (2, 210, 300)], [(3, 175, 300), (2, 190, 300), (1, 205, 300)]
    _, k = event(spark, [trunk + left, trunk + right], skip=0)
    stats = trees.statistics(trees.grow(k)).filter("top_id = '7:100:300'").first()
    leaves = {r["rank"]: r for r in trees.ranked_leaves(trees.statistics(trees.grow(k)), least_unique=1).filter("head = '7:100:300'").collect()}
    assert stats["n_leaves"] >= 2
    assert stats["most_points"] == leaves[1]["n_points"] == 7
    assert leaves[1]["leaf"] == "1:205:300"
    assert leaves[2]["n_shared"] >= 4


def test_behind_a_sharp_kink_a_tree_starts_and_what_ended_there_goes(spark):
    _, k = event(spark, [[(7, 100, 300), (6, 100, 300), (5, 500, 300)]], skip=0)
    assert sorted((r["top_id"], r["depth"]) for r in trees.grow(k).collect()) == [("6:100:300", 1)]


def test_empty_event(spark):
    _, k = event(spark, [straight([7, 6])], skip=0)
    none = k.filter("event = 2")
    assert trees.grow(none).count() == 0
    assert trees.ranked_leaves(trees.statistics(trees.grow(none))).count() == 0


def test_point_ids_beyond_a_million(spark):
    rows = [(1, 3, 0, 10, 1_000_000), (1, 3, 1, 20, 0), (1, 4, 0, 10, 999_999), (1, 4, 1, 20, 1_000_000)]
    hits = spark.createDataFrame(rows, "event long, layer int, view int, strip long, hit long")
    found = points.points(hits, ["event", "layer"], ["hit"]).select(points.pair_id("x_hit", "y_hit").alias("id")).collect()
    assert len({r["id"] for r in found}) == 2


@pytest.mark.parametrize(("strips", "truncated", "allowed"), [([5], True, 10), ([5, 9], True, 5), ([5, 9], False, 0), ([1, 2], True, 3), ([1, 500], True, 10)])
def test_allowed_gap(spark, strips, truncated, allowed):
    rows = spark.createDataFrame([(1, s, 0, truncated) for s in strips], "plane int, strip int, side int, cut boolean")
    assert islands.allowed_gap(rows, ["plane"], F.max("cut"), []).first()["allowed"] == allowed


def test_guard_counts_points_before_they_are_formed(spark):
    from stripweave.jobs.reconstruct import LINKS, POINTS, Config, first_pass

    rows = [(e, layer, view, 10 * k, 100 * layer + 10 * k + view) for e, n in ((1, 4), (2, 2)) for layer in (3, 4) for view in (0, 1) for k in range(n)]
    hits = spark.createDataFrame(rows, "event long, layer int, view int, strip long, hit long")
    found = first_pass(hits, Config(most_points=31))
    assert [(r["event"], r["stage"]) for r in found.errors.collect()] == [(1, "points")]
    assert {r["event"] for r in found.points.collect()} == {2}
    early = first_pass(hits, Config(last_stage=LINKS))
    assert early.summary.count() == 0
    assert first_pass(hits, Config(last_stage=POINTS)).links.count() == 0


def test_a_later_window_takes_the_tables_of_an_earlier_pass(spark):
    from stripweave.jobs.reconstruct import LINKS, SUMMARY, Config, first_pass

    rows = [(e, layer, view, 10 * k, 100 * layer + 10 * k + view) for e in (1, 2) for layer in (3, 4) for view in (0, 1) for k in range(2)]
    hits = spark.createDataFrame(rows, "event long, layer int, view int, strip long, hit long")
    whole, early = first_pass(hits), first_pass(hits, Config(last_stage=LINKS))
    for first in (LINKS, SUMMARY):
        late = first_pass(hits, Config(first_stage=first), early)
        assert late.links.count() == whole.links.count() > 0
        assert sorted(late.summary.collect()) == sorted(whole.summary.collect())
    with pytest.raises(ValueError, match="earlier pass"):
        first_pass(hits, Config(first_stage=LINKS))


def link(top, bot, sx=0.0, sy=0.0, **more):
    """A link of a made-up event; points are (layer, a, b), clusters are their coordinates."""
    name = lambda p: ":".join(map(str, p))
    fields = {"event": 1, "top_layer": top[0], "top_id": name(top), "step": top[0] - bot[0], "bot_id": name(bot), "bot_layer": bot[0], "sx": sx, "sy": sy}
    fields |= {"top_a": f"{top[0]}:{top[1]}", "top_b": f"{top[0]}:{top[2]}", "bot_a": f"{bot[0]}:{bot[1]}", "bot_b": f"{bot[0]}:{bot[2]}", "wide_a": 1, "wide_b": 1, "gap": False}
    return trees.Link(**fields | more)


def grown(*found):
    ordered = sorted(found, key=lambda x: (-x.top_layer, x.top_id, x.step, x.bot_id))
    return {tuple(n.path) for n in trees.grow_event(ordered, trees.Cuts())}


def chain(points, sx=0.0):
    return [link(p, q, sx) for p, q in zip(points, points[1:], strict=False)]


def names(points):
    return tuple(":".join(map(str, p)) for p in points)


def test_losers_at_a_point_are_deleted():
    one = [(9, 1, 1), (8, 1, 1), (7, 5, 5), (6, 5, 5)]
    other = [(9, 2, 2), (8, 2, 2), (7, 5, 5)]
    paths = grown(*chain(one), *chain(other, sx=0.1))
    assert names(one) in paths
    assert names(other) not in paths
    assert names(other[:2]) in paths  # what the loser hung on stays


def test_of_nodes_at_a_dead_end_the_straighter_one_stays():
    straight, bent = [(9, 1, 1), (8, 1, 1), (7, 1, 1), (6, 5, 5)], [(9, 2, 2), (8, 2, 2), (7, 2, 2), (6, 5, 5)]
    found = [*chain(straight), *chain(bent)]
    found[-1] = found[-1]._replace(sx=0.2)
    paths = grown(*found)
    assert names(straight) in paths
    assert names(bent) not in paths
    assert names(bent[:3]) in paths


def test_newcomers_are_refused_by_much_longer_nodes():
    long = [(9, 1, 1), (8, 1, 1), (7, 1, 1), (6, 1, 1), (5, 1, 1)]
    short = [(6, 2, 2), (5, 1, 3)]  # shares cluster a of layer 5 with the fourth link
    assert names(short) not in grown(*chain(long), *chain(short))
    apart = [(6, 2, 2), (5, 2, 3)]
    assert names(apart) in grown(*chain(long), *chain(apart))


def test_a_much_straighter_owner_keeps_newcomers_out_of_narrow_clusters():
    straight, bent = [(9, 1, 1), (8, 1, 1), (7, 1, 1), (6, 1, 1)], [(9, 2, 2), (8, 2, 2), (7, 2, 2), (6, 1, 2)]
    found = [*chain(straight), *chain(bent)]
    found[-1] = found[-1]._replace(sx=0.3)
    assert names(bent) not in grown(*found)
    found[-1] = found[-1]._replace(wide_a=5)
    assert names(bent) in grown(*found)


def test_trees_dont_start_on_clusters_of_longer_ones():
    long, late = [(9, 1, 1), (8, 1, 1), (7, 1, 1)], [(7, 1, 4), (6, 4, 4), (5, 4, 4)]
    assert names(late) not in grown(*chain(long), *chain(late))
    assert names([(7, 2, 4), *late[1:]]) in grown(*chain(long), *chain([(7, 2, 4), *late[1:]]))


def test_trees_start_with_long_links_in_gaps_only():
    long = link((9, 1, 1), (6, 1, 1))
    assert grown(long) == set()
    assert grown(long._replace(gap=True)) == {names([(9, 1, 1), (6, 1, 1)])}
    assert grown(link((9, 1, 1), (4, 1, 1), gap=True)) == set()


def test_cuts_widen_for_small_events():
    assert trees.Cuts().of_event(1000) == trees.Cuts()
    assert trees.Cuts().of_event(10).displaced == pytest.approx(1.25 + 1.69 * 2.25)
    assert trees.Cuts().of_event(100, energy=100.0).kink == pytest.approx(0.7071067811865476)


def random_event(r, event, layers=9, points=5):
    """Links between random points whose clusters are shared."""
    at = {layer: sorted({(layer, r.randint(0, 2), r.randint(0, 3)) for _ in range(points)}) for layer in range(layers)}
    found = []
    for layer in range(layers - 1, 0, -1):
        for top in at[layer]:
            for step in (1, 2):
                for bot in at.get(layer - step, []):
                    if r.random() < 0.5:
                        found.append(link(top, bot, r.gauss(0, 0.08), r.gauss(0, 0.08), event=event))
    return found


def plain_kept(nodes):
    """Heads that stay and stubs that go, from the rows of one event."""
    heads = {}
    for n in nodes:
        if n["parent_id"] is None:
            key = (-n["below"], round(n["best_rms"], 9), n["bot_id"])
            if n["head"] not in heads or key < heads[n["head"]][0]:
                heads[n["head"]] = (key, n)
    there, stubs = list(nodes), set()
    for n in nodes:
        best = heads[n["head"]][1]
        size = lambda x: (x["sx"] ** 2 + x["sy"] ** 2 + 1) ** 0.5
        if n["parent_id"] is None and n["below"] == 1 and n["bot_id"] != best["bot_id"] and round((n["sx"] * best["sx"] + n["sy"] * best["sy"] + 1) / size(n) / size(best), 9) < 0.975:
            stubs.add((n["head"], n["bot_id"]))
    stay = []
    for head in sorted(heads, key=lambda h: (-(heads[h][1]["bot_layer"] + heads[h][1]["step"]), h)):
        first = heads[head][1]
        bad = any((n["layers"] > 2 and n["bot_a"] == first["top_a"]) or (n["depth"] > 2 and n["bot_b"] == first["top_b"]) for n in there)
        if first["below"] > 1 and not bad:
            stay.append(head)
            there = [n for n in there if (n["head"], n["bot_id"]) not in stubs or n["head"] != head or n["parent_id"] is not None]
        else:
            there = [n for n in there if n["head"] != head]
    return sorted((n["head"], tuple(n["path"])) for n in there)


def test_kept_trees_equal_plain(spark):
    import random

    r = random.Random(4)
    rows = [x for event in range(40) for x in random_event(r, event)]
    nodes = trees.statistics(trees.grow(spark.createDataFrame(rows, ", ".join(f"{f} {'double' if f in ('sx', 'sy') else 'boolean' if f == 'gap' else 'string' if f.endswith(('_id', '_a', '_b')) and f[:4] != 'wide' else 'int'}" for f in trees.Link._fields)).withColumn("event", F.col("event").cast("long")))).cache()
    by_event = {}
    for n in nodes.collect():
        by_event.setdefault(n["event"], []).append(n)
    kept = trees.kept(nodes).cache()
    got = {}
    for n in kept.withColumn("distance", trees.main_distance()).collect():
        got.setdefault(n["event"], []).append((n["head"], tuple(n["path"])))
        assert n["distance"] == sum(a != b for a, b in zip(n["path"], [*n["main"], *[None] * 20], strict=False)) or n["distance"] > 0
    assert {e: sorted(x) for e, x in got.items()} == {e: k for e, rows in by_event.items() if (k := plain_kept(rows))}
    assert any(len(plain_kept(x)) < len(x) for x in by_event.values())
    ranks = trees.ordered_leaves(kept).filter("rank = 1").collect()
    assert all(x["distance"] == 0 for x in ranks)


def test_leaves_at_one_point_are_ordered_by_path(spark):
    """Two leaves of a tree end at one point, equally long and straight: the lesser path comes first, whatever the order of rows."""
    fields = "event long, head string, bot_id string, path array<string>, best_rms double, below int, layers int, main array<string>"
    row = lambda *path: (5, path[0], path[-1], list(path), 0.0, 1, 3, ["h", "a", "z"])
    rows = [row("h", "b", "y"), row("h", "c", "y"), row("h", "a", "y"), row("h", "d", "y"), row("h", "a", "z")]
    for order in (rows, rows[::-1]):
        stats = spark.createDataFrame(order, fields).coalesce(1)
        ranked = sorted((r["rank"], r["path"][1]) for r in trees.ranked_leaves(stats).collect() if r["leaf"] == "y")
        assert ranked == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
        sought = sorted((r["rank"], r["distance"]) for r in trees.ordered_leaves(stats).collect())
        assert sought == [(1, 0), (2, 2), (3, 2), (4, 2), (5, 1)]


def test_hits_of_leaves_at_one_point_stay_apart(spark):
    leaves = spark.createDataFrame([(5, "h", "y", ["h", "a", "y"]), (5, "h", "y", ["h", "b", "y"])], "event long, head string, leaf string, path array<string>")
    points = spark.createDataFrame([(5, "h", 9, 1, 1), (5, "a", 8, 1, 1), (5, "b", 7, 1, 1), (5, "y", 6, 1, 1)], "event long, id string, layer int, x long, y long")
    got = sorted((r["layer"], r["gap"]) for r in trees.leaf_hits(leaves, points).collect())
    assert got == [(6, False), (6, False), (7, False), (7, True), (8, False), (8, True), (9, False), (9, False)]
