"""N-gram Jaccard join by T-occurrence search (DivideSkip).

1. Every whole text becomes a set of hashed word shingles; equal sets are one node from here on.
2. Routing: the shingles of a set are dealt over segments by hash; the content of a segment is a key. The number of
   segments and deals (`deal_plan`) follows from the size class alone, such that two linked sets, however they differ,
   have no common key with a chance under 1e-15: about that of two sets with one hash. Nothing else is left to chance.
   Keys travel as ids. Nodes that share a key are candidates; components of candidates are formed by ids.
3. Search: a component of up to `BLOCK` nodes is one task. A larger one is searched in pairs of blocks of compatible
   sizes, or key by key, whichever sends fewer sets; so what is sent grows with the nodes, even if candidates that
   only share a passage chain to one component. Inside a task each set is a query against the inverted lists of the earlier ones: short
   lists are heap-merged, long ones probed by binary search, and sets that reach the required overlap stay. A
   pair that meets under several keys counts under the least of them.
4. Components of the verified links, by ids again, give each document its class.

Only ids, keys and spanning links are shuffled besides the sets of nodes that share a key; no pairs are
listed. Null or empty texts, or texts without words, have no shingles and no links; texts with fewer
words than a shingle has are one shingle. Very long texts: whole, with a bounded number of keys. Ties: equal sets are
always linked. Repeated rows: like equal texts. An empty table gives no rows. Null doc_id: such rows are nodes'
members, never their smallest id unless a class has no other. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_rows, documents, pieces, text_or_empty, written

BLOCK, LONG_LIST = 512, 24
#: Nodes of one piece from which on a key is combined before the shuffle.
HOT = 16
BROADCAST_IDS = 1_000_000
#: Shingles of a segment on average, at most, and the least number that a key has, at most; the chance of a link without a common key.
CONTENT, MOST_LEAST, MISS = 5, 3, 1e-15
U = np.uint64
#: Fixed table for hashing bytes: any odd-looking constants will do, but reruns and executors must agree.
BYTES = np.random.Generator(np.random.PCG64(20)).integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
STEP, STEP_BACK = U(0x9E3779B97F4A7C15), U(pow(0x9E3779B97F4A7C15, -1, 2**64))
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = U(1)
    return np.multiply.accumulate(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of a string column and the row it is in; A-Z count as a-z."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = LOWER[np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = ~IS_SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[offsets[:-1]] = True
    begins = np.flatnonzero(inside & (first[:-1] | ~np.concatenate(([False], inside[:-1]))))
    last = np.zeros(len(raw) + 1, bool)
    last[offsets[1:]] = True
    ends = np.flatnonzero(inside & (last[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    prefix = np.concatenate((np.zeros(1, U), np.cumsum(BYTES[raw] * powers(STEP, len(raw)), dtype=U)))
    back = powers(STEP_BACK, len(raw) + 1)
    hashes = mixed((prefix[ends] - prefix[begins]) * back[begins] + (ends - begins).astype(U))
    return hashes, np.searchsorted(offsets, begins, "right") - 1


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one row after the other, and the bounds of the rows."""
    words, row = word_hashes(column)
    rows = len(column)
    counts = np.bincount(row, minlength=rows)
    starts = np.cumsum(counts) - counts
    place = np.arange(len(words)) - starts[row]
    full = place + n <= counts[row]
    at = np.flatnonzero(full | ((place == 0) & (counts[row] < n)))
    length = np.minimum(counts[row[at]], n)
    value = length.astype(U)
    for k in range(n):
        more = k < length
        value[more] = mixed(value[more] * STEP + words[at[more] + k])
    owner = row[at]
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    value, owner = value[new], owner[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows))))


def size_classes(num: int, den: int, most: int) -> list[int]:
    """First sizes of classes such that linked sets are of one class or of neighbouring ones, to two beyond the class of `most`."""
    out = [1]
    while out[-1] <= most:
        out.append(out[-1] * den // num + 1)
    return [*out, out[-1] * den // num + 1]


@lru_cache(maxsize=4096)
def deal_plan(low: int, top: int, num: int, den: int) -> tuple[int, int, int]:
    """Segments of a deal, least shingles of a key, and how many segments (over one deal or more) are keys, for sets of low to top shingles.

    Linked sets differ in at most `differ` shingles and share at least `common`. A segment serves if no difference and
    enough common shingles fall into it. Such segments are negatively associated, so all of n fail with a chance of at
    most (1 - p) ** n; n is chosen such that this is under MISS. Zero segments: only equal sets can be linked.
    """
    differ = 2 * top * (den - num) // (den + num)
    if differ < 1:
        return 0, 0, 0
    common = int(required(-(-low * num // den), low, num, den))
    segments = max(differ + 2, -(-top // CONTENT))
    free = (1 - 1 / segments) ** differ
    found = []
    for least in range(1, MOST_LEAST + 1):
        fewer = sum(math.comb(common, k) * (1 / segments) ** k * (1 - 1 / segments) ** (common - k) for k in range(min(least, common + 1)))
        p = free * (1 - fewer)
        found.append(math.ceil(math.log(MISS) / math.log1p(-p)) if p > 1e-6 else 1 << 30)
    least = max(k for k, n in enumerate(found) if n <= 2 * found[0]) + 1
    return segments, least, found[least - 1]


def flat_keys(values: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys. The keys of a row's set depend on that set alone, not on the rows beside it."""
    sizes = np.diff(bounds)
    classes = size_classes(num, den, int(sizes.max(initial=1)))
    own = np.searchsorted(np.array(classes), sizes, "right") - 1
    rows_out, keys_out = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for k in np.unique(own[sizes > 0]).tolist() if len(sizes) else []:
        rows = np.flatnonzero((own == k) & (sizes > 0))
        inside = np.zeros(len(sizes) + 1, bool)
        inside[rows] = True
        mine = values[np.repeat(inside[:-1], sizes)]
        owner = np.repeat(np.arange(len(rows)), sizes[rows])
        weight = mixed(mine ^ U(0x14057B7EF767814F))
        for c in (k, k + 1):  # as the larger or an equal partner, and as the smaller one
            segments, least, wanted = deal_plan(classes[c], classes[c + 1] - 1, num, den)
            deal = 0
            while wanted > 0:
                width = min(wanted, segments)
                salt = mixed(np.array([(0x5851F42D4C957F2D + c * 0x9E3779B97F4A7C15 + deal * 0xBF58476D1CE4E5B9) % 2**64], U))
                place = (mixed(mine ^ salt) % U(segments)).astype(np.int64)
                used = place < width if width < segments else slice(None)
                slot = owner[used] * width + place[used]
                counts = np.bincount(slot, minlength=len(rows) * width)
                sums = np.zeros(len(rows) * width, U)
                np.add.at(sums, slot, weight[used])
                full = np.flatnonzero(counts >= least)
                tag = mixed(salt + (full % width).astype(U))
                rows_out.append(rows[full // width])
                keys_out.append(mixed(sums[full] ^ tag))
                wanted, deal = wanted - width, deal + 1
    row, key = np.concatenate(rows_out), np.concatenate(keys_out)
    order = np.argsort(row, kind="stable")
    return row[order], key[order]


def routing_keys(values: np.ndarray, bounds: np.ndarray, num: int, den: int) -> list[np.ndarray]:
    """The keys of each row's set."""
    row, key = flat_keys(values, bounds, num, den)
    return np.split(key, np.cumsum(np.bincount(row, minlength=len(bounds) - 1))[:-1])


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(U).view(np.int64)


def node_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash for each row's set: of the sum of its mixed shingles and its size."""
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mixed(values), dtype=U)))
    return as_long(mixed((sums[bounds[1:]] - sums[bounds[:-1]]) ^ np.diff(bounds).astype(U)))


def nodes(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, same (hash of the text), n_shingles, node (hash of the set)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = shingle_sets(batch.column("text"), n)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("same"), pa.array(np.diff(bounds), pa.int64()), pa.array(node_hashes(values, bounds))], ["doc_id", "same", "n_shingles", "node"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("same"), text_or_empty().alias("text"))
    return rows.mapInArrow(by_rows(run), "doc_id long, same long, n_shingles long, node long")


def keyed_nodes(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, key. Combined before the shuffle: a task names a node once, however many copies of its set it reads. A key that
    `HOT` nodes of a piece have is named by the first of them, to which the others are tied by odd keys of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in pieces(batches):
            values, bounds = shingle_sets(batch.column("text"), n)
            node = node_hashes(values, bounds)
            fresh = np.zeros(len(node), bool)
            for i, x in enumerate(node.tolist()):
                fresh[i] = x not in seen
                seen.add(x)
            row, key = flat_keys(values, bounds, num, den)
            own, key = node[row[fresh[row]]].view(U), key[fresh[row]] & ~U(1)
            _, first, place, count = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            pivot = own[first][place]
            tied = (count[place] >= HOT) & (own != pivot)
            ties = np.unique(np.stack((own[tied], pivot[tied]), 1), axis=0)
            tie = mixed(ties[:, 0] ^ mixed(ties[:, 1])) | U(1)
            columns = np.concatenate((own[~tied], ties[:, 0], ties[:, 1])), np.concatenate((key[~tied], tie, tie))
            yield pa.RecordBatch.from_arrays([pa.array(as_long(x)) for x in columns], ["node", "key"])

    return docs.select(text_or_empty().alias("text")).mapInArrow(run, "node long, key long")


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b. node, component (least node of its component), for all nodes of edges.

    Rounds of large-star and small-star: every node's larger, then smaller neighbours are tied to its least one. Ids only;
    each round is written, so the lineage stays short.
    """
    now = written(edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("u < v").distinct(), "edges")
    seen = None
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v"), F.col("m").alias("u")).filter("u < v").distinct()
        down = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(down, "v").select(F.explode(F.array(F.struct(F.col("v"), F.col("m").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")))).alias("e")).select("e.u", "e.v").filter("u < v").distinct()
        after = written(small, "edges")
        seen, before = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first(), seen
        now = after
        if seen == before:
            break
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def required(a: np.ndarray | int, b: np.ndarray | int, num: int, den: int):
    """Least overlap of sets of sizes a and b that are linked: den * i >= num * (a + b - i)."""
    return -((a + b) * -num // (num + den))


def search(values: np.ndarray, bounds: np.ndarray, group: np.ndarray | None, num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sets in the order of their sizes. For each, the earlier ones it is linked with; group: only those of the other group."""
    sizes = np.diff(bounds)
    n = len(sizes)
    _, lists = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(lists, kind="stable")
    members = owner[order]  # of each list, ascending
    begins = np.concatenate(([0], np.cumsum(np.bincount(lists))))
    counts = np.zeros(n, np.int64)
    for q in range(n):
        mine = lists[bounds[q] : bounds[q + 1]]
        low = int(np.searchsorted(sizes, -(-int(sizes[q]) * num // den)))
        if low >= q:
            continue
        least = required(int(sizes[q]), int(sizes[low]), num, den)
        a, lengths = begins[mine], begins[mine + 1] - begins[mine]
        by_length = np.argsort(-lengths, kind="stable")
        n_long = min(int((lengths > LONG_LIST).sum()), least - 1)
        long, short = mine[by_length[:n_long]], by_length[n_long:]
        short = short[lengths[short] > 1]
        runs = [members[a[i] : a[i] + lengths[i]] for i in short.tolist()]
        if sum(map(len, runs)) <= 4096:
            cand, hits = [], []
            for x in heapq.merge(*[r.tolist() for r in runs]):
                if cand and cand[-1] == x:
                    hits[-1] += 1
                elif low <= x < q:
                    cand.append(x)
                    hits.append(1)
            cand, hits = np.array(cand, np.int64), np.array(hits, np.int64)
        else:  # the same merge by counting
            np.add.at(counts, np.concatenate(runs), 1)
            cand = np.flatnonzero(counts[low:q]) + low
            hits = counts[cand].copy()
            counts[:] = 0
        need = required(int(sizes[q]), sizes[cand], num, den)
        keep = hits >= need - n_long
        if group is not None:
            keep &= group[cand] != group[q]
        cand, hits, need = cand[keep], hits[keep], need[keep]
        for k, i in enumerate(long.tolist()):
            if not len(cand):
                break
            run = members[begins[i] : begins[i + 1]]
            at = np.searchsorted(run, cand)
            hits = hits + (run[np.minimum(at, len(run) - 1)] == cand)
            if k % 8 == 7 or k == n_long - 1:
                keep = hits >= need - (n_long - 1 - k)
                cand, hits, need = cand[keep], hits[keep], need[keep]
        cand = cand[hits >= need]
        if len(cand):
            yield q, cand


def candidates(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, grp, total (nodes of the group), groups (all groups of the node where it has several, else null)."""
    # both branches below read one shuffle; without this filter the join would push its own below only one of them
    rows = keyed_nodes(docs, n, num, den).filter("node IS NOT NULL AND key IS NOT NULL").repartition("key")
    shared = rows.groupBy("key").agg(F.min("node").alias("pivot"), F.max("node").alias("top")).filter("pivot < top")
    keyed = written(rows.join(shared, "key").select("key", "node", "pivot").distinct(), "keyed")
    routed = written(components(keyed.filter("node > pivot").select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct()), "routed")
    # keys with the same nodes are one group
    of_key = keyed.groupBy("key").agg(F.min("pivot").alias("pivot"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"))
    of_key = of_key.groupBy("pivot", "n", "x").agg(F.min("key").alias("grp"))
    of_key = of_key.join(routed.withColumnRenamed("node", "pivot"), "pivot")
    sizes = routed.groupBy("component").agg(F.count("*").alias("total"))
    sent = of_key.groupBy("component").agg(F.sum("n").alias("sent"), F.max(F.col("grp").bitwiseAND(1)).alias("tied"))
    by_key = (F.col("total") > BLOCK) & (F.col("tied") == 0) & (F.col("sent") * 2 * BLOCK < F.col("total") * F.col("total"))
    how = written(sizes.join(sent, "component").select("component", "total", by_key.alias("by_key")), "how")
    whole = routed.join(how.filter(~F.col("by_key")), "component").select("node", F.col("component").alias("grp"), "total", F.lit(None).cast("array<bigint>").alias("groups"))
    parts = of_key.join(how.filter("by_key").select("component"), "component").select("grp", F.col("n").alias("total"))
    split = keyed.select("node", F.col("key").alias("grp")).join(parts, "grp")
    groups = split.groupBy("node").agg(F.array_sort(F.collect_list("grp")).alias("groups"))  # at most a node's keys
    return whole.unionByName(split.join(groups, "node").select("node", "grp", "total", "groups"))


def classes(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """doc_id, same, n_shingles, component_id, n_links for every document."""
    table = written(nodes(docs, n), "nodes")
    sets = table.groupBy("node").agg(F.min("doc_id").alias("doc"), F.count("*").alias("copies"), F.max("n_shingles").alias("n_shingles"))
    members = written(candidates(docs, n, num, den).join(sets.filter(F.col("n_shingles") > 0), "node"), "members")
    links = written(found_links(docs, members, n, num, den), "links")
    edges = links.filter(F.col("b").isNotNull()).select("a", "b")
    joined = written(components(edges), "joined")
    counted = links.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    nodes_of = sets.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = nodes_of.groupBy("component").agg(F.min("doc").alias("component_id"))
    of_node = nodes_of.join(ids, "component").join(counted, "node", "left").select("node", "component_id", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = table.join(of_node, "node")
    empty = F.col("n_shingles") == 0
    component_id = F.when(empty, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id")).alias("component_id")
    return out.select("doc_id", "same", "n_shingles", component_id, F.when(empty, 0).otherwise(F.col("n_links")).cast("long").alias("n_links"))


def linked(docs: DataFrame, n: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links for every document."""
    return classes(docs, n, num, den).drop("same")


def found_links(docs: DataFrame, members: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """a, b, n: spanning links of each task (b not null), and for each node (b null) the number of documents it is linked with there."""
    columns = ["node", "copies", "n_shingles", "grp", "groups"]
    few = members.filter(F.col("total") <= BLOCK).select(*columns, F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(0).alias("side"))
    # blocks of a large group: rank by size, from counts of sizes, then by a hash among equal sizes
    many = members.filter(F.col("total") > BLOCK)
    by_size = many.groupBy("grp", "n_shingles").agg(F.count("*").alias("c"))
    before = by_size.withColumn("before", F.sum("c").over(Window.partitionBy("grp").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c"))
    many = many.join(before, ["grp", "n_shingles"]).withColumn("block", F.floor((F.col("before") + F.pmod(F.xxhash64("node"), F.col("c"))) / BLOCK).cast("int"))
    spans = many.groupBy("grp", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    a, b = spans.select("grp", F.col("block").alias("i"), F.col("high").alias("top")), spans.select("grp", F.col("block").alias("j"), F.col("low").alias("bottom"))
    tasks = a.join(b, "grp").filter((F.col("i") <= F.col("j")) & (F.col("top") * den >= F.col("bottom") * num)).select("grp", "i", "j")
    side = lambda block, k: F.struct(F.col(block).alias("block"), F.lit(k).alias("side"))
    sides = F.explode(F.when(F.col("i") == F.col("j"), F.array(side("i", 0))).otherwise(F.array(side("i", 1), side("j", 2)))).alias("s")
    sides = tasks.select("grp", "i", "j", sides).select("grp", "i", "j", "s.block", "s.side")
    many = many.join(sides, ["grp", "block"])
    routed = few.unionByName(many.select(*few.columns))
    docs_of = small(members.select(F.col("doc").alias("m")).distinct(), members.count())
    texts = docs.select("doc_id", text_or_empty().alias("text")).join(docs_of, F.col("doc_id").eqNullSafe(F.col("m")), "left_semi").select("text")

    def hashed(batch: pa.RecordBatch) -> pa.RecordBatch:
        values, bounds = shingle_sets(batch.column("text"), n)
        raw = [values[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(node_hashes(values, bounds)), pa.array(raw, pa.binary())], ["node", "hashes"])

    sets = texts.mapInArrow(by_rows(hashed), "node long, hashes binary").dropDuplicates(["node"])
    dealt = routed.join(sets, "node").withColumn("task", F.xxhash64("grp", "i", "j"))
    dealt = dealt.select("task", "grp", "i", "j", "side", "node", "copies", "n_shingles", "groups", "hashes")
    dealt = dealt.repartition("task").sortWithinPartitions("task", "grp", "i", "j", "n_shingles", "node")
    return dealt.mapInArrow(lambda batches: searched(batches, num, den), "a long, b long, n long")


def searched(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Runs the search on each task's rows, which come one after the other; a task has at most two blocks."""
    held: list[tuple] = []
    name: tuple | None = None
    out: list[tuple] = []

    def flush() -> None:
        if len(held) < 2:
            return
        node, copies, side = [r[0] for r in held], [r[1] for r in held], np.array([r[2] for r in held])
        sets = [np.frombuffer(r[3], U) for r in held]
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in sets])))
        root, weight, others = list(range(len(held))), np.array(copies, np.int64), np.zeros(len(held), np.int64)

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        groups = [r[4] for r in held]
        for q, cand in search(np.concatenate(sets), bounds, side if side.any() else None, num, den):
            if groups[q] is not None:  # a pair that meets under several keys counts under the least of them
                cand = cand[[name[1] == min(set(groups[q]).intersection(groups[c])) for c in cand.tolist()]]
            others[q] += weight[cand].sum()
            others[cand] += weight[q]
            for c in cand.tolist():
                x, y = top(q), top(c)
                if x != y:
                    root[x] = y
                    out.append((node[q], node[c], None))
        out.extend((node[k], None, int(others[k])) for k in np.flatnonzero(others).tolist())

    for batch in pieces(batches, "hashes"):
        columns = [batch.column(c).to_pylist() for c in ("task", "grp", "i", "j", "node", "copies", "side", "hashes", "groups")]
        for task, grp, i, j, *row in zip(*columns, strict=True):
            if (task, grp, i, j) != name:
                flush()
                held, name = [], (task, grp, i, j)
            held.append(row)
        if out:
            yield rows_of(out)
            out = []
    flush()
    if out:
        yield rows_of(out)


def rows_of(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b", "n"])


def small(ids: DataFrame, n: int) -> DataFrame:
    """Broadcast up to `BROADCAST_IDS` rows of one id each (16 MB), so that texts aren't shuffled; beyond, Spark joins by shuffle."""
    return F.broadcast(ids) if n <= BROADCAST_IDS else ids


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of each class stays, that of the smallest doc_id, all columns as they were. Rows without a doc_id stay.

    Repeated rows of one doc_id and text become one.
    """
    rows = written(classes(docs, n, num, den).select("doc_id", "same", "component_id"), "classes")
    others = written(rows.filter("component_id <> doc_id").select(F.col("doc_id").alias("other"), F.col("same").alias("other_same")).distinct(), "others")
    same = F.xxhash64("text") == F.col("other_same")
    kept = docs.join(small(others, others.count()), (F.col("doc_id") == F.col("other")) & same, "left_anti")
    again = rows.filter("component_id = doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias("twice"))
    again = written(again, "repeated")
    ids = small(again, again.count())
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    repeated = kept.select("doc_id", F.xxhash64("text").alias("same"), whole).join(ids, F.col("doc_id") == F.col("twice"), "left_semi")
    repeated = repeated.withColumn("turn", F.row_number().over(Window.partitionBy("doc_id", "same").orderBy("same"))).filter("turn = 1").select("whole.*")
    return kept.join(ids, F.col("doc_id") == F.col("twice"), "left_anti").unionByName(repeated)


def op1_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(documents(spark, sf_dir))
