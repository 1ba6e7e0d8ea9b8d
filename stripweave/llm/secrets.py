"""Secret scans with corpus-wide ownership frequency.

Candidates of all kinds are found in every whole text, once; their hashes are counted over distinct
repositories and owners. A hash with `COPIED` owners or `SPREAD` repositories or more is a widely copied example; any
other is owner-specific and looks live. Here an owner is a source, a repository a (source, lang).

Null text: the empty text. Null owner or repository: a value of its own. Empty texts: no spans, the
hash of the empty string. Repeated rows count once for each repository. Positions are code
points, ends exclusive; a span covers the whole match. Very long texts, and many spans in one, take linear time: places are
running sums over blocks. Spans that start together are ordered by kind (ties). Null doc_id: kept, an id of its own. An empty
table gives no rows. Only doc_id, text, lang and source are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, text_or_empty, written

COPIED, SPREAD = 3, 6
#: Kind, pattern, group that holds the secret, its least length. The first three are the base kinds.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("webtoken", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 27),
    ("prefixed", r"(?:gh[pousr]_|glpat-|xox[abprs]-|sk_live_)[A-Za-z0-9_-]{16,}", 0, 20),
    ("keyblock", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 27),
)
BASE = 3
SALTS = 16
#: Values of a block of running(), code points of a chunk of without().
BLOCK, CHUNK = 512, 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is evaluated once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of bigints what merge makes of 0 and all values before it, and at the end of all.

    Two levels of BLOCK values, so that growing arrays stay short and the work is linear.
    """
    zero = F.lit(0).cast("bigint")

    def step(acc: Column, x: Column) -> Column:
        return F.struct(F.concat(acc["all"], F.array(acc["now"])).alias("all"), merge(acc["now"], x).alias("now"))

    def fold(values: Column, start: Column) -> Column:
        return F.aggregate(values, F.struct(F.array().cast("array<bigint>").alias("all"), start.alias("now")), step)

    def blocks(values: Column) -> Column:
        begins = F.sequence(F.lit(1), F.greatest(F.size(values), F.lit(1)), F.lit(BLOCK))
        parts = F.transform(begins, lambda k: F.slice(values, k, BLOCK))
        totals = lambda parts: fold(F.transform(parts, lambda x: F.aggregate(x, zero, lambda a, b: merge(a, b))), zero)
        inner = lambda parts, outer: F.flatten(F.zip_with(parts, outer["all"], lambda x, start: fold(x, start)["all"]))
        return let(parts, lambda parts: let(totals(parts), lambda outer: F.concat(inner(parts, outer), F.array(outer["now"]))))

    return let(values, blocks)


def found(text: Column, k: int) -> Column:
    """Spans of one kind as array<struct<start,k,kind,end,hash>>; the text between matches gives their places."""
    kind, pattern, group, least = KINDS[k]
    item = "struct<start:bigint,k:int,kind:string,end:bigint,hash:string>"
    whole = F.regexp_extract_all(text, F.lit(pattern), 0)
    held = F.regexp_extract_all(text, F.lit(pattern), group) if group else whole
    steps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), held.alias("held"))
    size = lambda c: F.coalesce(F.length(c), F.lit(0)).cast("bigint")

    def spans(steps: Column) -> Column:
        before = running(F.transform(steps, lambda x: size(x["gap"]) + size(x["whole"])), lambda a, b: a + b)
        placed = F.zip_with(steps, F.slice(before, F.lit(1), F.size(steps)), lambda x, at: F.struct((at + size(x["gap"])).alias("start"), (at + size(x["gap"]) + size(x["whole"])).alias("end"), x["held"].alias("held")))
        kept = F.filter(placed, lambda x: F.length(x["held"]) >= least)
        return F.transform(kept, lambda x: F.struct(x["start"], F.lit(k).alias("k"), F.lit(kind).alias("kind"), x["end"], F.sha2(x["held"].cast("binary"), 256).alias("hash")))

    return F.when(text.rlike(pattern), let(steps, spans)).otherwise(F.array().cast(f"array<{item}>"))


def scan(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, more, found: all spans in the order of start, then kind."""
    return docs.select("doc_id", *more, F.array_sort(F.concat(*[found(text_or_empty(), k) for k in range(len(KINDS))])).alias("found"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def ownership(scanned: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """hash, n_owners, n_repositories, n_spans: counts over all documents, pre-aggregated at each level."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    spans = scanned.filter(F.size("found") > 0).select(name(owner).alias("owner"), F.to_json(F.array(*[name(c) for c in repository])).alias("repository"), F.explode("found.hash").alias("hash"))
    by_repository = spans.groupBy("hash", "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_spans"))


def verdicts(scanned: DataFrame) -> DataFrame:
    """doc_id, digest (of its spans), live (indices of spans that look live) for each distinct pair of doc_id and spans that has live ones.

    A hash that many documents hold is joined over salts, so that none of its rows meet in one task.
    """
    owners = ownership(scanned).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    holders = scanned.filter(F.size("found") > 0).select("doc_id", digest().alias("digest"), F.col("found.hash").alias("hashes")).dropDuplicates(["doc_id", "digest"])
    each = holders.select("doc_id", "digest", F.posexplode("hashes").alias("at", "hash")).withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    live = each.join(owners, ["hash", "salt"]).filter((F.col("n_owners") < COPIED) & (F.col("n_repositories") < SPREAD))
    return live.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list("at")).alias("live"))


def digest() -> Column:
    return F.md5(listed(F.col("found")).cast("binary"))


def joined(rows: DataFrame, scanned: DataFrame) -> DataFrame:
    """rows (doc_id, found, ..) with live; rows without spans stay where they are."""
    v = verdicts(scanned).select(F.col("doc_id").alias("v_id"), F.col("digest").alias("v_digest"), "live")
    same = F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("digest") == F.col("v_digest"))
    held = rows.filter(F.size("found") > 0).withColumn("digest", digest()).join(v, same, "left").drop("v_id", "v_digest", "digest")
    none = F.array().cast("array<int>")
    return rows.filter(F.size("found") == 0).withColumn("live", none).unionByName(held.withColumn("live", F.coalesce("live", none)))


def report(docs: DataFrame) -> DataFrame:
    scanned = written(scan(docs, "source", "lang"), "spans")
    count = lambda k: F.size(F.filter("found", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k][0]}")
    base = listed(F.filter("found", lambda x: x["k"] < BASE))
    n = lambda hashes: F.size(F.array_distinct(hashes)).cast("long")
    n_live = n(F.transform("live", lambda at: F.get("found", at)["hash"]))
    told = joined(scanned.drop("source", "lang"), scanned).withColumn("n_owner_specific", n_live)
    return told.select("doc_id", *[count(k) for k in range(BASE)], F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "n_owner_specific", (n("found.hash") - F.col("n_owner_specific")).alias("n_widely_copied"))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with live-looking secrets' spans replaced; widely copied examples stay. Overlapping spans become one. Other columns stay as they are."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = written(scan(docs.select("doc_id", "text", "source", "lang", whole), "source", "lang", "whole"), "spans")
    rows = joined(rows, rows.drop("whole"))
    spans = F.transform("live", lambda at: F.get("found", at))
    rows = rows.withColumn("text", F.when(F.size("live") > 0, without(F.col("whole.text"), spans, mark)).otherwise(F.col("whole.text")))
    return rows.select(*[F.col("text") if c == "text" else F.col(f"whole.`{c}`").alias(c) for c in docs.columns])


def without(text: Column, spans: Column, mark: str) -> Column:
    """A text with spans (in the order of their starts) replaced. It is cut into chunks once, so that finding a place costs a chunk."""
    chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), 0)
    place = lambda at: (F.floor(at / CHUNK).cast("int"), (at % CHUNK).cast("int"))

    def piece(chunks: Column, begin: Column, end: Column) -> Column:
        (first, skip), (last, left) = place(begin), place(end)
        chunk = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
        one = F.substring(chunk(first), skip + 1, left - skip)
        more = F.concat(F.substring(chunk(first), skip + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(chunk(last), F.lit(1), left))
        return F.when(first == last, one).otherwise(more)

    def parts(chunks: Column) -> Column:
        def between(x: Column) -> Column:
            spans, ends = x["spans"], x["ends"]
            gaps = F.filter(F.zip_with(spans, F.slice(ends, F.lit(1), F.size(spans)), lambda s, at: F.struct(at.alias("at"), s["start"].alias("start"))), lambda g: g["start"] >= g["at"])
            rest = piece(chunks, F.element_at(ends, -1), F.length(text).cast("bigint"))
            return F.array_join(F.concat(F.transform(gaps, lambda g: piece(chunks, g["at"], g["start"])), F.array(rest)), mark)

        return let(spans, lambda s: let(F.struct(s.alias("spans"), running(F.transform(s, lambda x: x["end"]), F.greatest).alias("ends")), between))

    return let(chunks, parts)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(documents(spark, sf_dir))
