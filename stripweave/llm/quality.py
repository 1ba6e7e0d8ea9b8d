"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates.

Each (lang, source), each language and the whole table has its own centre and scatter of transformed text statistics: from
two robust starts, concentration steps take the share `H` of rows with the least Mahalanobis distance
and estimate again; the start with the smaller determinant counts. A group's estimates are then drawn towards those of
its language, and these towards the whole table's, as if `PRIOR` rows of the wider group were in it; so groups of every size are
judged alike, and small ones mostly by what is usual around them. Statistics are whole numbers (thousandths), so sums
are exact and reruns agree.

Null text: no words, so base_failed. Null lang or source: a value of its own. Empty and very long
texts, ties and repeated rows: every row is judged alone, equal rows alike. An empty table gives no
rows. Only doc_id, text, lang and source are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import GAP, documents, text_or_empty, written

H, STEPS, PRIOR = 0.75, 4, 60
#: Least standard deviation of each statistic, in thousandths, so that constant statistics have a scale.
FLOOR = 300
#: Squared distance beyond which a document is rejected (ten robust standard deviations: only gross outliers go).
CUTOFF = 100.0
#: Fixed value: the median of the chi-squared distribution with five degrees of freedom.
MEDIAN = 4.351
STATS = ("s_words", "s_length", "s_symbols", "s_lines", "s_repeats")
#: Keys up to which the table of estimates is broadcast: under 40 MB.
BROADCAST_KEYS = 100_000


def base_statistics(docs: DataFrame, *more: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words of whole texts."""
    text, word = F.col("t"), F.col("w")
    rows = docs.select("doc_id", *more, text_or_empty().alias("t"))
    rows = rows.withColumn("w", F.filter(F.split(text, GAP), lambda x: x != ""))
    rows = rows.withColumn("n_words", F.size(word).cast("long"))
    n = F.col("n_words").cast("int")
    three = F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.xxhash64(F.get(word, i - 1), F.get(word, i), F.get(word, i + 1)))
    rows = rows.withColumn("three", F.when(n > 2, three).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("sorted", F.when(F.size(F.array_distinct("three")) < F.size("three"), F.sort_array(F.arrays_zip(F.col("three").alias("h"), F.sequence(F.lit(0), F.size("three") - 1).alias("i")))))
    at = lambda i: F.get(F.col("sorted"), i)
    last = F.size("sorted") - 1
    twice = F.filter("sorted", lambda x, i: (F.coalesce(at(i - 1)["h"] == x["h"], F.lit(False))) | ((i < last) & F.coalesce(at(i + 1)["h"] == x["h"], F.lit(False))))
    covered = F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (
        rows.withColumn("lines", lines)
        .select(
            "doc_id",
            *more,
            "n_words",
            F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.when(F.col("sorted").isNull(), 0).otherwise(covered).cast("long").alias("n_repeat_words"),
        )
    )


def with_statistics(base: DataFrame) -> DataFrame:
    """base_failed and the five transformed statistics."""
    milli = lambda x: F.round(x * 1000).cast("long")
    words = F.greatest(F.col("n_words"), F.lit(1))
    return base.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "s_words": milli(F.log1p("n_words")),
            "s_length": milli(4 * F.log((F.col("word_chars") + 1) / words)),
            "s_symbols": milli(F.log1p(100 * F.col("n_symbols") / words)),
            "s_lines": milli(F.log1p(20 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
            "s_repeats": milli(F.log1p(20 * F.col("n_repeat_words") / words)),
        }
    )


def named(rows: DataFrame) -> DataFrame:
    """k_lang, k_both: the names of a row's language and of its language and source."""
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    return rows.withColumn("k_lang", name("lang")).withColumn("k_both", F.concat(F.length("k_lang"), F.lit(":"), F.col("k_lang"), name("source")))


#: Name of the group of all rows.
ALL = "all"


def with_levels(rows: DataFrame) -> DataFrame:
    """key: each row once for its (lang, source), once for its language and once for all."""
    keys = F.array(F.concat(F.lit("b"), "k_both"), F.concat(F.lit("l"), "k_lang"), F.lit(ALL))
    return named(rows).select(F.explode(keys).alias("key"), *STATS)


def small(table: DataFrame, n: int) -> DataFrame:
    """Broadcast behind a check of its size; beyond it, Spark joins by shuffle."""
    return F.broadcast(table) if n <= BROADCAST_KEYS else table


P = len(STATS)
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def estimates(subset: DataFrame) -> DataFrame:
    """n, mean m0.. and covariance v00.. by key and start."""
    sums = subset.groupBy("key", "start").agg(
        F.count("*").alias("n"),
        *[F.sum(c).alias(f"x{i}") for i, c in enumerate(STATS)],
        *[F.sum((F.col(STATS[i]) * F.col(STATS[j])).cast("decimal(38,0)")).cast("double").alias(f"x{i}{j}") for i, j in PAIRS],
    )
    mean = lambda i: F.col(f"x{i}") / F.col("n")
    covariance = lambda i, j: F.col(f"x{i}{j}") / F.col("n") - mean(i) * mean(j) + (FLOOR**2 if i == j else 0)
    return sums.select("key", "start", "n", *[mean(i).alias(f"m{i}") for i in range(P)], *[covariance(i, j).alias(f"v{i}{j}") for i, j in PAIRS])


def factored(table: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor c00.. of the covariance and its log-determinant."""
    out = table
    for j in range(P):
        out = out.withColumn(f"c{j}{j}", F.sqrt(F.greatest(F.col(f"v{j}{j}") - sum((F.col(f"c{j}{k}") ** 2 for k in range(j)), F.lit(0.0)), F.lit(1.0))))
        out = out.withColumns({f"c{i}{j}": (F.col(f"v{i}{j}") - sum((F.col(f"c{i}{k}") * F.col(f"c{j}{k}") for k in range(j)), F.lit(0.0))) / F.col(f"c{j}{j}") for i in range(j + 1, P)})
    return out.withColumn("log_det", sum((F.log(f"c{j}{j}") for j in range(P)), F.lit(0.0)))


def drawn(own: DataFrame, wider: DataFrame) -> DataFrame:
    """own: key, parent, n, m, v, scale; wider: the same by key. own as if PRIOR rows of the wider group were among its rows."""
    w = wider.select(F.col("key").alias("w_key"), *[F.col(c).alias(f"w_{c}") for c in (*(f"m{i}" for i in range(P)), *(f"v{i}{j}" for i, j in PAIRS), "scale")])
    rows = own.join(w, F.col("parent") == F.col("w_key"))
    share = F.col("n") / (F.col("n") + PRIOR)
    blend = lambda c: share * F.col(c) + (1 - share) * F.col(f"w_{c}")
    apart = lambda i: F.col(f"m{i}") - F.col(f"w_m{i}")
    means = [blend(f"m{i}").alias(f"m{i}") for i in range(P)]
    covariances = [(blend(f"v{i}{j}") + share * (1 - share) * apart(i) * apart(j)).alias(f"v{i}{j}") for i, j in PAIRS]
    return rows.select("key", "n", *means, *covariances, blend("scale").alias("scale"))


def distance(rows: DataFrame) -> DataFrame:
    """Squared Mahalanobis distance d by forward substitution; rows have the columns of estimates()."""
    for i in range(P):
        z = (F.col(STATS[i]) - F.col(f"m{i}") - sum((F.col(f"c{i}{k}") * F.col(f"z{k}") for k in range(i)), F.lit(0.0))) / F.col(f"c{i}{i}")
        rows = rows.withColumn(f"z{i}", z)
    return rows.withColumn("d", sum((F.col(f"z{i}") ** 2 for i in range(P)), F.lit(0.0))).drop(*[f"z{i}" for i in range(P)])


def cut_at(rows: DataFrame, share: float) -> DataFrame:
    """key, start, at: the least step of ln(d) such that `share` of the rows are at or below it, from a histogram by key."""
    counts = rows.groupBy("key", "start", "q").agg(F.count("*").alias("n"))
    by = Window.partitionBy("key", "start")
    up_to = F.sum("n").over(by.orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumn("up_to", up_to).withColumn("all", F.sum("n").over(by))
    return counts.filter(F.col("up_to") >= F.ceil(F.col("all") * F.lit(share))).groupBy("key", "start").agg(F.min("q").alias("at"))


def in_steps(d: Column) -> Column:
    return F.floor(F.log(d + 1e-6) * 64).cast("int")


def mcd(rows: DataFrame, n_keys: int) -> DataFrame:
    """Estimates of each key: those of the start with the least determinant, with `scale` for distances."""
    middle = rows.groupBy("key").agg(*[F.percentile_approx(c, 0.5, 10000).alias(f"m{i}") for i, c in enumerate(STATS)])
    off = rows.join(small(written(middle, "middle"), n_keys), "key")
    spread = off.groupBy("key").agg(*[F.percentile_approx(F.abs(F.col(c) - F.col(f"m{i}")), 0.5, 10000).alias(f"w{i}") for i, c in enumerate(STATS)])
    off = off.join(small(written(spread, "spread"), n_keys), "key")
    far = [((F.col(c) - F.col(f"m{i}")) / (1.4826 * F.col(f"w{i}") + FLOOR)) ** 2 for i, c in enumerate(STATS)]
    starts = off.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("d", F.when(F.col("start") == 0, sum(far, F.lit(0.0))).otherwise(F.greatest(*far)))
    for _ in range(STEPS):
        starts = starts.withColumn("q", in_steps(F.col("d"))).select("key", "start", "q", *STATS)
        subset = starts.join(small(cut_at(starts, H), 2 * n_keys), ["key", "start"]).filter(F.col("q") <= F.col("at"))
        found = written(factored(estimates(subset)), "estimates")
        starts = distance(rows.join(small(found, 2 * n_keys), "key"))
    best = found.groupBy("key").agg(F.min(F.struct("log_det", "start")).alias("best"))
    found = found.join(best, "key").filter(F.col("best.start") == F.col("start")).drop("best")
    final = distance(rows.join(small(found, n_keys), "key")).withColumn("q", in_steps(F.col("d")))
    half = cut_at(final, 0.5).select("key", F.greatest(F.lit(1.0), F.exp((F.col("at") + 1) / 64) / MEDIAN).alias("scale"))
    return found.join(half, "key")


def in_levels(rows: DataFrame, found: DataFrame) -> DataFrame:
    """b: the group's name k_both; estimates of each group, drawn towards its language and all rows."""
    groups = named(rows).select("k_lang", "k_both").distinct()
    n = {"n": F.col("rows")}
    counts = with_levels(rows.filter(~F.col("base_failed"))).groupBy("key").agg(F.count("*").alias("rows"))
    found = written(found.drop("n").join(counts, "key").withColumns(n).select("key", "n", *[f"m{i}" for i in range(P)], *[f"v{i}{j}" for i, j in PAIRS], "scale"), "levels")
    whole = found.filter(F.col("key") == ALL)
    lang = groups.select(F.concat(F.lit("l"), "k_lang").alias("k"), F.lit(ALL).alias("parent")).distinct()
    lang = drawn(of_groups(lang, found, whole), whole)
    both = groups.select(F.concat(F.lit("b"), "k_both").alias("k"), F.concat(F.lit("l"), "k_lang").alias("parent"))
    both = drawn(of_groups(both, found, lang), lang)
    return factored(both).withColumn("b", F.substring("key", 2, 1 << 30))


def of_groups(groups: DataFrame, found: DataFrame, wider: DataFrame) -> DataFrame:
    """groups: k, parent, with their own estimates; a group without any rows to learn from has its parent's, with no weight."""
    names = [*(f"m{i}" for i in range(P)), *(f"v{i}{j}" for i, j in PAIRS), "scale"]
    own = groups.join(found, F.col("k") == F.col("key"), "left").drop("key")
    up = wider.select(F.col("key").alias("up"), *[F.col(c).alias(f"up_{c}") for c in names])
    rows = own.join(up, F.col("parent") == F.col("up"))
    return rows.select(F.col("k").alias("key"), "parent", F.coalesce("n", F.lit(0)).alias("n"), *[F.coalesce(c, f"up_{c}").alias(c) for c in names])


class Judge:
    """The estimates learned from all documents, and their verdicts on rows that have the statistics."""

    def __init__(self, rows: DataFrame):
        passed = with_levels(rows.filter(~F.col("base_failed")))
        self.n_keys = named(rows).select("k_lang", "k_both").distinct().count() * 2 + 1
        self.found = written(in_levels(rows, mcd(passed, self.n_keys)), "mcd")

    def judged(self, rows: DataFrame) -> DataFrame:
        """Where no row at all passed the base rules, nothing is known and distance is null; no row is kept then either."""
        rows = distance(named(rows).join(small(self.found.drop("key", "n"), self.n_keys), F.col("k_both") == F.col("b"), "left"))
        rows = rows.withColumn("distance", F.col("d") / F.col("scale"))
        return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True)))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, base_failed, kept and the distance."""
    rows = written(with_statistics(base_statistics(docs, "lang", "source")), "statistics")
    return Judge(rows).judged(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, all columns as they were. The rows are written once beside their statistics, so texts aren't shuffled."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    rows = docs.select("doc_id", "text", "lang", "source", whole)
    rows = written(with_statistics(base_statistics(rows, "lang", "source", "whole")), "statistics")
    return Judge(rows).judged(rows).filter("kept").select("whole.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
