"""Operators and pipeline stages on harder tables, against plain versions."""

import collections
import math

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stripweave.llm import jaccard, mixing, quality, toxicity

from .test_llm import BASE, SCHEMA, hard_rows, plain_links

WORDS = [f"{a}{b}{c}" for a in ("ta", "ko", "ri", "me") for b in ("lo", "sun", "vi", "par") for c in ("ne", "do", "gra", "s")]


def linked(spark, rows, parts):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.linked(docs).collect())


def test_links_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(9)
    rows = []
    for k in range(12):  # pairs whose sizes straddle class bounds
        w = [f"w{x}" for x in rng.integers(0, 10**6, int(rng.integers(8, 700)))]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w[: max(3, len(w) - len(w) // 14)]))]
    want = plain_links(rows, 3, 90, 100)
    for parts in (1, 7, len(rows)):
        assert linked(spark, rows, parts) == want


def test_long_chains_are_searched_key_by_key(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = np.random.default_rng(10)
    words = [f"w{x}" for x in rng.integers(0, 10**6, 960)]
    rows = [(k, " ".join(words[k : k + 60])) for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(64)  # so that no key is hot in a piece
    assert jaccard.candidates(docs, 3, 90, 100).filter("groups IS NOT NULL").count() > 0
    assert linked(spark, rows, 64) == plain_links(rows, 3, 90, 100)


def plain_mcd(x):
    """Means, covariance and scale of one group."""
    n, p = x.shape
    middle = lambda v: np.sort(v, axis=0)[math.ceil(len(v) / 2) - 1]
    step = lambda d: np.floor(np.log(d + 1e-6) * 64)

    def cut(q, share):
        values, counts = np.unique(q, return_counts=True)
        return values[np.searchsorted(np.cumsum(counts), math.ceil(n * share))]

    def distance(m, v):
        return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(v), x - m)

    m0 = middle(x)
    far = ((x - m0) / (1.4826 * middle(np.abs(x - m0)) + quality.FLOOR)) ** 2
    best = None
    for d in (far.sum(1), far.max(1)):
        for _ in range(quality.STEPS):
            q = step(d)
            subset = x[q <= cut(q, quality.H)]
            m, v = subset.mean(0), np.cov(subset.T, bias=True) + np.eye(p) * quality.FLOOR**2
            d = distance(m, v)
        if best is None or np.linalg.slogdet(v)[1] < best[0] - 1e-9:
            best = np.linalg.slogdet(v)[1], m, v
    _, m, v = best
    return n, m, v, max(1.0, math.exp((cut(step(distance(m, v)), 0.5) + 1) / 64) / quality.MEDIAN)


def drawn(own, wider):
    n, m, v, s = own
    share = n / (n + quality.PRIOR)
    off = m - wider[1]
    return n, share * m + (1 - share) * wider[1], share * v + (1 - share) * wider[2] + share * (1 - share) * np.outer(off, off), share * s + (1 - share) * wider[3]


def test_distances_equal_plain(spark):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(260):
        w = list(rng.choice(WORDS, int(rng.integers(60, 160))))
        if k % 23 == 0:
            w = [f"{x}$$%" for x in w]
        rows.append((k, " ".join(w) + ("\nsame line\nsame line" if k % 9 == 0 else ""), ["en", "de", None][k % 7 % 3], ["a", "b"][k % 5 % 2]))
    docs = spark.createDataFrame([*rows, (900, None, "fr", "z"), (901, "too short", "fr", "z")], "doc_id long, text string, lang string, source string")
    stats = {r["doc_id"]: r for r in quality.with_statistics(quality.base_statistics(docs, "lang", "source")).collect()}
    ok = [r for r in stats.values() if not r["base_failed"]]
    table = lambda rs: np.array([[r[c] for c in quality.STATS] for r in rs], float)
    whole = plain_mcd(table(ok))
    want = {}
    for lang in {r["lang"] for r in ok}:
        of_lang = drawn(plain_mcd(table([r for r in ok if r["lang"] == lang])), whole)
        for source in {r["source"] for r in ok if r["lang"] == lang}:
            group = [r for r in ok if r["lang"] == lang and r["source"] == source]
            _, m, v, s = drawn(plain_mcd(table(group)), of_lang)
            want |= {r["doc_id"]: float((table([r])[0] - m) @ np.linalg.inv(v) @ (table([r])[0] - m) / s) for r in group}
    got = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert {k: r["distance"] for k, r in got.items() if k in want} == pytest.approx(want, rel=1e-6)
    assert {k for k, r in got.items() if r["kept"]} == {k for k, d in want.items() if d <= quality.CUTOFF}
    assert not got[900]["kept"]


def test_hard_rows_of_mix_and_toxicity(spark):
    docs = spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)
    mix = mixing.mix(mixing.sized(docs)).collect()
    assert len(mix) == len(hard_rows())
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in mix)
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(12)] + [(3, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    scores = toxicity.score(docs, toxicity.learned(docs, labels)).collect()
    assert len(scores) == len(hard_rows())
    assert all(0 <= r["score"] <= 1 for r in scores)
    by_text = collections.defaultdict(set)
    text = dict((r[0], r[1]) for r in hard_rows())
    for r in scores:
        by_text[text[r["doc_id"]] or ""].add(r["score"])
    assert all(len(x) == 1 for x in by_text.values())


def test_pipeline_on_a_planted_table(spark):
    import corpus_pipeline
    from stripweave.llm.common import written

    rng = np.random.default_rng(12)
    fresh = lambda: " ".join(f"{a}{b}" for a, b in zip(rng.choice(WORDS, 90), rng.choice(WORDS, 90), strict=True))
    texts = {k: fresh() for k in range(40)}
    texts[50], texts[51] = texts[3], texts[4].rsplit(" ", 2)[0]  # an exact and a near copy
    texts[60] = "short text"
    texts[7] += " password=abcdefghijkl0007"
    texts |= {k: texts[k] + " token=examplevalue000000" for k in (10, 11, 12)}
    source = lambda k: "abc"[k % 3]
    rows = [(k, t, "en", source(k), len(t), 1) for k, t in texts.items()]
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, ""), "stage")
        seen.append(sorted(tuple(r) for r in now.collect()))
    ids = [[r[0] for r in rows] for rows in seen]
    assert ids[0] == sorted(set(texts) - {60})
    assert ids[1] == sorted(set(texts) - {50, 51, 60})
    after = dict((r[0], r[1]) for r in seen[2])
    assert after[7].endswith(" [secret]")
    assert all(after[k] == texts[k] for k in ids[2] if k != 7)
    assert set(ids[3]) <= set(ids[2])
    sizes = collections.Counter()
    for k in ids[2]:
        sizes[source(k)] += len(after[k].split())
    taken = collections.Counter()
    for k in ids[3]:
        taken[source(k)] += len(after[k].split())
    for r in mixing.mix(mixing.sized(spark.createDataFrame([(k, after[k], source(k)) for k in ids[2]], "doc_id long, text string, source string"))).select("source", "target").distinct().collect():
        assert abs(taken[r["source"]] - r["target"]) <= 60
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert sorted((r[0], r[1]) for r in seen[4]) == sorted((k, len(library.encode(after[k], add_special_tokens=False).ids)) for k in ids[3])


def test_pipeline_on_an_empty_table(spark):
    import corpus_pipeline
    from stripweave.llm.common import written

    now = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        now = written(stage(spark, now, ""), "stage")
    assert now.count() == 0
    assert BASE
