"""Deleted interpolation against a plain version on the same documents."""

import collections
import math
import zlib

import numpy as np
import pytest

from stripweave.llm import lm

WORDS = "alpha beta gamma delta epsilon zeta eta theta".split()


def corpus():
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(WORDS, rng.integers(0, 30), p=[0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05])) for _ in range(300)]
    return [*enumerate(texts), (300, None), (301, ""), (302, "alpha beta " * 400), (303, texts[0]), (0, texts[0]), (None, "beta gamma")]


def plain(rows):
    """Scores and weights by dictionaries and loops."""
    crc = lambda i: zlib.crc32(("" if i is None else str(i)).encode())
    tokens = [["^", "^", *(t or "").split(), "$"] for _, t in rows]
    kind = ["test" if crc(i) % 7 == 2 else "held" if crc(i) // 7 % 8 == 0 else "kept" for i, _ in rows]

    def model(kinds):
        c = collections.Counter()
        for t, k in zip(tokens, kind, strict=True):
            if k in kinds:
                c[("^",)] += 1
                c[("^", "^")] += 1
                for j in range(2, len(t)):
                    c.update([(t[j],), (t[j - 1], t[j]), (t[j - 2], t[j - 1], t[j])])
        words = [c[w] for w in c if len(w) == 1 and w != ("^",)]
        return c, sum(words), len(words)

    octave = lambda x: 0 if x == 0 else int(math.log2(x)) + 1

    def event(m, u, v, w):
        c, n, _ = m
        f = [c[(w,)] / max(1, n), c[(v, w)] / max(1, c[(v,)]), c[(u, v, w)] / max(1, c[(u, v)])]
        return f, [1, octave(c[(v,)]), octave(c[(u, v)])]

    def mix(weights, m, f, b):
        p, out = 1 / (m[2] + 1), []
        for k in range(3):
            p = weights[k][b[k]] * f[k] + (1 - weights[k][b[k]]) * p
            out.append(p)
        return out

    kept, full = model({"kept"}), model({"kept", "held"})
    events = [event(kept, *t[j - 2 : j + 1]) for t, k in zip(tokens, kind, strict=True) if k == "held" for j in range(2, len(t))]
    weights, before = [collections.defaultdict(lambda: 0.5) for _ in range(3)], -math.inf
    for _ in range(lm.ROUNDS):
        s, n, fit = [collections.Counter() for _ in range(3)], [collections.Counter() for _ in range(3)], 0.0
        for f, b in events:
            p, reach = mix(weights, kept, f, b), 1.0
            fit += math.log(p[2])
            for k in (2, 1, 0):
                taken = reach * weights[k][b[k]] * f[k] / p[k]
                s[k][b[k]] += taken
                n[k][b[k]] += reach
                reach -= taken
        if fit / len(events) - before < lm.GAIN:
            break
        before = fit / len(events)
        for k in range(3):
            last = 0.5
            for i in range(0 if k == 0 else 1, lm.BUCKETS):
                last = weights[k][i] = min(1 - 1e-6, max(1e-6, s[k][i] / n[k][i])) if n[k][i] > 0 else last
            if k:
                weights[k][0] = 0.0
    scores = [sum(math.log10(mix(weights, full, *event(full, *t[j - 2 : j + 1]))[2]) for j in range(2, len(t))) for t in tokens]
    return scores, weights


@pytest.mark.parametrize(("parts", "chunk", "ranges"), [(1, 1 << 20, 1 << 20), (5, 700, 2000)])
def test_scores_equal_plain(spark, parts, chunk, ranges):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, chunk string, kind int").repartition(parts)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in lm.score(docs, chunk, ranges).collect())
    want = sorted((-1 if i is None else i, s) for (i, _), s in zip(rows, plain(rows)[0], strict=True))
    assert [i for i, _ in got] == [i for i, _ in want]
    np.testing.assert_allclose([s for _, s in got], [s for _, s in want], rtol=1e-9)


def test_probabilities_of_a_context_add_up_to_one():
    f = [np.array([0.5, 0.3, 0.2, 0.0]), np.array([0.1, 0.9, 0.0, 0.0]), np.array([0.0, 1.0, 0.0, 0.0])]
    b = [np.ones(4, int), np.full(4, 3), np.full(4, 2)]
    assert lm.Weights(floor=1 / 4).mix(f, b)[2].sum() == pytest.approx(1)


def test_packing():
    x = np.array([0, 1, 254, 255, 256, 10**12])
    assert lm.unpacked_counts(lm.packed_counts(x)).tolist() == x.tolist()
    h = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000).astype(np.uint64)) * np.uint64(2)
    assert (lm.unpacked_sorted(lm.packed_sorted(h)) == h).all()
    assert len(lm.unpacked_sorted(lm.packed_sorted(h[:0]))) == 0
