"""Decontamination, filter audits and fill-in-the-middle on small tables with hard rows, against plain versions."""

import collections
import hashlib
import itertools
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from stripweave.llm import audit, contamination, infill

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, body string, place int, hash string, range string, part string, mask int, n long, hit string, items string, quality int"
LONG = "\n".join(" ".join(f"w{(k * j) % 97}" for j in range(9)) for k in range(400))
ITEMS = [("a", "The quick, brown fox jumps over the lazy dog and runs away again"), ("b", "short one"), ("c", "The QUICK brown fox jumps over the lazy dog and sleeps"), ("d", None), ("e", " ?! "), (None, "ünï çödé wörds"), ("b", "Short, one!"), ("f", "a a a")]
TEXTS = [
    None, "", " \n\t ", "\n", "\n\n", "one", "one", "ONE two", "x\nü😀ñ\ny", "a<P>b", "<M>", LONG, LONG, LONG + " ", "trailing\x00", "no end\nof line", "AB# cd",
    "so: the quick brown fox jumps over the lazy dog and runs -- short ONE.", "shorter one, a short one; shortone short 1one", "Ünï çödé wörds and ünï Çödé wörds", "a a a a a", "quick brown fox jumps over the lazy dog and runs",
    "A" * 50, "UP down " * 150, " ".join(f"v{k}" for k in range(250)), " ".join(f"v{k}" for k in range(251)), "$ " + " ".join(f"v{k}" for k in range(250)),
]


def hard_rows():
    rows = [(k, t, ["en", None, "", "de"][k % 4]) for k, t in enumerate(TEXTS)]
    rows += [(None, "one", "en"), (None, "no id", "en"), (None, "no id", "de"), rows[11], rows[17], (2000, LONG, "en"), (3, "the same id, another text", "en")]
    return [(*r, "s", 0, 1, "b", 2, "h", "r", "p", 3, 4, "x", "y", 5) for r in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(*x, "h", "w") for x in ITEMS], "item_id string, text string, hit string, n_words string")


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]


def plain_contamination(text, size=10):
    words = [w for w, *_ in plain_words(text)]
    hit, items = set(), set()
    for item, item_text in ITEMS:
        own = [w for w, *_ in plain_words(item_text)]
        k = min(size, len(own))
        for j in range(len(own) - k + 1 if k else 0):
            for i in range(len(words) - k + 1):
                if words[i : i + k] == own[j : j + k]:
                    hit.update(range(i, i + k))
                    items.add(item or "")
    return words, hit, sorted(items)


@pytest.mark.parametrize(("size", "most_bytes"), [(10, 1 << 20), (10, 20), (3, 1 << 20), (2, 60)])
def test_contamination_equals_plain(docs, benchmark, size, most_bytes):
    got = collections.Counter()
    for r in contamination.report(docs, benchmark, size, most_bytes).collect():
        got[r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"], tuple((p["start"], p["end"]) for p in r["passages"])] += 1
    expected = collections.Counter()
    for doc_id, text, *_ in hard_rows():
        words, hit, items = plain_contamination(text, size)
        runs = [[k for _, k in g] for _, g in itertools.groupby(enumerate(sorted(hit)), lambda x: x[1] - x[0])]
        places = plain_words(text)
        passages = tuple((places[r[0]][1], places[r[-1]][2]) for r in runs)
        expected[doc_id, len(words), len(hit), len(items), sha(",".join(items)), bool(hit), passages] += 1
    joined = lambda c: collections.Counter({k[:-1]: 0 for k in c} | {k[:-1]: v for k, v in c.items()})
    if most_bytes < 1 << 20:  # runs that touch may come from different automata
        got, expected = joined(got), joined(expected)
    assert got == expected


@given(st.lists(st.sampled_from("abcd"), max_size=60), st.lists(st.lists(st.sampled_from("abcd"), max_size=7), max_size=5), st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_stretches_miss_nothing(words, items, size):
    scanner = contamination.Scanner([(str(k), " ".join(x)) for k, x in enumerate(items)], size)
    raw = " ".join(words).encode()
    whole, contamination.STRETCH = contamination.STRETCH, 7
    try:
        got = scanner.scan(raw)
    finally:
        contamination.STRETCH = whole
    n, runs, found = scanner.scan(raw)
    covered = lambda spans: {k for a, b in spans for k in range(a, b)}
    assert (got[0], covered(got[1]), got[2]) == (n, covered(runs), found)
    own = {str(k): ["".join(x[j : j + min(size, len(x))]) for j in range(max(1, len(x) - size + 1))] for k, x in enumerate(items) if x}
    assert found == sorted(k for k, w in own.items() if any(x in "".join(words) for x in w))


def test_empty_tables(spark, docs, benchmark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert contamination.report(none, benchmark).count() == 0
    assert contamination.report(docs, benchmark.limit(0)).filter("contaminated OR n_items > 0").count() == 0
    assert audit.audit(audit.masks(none), labels).count() == 0
    assert infill.report(none).count() == 0


def plain_masks():
    rows = [(r[0], r[1] or "", r[2] or "") for r in hard_rows()]
    rank = lambda i: (i is None, i or 0)
    least = {}
    for doc_id, text, _ in rows:
        least[text] = min(least.get(text, (True, 1)), rank(doc_id))
    for doc_id, text, part in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search("[#$%&*|]", text)), rank(doc_id) > least[text]
        yield doc_id, part, {x for x, f in zip("ABCDE", fails, strict=True) if f}


@pytest.mark.parametrize(("range_bytes", "hot"), [(1 << 20, 1000), (1, 1000), (40, 1), (2000, 2)])
def test_masks_equal_plain(docs, range_bytes, hot):
    got = collections.Counter()
    for r in audit.masks(docs, range_bytes, hot).collect():
        got[r["doc_id"], r["part"], frozenset(x for x, bit in audit.BIT.items() if r["mask"] & bit)] += r["n"]
    assert got == collections.Counter((i, p, frozenset(f)) for i, p, f in plain_masks())


def test_audit_equals_plain(spark, docs):
    told = [(11, 1, 0), (12, 1, 1), (12, 0, 0), (6, None, 1), (2000, 1, None), (None, 1, 1), (99999, 1, 1)]
    labels = spark.createDataFrame(told, "doc_id long, quality int, toxic int")
    good, toxic = ({t[0] for t in told if t[k] == 1 and t[0] is not None} for k in (1, 2))
    rows = list(plain_masks())
    expected, shapley = {}, collections.Counter()
    for order in itertools.permutations("ABCDE"):
        for part in {p for _, p, _ in rows}:
            left, gone = [r for r in rows if r[1] == part], []
            for step, x in enumerate(order, 1):
                out = [r for r in left if x in r[2]]
                again = sum(x in r[2] for r in gone)
                left = [r for r in left if x not in r[2]]
                gone += out
                shapley[part, x] += len(out)
                expected[part, "".join(order), step] = [len(left), len(out), again, sum(r[1] == part and r[2] == {x} for r in rows), sum(r[0] in good for r in out), sum(r[0] in toxic for r in out)]
    got = {(r["part"], r["filter_order"], r["step"]): r for r in audit.audit(audit.masks(docs), labels).collect()}
    assert {k: [r["kept"], r["removed"], r["redundant"], r["unique_fails"], r["good_lost"], r["toxic_lost"]] for k, r in got.items()} == expected
    assert all(r["shapley"] == shapley[part, order[step - 1]] for (part, order, step), r in got.items())


@given(st.lists(st.text("ab", max_size=8), max_size=40))
@settings(max_examples=200, deadline=None)
def test_tries_hold_least_ids(texts):
    trie = audit.Trie()
    for k, text in enumerate(texts):
        trie.insert(text, (k * 7 % 41, text))
    got = sorted((row, again) for again, row in trie.rows())
    least = {}
    for k, text in enumerate(texts):
        least[text] = min(least.get(text, 99), k * 7 % 41)
    assert got == sorted(((k * 7 % 41, t), k * 7 % 41 > least[t]) for k, t in enumerate(texts))


def plain_infill(doc_id, text, rate, spm, seed):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("rate", "spm", "seed"), [(100, 50, 7), (50, 0, 1), (100, 100, 2)])
def test_infill_equals_plain(docs, rate, spm, seed):
    got = collections.Counter(tuple(r) for r in infill.report(docs, rate, spm, seed).collect())
    expected = collections.Counter()
    for doc_id, text, *_ in hard_rows():
        *told, output = plain_infill(doc_id, text or "", rate, spm, seed)
        expected[doc_id, *told, sha(output), sha(text or "")] += 1
    assert got == expected


@pytest.mark.parametrize("size", [1, 7, 300])
def test_pieces_of_any_size(docs, size):
    found = infill.restored(infill.assembled(infill.cut(docs, size=size), infill.Text), infill.Text)
    got = collections.Counter((r["doc_id"], bytes(r["output"]).decode(), bytes(r["restored"]).decode()) for r in found.collect())
    assert got == collections.Counter((i, plain_infill(i, t or "", 100, 50, 7)[-1], t or "") for i, t, *_ in hard_rows())


def test_outputs_are_turned_back(docs):
    outputs = infill.transformed(docs)
    assert {r["form"] for r in outputs.collect()} == {"plain", "psm", "spm"}
    got = collections.Counter((r["doc_id"], r["text"]) for r in infill.untransformed(outputs).collect())
    assert got == collections.Counter((i, t or "") for i, t, *_ in hard_rows())
