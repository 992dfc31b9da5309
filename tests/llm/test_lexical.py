"""Ranked search against SQL and plain scoring."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from tests.conftest import SF
from tests.oracle import assert_same
from tidemark.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(t):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), t or ""))


def brute(docs, items, k):
    each = [(d, Counter(terms(t))) for d, t in docs if terms(t)]
    n_docs, n_terms = len(each), sum(sum(c.values()) for _, c in each)
    df = Counter(t for _, c in each for t in c)
    out = []
    for item, text in items:
        found = []
        for d, c in each:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if s > 0:
                found.append((-s, d is None, d))
        out += [(item, r, x[2], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(map(repr, out))


DOCS = [
    (1, "The cat sat on the mat. THE END"), (2, None), (3, ""), (4, " .,; "), (5, "cat cat cat dog"), (5, "cat cat cat dog"), (6, "dog " * 300 + "cat"), (7, "naïve Über été 日本 x1"),
    (None, "no id, a cat"), (8, "mat " * 70_000 + "rare"), (9, "rare bird\x00bird"), *[(100 + i, f"common words here number{i % 7} again") for i in range(60)],
]
ITEMS = [(1, "the cat"), (2, "CAT dog dog"), (3, None), (4, ""), (5, "common number3"), (5, "common number3"), (5, "naïve ÜBER été"), (None, "rare bird mat"), (6, "unknownterm")]


@pytest.mark.parametrize("passes", [1 << 17, 3])
def test_search_against_brute_force(spark, monkeypatch, passes):
    monkeypatch.setattr(lexical, "TERMS", passes)
    docs = spark.createDataFrame([(*r, 1) for r in DOCS], "doc_id long, text string, score int").repartition(3)
    items = spark.createDataFrame([(*r, "x") for r in ITEMS], "item_id long, text string, rank string")
    got = lexical.search(lexical.index(docs), items, k=4)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(repr(tuple(r)) for r in got.collect()) == brute(DOCS, dict.fromkeys(ITEMS), 4)
    if passes > 3:
        named = spark.createDataFrame([(f"d{a}" if a else None, b) for a, b in DOCS], "doc_id string, text string")
        assert sorted(repr(tuple(r)) for r in lexical.search(lexical.index(named), items, k=4).collect()) == brute([(f"d{a}" if a else None, b) for a, b in DOCS], dict.fromkeys(ITEMS), 4)
        assert lexical.search(lexical.index(docs.where("false")), items).count() == 0
        assert lexical.search(lexical.index(docs), items.where("false")).count() == 0


def test_bounds_hold_and_exclude():
    r = np.random.default_rng(1)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(words[int(x)] for x in np.minimum(r.zipf(1.3, r.integers(5, 400)), 2999)) for _ in range(200)]
    rows = []
    for i, t in enumerate(texts):
        h, tf = lexical.terms(t)
        rows.append((i, int(tf.sum()), lexical.entries(h, tf), t))
    block = lexical._block(4096, rows)
    slices = np.frombuffer(block["slices"], np.uint8).reshape(4096, -1)
    h, q = lexical.terms("w1 w2 w17 w900 w1200 w2500")
    query = lexical.Query([0], [h], [np.full(len(h), 1000.0)])
    n = np.array(block["n"])
    m = 75 + 25 * n * 200 // n.sum()
    upper = lexical.bounds(query, query.present(slices), n, m)[0]
    exact = np.array([sum(1000 * (1000000000 * c // (1000 * c + 12 * int(x))) for w in "w1 w2 w17 w900 w1200 w2500".split() if (c := Counter(t.split())[w])) for t, x in zip(texts, m)])
    assert (upper >= exact).all() and np.median(upper / np.maximum(exact, 1)) < 1.2
    best = lexical.Best(1, 5)
    lexical.score_block(query, best, block["ids"], n, texts, slices, 200, int(n.sum()))
    assert [s for s, _ in best.held[0]] == sorted(exact.tolist())[::-1][:5]
    assert lexical.score_block(query, best, block["ids"], n, texts, slices, 200, int(n.sum())) < 100


def test_op12_against_sql(spark):
    sf = SF.replace("0.001", "0.01")
    assert_same(lexical.op12_bit_sliced_search(spark, sf), lexical.OP12_SQL, sf)
