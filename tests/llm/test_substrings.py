"""Windows that occur before, against brute force."""

import hashlib
import random
import re

import pytest
from tests.conftest import SF
from tidemark.llm import substrings
from tidemark.session import table

W = substrings.WINDOW


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute(rows):
    """``(n_words, n_removed, kept)`` of each row."""
    last = (1, 0)
    key = lambda d: last if d is None else (0, d)
    first = {}
    for d, t in rows:
        w = words(t)
        for i in range(len(w) - W + 1):
            s = tuple(w[i : i + W])
            first[s] = min(first.get(s, ((2, 0), 0)), (key(d), i))
    out = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - W + 1):
            if first[tuple(w[i : i + W])] != (key(d), i):
                gone[i : i + W] = [True] * W
        out.append((len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def cases():
    r = random.Random(5)
    some = lambda n: " ".join(f"w{r.randrange(400)}" for _ in range(n))
    line, passage = some(24), some(60)
    rows = [(i, f"{some(30)} {line} {some(r.randrange(40))}") for i in range(40)]
    rows += [(100 + i, f"{some(10)} {passage[: r.randrange(40, 200)]} {some(25)}") for i in range(20)]
    rows += [(200, passage), (201, passage), (202, "of " * 900), (203, "a b c " * 200), (204, f"of {'of ' * 40}"), (205, some(19))]
    rows += [(300, None), (301, ""), (302, " \n\t "), (303, passage + " Tail"), (303, passage + " Tail"), (304, passage), (304, line + " other"), (None, passage), (None, "x " + line)]
    rows += [(400, some(5000) + " " + passage), (401, passage.replace("w", "W"))]
    return rows


@pytest.mark.parametrize("hot", [1, substrings.HOT])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    rows = cases()
    docs = spark.createDataFrame([(d, t, "mine", 7) for d, t in rows], "doc_id long, text string, d string, n_words int").repartition(3)
    out = substrings.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "d", "n_words", "n_removed", "kept"]
    got = sorted(repr((r.doc_id, r.text, r.n_words, r.n_removed, r.kept)) for r in out.collect())
    assert got == sorted(repr((d, t, *x)) for (d, t), x in zip(rows, brute(rows)))
    digests = substrings.remove_repeats(docs, digest=True).collect()
    want = sorted(repr((d, n, hashlib.sha256(k.encode()).hexdigest())) for (d, _), (_, n, k) in zip(rows, brute(rows)))
    assert sorted(repr((r.doc_id, r.n_removed, r.kept_sha256)) for r in digests) == want


def test_keys_of_text_and_empty_table(spark):
    p = " ".join(map(str, range(30)))
    docs = spark.createDataFrame([("b", p), ("a", p), (None, p), ("c", None)], "name string, text string")
    got = {r.name: (r.n_words, r.n_removed) for r in substrings.remove_repeats(docs, key="name").collect()}
    assert got == {"a": (30, 0), "b": (30, 30), None: (30, 30), "c": (0, 0)}
    assert substrings.remove_repeats(docs.where("false"), key="name").count() == 0


def test_superkmers_of_a_long_text_and_its_parts(monkeypatch):
    import numpy as np

    h = np.arange(5000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    m, s, a, w, own = substrings.superkmers(h)
    assert w.sum() == 5000 - W + 1 and (a == np.cumsum(w) - w).all() and not own.any() and (w >= 1).all()
    monkeypatch.setattr(substrings, "STEP", 1000)
    assert substrings.superkmers(h)[3].sum() == 5000 - W + 1
    assert substrings.superkmers(np.zeros(300, np.uint64))[4].any()
    assert all(len(x) == 0 for x in substrings.superkmers(h[: W - 1]))


def test_op11_on_the_tables(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.op11_super_kmer_dedup(spark, SF).collect()}
    assert got == {d: (n, k, hashlib.sha256(x.encode()).hexdigest()) for (d, _), (n, k, x) in zip(docs, brute(docs))}
    assert any(0 < k < n for n, k, _ in got.values())


def test_hashes_of_longs_are_those_of_spark(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from tidemark.llm.batches import hash_longs

    rows = [(0, 1, -1), (1 << 62, -(1 << 63), 7), (-5, 123456789, 0)]
    got = hash_longs(*[np.array(c, np.int64) for c in zip(*rows)]).view(np.int64).tolist()
    assert got == [r.h for r in spark.createDataFrame(rows, "a long, b long, c long").select(F.xxhash64("a", "b", "c").alias("h")).collect()]
