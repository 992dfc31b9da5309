"""Purge and splits: rows without ids, blacklists of any size, and each guard of the flow."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF
from tidemark.functions import filters, texts
from tidemark.operators import families, guards, purge, splits
from tidemark.plans import leakage
from tidemark.session import table

PASSAGE = "one two three four five six seven eight nine"


@pytest.mark.parametrize("small", [1_000_000, 0])
def test_purge_of_rows_without_id_and_of_repeated_ids(spark, small):
    rows = [(None, "x " + PASSAGE), (None, "clean words"), (1, "y " + PASSAGE), (1, "other"), (2, PASSAGE), (3, None), (4, ""), (5, f"{PASSAGE} {PASSAGE} ten")]
    pool = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bad = spark.createDataFrame([(PASSAGE,), (None,), ("short",)], "text string")
    got = sorted(((r.doc_id, r.text, r.status, r.n_shared) for r in purge.purge_texts(pool, bad, small=small).collect()), key=repr)
    want = {"x " + PASSAGE: ("passage", 2), "clean words": ("kept", 0), "y " + PASSAGE: ("passage", 2), "other": ("kept", 0), PASSAGE: ("exact", 2), None: ("kept", 0), "": ("kept", 0), f"{PASSAGE} {PASSAGE} ten": ("passage", 2)}
    assert got == sorted(((d, t, *want[t]) for d, t in rows), key=repr)
    assert purge.purge_texts(pool, bad.where("false"), small=small).where("status <> 'kept'").count() == 0


def test_both_ways_of_purging_agree_on_the_table(spark):
    docs, bench = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    a, b = (purge.count_shared(docs.select("doc_id", "text"), bench, small=n).select("doc_id", "n_shared") for n in (1_000_000, 10))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0 and a.where("n_shared > 0").count() > 0


def test_filter_holds_what_it_was_built_from(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("h"))
    bits = filters.bloom(keys, "h", 5000)
    held = np.array([r.h for r in keys.collect()], np.int64)
    assert filters.may_hold(bits, held).all()
    other = np.array([r.h for r in spark.range(10_000, 30_000).select(F.xxhash64("id").alias("h")).collect()], np.int64)
    assert filters.may_hold(bits, other).mean() < 0.02


def test_windows_of_texts_hashed_together_and_in_parts(monkeypatch):
    some = ["Straße ÉCOLE école 日本語 q̃x one-two_three 4", None, "", "a b c d", "x " * 400 + "été ΣΑΣ"]
    whole = texts.hash_windows(some, 2)
    assert [len(w) for w in whole] == [8, 0, 0, 3, 3]
    alone = [texts.hash_windows([t], 2)[0] for t in some]
    monkeypatch.setattr(texts, "CHUNK", 64)
    texts._powers.cache_clear()
    parts = texts.hash_windows(some, 2)
    texts._powers.cache_clear()
    assert all((a == b).all() and (a == c).all() for a, b, c in zip(whole, alone, parts))
    assert texts.hash_windows(["one two"], 2)[0].tolist() == texts.hash_windows(["zero ONE, two"], 2)[0][np.isin(texts.hash_windows(["zero ONE, two"], 2)[0], texts.hash_windows(["one two"], 2)[0])].tolist()


def _rows(spark, rows):
    return spark.createDataFrame(rows, "id long, a string, b string")


def test_each_guard_stops_the_split(spark):
    fine = [(i, f"a{i // 2}", None) for i in range(300)]
    out = splits.split_by_family(_rows(spark, fine), "id", ["a", "b"])
    assert out.count() == 300 and out.groupBy("family_id").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    with pytest.raises(splits.MissingUnitError):
        splits.split_by_family(_rows(spark, [*fine, (None, "x", None)]), "id", ["a", "b"])
    with pytest.raises(families.DuplicateNodeError):
        splits.split_by_family(_rows(spark, [*fine, (5, "x", None)]), "id", ["a", "b"])
    chained = [(i, "same" if i % 3 == 0 else f"a{i}", None) for i in range(300)]
    with pytest.raises(families.PercolationError):
        splits.split_by_family(_rows(spark, chained), "id", ["a", "b"])
    assert splits.split_by_family(_rows(spark, chained), "id", ["a", "b"], most_family=1.0).count() == 300
    with pytest.raises(splits.DegenerateSplitError):
        splits.split_by_family(_rows(spark, [(i, "same" if i else "x", None) for i in range(300)]), "id", ["a", "b"], most_family=1.0)
    assert splits.split_by_family(_rows(spark, []), "id", ["a", "b"]).count() == 0


def test_a_guard_takes_its_measures_while_the_stage_is_written(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            rows.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(seen, "id long")
    found = []
    out = guards.guarded(df, {"n": F.count("*"), "top": F.max("id")}, found.append)
    assert found == [{"n": 100, "top": 99}] and out.count() == 100 and rows.value == 100


def test_no_key_of_the_test_split_stands_in_another(spark):
    out = leakage.split_documents(spark, SF)
    assert {r.split for r in out.select("split").distinct().collect()} == set(splits.SHARES)
    with pytest.raises(purge.LeakageError):
        torn = out.withColumn("split", F.when(F.col("doc_id") % 2 == 0, "test").otherwise("train")).withColumn("normal", F.lit("one"))
        purge.assert_zero_overlap(torn.where("split = 'test'"), torn.where("split <> 'test'"), leakage.SPLIT_KEYS)
