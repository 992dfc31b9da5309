"""Zip archives as tables; published reports, splits and caches."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F
from tidemark.sources import scans, zips


def _zip(path):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        wide = [f"c{i}" for i in range(300)]
        z.writestr("a/one.tsv", "\t".join(["key", "Chain 2", "Chain 1", *wide]) + "\n" + "".join("\t".join([f"k{i}", "", f'"q{i}', *["x"] * 300]) + "\r\n" for i in range(500)))
        z.writestr("two.tsv", "key\tChain 10\nz\té\n")
        z.writestr("empty.tsv", "")
        z.writestr("notes.txt", "key\nno\n")
    return str(path)


def test_members_of_an_archive_are_one_table(spark, tmp_path):
    path = _zip(tmp_path / "t.zip")
    names = scans.chain_columns(zips.header([path]), r"Chain (\d+)")
    assert names == ["Chain 1", "Chain 2", "Chain 10"]
    df = zips.read_zip(spark, path, ["key", *names])
    assert df.rdd.getNumPartitions() == 3 and df.columns == ["key", *names]
    rows = {r.key: (r["Chain 1"], r["Chain 2"], r["Chain 10"]) for r in df.collect()}
    assert len(rows) == 501 and rows["k7"] == ('"q7', None, None) and rows["z"] == (None, None, "é")
    first = scans.first_of_chains(df, r"Chain (\d+)", r"Chain (\d+)", "chain")
    assert first.where("key = 'z'").first().chain == "é"
    assert len(zips.read_zip(spark, [path, path]).columns) == 304 and zips.read_zip(spark, [path, path], ["key"]).count() == 1002
    assert zips.read_zip(spark, path, ["key"], suffix=".none").count() == 0


def test_reports_and_splits_are_published_whole(spark, tmp_path):
    path = str(tmp_path / "report")
    rows = spark.createDataFrame([("n", None, "5"), ("by", "a.x", "1"), ("by", "a.y", "2"), ("by", "b", "3")], "metric string, key string, value string")
    for _ in range(2):
        scans.write_nested_report(rows, path)
    assert json.loads(spark.read.text(path).first().value) == {"n": "5", "by": {"a": {"x": "1", "y": "2"}, "b": "3"}}
    assigned = spark.createDataFrame([(1, "u", "test"), (2, "u", "test"), (3, "v", "train")], "id int, unit string, split string")
    scans.write_split(assigned, str(tmp_path / "split"), "unit")
    assert {(r.unit, r.split) for r in spark.read.json(str(tmp_path / "split")).collect()} == {("u", "test"), ("v", "train")}
    scans.assert_published(spark, str(tmp_path / "split"))

    def fails(to):
        assigned.write.parquet(to + "/part")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        scans.publish(spark, str(tmp_path / "never"), fails)
    with pytest.raises(scans.UnpublishedError):
        scans.assert_published(spark, str(tmp_path / "never"))
    before = sorted(spark.read.text(path).collect())
    with pytest.raises(RuntimeError):
        scans.publish(spark, path, fails)
    assert sorted(spark.read.text(path).collect()) == before


def test_cache_is_filled_once(spark, tmp_path):
    path, calls = str(tmp_path / "cache"), []

    def annotate(missing):
        calls.append(sorted(r.key for r in missing.collect()))
        return missing.withColumn("v", F.length("key"))

    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "key string")
    for _ in range(2):
        assert {(r.key, r.v) for r in scans.extend_cache(keys("a", "bb", "bb", None), path, "key", annotate).collect()} == {("a", 1), ("bb", 2), (None, None)}
    assert calls == [["a", "bb"]]
    # two runs that overlap: both saw the same missing keys, or shared some
    scans.publish(spark, f"{path}/batch-other", lambda to: keys("bb", "ccc").withColumn("v", F.lit(9)).write.parquet(to), keep=True)
    assert not scans.publish(spark, f"{path}/batch-other", lambda to: keys("ccc").withColumn("v", F.lit(1)).write.parquet(to), keep=True)
    got = scans.extend_cache(keys("a", "bb", "ccc", "dddd"), path, "key", annotate)
    assert got.count() == 4 and {r.key: r.v for r in got.collect()}["ccc"] == 9 and calls[-1] == ["dddd"]
    # an interrupted run leaves a staged folder, which does not count
    keys("lost").withColumn("v", F.lit(0)).write.parquet(f"{path}/batch-x.staged-1")
    assert scans.read_cache(spark, path, "key").where("key = 'lost'").count() == 0
    assert scans.extend_cache(keys().where("false"), str(tmp_path / "none"), "key", annotate).count() == 0
