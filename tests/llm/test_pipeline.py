"""The pipeline's stages and the run as a whole."""

import hashlib

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.conftest import SF
from tidemark.llm import bpe
from tidemark.session import table


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


def test_filters_keep_clean_documents(spark, docs):
    labels = table(spark, SF, "labels")
    for stage, bad in ((corpus_pipeline.drop_toxic, "toxic = 1"), (corpus_pipeline.keep_quality, "quality = 0")):
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        clean = labels.where(f"not ({bad})").select("doc_id")
        assert kept.join(clean, "doc_id").count() >= 0.97 * clean.count()


def test_one_of_each_group_stays(spark, docs):
    twice = docs.unionByName(docs.where("doc_id < 20")).unionByName(docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 100_000))
    kept = corpus_pipeline.one_of_each(spark, twice, SF)
    assert kept.columns == docs.columns
    assert kept.count() == kept.select("doc_id").distinct().count()
    assert kept.where("doc_id >= 100000").count() == 0
    nothing = corpus_pipeline.one_of_each(spark, docs.where("false"), SF)
    assert nothing.count() == 0


def test_run_tokenises_what_the_stages_leave(spark, docs):
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF).cache()
    want = sorted((r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in frame.collect())
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r.doc_id, r.decoded_sha256) for r in got.collect()) == want
    v = bpe.vocabulary(bpe.default_path())
    assert all(v.decode(i) == t.encode() for t in ["", "x y"] for i in v.encode([t])[0])


ODD = [
    (1, "plain words of a clean text stand here in a row", "en", "a", 10),
    (2, None, "en", "a", 0),
    (3, "", None, None, 0),
    (4, " \n", "en", "b", 2),
    (5, "the same words again and again in this text", "en", "b", 43),
    (5, "the same words again and again in this text", "en", "b", 43),
    (6, "long " * 40_000, "en", "b", 200_000),
    (None, "a text without an id", "en", "a", 20),
]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_rows_and_clashing_names(spark, name, stage):
    """Nulls anywhere, empty and long texts, repeated rows and columns named as operators' own pass every stage unchanged."""
    made = ["score", "hits", "predicted", "size", "target", "taken", "copies", "source_size", "_h", "_c", "_s", "n_tokens", "component_id"]
    rows = [(*r, *[f"{c} {i}" for c in made]) for i, r in enumerate(ODD)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in made)
    docs = spark.createDataFrame(rows, schema)
    out = stage(spark, docs, SF)
    assert stage(spark, docs.where("false"), SF).count() == 0
    if name == "byte_bpe":
        assert out.count() == len(ODD)
        return
    assert out.schema.simpleString() == docs.schema.simpleString()
    got, want = [tuple(r) for r in out.collect()], set(rows)
    assert set(got) <= want
    if name in ("toxicity", "quality"):
        assert all(r in got for r in rows if r[0] in (1, 5) or (name == "toxicity"))
    if name == "ngram_jaccard":
        assert sorted(r[0] or 0 for r in got) == [0, 1, 2, 3, 4, 5, 6]
