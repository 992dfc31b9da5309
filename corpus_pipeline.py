"""A corpus pipeline from five of the operators: filter, de-duplicate, mix, tokenise.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last return the
columns of ``documents``, with whatever other columns the corpus has: those are set aside under
names of their own while an operator runs, so none is overwritten. Null and empty texts are
texts without words: clean, scored by the models as such, linked with nothing, and never drawn
by the mix, whose sizes they do not change. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, ngrams, quality, toxicity
from tidemark.session import bounded_batches, table, written


#: Columns that the operators read.
READ = ("doc_id", "text", "source")


def _aside(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work(docs)`` in the columns of ``docs``; columns that no operator reads are hidden from it."""
    names = {c: f"corpus column {i}" for i, c in enumerate(docs.columns) if c not in READ}
    hidden = docs.withColumnsRenamed(names)
    return work(hidden).select(*hidden.columns).withColumnsRenamed({v: k for k, v in names.items()})


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject; repeated rows are judged alike."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _aside(docs, lambda d: toxicity.classify(d, model).where("predicted = 0"))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality ranking puts above its cut; repeated rows are judged alike."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _aside(docs, lambda d: quality.classify(d, model).where("predicted = 1"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Of repeated rows one stays. An id that has several texts stays with all of them if it is the smallest of any of their groups, as the
    operator decides on ids. Documents without an id stay: no decision can name them.
    """
    bounded_batches(spark)
    found = ngrams.jaccard_components(docs)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    rows = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rows.select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources' documents at their target weights, each row as often as it is drawn (0, 1 or 2 times)."""
    bounded_batches(spark)
    return _aside(docs, lambda d: mixing.emit(mixing.mix(d), d.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id`` with token counts and digests of ids and decoded bytes, a row for each row of ``docs``."""
    bounded_batches(spark)
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_quality),
    ("ngram_jaccard", one_of_each),
    ("source_mix", mixed),
    ("byte_bpe", encoded),
]

#: The stages fit models and cut token automata, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
