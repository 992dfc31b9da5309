"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a score quantile."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import Words, chunks, lower_table, pieces
from tidemark.llm.labelled import fold, logistic, sample, sigmoid
from tidemark.session import table

FEATURES = ["upper", "digit", "symbol", "foreign", "bare_words", "repeats", "distinct", "word_length", "words", "lines", "longest"]

_CLASS = np.zeros(256, np.uint8)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'-"]] = 3
_CLASS[128:] = 4
_CLASS[10] = 5
_CLASS[97:123] = 6
_SPACE = lower_table("space")
_SPACE[65:91] -= 32  # case is kept: only the places of words matter here


def _totals(texts: list[str]) -> tuple[np.ndarray, Words]:
    """For each text: bytes of each class, bytes, words, words without letters, bytes of words, words
    equal to the one before, and bytes of the longest word."""
    w = Words(texts, _SPACE)
    kind = _CLASS[np.frombuffer(w.raw, np.uint8)]
    count = [np.add.reduceat(kind == k, w.offset[:-1], dtype=np.int64) for k in range(1, 7)]
    letters = np.concatenate([[0], np.cumsum((kind == 1) | (kind == 4) | (kind == 6))])
    bare = np.concatenate([[0], np.cumsum(letters[w.end] == letters[w.start])])
    length = np.concatenate([[0], np.cumsum(w.end - w.start)])
    same = np.concatenate([[0, 0], np.cumsum(w.hash[1:] == w.hash[:-1])]) if len(w.hash) else np.zeros(1, np.int64)
    a, b = w.first[:-1], w.first[1:]
    repeats = np.where(b - a > 1, same[b] - same[np.minimum(a + 1, b)], 0)
    top = np.array([(w.end[i:j] - w.start[i:j]).max() if j > i else 0 for i, j in zip(a.tolist(), b.tolist())])
    return np.column_stack([*count, np.diff(w.offset) - 1, w.count, bare[b] - bare[a], length[b] - length[a], repeats, top]), w


def _long_totals(parts: list[str]) -> tuple[np.ndarray, int]:
    """The totals of one text given in parts, and its number of distinct words."""
    whole, seen, last = np.zeros(12, np.int64), [], None
    for p in parts:
        (one,), w = _totals([p])
        top = max(whole[11], one[11])
        whole += one
        whole[11] = top
        if len(w.hash):
            whole[10] += int(last == w.hash[0])
            last = w.hash[-1]
            seen.append(np.unique(w.hash))
    return whole, len(np.unique(np.concatenate(seen))) if seen else 0


def features(texts: list[str]) -> np.ndarray:
    """A row of numbers for each whole text; an empty text gives zeros. A very long text goes part by
    part, of which only totals and distinct words stay."""
    parts = [pieces(t) for t in texts]
    if all(len(p) == 1 for p in parts):
        t, w = _totals(texts)
        distinct = np.array([len(np.unique(w.hash[i:j])) for i, j in zip(w.first[:-1].tolist(), w.first[1:].tolist())])
    else:
        each = [_long_totals(p) for p in parts]
        t, distinct = np.array([x for x, _ in each]), np.array([n for _, n in each])
    upper, digit, symbol, foreign, lines, lower, size, count, bare, length, repeats, top = t.T
    size, words = np.maximum(size, 1), np.maximum(count, 1)
    x = np.column_stack(
        [
            upper / np.maximum(upper + lower + foreign / 2, 1),
            digit / size,
            symbol / size,
            foreign / size,
            bare / words,
            repeats / words,
            np.log1p(distinct) / np.log1p(words),
            length / words / 10,
            np.log1p(count) / 10,
            np.minimum(lines / words, 1),
            np.log1p(top) / 5,
        ]
    )
    x[count == 0] = 0.0
    return x.reshape(len(texts), len(FEATURES))


@dataclass(frozen=True)
class Ranking:
    """A fitted scorer: strengths are ``(x - centre) / spread @ weights``; ``cut`` maps to 0.5."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.spread, -8, 8)
        return sigmoid(z @ self.weights - self.cut)


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 100_000, ridge: float = 1e-4, seed: int = 7) -> Ranking:
    """Bradley-Terry: documents of label 1 are preferred to those of label 0.

    Pairs are drawn at random; the logistic loss of their feature differences (no intercept) is
    minimised. The cut is the quantile of the training scores at the share of label 0. Without
    one of the labels there are no pairs: all weights are 0, and the score is 0.5 (no label 0)
    or 0.25 for every text.
    """
    centre = x.mean(0) if len(x) else np.zeros(len(FEATURES))
    spread = np.maximum(x.std(0), 1e-3) if len(x) else np.ones(len(FEATURES))
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return Ranking(centre, spread, np.zeros(len(FEATURES)), np.log(3.0) if len(bad) else 0.0)
    rng = np.random.default_rng(seed)
    z = lambda v: np.clip((v - centre) / spread, -8, 8)
    better, worse = z(good)[rng.integers(len(good), size=pairs)], z(bad)[rng.integers(len(bad), size=pairs)]
    w = logistic(better - worse, np.ones(pairs), np.ones(pairs), ridge)
    cut = np.quantile(z(x) @ w, (len(bad) - 0.5) / (len(x) - 1))
    return Ranking(centre, spread, w, float(cut))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, folds: int = 3, held_out: int = 1) -> Ranking:
    """Fits on a sample of at most about ``max_rows`` labelled documents outside the held-out fold. Ids may be of any type; of
    several texts of one id one counts. Without labelled documents every score is 0.5."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    chosen = sample(labels.where(fold(F.col("doc_id"), folds) != held_out), "quality", max_rows)

    def run(batches):
        for part, texts in chunks(batches, "text"):
            x = pa.array(list(features(texts)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), x], names=["doc_id", "y", "x"])

    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text")
    rows = texts.mapInArrow(run, f"doc_id {kind}, y int, x array<double>").groupBy("doc_id", "y").agg(F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)  # bounded by the sample's size
    return fit(np.array([r.x for r in rows]).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], dtype=int))


def classify(docs: DataFrame, model: Ranking, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on); a null text counts as empty. Repeated rows are scored alike,
    an empty table gives an empty result, a text of any length is read in parts where it has white space. Columns named
    ``score`` and ``predicted`` are replaced, all others kept."""
    source = docs.drop(*[c for c in ("score", "predicted") if c != text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", score double, predicted int"
    names = [*source.columns, "score", "predicted"]

    def run(batches):
        for part, texts in chunks(batches, text):
            s = model.score(features(texts))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=names)

    return source.mapInArrow(run, schema)


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = (fold(F.col("doc_id"), 3) == 1).alias("held_out")
    return classify(docs, model).select("doc_id", held, "score", "predicted")
