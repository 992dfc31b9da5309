"""Toxicity: a Levenshtein automaton over a lexicon trie, with context windows for quotation."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.batches import chunks, pieces
from tidemark.llm.labelled import fold, logistic, sample, sigmoid
from tidemark.session import table

WORD = re.compile(r"[^\W\d_]+")
#: Characters to each side of a hit that are searched for quotation marks.
WINDOW = 60
OPENING, CLOSING = "\"“«„‘‹", "\"”»“’›"
#: Lengths of stems: prefixes that longer words of a lexicon family share.
STEMS = (4, 5, 6)
#: Kinds of a word: none, a term, a word with a stem, one or two edits from a term.
NONE, TERM, STEM, ONE, TWO = range(5)


def edits(term: str) -> int:
    """How many edits a term tolerates; short terms none."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """All words within ``edits`` of a term, as one automaton made state by state.

    A state is a set of (trie node, edits used); reading a character moves along the trie
    (match), along any branch (substitution), stays (insertion), and branches are also taken
    without reading (deletion). Nodes know the largest tolerance below them, so a set is empty,
    and the search over, as soon as no term can be reached. Sets and moves are kept, so a word
    costs one look-up a character.
    """

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.limit, self.term = [0], [-1]
        for t in terms:
            node, most = 0, edits(t)
            self.limit[0] = max(self.limit[0], most)
            for ch in t:
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.limit.append(0)
                    self.term.append(-1)
                node = self.child[node][ch]
                self.limit[node] = max(self.limit[node], most)
            self.term[node] = most
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.move: list[dict[str, int]] = []
        self.cost: list[int] = []
        self.dead = self._id({})
        self.first = self._id({0: 0} if terms else {})

    def _id(self, used: dict[int, int]) -> int:
        todo = list(used)
        while todo:  # deletions
            node = todo.pop()
            e = used[node] + 1
            for c in self.child[node].values():
                if e <= self.limit[c] and e < used.get(c, 9):
                    used[c] = e
                    todo.append(c)
        key = frozenset(used.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.move.append({})
            self.cost.append(min((e for n, e in key if e <= self.term[n]), default=-1))
        return self.ids[key]

    def _go(self, state: int, ch: str) -> int:
        used: dict[int, int] = {}
        for node, e in self.sets[state]:
            for c, to in self.child[node].items():
                cost = e + (c != ch)
                if cost <= self.limit[to] and cost < used.get(to, 9):
                    used[to] = cost
            if e + 1 <= self.limit[node] and e + 1 < used.get(node, 9):
                used[node] = e + 1
        self.move[state][ch] = to = self._id(used)
        return to

    def distance(self, word: str) -> int:
        """Edits to the nearest term that tolerates them, or -1."""
        state = self.first
        for ch in word:
            to = self.move[state].get(ch)
            state = self._go(state, ch) if to is None else to
            if state == self.dead:
                return -1
        return self.cost[state]


@dataclass
class Lexicon:
    """Terms and stems; remembers the kinds of words it has seen (up to ``keep`` of them)."""

    terms: list[str]
    stems: list[str]
    keep: int = 1 << 17
    _seen: dict = field(default_factory=dict, repr=False)
    _made: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"terms": self.terms, "stems": self.stems, "keep": self.keep, "_seen": {}, "_made": None}

    def kind(self, word: str) -> int:
        known = self._seen.get(word)
        if known is not None:
            return known
        if self._made is None:
            self._made = Automaton(self.terms), frozenset(self.stems)
        automaton, stems = self._made
        d = automaton.distance(word)
        kind = TERM if d == 0 else STEM if any(word[:k] in stems for k in STEMS) else (NONE, ONE, TWO)[max(d, 0)]
        if len(self._seen) >= self.keep:
            self._seen.clear()
        self._seen[word] = kind
        return kind


def quoted(text: str, start: int, end: int) -> bool:
    """Whether quotation marks stand around the place, both within the window."""
    left = text[max(0, start - WINDOW) : start]
    right = text[end : end + WINDOW]
    opened = max(left.rfind(c) for c in OPENING)
    if opened < 0 or min((i for c in CLOSING if (i := right.find(c)) >= 0), default=-1) < 0:
        return False
    plain = left[opened] == '"'
    return left.count('"') % 2 == 1 if plain else not any(c in left[opened + 1 :] for c in CLOSING if c != left[opened])


def counts(text: str, lexicon: Lexicon) -> tuple[int, ...]:
    """Hits by kind outside quotation, and hits inside."""
    low = text.lower()
    kind = lexicon.kind
    n = [0] * 5
    at = 0
    for part in pieces(low):  # so that the words of a very long text are not all held
        hit = {w for w in set(WORD.findall(part)) if kind(w)}
        if hit:
            for m in WORD.finditer(low, at, at + len(part)):
                if m[0] in hit:
                    n[4 if quoted(low, m.start(), m.end()) else kind(m[0]) - 1] += 1
        at += len(part)
    return tuple(n)


def row(n: tuple[int, ...]) -> list[float]:
    """An intercept, logarithms of counts (each further hit says less), and whether there is a hit of each kind."""
    return [1.0, *[math.log1p(k) for k in n], *[float(k > 0) for k in n]]


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, n: list[tuple[int, ...]]) -> np.ndarray:
        return sigmoid(np.array([row(k) for k in n]).reshape(-1, 11) @ self.weights)


def _terms(text: str) -> set[str]:
    words = {w for w in WORD.findall(text.lower()) if len(w) > 2}
    return words | {f"{w[:k]}*" for w in words for k in STEMS if len(w) > k}


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``(text, y)`` rows, equal words and label once; unlike texts never stand for each other."""
    words = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")))
    return rows.groupBy(words.alias("_words"), "y").agg(F.min("text").alias("text")).select("text", "y")


def learn_lexicon(texts: DataFrame) -> Lexicon:
    """Words and stems that mark label 1, from ``(text, y)`` rows.

    A term must be so much commoner in label 1 that hardly any random term is expected to be, by
    the likelihood ratio against the number of terms tried, which grows with the texts (there are
    fewer stems than words). All that pass are kept: the texts are a bounded sample.
    """

    def run(batches):
        for part, batch in chunks(batches, "text"):
            n = {0: Counter(), 1: Counter()}
            for t, y in zip(batch, part.column("y").to_pylist()):
                n[int(y > 0)].update(_terms(t))
            terms = sorted(set(n[0]) | set(n[1]))
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([n[1][t] for t in terms], pa.int64()), pa.array([n[0][t] for t in terms], pa.int64())], names=["term", "hot", "cold"])

    n = {r.y: r.n for r in texts.groupBy((F.col("y") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        return Lexicon([], [])
    share = n[1] / (n[0] + n[1])
    seen = texts.mapInArrow(run, "term string, hot long, cold long").groupBy("term").agg(F.sum("hot").alias("hot"), F.sum("cold").alias("cold"))
    h, c = F.col("hot").cast("double"), F.col("cold").cast("double")
    gain = h * F.log(h / (h + c) / share) + F.when(c > 0, c * F.log(c / (h + c) / (1 - share))).otherwise(0.0)
    tried = F.log(F.when(F.col("term").endswith("*"), 10.0).otherwise(50.0) * (n[0] + n[1]))
    marked = seen.where(h > c * n[1] / n[0]).withColumn("gain", gain).where((F.col("gain") > tried) & (h / (h + c) > 0.5))
    top = [r.term for r in marked.select("term").collect()]
    return Lexicon(sorted(t for t in top if t[-1] != "*"), sorted(t[:-1] for t in top if t[-1] == "*"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, folds: int = 5, held_out: int = 0) -> Model:
    """Lexicon and weights from at most about ``max_rows`` labelled documents outside the held-out fold."""
    chosen = sample(labels.where(fold(F.col("doc_id"), folds) != held_out), "toxic", max_rows)

    joined = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "y")
    once = distinct_texts(joined).persist()
    try:
        lexicon = learn_lexicon(once)

        def counted(batches):
            for part, texts in chunks(batches, "text"):
                c = pa.array([list(counts(t, lexicon)) for t in texts], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([c, part.column("y")], names=["c", "y"])

        rows = once.mapInArrow(counted, "c array<int>, y int").groupBy("c", "y").agg(F.count("*").alias("n")).collect()
    finally:
        once.unpersist()
    rows.sort(key=lambda r: (r.c, r.y))
    if not rows:
        return Model(lexicon, np.array([-35.0] + [0.0] * 10))
    x, y, n = (np.array(v, dtype=float) for v in ([row(r.c) for r in rows], [r.y for r in rows], [r.n for r in rows]))
    return Model(lexicon, logistic(x, (y > 0).astype(float), n, 1e-4, free=1))


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and ``hits`` (counts by kind).

    A null text counts as empty and has no hits. Without labels of both kinds the lexicon is
    empty and every text gets the labels' share as its score (0 without labels). Repeated rows are scored alike, an empty table
    gives an empty result, a very long text is read in parts where it has white space. Columns named as the three are replaced, all others kept.
    """
    made = ["score", "predicted", "hits"]
    source = docs.drop(*[c for c in made if c != text])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", score double, predicted int, hits array<int>"
    names = [*source.columns, *made]

    def run(batches):
        for part, texts in chunks(batches, text):
            n = [counts(t, model.lexicon) for t in texts]
            s = model.score(n)
            out = [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), pa.array([list(k) for k in n], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *out], names=names)

    return source.mapInArrow(run, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    held = (fold(F.col("doc_id"), 5) == 0).alias("held_out")
    return classify(docs, model).select("doc_id", held, "score", "predicted")
