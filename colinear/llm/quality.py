"""Quality classifier from weak labels: expectation-maximisation over labellers, then a hashed linear scorer.

Seven heuristic labellers each vote good, bad or nothing on a whole text. A two-class Dawid-Skene model estimates their
accuracies, without any label, from the counts of all vote patterns of the corpus (3**7 at most, whatever the corpus).
The posterior of each pattern labels documents; a logistic scorer over hashed features of the text is trained on a
bounded sample of them, and scores every document. The sample is the first SAMPLE different (doc_id, text) by the order
of a hash, as far as they have SAMPLE_CELLS features in all; how often a row occurs is its weight, so ties are no matter.

Null or empty text has no words: posterior of its votes, score 0, not kept. Repeated rows give one result row each, an
empty table none. If every document votes alike the posterior is 1 for good. A very long text is worked on whole. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, bytes_of, id_and_text, mapped, mix64, slices, stored, table

LABELLERS = ("symbols", "columns", "repetition", "short_words", "sentences", "length", "letters")
SAMPLE, SAMPLE_CELLS = 6_000, 8_000_000  # documents that the scorer is trained on, and their features (about 64 MB)
CELLS = 1 << 14
ROUNDS, EPOCHS, STEP, PULL = 60, 300, 2.0, 1e-5
PRIOR_GOOD = 0.8

WORDS = Rolling(505)
_byte = np.arange(256)
SPACE = np.isin(_byte, [32, *range(9, 14)])
SYMBOL = np.isin(_byte, list(b"#$%&*|<>{}[]\\^~=+_@"))
LETTER = ((_byte | 32) >= 97) & ((_byte | 32) <= 122) | (_byte >= 128)
STOP = np.isin(_byte, list(b".!?"))


class Measures:
    """Words of some texts and what labellers and features need to know about them."""

    def __init__(self, texts: list[bytes]) -> None:
        self.n_docs = len(texts)
        data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts])
        begin = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        gap = SPACE[data]
        before = np.concatenate([[True], gap[:-1]])
        self.start, self.end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        self.n = np.bincount(self.doc, minlength=self.n_docs)
        self.word = WORDS.of(WORDS.prefix(data), self.start, self.end)
        total = lambda table_: np.diff(np.concatenate([[0], np.cumsum(table_[data])])[np.append(begin, self.ends[-1])])
        self.symbols, self.letters, self.solid = total(SYMBOL), total(LETTER), total(~SPACE)
        length = self.end - self.start
        self.short = self._count(length <= 3)
        self.stops = self._count(STOP[data[self.end - 1]])
        self.bars = self._count((length == 1) & (data[self.start] == 124))
        again = np.zeros(len(self.word), bool)
        again[1:] = (self.word[1:] == self.word[:-1]) & (self.doc[1:] == self.doc[:-1])
        self.repeats = self._count(again)
        self.shape = np.minimum(length, 15) + 16 * SYMBOL[data[self.end - 1]] + 32 * STOP[data[self.end - 1]] + 64 * again

    def _count(self, flag: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc[flag], minlength=self.n_docs)

    def votes(self) -> np.ndarray:
        """+1 good, -1 bad, 0 none: texts by labellers."""
        words, solid = np.maximum(self.n, 1), np.maximum(self.solid, 1)
        vote = lambda good, bad: good.astype(np.int8) - bad.astype(np.int8)
        share = self.symbols / solid
        return np.column_stack([
            vote(share < 0.01, share > 0.04),
            vote(np.zeros(self.n_docs, bool), self.bars / words > 0.1),
            vote(self.repeats / words < 0.02, self.repeats / words > 0.1),
            vote((self.short / words > 0.15) & (self.short / words < 0.6), (self.short / words < 0.08) & (self.n >= 20)),
            vote(self.stops / words > 0.03, (self.stops / words < 0.02) & (self.n >= 20)),
            vote(self.n >= 20, self.n < 5),
            vote(self.letters / solid > 0.9, self.letters / solid < 0.75),
        ])

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, cell, value) of word and word-shape features, each kind scaled to the share of the text's words."""
        cell = np.concatenate([mix64(self.word) % np.uint64(CELLS - 256), np.uint64(CELLS - 256) + self.shape.astype(np.uint64)]).astype(np.int64)
        doc = np.concatenate([self.doc, self.doc])
        key, count = np.unique(doc * CELLS + cell, return_counts=True)
        doc, cell = key // CELLS, key % CELLS
        value = count / self.n[doc]
        return doc, cell, np.where(cell >= CELLS - 256, value, value / 8)


def _votes(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            votes = ["".join("-0+"[v + 1] for v in row) for row in Measures(bytes_of(batch.column(1))).votes().tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.string())], ["doc_id", "votes"])

    return mapped(docs, run, "doc_id long, votes string")


def posteriors(patterns: dict[str, int]) -> dict[str, float]:
    """Probability of good for each vote pattern, by expectation-maximisation of the labellers' accuracies."""
    if not patterns:
        return {}
    names = sorted(patterns)
    vote = np.array([["-0+".index(c) for c in p] for p in names])
    weight = np.array([patterns[p] for p in names], float)
    score = (vote - 1).sum(axis=1)
    good = np.where(score > 0, 0.9, np.where(score < 0, 0.1, 0.5))
    one_hot = np.eye(3)[vote]  # patterns, labellers, votes
    for _ in range(ROUNDS):
        prior = (weight @ good + PRIOR_GOOD * 10) / (weight.sum() + 10)
        like = []
        for share, lean in ((good, (0.5, 1, 2)), (1 - good, (2, 1, 0.5))):
            table_ = np.einsum("p,plv->lv", weight * share, one_hot) + np.array(lean)
            like.append(np.log(table_ / table_.sum(axis=1, keepdims=True)))
        fit = [np.einsum("plv,lv->p", one_hot, x) for x in like]
        good = 1 / (1 + np.exp(np.clip(fit[1] - fit[0] + np.log((1 - prior) / prior), -60, 60)))
    return dict(zip(names, good.tolist(), strict=True))


def train(rows: list, posterior: dict[str, float]) -> np.ndarray:
    """Weights of the hashed linear scorer (the last is the intercept) from rows of (votes, cells, values, copies), the arrays as bytes."""
    if not rows:
        return np.zeros(CELLS + 1, np.float32)
    cells, values = [np.frombuffer(r["cells"], np.int32) for r in rows], [np.frombuffer(r["cell_values"], np.float32) for r in rows]
    cell, value = np.concatenate(cells).astype(np.int64), np.concatenate(values).astype(np.float64)  # as bincount takes them
    doc = np.repeat(np.arange(len(rows)), [len(c) for c in cells])
    wanted, copies = np.array([posterior[r["votes"]] for r in rows]), np.array([r["copies"] for r in rows], float)
    copies /= copies.sum()
    weight, velocity = np.zeros(CELLS + 1), np.zeros(CELLS + 1)
    for _ in range(EPOCHS):
        z = np.bincount(doc, weights=value * weight[cell], minlength=len(rows)) + weight[-1]
        error = (1 / (1 + np.exp(-z)) - wanted) * copies
        slope = np.append(np.bincount(cell, weights=value * error[doc], minlength=CELLS), error.sum()) + PULL * weight
        velocity = 0.9 * velocity - STEP * slope
        weight += velocity
    return weight.astype(np.float32)


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, votes, posterior, score and keep (score of 0.5 or more). One pass each to count, sample and score."""
    own = id_and_text(docs, id_col, text_col)
    patterns = {r["votes"]: r["count"] for r in _votes(own).groupBy("votes").count().collect()}  # 3**7 rows at most
    posterior = posteriors(patterns)

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            m = Measures(bytes_of(batch.column(1)))
            votes = ["".join("-0+"[v + 1] for v in row) for row in m.votes().tolist()]
            doc, cell, value = m.features()
            cut = np.searchsorted(doc, np.arange(m.n_docs + 1)).tolist()
            cell, value = cell.astype(np.int32), value.astype(np.float32)
            columns = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (cell, value)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(votes, pa.string()), pa.array(np.diff(cut)), *(pa.array(c, pa.binary()) for c in columns)], ["h", "votes", "n_cells", "cells", "cell_values"])

    # The rows with the smallest hashes; only hashes are counted and ordered, texts of the chosen ones alone are read on.
    hashed = own.select(F.xxhash64("doc_id", "text").alias("h"), "text")
    least = stored(hashed.groupBy("h").agg(F.count(F.lit(1)).alias("copies")).orderBy("h").limit(SAMPLE))
    last = least.agg(F.max("h")).first()[0]
    chosen = hashed.where(F.col("h") <= F.lit(last)) if last is not None else hashed.limit(0)
    found = stored(mapped(chosen, sampled, "h long, votes string, n_cells long, cells binary, cell_values binary").dropDuplicates(["h"]))
    so_far = F.sum("n_cells").over(Window.orderBy("h"))  # over SAMPLE rows at most
    kept = found.select("h", so_far.alias("so_far")).where(F.col("so_far") <= SAMPLE_CELLS)
    rows = found.join(kept, "h").join(least, "h").orderBy("h").select("votes", "cells", "cell_values", "copies").collect()
    weights = train(rows, posterior)
    shared = docs.sparkSession.sparkContext.broadcast((posterior, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weight = shared.value
        for batch in slices(batches):
            m = Measures(bytes_of(batch.column(1)))
            votes = ["".join("-0+"[v + 1] for v in row) for row in m.votes().tolist()]
            doc, cell, value = m.features()
            z = np.bincount(doc, weights=value * weight[cell], minlength=m.n_docs) + weight[-1]
            score = np.where(m.n > 0, 1 / (1 + np.exp(-np.clip(z, -60, 60))), 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.n, pa.int64()), pa.array(votes, pa.string()), pa.array([known[v] for v in votes], pa.float64()), pa.array(score, pa.float64()), pa.array(score >= 0.5)], ["doc_id", "n_words", "votes", "posterior", "score", "keep"])

    return mapped(own, run, "doc_id long, n_words long, votes string, posterior double, score double, keep boolean")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
