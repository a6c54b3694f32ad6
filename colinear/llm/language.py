"""Language identification as inference of a mixture: which languages, in which proportions, a document holds.

Learning: counts of letter trigrams (the neighbours of every letter, word edges included) by language, over all training
documents, hashed into cells, as log probabilities with add-half smoothing. There are 2**16 cells for up to FINE
languages, half as many whenever their number doubles, 2**8 at least. Inference: the words of a document are
draws from a mixture of languages; expectation-maximisation estimates the proportions, and the set of languages is the
one with the best likelihood less PENALTY * log(words) for every language after the first, along the order of their
proportions, of any size up to all languages. A document's search ends where no larger set can win: the likelihood is
concave in the proportions, which bounds it over all sets from one estimate. The prediction is the largest language of
the set, its score that language's proportion.

Only ``text`` is an input of a prediction. Documents whose crc32(doc_id as text) mod 5 is 0, and those without an id, are
never learnt from. A null text, one without letters, or a model without languages gives ``und`` and score 0. Ties go to
the language first in order. Repeated rows give one result row each, an empty table none. A very long text is worked on
whole. The model has FINE * 2**16 numbers at most (64 MB), which bounds what is collected and broadcast; a column of over
FINE * 2**8 values holds no languages and is an error. Other columns are not read, ``known`` passes them on as they are.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_and_text, mapped, slices, table

BITS, FEWEST_BITS = 16, 8
CELLS = 1 << BITS
FINE = 256  # languages that have all cells
SLICE = 1 << 18  # bytes of text worked on at once, for few languages
FOLDS = 5
PENALTY = 3.0
ROUNDS, SET_ROUNDS = 8, 5
UNKNOWN = "und"


@lru_cache(1)
def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram cells of all letters of all texts, where each word begins among them, and the text of each word."""
    joined = "\n".join((t or "").lower() for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    letter = letters()[points]
    ends = np.cumsum([len((t or "").lower()) + 1 for t in texts])
    padded = np.zeros(len(points) + 2, np.uint32)
    padded[1:-1] = np.where(letter, points, 0)
    at = np.flatnonzero(letter)
    a, b, c = padded[at], padded[at + 1], padded[at + 2]
    cell = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    cell ^= cell >> np.uint32(15)
    cell *= np.uint32(0x2C1B3C6D)
    starts = np.flatnonzero(a == 0)
    return (cell >> np.uint32(16)).astype(np.int64), starts, np.searchsorted(ends, at[starts], side="right")


def bits_for(languages: int) -> int:
    """Bits of a cell's number that are used, so that the model is bounded however many languages there are."""
    bits = BITS - max(0, (max(languages, 1) - 1).bit_length() - (FINE - 1).bit_length())
    if bits < FEWEST_BITS:
        raise ValueError(f"{languages} values are no languages")
    return bits


def limit_for(languages: int) -> int:
    return SLICE * 16 // max(16, languages)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order and their log probabilities, cells by languages, from the documents of the other folds."""
    held = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS)) == 0
    rows = docs.where(~held & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # A bounded read: one value more than there may be languages tells that there are too many.
    names = sorted(r.lang for r in rows.select("lang").distinct().limit((FINE << (BITS - FEWEST_BITS)) + 1).collect())
    bits = bits_for(len(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, limit=SLICE):
            names = np.array(batch.column(0).to_pylist(), object)
            texts = np.array(batch.column(1).to_pylist(), object)
            for lang in dict.fromkeys(names.tolist()):
                cell = features(texts[names == lang].tolist())[0] >> (BITS - bits)
                total[lang] = total.get(lang, 0) + np.bincount(cell, minlength=1 << bits)
        for lang, n in total.items():
            at = np.flatnonzero(n)
            for k in range(0, len(at), 8192):
                part = at[k : k + 8192]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array(part, pa.int32()), pa.array(n[part], pa.int64())], ["lang", "cell", "n"])

    counted = mapped(rows, run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    # One row for each language and 256 cells.
    packed = counted.groupBy("lang", F.shiftright("cell", 8).alias("part")).agg(F.collect_list(F.struct("cell", "n")).alias("cells")).collect()
    seen = {r["lang"] for r in packed}
    names = [x for x in names if x in seen]  # languages without a letter can't be told
    place = {x: i for i, x in enumerate(names)}
    counts = np.full((1 << bits, len(names)), 0.5, np.float32)
    for r in packed:
        column = place[r["lang"]]
        for cell, n in r["cells"]:
            counts[cell, column] += n
    return names, np.log(counts / counts.sum(axis=0, dtype=np.float64)).astype(np.float32)


def mixtures(texts: list[str | None], log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the proportions of the languages in the selected set (all 0 without letters), and the set's size."""
    n_langs, out, size = log_p.shape[1], np.zeros((len(texts), log_p.shape[1])), np.zeros(len(texts), np.int64)
    cell, starts, owner = features(texts)
    if not len(starts) or not n_langs:
        return out, size
    cell >>= BITS - (len(log_p).bit_length() - 1)
    like = np.add.reduceat(log_p[cell], starts, axis=0)
    best = like.max(axis=1)
    chance = np.exp(np.maximum(like - best[:, None], -60), dtype=np.float32)
    docs, first = np.unique(owner, return_index=True)
    n = np.diff(np.append(first, len(owner)))

    def fitted(share: np.ndarray, chance: np.ndarray, first: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = (chance * share[row]).sum(axis=1) + np.float32(1e-30)
        return f, np.add.reduceat(np.log(f).astype(np.float64), first)

    def em(share: np.ndarray, rounds: int, chance: np.ndarray, first: np.ndarray, row: np.ndarray, n: np.ndarray) -> np.ndarray:
        for _ in range(rounds):
            part = chance * share[row]
            part /= part.sum(axis=1, keepdims=True) + np.float32(1e-30)
            share = (np.add.reduceat(part, first, axis=0) / n[:, None]).astype(np.float32)
        return share

    single = np.add.reduceat((like - best[:, None]).astype(np.float64), first, axis=0)
    top = single.argmax(axis=1)
    chosen, gain, count = np.eye(n_langs, dtype=np.float32)[top], single.max(axis=1), np.ones(len(docs), np.int64)
    if n_langs > 1:
        row = np.repeat(np.arange(len(docs)), n)
        full = em(np.full((len(docs), n_langs), 1 / n_langs, np.float32), ROUNDS, chance, first, row, n)
        order = np.argsort(-full, axis=1, kind="stable")
        # No proportions q fit better than full by more than n * log of the largest mean of chance / f, nor better than 0.
        f, fit = fitted(full, chance, first, row)
        ratio = np.add.reduceat(chance / f[:, None], first, axis=0, dtype=np.float64).max(axis=1) / n
        bound = np.minimum(fit + n * np.log(np.maximum(ratio, 1)), 0) + 1e-3 + 1e-5 * n
        open_ = np.arange(len(docs))
        for k in range(2, n_langs + 1):
            still = bound[open_] - PENALTY * (k - 1) * np.log(n[open_] + 1) > gain[open_]
            if not still.all():
                words = still[row]
                open_, chance = open_[still], chance[words]
                if not len(open_):
                    break
                row = np.repeat(np.arange(len(open_)), n[open_])
                first = np.append(0, np.cumsum(n[open_])[:-1])
            mask = np.zeros((len(open_), n_langs), np.float32)
            np.put_along_axis(mask, order[open_, :k], 1, axis=1)
            start = (full[open_] + np.float32(1e-3)) * mask
            share = em(start / start.sum(axis=1, keepdims=True), SET_ROUNDS, chance, first, row, n[open_])
            fit = fitted(share, chance, first, row)[1] - PENALTY * (k - 1) * np.log(n[open_] + 1)
            better = fit > gain[open_]
            at = open_[better]
            chosen[at], gain[at], count[at] = share[better], fit[better], k
    out[docs], size[docs] = chosen, count
    return out, size


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, languages (the selected set, largest first). No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = shared.value
        for batch in slices(batches, limit=limit_for(len(names))):
            share, size = mixtures(batch.column(1).to_pylist(), log_p)
            order = np.argsort(-share, axis=1, kind="stable") if names else np.zeros((len(share), 0), np.int64)
            langs = [[names[i] for i in o[:k]] for o, k in zip(order, size, strict=True)]
            score = np.clip(share.max(axis=1, initial=0), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] if x else UNKNOWN for x in langs]), pa.array(score, pa.float64()), pa.array(langs, pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "languages"])

    return mapped(id_and_text(docs, id_col, text_col), run, "doc_id long, lang_pred string, score double, languages array<string>")


def known(docs: DataFrame, model: tuple[list[str], np.ndarray], least: float, text_col: str = "text") -> DataFrame:
    """The documents, all their columns, whose main language is one of the model's with at least that proportion."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, log_p = shared.value
        for batch in slices(batches, text_col, limit_for(len(names))):
            share, _ = mixtures(batch.column(at).to_pylist(), log_p)
            yield batch.filter(pa.array(share.max(axis=1, initial=0) >= max(least, 1e-9)))

    return mapped(docs, run, docs.schema)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == 0, F.lit(False))
    return predict(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", F.array_join("languages", ",").alias("languages"))
