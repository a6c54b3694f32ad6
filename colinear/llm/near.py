"""Near-duplicate documents by SetSketch registers, banded, estimated jointly and verified on full sets.

A document's set is its distinct word shingles. Its sketch has REGISTERS registers: for each, the smallest of that many
independent exponential variables over the set, on an exponentially spaced scale and truncated to 16 bits. Sketches of
parts merge by the register-wise maximum, and equal registers are as likely as the sets are similar, so documents that
agree in a whole band of registers are candidates. At 40 bands of 5 registers a pair of similarity 0.8 is missed with
probability (1 - 0.8**5)**40 = 1.3e-7, without any cap.

Documents with equal sets collapse to their smallest id first. In each bucket all members are compared with the smallest
one, as a star whose members are dealt over tasks; stars give components. Documents of buckets that still hold several
components go to a second step, where pairs of different components must share a shingle of their rarest-first prefixes
(no link can do without; documents of the component that has the most of a shingle's look for no partners, so a large
group costs its size times the documents outside it), and where a joint maximum-likelihood estimate of their similarity from the registers rules out
those far below the threshold. Every link is confirmed on the full sets of both texts.

Null or empty text, or text without words, has an empty set and is linked with nothing. Rows without an id get no
component and are kept. Repeated rows give one result row each; of rows with one id and different texts that
whose text has the smallest hash is linked, and the others get its component.
A very long text is one set, sketched and verified as a whole. An empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, bytes_of, components, id_and_text, mapped, mix64, scratch, slices, spread_join, stored, table

REGISTERS, BAND = 200, 5
KEPT = 128  # registers kept for the joint estimate
SCALE, RATE = 1.001, 20.0
STAR, STAR_PARTS = 256, 10_000  # members of a star in one task, and the most parts that its centre is sent to
SLICE = 1 << 18  # bytes of text worked on at once
MARGIN = 0.25  # below the threshold, about seven standard errors of the estimate
FILTER_WORDS = 1 << 18  # words of 64 bits in the filter of ids, about 10 MB as a broadcast table

WORDS = Rolling(303)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_rng = np.random.Generator(np.random.PCG64(404))
PLACES = _rng.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FLIPS = _rng.integers(0, 2**63, REGISTERS, dtype=np.uint64)
FACTORS = _rng.integers(1, 2**62, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and where each text's begin (one more at the end)."""
    data = np.frombuffer(b" ".join(t.translate(LOWER) for t in texts) + b" ", np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    ends = np.cumsum(size)
    gap = SPACE[data]
    before = np.concatenate([[True], gap[:-1]])
    start, end = np.flatnonzero(~gap & before), np.flatnonzero(gap & ~before)
    word = WORDS.of(WORDS.prefix(data), start, end)
    owner = np.searchsorted(ends, start, side="right")
    n = np.bincount(owner, minlength=len(texts))
    first = np.cumsum(n) - n
    count = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count) + first[doc]
    left = first[doc] + n[doc] - at  # words from here to the end of the text
    padded = np.concatenate([word, np.zeros(width, np.uint64)])
    value = np.minimum(left, width).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(width):
        value += np.where(left > k, padded[at + k] * PLACES[k], np.uint64(0))
    value = mix64(value)
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.concatenate([[True], (np.diff(value) != 0) | (np.diff(doc) != 0)]) if len(doc) else np.zeros(0, bool)
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(texts) + 1))


def sketch(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Registers (sets by REGISTERS, 16 bits) of the non-empty sets that begin at these places."""
    out = np.empty((len(begin), REGISTERS), np.uint16)
    for i in range(REGISTERS):
        least = np.minimum.reduceat((values ^ FLIPS[i]) * FACTORS[i] >> np.uint64(32), begin)
        exponential = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
        out[:, i] = np.clip(np.floor(1 - np.log(exponential) / np.log(SCALE)), 0, 65535)
    return out


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood estimate of the Jaccard similarity from two sketches of sets of known size."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = n_a / (n_a + n_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 101)[:, None] * top
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)
    x, y = p(u - v * grid), p(v - u * grid)
    tiny = 1e-12
    fit = more * np.log(x + tiny) + less * np.log(y + tiny) + same * np.log(np.maximum(1 - x - y, tiny))
    return np.take_along_axis(grid, fit.argmax(axis=0)[None], axis=0)[0]


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text, n (set size), two sums that identify the set, the bands' keys and the registers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            value, begin = shingles(bytes_of(batch.column(1)), width)
            n = np.diff(begin)
            full = np.flatnonzero(n)
            one, two = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            bands: list[np.ndarray | None] = [None] * len(n)
            registers: list[bytes | None] = [None] * len(n)
            if len(full):
                one[full] = np.add.reduceat(mix64(value + np.uint64(1)), begin[full])
                two[full] = np.add.reduceat(mix64(value ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin[full])
                k = sketch(value, begin[full])
                keys = (k.reshape(len(full), -1, BAND) * PLACES[:BAND]).sum(axis=2, dtype=np.uint64)
                keys = mix64(keys + np.arange(1, REGISTERS // BAND + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
                for i, d in enumerate(full.tolist()):
                    bands[d], registers[d] = keys[i].view(np.int64), k[i, :KEPT].tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(bands, pa.list_(pa.int64())), pa.array(registers, pa.binary())], ["doc_id", "n", "one", "two", "bands", "registers"])

    return mapped(docs, run, "doc_id long, n long, one long, two long, bands array<long>, registers binary")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold. Each star around a is dealt in parts of about STAR members."""
    counted = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("members"))
    parts = counted.select("a", "members", F.least(F.ceil(F.col("members") / STAR), F.lit(STAR_PARTS)).cast("int").alias("parts"))
    member = spread_join(pairs, parts, ["a"], "members", pairs.count()).select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("doc_id"), F.lit(1).alias("role"))
    centre = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("a").alias("doc_id"), F.lit(0).alias("role"))
    rows = member.unionByName(centre).join(texts, "doc_id").select("a", "part", "role", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        star, own = None, np.zeros(0, np.uint64)
        for batch in slices(batches, limit=SLICE):
            value, begin = shingles(bytes_of(batch.column(4)), width)
            a, part, role, doc = (batch.column(k).to_pylist() for k in range(4))
            linked = []
            for i in range(batch.num_rows):
                mine = value[begin[i] : begin[i + 1]]
                if role[i] == 0:
                    star, own = (a[i], part[i]), mine
                elif star == (a[i], part[i]) and 100 * min(len(own), len(mine)) >= percent * max(len(own), len(mine)):
                    both = len(np.intersect1d(own, mine, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(mine) - both):
                        linked.append((a[i], doc[i]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in linked], pa.int64()) for k in (0, 1)], ["a", "b"])

    return mapped(rows.repartition("a", "part").sortWithinPartitions("a", "part", "role"), run, "a long, b long")


def _prefix_pairs(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of documents (doc_id, text, label) of different labels that can reach the threshold.

    With the shingles of a set of n in one order for all, rarest first, two sets that reach the threshold share one of
    their first n - ceil(n * percent / 100) + 1. Copies edited in many places are full of shingles that nobody shares,
    so they propose nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            value, begin = shingles(bytes_of(batch.column(1)), width)
            n = np.diff(begin)
            row = np.repeat(np.arange(len(n)), n)
            ids, label = (batch.column(k).to_numpy()[row] for k in (0, 2))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (value.view(np.int64), ids, label, n[row].astype(np.int64))], ["shingle", "doc_id", "label", "n"])

    sets = mapped(docs, run, "shingle long, doc_id long, label long, n long")
    common = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("label").alias("low"), F.max("label").alias("high"))
    # Shingles of one document come first and are only counted: their number is what the set lacks among the others.
    own = Window.partitionBy("doc_id")
    place = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "shingle"))
    prefix = sets.join(common.where("df > 1"), "shingle").withColumn("place", place).where(F.col("place") <= F.expr(f"n - ceil(n * {percent} / 100.0D) + 1")).where("low < high")
    prefix = stored(prefix.select("shingle", "doc_id", "label", "n", "place"))
    # Documents of a shingle's largest component are no pairs among themselves: only the others look for partners. The
    # documents of a frequent shingle are dealt in parts, to each of which those that look are sent.
    sizes = prefix.groupBy("shingle", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("shingle").agg(F.max(F.struct(F.col("n").alias("k"), F.col("label").alias("largest"))).alias("m"), F.sum("n").alias("members"))
    parts = F.least(F.ceil(F.col("members") / STAR), F.lit(STAR_PARTS)).cast("int")
    told = stored(spread_join(prefix, sizes.select("shingle", "m.largest", parts.alias("parts"), "members"), ["shingle"], "members", prefix.count()))
    seeking = told.where("label <> largest").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    found = told.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    left, right = (x.select("shingle", "part", F.col("doc_id").alias(k), F.col("label").alias(f"label_{k}"), F.col("n").alias(f"n_{k}"), F.col("place").alias(f"place_{k}")) for k, x in (("a", seeking), ("b", found)))
    # At the first shared shingle, what is left of both sets bounds what they can share.
    most = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    near = (most * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent) & (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("label_a") != F.col("label_b"))
    return left.join(right, ["shingle", "part"]).where(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _likely(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (with sizes and registers of both) whose estimate is not far below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (2, 3))
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, KEPT) for k in (4, 5))
            keep = similarity(a, b, n_a, n_b) >= percent / 100 - MARGIN if len(n_a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep))

    return mapped(pairs.select("a", "b", "n_a", "n_b", "r_a", "r_b"), run, "a long, b long")


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs (doc_id, ...) whose id is among ``ids`` (doc_id), before whose exchange most others are dropped.

    A filter of one bit for each hash of an id, FILTER_WORDS rows at most however many ids there are, is broadcast; what
    passes it is joined exactly. The fuller the filter, the more rows pass it; with all bits set it only costs its probe.
    """
    hashed = F.xxhash64("doc_id")
    word, bit = F.pmod(hashed, F.lit(FILTER_WORDS)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int"))
    words = ids.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    likely = docs.join(F.broadcast(words), word == F.col("word")).where(F.col("bits").bitwiseAND(bit) != 0).select(docs.columns)
    return likely.join(ids, "doc_id", "left_semi")


def groups(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: connected components of the links with Jaccard similarity >= percent / 100.

    The result is stored; tables on the way to it are removed.
    """
    with scratch(docs.sparkSession):
        return stored(_groups(id_and_text(docs, id_col, text_col), width, percent), keep=True)


def _groups(own: DataFrame, width: int, percent: int) -> DataFrame:
    # Of rows with one id and different texts, one is linked: that whose text has the smallest hash.
    hashed = F.xxhash64("text")
    several = stored(own.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(hashed).alias("linked"), F.max(hashed).alias("last")).where("linked <> last").select("doc_id", "linked"))
    others = None
    if several.limit(1).count():
        told = own.join(several, "doc_id", "left").withColumn("out", F.coalesce(F.col("linked") != hashed, F.lit(False)))
        own, others = told.where("NOT out").select("doc_id", "text"), told.where("out").select("doc_id", "text")
    sets = stored(_sets(own, width))
    total = sets.count()
    named = sets.where("n > 0 AND doc_id IS NOT NULL")
    # Sets that several documents have; any other represents itself.
    first = named.groupBy("one", "two", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    chosen = spread_join(named.select("doc_id", "one", "two", "n"), first, ["one", "two", "n"], "copies", total)
    chosen = stored(chosen.select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).distinct())
    reps = chosen.where("doc_id = rep").select("rep")
    buckets = named.select(F.col("doc_id").alias("rep"), F.explode("bands").alias("band"))
    pivots = buckets.groupBy("band").agg(F.min("rep").alias("a"), F.max("rep").alias("last"), F.count(F.lit(1)).alias("size")).where("a < last").select("band", "a", "size")
    joined = spread_join(buckets, pivots, ["band"], "size", total * (REGISTERS // BAND)).where("a IS NOT NULL")
    shared = stored(joined.join(reps, "rep", "left_semi").select("band", "rep", "a").distinct())
    stars = stored(shared.where("a <> rep").select("a", F.col("rep").alias("b")).distinct())
    members = stored(stars.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = stored(_among(own, members).dropDuplicates(["doc_id"]))
    links = stored(_verified(stars, texts, width, percent))
    label = components(links)
    # Documents of a bucket with several components are contested; their remaining links are found by prefixes.
    named = shared.join(label.select(F.col("v").alias("rep"), "label"), "rep", "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))
    mixed = named.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("band")
    contested = stored(named.join(mixed, "band", "left_semi").select("rep", "label").distinct())
    again = _prefix_pairs(texts.join(contested, texts["doc_id"] == contested["rep"]).select("doc_id", "text", "label"), width, percent)
    again = again.join(stars, ["a", "b"], "left_anti")
    size = sets.select("doc_id", "n", "registers").join(contested.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    full = again.join(size.select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), F.col("registers").alias("r_a")), "a").join(size.select(F.col("doc_id").alias("b"), F.col("n").alias("n_b"), F.col("registers").alias("r_b")), "b")
    more = stored(_verified(stored(_likely(full, percent)), texts, width, percent))
    if more.limit(1).count():
        label = components(links.union(more))
    named = chosen.join(label.select(F.col("v").alias("rep"), "label"), "rep", "left").select("doc_id", F.coalesce("label", "rep").alias("component_id")).distinct()
    rows = sets.select("doc_id", "n") if others is None else sets.select("doc_id", "n").unionByName(_sets(others, width).select("doc_id", "n"))
    found = rows.select("doc_id", F.col("n").alias("n_shingles")).join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def op6_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), width=4)


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 3], ' ') AS shingle FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0) AS x),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s AS x JOIN s AS y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2) AS p JOIN n AS na ON na.doc_id = p.a JOIN n AS nb ON nb.doc_id = p.b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
near AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS v, doc_id AS label FROM documents UNION SELECT near.b, reach.label FROM reach JOIN near ON near.a = reach.v WHERE reach.label < near.b),
least AS (SELECT v, min(label) AS component_id FROM reach GROUP BY v)
SELECT documents.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = documents.doc_id AS kept FROM documents JOIN least ON v = documents.doc_id LEFT JOIN n ON n.doc_id = documents.doc_id
"""
