"""Shared helpers: input projection, byte-bounded Arrow slices and rolling hashes of whole texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import scratch, shared_folder, stored

__all__ = ["Rolling", "bytes_of", "components", "id_and_text", "kind_count", "mapped", "mix64", "scratch", "shared_folder", "slices", "span_digest", "spread_join", "sql_spans", "stored", "table"]

SLICE_BYTES = 4 << 20
BATCH_BYTES = 4 << 20  # of an Arrow batch on its way to Python; Spark's own default is sixteen times as much


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, so extra columns of any name cannot clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends, start = np.cumsum(size, dtype=np.int64), 0
        while start < batch.num_rows:
            before = int(ends[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mapped(df: DataFrame, run, schema) -> DataFrame:  # noqa: ANN001
    """``df.mapInArrow``, for whose batches the session's limit is lowered to BATCH_BYTES unless it is lower already.

    An executor holds a batch or two for each task in Java, outside its heap, and another in each Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = df.sparkSession.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        df.sparkSession.conf.set(key, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each value; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def span_digest(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` joined by commas; the spans are already in order."""
    if kinds is not None:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sql_spans(rank: int, kind: str, pattern: str, holds: str) -> str:
    """SQL of (i, rank, kind, part, start, stop) over a table d (i, t): each match of the pattern for which ``holds``.

    Marks are put around every match; every second piece between marks is one, at the sum of the lengths before it.
    """
    quoted = pattern.replace("'", "''")
    marked = f"string_split(regexp_replace(t, '{quoted}', concat(chr(1), '\\0', chr(1)), 'g'), chr(1))"
    pieces = f"SELECT i, unnest({marked}) AS part, unnest(range(1, len({marked}) + 1)) AS n FROM d"
    placed = f"SELECT i, part, n, sum(length(part)) OVER (PARTITION BY i ORDER BY n) AS stop FROM ({pieces}) AS a"
    return f"SELECT i, {rank} AS rank, '{kind}' AS kind, part, stop - length(part) AS start, stop FROM ({placed}) AS b WHERE n % 2 = 0 AND {holds}"


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words (xor-shift and multiply rounds)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


class Rolling:
    """Hashes of any substring of a byte buffer from prefix sums modulo 2**64 over random byte values.

    The hash of ``[s, e)`` is ``(P[e] - P[s]) * base**-s``: independent of the place, O(1) per substring.
    """

    def __init__(self, seed: int) -> None:
        rng = np.random.Generator(np.random.PCG64(seed))
        self.values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(2**40, 2**62)) * 8 + 5
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            inverse = pow(self.base, -1, 2**64)
            self.up, self.down = (self._table(b, n) for b in (self.base, inverse))

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 2**64))])
        return out[:n]

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._powers(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scrambled hashes of the substrings; not to be compared between substrings of different length."""
        return mix64((prefix[end] - prefix[start]) * self.down[start])

    def windows(self, prefix: np.ndarray, width: int) -> np.ndarray:
        n = len(prefix) - width
        return mix64((prefix[width:] - prefix[:n]) * self.down[:n])


HEAVY = 1_000


def spread_join(rows: DataFrame, table_: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows left-joined with the table's values by keys, so that no key's rows are the work of one task.

    ``weight`` is how many rows have the table row's key, ``total`` at least their sum. Keys of more than total / HEAVY
    rows, fewer than HEAVY of them whatever the input, are broadcast; their rows are spread over all tasks of the join
    that finds the others.
    """
    values = [c for c in table_.columns if c not in (*keys, weight)]
    light, heavy = table_.where(F.col(weight) * HEAVY <= total), table_.where(F.col(weight) * HEAVY > total)
    known = F.broadcast(heavy.select(*keys, F.struct(*values).alias("_heavy")))
    salt = F.when(F.col("_heavy").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))).cast("long")
    marked = rows.join(known, keys, "left").withColumn("_salt", salt)
    # The salt of the others is no literal, which Catalyst would take out of the keys that rows are dealt by.
    plain = F.when(F.col(weight) * HEAVY <= total, 0).otherwise(1).cast("long")
    found = marked.join(light.select(*keys, plain.alias("_salt"), F.struct(*values).alias("_light")), [*keys, "_salt"], "left")
    return found.select(*rows.columns, *[F.coalesce(F.col("_heavy")[c], F.col("_light")[c]).alias(c) for c in values])


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of the undirected edges (a, b) can reach.

    Every round takes the smallest label among a vertex and its neighbours, then that label's own label (pointer
    jumping); each round is stored. Hubs of stars and labels that many vertices have are found by counts and their rows
    spread. Nothing but the number of changes and of rows reaches the driver.
    """
    both = stored(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("label")))
    n_edges, n_vertices = both.count(), labels.count()
    degree = both.groupBy("b").agg(F.count(F.lit(1)).alias("degree"))
    hubs = stored(degree.where(F.col("degree") * HEAVY > n_edges))
    while True:
        own = labels.select(F.col("v").alias("b"), "label").join(F.broadcast(hubs), "b", "left").select("b", "label", F.coalesce("degree", F.lit(0)).alias("degree"))
        near = spread_join(both, own, ["b"], "degree", n_edges).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        least = stored(labels.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        crowd = stored(least.groupBy("label").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") * HEAVY > n_vertices))
        jump = labels.select(F.col("v").alias("label"), F.col("label").alias("next")).join(F.broadcast(crowd), "label", "left").select("label", "next", F.coalesce("crowd", F.lit(0)).alias("crowd"))
        step = stored(spread_join(least, jump, ["label"], "crowd", n_vertices).select("v", "old", F.least("label", F.coalesce("next", "label")).alias("label")))
        changed = step.where("old <> label").limit(1).count()
        labels = step.select("v", "label")
        if not changed:
            return labels
