"""Benchmark decontamination with truncated suffix arrays over shards of the training documents.

Words of documents become numbers of the benchmark's vocabulary (0: a word that no item has). A shard's suffix array
holds the suffixes that can begin a match (enough known words in a row, a known first pair), sorted by their first ten
words. Every test suffix is found in it by binary search; the range of equal suffixes gives all its verbatim
occurrences. ``runs`` are the words inside any occurrence. ``matches`` has, for each item, its longest verbatim match:
occurrences of successive suffixes of the item at successive words are chained to the maximal match they are part of
(the one that begins first, then earliest in the item, on ties).

The benchmark is read in blocks of at most BLOCK_BYTES of text (one item at least), whose number is computed first. With
one block, the rule, nothing is shuffled. More blocks are searched one after the other: the driver and a task hold one
at a time, what each finds is stored, and a document is found again by the md5 of its text.

Items without words are ignored; one without an id hits like any other but is in no list of items; repeated items are
one. Null or empty documents have no words; repeated rows give one result row each; without items nothing is hit; an
empty table gives an empty result. A very long text is one shard by itself. Columns of other names are not read, and
``remove`` passes them through a struct.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, id_and_text, mapped, slices, stored, table

WINDOW = 10
BLOCK_BYTES = 32 << 20
RUN = "array<struct<start:int,end:int>>"
MATCH = "array<struct<item:string,length:int,start:int,item_start:int>>"
Match = tuple[str | None, int, int, int]

# ASCII letters in lower case and digits stay, bytes from 128 on (other code points) stay, the rest separates words.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


class Block:
    """The test suffixes of some items: windows of ten words, or a shorter item as one window."""

    def __init__(self, items: list[tuple[str | None, str]], width: int = WINDOW) -> None:
        self.width, self.ids = width, {}
        self.names, begins = [], []  # of the items, and where each begins among all their words
        found: dict[tuple[int, ...], list[int]] = defaultdict(list)
        end = 0
        for item, text in items:
            row = [self.ids.setdefault(w, len(self.ids) + 1) for w in words(text.encode())]
            self.names.append(item)
            begins.append(end)
            for i in range(max(1, len(row) - width + 1) if row else 0):
                found[tuple(row[i : i + width])].append(end + i)
            end += len(row) + 1
        self.begins = np.array(begins, np.int64)
        self.windows = sorted(found)
        self.owners = [np.array(found[w], np.int64) for w in self.windows]  # places of each window, in order
        self.lengths = np.array([len(w) for w in self.windows], np.int64)
        self.least = int(self.lengths.min()) if self.windows else 0
        rows = np.zeros((len(self.windows), width), ">u4")
        for i, w in enumerate(self.windows):
            rows[i, : len(w)] = w
        self.low = self._keys(rows)
        rows[np.arange(width) >= self.lengths[:, None]] = 0xFFFFFFFF
        self.high = self._keys(rows)
        lead = np.array([[*w, 0][:2] for w in self.windows], np.int64).reshape(-1, 2)
        self.first = np.zeros(len(self.ids) + 1, bool)
        self.first[lead[lead[:, 1] == 0, 0]] = True
        self.pairs = np.zeros(1 << 22, bool)
        self.pairs[self._pair(lead[:, 0], lead[:, 1])] = True

    def _keys(self, rows: np.ndarray) -> np.ndarray:
        return rows.copy(order="C").view(f"S{4 * self.width}").ravel()

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 1_000_003 + b) & (len(self.pairs) - 1)

    def numbers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The documents' words as numbers, a 0 behind each document, and where each begins."""
        rows, get = [], self.ids.get
        for t in texts:
            row = words(t)
            row.append(b"")
            rows.append(np.fromiter(map(get, row, repeat(0)), np.int64, len(row)))
        starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return np.concatenate([*rows, np.zeros(self.width, np.int64)]), starts

    def suffixes(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The truncated suffix array of a shard: sorted keys and places."""
        n = len(text) - self.width
        gaps = np.flatnonzero(text == 0)
        known = gaps[np.searchsorted(gaps, np.arange(n))] - np.arange(n) if n > 0 else np.zeros(0, np.int64)
        at = np.flatnonzero(known >= self.least)
        at = at[self.pairs[self._pair(text[at], text[at + 1])] | self.first[text[at]]]
        keys = self._keys(text[at[:, None] + np.arange(self.width)].astype(">u4").reshape(-1, self.width))
        order = np.argsort(keys, kind="stable")
        return keys[order], at[order]

    def occurrences(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, place) of every occurrence of every window."""
        keys, places = self.suffixes(text)
        left, right = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        n = right - left
        window = np.repeat(np.arange(len(n)), n)
        at = np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(left, n)
        return window, places[at]

    def longest(self, window: np.ndarray, place: np.ndarray) -> list[Match]:
        """The longest match of every item in one document, from the occurrences in the order of their places."""
        best: dict[int, Match] = {}
        at, length = np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = -2
        cut = np.flatnonzero(np.concatenate([[True], np.diff(place) != 0]))
        for k, (lo, hi) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(place)], strict=True)):
            now = int(place[lo])
            if now != before + 1:
                at, length = at[:0], length[:0]
            # Several windows occur at one place only if some are short, whole items.
            own = np.concatenate([self.owners[w] for w in window[lo:hi].tolist()])
            new = np.concatenate([np.full(len(self.owners[w]), self.lengths[w]) for w in window[lo:hi].tolist()])
            order = np.argsort(own)
            own, new = own[order], new[order]
            if len(at):
                prior = np.minimum(np.searchsorted(at, own - 1), len(at) - 1)
                new = np.where((at[prior] == own - 1) & (new == self.width), length[prior] + 1, new)
            item = np.searchsorted(self.begins, own, side="right") - 1
            top = np.lexsort((own, -new, item))  # the first of each item: its longest here, leftmost in the item
            top = top[np.concatenate([[True], np.diff(item[top]) != 0])]
            for i in top.tolist():
                n, name = int(new[i]), int(item[i])
                if name not in best or n > best[name][1]:
                    best[name] = (self.names[name], n, now + int(self.lengths[window[lo:hi]].max()) - n if n > self.width else now, int(own[i] - self.begins[name]) - max(n - self.width, 0))
            at, length, before = own, new, now
        return list(best.values())

    def clean(self, texts: list[bytes]) -> np.ndarray:
        """Whether each text holds no window of any item."""
        text, starts = self.numbers(texts)
        out = np.ones(len(texts), bool)
        if self.windows:
            out[np.searchsorted(starts, self.occurrences(text)[1], "right") - 1] = False
        return out

    def hits(self, texts: list[bytes]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[Match]]]:
        """For each text: its words, the maximal hit runs of words and the longest match of each item found."""
        text, starts = self.numbers(texts)
        window, place = self.occurrences(text) if self.windows else (np.zeros(0, np.int64),) * 2
        edge = np.zeros(len(text) + 1, np.int64)
        np.add.at(edge, place, 1)
        np.add.at(edge, place + self.lengths[window] if len(window) else place, -1)
        step = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=np.int8(0))
        begin, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        runs: list[list[tuple[int, int]]] = [[] for _ in texts]
        for d, s, e in zip(np.searchsorted(starts, begin, "right") - 1, begin, end, strict=True):
            runs[d].append((int(s - starts[d]), int(e - starts[d])))
        found: list[list[Match]] = [[] for _ in texts]
        order = np.argsort(place, kind="stable")
        window, place = window[order], place[order]
        cut = np.searchsorted(place, starts)
        for d in np.flatnonzero(np.diff(cut)).tolist():
            found[d] = self.longest(window[cut[d] : cut[d + 1]], place[cut[d] : cut[d + 1]] - starts[d])
        return (np.diff(starts) - 1).tolist(), runs, found


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def best_of(found: list[Match]) -> list[Match]:
    """One match for each item that has an id, the longest (then first), ordered by item."""
    best: dict[str, Match] = {}
    for m in sorted((m for m in found if m[0] is not None), key=lambda m: (-m[1], m[2:])):
        best.setdefault(m[0], m)
    return [best[k] for k in sorted(best)]


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The items (item, text) and the number of blocks that they are searched in. Their bytes are counted, not collected."""
    items = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).dropna(subset=["text"]).distinct()
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("item"), F.lit(0)))).first()[0] or 0
    return items, max(1, -(-2 * size // BLOCK_BYTES))


def _block(items: DataFrame, n: int, k: int):  # noqa: ANN202
    """Block k of n as a broadcast of about half BLOCK_BYTES."""
    part = items if n == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)
    return items.sparkSession.sparkContext.broadcast([tuple(r) for r in part.collect()])


RUN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
MATCH_TYPE = pa.list_(pa.struct([("item", pa.string()), ("length", pa.int32()), ("start", pa.int32()), ("item_start", pa.int32())]))


def _columns(runs: list[list[tuple[int, int]]], found: list[list[Match]]) -> list[pa.Array]:
    names = [f.name for f in MATCH_TYPE.value_type]
    return [pa.array([[{"start": s, "end": e} for s, e in r] for r in runs], RUN_TYPE), pa.array([[dict(zip(names, m, strict=True)) for m in best_of(x)] for x in found], MATCH_TYPE)]


def _searched(docs: DataFrame, block, width: int) -> DataFrame:  # noqa: ANN001
    """doc_id, text_md5, n_words, runs and matches of (doc_id, text, text_md5). No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in slices(batches):
            own = own or Block(block.value, width)
            n, runs, found = own.hits(bytes_of(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), *_columns(runs, found)], ["doc_id", "text_md5", "n_words", "runs", "matches"])

    return mapped(docs, run, f"doc_id long, text_md5 string, n_words long, runs {RUN}, matches {MATCH}")


def _hits(keyed: DataFrame, items: DataFrame, n: int, width: int) -> DataFrame:
    """(text_md5, runs, matches) of the texts that blocks hit, one row a block and text; each block's are stored before the next is read."""
    out = None
    for k in range(n):
        block = _block(items, n, k)
        part = stored(_searched(keyed, block, width).where("size(runs) > 0").select("text_md5", "runs", "matches").dropDuplicates(["text_md5"]))
        block.destroy()
        out = part if out is None else out.unionByName(part)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (word positions of maximal hit runs), items (sorted ids with occurring windows), matches."""
    own, (items, n) = id_and_text(docs, id_col, text_col), _items(benchmark, item_col, item_text_col)
    if n == 1:
        found = _searched(own.withColumn("text_md5", F.lit(None).cast("string")), _block(items, 1, 0), width)
    else:
        keyed = own.withColumn("text_md5", F.md5(F.coalesce("text", F.lit(""))))
        hits = _hits(keyed, items, n, width).groupBy("text_md5").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("matches")).alias("matches"))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                runs = [merged([(r["start"], r["end"]) for r in x]) for x in batch.column(1).to_pylist()]
                found = [[tuple(m.values()) for m in x] for x in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *_columns(runs, found)], ["text_md5", "runs", "matches"])

        counted = _searched(keyed, docs.sparkSession.sparkContext.broadcast([]), width).select("doc_id", "text_md5", "n_words")
        found = counted.join(mapped(hits, join, f"text_md5 string, runs {RUN}, matches {MATCH}"), "text_md5", "left")
        none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
        found = found.select("doc_id", "n_words", none("runs", RUN), none("matches", MATCH))
    return found.select("doc_id", "n_words", "runs", F.transform("matches", lambda m: m["item"]).alias("items"), "matches")


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all their columns, that hold no window of any item. No shuffle for a benchmark of one block."""
    items, n = _items(benchmark, item_col, item_text_col)
    if n == 1:
        block, at = _block(items, 1, 0), docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = None
            for batch in slices(batches, text_col):
                own = own or Block(block.value, width)
                yield batch.filter(pa.array(own.clean(bytes_of(batch.column(at)))))

        return mapped(docs, run, docs.schema)
    text = F.col(f"`{text_col}`").cast("string")
    keyed = docs.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.md5(F.coalesce(text, F.lit(""))).alias("text_md5"))
    gone = _hits(keyed, items, n, width).select("text_md5").distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.md5(F.coalesce(text, F.lit(""))).alias("text_md5"))
    return whole.join(gone, "text_md5", "left_anti").select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    long = F.transform("runs", lambda r: (r["end"] - r["start"]).cast("long"))
    n_hit = F.aggregate(long, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        F.coalesce(F.array_max(long), F.lit(0).cast("long")).alias("longest_run"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["length"].cast("long"))), F.lit(0).cast("long")).alias("longest_match"),
    )


SQL_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, {SQL_WORDS} AS words FROM documents), b AS (SELECT item_id, {SQL_WORDS} AS words FROM benchmark),
t AS (SELECT item_id, p, least(len(words), 10) AS n, array_to_string(words[p:p + 9], ' ') AS key FROM (SELECT item_id, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS p FROM b WHERE len(words) > 0) AS x),
o AS (SELECT d.doc_id, q, t.item_id, t.p, t.n FROM (SELECT doc_id, words, size, unnest(range(1, len(words) - size + 2)) AS q FROM d, (SELECT DISTINCT n AS size FROM t) AS z WHERE len(words) >= size) AS d
      JOIN t ON t.n = d.size AND t.key = array_to_string(d.words[q:q + size - 1], ' ')),
islands AS (SELECT doc_id, q, e, sum(fresh) OVER (PARTITION BY doc_id ORDER BY q) AS g FROM (SELECT doc_id, q, e, CASE WHEN q <= max(e) OVER (PARTITION BY doc_id ORDER BY q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM (SELECT doc_id, q, max(q + n) AS e FROM o GROUP BY doc_id, q) AS x) AS y),
runs AS (SELECT doc_id, max(e) - min(q) AS size FROM islands GROUP BY doc_id, g),
hit AS (SELECT doc_id, sum(size) AS n_hit, max(size) AS longest_run FROM runs GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT cast(item_id AS varchar), ',' ORDER BY cast(item_id AS varchar)) AS items FROM o GROUP BY doc_id),
long AS (SELECT doc_id, max(size) AS longest_match FROM (SELECT doc_id, max(q + n) - min(q) AS size FROM (SELECT *, q - row_number() OVER (PARTITION BY doc_id, item_id, q - p, n ORDER BY q) AS g FROM (SELECT DISTINCT * FROM o WHERE item_id IS NOT NULL) AS x) AS y GROUP BY doc_id, item_id, q - p, n, g) AS z GROUP BY doc_id)
SELECT d.doc_id, cast(len(words) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit, cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       cast(coalesce(longest_run, 0) AS bigint) AS longest_run, cast(coalesce(longest_match, 0) AS bigint) AS longest_match
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN found ON d.doc_id = found.doc_id LEFT JOIN long ON d.doc_id = long.doc_id
"""
