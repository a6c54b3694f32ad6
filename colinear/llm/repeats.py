"""Removal of repeated 100-byte windows by a depth-limited, most-significant-digit radix sort of sparse suffixes.

Which windows occur earlier (in a smaller doc_id, or before in the same document) is found without a row for each byte:

* Suffixes are sorted only where it matters. In every window the gram of 37 bytes with the smallest 13 bits of a hash
  (leftmost on ties) is the window's anchor, so equal windows have equal anchors at equal offsets. Neighbouring windows with the same
  anchor form a segment, on average 32 windows; a segment is cut at every BLOCK bytes of a long text.
* First digit: segments are dealt by their gram. Equal segments of a gram collapse to their first document before they
  travel further; a segment that is not first is repeated in all its windows. A gram with one distinct segment is a
  singleton group and is dropped: its windows occur nowhere else.
* Next digits: the segments left of a gram bring their bytes, and their windows are ordered by digits of 5 bytes, most
  significant first. Each pass orders only windows whose group has others and drops those left alone; groups that are
  still together at the depth of 100 bytes are exactly the repeated windows.
* Crowded grams, of over CROWD distinct segments, are dealt by the last digit at once: their windows by two 64-bit hashes
  of the 100 bytes, as a partial aggregate, so that no gram is the work of one task. Rows are counted by BUCKETS of
  grams beforehand; grams of a bucket with over CROWD rows and over eight times the mean are taken for crowded before
  their segments are dealt, by the whole segment.

What is first goes back to its documents (a list a document, bounded by its own length). Segments, and the windows of
crowded grams, are known by two 64-bit hashes and not compared on bytes; all others are.

Null or empty text has 0 bytes; texts under 100 bytes lose nothing. Rows without an id are ordered as if their id were
2**62 plus 62 bits of a hash of their text. Rows of one id are each judged against smaller ids and themselves, not
against one another, so repeated rows get the same answer. Very long texts are cut for the search; what is held of them
is about 30 bytes for each of theirs. An empty table gives an empty result; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Rolling, bytes_of, id_and_text, mapped, slices, table

DEPTH = 100
GRAM = 37
SPAN = DEPTH - GRAM + 1  # grams in a window: 64, as many as a mask has bits
DIGIT = 5  # bytes: a key of 64 bits holds them and the number of a group
BLOCK = 1 << 18  # windows whose anchors are found at once
PLACE = np.uint32((1 << 19) - 1)
NO_ID = 1 << 62
GROUP_ROWS = 10_000
SLICE = 1 << 19  # bytes of text worked on at once
BUCKETS, PART = 1 << 18, 1 << 12
CROWD = 20_000  # distinct segments of a gram that one task compares at once: 3 MB of bytes
STATES = np.uint64(3)  # the two lowest bits of a segment's code
ALONE, SEVERAL, CROWDED = 0, 1, 2
WHOLE = -1  # in place of a position: the row names a window by its hash

GRAMS, OTHERS = Rolling(101), Rolling(606)


def anchors(grams: np.ndarray) -> np.ndarray:
    """For each window, the place of its anchor: the smallest upper 13 bits of a gram's hash, leftmost on ties."""
    low = (grams >> np.uint64(32)).astype(np.uint32)
    low &= ~PLACE
    low |= np.arange(len(grams), dtype=np.uint32)
    step = 1
    while step < SPAN:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    low &= PLACE
    return low


class Segments:
    """The segments of some documents, in order. start, anchor: places in the joined bytes; n: windows; doc: index."""

    def __init__(self, texts: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        self.size = np.array([len(t) for t in texts], np.int64)
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        found = [self._block(at, n) for at, n in self._blocks()]
        kinds = (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.start, self.anchor, self.n, self.doc, self.gram, self.hash = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, t) for k, t in enumerate(kinds))

    def _blocks(self) -> Iterator[tuple[int, int]]:
        """(place, windows) of the blocks: whole documents, or parts of a long one, cut by its own places alone.

        So a document has the same segments whatever others it comes with.
        """
        at = 0
        for begin, end in zip(self.begin.tolist(), self.end.tolist(), strict=True):
            if end - at > BLOCK:
                if begin - at >= DEPTH:
                    yield at, begin - at - DEPTH + 1
                at = begin
                while end - at >= BLOCK + DEPTH:
                    yield at, BLOCK
                    at += BLOCK
        if len(self.data) - at >= DEPTH:
            yield at, len(self.data) - at - DEPTH + 1

    def _block(self, at: int, n: int) -> tuple[np.ndarray, ...]:
        data = self.data[at : at + n + DEPTH - 1]
        valid = np.ones(n, bool)  # a window that begins here ends inside its document
        for end in self.end[(self.end > at) & (self.end < at + len(data))].tolist():
            valid[max(end - DEPTH + 1 - at, 0) : end - at] = False
        prefix = GRAMS.prefix(data)
        grams = GRAMS.windows(prefix, GRAM)
        anchor = anchors(grams)
        # Documents are apart by the windows that are not valid, so a segment ends there or where the anchor changes.
        change = anchor[1:] != anchor[:-1]
        first, last = valid.copy(), valid.copy()
        first[1:] &= change | ~valid[:-1]
        last[:-1] &= change | ~valid[1:]
        start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        anchor = anchor[start].astype(np.int64)
        whole = GRAMS.of(prefix, start, end - 1 + DEPTH)
        return start + at, anchor + at, end - start, np.searchsorted(self.end, start + at, side="right"), grams[anchor], whole & ~STATES

    def bucket(self) -> np.ndarray:
        return (self.gram % np.uint64(BUCKETS)).astype(np.int64)

    def once(self, ids: np.ndarray) -> np.ndarray:
        """The segments without their repetitions among these documents: each stays in the one with the smallest id."""
        order = np.lexsort((ids, self.hash, self.gram))
        gram, whole = self.gram[order], self.hash[order]
        return order[np.concatenate([[True], (np.diff(gram) != 0) | (np.diff(whole) != 0)])] if len(order) else order

    def state(self, firsts: list[list[int] | None]) -> np.ndarray:
        """ALONE, SEVERAL or CROWDED for the segments that are the first of their kind, else -1."""
        codes, known = _listed(firsts, STATES)
        return _looked_up(self.doc, self.hash, known, (codes & STATES).astype(np.int64))

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, place) of every window of these segments."""
        n = self.n[at]
        step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.doc[at], n), np.repeat(self.start[at], n) + step

    def hashes(self, place: np.ndarray, rolling: Rolling) -> np.ndarray:
        """Of the windows at these places, taken block by block."""
        out = np.zeros(len(place), np.uint64)
        block = place // BLOCK
        for k in np.unique(block).tolist():
            own = block == k
            start = place[own] - k * BLOCK
            out[own] = rolling.of(rolling.prefix(self.data[k * BLOCK : (k + 1) * BLOCK + DEPTH - 1]), start, start + DEPTH)
        return out


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _listed(lists: list[list[int] | None], ignored: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """All codes of all documents' lists, and what names code (less the ignored bits) and document in one number."""
    n = np.array([len(x or ()) for x in lists], np.int64)
    codes = np.fromiter((c for x in lists for c in x or ()), np.int64, int(n.sum())).view(np.uint64)
    return codes, (codes & ~ignored) ^ (np.repeat(np.arange(len(n)), n).astype(np.uint64) * MULTIPLIER)


def _looked_up(doc: np.ndarray, own: np.ndarray, known: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The value of each (doc, own) among the known ones at its first occurrence, else -1."""
    out = np.full(len(own), -1, np.int64)
    if not len(known) or not len(own):
        return out
    key = own ^ (doc.astype(np.uint64) * MULTIPLIER)
    order = np.argsort(known)
    at = order[np.minimum(np.searchsorted(known[order], key), len(known) - 1)]
    first = np.unique(key, return_index=True)[1]
    first = first[known[at[first]] == key[first]]
    out[first] = value[at[first]]
    return out


def _crowded(docs: DataFrame, crowd: int) -> tuple[np.ndarray, bool]:
    """Which buckets of grams are crowded, from exact counts of all segments' rows (BUCKETS flags, whatever the input), and whether any gram can be."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in slices(batches, limit=SLICE):
            s = Segments(bytes_of(batch.column(0)))
            total += np.bincount(s.bucket()[s.once(s.doc)], minlength=BUCKETS)
        for k in np.flatnonzero(total.reshape(-1, PART).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total[k * PART : (k + 1) * PART].tobytes()], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[part] = total.get(part, 0) + np.frombuffer(counts, np.int64)
        for part, n in total.items():
            at = np.flatnonzero(n > crowd)
            all_ = pa.array(np.full(len(at) + 1, n.sum()))  # the last row brings the part's sum alone
            yield pa.RecordBatch.from_arrays([pa.array(np.append(at + part * PART, -1)), pa.array(np.append(n[at], 0)), all_], ["bucket", "n", "all"])

    counted = mapped(mapped(docs.select("text"), count, "part int, counts binary").repartition("part"), add, "bucket long, n long, all long")
    rows = counted.collect()  # BUCKETS rows at most, and one for each part
    mean = sum(r["all"] for r in rows if r["bucket"] < 0) / BUCKETS
    flags = np.zeros(BUCKETS, bool)
    flags[[r["bucket"] for r in rows if r["bucket"] >= 0 and r["n"] > 8 * mean]] = True
    return flags, any(r["bucket"] >= 0 for r in rows)


def _first_segments(docs: DataFrame, crowded: np.ndarray, crowd: int) -> DataFrame:
    """(doc_id, firsts): the codes (hash and state) of the segments whose first document it is."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(crowded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = np.unpackbits(shared.value).astype(bool)
        for batch in slices(batches, limit=SLICE):
            s = Segments(bytes_of(batch.column(1)))
            ids = batch.column(0).to_numpy(zero_copy_only=False)[s.doc].astype(np.int64)
            at = s.once(ids)
            own = hot[s.bucket()[at]]
            whole = s.hash[at]
            dealt = np.where(own, s.gram[at] ^ (whole * MULTIPLIER), s.gram[at])
            code = whole | np.where(own, np.uint64(CROWDED), np.uint64(ALONE))
            yield pa.RecordBatch.from_arrays([pa.array(dealt.view(np.int64)), pa.array(code.view(np.int64)), pa.array(ids[at])], ["gram", "code", "doc_id"])

    # One exchange serves both levels; every slice has already sent each segment once.
    dealt = mapped(docs.select("doc_id", "text"), run, "gram long, code long, doc_id long").repartition("gram")
    first = dealt.groupBy("gram", "code").agg(F.min("doc_id").alias("doc_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("gram"))
    state = F.when(F.col("code").bitwiseAND(3) == CROWDED, 0).when(n > crowd, CROWDED).when(n > 1, SEVERAL).otherwise(ALONE)
    return first.select("doc_id", (F.col("code") + state).alias("code")).groupBy("doc_id").agg(F.collect_list("code").alias("firsts"))


PIECE = "gram long, doc_id long, row long, pos long, off int, n int, piece binary"


def _pieces(known: DataFrame) -> DataFrame:
    """The bytes of first segments that share their gram with other segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            s = Segments(bytes_of(batch.column(1)))
            at = np.flatnonzero(s.state(batch.column(3).to_pylist()) == SEVERAL)
            raw, start, end = s.data.tobytes(), s.start[at], s.start[at] + s.n[at] - 1 + DEPTH
            doc = s.doc[at]
            ids, row = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64)[doc] for k in (0, 2))
            columns = [s.gram[at].view(np.int64), ids, row, start - s.begin[doc], (s.anchor[at] - start).astype(np.int32), s.n[at].astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array([raw[a:b] for a, b in zip(start, end, strict=True)], pa.binary())], ["gram", "doc_id", "row", "pos", "off", "n", "piece"])

    return mapped(known.where(F.exists("firsts", lambda c: c.bitwiseAND(3) == SEVERAL)), run, PIECE)


def _shared(group: np.ndarray) -> np.ndarray:
    """Which members of the groups, in order, are not alone."""
    edge = np.diff(group) != 0
    return ~(np.append(True, edge) & np.append(edge, True)) if len(group) else np.zeros(0, bool)


def equal_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that equal others of their group, by radix passes: their indices, ordered by class and then as given, and their classes.

    The groups are fewer than 2**24.
    """
    word = np.zeros(len(data), np.uint64)  # the digit that begins at each byte
    for k in range(DIGIT):
        word[: len(data) - k] |= data[k:].astype(np.uint64) << np.uint64(8 * (DIGIT - 1 - k))
    live = np.argsort(group, kind="stable")
    group = group[live]
    for at in range(0, DEPTH, DIGIT):
        left = _shared(group)  # groups of one are dropped
        live, group = live[left], group[left]
        if not len(live):
            return live, group
        digit = word[start[live] + at]
        key = np.cumsum(np.append(0, np.diff(group) != 0)).astype(np.uint64) << np.uint64(8 * DIGIT) | digit
        order = np.argsort(key)
        live, key = live[order], key[order]
        group = np.cumsum(np.append(0, np.diff(key) != 0))
    left = _shared(group)
    live, group = live[left], group[left]
    order = np.lexsort((live, group))
    return live[order], group[order]


def compare(gram: np.ndarray, ids: np.ndarray, row: np.ndarray, off: np.ndarray, n: np.ndarray, pieces: list[bytes]) -> np.ndarray:
    """Masks of the windows (bit j: the one that starts at byte j) that an earlier piece of the same gram has too.

    The pieces come in the order of their gram, then their place in the corpus. Earlier is one of a smaller id or of
    the same row.
    """
    size = np.array([len(p) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(pieces), np.uint8)
    piece = np.repeat(np.arange(len(pieces)), n)
    j = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    start = (np.cumsum(size) - size)[piece] + j
    group = np.cumsum(np.concatenate([[0], np.diff(gram) != 0]))[piece] * SPAN + off[piece] - j  # windows that share gram and offset
    at, kind = equal_windows(data, start, group)
    mask = np.zeros(len(pieces), np.uint64)
    if len(at):
        own = piece[at]
        begins = np.concatenate([[True], np.diff(kind) != 0])
        first = own[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
        before = np.concatenate([[0], own[:-1]])
        again = ~begins & ((ids[first] != ids[own]) | ((ids[before] == ids[own]) & (row[before] == row[own])))
        np.bitwise_or.at(mask, own[again], np.uint64(1) << j[at[again]].astype(np.uint64))
    return mask


FOUND = "doc_id long, row long, pos long, mask long"


def _repeated(pieces: DataFrame) -> DataFrame:
    """The repeated windows of first segments: (doc_id, row, pos, mask)."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        gram, ids, row, pos, off, n = (rows.column(k).to_numpy() for k in range(6))
        other = np.ones(len(gram), bool)  # repeated rows bring their pieces again
        other[1:] = (np.diff(gram) != 0) | (np.diff(ids) != 0) | (np.diff(row) != 0) | (np.diff(pos) != 0)
        at = np.flatnonzero(other)
        gram, ids, row, pos, off, n = (x[at] for x in (gram, ids, row, pos, off, n))
        mask = compare(gram, ids, row, off.astype(np.int64), n.astype(np.int64), rows.column(6).take(pa.array(at)).to_pylist())
        keep = mask != 0
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (ids, row, pos, mask.view(np.int64))], ["doc_id", "row", "pos", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy()
            cut = int(np.searchsorted(gram, gram[-1]))  # the last gram may go on
            if count + cut >= GROUP_ROWS and (cut or held[-1].column(0)[-1].as_py() != gram[-1]):
                yield done(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, count, batch = [], 0, batch.slice(cut)
            held.append(batch)
            count += batch.num_rows
        if held:
            yield done(pa.Table.from_batches(held))

    return mapped(pieces.repartition("gram").sortWithinPartitions("gram", "doc_id", "row", "pos"), run, FOUND)


def _first_windows(known: DataFrame) -> DataFrame:
    """The windows of crowded grams whose first document it is: (doc_id, row, pos = WHOLE, mask = the window's hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            s = Segments(bytes_of(batch.column(1)))
            doc, place = s.windows(np.flatnonzero(s.state(batch.column(3).to_pylist()) == CROWDED))
            one, two = (s.hashes(place, r) for r in (GRAMS, OTHERS))
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)[doc]
            order = np.lexsort((ids, two, one))
            one, two, ids = one[order], two[order], ids[order]
            keep = np.concatenate([[True], (np.diff(one) != 0) | (np.diff(two) != 0)]) if len(ids) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep].view(np.int64)) for x in (one, two, ids)], ["one", "two", "doc_id"])

    crowded = known.where(F.exists("firsts", lambda c: c.bitwiseAND(3) == CROWDED))  # only texts that have any go to Python
    first = mapped(crowded, run, "one long, two long, doc_id long").groupBy("one", "two").agg(F.min("doc_id").alias("doc_id"))
    return first.select("doc_id", F.lit(0).cast("long").alias("row"), F.lit(WHOLE).cast("long").alias("pos"), F.col("one").alias("mask"))


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, runs (removed byte ranges, maximal) and kept_sha256 of what is left. ``crowd`` changes the way, not the result."""
    own = id_and_text(docs, id_col, text_col)
    late = F.lit(NO_ID) + F.xxhash64("text").bitwiseAND(NO_ID - 1)
    keyed = own.select(F.coalesce("doc_id", late).alias("doc_id"), "text", F.xxhash64("text").alias("row"), F.col("doc_id").isNull().alias("no_id"))
    crowded, any_ = _crowded(keyed, crowd)
    known = keyed.join(_first_segments(keyed, crowded, crowd), "doc_id", "left").select("doc_id", "text", "row", "firsts", "no_id")
    found = _repeated(_pieces(known))
    if any_:
        found = found.unionByName(_first_windows(known))
    listed = found.groupBy("doc_id").agg(F.collect_list(F.struct("row", "pos", "mask")).alias("windows"))
    marked = known.join(listed, "doc_id", "left").select("doc_id", "text", "row", "firsts", "no_id", "windows")
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=SLICE):
            s = Segments(bytes_of(batch.column(1)))
            state = s.state(batch.column(3).to_pylist())
            again = np.flatnonzero(state < 0)
            starts, ends = [s.start[again]], [s.start[again] + s.n[again] - 1 + DEPTH]
            listed = batch.column(5).to_pylist()
            doc, place = s.windows(np.flatnonzero(state == CROWDED))
            if len(place):
                known_ = _listed([[w["mask"] for w in x or () if w["pos"] == WHOLE] for x in listed], np.uint64(0))[1]
                place = place[_looked_up(doc, s.hashes(place, GRAMS), known_, np.zeros(len(known_), np.int64)) < 0]
                starts.append(place)
                ends.append(place + DEPTH)
            for d, (row, windows) in enumerate(zip(batch.column(2).to_pylist(), listed, strict=True)):
                own = [(w["pos"], w["mask"]) for w in windows or () if w["pos"] != WHOLE and w["row"] == row]
                if own:
                    pos, mask = np.array(own, np.int64).T
                    which, bit = np.nonzero(mask[:, None] >> np.arange(SPAN) & 1)
                    starts.append(s.begin[d] + pos[which] + bit)
                    ends.append(starts[-1] + DEPTH)
            size = len(s.data) + 1
            depth = np.bincount(np.concatenate(starts), minlength=size) - np.bincount(np.concatenate(ends), minlength=size)
            gone = np.cumsum(depth[:-1]) > 0
            kept = s.data[~gone].tobytes()
            kept_end = np.concatenate([[0], np.cumsum(~gone)])
            before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            before[s.begin[s.size > 0]] = False
            first = np.flatnonzero(gone & ~before)
            after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
            after[s.end[s.size > 0] - 1] = False
            last = np.flatnonzero(gone & ~after) + 1
            runs: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for d, a, b in zip(np.searchsorted(s.end, first, side="right").tolist(), first.tolist(), last.tolist(), strict=True):
                runs[d].append({"start": int(a - s.begin[d]), "end": int(b - s.begin[d])})
            digest = [hashlib.sha256(kept[kept_end[a] : kept_end[b]]).hexdigest() for a, b in zip(s.begin, s.end, strict=True)]
            ids = [None if no else i for i, no in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(s.size, pa.int64()), pa.array(runs, run_type), pa.array(digest)], ["doc_id", "n_bytes", "runs", "kept_sha256"])

    return mapped(marked, run, "doc_id long, n_bytes long, runs array<struct<start:long,end:long>>, kept_sha256 string")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    return removed(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), "kept_sha256")


OP4_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, s, substr(h, cast(2 * s + 1 AS bigint), 200) AS bytes FROM (SELECT doc_id, h, unnest(range(length(h) // 2 - 99)) AS s FROM d WHERE length(h) >= 200) AS x),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY bytes ORDER BY doc_id, s) AS k FROM w) AS x WHERE k > 1),
islands AS (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 100 THEN 0 ELSE 1 END AS fresh FROM again) AS x),
runs AS (SELECT doc_id, min(s) AS a, max(s) + 100 AS b FROM islands GROUP BY doc_id, g),
cut AS (SELECT r.doc_id, a, b, substr(h, cast(2 * before + 1 AS bigint), cast(2 * (a - before) AS bigint)) AS kept FROM (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs) AS r JOIN d ON r.doc_id = d.doc_id),
gone AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k, max(b) AS last, string_agg(kept, '' ORDER BY a) AS kept FROM cut GROUP BY doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, cast(coalesce(n, 0) AS bigint) AS n_removed, coalesce(k, 0) AS n_spans, sha256(unhex(concat(coalesce(kept, ''), substr(h, cast(2 * coalesce(last, 0) + 1 AS bigint))))) AS kept_sha256
FROM d LEFT JOIN gone ON d.doc_id = gone.doc_id
"""
