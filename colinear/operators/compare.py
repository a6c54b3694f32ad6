"""Homology comparison of two alignments: which aligned pairs of one are aligned in the other too."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.maf import cells
from ..sources.shared import stored
from . import coverage
from .coverage import in_intervals, pair_count

PAIR = ["seq1", "pos1", "seq2", "pos2"]
REGIONS = ("both", "A", "B", "neither")


def legit_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """Names that both alignments have. Different source lengths of a name are an error."""
    size = lambda x, c: x.groupBy("name").agg(F.max("source_length").alias(c))
    both = size(a, "la").join(size(b, "lb"), "name")
    return both.select(F.when(F.col("la") != F.col("lb"), F.raise_error(F.concat(F.lit("different source lengths: "), "name")).cast("string")).otherwise(F.col("name")).alias("name"))


def _ordered(both: DataFrame) -> DataFrame:
    """Distinct pairs of the positions p1 and p2, the smaller (name, position) first."""
    low, high = F.least("p1", "p2"), F.greatest("p1", "p2")
    return both.select(low["name"].alias("seq1"), low["pos"].alias("pos1"), high["name"].alias("seq2"), high["pos"].alias("pos2")).distinct()


def pairs(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct aligned pairs (seq1, pos1, seq2, pos2), the smaller (name, position) first."""
    c = cells(rows.join(names, "name", "left_semi"))
    one, two = (c.select("block_id", "col", F.col("row_idx").alias(f"r{k}"), F.struct("name", "pos").alias(f"p{k}")) for k in (1, 2))
    return _ordered(one.hint("merge").join(two, ["block_id", "col"]).where("r1 < r2"))


def unranked(rank: Column) -> tuple[Column, Column]:
    """The pair i < j that has this rank among the pairs (0, 1), (0, 2), (1, 2), (0, 3) and so on."""
    near = F.floor((1 + F.sqrt(8 * rank.cast("double") + 1)) / 2).cast("long")
    below = lambda j: F.expr("1") * j * (j - 1) / 2
    j = F.when(below(near) > rank, near - 1).when(below(near + 1) <= rank, near + 1).otherwise(near)
    return (rank - (j * (j - 1) / 2).cast("long")).cast("long"), j


def sampled_pairs(rows: DataFrame, names: DataFrame, samples: int, seed: int = 0) -> DataFrame:
    """About ``samples`` of the aligned pairs, as ``pairs`` gives them; all if there are no more. No other pair is made.

    Pairs of a column are numbered and drawn with equal chance: the gaps between drawn numbers are geometric, each from a
    hash of the seed, the column and its number, so any run draws the same pairs. Pairs are counted first, by masks.
    """
    total = pair_count(rows, names).first()[0]
    if total <= samples:
        return pairs(rows, names)
    chance = samples / total
    c = cells(rows.join(names, "name", "left_semi"))
    column = Window.partitionBy("block_id", "col").orderBy("row_idx")
    ranked = c.select("block_id", "col", F.row_number().over(column).cast("long").alias("r") - 1, F.struct("name", "pos").alias("p"))
    ranked = ranked.toDF("block_id", "col", "r", "p")
    k = c.groupBy("block_id", "col").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("block_id", "col", F.expr("k * (k - 1) div 2").alias("m"))
    # More gaps than a column can hold but for one chance in 1e16; they are added up until they leave it.
    most = F.ceil(F.col("m") * chance + 12 * F.sqrt(F.col("m") * chance) + 20).cast("int")
    uniform = lambda t: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "block_id", "col", t), 11).cast("double") + 0.5) / float(1 << 53)
    gap = lambda t: F.floor(F.log(uniform(t)) / F.lit(_log_rest(chance))).cast("long")
    start = F.struct(F.lit(-1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("drawn"))

    def step(acc: Column, t: Column) -> Column:
        at = acc["at"] + 1 + F.least(gap(t), F.col("m"))
        return F.when(acc["at"] >= F.col("m"), acc).otherwise(F.struct(at.alias("at"), F.when(at < F.col("m"), F.concat(acc["drawn"], F.array(at))).otherwise(acc["drawn"]).alias("drawn")))

    drawn = k.select("block_id", "col", F.explode(F.aggregate(F.sequence(F.lit(1), most), start, step)["drawn"]).alias("rank"))
    i, j = unranked(F.col("rank"))
    chosen = drawn.select("block_id", "col", i.alias("i"), j.alias("j"))
    one, two = (ranked.select("block_id", "col", F.col("r").alias(x), F.col("p").alias(p)) for x, p in (("i", "p1"), ("j", "p2")))
    return _ordered(chosen.join(one, ["block_id", "col", "i"]).join(two, ["block_id", "col", "j"]))


def _log_rest(chance: float) -> float:
    import math

    return math.log1p(-chance)


def found(a: DataFrame, b: DataFrame, near: int = 0) -> DataFrame:
    """Pairs of a with ``hit``: b has the pair, or for near one with one position equal and the other within near."""
    if not near:
        return a.join(b.withColumn("hit", F.lit(True)), PAIR, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    around = lambda c: F.explode(F.sequence(F.col(c) - near, F.col(c) + near)).alias(c)
    wide = a.select("*", F.struct(*PAIR).alias("own"))
    one = wide.select("own", "seq1", "pos1", "seq2", around("pos2")).join(b, PAIR).select("own")
    two = wide.select("own", "seq1", around("pos1"), "seq2", "pos2").join(b, PAIR).select("own")
    hits = one.union(two).distinct().select("own.*").withColumn("hit", F.lit(True))
    return a.join(hits, PAIR, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def found_among(p: DataFrame, rows: DataFrame, near: int = 0) -> DataFrame:
    """As ``found`` in the pairs of these rows, none of which is made: both positions of a pair are looked up among the
    rows' cells and must meet in a column. The cost grows with the pairs asked for, however many rows a column has."""
    c = cells(rows)
    one, two = (c.select("block_id", "col", F.col("row_idx").alias(f"r{k}"), F.col("name").alias(f"seq{k}"), F.col("pos").alias(f"at{k}")) for k in (1, 2))
    own = p.select("seq1", "seq2", F.struct(*PAIR).alias("own"), F.col("pos1").alias("at1"), F.col("pos2").alias("at2"))
    if near:
        around = lambda c: F.explode(F.sequence(F.col(c) - near, F.col(c) + near)).alias(c)
        own = own.select("seq1", "seq2", "own", "at1", around("at2")).union(own.select("seq1", "seq2", "own", around("at1"), "at2")).distinct()
    met = own.join(one, ["seq1", "at1"]).join(two, ["seq2", "at2", "block_id", "col"]).where("r1 <> r2")
    hits = met.select("own").distinct().select("own.*").withColumn("hit", F.lit(True))
    return p.join(hits, PAIR, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def regions(p: DataFrame, intervals: DataFrame) -> DataFrame:
    """``region`` of each pair: both, A (only the first position inside), B or neither."""
    for k in (1, 2):
        ends = p.select(f"seq{k}", f"pos{k}").distinct()
        p = p.join(in_intervals(ends, intervals, f"seq{k}", f"pos{k}").withColumn(f"in{k}", F.lit(True)), [f"seq{k}", f"pos{k}"], "left")
    a, b = F.col("in1").isNotNull(), F.col("in2").isNotNull()
    return p.withColumn("region", F.when(a & b, "both").when(a, "A").when(b, "B").otherwise("neither")).drop("in1", "in2")


def totals(p: DataFrame) -> DataFrame:
    """(seq1, seq2, total, hits) and, with regions, both counts for each region."""
    count = lambda c: F.sum(c.cast("long")).cast("long")
    more = []
    if "region" in p.columns:
        for r in ("both", "A", "B", "neither"):
            more += [count(F.col("region") == r).alias(f"total_{r}"), count((F.col("region") == r) & F.col("hit")).alias(f"hits_{r}")]
    return p.groupBy("seq1", "seq2").agg(F.count(F.lit(1)).alias("total"), count(F.col("hit")).alias("hits"), *more)


def rollup(t: DataFrame) -> DataFrame:
    """Totals of all pairs, of pairs within one sequence, and of every name on either side (a pair counts for both)."""
    sums = [F.sum(c).cast("long").alias(c) for c in t.columns if c not in ("seq1", "seq2")]
    every = t.agg(*sums).select(F.lit("aggregate").alias("seq1"), F.lit("aggregate").alias("seq2"), "*")
    own = t.where("seq1 = seq2").agg(*sums).where("total IS NOT NULL").select(F.lit("self").alias("seq1"), F.lit("self").alias("seq2"), "*")
    names = t.withColumn("name", F.explode(F.array_distinct(F.array("seq1", "seq2")))).groupBy("name").agg(*sums).select(F.col("name").alias("seq1"), F.lit("aggregate").alias("seq2"), *[c for c in t.columns if c not in ("seq1", "seq2")])
    return every.unionByName(own).unionByName(names)


def wiggle_pairs(lengths: DataFrame, patterns: list[tuple[str, str]], start: int = 0, stop: int = 0) -> DataFrame:
    """(reference, partner, start, length) of every two names that match both patterns of a pair, from (name, source_length).

    Names meet by the number of the pair whose pattern they match. Without a stop the region is the whole reference.
    """
    side = lambda k: F.explode(F.filter(F.array(*[F.when(X.wildcard(F.col("name"), p[k]), F.lit(i)) for i, p in enumerate(patterns)]), lambda x: x.isNotNull())).alias("pair")
    length = F.lit(1 + stop - start).cast("long") if stop else F.col("source_length")
    one, two = lengths.select(F.col("name").alias("reference"), length.alias("length"), side(0)), lengths.select(F.col("name").alias("partner"), side(1))
    return one.join(two, "pair").select("reference", "partner", F.lit(start).cast("long").alias("start"), "length").distinct()


def wiggles(ab: DataFrame, ba: DataFrame, regions_: DataFrame, width: int) -> DataFrame:
    """(reference, partner, bin, present_ab, absent_ab, present_ba, absent_ba) for every bin of the pairs of ``wiggle_pairs``.

    ab: tested pairs of the first alignment with ``hit``, ba: those of the second. A pair is counted at the place of its
    reference; where both orders of its names are wanted, at that of its first name.
    """
    want = F.broadcast(regions_)
    own = regions_.select(F.col("reference").alias("seq1"), F.col("partner").alias("seq2"), F.lit(1).alias("first")).distinct()
    parts = []
    for direction, tested in (("ab", ab), ("ba", ba)):
        known = tested.join(F.broadcast(own), ["seq1", "seq2"], "left")
        as_first = known.where("first = 1").select(F.col("seq1").alias("reference"), F.col("seq2").alias("partner"), F.col("pos1").alias("pos"), "hit")
        as_second = known.where("first IS NULL").select(F.col("seq2").alias("reference"), F.col("seq1").alias("partner"), F.col("pos2").alias("pos"), "hit")
        inside = as_first.unionByName(as_second).join(want, ["reference", "partner"]).where("pos >= start AND pos < start + length")
        parts.append(inside.select("reference", "partner", F.floor((F.col("pos") - F.col("start")) / width).cast("long").alias("bin"), *[F.lit(int(d == direction)).alias(d) for d in ("ab", "ba")], F.col("hit").cast("long").alias("hit")))
    counts = [F.sum(F.col(d) * (F.col("hit") if kind == "present" else 1 - F.col("hit"))).cast("long").alias(f"{kind}_{d}") for d in ("ab", "ba") for kind in ("present", "absent")]
    hits = parts[0].unionByName(parts[1]).groupBy("reference", "partner", "bin").agg(*counts)
    grid = regions_.select("reference", "partner", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / width).cast("long") - 1)).alias("bin"))
    return grid.join(hits, ["reference", "partner", "bin"], "left").na.fill(0)


SIDE = 4  # bits of a place inside a tile: a tile is 16 places of one sequence by 16 of another, a bit for each pair
WORDS = range(1 << (2 * SIDE - 6))  # longs of a tile, four places of the first sequence in each


def numbered(names: DataFrame) -> DataFrame:
    """(name, k): the names in order, stored, so that their size tells whether they are sent to the rows."""
    return stored(names.select("name").distinct().select("name", F.row_number().over(Window.orderBy("name")).cast("long").alias("k")))


def _places(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(k1, pos1, k2, pos2) of every aligned pair, the smaller first, as often as it is aligned."""
    small, crowded = coverage._split(rows.join(names, "name"))
    keep, both = ["k", "first", "sign", "mask"], None
    for part, one in coverage.narrow(small):
        pair = coverage.met(coverage.strips(part, "k", one=one), keep, keep, "own.row_idx < other.row_idx")
        met = pair.select("k", coverage.place("first", "sign", "mask").alias("pos"), "o_k", coverage.place("o_first", "o_sign", "o_mask").alias("o_pos"))
        both = met if both is None else both.unionByName(met)
    if crowded is not None:
        c = cells(crowded.drop("name").withColumnRenamed("k", "name"))
        one, two = (c.select("block_id", "col", F.col("row_idx").alias(f"r{x}"), F.col("name").alias(f"{x}k"), F.col("pos").alias(f"{x}pos")) for x in ("", "o_"))
        both = both.unionByName(one.hint("merge").join(two, ["block_id", "col"]).where("r < ro_").select("k", "pos", "o_k", "o_pos"))
    turned = "k > o_k OR (k = o_k AND pos > o_pos)"
    either = lambda x, y: F.expr(f"CASE WHEN {turned} THEN {y} ELSE {x} END")
    return both.select(either("k", "o_k").alias("k1"), either("pos", "o_pos").alias("pos1"), either("o_k", "k").alias("k2"), either("o_pos", "pos").alias("pos2"))


def tiles(a: DataFrame, b: DataFrame, names: DataFrame, near: int = 0) -> DataFrame:
    """(k1, t1, k2, t2, a0.., b0..) and for near (na0.., nb0..): the pairs of both alignments as bits of tiles of places.

    Bits are joined where the blocks are, so a pair that occurs in many blocks is moved once for many, and the pairs of
    both alignments meet in the same row. For near, n has the pairs with one position equal and the other within near.
    """
    size = 1 << SIDE
    both = _places(a, names).withColumn("s", F.lit(0)).unionByName(_places(b, names).withColumn("s", F.lit(1)))
    at = F.expr(f"(pos1 & {size - 1}) * {size} + (pos2 & {size - 1})").cast("int")
    cut = both.withColumn("at", at).select("k1", F.shiftright("pos1", SIDE).alias("t1"), "k2", F.shiftright("pos2", SIDE).alias("t2"), "s", F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, at & 63)").alias("bit"))
    word = lambda k, w: F.coalesce(F.bit_or(F.when((F.col("s") == k) & (F.col("word") == w), F.col("bit"))), F.lit(0).cast("long"))
    t = cut.groupBy("k1", "t1", "k2", "t2").agg(*[word(k, w).alias(f"{side}{w}") for k, side in enumerate("ab") for w in WORDS])
    return _widened(t, near) if near else t


def _widened(t: DataFrame, near: int) -> DataFrame:
    """Tiles with na0.., nb0..: their bits moved by up to ``near`` places along either side, where they meet the next tiles' too.

    Whole words are moved: a place of the first sequence is a quarter of a word, one of the second a bit in each quarter.
    """
    size, quarters = 1 << SIDE, 4
    moved = []
    for by in (d for k in range(1, near + 1) for d in (k, -k)):
        for over in sorted({by // size, -(-by // size)}):
            step = by - over * size  # what comes into the tile ``over`` tiles on
            moved.append(((over, 0), [(side, w, _down(f"{side}", w, step, quarters)) for side in "ab" for w in WORDS]))
            mask = sum(1 << j for j in range(size) if 0 <= j + step < size)
            moved.append(((0, over), [(side, w, _along(f"{side}{w}", step, mask)) for side in "ab" for w in WORDS]))
    zero, keep = [f"{side}{w}" for side in "ab" for w in WORDS], ["k1", "t1", "k2", "t2"]
    parts = [F.struct(F.lit(0).alias("d1"), F.lit(0).alias("d2"), *[F.col(c).alias(c) for c in zero], *[F.col(c).alias(f"n{c}") for c in zero])]
    for (d1, d2), words in moved:
        parts.append(F.struct(F.lit(d1).alias("d1"), F.lit(d2).alias("d2"), *[F.lit(0).cast("long").alias(c) for c in zero], *[F.expr(e).alias(f"n{side}{w}") for side, w, e in words]))
    some = " OR ".join(f"x.n{c} <> 0" for c in zero)
    each = t.select(*keep, F.explode(F.array(*parts)).alias("x")).where(some)
    each = each.select("k1", (F.col("t1") + F.col("x.d1")).alias("t1"), "k2", (F.col("t2") + F.col("x.d2")).alias("t2"), *[f"x.{c}" for c in zero], *[f"x.n{c}" for c in zero])
    return each.groupBy(*keep).agg(*[F.bit_or(c).alias(c) for c in [*zero, *[f"n{c}" for c in zero]]])


def _down(side: str, w: int, step: int, quarters: int) -> str:
    """Word ``w`` of a tile whose places of the first sequence are moved by ``step``."""
    bits, out = 64 // quarters, []
    for q in range(quarters):
        was = w * quarters + q - step
        if 0 <= was < 1 << SIDE:
            out.append(f"shiftleft(shiftrightunsigned({side}{was // quarters}, {bits * (was % quarters)}) & {(1 << bits) - 1}L, {bits * q})")
    return " | ".join(out) or "0L"


def _along(word: str, step: int, mask: int) -> str:
    """A word whose places of the second sequence are moved by ``step``; those of ``mask`` stay inside."""
    if not mask:
        return "0L"
    every = sum(mask << (1 << SIDE) * q for q in range(4))
    held = f"({word} & {every - (1 << 64) if every >> 63 else every}L)"
    return f"shiftleft({held}, {step})" if step >= 0 else f"shiftrightunsigned({held}, {-step})"


DIRECTIONS = {"AB": ("a", "b"), "BA": ("b", "a")}


def _inside(intervals: DataFrame, names: DataFrame) -> DataFrame:
    """(k, t, m): the places of a tile's side that lie in an interval, as bits."""
    size = 1 << SIDE
    spread = intervals.where("stop > start").join(names, "name").select("k", "start", "stop", F.explode(F.sequence(F.shiftright("start", SIDE), F.shiftright(F.col("stop") - 1, SIDE))).alias("t"))
    low, high = F.greatest(F.col("start") - F.col("t") * size, F.lit(0)), F.least(F.col("stop") - F.col("t") * size, F.lit(size))
    ends = spread.select("k", "t", low.cast("int").alias("low"), high.cast("int").alias("high"))
    return ends.groupBy("k", "t").agg(F.bit_or(F.expr("shiftleft(1L, high) - shiftleft(1L, low)")).alias("m"))


def counted(t: DataFrame, names: DataFrame, near: int = 0, intervals: DataFrame | None = None) -> DataFrame:
    """(direction, seq1, seq2, total, hits) and, with intervals, both counts for each region: ``totals`` of all pairs of both
    directions, counted as bits. The result is stored: it has a row for each two names."""
    regions_ = {"": lambda w, x: x}
    if intervals is not None:
        held = stored(_inside(intervals, names))
        for k in (1, 2):
            side = held.select(F.col("k").alias(f"k{k}"), F.col("t").alias(f"t{k}"), F.col("m").alias(f"m{k}"))
            t = t.join(side, [f"k{k}", f"t{k}"], "left").withColumn(f"m{k}", F.coalesce(f"m{k}", F.lit(0)).cast("long"))
        rows_ = lambda w: " | ".join(f"CASE WHEN shiftright(m1, {4 * w + j}) & 1 = 1 THEN shiftleft(65535L, {16 * j}) ELSE 0L END" for j in range(4))
        t = t.select("*", F.expr("m2 | shiftleft(m2, 16) | shiftleft(m2, 32) | shiftleft(m2, 48)").alias("c"), *[F.expr(rows_(w)).alias(f"r{w}") for w in WORDS])
        regions_ |= {"_both": lambda w, x: f"{x} & r{w} & c", "_A": lambda w, x: f"{x} & r{w} & ~c", "_B": lambda w, x: f"{x} & ~r{w} & c", "_neither": lambda w, x: f"{x} & ~r{w} & ~c"}
    columns = []
    for d, (x, y) in DIRECTIONS.items():
        other = f"n{y}" if near else y
        for region, cut in regions_.items():
            for kind, pair in (("total", lambda w: f"{x}{w}"), ("hits", lambda w: f"({x}{w} & {other}{w})")):
                each = " + ".join(f"bit_count({cut(w, pair(w))})" for w in WORDS)
                columns.append(F.sum(F.expr(each).cast("long")).alias(f"{d}_{kind}{region}"))
    sums = t.groupBy("k1", "k2").agg(*columns)
    fields = [f"{kind}{region}" for region in regions_ for kind in ("total", "hits")]
    each = sums.select("k1", "k2", F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), *[F.col(f"{d}_{f}").alias(f) for f in fields]) for d in DIRECTIONS])).alias("x")).select("k1", "k2", "x.*").where("total > 0")
    one, two = (names.select(F.col("k").alias(f"k{k}"), F.col("name").alias(f"seq{k}")) for k in (1, 2))
    return stored(each.join(one, "k1").join(two, "k2").select("direction", "seq1", "seq2", *fields))


def expanded(t: DataFrame, names: DataFrame, direction: str, near: int = 0) -> DataFrame:
    """(seq1, pos1, seq2, pos2, hit): the pairs of tiles one by one."""
    x, y = DIRECTIONS[direction]
    other = f"n{y}" if near else y
    words = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.col(f"{x}{w}").alias("x"), F.col(f"{other}{w}").alias("y")) for w in WORDS])).alias("v")
    one, two = (names.select(F.col("k").alias(f"k{k}"), F.col("name").alias(f"seq{k}")) for k in (1, 2))
    named = t.join(one, "k1").join(two, "k2").select("seq1", "t1", "seq2", "t2", words).where("v.x <> 0")
    bit = named.select("seq1", "t1", "seq2", "t2", "v", F.explode(F.array(*[F.lit(i) for i in range(64)])).alias("i")).where("shiftright(v.x, i) & 1 = 1")
    at = "v.w * 64 + i"
    return bit.select("seq1", F.expr(f"shiftleft(t1, {SIDE}) + shiftright({at}, {SIDE})").alias("pos1"), "seq2", F.expr(f"shiftleft(t2, {SIDE}) + (({at}) & {(1 << SIDE) - 1})").alias("pos2"), F.expr("shiftright(v.y, i) & 1 = 1").alias("hit"))


def tested(a: DataFrame, b: DataFrame, near: int = 0, samples: int | None = None, seed: int = 0, names: DataFrame | None = None, among: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs of a with ``hit`` in b, and those of b in a. If ``among`` (reference, partner) is given, an exhaustive comparison makes the pairs of these names alone."""
    names = legit_names(a, b) if names is None else names
    if samples is not None:
        return tuple(found_among(sampled_pairs(x, names, samples, seed), y, near) for x, y in ((a, b), (b, a)))
    if among is not None:
        names = names.join(among.select(F.explode(F.array("reference", "partner")).alias("name")).distinct(), "name", "left_semi")
    k = numbered(names)
    t = tiles(a, b, k, near)
    if among is not None:
        one, two = (k.select(F.col("name").alias(n), F.col("k").alias(x)) for n, x in (("reference", "x"), ("partner", "y")))
        wanted = among.join(one, "reference").join(two, "partner").select(F.least("x", "y").alias("k1"), F.greatest("x", "y").alias("k2")).distinct()
        t = t.join(stored(wanted), ["k1", "k2"], "left_semi")
    t = stored(t)
    return tuple(expanded(t, k, d, near) for d in DIRECTIONS)


def compare(a: DataFrame, b: DataFrame, near: int = 0, samples: int | None = None, intervals: DataFrame | None = None, seed: int = 0, names: DataFrame | None = None) -> DataFrame:
    """Totals for both directions (``direction``: AB pairs of a tested in b, BA the reverse), roll-ups included."""
    out = []
    if samples is None:
        k = numbered(legit_names(a, b) if names is None else names)
        every = counted(tiles(a, b, k, near), k, near, intervals)
    else:
        sampled = tested(a, b, near, samples, seed, names)
    for i, direction in enumerate(DIRECTIONS):
        if samples is None:
            t = every.where(F.col("direction") == direction).drop("direction")
        else:
            t = totals(regions(sampled[i], intervals) if intervals is not None else sampled[i])
        out.append(t.unionByName(rollup(t)).withColumn("direction", F.lit(direction)))
    return out[0].unionByName(out[1])


# The report's elements.
TESTS = ("homologyTests", "aggregateResults", "homologyPairTests", "homologyTest", "singleHomologyTests", "singleHomologyTest")
WIGGLES = {"present_ab": "presentMaf1ToMaf2", "present_ba": "presentMaf2ToMaf1", "absent_ab": "absentMaf1ToMaf2", "absent_ba": "absentMaf2ToMaf1"}


def xml(result: DataFrame, files: tuple[str, str] = ("a", "b"), bins: DataFrame | None = None, regions_: DataFrame | None = None, width: int = 1, **attributes: object) -> str:
    """Report of a comparison: for each direction its aggregate, then every pair of names, nested; then the wiggles.

    Its rows are aggregates, one for each pair of names (and one for each wiggle), read one after the other.
    """
    from xml.sax.saxutils import quoteattr

    tests, aggregates, pair_tests, test, singles, single = TESTS
    given = lambda **a: "".join(f" {k}={quoteattr(str(v))}" for k, v in a.items())
    out = [f"<alignmentComparisons{given(**attributes)}>"]
    tags = [("all", "total", "hits"), *((r, f"total_{r}", f"hits_{r}") for r in REGIONS if f"total_{r}" in result.columns)]

    def counts(r, depth: int) -> list[str]:  # noqa: ANN001
        lines = []
        for tag, total, hits in tags:
            n, true = r[total] or 0, r[hits] or 0
            lines.append("\t" * (depth + 1) + f"<{tag}" + given(totalTests=n, totalTrue=true, totalFalse=n - true, average=f"{true / n if n else 0:f}") + "/>")
        return ["\t" * depth + f"<{aggregates}>", *lines, "\t" * depth + f"</{aggregates}>"]

    for direction, (one, two) in zip(("AB", "BA"), (files, files[::-1]), strict=True):
        own = result.where(F.col("direction") == direction)
        whole = own.where("seq1 = 'aggregate' AND seq2 = 'aggregate'").first()
        out += [f"\t<{tests}{given(fileA=one, fileB=two)}>", *counts(whole, 2), f"\t\t<{pair_tests}>"]
        for r in own.orderBy(F.desc("seq1"), F.desc("seq2")).toLocalIterator():
            names = given(sequenceA=r["seq1"], sequenceB=r["seq2"])
            out += [f"\t\t\t<{test}{names}>", *counts(r, 4), f"\t\t\t\t<{singles}>", f"\t\t\t\t\t<{single}{names}>", *counts(r, 6)]
            out += [f"\t\t\t\t\t</{single}>", f"\t\t\t\t</{singles}>", f"\t\t\t</{test}>"]
        out += [f"\t\t</{pair_tests}>", f"\t</{tests}>"]
    out.append("\t<wigglePairs>")
    if bins is not None:
        listed = bins.groupBy("reference", "partner").agg(F.array_sort(F.collect_list(F.struct("bin", *WIGGLES))).alias("bins"))
        for r in listed.join(regions_, ["reference", "partner"]).orderBy("reference", "partner").toLocalIterator():
            head = given(reference=r["reference"], partner=r["partner"], referenceStart=r["start"], referenceLength=r["length"], numberOfBins=len(r["bins"]), binLength=width)
            out += [f"\t\t<wigglePair{head}>", *[f"\t\t\t<{tag}>" + ",".join(str(b[c]) for b in r["bins"]) + f"</{tag}>" for c, tag in WIGGLES.items()], "\t\t</wigglePair>"]
    return "\n".join([*out, "\t</wigglePairs>", "</alignmentComparisons>"])
