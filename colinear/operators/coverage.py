"""Statistics, pair coverage, genome coverage and pair counts.

Pairs of rows are compared by gap masks: chunks of 62 columns as bits of a long, so a pair costs a few machine words
instead of a join of cells. Positions are exploded only where bins, regions or depths need them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.maf import cells
from ..sources.shared import stored

CHUNK = 62
TILE = 16  # places whose counts are one row
LARGE = 64  # rows of a block from which columns are counted by name instead of pairing rows


def bits(chunk: Column) -> Column:
    """Bit i from the left: column i holds a base."""
    return F.conv(F.regexp_replace(F.translate(chunk, "-", "0"), "[^0]", "1"), 2, 10).cast("long")


def masks(rows: DataFrame, *keep: str) -> DataFrame:
    """(block_id, row_idx, keep..., chunk, mask) for each 62 columns of each row; the last chunk is filled with gaps."""
    parts = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / CHUNK).cast("int")), lambda i: F.substring(F.col("text"), i * CHUNK + 1, F.lit(CHUNK))))
    return rows.where(F.length("text") > 0).select("block_id", "row_idx", *keep, parts.alias("chunk", "piece")).select("block_id", "row_idx", *keep, "chunk", bits(F.rpad("piece", CHUNK, "-")).alias("mask"))


def narrow(rows: DataFrame) -> list[tuple[DataFrame, bool]]:
    """(rows, one): the rows of blocks of CHUNK columns at most, whose strips are one to a row, and those of wider ones if there are any.

    Strips that are one to a row lie as their rows do, so rows that are dealt and sorted by block are not sorted again.
    """
    wide = rows.where(F.length("text") > CHUNK).select("block_id")
    if not wide.limit(1).count():
        return [(rows, True)]
    return [(rows.join(wide, "block_id", "left_anti"), True), (rows.join(wide, "block_id", "left_semi"), False)]


def strips(rows: DataFrame, *keep: str, one: bool = False) -> DataFrame:
    """(block_id, row_idx, keep..., chunk, piece, mask, first, sign): ``masks`` with the place of a chunk's first base and the step to the next.

    If ``one``, texts are of one chunk and there is no column for it."""
    sign = X.sign(F.col("strand")).cast("long")
    start = X.pos_start(F.col("start"), F.col("strand"), F.col("source_length"))
    if one:
        each = rows.where(F.length("text") > 0).select("block_id", "row_idx", *keep, F.rpad("text", CHUNK, "-").alias("piece"), start.cast("long").alias("first"), sign.alias("sign"))
        return each.select("block_id", "row_idx", *keep, "piece", bits(F.col("piece")).alias("mask"), "first", "sign")
    count = F.floor((F.length("text") - 1) / CHUNK).cast("int")
    piece = F.transform(F.sequence(F.lit(0), count), lambda i: F.rpad(F.substring(F.col("text"), i * CHUNK + 1, F.lit(CHUNK)), CHUNK, "-"))
    listed = F.transform("pieces", lambda x: F.struct(x.alias("piece"), bits(x).alias("mask")))
    none = F.struct(F.lit(0).cast("long").alias("n"), F.array().cast("array<bigint>").alias("at"))
    seen = F.aggregate("listed", none, lambda acc, x: F.struct((acc["n"] + F.bit_count(x["mask"])).alias("n"), F.concat(acc["at"], F.array(acc["n"])).alias("at")))["at"]
    each = rows.where(F.length("text") > 0).withColumn("pieces", piece).withColumn("listed", listed).withColumn("seen", seen)
    out = each.select("block_id", "row_idx", *keep, start.alias("from"), sign.alias("sign"), F.posexplode(F.arrays_zip("listed", "seen")).alias("chunk", "x"))
    return out.select("block_id", "row_idx", *keep, "chunk", F.col("x.listed.piece").alias("piece"), F.col("x.listed.mask").alias("mask"), (F.col("from") + F.col("sign") * F.col("x.seen")).cast("long").alias("first"), "sign")


# Steps (v, s) by which the columns without a base are left out of bits: those of v move by s to the right. ``odd`` has the bits that
# stand left of gaps odd in number; the gaps are halved at each step. One expression: as columns they are too many for the optimizer.
STEPS = """aggregate(array(1, 2, 4, 8, 16, 32), named_struct('m', mask, 'g', shiftleft(~mask, 1), 'steps', cast(array() AS array<struct<v: bigint, s: int>>)),
 (acc, i) -> get(transform(array(aggregate(array(1, 2, 4, 8, 16, 32), acc.g, (x, k) -> x ^ shiftleft(x, k))), odd -> named_struct(
 'm', (acc.m ^ (odd & acc.m)) | shiftrightunsigned(odd & acc.m, i), 'g', acc.g & ~odd, 'steps', concat(acc.steps, array(named_struct('v', odd & acc.m, 's', i))))), 0)).steps"""
# The columns ``both`` of a strip as bits of its bases; the last base is bit 0.
SQUEEZED = "aggregate(own.steps, both, (x, step) -> (x & ~step.v) | shiftrightunsigned(x & step.v, step.s))"


def met_tiles(strips_: DataFrame, of: list[str], other: list[str], when: str, shared: str = "own.mask & other.mask") -> DataFrame:
    """(of..., o_other..., t, n0..n15): how many bases of the rows ``other`` share a column with each place of a row, by tiles of TILE places.

    Rows of a block meet as in ``met``, but no column becomes a row: columns are bits of the row's places, added up tile by tile.
    """
    keys = [c for c in ("block_id", "chunk") if c in strips_.columns]
    cols = list(dict.fromkeys(["row_idx", "mask", "first", "sign", *of]))
    named = [c for c in strips_.columns if re.search(rf"\bown\.{c}\b", shared) and c not in cols]
    others = list(dict.fromkeys(["row_idx", "mask", *other, *[c for c in strips_.columns if re.search(rf"\bother\.{c}\b", shared)]]))
    gathered = strips_.select(*keys, *dict.fromkeys([*cols, *named, *others])).withColumn("rows", F.collect_list(F.struct(*others)).over(Window.partitionBy(*keys)))
    # Places ascend with the bits on the - strand; on the + strand their complements do, and a tile's bits are turned.
    low = "CASE WHEN sign > 0 THEN ~(first + bit_count(mask) - 1) ELSE first - bit_count(mask) + 1 END"
    own = gathered.withColumn("steps", F.expr(STEPS)).withColumn("low", F.expr(low)).withColumn("turn", F.expr(f"CASE WHEN sign > 0 THEN {TILE - 1} ELSE 0 END"))
    pair = own.select(F.struct(*cols, *named, "low", "turn", "steps").alias("own"), F.explode("rows").alias("other")).where(when)
    bases = pair.withColumn("both", F.expr(shared)).where("both <> 0").withColumn("both", F.expr(SQUEEZED))
    every = F.explode(F.array(*[F.lit(i) for i in range(2 + (CHUNK - 2) // TILE)])).alias("q")
    flat = bases.select(*[F.col(f"own.{c}").alias(c) for c in of], *[F.col(f"other.{c}").alias(f"o_{c}") for c in other], F.col("own.low").alias("low"), F.col("own.turn").alias("turn"), "both", every)
    word = f"CASE WHEN q = 0 THEN shiftleft(both, cast(low & {TILE - 1} AS int)) WHEN {TILE} * q - (low & {TILE - 1}) < 64 THEN shiftrightunsigned(both, cast({TILE} * q - (low & {TILE - 1}) AS int)) ELSE 0L END & {(1 << TILE) - 1}L"
    cut = flat.withColumn("w", F.expr(word)).where("w <> 0").withColumn("t", F.expr("shiftright(low, 4) + q"))
    cut = cut.withColumn("t", F.expr("CASE WHEN turn = 0 THEN t ELSE ~t END"))
    return cut.groupBy(*of, *[f"o_{c}" for c in other], "t").agg(*[F.sum(F.expr(f"shiftright(w, {i} ^ turn) & 1")).alias(f"n{i}") for i in range(TILE)])


def letters(strips_: DataFrame) -> DataFrame:
    """Strips of upper-case texts with masks of what ``SAME`` compares: A, C, G and T (known, by the bits low and high) and what else is no N (rare)."""
    plain = strips_.withColumn("plain", F.regexp_replace("piece", "[^ACGTN-]", "N"))
    as_bits = lambda x: F.conv(x, 2, 10).cast("long")
    marks = {"known": "111100", "one": "010100", "two": "001100"}
    rare = F.when(F.col("plain") == F.col("piece"), F.lit(0).cast("long")).otherwise(as_bits(F.regexp_replace(F.regexp_replace("piece", "[ACGTN-]", "0"), "[^0]", "1")))
    return plain.withColumns({c: as_bits(F.translate("plain", "ACGTN-", m)) for c, m in marks.items()}).withColumn("rare", rare).drop("plain")


# The columns in which two strips have the same base; rare ones are compared as they stand.
SAME = """(own.known & other.known & ~(own.one ^ other.one) & ~(own.two ^ other.two)) | CASE WHEN own.rare & other.rare = 0 THEN 0L ELSE own.rare & other.rare
 & aggregate(sequence(1, {n}), 0L, (acc, i) -> shiftleft(acc, 1) | CASE WHEN substring(own.piece, i, 1) = substring(other.piece, i, 1) THEN 1L ELSE 0L END) END""".format(n=CHUNK)


def met(strips_: DataFrame, of: list[str], other: list[str], when: str | Column, shared: str = "own.mask & other.mask") -> DataFrame:
    """(of..., o_other..., both, bit): the columns that every two rows of a block share, one row for each of them.

    The rows of a block (LARGE at most) are gathered once as an array; nothing as large as the cells is moved.
    """
    keys = [c for c in ("block_id", "chunk") if c in strips_.columns]
    together = Window.partitionBy(*keys)
    cols, others = (list(dict.fromkeys(["row_idx", "mask", *c])) for c in (of, other))
    gathered = strips_.select(*keys, *dict.fromkeys([*cols, *others])).withColumn("rows", F.collect_list(F.struct(*others)).over(together))
    pair = gathered.select(F.struct(*cols).alias("own"), F.explode("rows").alias("other")).where(when).withColumn("both", F.expr(shared)).where("both <> 0")
    every = F.explode(F.array(*[F.lit(i) for i in range(CHUNK)])).alias("bit")
    flat = pair.select(*[F.col(f"own.{c}").alias(c) for c in of], *[F.col(f"other.{c}").alias(f"o_{c}") for c in other], "both", every)
    return flat.where(f"shiftright(both, {CHUNK - 1} - bit) & 1 = 1")


def place(first: str, sign: str, mask: str) -> Column:
    """The place of the base in column ``bit`` of a strip."""
    return F.expr(f"{first} + {sign} * bit_count(shiftright({mask}, {CHUNK} - bit))")


def file_stats(lines: DataFrame) -> DataFrame:
    """One row: lines by type, blocks, characters, degrees and areas over all of a file's lines."""
    t = lambda c: F.sum((F.col("type") == c).cast("long"))
    s = F.when(F.col("type") == "s", F.col("text"))
    block = lines.where("block_id > 0").groupBy("block_id").agg(
        *[t(c).alias(c) for c in "aseiq"], t("#").alias("comment"),
        F.sum(F.length(s)).alias("chars"), F.sum(X.bases(s)).alias("bases"), F.max(F.length(s)).alias("columns"), F.sum(F.when(F.col("type") == "s", F.col("length"))).alias("length"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return block.agg(
        F.count(F.lit(1)).alias("blocks"), *[total(c).alias(f"{n}_lines") for c, n in (("a", "a"), ("s", "s"), ("e", "e"), ("i", "i"), ("q", "q"), ("comment", "comment"))],
        total("bases").alias("base_chars"), (total("chars") - total("bases")).alias("gap_chars"), total("columns").alias("columns"),
        F.max(F.col("columns") * F.col("s")).cast("long").alias("max_area"), F.max("s").cast("long").alias("max_degree"), F.max("columns").cast("long").alias("max_text"),
        F.avg(F.col("columns") * F.col("s")).alias("avg_area"), F.avg("s").alias("avg_degree"), (F.sum("length") / F.sum("s")).alias("avg_length"),
    )


def bases_per_sequence(rows: DataFrame) -> DataFrame:
    """(name, bases, share): sums of the length field, with the share of the total."""
    each = rows.groupBy("name").agg(F.sum("length").cast("long").alias("bases"))
    total = F.broadcast(each.agg(F.sum("bases").alias("all_bases")))  # one row
    return each.join(total).select("name", "bases", (F.col("bases") / F.col("all_bases")).alias("share")).orderBy(F.desc("bases"), "name")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The rows of blocks of LARGE rows at most, and those of larger ones if a count of rows by block finds any."""
    large = rows.groupBy("block_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE).select("block_id")
    if not large.limit(1).count():
        return rows, None
    return rows.join(large, "block_id", "left_anti"), rows.join(large, "block_id", "left_semi")


def column_counts(rows: DataFrame, *keys: str) -> DataFrame:
    """(block_id, col, keys..., n): how many bases each column has for each value of the keys. Partially aggregated."""
    return cells(rows).groupBy("block_id", "col", *keys).agg(F.count(F.lit(1)).alias("n"))


def aligned_pairs(rows: DataFrame, seq1: str, seq2: str) -> DataFrame:
    """(name1, name2, aligned): columns where both rows have a base, over all pairs of rows of a block. A row can pair itself.

    Rows of a block of LARGE rows at most are paired by masks. In a larger block the bases of a column are first counted
    by name, and counts are paired, so the cost follows its names and not the square of its rows.
    """
    small, crowded = _split(rows.where(X.wildcard(F.col("name"), seq1) | X.wildcard(F.col("name"), seq2)))
    bits_ = masks(small, "name")
    one, two = (bits_.where(X.wildcard(F.col("name"), p)).select("block_id", "chunk", F.col("name").alias(f"name{k}"), F.col("mask").alias(f"m{k}")) for k, p in ((1, seq1), (2, seq2)))
    paired = one.hint("merge").join(two, ["block_id", "chunk"]).select("name1", "name2", F.expr("bit_count(m1 & m2)").cast("long").alias("n"))
    if crowded is not None:
        counts = column_counts(crowded, "name")
        one, two = (counts.where(X.wildcard(F.col("name"), p)).select("block_id", "col", F.col("name").alias(f"name{k}"), F.col("n").alias(f"n{k}")) for k, p in ((1, seq1), (2, seq2)))
        paired = paired.unionByName(one.hint("merge").join(two, ["block_id", "col"]).select("name1", "name2", (F.col("n1") * F.col("n2")).alias("n")))
    return paired.groupBy("name1", "name2").agg(F.sum("n").cast("long").alias("aligned"))


def pair_coverage(rows: DataFrame, seq1: str, seq2: str) -> DataFrame:
    """(side, name, source_length, observed, aligned, coverage, observed_coverage) for the names of both patterns."""
    pairs = aligned_pairs(rows, seq1, seq2)
    out = None
    for side, pattern in ((1, seq1), (2, seq2)):
        seen = rows.where(X.wildcard(F.col("name"), pattern)).groupBy("name").agg(F.max("source_length").cast("long").alias("source_length"), F.sum("length").cast("long").alias("observed"))
        hit = pairs.groupBy(F.col(f"name{side}").alias("name")).agg(F.sum("aligned").alias("aligned"))
        aligned = F.coalesce("aligned", F.lit(0)).cast("long")
        ratio = lambda by: F.coalesce(aligned.cast("double") / F.nullif(F.col(by), F.lit(0)), F.lit(0.0))
        part = seen.join(hit, "name", "left").select(F.lit(side).alias("side"), "name", "source_length", "observed", aligned.alias("aligned"), ratio("source_length").alias("coverage"), ratio("observed").alias("observed_coverage"))
        out = part if out is None else out.unionByName(part)
    return out


def aligned_places(rows: DataFrame, seq1: str, seq2: str) -> DataFrame:
    """(name1, pos1, name2, n): how many bases of rows of seq2 are aligned with each base of seq1's rows, in one or more rows a place.

    In blocks of over LARGE rows the bases of seq2's rows are counted by column and name first.
    """
    small, crowded = _split(rows.where(X.wildcard(F.col("name"), seq1) | X.wildcard(F.col("name"), seq2)))
    out = None
    for part, one in narrow(small):
        pair = met(strips(part, "name", one=one), ["name", "first", "sign", "mask"], ["name"], X.wildcard(F.col("own.name"), seq1) & X.wildcard(F.col("other.name"), seq2))
        places = pair.select(F.col("name").alias("name1"), place("first", "sign", "mask").alias("pos1"), F.col("o_name").alias("name2"), F.lit(1).cast("long").alias("n"))
        out = places if out is None else out.unionByName(places)
    if crowded is not None:
        one = cells(crowded.where(X.wildcard(F.col("name"), seq1))).select("block_id", "col", F.col("name").alias("name1"), F.col("pos").alias("pos1"))
        two = column_counts(crowded.where(X.wildcard(F.col("name"), seq2)), "name").withColumnRenamed("name", "name2")
        out = out.unionByName(one.hint("merge").join(two, ["block_id", "col"]).select("name1", "pos1", "name2", "n"))
    return out


def pair_bins(rows: DataFrame, seq1: str, seq2: str, start: int, end: int, width: int = 1000) -> DataFrame:
    """(bin, bin_start, value): aligned columns by closed bins of seq1's places, over the bin width; empty bins too."""
    if seq1.endswith("*"):
        raise ValueError("seq1 must be one sequence")
    n = -(-(end + 1 - start) // width)
    hits = aligned_places(rows, seq1, seq2).where(F.col("pos1").between(start, end)).groupBy(F.floor((F.col("pos1") - start) / width).cast("long").alias("bin")).agg(F.sum("n").alias("n"))
    grid = rows.sparkSession.range(n).withColumnRenamed("id", "bin")
    return grid.join(hits, "bin", "left").select("bin", (F.col("bin") * width + start).alias("bin_start"), (F.coalesce("n", F.lit(0)) / F.lit(float(width))).alias("value"))


def in_intervals(points: DataFrame, intervals: DataFrame, name: str = "name", pos: str = "pos", tile: int = 10_000) -> DataFrame:
    """Points inside an interval (start <= pos < stop): an equi-join on the name and a tile of positions, so no name is a scan.

    Intervals are stored, so that their size tells whether they are sent to the points; only many have the points dealt out.
    """
    spread = stored(intervals.where("stop > start").select(F.col("name").alias("_n"), F.col("start").alias("_s"), F.col("stop").alias("_e"), F.explode(F.sequence(F.floor(F.col("start") / tile), F.floor((F.col("stop") - 1) / tile))).alias("_t")))
    cond = (F.col(name) == F.col("_n")) & (F.floor(F.col(pos) / tile) == F.col("_t")) & (F.col(pos) >= F.col("_s")) & (F.col(pos) < F.col("_e"))
    return points.join(spread, cond, "left_semi")


def pair_regions(rows: DataFrame, seq1: str, seq2: str, intervals: DataFrame) -> DataFrame:
    """(side, name, in_region, out_region): aligned columns whose place in a name of that side lies in its intervals, or not."""
    out = None
    for side, (own, other) in enumerate(((seq1, seq2), (seq2, seq1)), 1):
        places = aligned_places(rows, own, other).groupBy("name1", "pos1").agg(F.sum("n").alias("n"))
        inside = in_intervals(places, intervals, "name1", "pos1").groupBy("name1").agg(F.sum("n").alias("in_region"))
        both = places.groupBy("name1").agg(F.sum("n").alias("n")).join(inside, "name1", "left").select(F.lit(side).alias("side"), F.col("name1").alias("name"), F.coalesce("in_region", F.lit(0)).cast("long").alias("in_region"), "n")
        part = both.select("side", "name", "in_region", (F.col("n") - F.col("in_region")).cast("long").alias("out_region"))
        out = part if out is None else out.unionByName(part)
    return out


def genome_lengths(rows: DataFrame, by_species: bool = True) -> DataFrame:
    key = X.species(F.col("name")) if by_species else F.col("name")
    return rows.select(key.alias("genome"), "name", "source_length").distinct().groupBy("genome").agg(F.sum("source_length").cast("long").alias("total"))


def coverage(rows: DataFrame, n_max: int = 1, identity: bool = False, by_species: bool = True) -> DataFrame:
    """(query, target, n, coverage): the share of the query genome's places with n or more aligned target bases.

    Every genome is a query at once. Rows of blocks of LARGE rows at most meet by masks, and their columns are counted by
    tiles of places before they are moved. In larger blocks the bases of a column are counted by genome (and base)
    before they meet the query's cells, so a column of k rows costs k times its genomes; a row is taken off its own
    genome's count. Depths stop at 127.
    """
    genome = X.species(F.col("name")) if by_species else F.col("name")
    by = ["block_id", "col", "base"] if identity else ["block_id", "col"]
    small, crowded = _split(rows)
    counts = None
    for part, one in narrow(small):
        strip = strips(part.select("block_id", "row_idx", "name", "start", "strand", "source_length", (F.upper("text") if identity else F.col("text")).alias("text"), genome.alias("genome")), "name", "genome", one=one)
        tiles = met_tiles(letters(strip) if identity else strip, ["name"], ["genome"], "own.row_idx <> other.row_idx", *([SAME] if identity else []))
        counts = tiles if counts is None else counts.unionByName(tiles)
    lane = F.explode(F.array(*[F.struct((F.col("t") * TILE + i).alias("qpos"), F.col(f"n{i}").alias("n")) for i in range(TILE)])).alias("x")
    found = counts.select(F.col("o_genome").alias("target"), F.col("name").alias("qname"), lane).select("target", "qname", "x.qpos", "x.n").where("n > 0")
    if crowded is not None:
        c = cells(crowded).withColumns({"genome": genome, "base": F.upper("base")})
        c = c.where("base <> 'N'") if identity else c
        q = c.select(*by, F.col("genome").alias("query"), F.col("name").alias("qname"), F.col("pos").alias("qpos"))
        t = c.groupBy(*by, F.col("genome").alias("target")).agg(F.count(F.lit(1)).alias("n"))
        others = F.col("n") - (F.col("query") == F.col("target")).cast("long")
        found = found.unionByName(q.hint("merge").join(t, by).select("target", "qname", "qpos", others.alias("n")).where("n > 0"))
    # Places are counted where their blocks are, by tiles, before anything moves; few rows of a place are left.
    depth = found.groupBy("target", "qname", "qpos").agg(F.least(F.sum("n"), F.lit(127)).alias("depth"))
    query = X.species(F.col("qname")) if by_species else F.col("qname")
    levels = depth.select(query.alias("query"), "target", F.explode(F.sequence(F.lit(1).cast("long"), F.least("depth", F.lit(n_max)))).alias("n")).groupBy("query", "target", "n").agg(F.count(F.lit(1)).alias("places"))
    lengths = genome_lengths(rows, by_species)
    return levels.join(lengths.withColumnRenamed("genome", "query"), "query").select("query", "target", F.col("n").cast("long").alias("n"), (F.col("places").cast("double") / F.col("total")).alias("coverage"))


def pair_count(rows: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """One row: pairs of bases over all columns, of the given names if any. A sum over columns of k(k-1)/2.

    The bases of CHUNK columns are added up at once, a counter for each column, as sums of bits of the rows' masks.
    """
    own = rows if names is None else rows.join(names.select("name").distinct(), "name", "left_semi")
    bit = lambda i: F.sum(F.shiftright("mask", CHUNK - 1 - i).bitwiseAND(F.lit(1).cast("long")))
    counts = masks(own).groupBy("block_id", "chunk").agg(*[bit(i).alias(f"k{i}") for i in range(CHUNK)])
    pairs = sum((F.expr(f"k{i} * (k{i} - 1) div 2") for i in range(CHUNK)), F.lit(0))
    return counts.agg(F.coalesce(F.sum(pairs), F.lit(0)).cast("long").alias("pairs"))
