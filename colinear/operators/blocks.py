"""Block-local operators over lines or rows: filters, orders, strands, lookup, extraction, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.maf import cells
from ..sources.shared import stored
from .coverage import _split, narrow


def block():  # noqa: ANN201
    """A window over each block. It is made when asked for: making one needs a session."""
    return Window.partitionBy("block_id")


def filter_blocks(lines: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, degree_lt: int | None = None, degree_gt: int | None = None) -> DataFrame:
    """By name prefixes or by degree (number of s lines, bounds inclusive), not both. Blocks without s lines go.

    Lines of other types stay in a surviving block; block 0, the header, always stays.
    """
    names = include is not None or exclude is not None
    if (include is not None and exclude is not None) or (names and (degree_lt is not None or degree_gt is not None)):
        raise ValueError("give one of include, exclude and degree bounds")
    is_s = F.col("type") == "s"
    if names:
        keep = X.starts_with_any(F.col("name"), include) if include is not None else ~X.starts_with_any(F.col("name"), exclude)
        kept = lines.where(~is_s | keep)
        gate = F.max((F.col("type") == "s").cast("int")).over(block()) == 1
    else:
        kept, n = lines, F.sum(is_s.cast("long")).over(block())
        gate = n > 0
        gate = gate & (n >= degree_lt) if degree_lt is not None else gate
        gate = gate & (n <= degree_gt) if degree_gt is not None else gate
    return kept.withColumn("_gate", gate).where((F.col("_gate")) | (F.col("block_id") == 0)).drop("_gate")


def order_rows(rows: DataFrame, names: list[str]) -> DataFrame:
    """Rows of each block in the order of the first prefix that matches them (``place``); the others go."""
    bucket = F.lit(None).cast("int")
    for i in reversed(range(len(names))):
        bucket = F.when(F.col("name").startswith(names[i]), i).otherwise(bucket)
    place = F.row_number().over(block().orderBy("bucket", "row_idx")).cast("long") - 1
    return rows.withColumn("bucket", bucket).where("bucket IS NOT NULL").withColumn("place", place).drop("bucket")


def order_by_gaps(lines: DataFrame) -> DataFrame:
    """``place`` of each line in its block: lines of other types first, then s lines by number of gaps, earlier ones first on ties."""
    gaps = F.when(F.col("type") == "s", F.length("text") - X.bases(F.col("text"))).otherwise(F.lit(-1))
    place = F.row_number().over(Window.partitionBy(*[c for c in ("path", "block_id") if c in lines.columns]).orderBy("gaps", "line_idx")).cast("long") - 1
    return lines.withColumn("gaps", gaps).withColumn("place", place).drop("gaps")


def sort_blocks(rows: DataFrame, prefix: str) -> DataFrame:
    """(block_id, key, place): blocks without the target first, in their own order, then by the target's largest left coordinate.

    Blocks are range-partitioned by their key; a place is the number of rows in the partitions before and in its own.
    """
    left = X.pos_left(F.col("start"), F.col("length"), F.col("strand"), F.col("source_length"))
    key = rows.groupBy("block_id").agg(F.max(F.when(F.col("name").startswith(prefix), left)).alias("key"))
    within = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    sorted_ = stored(key.orderBy(F.col("key").asc_nulls_first(), "block_id").select("block_id", "key", F.spark_partition_id().alias("part"), within.alias("at")))
    sizes = sorted_.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    return sorted_.join(F.broadcast(offset), "part").select("block_id", "key", (F.col("offset") + F.col("at")).alias("place"))


def sorted_lines(lines: DataFrame, prefix: str) -> DataFrame:
    """All lines with the ``place`` of their block in the order of ``sort_blocks``, as ``maf.write(..., order="place")`` takes them."""
    rows = lines.withColumn("name", F.when(F.col("type") == "s", F.col("name")))
    return lines.join(sort_blocks(rows, prefix).select("block_id", "place"), "block_id")


def flip(rows: DataFrame, when: Column) -> DataFrame:
    """Rows re-expressed on the other strand where the condition holds."""
    return rows.withColumns({
        "start": F.when(when, F.col("source_length") - (F.col("start") + F.col("length"))).otherwise(F.col("start")),
        "strand": F.when(when, F.when(F.col("strand") == "+", "-").otherwise("+")).otherwise(F.col("strand")),
        "text": F.when(when, X.reverse_complement(F.col("text"))).otherwise(F.col("text")),
    })


def coerce_strand(rows: DataFrame, prefix: str, strand: str = "+") -> DataFrame:
    """Flip every row of a block whose target rows all have the other strand."""
    target = F.col("name").startswith(prefix)
    wrong = F.max((target & (F.col("strand") != strand)).cast("int")).over(block())
    right = F.max((target & (F.col("strand") == strand)).cast("int")).over(block())
    marked = rows.withColumn("_flip", (wrong == 1) & (right == 0))
    return flip(marked, F.col("_flip")).drop("_flip")


def find_position(rows: DataFrame, name: str, pos: int) -> DataFrame:
    """Rows of exactly that name that cover the position, with a vignette of its surroundings."""
    left = X.pos_left(F.col("start"), F.col("length"), F.col("strand"), F.col("source_length"))
    offset = F.when(F.col("strand") == "+", pos - left).otherwise(left + F.col("length") - 1 - pos)
    hit = rows.where((F.col("name") == name) & (left <= pos) & (left + F.col("length") - 1 >= pos))
    where = [c for c in ("path", "line_no") if c in rows.columns]
    return hit.select(*where, "block_id", "row_idx", "name", "start", "length", "strand", "source_length", X.vignette(F.col("text"), offset).alias("vignette"))


def find_lines(lines: DataFrame, name: str, pos: int) -> DataFrame:
    """The rows of ``find_position`` with the numbers of their own line and of their block's a line (``block_line``)."""
    rows = lines.where("type = 's'").withColumn("row_idx", F.col("line_no"))
    opening = lines.where("type = 'a'").groupBy("path", "block_id").agg(F.min("line_no").alias("block_line"))
    return find_position(rows, name, pos).drop("row_idx").join(opening, ["path", "block_id"], "left")


def overlaps(start: int, stop: int) -> Column:
    """Whether the row's places meet the closed interval; its ends may come in either order."""
    start, stop = min(start, stop), max(start, stop)
    left = X.pos_left(F.col("start"), F.col("length"), F.col("strand"), F.col("source_length"))
    return (left <= stop) & (left + F.col("length") - 1 >= start)


def extract_soft(rows: DataFrame, name: str, start: int, stop: int) -> DataFrame:
    """All rows of the blocks in which a row of that name overlaps the region."""
    return rows.join(rows.where((F.col("name") == name) & overlaps(start, stop)).select("block_id").distinct(), "block_id", "left_semi")


def extract(rows: DataFrame, name: str, start: int, stop: int) -> DataFrame:
    """Blocks cut to the maximal runs of columns in which the name has a base inside the region.

    ``splice`` numbers the runs of a block; ``whole`` tells that a run is the entire block. Rows without a base go.
    """
    low, high = min(start, stop), max(start, stop)
    target = cells(rows.where((F.col("name") == name) & overlaps(start, stop))).where(F.col("pos").between(low, high))
    columns = target.select("block_id", "col").distinct()
    run = columns.withColumn("island", F.col("col") - F.row_number().over(block().orderBy("col")))
    runs = run.groupBy("block_id", "island").agg(F.min("col").alias("l"), F.max("col").alias("r"))
    runs = runs.withColumn("splice", F.row_number().over(block().orderBy("l")).cast("long") - 1)
    cut = rows.join(runs, "block_id").withColumn("piece", F.substring("text", (F.col("l") + 1).cast("int"), (F.col("r") - F.col("l") + 1).cast("int")))
    before = X.bases(F.substring(F.col("text"), F.lit(1), F.col("l").cast("int")))
    whole = (F.col("l") == 0) & (F.col("r") == F.length("text") - 1)
    return cut.where(whole | (X.bases(F.col("piece")) > 0)).select("block_id", "splice", "row_idx", "name", (F.col("start") + before).alias("start"), X.bases(F.col("piece")).cast("long").alias("length"), "strand", "source_length", F.col("piece").alias("text"), whole.alias("whole"))


def extract_lines(lines: DataFrame, name: str, start: int, stop: int, tag: str = "spliced=true") -> DataFrame:
    """(block_id, splice, line_idx, type, raw) of the blocks cut as by ``extract``.

    A run that is its entire block keeps the block's lines. Any other has an a line of its own, with ``tag`` and the
    block's and the run's number, its rows cut, and lines of other types as they are.
    """
    is_s = F.col("type") == "s"
    body = lines.where("block_id > 0")
    s = body.where(is_s).withColumn("row_idx", F.row_number().over(block().orderBy("line_idx")).cast("long") - 1)
    cut = extract(s.select("block_id", "row_idx", "name", "start", "length", "strand", "source_length", "text"), name, start, stop)
    runs = cut.select("block_id", "splice", "whole").distinct()
    line = F.format_string("s %s %d %d %s %d %s", "name", "start", "length", "strand", "source_length", "text")
    rows = cut.select("block_id", "splice", "row_idx", "whole", line.alias("cut")).join(s.select("block_id", "row_idx", "line_idx", "raw"), ["block_id", "row_idx"])
    rows = rows.select("block_id", "splice", "line_idx", F.lit("s").alias("type"), F.when(F.col("whole"), F.col("raw")).otherwise(F.col("cut")).alias("raw"))
    head = F.concat(F.lit(f"a score=0 {tag} splice_id="), F.col("block_id").cast("string"), F.lit("_"), F.col("splice").cast("string"))
    others = body.where(~is_s).join(runs, "block_id").select("block_id", "splice", "line_idx", "type", F.when((F.col("type") == "a") & ~F.col("whole"), head).otherwise(F.col("raw")).alias("raw"))
    return rows.unionByName(others)


def ordered_lines(lines: DataFrame, names: list[str]) -> DataFrame:
    """(block_id, line_idx, type, raw): the rows of ``order_rows`` under an a line of their own; all other lines go."""
    s = lines.where("type = 's'").withColumn("row_idx", F.col("line_idx"))
    rows = order_rows(s, names).select("block_id", (F.col("place") + 1).alias("line_idx"), F.lit("s").alias("type"), "raw")
    head = rows.select("block_id").distinct().select("block_id", F.lit(0).cast("long").alias("line_idx"), F.lit("a").alias("type"), F.lit("a ordered=true").alias("raw"))
    return head.unionByName(rows)


# Bits of a code, and which bases (A 1, C 2, G 4, T 8) each stands for.
BITS_OF_THREE = 0.41503749927884  # what a code of three bases tells
CODE_OF = ("N", "A", "C", "M", "G", "R", "S", "V", "T", "W", "Y", "H", "K", "D", "B", "N")


def _code(counts: DataFrame) -> DataFrame:
    """(block_id, col, code) of counts of A, C, G, T and N."""
    most = F.greatest(*[F.col(f"n_{b}") for b in "ACGTN"])
    mask = sum((F.when(F.col(f"n_{b}") == most, 1 << i).otherwise(0) for i, b in enumerate("ACGT")), F.lit(0))
    code = F.when((most == 0) | (F.col("n_N") == most), "N").otherwise(F.element_at(F.array(*map(F.lit, CODE_OF)), mask + 1))
    return counts.select("block_id", F.col("col").cast("long").alias("col"), code.alias("code"))


def _codes(rows: DataFrame) -> DataFrame:
    """(block_id, col, code): ``consensus`` of rows as they are dealt."""
    each = rows.select("block_id", "row_idx", F.posexplode(F.split(F.upper("text"), "")).alias("col", "base")).where("base <> ''")
    return _code(each.groupBy("block_id", "col").agg(*[F.sum(((F.col("base") == b) & (F.col("row_idx") > 0)).cast("long")).alias(f"n_{b}") for b in "ACGTN"]))


def _codes_by_block(rows: DataFrame) -> DataFrame:
    """``consensus`` of narrow blocks of LARGE rows at most: a block's texts are one row, and columns are counted block by block as they pass.

    The counts of a column are bytes of a long, so nothing is held beyond one block."""
    each = rows.select("block_id", "row_idx", F.upper("text").alias("text"))
    below = F.collect_list(F.when(F.col("row_idx") > 0, F.col("text"))).over(block())
    one = each.select("block_id", (F.col("row_idx") == F.min("row_idx").over(block())).alias("one"), F.max(F.length("text")).over(block()).alias("n"), below.alias("texts")).where("one AND n > 0")
    byte = " ".join(f"WHEN '{b}' THEN {1 << 8 * i}L" for i, b in enumerate("ACGTN"))
    counted = one.select("block_id", "texts", F.explode(F.sequence(F.lit(1), "n")).alias("at")).select("block_id", (F.col("at") - 1).alias("col"), F.expr(f"aggregate(texts, 0L, (acc, t) -> acc + CASE substring(t, at, 1) {byte} ELSE 0L END)").alias("c"))
    return _code(counted.select("block_id", "col", *[F.expr(f"shiftright(c, {8 * i}) & 255").alias(f"n_{b}") for i, b in enumerate("ACGTN")]))


def consensus(rows: DataFrame) -> DataFrame:
    """(block_id, col, code): the bases most frequent below the first row; N if N leads, or all four, or none.

    Rows are dealt by their block and counted there; columns of blocks of over LARGE rows are counted before they are moved.
    """
    small, crowded = _split(rows)
    codes = None
    for part, one in narrow(small):
        c = _codes_by_block(part) if one else _codes(part.repartition("block_id"))
        codes = c if codes is None else codes.unionByName(c)
    return codes if crowded is None else codes.unionByName(_codes(crowded))


def _score() -> Column:
    """What a base tells of a code that allows it, in bits."""
    held = [[c for i, c in enumerate("ACGT") if m >> i & 1] for m in range(16)]
    score = F.lit(0.0)
    for m, bases_ in enumerate(held):
        if len(bases_) == 1:
            score = F.when((F.col("code") == CODE_OF[m]) & (F.col("base") == bases_[0]), 2.0).otherwise(score)
        elif len(bases_) == 2:
            score = F.when((F.col("code") == CODE_OF[m]) & F.col("base").isin(*bases_), 1.0).otherwise(score)
        elif len(bases_) == 3:
            out = next(c for c in "ACGT" if c not in bases_)
            score = F.when((F.col("code") == CODE_OF[m]) & (F.col("base") != out), BITS_OF_THREE).otherwise(score)
    return score


def _scores_by_block(rows: DataFrame) -> DataFrame:
    """``duplicate_scores`` where rows are dealt by their block once and each block's codes are one text that its rows meet."""
    n = F.count(F.lit(1)).over(Window.partitionBy("block_id", "species"))
    own = rows.select("block_id", "row_idx", X.species(F.col("name")).alias("species"), "text").repartition("block_id").withColumn("n", n)
    touched = own.withColumn("most", F.max("n").over(block())).where("most > 1")
    listed = F.array_sort(F.collect_list(F.struct("col", "code")))
    codes = _codes(touched).groupBy("block_id").agg(F.transform(listed, lambda x: x["code"]).alias("codes"))
    pair = touched.where("n > 1").join(codes.hint("merge"), "block_id").select("block_id", "row_idx", "species", F.explode(F.arrays_zip(F.split(F.upper("text"), "").alias("base"), F.col("codes").alias("code"))).alias("x"))
    each = pair.select("block_id", "row_idx", "species", F.col("x.base").alias("base"), F.col("x.code").alias("code")).where("base <> ''")
    return each.groupBy("block_id", "row_idx", "species").agg(F.sum(_score()).alias("score"))


def duplicate_scores(rows: DataFrame) -> DataFrame:
    """(block_id, row_idx, score) of rows whose species occurs again in the block: agreement with the consensus in bits."""
    small, crowded = _split(rows)
    scores = _scores_by_block(small)
    if crowded is None:
        return scores
    own = crowded.withColumn("species", X.species(F.col("name")))
    n = F.count(F.lit(1)).over(Window.partitionBy("block_id", "species"))
    dup = own.withColumn("n", n).where("n > 1").select("block_id", "row_idx", "species", "text")
    touched = crowded.join(dup.select("block_id").distinct(), "block_id", "left_semi")
    each = dup.select("block_id", "row_idx", "species", F.posexplode(F.split(F.upper("text"), "")).alias("col", "base")).where("base <> ''").withColumn("col", F.col("col").cast("long"))
    return scores.unionByName(each.hint("merge").join(_codes(touched), ["block_id", "col"]).groupBy("block_id", "row_idx", "species").agg(F.sum(_score()).alias("score")))


def filter_duplicates(rows: DataFrame) -> DataFrame:
    """One row of each species in a block: the best score against the consensus, the earliest on ties."""
    best = Window.partitionBy("block_id", "species").orderBy(F.round("score", 9).desc(), "row_idx")
    losers = duplicate_scores(rows).withColumn("rank", F.row_number().over(best)).where("rank > 1").select("block_id", "row_idx")
    return rows.join(losers, ["block_id", "row_idx"], "left_anti")
