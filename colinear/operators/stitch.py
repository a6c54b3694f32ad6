"""Stitching of all blocks into one, as events: what each species' row does before its block, found by ``lag``.

An event adds columns for one species (N for a break, its own sequence for an insertion) and gaps for all others. Every
species' text is the concatenation, in the order of events and block bodies, of its own pieces and gaps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

TILE = 1 << 16  # blocks in one task of the search for a species' row before

def events(rows: DataFrame, penalty: int, interstitial: int, reference: str | None = None) -> DataFrame:
    """(block_id, row_idx, species, kind, width) for each row that is not the first of its species.

    kind: reference or interstitial (width: bases to insert), strand, name or distance (a break of ``penalty`` columns),
    none.
    """
    own = rows.withColumn("species", X.species(F.col("name")))
    # The row before is looked for in the same range of blocks, and only for a range's first row in the one before.
    seen = F.struct("strand", "name", (F.col("start") + F.col("length") - 1).alias("right"))
    tiled = own.withColumns({"tile": F.floor(F.col("block_id") / TILE), "seen": seen})
    order = Window.partitionBy("species", "tile").orderBy("block_id", "row_idx")
    last = tiled.groupBy("species", "tile").agg(F.max_by("seen", F.struct("block_id", "row_idx")).alias("last"))
    carried = last.select("species", "tile", F.lag("last").over(Window.partitionBy("species").orderBy("tile")).alias("carried"))
    x = tiled.withColumn("prev", F.lag("seen").over(order)).join(carried, ["species", "tile"]).withColumn("prev", F.coalesce("prev", "carried")).where("prev IS NOT NULL")
    x = x.withColumns({"p_strand": F.col("prev.strand"), "p_name": F.col("prev.name"), "right": F.col("prev.right")})
    gap = F.col("start") - F.col("right") - 1
    is_ref = F.lit(False) if reference is None else F.col("name") == reference
    kind = (
        F.when(is_ref, F.when(gap > 0, "reference").otherwise("none"))
        .when(F.col("p_strand") != F.col("strand"), "strand")
        .when(F.col("p_name") != F.col("name"), "name")
        .when(F.col("right") + interstitial < F.col("start"), "distance")
        .when(gap > 0, "interstitial")
        .otherwise("none")
    )
    width = F.when(F.col("kind").isin("reference", "interstitial"), gap).when(F.col("kind") == "none", 0).otherwise(penalty)
    return x.withColumn("kind", kind).select("block_id", "row_idx", "species", "name", "kind", width.cast("long").alias("width"), (F.col("right") + 1).alias("from"), "strand")


BODY = 1 << 40  # the step of a block's rows, after all insertions before it


def pieces(rows: DataFrame, fasta: DataFrame, penalty: int, interstitial: int, reference: str | None = None) -> DataFrame:
    """(species, block_id, step, at, piece): what each species has of the stitched text, and at which of its columns.

    What lies between two pieces of a species is gaps. Columns are numbered by the widths of all slots before: sums of
    tiles of blocks first, then inside a tile.
    """
    own = rows.withColumn("species", X.species(F.col("name")))
    n = F.count(F.lit(1)).over(Window.partitionBy("block_id", "species"))
    own = own.withColumn("species", F.when(n > 1, F.raise_error("a species has two rows in a block").cast("string")).otherwise(F.col("species")))
    ev = events(rows, penalty, interstitial, reference).where("width > 0")
    first = ev.where(F.col("kind").isin("name", "distance")).groupBy("species").agg(F.min(F.struct("block_id", "row_idx")).alias("first"))
    collapsed = ev.join(first, "species", "left").withColumn("broken", F.coalesce(F.struct("block_id", "row_idx") > F.col("first"), F.lit(False)))
    with_seq = collapsed.join(fasta.select(F.col("name").alias("f_name"), "seq"), F.col("name") == F.col("f_name"), "left")
    inserts = F.col("kind").isin("reference", "interstitial")
    fill = F.when(inserts & ~F.col("broken"), F.when(F.col("seq").isNull(), F.raise_error(F.concat(F.lit("no sequence for "), "name")).cast("string")).otherwise(X.subsequence(F.col("seq"), F.col("from"), F.col("width"), F.col("strand"))))
    fill = fill.when(inserts, F.expr("repeat('-', cast(width as int))")).otherwise(F.expr("repeat('N', cast(width as int))"))
    body = own.select("block_id", F.lit(BODY).alias("step"), "species", F.col("text").alias("piece"))
    every = with_seq.select("block_id", F.col("row_idx").alias("step"), "species", fill.alias("piece")).unionByName(body)
    slots = ev.select("block_id", F.col("row_idx").alias("step"), "width").unionByName(own.groupBy("block_id").agg(F.lit(BODY).alias("step"), F.max(F.length("text")).cast("long").alias("width")))
    tiled = slots.withColumn("tile", F.floor(F.col("block_id") / TILE))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = tiled.groupBy("tile").agg(F.sum("width").alias("width"))
    offset = sums.select("tile", F.coalesce(F.sum("width").over(before(Window.orderBy("tile"))), F.lit(0)).alias("offset"))
    inside = F.coalesce(F.sum("width").over(before(Window.partitionBy("tile").orderBy("block_id", "step"))), F.lit(0))
    placed = tiled.withColumn("inside", inside).join(offset, "tile").select("block_id", "step", (F.col("offset") + F.col("inside")).alias("at"))
    return every.join(placed, ["block_id", "step"]).select("species", "block_id", "step", "at", "piece")


TEXT_TILE = 1 << 12  # blocks whose pieces one task joins


def _joined(part: DataFrame, gaps: Callable[[Column], Column], *keys: str) -> DataFrame:
    """(keys..., at, piece): the pieces of each key in the order of their columns as one, with gaps between them."""
    listed = part.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", F.length("piece").alias("n"), "piece"))).alias("p"))
    after = lambda x: x["at"] + x["n"]
    filled = F.transform("p", lambda x, i: F.concat(F.when(i == 0, F.lit("")).otherwise(gaps(x["at"] - after(F.get("p", i - 1)))), x["piece"]))
    return listed.select(*keys, F.col("p")[0]["at"].alias("at"), F.array_join(filled, "").alias("piece"))


def stitch(rows: DataFrame, fasta: DataFrame, penalty: int, interstitial: int, reference: str | None = None) -> DataFrame:
    """(species, name, start, length, strand, source_length, text) in the order of first appearance (``place``).

    A species' text is one value, as in the file that it is written to; ``pieces`` are its parts for larger ones.
    """
    part = pieces(rows, fasta, penalty, interstitial, reference)
    end = part.select((F.col("at") + F.length("piece")).alias("end")).agg(F.max("end").alias("end"))
    gaps = lambda n: F.call_function("repeat", F.lit("-"), n.cast("int"))
    # Pieces are joined to those of their tile of blocks first, and tiles to a text; each is from its first column to its last.
    tile = _joined(part.select("species", F.floor(F.col("block_id") / TEXT_TILE).alias("tile"), "at", "piece"), gaps, "species", "tile")
    listed = _joined(tile.select("species", "at", "piece"), gaps, "species").join(F.broadcast(end))
    text = listed.select("species", F.concat(gaps(F.col("at")), "piece", gaps(F.col("end") - F.col("at") - F.length("piece"))).alias("text"))
    kinds = rows.withColumn("species", X.species(F.col("name"))).groupBy("species").agg(F.min(F.struct("block_id", "row_idx", "name", "start", "strand", "source_length")).alias("first"))
    ev = events(rows, penalty, interstitial, reference).where("width > 0")
    marks = ev.groupBy("species").agg(F.max(F.col("kind").isin("name", "distance").cast("int")).alias("many"), F.max(F.col("kind").isin("strand", "name").cast("int")).alias("both"))
    many, both = F.coalesce("many", F.lit(0)) == 1, F.coalesce("both", F.lit(0)) == 1
    length = X.bases(F.col("text")).cast("long")
    return text.join(kinds, "species").join(marks, "species", "left").select(
        "species", F.when(many, F.col("species")).otherwise(F.col("first.name")).alias("name"), F.when(many, 0).otherwise(F.col("first.start")).alias("start"), length.alias("length"),
        F.when(both, "*").otherwise(F.col("first.strand")).alias("strand"), F.when(many, length).otherwise(F.col("first.source_length")).alias("source_length"), "text", F.struct("first.block_id", "first.row_idx").alias("place"),
    )


def stitched_text(stitched: DataFrame) -> DataFrame:
    """(place, value): the lines of an alignment file whose one block is the stitched rows, in columns as wide as needed."""
    wide = stitched.agg(*[F.greatest(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(1)), F.lit(1)).alias(c) for c in ("name", "start", "length", "source_length")])
    width = stitched.join(F.broadcast(wide.select(F.struct("*").alias("w"))))
    left = lambda c: F.lpad(F.col(c).cast("string"), F.col(f"w.{c}") + 1, F.lit(" "))
    strand = F.when(F.col("strand") == "*", "+").otherwise(F.col("strand"))
    line = F.concat_ws(" ", F.lit("s"), F.rpad("name", F.col("w.name") + 2, F.lit(" ")), left("start"), left("length"), strand, left("source_length"), "text")
    body = width.select(F.row_number().over(Window.orderBy("place")).cast("long").alias("place"), line.alias("value"))
    head = wide.select(F.posexplode(F.array(F.lit("##maf version=1"), F.lit(""))).alias("place", "value")).withColumn("place", F.col("place").cast("long") - 3)
    any_ = stitched.groupBy().agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    around = any_.select(F.explode(F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit("a stitched=true").alias("value")), F.struct((F.col("n") + 1).alias("place"), F.lit("").alias("value")))).alias("x")).select("x.*")
    return head.unionByName(around).unionByName(body)
