"""Text reports of aggregates, as (place, value) rows in the order of ``place``. They read results of a bounded size:
one row for each file, name or bin; nothing here looks at blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The layout of the reports.
STATS_LINES = (
    ("File size:              %10s", "file_size"), ("Lines:                  %10d", "lines"), ("Header lines:           %10d", "header_lines"),
    ("s lines:                %10d", "s_lines"), ("e lines:                %10d", "e_lines"), ("i lines:                %10d", "i_lines"), ("q lines:                %10d", "q_lines"),
    ("Blank lines:            %10d", "blank_lines"), ("Comment lines:          %10d\n", "comment_lines"),
    ("Columns:                %10d\n", "columns"), ("Blocks:                 %10d", "blocks"), ("Ave block area:         %10.2f", "avg_area"), ("Max block area:         %10d", "max_area"),
    ("Total block area:       %10d", "total_area"), ("Ave block degree:       %10.2f", "avg_degree"), ("Max block degree:       %10d", "max_degree"),
    ("Ave seq field length:   %10.2f", "avg_text"), ("Max seq field length:   %10d\n", "max_text"),
)
SHARE_LINES = (("Sequence chars:         %10d (%6.2f%%)", "base_chars"), ("Gap chars:              %10d (%6.2f%%)", "gap_chars"))
COVERAGE_HEAD = "# referenceSpecies/Chr\tquerySpecies/Chr\tlengthOfReferenceGenome\tcoverage\t"
PAIR_HEAD = "#%19s\t%15s\t%15s\t%15s\t%15s\t%15s"
PAIR_ROW = "%20s\t%15d\t%15d\t%15d\t%15e\t%15e"
BED_HEAD = "#%19s\t%15s\t%15s\t%15s\t%15s"
BED_ROW = "%20s\t%15d\t%15d\t%15d\t%15e"


def human_size(n: Column) -> Column:
    """A number of bytes in the largest unit that it exceeds once."""
    out = F.format_string("%.2f TB", n / 1024.0**4)
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB")):
        out = F.when(n <= 1024.0 ** (power + 1), F.format_string(f"%.2f {unit}", n / 1024.0**power)).otherwise(out)
    return F.when(n <= 1024, F.format_string("%d Bytes", n)).otherwise(out)


def _rows(listed: Column, of: DataFrame) -> DataFrame:
    return of.select(F.posexplode(listed).alias("place", "value"))


def _stack(*parts: DataFrame) -> DataFrame:
    """The parts below one another; each has (place, value)."""
    out = None
    for i, part in enumerate(parts):
        part = part.select(F.struct(F.lit(i).alias("part"), F.col("place").cast("long").alias("at")).alias("place"), "value")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("place", F.row_number().over(Window.orderBy("place")).cast("long"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def stats(result: DataFrame, names: DataFrame, path: str) -> DataFrame:
    """Of ``file_stats``, with columns file_bytes and lines added, and ``bases_per_sequence``. Ratios of nothing are 0.00."""
    chars = F.col("base_chars") + F.col("gap_chars")
    parts = ("s", "e", "i", "q", "comment")
    full = result.withColumns({
        "file_size": human_size(F.col("file_bytes")), "total_area": F.coalesce(F.round(F.col("avg_area") * F.col("blocks")), F.lit(0.0)).cast("long"), "avg_text": _ratio(chars, F.col("s_lines")),
        "blank_lines": F.col("lines") - F.col("header_lines") - sum((F.col(f"{p}_lines") for p in parts), F.lit(0)),
    }).na.fill(0)
    line = lambda f, *c: F.format_string(f, *c)
    values = [F.lit(path), F.lit("-" * 30), *[line(f, F.col(c)) for f, c in STATS_LINES[:9]], *[line(f, F.col(c), 100 * _ratio(F.col(c), chars)) for f, c in SHARE_LINES], *[line(f, F.col(c)) for f, c in STATS_LINES[9:]]]
    count = names.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bases"), F.lit(0)).alias("bases"))
    ranked = names.select(F.row_number().over(Window.orderBy(F.desc("bases"), "name")).alias("place"), line("%25s: %12d (%6.2f%%)", "name", "bases", F.col("share") * 100).alias("value"))
    above = count.select(F.lit(0).alias("place"), line("%d unique sequences, ordered by # bases present:", "n").alias("value"))
    below = _rows(F.array(line("%25s: %12d (100.00%%)", F.lit("total"), "bases"), F.lit("")), count)
    return _stack(_rows(F.array(*values), full), above, ranked, below)


def coverage(levels: DataFrame, lengths: DataFrame, n_max: int = 1) -> DataFrame:
    """Of ``coverage.coverage``: one line for each query and target, with a field for each depth from 2 to n_max."""
    more = [F.coalesce(F.max(F.when(F.col("n") == k, F.col("coverage"))), F.lit(0.0)).alias(f"c{k}") for k in range(1, n_max + 1)]
    wide = levels.groupBy("query", "target").agg(*more).join(lengths.withColumnRenamed("genome", "query"), "query")
    row = F.concat_ws("\t", "query", "target", F.col("total").cast("string"), *[F.format_string("%f", F.col(f"c{k}")) for k in range(1, n_max + 1)])
    head = COVERAGE_HEAD + "".join(f"\t{k}-coverage" for k in range(2, n_max + 1))
    one = levels.sparkSession.range(1)
    return _stack(_rows(F.array(F.lit(head)), one), wide.select(F.row_number().over(Window.orderBy("query", "target")).alias("place"), row.alias("value")))


def pair_coverage(result: DataFrame, seq1: str, seq2: str) -> DataFrame:
    """Of ``coverage.pair_coverage``: the totals of both patterns, then each name."""
    names = F.format_string(PAIR_ROW, "name", "source_length", "observed", "aligned", "coverage", "observed_coverage")
    each = result.select(F.row_number().over(Window.orderBy("side", "name")).alias("place"), names.alias("value"))
    sums = result.groupBy("side").agg(*[F.sum(c).alias(c) for c in ("source_length", "observed", "aligned")])
    grid = result.sparkSession.createDataFrame([(1, seq1), (2, seq2)], "side int, name string").join(sums, "side", "left").na.fill(0)
    ratios = [_ratio(F.col("aligned"), F.col(c)) for c in ("source_length", "observed")]
    total = grid.select(F.col("side").alias("place"), F.format_string(PAIR_ROW, "name", "source_length", "observed", "aligned", *ratios).alias("value"))
    head = PAIR_HEAD % ("Sequence", "Source Length", "Obs Length", "Aligned Pos.", "Coverage", "Obs Coverage")
    one = result.sparkSession.range(1)
    text = lambda *lines: _rows(F.array(*map(F.lit, lines)), one)
    return _stack(text("# Overall", head), total, text("", "# Individual Sequences", head), each)


def bed(result: DataFrame, intervals: DataFrame, seq1: str) -> DataFrame:
    """Of the first side of ``coverage.pair_regions``: the total of the pattern, then each name with intervals."""
    size = intervals.groupBy("name").agg(F.sum(F.col("stop") - F.col("start")).alias("size"))
    known = result.where("side = 1").join(size, "name", "left")
    sums = known.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("size", "in_region", "out_region")])
    row = lambda name: F.format_string(BED_ROW, name, "size", "in_region", "out_region", _ratio(F.col("in_region"), F.col("size")))
    head = BED_HEAD % ("Sequence", "Region Length", "In Regions", "Out of Regions", "Coverage")
    each = known.where("size IS NOT NULL").select(F.row_number().over(Window.orderBy("name")).alias("place"), row(F.col("name")).alias("value"))
    return _stack(_rows(F.array(F.lit(""), F.lit("# BED Regions"), F.lit(head), row(F.lit(seq1))), sums), each)


def bins(result: DataFrame) -> DataFrame:
    """Of ``coverage.pair_bins``: the first place and the value of each bin."""
    one = result.sparkSession.range(1)
    head = _rows(F.array(*map(F.lit, ("#" * 30, "# Bins", "# Ref_Bin_Starting_Pos\tCoverage"))), one)
    return _stack(head, result.select(F.col("bin").alias("place"), F.format_string("%22d\t%12e", "bin_start", "value").alias("value")))
