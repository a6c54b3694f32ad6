"""Alignment files as DataFrames: lines, rows and cells; BED and FASTA; writers.

``lines``: path, block_id, line_idx, line_no, type, raw and, for s lines, name, start, length, strand, source_length,
text. Block 0 is the header. ``rows``: the s lines with row_idx. ``cells``: one row for each base of each row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

FIELDS = ("name", "start", "length", "strand", "source_length", "text")


def with_fields(lines: DataFrame) -> DataFrame:
    """The columns of ``lines`` from (path, block_id, line_idx, raw)."""
    is_s = F.col("type") == "s"

    def field(i: int, kind: str) -> Column:
        return F.when(is_s, F.expr(f"try_cast(get(split(trim(raw), '[ \\\\t]+'), {i}) AS {kind})"))

    kind = F.when(F.col("raw").startswith("##maf") | F.col("raw").startswith("track"), "h").otherwise(F.substring("raw", 1, 1))
    return lines.withColumn("type", kind).select(
        "path", F.col("block_id").cast("long").alias("block_id"), F.col("line_idx").cast("long").alias("line_idx"), (F.col("line_idx") + 1).cast("long").alias("line_no"), "type", "raw",
        field(1, "string").alias("name"), field(2, "long").alias("start"), field(3, "long").alias("length"),
        field(4, "string").alias("strand"), field(5, "long").alias("source_length"), field(6, "string").alias("text"), F.size(F.split(F.trim("raw"), r"[ \t]+")).alias("n_fields"),
    )


def _numbered(lines: DataFrame) -> DataFrame:
    """Number the lines and blocks of (path, part, at, raw): parts of a file in order, and the order of lines in a part.

    A line opens a block if it is not blank and follows a blank one, or if it is the first a line and nothing blank came
    before it; what precedes is the header, block 0. Blocks are counted through all files in the order of their paths, so
    a block_id other than 0 is of one block. Windows reach over one part. Between parts only one row for each part is
    ordered: its numbers of lines and openings, whether its last line is blank and where its first blank or a line stands.
    All this is told in one pass without the lines' text, which is dealt out once.
    """
    lines = lines.withColumn("raw", F.regexp_replace("raw", "\r", ""))
    own = Window.partitionBy("path", "part").orderBy("at")
    blank = F.trim(F.regexp_replace("raw", r"\s+", " ")) == ""
    told = lines.withColumns({"blank": blank, "mark": blank | F.col("raw").startswith("a"), "k": F.row_number().over(own).cast("long") - 1, "before": F.lag(blank).over(own)})
    # A part's openings are those after its blank lines and one more: its first mark, or its first line by what came before.
    parts = told.groupBy("path", "part").agg(
        F.count(F.lit(1)).alias("n"), F.max_by("blank", "k").alias("last"), F.min_by("blank", "k").alias("first"), F.min(F.when(F.col("mark"), F.col("k"))).alias("marked"),
        F.min_by("blank", F.when(F.col("mark"), F.col("k"))).alias("marks_blank"), F.sum((~F.col("blank") & F.coalesce("before", F.lit(False))).cast("long")).alias("after"),
    )
    order = Window.partitionBy("path").orderBy("part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "path", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"), F.lag("last").over(order).alias("carried"),
        "marked", F.coalesce(F.count("marked").over(earlier) > 0, F.lit(False)).alias("in_body"), "first", "marks_blank", "after",
    )
    more = F.when(F.col("in_body"), ~F.col("first") & F.coalesce("carried", F.lit(False))).otherwise(~F.coalesce("marks_blank", F.lit(True)))
    every = Window.orderBy("path", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum(F.col("after") + more.cast("long")).over(every), F.lit(0))
    placed = told.join(parts.select("path", "part", "offset", "carried", "marked", "in_body", base.alias("base")), ["path", "part"])
    first = ~F.col("in_body") & F.coalesce(F.col("k") == F.col("marked"), F.lit(False))
    body = F.col("in_body") | F.coalesce(F.col("k") >= F.col("marked"), F.lit(False))
    opens = ~F.col("blank") & body & (first | F.coalesce("before", "carried", F.lit(False)))
    placed = placed.withColumns({"body": body, "opens": opens.cast("long"), "line_idx": F.col("offset") + F.col("k")})
    block = F.when(F.col("body"), F.col("base") + F.sum("opens").over(own)).otherwise(0)
    return placed.withColumn("block_id", block).where("NOT blank").select("path", "block_id", "line_idx", "raw")


def parse_lines(files: DataFrame) -> DataFrame:
    """Lines of (path, value) rows, value being a whole file. Whitespace-only lines end a block and are dropped."""
    return with_fields(_numbered(files.select("path", F.lit(0).alias("part"), F.posexplode(F.split("value", "\n")).alias("at", "raw"))))


def parse_each(files: DataFrame) -> DataFrame:
    """As ``parse_lines``, by expressions on each row alone: no shuffle, and fit for a stream of whole files."""
    lines = "transform(split(replace(value, '\\r', ''), '\\n'), (x, i) -> named_struct('i', cast(i AS bigint), 'raw', x, 'b', trim(regexp_replace(x, '\\\\s+', ' ')) = ''))"
    marks = f"array_min(transform(filter({lines}, l -> l.b OR startswith(l.raw, 'a')), l -> l.i))"
    # A line opens a block after a blank one, or where the body begins; blocks are counted by the opening lines up to it.
    told = files.selectExpr("path", f"{lines} AS l", f"coalesce({marks}, {1 << 62}L) AS body")
    opening = told.selectExpr("path", "l", "body", "array_sort(transform(filter(l, x -> NOT x.b AND x.i >= body AND (x.i = body OR l[cast(x.i AS int) - 1].b)), x -> x.i)) AS opens")
    spans = "transform(opens, (o, k) -> named_struct('block', k + 1, 'from', cast(o AS int), 'to', cast(coalesce(get(opens, k + 1), size(l)) AS int)))"
    header = "array(named_struct('block', 0, 'from', 0, 'to', cast(least(body, size(l)) AS int)))"
    each = opening.selectExpr("path", "l", f"explode(concat({header}, {spans})) AS s").selectExpr("path", "s.block AS block_id", "explode(filter(slice(l, s.from + 1, s.to - s.from), x -> NOT x.b)) AS x")
    return with_fields(each.selectExpr("path", "block_id", "x.i AS line_idx", "x.raw AS raw"))


def read_lines(spark: SparkSession, path: str | list[str], one: bool = False) -> DataFrame:
    """Files are cut by byte ranges as any text source, so one file is read by many tasks; ranges are the parts that are numbered.

    If ``one``, the files of a folder are one file, cut between lines, in the order of their names; its path is the folder's.
    """
    return with_fields(numbered_lines(spark, path, one))


def placed_text(spark: SparkSession, path: str | list[str], one: bool = False) -> DataFrame:
    """(path, part, at, raw) of the lines of files: parts of a file in order, and the order of lines in a part."""
    text = spark.read.option("lineSep", "\n").text(path)
    file, start = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    where = [F.lit(path).alias("path"), F.struct(file.alias("file"), start.alias("start")).alias("part")] if one else [file.alias("path"), start.alias("part")]
    return text.select(*where, F.monotonically_increasing_id().alias("at"), F.col("value").alias("raw"))


def numbered_lines(spark: SparkSession, path: str | list[str], one: bool = False) -> DataFrame:
    """(path, block_id, line_idx, raw) of the lines of ``read_lines``, without their fields."""
    return _numbered(placed_text(spark, path, one))


def rows(lines: DataFrame) -> DataFrame:
    """The aligned rows. A row whose numbers or strand cannot be read is an error."""
    keys = [c for c in ("path", "block_id") if c in lines.columns]
    bad = F.col("start").isNull() | F.col("length").isNull() | F.col("source_length").isNull() | ~F.coalesce(F.col("strand").isin("+", "-"), F.lit(False)) | (F.col("start") < 0)
    checked = F.when(bad, F.raise_error(F.concat(F.lit("unreadable row: "), F.col("raw"))).cast("string")).otherwise(F.col("name"))
    # Rows are checked before they are dealt by block, so their raw lines stay behind.
    s = lines.where("type = 's'").select(*keys, "line_idx", checked.alias("name"), *FIELDS[1:])
    row_idx = F.row_number().over(Window.partitionBy(*keys).orderBy("line_idx")).cast("long") - 1
    return s.withColumn("row_idx", row_idx).select(*keys, "row_idx", *FIELDS)


def cells(aligned: DataFrame) -> DataFrame:
    """(block_id, row_idx, col, base, name, pos) of every base; pos is on the + strand.

    The bases of a text are listed with their columns; a base's index in the list is the number of bases before it, so
    the cost grows with the text, however long.
    """
    listed = F.filter(F.transform(F.split("text", ""), lambda c, i: F.struct(i.alias("col"), c.alias("base"))), lambda x: (x["base"] != "-") & (x["base"] != ""))
    pos = X.pos_start(F.col("start"), F.col("strand"), F.col("source_length")) + X.sign(F.col("strand")) * F.col("seen")
    each = aligned.select("block_id", "row_idx", "name", "start", "strand", "source_length", F.posexplode(listed).alias("seen", "cell"))
    return each.select("block_id", "row_idx", F.col("cell.col").cast("long").alias("col"), F.col("cell.base").alias("base"), "name", "strand", pos.cast("long").alias("pos"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(name, start, stop), half open. Overlapping intervals of a name are an error."""
    part = F.split(F.trim("value"), r"[ \t]+")
    bed = spark.read.text(path).where(F.trim("value") != "").select(part[0].alias("name"), part[1].cast("long").alias("start"), part[2].cast("long").alias("stop"))
    before = F.lag("stop").over(Window.partitionBy("name").orderBy("start"))
    return bed.withColumn("start", F.when(before > F.col("start"), F.raise_error(F.concat(F.lit("overlapping intervals of "), F.col("name"))).cast("long")).otherwise(F.col("start")))


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(name, seq); the name is the first word after the angle. Files are read by byte ranges; a range's records are numbered from the heads before it."""
    text = spark.read.option("lineSep", "\n").text(list(paths))
    lines = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.regexp_replace("value", r"\s+$", "").alias("value"))
    head = F.col("value").startswith(">")
    told = lines.withColumn("seen", F.sum(head.cast("long")).over(Window.partitionBy("path", "part").orderBy("at")))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = told.groupBy("path", "part").agg(F.max("seen").alias("n")).select("path", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    record = told.join(offset, ["path", "part"]).withColumn("record", F.col("offset") + F.col("seen")).where("record > 0")
    bases = F.when(~head, F.struct("part", "at", F.regexp_replace("value", r"\s", "").alias("b")))
    whole = record.groupBy("path", "record").agg(F.max(F.when(head, F.col("value"))).alias("head"), F.array_sort(F.collect_list(bases)).alias("parts"))
    name = F.split(F.trim(F.substring(F.col("head"), 2, 1 << 30)), r"\s+")[0]
    return whole.select(name.alias("name"), F.array_join(F.transform("parts", lambda x: x["b"]), "").alias("seq"))


def fasta_text(seqs: DataFrame, width: int = 50) -> DataFrame:
    return seqs.select(F.concat(F.lit("> "), "name", F.lit("\n"), F.regexp_replace("seq", f"(.{{{width}}})(?!$)", "$1\n")).alias("value"))


def s_line(width: bool = False) -> Column:
    """An s line from its fields, in fixed columns if width."""
    return F.format_string("s %-15s %10d %10d %s %10d %s" if width else "s %s %d %d %s %d %s", *FIELDS)


def pretty(lines: DataFrame) -> DataFrame:
    """s lines padded to the widest value of their block; other lines as they are."""
    block = Window.partitionBy(*[c for c in ("path", "block_id") if c in lines.columns])
    wide = {c: F.max(F.length(F.col(c).cast("string"))).over(block) for c in ("name", "start", "length", "source_length")}
    pad = lambda c, f: f(F.col(c).cast("string"), F.col(f"w_{c}"), F.lit(" "))
    line = F.concat_ws(" ", F.lit("s"), pad("name", F.rpad), pad("start", F.lpad), pad("length", F.lpad), "strand", pad("source_length", F.lpad), "text")
    return lines.withColumns({f"w_{c}": w for c, w in wide.items()}).withColumn("raw", F.when(F.col("type") == "s", line).otherwise(F.col("raw"))).drop(*[f"w_{c}" for c in wide])


def append_to_a(lines: DataFrame, text: Column) -> DataFrame:
    """The lines with a text added to each a line, such as `` key=value``."""
    return lines.withColumn("raw", F.when(F.col("type") == "a", F.concat("raw", text)).otherwise(F.col("raw")))


def blocks_text(lines: DataFrame, order: str = "block_id") -> DataFrame:
    """(path, block_id, value): each block's lines, then a blank line, as they are written to a file. Without ``path`` there is one file.

    ``order`` is the column whose order the blocks are written in; it is returned too.
    """
    keys = list(dict.fromkeys(c for c in ("path", order, "block_id") if c in lines.columns))
    listed = F.array_sort(F.collect_list(F.struct("line_idx", "raw")))
    return lines.groupBy(*keys).agg(F.concat(F.array_join(F.transform(listed, lambda x: x["raw"]), "\n"), F.lit("\n")).alias("value"))


def write(lines: DataFrame, path: str, order: str = "block_id") -> None:
    """Part files whose order by name is the order of the files and their blocks."""
    text = blocks_text(lines, order)
    text.orderBy(*[c for c in text.columns if c != "value"]).select("value").write.text(path)
