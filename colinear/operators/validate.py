"""Format rules as one DataFrame of violations (path, line_no, rule, message): all of them, not only the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..sources.maf import cells, numbered_lines, placed_text, with_fields
from ..sources.shared import stored

TILE = 1 << 20  # places of a sequence in one task

def duplicate_columns(rows: DataFrame) -> DataFrame:
    """(name, start, stop) of rows whose places on the + strand were covered by a row that begins before. Nothing is exploded.

    Rows are ordered inside tiles of a sequence; between tiles only each tile's largest end is carried on.
    """
    left = X.pos_left(F.col("start"), F.col("length"), F.col("strand"), F.col("source_length"))
    spans = rows.where("length > 0").select("name", "block_id", "row_idx", left.alias("low"), (left + F.col("length")).alias("high")).withColumn("tile", F.floor(F.col("low") / TILE))
    earlier = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("high").over(earlier("name", "tile").orderBy("low", "high", "block_id", "row_idx"))
    ends = spans.groupBy("name", "tile").agg(F.max("high").alias("high"))
    carried = ends.select("name", "tile", F.max("high").over(earlier("name").orderBy("tile")).alias("carried"))
    seen = spans.withColumn("before", before).join(carried, ["name", "tile"]).where("greatest(before, carried) > low")
    return seen.select("name", "block_id", "row_idx", F.col("low").alias("start"), F.col("high").alias("stop"))


def inconsistent_bases(rows: DataFrame) -> DataFrame:
    """(name, pos) where rows disagree about the base on the + strand; N says nothing."""
    plus = F.upper(F.when(F.col("strand") == "+", F.col("text")).otherwise(X.reverse_complement(F.reverse("text"))))
    # Numbers of characters, not strings, so that minima are hashed and not sorted.
    each = cells(rows.withColumn("text", plus)).where("base <> 'N'").select("name", "pos", F.ascii("base").alias("b"))
    return each.groupBy("name", "pos").agg(F.min("b").alias("low"), F.max("b").alias("high")).where("low <> high").select("name", "pos")


def source_lengths(rows: DataFrame) -> DataFrame:
    """(name, n): names given with n different source lengths."""
    return rows.groupBy("name").agg(F.count_distinct("source_length").alias("n")).where("n > 1")


def text_lengths(rows: DataFrame) -> DataFrame:
    """(block_id, low, high): blocks whose rows have texts of different lengths."""
    return rows.groupBy("block_id").agg(F.min(F.length("text")).cast("long").alias("low"), F.max(F.length("text")).cast("long").alias("high")).where("low <> high")


def _pairs_hold(raw: Column) -> Column:
    """Whether every field after the first is one key=value pair."""
    return F.forall(F.slice(F.split(F.trim(raw), r"[ \t]+"), 2, 1 << 20), lambda t: F.size(F.split(t, "=")) == 2)


def headers(lines: DataFrame) -> DataFrame:
    """(path) of files whose first line, or whose second after a ``track`` line, is no ##maf line of key=value pairs with a version."""
    first, second = (F.max(F.when(F.col("line_no") == k, F.col("raw"))).alias(f"l{k}") for k in (1, 2))
    top = lines.where("line_no <= 2").groupBy("path").agg(first, second)
    track = F.coalesce(F.col("l1").startswith("track"), F.lit(False))
    head = F.when(track, F.col("l2")).otherwise(F.col("l1"))
    fields = F.slice(F.split(F.trim(head), r"[ \t]+"), 2, 1 << 20)
    bare = F.exists(fields, lambda t: t.startswith("=") | t.endswith("="))
    good = head.startswith("##maf") & _pairs_hold(head) & ~bare & F.exists(fields, lambda t: t.startswith("version=")) & (~track | _pairs_hold(F.col("l1")))
    return lines.select("path").distinct().join(top.select("path", F.coalesce(good, F.lit(False)).alias("good")), "path", "left").where("NOT coalesce(good, false)").select("path")


def validate(lines: DataFrame, chrom_names: bool = False, ignore_duplicates: bool = False, check_sequence: bool = False) -> DataFrame:
    """All violations of the lines of the reader. Checking sequences turns the search for duplicate columns off.

    Rules of one line and its neighbours are an array of broken rules for each line, in one pass over the blocks.
    """
    part = F.split(F.trim("raw"), r"[ \t]+")
    n = F.size(part)
    at = lambda i: F.try_element_at(part, F.lit(i + 1))
    number = lambda i: at(i).try_cast("long")
    order = Window.partitionBy("path", "block_id").orderBy("line_idx")
    s, i, e, q, a = (F.col("type") == c for c in "sieqa")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    whole = lambda c: F.coalesce(c.rlike("^[0-9]+$"), F.lit(False))
    status = lambda c, allowed: F.coalesce(c.isin(*allowed), F.lit(False))
    i_ok = (n == 6) & whole(at(3)) & whole(at(5)) & status(at(2), "CINnMT") & status(at(4), "CINnMT") & ((at(2) != "I") | (number(3) > 0)) & ((at(4) != "I") | (number(5) > 0))
    e_ok = (n == 7) & whole(at(2)) & whole(at(3)) & whole(at(5)) & status(at(4), "+-") & status(at(6), "CIMn")
    q_ok = (n == 3) & F.coalesce(at(2).rlike("^[0-9F-]+$"), F.lit(False))
    good = s & (n == 7)
    below = lambda i: F.coalesce(number(i), F.lit(-1)) < 0
    rules = {
        "KeyValuePair": a & ~_pairs_hold(F.col("raw")),
        "FieldNumber": s & (n != 7),
        "StrandCharacter": good & ~status(at(4), "+-"),
        "StartField": good & below(2),
        "SourceSizeField": good & below(5),
        "OutOfRange": good & (number(2) + number(3) > number(5)),
        "ELine": e & ~F.coalesce(e_ok, F.lit(False)),
    }
    if chrom_names:
        rules["SpeciesField"] = good & ~F.coalesce(F.col("name").rlike(r"^(.+?)\.(chr.+)"), F.lit(False))
    listed = lambda r: F.filter(F.array(*[F.when(when, F.lit(rule)) for rule, when in r.items()]), lambda x: x.isNotNull())
    # What a line says by itself is told before lines are dealt by block, so that their text goes along only if messages are asked for.
    own = lines.select(
        "path", "block_id", "line_idx", "line_no", "type", F.col("raw").alias("message"), at(0).alias("word"), at(1).alias("source"), F.length("text").alias("size"), listed(rules).alias("broken"),
        F.coalesce(F.when(i, i_ok).when(q, q_ok), F.lit(False)).alias("fine"), (s & (n == 7) & (F.coalesce(number(3), F.lit(-1)) != X.bases(at(6)))).alias("uneven"),
    )
    x = own.withColumns({"above": F.lag(F.struct("word", "source")).over(order), "opened": F.max(a.cast("int")).over(so_far), "wide": F.max(F.when(s, F.col("size"))).over(every)})
    same_source = F.coalesce((F.col("above.word") == "s") & (F.col("above.source") == F.col("source")), F.lit(False))
    near = {
        "MissingAlignmentBlockLine": (s | i | e | q) & (F.coalesce("opened", F.lit(0)) == 0),
        "AlignmentLength": s & (F.coalesce("uneven", F.lit(False)) | F.coalesce(F.col("size") != F.col("wide"), F.lit(False))),
        "ILine": i & ~(F.col("fine") & same_source),
        "QLine": q & ~(F.col("fine") & same_source),
    }
    out = x.select("path", "line_no", F.explode(F.concat("broken", listed(near))).alias("rule"), "message")
    # A name's first length counts; only names with several are looked at again.
    length = lines.where(s & F.col("source_length").isNotNull()).groupBy("path", "name").agg(F.min_by("source_length", "line_idx").alias("size"), F.min("source_length").alias("low"), F.max("source_length").alias("high")).where("low <> high")
    # Stored, so that their size tells whether they are sent to the lines, few as names mostly are.
    other = lines.where(s).join(stored(length.select("path", "name", "size")), ["path", "name"]).where("source_length <> size")
    out = out.unionByName(other.select("path", "line_no", F.lit("SourceLength").alias("rule"), F.col("raw").alias("message")))
    out = out.unionByName(headers(lines).select("path", F.lit(1).cast("long").alias("line_no"), F.lit("Header").alias("rule"), F.lit("no ##maf line with a version").alias("message")))
    strict = lines.where(s & (F.col("n_fields") == 7) & status(F.col("strand"), "+-") & (F.col("start") >= 0) & F.col("length").isNotNull() & F.col("source_length").isNotNull()).withColumn("row_idx", F.col("line_no"))
    strict = strict.withColumn("name", F.concat_ws("\t", "path", "name"))  # the same name in another file is another sequence
    if check_sequence:
        bad = inconsistent_bases(strict).groupBy("name").agg(F.min("pos").alias("pos"))
        file, name = (F.split("name", "\t")[k] for k in (0, 1))
        out = out.unionByName(bad.select(file.alias("path"), F.lit(None).cast("long").alias("line_no"), F.lit("SequenceConsistency").alias("rule"), F.concat_ws(":", name, F.col("pos").cast("string")).alias("message")))
    elif not ignore_duplicates:
        again = duplicate_columns(strict).select("block_id", F.col("row_idx").alias("line_no"))
        out = out.unionByName(strict.join(again, ["block_id", "line_no"], "left_semi").select("path", "line_no", F.lit("DuplicateColumn").alias("rule"), F.col("raw").alias("message")))
    return out


def empty_files(spark: SparkSession, path: str) -> list[str]:
    """Files without a byte below the path (or glob), which no reader of Spark gives a row for. Only file names are listed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for status in system.globStatus(at) or []:
        files = system.listFiles(status.getPath(), True)
        while files.hasNext():
            file = files.next()
            if file.getLen() == 0 and file.getPath().getName()[0] not in "_.":
                found.append(file.getPath().toString())
    return found


def endings(spark: SparkSession, path: str, lines: DataFrame, one: bool = False) -> DataFrame:
    """EmptyInput and Footer: files without a byte, and files whose last line is neither blank nor a comment outside all blocks."""
    text = placed_text(spark, path, one)
    none = empty_files(spark, path) if not one else [] if text.limit(1).count() else [path]
    rows = [(file, 0, "EmptyInput", "the file is empty") for file in none]
    empty = spark.createDataFrame(rows, "path string, line_no long, rule string, message string")
    text = text.select("path", F.struct("part", "at").alias("at"), F.trim(F.regexp_replace("raw", "\r", "")).alias("value"))
    last = text.groupBy("path").agg(F.max_by("value", "at").alias("last")).where("last <> ''")
    # Its last line that is not blank is the file's last: it stands in a block if an a line does before it in that block.
    block = lines.groupBy("path", "block_id").agg(F.max("line_no").alias("line_no"), F.max((F.col("type") == "a").cast("int")).alias("opened"))
    ends = block.groupBy("path").agg(F.max(F.struct("line_no", "opened")).alias("e"))
    bad = last.join(ends, "path").where((F.col("e.opened") == 1) | ~F.col("last").startswith("#"))
    return empty.unionByName(bad.select("path", F.col("e.line_no").alias("line_no"), F.lit("Footer").alias("rule"), F.col("last").alias("message")))


def validate_files(spark: SparkSession, path: str, one: bool = False, **options: bool) -> DataFrame:
    """All violations of the files of a path, those of whole files included. If ``one``, the files of a folder are one file.

    Numbered lines are stored, as each rule that is not of one line and its neighbours reads them again.
    """
    lines = with_fields(stored(numbered_lines(spark, path, one)))
    return validate(lines, **options).unionByName(endings(spark, path, lines, one))


def first_error(violations: DataFrame) -> str | None:
    top = violations.orderBy(F.col("line_no").asc_nulls_last(), "rule").select("rule").first()
    return top[0] if top else None
