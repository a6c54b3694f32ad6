import pytest
from pyspark.sql import functions as F

from colinear.operators import blocks
from colinear.sources import maf
from colinear.streaming import files

CASES = [
    "track name=x\n##maf version=1\n# c\n\na score=0\ns a.b 0 4 + 9 AC-GT\n\n \t\n\na score=1\n# in\ns a.b 4 2 - 9 AC\r\ni a.b N 0 C 0\n",
    "##maf version=1\na score=0\ns a.b 0 2 + 9 AC\na score=1\ns c.d 0 2 + 9 AC",
    "\n\n##maf version=1\n\na\ns a.b 0 2 + 9 AC\n\n\n",
    "",
    "##maf version=1\n# only a header",
    "##maf version=1\n" + "".join(f"a score={i}\n" + f"s x.y {i} 3 + 900 ACG\ns z.w {i} 3 - 900 A-CG\n" * 2 + "\n" * (i % 3 + 1) for i in range(60)),
]
WANT = ["path", "block_id", "line_idx", "line_no", "type", "raw", "name", "start", "length", "strand", "source_length", "text", "n_fields"]


def plain(text):
    """(block_id, line_idx, raw) by a loop over the lines."""
    out, block, body, blank = [], 0, False, False
    for i, raw in enumerate(text.replace("\r", "").split("\n")):
        now = not raw.strip()
        if not now and ((body and blank) or (not body and raw.startswith("a"))):
            block += 1
        body = body or now or raw.startswith("a")
        if not now:
            out.append((block, i, raw))
        blank = now
    return out


def kept(df):
    assert df.columns == WANT
    return sorted((r.block_id, r.line_idx, r.raw) for r in df.collect())


@pytest.mark.parametrize("case", range(len(CASES)))
def test_readers_agree(spark, tmp_path, case):
    (tmp_path / "x.maf").write_bytes(CASES[case].encode())
    whole = spark.createDataFrame([("x", CASES[case])], "path string, value string")
    assert kept(maf.parse_lines(whole)) == kept(maf.parse_each(whole)) == plain(CASES[case])
    assert kept(maf.read_lines(spark, str(tmp_path / "x.maf"))) == plain(CASES[case])


@pytest.mark.parametrize("size", [7, 64, 333])
def test_byte_ranges(spark, tmp_path, size):
    for i, case in enumerate(CASES):
        (tmp_path / f"{i}.maf").write_bytes(case.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = maf.read_lines(spark, str(tmp_path)).select(F.substring_index("path", "/", -1).alias("path"), "block_id", "line_idx", "raw").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    want, before = [], 0
    for i, case in enumerate(CASES):
        want += [(f"{i}.maf", b and b + before, k, raw) for b, k, raw in plain(case)]
        before += max((b for b, _, _ in plain(case)), default=0)
    assert sorted(map(tuple, got)) == sorted(want)


def test_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, case in enumerate(CASES):
        (tmp_path / "in" / f"{i}.maf").write_bytes(case.encode())
    seen = []
    lines = files.stream_lines(spark, str(tmp_path / "in"), files_per_trigger=2)
    stripped = lambda df: blocks.filter_blocks(df, degree_lt=2)
    query = files.per_batch(files.stream_filter(lines, include=["x"]), stripped, lambda df, n: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.line_idx for r in seen) == [i for b, i, raw in plain(CASES[5]) if raw.startswith("s x")]
    assert {r.path.rsplit("/", 1)[-1] for r in seen} == {"5.maf"}


def test_stream_of_names_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, case in enumerate(CASES):
        (tmp_path / "in" / f"{i}.maf").write_bytes(case.encode())
    seen = []
    query = files.per_file_batch(spark, str(tmp_path / "in"), lambda df: df, lambda df, n: seen.extend(df.collect()), 2).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted((f"{i}.maf", k, raw) for i, case in enumerate(CASES) for _, k, raw in plain(case))
    assert sorted((r.path.rsplit("/", 1)[-1], r.line_idx, r.raw) for r in seen) == want


def test_event_bins_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.range(1).select(F.lit(10**9).alias("event_id").cast("long"), F.expr("timestamp '2100-01-01 00:00:00'").alias("ts"), F.lit(1).cast("long").alias("user_id")).write.mode("append").parquet(str(tmp_path / "in"))
    stream = files.event_bins(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    query = stream.writeStream.format("memory").queryName("binned").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    want = events.groupBy((F.col("user_id") % 16).alias("shard"), F.date_trunc("hour", "ts").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    assert sorted(map(tuple, spark.table("binned").collect())) == sorted(map(tuple, want.collect()))


def test_order_by_gaps(spark):
    df = maf.parse_lines(spark.createDataFrame([("x", "##maf version=1\n\na\ns a.b 0 2 + 9 A-C-\n# note\ns c.d 0 4 + 9 ACGT\ns e.f 0 3 + 9 ACG-\ns g.h 0 4 + 9 ACGT\n")], "path string, value string"))
    got = [r.raw.split()[1] if r.type == "s" else r.type for r in blocks.order_by_gaps(df).where("block_id = 1").orderBy("place").collect()]
    assert got == ["a", "#", "c.d", "g.h", "e.f", "a.b"]
