from pyspark.sql import functions as F

from colinear.operators import coverage, reports
from colinear.sources import maf

TEXT = "##maf version=1\n\na score=0\ns a.c 0 4 + 10 ACGT\ns b.c 0 3 + 5 AC-G\n# note\n\na score=1\ns a.c 4 2 + 10 AC\n"


def value(df):
    return [r.value for r in df.orderBy("place").collect()]


def aligned(spark):
    lines = maf.parse_lines(spark.createDataFrame([("x", TEXT)], "path string, value string"))
    return lines, maf.rows(lines)


def test_stats_report(spark):
    lines, rows = aligned(spark)
    result = coverage.file_stats(lines).withColumns({"file_bytes": F.lit(2048), "lines": F.lit(9), "header_lines": F.lit(1)})
    got = "\n".join(value(reports.stats(result, coverage.bases_per_sequence(rows), "x"))).split("\n")
    assert got[:3] == ["x", "-" * 30, "File size:                 2.00 KB"]
    assert "Sequence chars:                  9 ( 90.00%)" in got and "Max block area:                  8" in got
    assert "Blank lines:                     4" in got and "Ave block degree:             1.50" in got
    assert got[-4:] == ["                      a.c:            6 ( 66.67%)", "                      b.c:            3 ( 33.33%)", "                    total:            9 (100.00%)", ""]


def test_coverage_report(spark):
    _, rows = aligned(spark)
    got = value(reports.coverage(coverage.coverage(rows, n_max=2), coverage.genome_lengths(rows), 2))
    assert got[1:] == ["a\tb\t10\t0.300000\t0.000000", "b\ta\t5\t0.600000\t0.000000"] and got[0].endswith("coverage\t\t2-coverage")


def test_pair_and_bed_and_bins_reports(spark):
    _, rows = aligned(spark)
    got = value(reports.pair_coverage(coverage.pair_coverage(rows, "a.*", "b.*"), "a.*", "b.*"))
    assert got[2].split() == ["a.*", "10", "6", "3", "3.000000e-01", "5.000000e-01"] and got[-1].split()[0] == "b.c" and len(got) == 9
    intervals = spark.createDataFrame([("a.c", 0, 2)], "name string, start long, stop long")
    got = value(reports.bed(coverage.pair_regions(rows, "a.*", "b.*", intervals), intervals, "a.*"))
    assert got[3].split() == ["a.*", "2", "2", "1", "1.000000e+00"] and got[4].split()[0] == "a.c"
    got = value(reports.bins(coverage.pair_bins(rows, "a.c", "b.*", 0, 3, 2)))
    assert got[3:] == ["%22d\t%12e" % (0, 1.0), "%22d\t%12e" % (2, 0.5)]


def test_human_size(spark):
    sizes = [(5,), (1024,), (1025,), (3 << 20,), (5 << 30,), (7 << 40,)]
    got = [r.s for r in spark.createDataFrame(sizes, "n long").orderBy("n").select(reports.human_size(F.col("n")).alias("s")).collect()]
    assert got == ["5 Bytes", "1024 Bytes", "1.00 KB", "3.00 MB", "5.00 GB", "7.00 TB"]
