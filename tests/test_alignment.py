import duckdb
import pytest
from pyspark.sql import functions as F

from colinear.functions import exprs as X
from colinear.operators import blocks, closure, compare, coverage, stitch, validate
from colinear.plans import texts  # noqa: F401
from colinear.plans.queries import ORACLES, QUERIES
from colinear.sources import maf

SF = "/root/testdata/sf0.001"
SCHEMA = "block_id long, row_idx long, name string, start long, length long, strand string, source_length long, text string"

TEXT = """track name=x
##maf version=1 scoring=none
# a comment

a score=0
s target.chr0 2 13 + 158545518 gcagctgaa---aaca
s name.chr1   0 10 - 100       ATGT---ATGCCG---

   \t
a score=1
# inside
s name2.chr1  0 5 + 100 ATGTA
i name2.chr1 N 0 C 0
"""


def lines_of(spark, text):
    return maf.parse_lines(spark.createDataFrame([("x", text)], "path string, value string"))


def make(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(block, i, name, start, strand, size, text):
    return (block, i, name, start, len(text.replace("-", "")), strand, size, text)


def test_reader_blocks_and_header(spark):
    got = [(r.block_id, r.type) for r in lines_of(spark, TEXT).orderBy("line_idx").collect()]
    assert got == [(0, "h"), (0, "h"), (0, "#"), (1, "a"), (1, "s"), (1, "s"), (2, "a"), (2, "#"), (2, "s"), (2, "i")]


def test_reader_header_without_blank(spark):
    got = [(r.block_id, r.type) for r in lines_of(spark, "##maf version=1\na score=0\ns a.b 0 1 + 5 A\n").orderBy("line_idx").collect()]
    assert got == [(0, "h"), (1, "a"), (1, "s")]


def test_rows_reject_unreadable_numbers(spark):
    with pytest.raises(Exception, match="unreadable row"):
        maf.rows(lines_of(spark, "##maf version=1\n\na score=0\ns a.b x 1 + 5 A\n")).collect()


def test_round_trip(spark):
    text = maf.blocks_text(lines_of(spark, TEXT)).orderBy("block_id").collect()
    again = lines_of(spark, "\n".join(r.value for r in text))
    assert [r.raw for r in again.orderBy("line_idx").collect()] == [r.raw for r in lines_of(spark, TEXT).orderBy("line_idx").collect()]


def test_reverse_complement_and_flip(spark):
    df = make(spark, [row(1, 0, "target.chr0", 158545457, "-", 158545518, "gcagctgaaaacT")])
    out = blocks.coerce_strand(df, "target", "+").first()
    assert (out.start, out.strand, out.text) == (48, "+", "Agttttcagctgc")


def test_conflicting_strands_stay(spark):
    df = make(spark, [row(1, 0, "t.a", 0, "-", 9, "ACG"), row(1, 1, "t.b", 0, "+", 9, "ACG")])
    assert {r.strand for r in blocks.coerce_strand(df, "t").collect()} == {"-", "+"}


def test_filter_keeps_comments_and_header(spark):
    lines = lines_of(spark, TEXT)
    got = blocks.filter_blocks(lines, include=["target"])
    assert [(r.block_id, r.type) for r in got.orderBy("line_idx").collect()] == [(0, "h"), (0, "h"), (0, "#"), (1, "a"), (1, "s")]
    with pytest.raises(ValueError):
        blocks.filter_blocks(lines, include=["a"], degree_gt=2)


def test_splice_of_a_gap(spark):
    df = make(spark, [row(1, 0, "target.chr0", 2, "+", 100, "gcagctgaa---aaca"), row(1, 1, "n.c", 0, "+", 100, "ATGT---ATGCCGAAA")])
    got = [(r.splice, r.start, r.length, r.text) for r in blocks.extract(df, "target.chr0", 4, 12).where("row_idx = 0").orderBy("splice").collect()]
    assert got == [(0, 4, 7, "agctgaa"), (1, 11, 2, "aa")]


def test_consensus_skips_first_row(spark):
    df = make(spark, [row(1, 0, "a.a", 0, "+", 9, "AA-"), row(1, 1, "b.a", 0, "+", 9, "CG-"), row(1, 2, "c.a", 0, "+", 9, "CA-")])
    assert [r.code for r in blocks.consensus(df).orderBy("col").collect()] == ["C", "R", "N"]


def test_masks_of_long_texts(spark):
    text = "ACGT-" * 40
    df = make(spark, [row(1, 0, "a.a", 0, "+", 999, text), row(1, 1, "b.a", 0, "+", 999, text[1:] + "A")])
    want = sum(x != "-" and y != "-" for x, y in zip(text, text[1:] + "A", strict=True))
    assert coverage.aligned_pairs(df, "a.a", "b.a").first().aligned == want


def test_comparison_known_values(spark):
    a = make(spark, [row(1, 0, "t1.c", 0, "+", 100, "ACGTACGTAC"), row(1, 1, "t2.c", 0, "+", 100, "ACGTACGTAC")])
    shifted = make(spark, [row(1, 0, "t1.c", 0, "+", 100, "ACGTACGTAC"), row(1, 1, "t2.c", 1, "+", 100, "ACGTACGTAC")])
    total = lambda x, near: [(r.total, r.hits) for r in compare.compare(a, x, near).where("seq1 = 't1.c' AND seq2 = 't2.c' AND direction = 'AB'").collect()]
    assert total(a, 0) == [(10, 10)]
    assert total(shifted, 0) == [(10, 0)]
    assert total(shifted, 1) == [(10, 10)]


def test_validator(spark):
    good = "##maf version=1\n\na score=0\ns a.chr1 0 3 + 9 ACG\ns b.chr1 0 3 - 9 ACG\n"
    assert validate.validate(lines_of(spark, good)).count() == 0
    bad = {
        "FieldNumber": good.replace("9 ACG\ns b", "9\ns b"), "StrandCharacter": good.replace(" - ", " x "), "AlignmentLength": good.replace("0 3 -", "0 4 -"),
        "OutOfRange": good.replace("b.chr1 0 3", "b.chr1 7 3"), "Header": good.replace(" version=1", ""), "KeyValuePair": good.replace("score=0", "score"),
        "DuplicateColumn": good + "\na score=1\ns a.chr1 1 3 + 9 CGT\n", "SourceLength": good + "\na score=1\ns a.chr1 5 3 + 10 CGT\n",
    }
    for rule, text in bad.items():
        assert rule in {r.rule for r in validate.validate(lines_of(spark, text)).collect()}, rule


def test_stitch_break_and_insertion(spark):
    df = make(spark, [row(1, 0, "r.c", 0, "+", 99, "ACGT"), row(1, 1, "q.c", 0, "+", 99, "AC-T"), row(2, 0, "r.c", 6, "+", 99, "GG"), row(2, 1, "q.c", 80, "+", 99, "GG")])
    fasta = spark.createDataFrame([("r.c", "ACGTTTGG"), ("q.c", "A" * 99)], "name string, seq string")
    got = {r.species: r.text for r in stitch.stitch(df, fasta, 3, 5).collect()}
    assert got == {"r": "ACGTTT---GG", "q": "AC-T--NNNGG"}


def test_closure_of_chained_pairs(spark):
    df = make(spark, [row(1, 0, "a.c", 0, "+", 50, "ACGT"), row(1, 1, "b.c", 10, "+", 50, "ACGT"), row(2, 0, "b.c", 10, "+", 50, "ACGT"), row(2, 1, "d.c", 5, "-", 50, "ACGT")])
    got = {(r.name, r.start, r.length, r.strand) for r in closure.transitive_closure(df).collect()}
    assert got == {("a.c", 0, 4, "+"), ("b.c", 10, 4, "+"), ("d.c", 5, 4, "-")}


def test_fasta_and_bed(spark, tmp_path):
    (tmp_path / "x.fa").write_text("> one more\nACGT\nAC\n>two\nGG\n")
    assert {(r.name, r.seq) for r in maf.read_fasta(spark, str(tmp_path / "x.fa")).collect()} == {("one", "ACGTAC"), ("two", "GG")}
    (tmp_path / "x.bed").write_text("a 1 5\na 4 8\n")
    with pytest.raises(Exception, match="overlapping"):
        maf.read_bed(spark, str(tmp_path / "x.bed")).collect()


def test_vignette(spark):
    df = make(spark, [row(1, 0, "a.b", 0, "+", 99, "ACGTACG-TACGTA")]).select(X.vignette(F.col("text"), F.lit(7)).alias("v"))
    assert df.first().v == "...GTACG ->T<- ACGTA"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "events", "part", "orders"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    key = lambda rows, at: sorted(tuple(str(r[i]) for i in at) for r in rows)
    assert key(df.collect(), [df.columns.index(c) for c in cols]) == key(rel.fetchall(), [rel.columns.index(c) for c in cols])
