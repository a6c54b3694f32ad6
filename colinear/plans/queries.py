"""Registered queries of the alignment operators over the driver's tables, each with SQL written apart from the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import blocks, closure, compare, coverage, stitch, validate
from .synth import B, WITH, alignment, lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, shared: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = (WITH if shared else "") + sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


LEFT = "CASE WHEN strand = '+' THEN start ELSE source_length - (start + length) END"
FLIPPED = "translate(reverse(text), 'ACGT', 'TGCA')"


@query("SELECT block_id, row_idx, name FROM a WHERE name LIKE 'sp1%' OR name LIKE 'sp2.chr0%'")
def filter_include(spark, d):
    x = blocks.filter_blocks(lines(spark, d), include=["sp1", "sp2.chr0"])
    return x.where("type = 's'").select("block_id", (F.col("line_idx") - 1).alias("row_idx"), "name")


@query("SELECT block_id, row_idx, name FROM a WHERE NOT (name LIKE 'sp1%' OR name LIKE 'sp2.chr0%')")
def filter_exclude(spark, d):
    x = blocks.filter_blocks(lines(spark, d), exclude=["sp1", "sp2.chr0"])
    return x.where("type = 's'").select("block_id", (F.col("line_idx") - 1).alias("row_idx"), "name")


@query("SELECT block_id, row_idx, name FROM a WHERE block_id IN (SELECT block_id FROM a GROUP BY block_id HAVING count(*) BETWEEN 3 AND 5)")
def filter_degree(spark, d):
    x = blocks.filter_blocks(lines(spark, d), degree_lt=3, degree_gt=5)
    return x.where("type = 's'").select("block_id", (F.col("line_idx") - 1).alias("row_idx"), "name")


@query("""SELECT block_id, row_idx, name, row_number() OVER (PARTITION BY block_id ORDER BY o, row_idx) - 1 AS place
FROM (SELECT *, CASE WHEN name LIKE 'sp3%' THEN 0 WHEN name LIKE 'sp1.chr1%' THEN 1 WHEN name LIKE 'sp1%' THEN 2 END AS o FROM a) AS x WHERE o IS NOT NULL""")
def row_order(spark, d):
    return blocks.order_rows(alignment(spark, d), ["sp3", "sp1.chr1", "sp1"]).select("block_id", "row_idx", "name", "place")


@query("SELECT block_id, row_idx, name, row_number() OVER (PARTITION BY block_id ORDER BY length(text) - length(replace(text, '-', '')), row_idx) AS place FROM a")
def gap_order(spark, d):
    return blocks.order_by_gaps(lines(spark, d)).where("type = 's'").select("block_id", (F.col("line_idx") - 1).alias("row_idx"), "name", "place")


@query(f"SELECT block_id, max(CASE WHEN name LIKE 'sp0%' THEN {LEFT} END) AS key FROM a GROUP BY block_id")
def block_sort(spark, d):
    return blocks.sort_blocks(alignment(spark, d), "sp0").select("block_id", "key")


@query(f"""SELECT block_id, row_idx, name, CASE WHEN f THEN source_length - (start + length) ELSE start END AS start, CASE WHEN f THEN CASE WHEN strand = '+' THEN '-' ELSE '+' END ELSE strand END AS strand, CASE WHEN f THEN {FLIPPED} ELSE text END AS text
FROM (SELECT a.*, coalesce(x.f, false) AS f FROM a LEFT JOIN (SELECT block_id, bool_and(strand = '-') AS f FROM a WHERE name LIKE 'sp2%' GROUP BY block_id) AS x ON a.block_id = x.block_id) AS y""")
def strand_coerce(spark, d):
    return blocks.coerce_strand(alignment(spark, d), "sp2", "+").select("block_id", "row_idx", "name", "start", "strand", "text")


@query(f"SELECT block_id, row_idx, {FLIPPED} AS flipped, split_part(name, '.', 1) AS species, split_part(name, '.', 2) AS chrom FROM a")
def revcomp(spark, d):
    return alignment(spark, d).select("block_id", "row_idx", X.reverse_complement(F.col("text")).alias("flipped"), X.species(F.col("name")).alias("species"), X.chromosome(F.col("name")).alias("chrom"))


@query(f"SELECT block_id, row_idx, {LEFT} AS pos_left, CASE WHEN strand = '+' THEN start ELSE source_length - start - 1 END AS pos_start FROM a")
def pos_coords(spark, d):
    c = [F.col(x) for x in ("start", "length", "strand", "source_length")]
    return alignment(spark, d).select("block_id", "row_idx", X.pos_left(*c).alias("pos_left"), X.pos_start(c[0], c[2], c[3]).alias("pos_start"))


@query(f"""SELECT block_id, row_idx, (CASE WHEN o - 5 > 0 THEN '...' ELSE '' END) || substr(t, greatest(o - 5, 0) + 1, o - greatest(o - 5, 0)) || ' ->' || substr(t, o + 1, 1) || '<- ' || substr(t, o + 2, 5) || (CASE WHEN o + 6 < length(t) THEN '...' ELSE '' END) AS vignette
FROM (SELECT *, cast(CASE WHEN strand = '+' THEN 510 - l ELSE l + length - 1 - 510 END AS bigint) AS o FROM (SELECT *, {LEFT} AS l, replace(text, '-', '') AS t FROM a WHERE name = 'sp1.chr1') AS x WHERE l <= 510 AND l + length - 1 >= 510) AS y""")
def position_find(spark, d):
    return blocks.find_position(alignment(spark, d), "sp1.chr1", 510).select("block_id", "row_idx", "vignette")


@query(f"SELECT block_id, row_idx, name FROM a WHERE block_id IN (SELECT block_id FROM a WHERE name = 'sp1.chr1' AND {LEFT} <= 300 AND {LEFT} + length - 1 >= 200)")
def region_soft(spark, d):
    return blocks.extract_soft(alignment(spark, d), "sp1.chr1", 300, 200).select("block_id", "row_idx", "name")


@query(""", t AS (SELECT DISTINCT block_id, col FROM ca WHERE name = 'sp1.chr1' AND pos BETWEEN 200 AND 300),
i AS (SELECT block_id, col, col - row_number() OVER (PARTITION BY block_id ORDER BY col) AS g FROM t),
r AS (SELECT block_id, min(col) AS l, max(col) AS r, row_number() OVER (PARTITION BY block_id ORDER BY min(col)) - 1 AS splice FROM i GROUP BY block_id, g)
SELECT a.block_id, splice, row_idx, name, start + length(replace(substr(text, 1, l), '-', '')) AS start, cast(length(replace(substr(text, l + 1, r - l + 1), '-', '')) AS bigint) AS length, substr(text, l + 1, r - l + 1) AS text
FROM a JOIN r ON a.block_id = r.block_id WHERE length(replace(substr(text, l + 1, r - l + 1), '-', '')) > 0""".replace(", t AS", ", t AS", 1))
def region_splice(spark, d):
    return blocks.extract(alignment(spark, d), "sp1.chr1", 200, 300).select("block_id", "splice", "row_idx", "name", "start", "length", "text")


ORACLES["region_splice"] = WITH.rstrip() + ORACLES["region_splice"][len(WITH):]


@query("""SELECT count(*) AS blocks, cast(sum(s) AS bigint) AS s_lines, cast(sum(b) AS bigint) AS base_chars, cast(sum(c - b) AS bigint) AS gap_chars, cast(sum(w) AS bigint) AS columns, cast(max(s) AS bigint) AS max_degree, cast(max(w * s) AS bigint) AS max_area
FROM (SELECT block_id, count(*) AS s, sum(length) AS b, sum(length(text)) AS c, max(length(text)) AS w FROM a GROUP BY block_id) AS x""")
def file_stats(spark, d):
    return coverage.file_stats(lines(spark, d)).select("blocks", "s_lines", "base_chars", "gap_chars", "columns", "max_degree", "max_area")


@query("SELECT name, cast(sum(length) AS bigint) AS bases, round(cast(sum(length) AS double) / (SELECT sum(length) FROM a), 9) AS share FROM a GROUP BY name")
def bases_per_seq(spark, d):
    return coverage.bases_per_sequence(alignment(spark, d)).select("name", "bases", F.round("share", 9).alias("share"))


CONSENSUS = """, u AS (SELECT block_id, row_idx, name, text, unnest(range(length(text))) AS col FROM a),
n AS (SELECT block_id, col, sum(CASE WHEN row_idx > 0 AND substr(text, col + 1, 1) = 'A' THEN 1 ELSE 0 END) AS a1, sum(CASE WHEN row_idx > 0 AND substr(text, col + 1, 1) = 'C' THEN 1 ELSE 0 END) AS c1,
  sum(CASE WHEN row_idx > 0 AND substr(text, col + 1, 1) = 'G' THEN 1 ELSE 0 END) AS g1, sum(CASE WHEN row_idx > 0 AND substr(text, col + 1, 1) = 'T' THEN 1 ELSE 0 END) AS t1 FROM u GROUP BY block_id, col),
k AS (SELECT block_id, col, CASE WHEN m = 0 THEN 'N' ELSE substr('NACMGRSVTWYHKDBN', cast(1 + (a1 = m)::int + 2 * (c1 = m)::int + 4 * (g1 = m)::int + 8 * (t1 = m)::int AS bigint), 1) END AS code FROM (SELECT *, greatest(a1, c1, g1, t1) AS m FROM n) AS x)
"""


@query(CONSENSUS + "SELECT block_id, col, code FROM k")
def column_consensus(spark, d):
    return blocks.consensus(alignment(spark, d))


@query(CONSENSUS + """, s AS (SELECT u.block_id, u.row_idx, split_part(name, '.', 1) AS sp, round(sum(CASE WHEN code IN ('A', 'C', 'G', 'T') AND code = b THEN 2.0
   WHEN (code = 'M' AND b IN ('A', 'C')) OR (code = 'R' AND b IN ('A', 'G')) OR (code = 'W' AND b IN ('A', 'T')) OR (code = 'S' AND b IN ('C', 'G')) OR (code = 'Y' AND b IN ('C', 'T')) OR (code = 'K' AND b IN ('G', 'T')) THEN 1.0
   WHEN (code = 'V' AND b <> 'T') OR (code = 'H' AND b <> 'G') OR (code = 'D' AND b <> 'C') OR (code = 'B' AND b <> 'A') THEN cast(0.41503749927884 AS double) ELSE 0.0 END), 9) AS score
  FROM (SELECT *, substr(text, col + 1, 1) AS b FROM u) AS u JOIN k ON u.block_id = k.block_id AND u.col = k.col GROUP BY 1, 2, 3)
SELECT block_id, row_idx FROM (SELECT *, row_number() OVER (PARTITION BY block_id, sp ORDER BY score DESC, row_idx) AS rn FROM s) AS z WHERE rn = 1""")
def dup_filter(spark, d):
    return blocks.filter_duplicates(alignment(spark, d)).select("block_id", "row_idx")


for _name in ("column_consensus", "dup_filter"):
    ORACLES[_name] = WITH.rstrip() + ORACLES[_name][len(WITH):]


@query("SELECT x.name AS name1, y.name AS name2, count(*) AS aligned FROM ca AS x JOIN ca AS y ON x.block_id = y.block_id AND x.col = y.col GROUP BY 1, 2")
def pair_coverage(spark, d):
    return coverage.aligned_pairs(alignment(spark, d), "*", "*")


@query("""SELECT n.side, n.name, n.source_length, n.observed, cast(coalesce(h.aligned, 0) AS bigint) AS aligned, round(coalesce(h.aligned, 0) / cast(n.source_length AS double), 9) AS coverage, round(coalesce(h.aligned, 0) / cast(n.observed AS double), 9) AS observed_coverage FROM (
 SELECT 1 AS side, name, max(source_length) AS source_length, cast(sum(length) AS bigint) AS observed FROM a WHERE name = 'sp1.chr1' GROUP BY name UNION ALL
 SELECT 2, name, max(source_length), cast(sum(length) AS bigint) FROM a WHERE name LIKE 'sp2.%' GROUP BY name) AS n
LEFT JOIN (SELECT s AS side, CASE WHEN s = 1 THEN n1 ELSE n2 END AS name, sum(c) AS aligned FROM (SELECT x.name AS n1, y.name AS n2, count(*) AS c FROM ca AS x JOIN ca AS y ON x.block_id = y.block_id AND x.col = y.col WHERE x.name = 'sp1.chr1' AND y.name LIKE 'sp2.%' GROUP BY 1, 2) AS p, (VALUES (1), (2)) AS v(s) GROUP BY 1, 2) AS h
ON n.side = h.side AND n.name = h.name""")
def pair_coverage_totals(spark, d):
    x = coverage.pair_coverage(alignment(spark, d), "sp1.chr1", "sp2.*")
    return x.select("side", "name", "source_length", "observed", "aligned", F.round("coverage", 9).alias("coverage"), F.round("observed_coverage", 9).alias("observed_coverage"))


@query("""SELECT g AS bin, g * 100 + 50 AS bin_start, coalesce(n, 0) / cast(100 AS double) AS value FROM range(12) AS r(g) LEFT JOIN
(SELECT (x.pos - 50) // 100 AS bin, count(*) AS n FROM ca AS x JOIN ca AS y ON x.block_id = y.block_id AND x.col = y.col WHERE x.name = 'sp1.chr1' AND y.name LIKE 'sp2.%' AND x.pos BETWEEN 50 AND 1249 GROUP BY 1) AS h ON g = bin""")
def pair_coverage_bins(spark, d):
    return coverage.pair_bins(alignment(spark, d), "sp1.chr1", "sp2.*", 50, 1249, 100)


def _bed(spark):
    return spark.createDataFrame([(f"sp{s}.chr{c}", k, k + 60) for s in range(5) for c in range(3) for k in range(s * 10, 1900, 150)], "name string, start long, stop long")


IN_BED = "(({p} - s * 10) % 150 < 60 AND {p} >= s * 10 AND s * 10 + ({p} - s * 10) // 150 * 150 < 1900)"


def _in_bed(side, own, other):
    return f"""SELECT {side} AS side, name, cast(sum(CASE WHEN i THEN 1 ELSE 0 END) AS bigint) AS in_region, cast(sum(CASE WHEN i THEN 0 ELSE 1 END) AS bigint) AS out_region FROM (
SELECT x.name, {IN_BED.format(p='x.pos')} AS i FROM (SELECT *, cast(substr(name, 3, 1) AS bigint) AS s FROM ca) AS x JOIN ca AS y ON x.block_id = y.block_id AND x.col = y.col WHERE x.name LIKE '{own}%' AND y.name LIKE '{other}%') AS z GROUP BY name"""


@query(_in_bed(1, "sp1.", "sp2.") + " UNION ALL " + _in_bed(2, "sp2.", "sp1."))
def pair_coverage_bed(spark, d):
    return coverage.pair_regions(alignment(spark, d), "sp1.*", "sp2.*", _bed(spark))


def _depth(same: str, n: str) -> str:
    return f"""SELECT query, target, n, round(cast(count(*) AS double) / max(total), 9) AS coverage FROM (
 SELECT split_part(x.name, '.', 1) AS query, split_part(y.name, '.', 1) AS target, x.name, x.pos, least(count(*), 127) AS depth FROM ca AS x JOIN ca AS y ON x.block_id = y.block_id AND x.col = y.col AND x.row_idx <> y.row_idx {same} GROUP BY 1, 2, 3, 4) AS dd
JOIN range(1, {n}) AS r(n) ON n <= depth JOIN (SELECT split_part(name, '.', 1) AS g, sum(source_length) AS total FROM (SELECT DISTINCT name, source_length FROM a) AS q GROUP BY 1) AS t ON g = query GROUP BY 1, 2, 3"""


def _rounded(x):
    return x.withColumn("coverage", F.round("coverage", 9))


@query(_depth("", "2"))
def genome_coverage(spark, d):
    return _rounded(coverage.coverage(alignment(spark, d)))


@query(_depth("", "6"))
def n_coverage(spark, d):
    return _rounded(coverage.coverage(alignment(spark, d), n_max=5))


@query(_depth("AND x.base = y.base", "2"))
def identity_coverage(spark, d):
    return _rounded(coverage.coverage(alignment(spark, d), identity=True))


@query("SELECT cast(sum(k * (k - 1) // 2) AS bigint) AS pairs FROM (SELECT block_id, col, count(*) AS k FROM ca GROUP BY 1, 2) AS x")
def pair_count(spark, d):
    return coverage.pair_count(alignment(spark, d))


PAIRS = """SELECT DISTINCT CASE WHEN (x.name, x.pos) <= (y.name, y.pos) THEN x.name ELSE y.name END AS seq1, CASE WHEN (x.name, x.pos) <= (y.name, y.pos) THEN x.pos ELSE y.pos END AS pos1, CASE WHEN (x.name, x.pos) <= (y.name, y.pos) THEN y.name ELSE x.name END AS seq2, CASE WHEN (x.name, x.pos) <= (y.name, y.pos) THEN y.pos ELSE x.pos END AS pos2 FROM {c} AS x JOIN {c} AS y ON x.block_id = y.block_id AND x.col = y.col AND x.row_idx < y.row_idx"""
TWO = WITH.rstrip() + f", p AS ({PAIRS.format(c='ca')}), q AS ({PAIRS.format(c='cb')})"
EXACT = ", h AS (SELECT p.*, q.seq1 IS NOT NULL AS hit FROM p LEFT JOIN q ON p.seq1 = q.seq1 AND p.pos1 = q.pos1 AND p.seq2 = q.seq2 AND p.pos2 = q.pos2)\n"
COUNTS = "count(*) AS total, cast(sum(hit::int) AS bigint) AS hits"


def _two(spark, d, near=0, bed=None):
    """Totals of the pairs of the first alignment tested in the second."""
    a, b = alignment(spark, d), alignment(spark, d, B)
    names = compare.numbered(compare.legit_names(a, b))
    return compare.counted(compare.tiles(a, b, names, near), names, near, bed).where("direction = 'AB'").drop("direction")


@query(TWO + EXACT + f"SELECT seq1, seq2, {COUNTS} FROM h GROUP BY 1, 2", shared=False)
def homology_exact(spark, d):
    return _two(spark, d)


@query(TWO + """, h AS (SELECT p.*, EXISTS (SELECT 1 FROM q WHERE q.seq1 = p.seq1 AND q.seq2 = p.seq2 AND q.pos1 = p.pos1 AND q.pos2 BETWEEN p.pos2 - 1 AND p.pos2 + 1)
 OR EXISTS (SELECT 1 FROM q WHERE q.seq1 = p.seq1 AND q.seq2 = p.seq2 AND q.pos2 = p.pos2 AND q.pos1 BETWEEN p.pos1 - 1 AND p.pos1 + 1) AS hit FROM p)
""" + f"SELECT seq1, seq2, {COUNTS} FROM h GROUP BY 1, 2", shared=False)
def homology_near(spark, d):
    return _two(spark, d, 1)


REGION = f"(SELECT *, {IN_BED.replace('s * 10', 's1 * 10').format(p='pos1')} AS i1, {IN_BED.replace('s * 10', 's2 * 10').format(p='pos2')} AS i2 FROM (SELECT *, cast(substr(seq1, 3, 1) AS bigint) AS s1, cast(substr(seq2, 3, 1) AS bigint) AS s2 FROM h) AS w) AS z"


@query(TWO + EXACT + f"""SELECT seq1, seq2, {COUNTS}, cast(sum((i1 AND i2)::int) AS bigint) AS total_both, cast(sum((i1 AND i2 AND hit)::int) AS bigint) AS hits_both, cast(sum((i1 AND NOT i2)::int) AS bigint) AS "total_A", cast(sum((i1 AND NOT i2 AND hit)::int) AS bigint) AS "hits_A",
cast(sum((NOT i1 AND i2)::int) AS bigint) AS "total_B", cast(sum((NOT i1 AND i2 AND hit)::int) AS bigint) AS "hits_B", cast(sum((NOT i1 AND NOT i2)::int) AS bigint) AS total_neither, cast(sum((NOT i1 AND NOT i2 AND hit)::int) AS bigint) AS hits_neither FROM {REGION} GROUP BY 1, 2""", shared=False)
def homology_bed(spark, d):
    return _two(spark, d, bed=_bed(spark))


@query(TWO + EXACT + f"""SELECT 'aggregate' AS seq1, 'aggregate' AS seq2, {COUNTS} FROM h UNION ALL SELECT 'self', 'self', {COUNTS} FROM h WHERE seq1 = seq2
UNION ALL SELECT n, 'aggregate', {COUNTS} FROM (SELECT seq1 AS n, hit FROM h UNION ALL SELECT seq2, hit FROM h WHERE seq1 <> seq2) AS w GROUP BY 1""", shared=False)
def homology_rollup(spark, d):
    return compare.rollup(_two(spark, d))


def _bins(tests: str, d: str) -> str:
    """Bins of 100 of each test's place in its reference, for references sp1.chr1 and sp0.* and partners sp2.* and sp3.chr0."""
    wanted = "((r = 'sp1.chr1' AND p LIKE 'sp2.%') OR (r LIKE 'sp0.%' AND p = 'sp3.chr0'))"
    return f"SELECT r, p, pos // 100 AS bin, sum(hit::int) AS present_{d}, sum((NOT hit)::int) AS absent_{d} FROM (SELECT seq1 AS r, seq2 AS p, pos1 AS pos, hit FROM {tests} UNION ALL SELECT seq2, seq1, pos2, hit FROM {tests} WHERE seq1 <> seq2) AS w WHERE {wanted} GROUP BY 1, 2, 3"


BACK = EXACT.rstrip() + ", k AS (SELECT q.*, p.seq1 IS NOT NULL AS hit FROM q LEFT JOIN p ON p.seq1 = q.seq1 AND p.pos1 = q.pos1 AND p.seq2 = q.seq2 AND p.pos2 = q.pos2)\n"


@query(TWO + BACK + f"""SELECT g.r AS reference, g.p AS partner, g.bin, {', '.join(f'cast(coalesce({c}, 0) AS bigint) AS {c}' for c in ('present_ab', 'absent_ab', 'present_ba', 'absent_ba'))}
FROM (SELECT x.name AS r, y.name AS p, b AS bin FROM (SELECT DISTINCT name FROM a) AS x, (SELECT DISTINCT name FROM a) AS y, range(20) AS z(b) WHERE (x.name = 'sp1.chr1' AND y.name LIKE 'sp2.%') OR (x.name LIKE 'sp0.%' AND y.name = 'sp3.chr0')) AS g
LEFT JOIN ({_bins('h', 'ab')}) AS m ON g.r = m.r AND g.p = m.p AND g.bin = m.bin LEFT JOIN ({_bins('k', 'ba')}) AS n ON g.r = n.r AND g.p = n.p AND g.bin = n.bin""", shared=False)
def wiggle_bins(spark, d):
    a, b = alignment(spark, d), alignment(spark, d, B)
    wanted = compare.wiggle_pairs(a.select("name", "source_length").distinct(), [("sp1.chr1", "sp2.*"), ("sp0.*", "sp3.chr0")])
    return compare.wiggles(*compare.tested(a, b, among=wanted), wanted, 100)


@query(TWO + BACK + f"SELECT 'AB' AS direction, seq1, seq2, {COUNTS} FROM h GROUP BY 2, 3 UNION ALL SELECT 'BA', seq1, seq2, {COUNTS} FROM k GROUP BY 2, 3", shared=False)
def homology_both_ways(spark, d):
    x = compare.compare(alignment(spark, d), alignment(spark, d, B))
    return x.where("seq2 <> 'aggregate' AND seq1 <> 'self'").select("direction", "seq1", "seq2", "total", "hits")


@query("SELECT DISTINCT name FROM a WHERE name IN (SELECT name FROM b WHERE block_id % 2 = 0 AND name NOT LIKE 'sp4%')")
def legit_names(spark, d):
    return compare.legit_names(alignment(spark, d), alignment(spark, d, B).where("block_id % 2 = 0 AND name NOT LIKE 'sp4%'"))


@query(f"""SELECT name, block_id, row_idx, l AS start, h AS stop FROM (SELECT *, max(h) OVER (PARTITION BY name ORDER BY l, h, block_id, row_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT name, block_id, row_idx, {LEFT} AS l, {LEFT} + length AS h FROM a) AS x) AS y WHERE b > l""")
def validate_dup_columns(spark, d):
    return validate.duplicate_columns(alignment(spark, d))


@query("SELECT name, count(DISTINCT source_length + CASE WHEN block_id % 50 = 0 THEN 1 ELSE 0 END) AS n FROM a GROUP BY name HAVING count(DISTINCT source_length + CASE WHEN block_id % 50 = 0 THEN 1 ELSE 0 END) > 1")
def validate_source_length(spark, d):
    return validate.source_lengths(alignment(spark, d).withColumn("source_length", F.expr("source_length + CASE WHEN block_id % 50 = 0 THEN 1 ELSE 0 END")))


@query("SELECT block_id, cast(min(length(t)) AS bigint) AS low, cast(max(length(t)) AS bigint) AS high FROM (SELECT block_id, CASE WHEN block_id % 7 = 0 AND row_idx = 1 THEN substr(text, 1, 30) ELSE text END AS t FROM a) AS x GROUP BY 1 HAVING min(length(t)) <> max(length(t))")
def validate_text_length(spark, d):
    return validate.text_lengths(alignment(spark, d).withColumn("text", F.expr("CASE WHEN block_id % 7 = 0 AND row_idx = 1 THEN substr(text, 1, 30) ELSE text END")))


@query("SELECT name, pos FROM (SELECT name, pos, CASE WHEN strand = '+' THEN base ELSE translate(base, 'ACGT', 'TGCA') END AS b FROM ca) AS x GROUP BY 1, 2 HAVING min(b) <> max(b)")
def validate_consistency(spark, d):
    return validate.inconsistent_bases(alignment(spark, d))


@query("""SELECT block_id, row_idx, species, kind, cast(CASE WHEN kind = 'interstitial' THEN start - r - 1 WHEN kind = 'none' THEN 0 ELSE 6 END AS bigint) AS width FROM (
SELECT *, CASE WHEN ps <> strand THEN 'strand' WHEN pn <> name THEN 'name' WHEN r + 20 < start THEN 'distance' WHEN start > r + 1 THEN 'interstitial' ELSE 'none' END AS kind FROM (
 SELECT *, lag(strand) OVER w AS ps, lag(name) OVER w AS pn, lag(start + length - 1) OVER w AS r FROM (SELECT *, split_part(name, '.', 1) AS species FROM a) AS s WINDOW w AS (PARTITION BY species ORDER BY block_id, row_idx)) AS x WHERE pn IS NOT NULL) AS y""")
def stitch_events(spark, d):
    return stitch.events(alignment(spark, d), 6, 20).select("block_id", "row_idx", "species", "kind", "width")


@query()
def transitive_closure(spark, d):
    return closure.transitive_closure(alignment(spark, d))


@query("SELECT user_id % 16 AS shard, cast(floor(epoch(ts) / 3600) AS bigint) AS bin, count(*) AS n FROM events GROUP BY 1, 2", shared=False)
def events_bins(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy((F.col("user_id") % 16).alias("shard"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3_600_000_000).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT block_id, row_idx, col, name, pos FROM (SELECT *, cast(substr(name, 3, 1) AS bigint) AS s FROM ca) AS x WHERE {IN_BED.format(p='pos')}")
def interval_join(spark, d):
    from ..sources.maf import cells

    return coverage.in_intervals(cells(alignment(spark, d)), _bed(spark)).select("block_id", "row_idx", "col", "name", "pos")
