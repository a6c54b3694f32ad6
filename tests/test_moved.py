"""What the alignment queries move between machines: no step deals out the cells or pairs of an alignment one by one."""

import pytest

from colinear.plans import texts  # noqa: F401
from colinear.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["genome_coverage", "identity_coverage", "report_coverage", "n_coverage", "sequence_coverage", "pair_coverage_bed", "homology_exact", "homology_rollup", "homology_bed", "homology_near", "homology_both_ways", "wiggle_bins"])
def test_cells_of_small_blocks_are_not_joined(spark, name):
    """Before, every cell was sent to a merge join by block and column, twice."""
    assert "strategy=merge" not in plan(QUERIES[name](spark, SF))


@pytest.mark.parametrize("near", [0, 1])
def test_pairs_meet_as_bits_of_tiles(spark, near):
    """Before, every pair of both alignments was a row of its own and was joined with the other alignment's."""
    from colinear.operators import compare
    from colinear.plans.queries import alignment
    from colinear.plans.synth import B

    a, b = alignment(spark, SF).where("block_id < 800"), alignment(spark, SF, B).where("block_id < 800")
    names = compare.numbered(compare.legit_names(a, b))
    t = compare.tiles(a, b, names, near).persist()
    every = [compare.pairs(x, names) for x in (a, b)]
    assert "strategy=merge" not in plan(t) and t.count() * 3 < every[0].count()
    for d, (x, y) in (("AB", every), ("BA", every[::-1])):
        plain = compare.found(x, y, near)
        assert sorted(map(tuple, compare.expanded(t, names, d, near).select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("name", ["dup_filter", "column_consensus"])
def test_columns_of_small_blocks_are_counted_where_rows_are(spark, name):
    """Before, the cells of a block were dealt out by column."""
    import re

    assert not re.search(r"hashpartitioning\(block_id#\d+L?, col#", QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString())


def test_scores_of_small_and_large_blocks_agree(spark, monkeypatch):
    from colinear.operators import blocks, coverage
    from colinear.plans.queries import alignment

    rows = alignment(spark, SF).where("block_id < 400")
    got = []
    for large in (coverage.LARGE, 2):
        monkeypatch.setattr(coverage, "LARGE", large)
        got.append(sorted((r[0], r[1], r[2], round(r[3], 9)) for r in blocks.duplicate_scores(rows).collect()))
    assert got[0] == got[1] and len(got[0]) > 100


def test_files_of_a_folder_as_one(spark, tmp_path):
    """Before, a file whose lines are numbered through had to be written by one task."""
    from colinear.sources import maf

    (tmp_path / "d").mkdir()
    text = ["##maf version=1\n\n", "a score=0\ns x.c 0 1 + 9 A\n\n", "a score=1\ns x.c 1 1 + 9 C\ns y.c 1 1 + 9 C\n\n"]
    for i, part in enumerate(text):
        (tmp_path / "d" / f"part-{i}").write_text(part)
    (tmp_path / "whole").write_text("".join(text))
    got = [sorted(tuple(r) for r in x.select("block_id", "line_no", "raw").collect()) for x in (maf.read_lines(spark, str(tmp_path / "d"), one=True), maf.read_lines(spark, str(tmp_path / "whole")))]
    assert got[0] == got[1] and len(got[0]) == 6


def test_bases_are_compared_as_numbers(spark):
    """Before, strings were compared, for which Spark sorts all cells."""
    assert "SortAggregate" not in QUERIES["validate_consistency"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_edges_of_small_blocks_are_not_dealt_out(spark, monkeypatch):
    """Before, every cell was dealt out by block and column, and all edges were kept and joined in each step."""
    from colinear.operators import closure, coverage
    from colinear.plans.queries import alignment

    rows = alignment(spark, SF).where("block_id < 300")
    names = closure.numbered(rows)
    got = []
    for large in (coverage.LARGE, 2):
        monkeypatch.setattr(coverage, "LARGE", large)
        edges = closure.star_edges(rows, names)
        got.append((sorted(map(tuple, edges.distinct().collect())), "strategy=merge" in plan(edges)))
    assert [x[1] for x in got] == [False, True] and got[0][0] == got[1][0] and len(got[0][0]) > 1000


def test_components_keep_no_edges(spark, monkeypatch):
    """Labels are those of the plain spreading of labels along edges, in components with and without contradictions."""
    import random

    from colinear.operators import closure

    rnd = random.Random(3)
    edges = [(g * 1000 + rnd.randrange(30), g * 1000 + rnd.randrange(30), int(rnd.random() < 0.3)) for g in range(8) for _ in range(25)]
    edges += [(9000 + i, 9001 + i, i % 2) for i in range(40)]
    directed = [*edges, *[(b, a, t) for a, b, t in edges]]
    labels = {a: a << 1 for a, _, _ in directed}
    while True:
        near = dict(labels)
        for a, b, t in directed:
            near[a] = min(near[a], labels[b] ^ t)
        step = {v: min(x, labels[x >> 1] ^ (x & 1)) for v, x in near.items()}
        if step == labels:
            break
        labels = step
    df = spark.createDataFrame(edges, "a long, b long, turned long")
    sizes, keep = [], closure.stored
    monkeypatch.setattr(closure, "stored", lambda x, **k: (lambda y: (sizes.append(y.count()), y)[1])(keep(x, **k)))
    assert {r.v: (r.label << 1) + r.turn for r in closure.components(df).collect()} == labels
    assert max(sizes) <= len(labels)


def test_text_is_written_by_ranges_of_items(spark):
    """Before, rows were dealt by block, and their text once more by ranges of blocks, or all of it to one task."""
    from colinear.plans import texts

    seen, keep = [], texts._written
    try:
        texts._written = lambda text, kind: (seen.append(text), keep(text, kind))[1]
        for name in ("maf_lines", "validate_files"):
            QUERIES[name](spark, SF)
    finally:
        texts._written = keep
    for text in seen:
        told = text._jdf.queryExecution().executedPlan().toString()
        assert told.count("Exchange ") == 1 and "rangepartitioning(l_orderkey" in told and "Coalesce 1" not in told


def test_numbering_deals_text_once(spark, tmp_path):
    """Before, lines were told apart three times over, parts and openings each from all lines again."""
    from colinear.sources import maf

    (tmp_path / "x").write_text("a score=0\ns x.c 0 1 + 9 A\n")
    told = maf.read_lines(spark, str(tmp_path / "x"))._jdf.queryExecution().optimizedPlan().toString()
    assert told.count("Relation [value") == 2


def test_files_of_a_folder_are_validated_as_one(spark, tmp_path):
    """Before, a file that was to be validated as a whole had to be written by one task."""
    from colinear.operators import validate

    (tmp_path / "d").mkdir()
    parts = ["##maf version=1\n", "\na score=0\ns x.c 0 1 + 9 A\nq y.c 9\n", "", "s y.c 0 2 + 9 A\n", "\ns x.c 1 1 + 8 C\n\na score\ns y.c 1 1 + 9 C\ni y.c C 0 N 3\n", "\na score=0"]
    for i, part in enumerate(parts):
        (tmp_path / "d" / f"part-{i}").write_text(part)
    (tmp_path / "whole").write_text("".join(parts))
    got = [sorted((r.line_no, r.rule, r.message) for r in validate.validate_files(spark, str(tmp_path / x), one=one).collect()) for x, one in (("d", True), ("whole", False))]
    assert got[0] == got[1] and {"QLine", "AlignmentLength", "MissingAlignmentBlockLine", "KeyValuePair", "SourceLength", "Footer", "ILine"} - {r for _, r, _ in got[0]} == {"ILine"}


def test_few_intervals_are_sent_to_the_cells(spark):
    """Before, nothing was known of the intervals' size when the join was planned, so all cells were dealt out unless it was changed while it ran."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        told = QUERIES["interval_join"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" not in told and "BroadcastHashJoin" in told


def test_pieces_are_joined_by_tiles_of_blocks(spark, monkeypatch):
    """Before, all pieces of a species were listed, ordered and joined by one task."""
    from colinear.operators import stitch
    from colinear.plans.queries import alignment
    from colinear.plans.texts import FILL, ONE

    rows = spark.sql(ONE, rows=alignment(spark, SF))
    fasta = rows.select("name").distinct().selectExpr("name", f"{FILL} AS seq")
    got = []
    for tile in (3, 1 << 40):
        monkeypatch.setattr(stitch, "TEXT_TILE", tile)
        got.append(sorted(map(tuple, stitch.stitch(rows, fasta, 6, 20).collect())))
    assert got[0] == got[1] and len(got[0]) == 5


@pytest.mark.parametrize("near", [2, 17])
def test_near_pairs_are_moved_as_words(spark, near):
    """Before, every pair was made once more for each place near it."""
    from colinear.operators import compare
    from colinear.plans.queries import alignment
    from colinear.plans.synth import B

    a, b = alignment(spark, SF).where("block_id < 60"), alignment(spark, SF, B).where("block_id < 60")
    names = compare.numbered(compare.legit_names(a, b))
    t = compare.tiles(a, b, names, near)
    assert plan(t).count("Aggregate [k1") == 2
    every = [compare.pairs(x, names) for x in (a, b)]
    plain = compare.found(*every, near)
    assert sorted(map(tuple, compare.expanded(t, names, "AB", near).select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_wiggles_make_pairs_of_their_names_alone(spark):
    """Before, the pairs of all names were made and looked at one by one."""
    from colinear.operators import compare
    from colinear.plans.queries import alignment
    from colinear.plans.synth import B

    a, b = alignment(spark, SF).where("block_id < 400"), alignment(spark, SF, B).where("block_id < 400")
    wanted = compare.wiggle_pairs(a.select("name", "source_length").distinct(), [("sp1.chr1", "sp2.*"), ("sp0.*", "sp3.chr0"), ("sp4.chr2", "sp4.chr2")])
    few = compare.tested(a, b, among=wanted)
    assert {(r.seq1, r.seq2) for x in few for r in x.select("seq1", "seq2").distinct().collect()} <= {tuple(sorted((r.reference, r.partner))) for r in wanted.collect()}
    got = [sorted(map(tuple, compare.wiggles(*x, wanted, 100).collect())) for x in (few, compare.tested(a, b))]
    assert got[0] == got[1] and sum(r[3] for r in got[0]) > 100


def dealt(df):
    """What the plan deals by, and whether texts are dealt."""
    import re

    told = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^()]*), \d+\)", re.sub(r"#\d+L?", "", told)), told


@pytest.mark.parametrize("name", ["genome_coverage", "n_coverage", "identity_coverage", "report_coverage", "sequence_coverage", "column_consensus"])
def test_items_are_dealt_before_they_have_texts(spark, name):
    """Before, rows were dealt with their texts to be numbered, and once more by block (and chunk)."""
    by, told = dealt(QUERIES[name](spark, SF))
    assert [x for x in by if x.startswith(("block_id", "l_orderkey"))] == ["block_id"]
    assert told.index("md5(") < told.index("Exchange hashpartitioning(block_id")  # above the exchange


def test_items_of_both_alignments_are_dealt_before_they_have_texts(spark):
    """Before, each alignment's rows were dealt twice, and nothing of the second could be taken from the first."""
    from colinear.operators import compare
    from colinear.plans.queries import alignment
    from colinear.plans.synth import B

    a, b = alignment(spark, SF), alignment(spark, SF, B)
    t = compare.tiles(a, b, compare.numbered(compare.legit_names(a, b)))
    by, _ = dealt(t)
    assert [x for x in by if x.startswith(("block_id", "l_orderkey"))] == ["block_id"] * 2


@pytest.mark.parametrize("identity", [False, True])
def test_rows_of_a_block_are_not_sorted_by_chunk(spark, identity):
    """Before, all strips were sorted once more, by block and chunk, and each shared column was a row."""
    from colinear.operators import coverage
    from colinear.plans.queries import alignment

    p = coverage.coverage(alignment(spark, SF), identity=identity)._jdf.queryExecution().executedPlan().toString()
    assert "chunk#" not in p and "bit#" not in p


@pytest.mark.parametrize("identity", [False, True])
def test_depths_of_wide_and_odd_texts(spark, identity):
    """Texts of several chunks, of both strands, with letters that are no bases, beside narrow ones; by tiles and cell by cell."""
    import random
    from collections import Counter

    from colinear.operators import coverage

    rng, rows = random.Random(3), []
    for b in range(12):
        for r in range(5):
            text = "".join(rng.choice("ACGTacgtNRY*--") for _ in range((62, 9, 150)[b % 3]))
            n = len(text) - text.count("-")
            rows.append((b, r, f"s{rng.randrange(3)}.c", rng.randrange(90), n, rng.choice("+-"), 400, text))
    df = spark.createDataFrame(rows, "block_id long, row_idx long, name string, start long, length long, strand string, source_length long, text string")
    depth, places = Counter(), {}
    for b, r, name, start, _, strand, size, text in rows:
        seen = 0
        for i, x in enumerate(text.upper()):
            if x != "-":
                pos = start + seen if strand == "+" else size - 1 - start - seen
                seen += 1
                for b2, r2, other, *_, t in rows:
                    if b2 == b and r2 != r and t[i] != "-" and (not identity or (x == t[i].upper() and x != "N")):
                        depth[name[:2], other[:2], pos] += 1
    for (q, t, _), n in depth.items():
        for k in range(1, min(n, 4) + 1):
            places[q, t, k] = places.get((q, t, k), 0) + 1
    got = {(x["query"], x["target"], x["n"]): round(x["coverage"] * 400) for x in coverage.coverage(df, 4, identity).collect()}
    assert got == places and len(got) > 9


def test_columns_are_counted_block_by_block(spark):
    """Before, the counts of all columns of a task's blocks were held at once."""
    from colinear.operators import blocks
    from colinear.plans.queries import alignment

    p = blocks.consensus(alignment(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in p and p.count("Exchange hashpartitioning") == 1


def test_consensus_of_narrow_wide_and_large_blocks(spark, monkeypatch):
    """Blocks by themselves and by counts of all columns agree, with texts of unequal lengths, empty ones and other letters."""
    import random

    from colinear.operators import blocks, coverage

    rng = random.Random(5)
    rows = [(b, r, "".join(rng.choice("ACGTacgtNnR-") for _ in range(rng.choice((0, 30, 62) if b % 2 else (62, 150))))) for b in range(40) for r in range(1, 2 + b % 5)] + [(b, 0, "ACGT" * 9) for b in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "block_id long, row_idx long, text string")
    got = sorted(map(tuple, blocks.consensus(df).collect()))
    assert got == sorted(map(tuple, blocks._codes(df).collect())) and len(got) > 1000
    monkeypatch.setattr(coverage, "LARGE", 2)
    assert got == sorted(map(tuple, blocks.consensus(df).collect()))
