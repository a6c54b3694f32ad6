"""Operators against plain versions: closures, crowded blocks, long rows, samples, reports and file rules."""

import random
from collections import Counter, defaultdict
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from colinear.functions import exprs as X
from colinear.operators import blocks, closure, compare, coverage, stitch, validate
from colinear.sources import maf
from colinear.sources.shared import clear, shared_folder, stored

SCHEMA = "block_id long, row_idx long, name string, start long, length long, strand string, source_length long, text string"
OTHER = str.maketrans("ACGT", "TGCA")


def made(seed, n_blocks, names=4, size=120, truth=None):
    """Rows cut from sources on both strands, so that bases agree."""
    rng = random.Random(seed)
    truth = truth or {f"s{k}.c{k % 2}": "".join(rng.choice("ACGT") for _ in range(size)) for k in range(names)}
    rows = []
    for b in range(1, n_blocks + 1):
        width = rng.randrange(4, 14)
        for i in range(rng.randrange(2, 5)):
            name, strand = rng.choice(list(truth)), rng.choice("+-")
            gaps = [rng.random() < 0.25 for _ in range(width)]
            n = gaps.count(False)
            start = rng.randrange(0, size - n)
            whole = truth[name] if strand == "+" else truth[name][::-1].translate(OTHER)
            bases = iter(whole[start : start + n])
            rows.append((b, i, name, start, n, strand, size, "".join("-" if g else next(bases) for g in gaps)))
    return rows


def places(row):
    """(column, base, place, sign) of each base of a row."""
    _, _, _, start, _, strand, size, text = row
    k = 0
    for col, base in enumerate(text):
        if base != "-":
            yield col, base, start + k if strand == "+" else size - 1 - start - k, 1 if strand == "+" else -1
            k += 1


def columns(rows):
    held = defaultdict(list)
    for row in rows:
        for col, base, pos, sign in places(row):
            held[row[0], col].append((row[1], row[2], pos, sign, base))
    return held


def test_cells_of_any_length(spark):
    rows = made(1, 20) + [(99, 0, "long.c", 7, 48_000, "-", 100_000, "AC-GT-" * 12_000)]
    got = coverage.cells(spark.createDataFrame(rows, SCHEMA)).collect()
    want = [(r[0], r[1], c, b, r[2], p) for r in rows for c, b, p, _ in places(r)]
    assert sorted((r.block_id, r.row_idx, r.col, r.base, r.name, r.pos) for r in got) == sorted(want)


@pytest.mark.parametrize("large", [coverage.LARGE, 1])
def test_pairs_by_masks_and_by_counts(spark, monkeypatch, large):
    monkeypatch.setattr(coverage, "LARGE", large)
    rows = made(2, 40)
    want = Counter()
    for held in columns(rows).values():
        for a in held:
            for b in held:
                if a[1].startswith("s") and b[1] != "s1.c1":
                    want[a[1], b[1]] += b[1].startswith("s")
    got = {(r.name1, r.name2): r.aligned for r in coverage.aligned_pairs(spark.createDataFrame(rows, SCHEMA), "s*", "s*").where("name2 <> 's1.c1'").collect()}
    assert got == want


@pytest.mark.parametrize("large", [coverage.LARGE, 2])
def test_bins_and_regions(spark, monkeypatch, large):
    monkeypatch.setattr(coverage, "LARGE", large)
    rows = made(13, 50, names=3, size=80)
    want, inside = Counter(), Counter()
    for held in columns(rows).values():
        for a in held:
            for b in held:
                if a[1] == "s0.c0" and b[1].startswith("s1"):
                    want[a[2] // 20] += 1
                    inside[1, a[1], 10 <= a[2] < 40] += 1
                    inside[2, b[1], 10 <= b[2] < 40] += 1
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r.bin: r.value * 20 for r in coverage.pair_bins(df, "s0.c0", "s1*", 0, 79, 20).collect()} == pytest.approx({k: want[k] for k in range(4)})
    bed = spark.createDataFrame([("s0.c0", 10, 40), ("s1.c1", 10, 40)], "name string, start long, stop long")
    got = {(r.side, r.name): (r.in_region, r.out_region) for r in coverage.pair_regions(df, "s0.c0", "s1*", bed).collect()}
    assert got == {(k, n): (inside[k, n, True], inside[k, n, False]) for k, n, _ in inside}


def test_a_block_of_many_rows(spark):
    rows = [(1, i, f"s{i % 3}.c", i * 3, 3, "+", 40_000, "ACG-") for i in range(10_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    n = Counter(i % 3 for i in range(10_000))
    assert {(r.name1, r.name2): r.aligned for r in coverage.aligned_pairs(df, "*", "*").collect()} == {(f"s{a}.c", f"s{b}.c"): 3 * n[a] * n[b] for a in n for b in n}
    assert coverage.pair_count(df).first().pairs == 3 * 10_000 * 9_999 // 2
    got = {(r.query, r.target): r.coverage for r in coverage.coverage(df).collect()}
    assert got == pytest.approx({(f"s{a}", f"s{b}"): 3 * n[a] / 40_000 for a in n for b in n})


@pytest.mark.parametrize(("identity", "large"), [(False, coverage.LARGE), (True, coverage.LARGE), (False, 2), (True, 2)])
def test_depths(spark, monkeypatch, identity, large):
    monkeypatch.setattr(coverage, "LARGE", large)
    rows = made(3, 60, names=3, size=40)
    depth = Counter()
    for held in columns(rows).values():
        for a in held:
            for b in held:
                if a[0] != b[0] and (not identity or a[4] == b[4]):
                    depth[a[1], a[2], b[1].split(".")[0]] += 1
    want = Counter()
    for (name, _, target), d in depth.items():
        for n in range(1, min(d, 4) + 1):
            want[name.split(".")[0], target, n] += 1 / 40
    got = {(r.query, r.target, r.n): r.coverage for r in coverage.coverage(spark.createDataFrame(rows, SCHEMA), n_max=4, identity=identity).collect()}
    assert got == pytest.approx(dict(want))


def plain_closure(rows):
    """Classes of places as {(name, pos): turn}, by a union of every column's first base with its others."""
    label = {}

    def find(v):
        turn = 0
        while label[v][0] != v:
            v, t = label[v]
            turn ^= t
        return v, turn

    for held in columns(rows).values():
        held.sort()
        for _, name, pos, sign, _ in held[1:]:
            a, b = (held[0][1], held[0][2]), (name, pos)
            label.setdefault(a, (a, 0))
            label.setdefault(b, (b, 0))
            (ra, ta), (rb, tb) = find(a), find(b)
            if ra != rb:
                label[rb] = (ra, ta ^ tb ^ (sign != held[0][3]))
    classes = defaultdict(dict)
    for v in label:
        root, turn = find(v)
        classes[root][v] = turn
    return classes


def test_closure_against_union(spark):
    truth = {f"s{k}.c": "".join(random.Random(k).choice("ACGT") for _ in range(300)) for k in range(5)}
    rows = made(6, 14, size=300, truth=truth)
    classes = {frozenset(c): c for c in plain_closure(rows).values()}
    df = spark.createDataFrame(rows, SCHEMA)
    found = closure.closure_rows(df).collect()
    by_block = defaultdict(list)
    for r in found:
        by_block[r.block].append(r)
        whole = truth[r.name] if r.strand == "+" else truth[r.name][::-1].translate(OTHER)
        assert r.text == whole[r.start : r.start + r.length] and r.degree == sum(x.block == r.block for x in found)
    seen = set()
    for members in by_block.values():
        for k in range(members[0].length):
            at = frozenset((r.name, r.start + k if r.strand == "+" else 300 - 1 - r.start - k) for r in members)
            assert at in classes
            seen.add(at)
    assert seen == {c for c in classes if len(c) > 1}
    lines = closure.closure_lines(closure.closure_rows(df)).orderBy("block", "line_idx").collect()
    assert sum(r.raw.startswith("a degree=") for r in lines) == len(by_block) and len(lines) == len(by_block) + len(found)


def test_closure_of_contradictions(spark):
    rows = [(1, 0, "a.c", 0, 2, "+", 9, "AC"), (1, 1, "b.c", 0, 2, "+", 9, "AC"), (2, 0, "a.c", 0, 2, "+", 9, "AG"), (2, 1, "b.c", 4, 2, "+", 9, "AG")]
    with pytest.raises(Exception, match="contradictory bases"):
        closure.closure_rows(spark.createDataFrame(rows, SCHEMA)).collect()


def test_unranked_pairs(spark):
    got = spark.range(5000).select(*[c.alias(n) for c, n in zip(compare.unranked(F.col("id")), "ij", strict=True)], "id").orderBy("id").collect()
    assert [(r.i, r.j) for r in got] == [(i, j) for j in range(101) for i in range(j)][:5000]
    far = spark.range(1).select(F.lit(10**15).alias("r")).select(*[c.alias(n) for c, n in zip(compare.unranked(F.col("r")), "ij", strict=True)]).first()
    assert far.j * (far.j - 1) // 2 + far.i == 10**15 and far.i < far.j


def test_samples_are_pairs_in_proportion(spark):
    rows = [(b, i, f"s{i}.c", b * 20, 20, "+", 10_000, "ACGTACGTAC" * 2) for b in range(1, 31) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    names = df.select("name").distinct()
    every = compare.pairs(df, names)
    total = every.count()
    some = compare.sampled_pairs(df, names, total // 10, seed=3)
    assert total == 30 * 20 * 66 and abs(some.count() - total / 10) < 5 * (total * 0.09) ** 0.5
    assert some.join(every, compare.PAIR, "left_anti").count() == 0 and sorted(some.collect()) == sorted(compare.sampled_pairs(df, names, total // 10, seed=3).collect())
    assert sorted(some.collect()) != sorted(compare.sampled_pairs(df, names, total // 10, seed=4).collect())
    by = Counter(r.seq1 for r in some.collect())
    assert len(by) == 11 and compare.sampled_pairs(df, names, total).count() == total


@pytest.mark.parametrize("near", [0, 2])
def test_pairs_are_found_among_cells(spark, near):
    """The same hits with all pairs made and with none, and samples are hits alike."""
    truth = {f"s{k}.c": "".join(random.Random(k).choice("ACGT") for _ in range(30)) for k in range(4)}
    a, b = (spark.createDataFrame(made(k, 25, size=30, truth=truth), SCHEMA) for k in (11, 12))
    names = compare.legit_names(a, b)
    every = compare.pairs(a, names).where("seq1 <> seq2")
    whole = sorted(map(tuple, compare.found(every, compare.pairs(b, names), near).collect()))
    assert sorted(map(tuple, compare.found_among(every, b, near).collect())) == whole and len({r[-1] for r in whole}) == 2
    some = compare.tested(a, b, near, samples=60, seed=5)[0].where("seq1 <> seq2").collect()
    assert 20 < len(some) < 120 and set(map(tuple, some)) <= set(whole)


def test_report_is_nested(spark):
    a, b = (spark.createDataFrame(made(k, 12), SCHEMA) for k in (7, 8))
    bed = spark.createDataFrame([("s0.c0", 10, 60)], "name string, start long, stop long")
    wanted = compare.wiggle_pairs(a.select("name", "source_length").distinct(), [("s0.*", "s1.*"), ("s2.c0", "*")])
    bins = compare.wiggles(*compare.tested(a, b), wanted, 50)
    result = compare.compare(a, b, intervals=bed)
    root = ElementTree.fromstring(compare.xml(result, ("a.maf", "b.maf"), bins, wanted, 50, near=0))
    assert [t.get("fileA") for t in root.findall("homologyTests")] == ["a.maf", "b.maf"]
    for tests, direction in zip(root.findall("homologyTests"), ("AB", "BA"), strict=True):
        parts = {t.tag: t for t in tests.find("aggregateResults")}
        assert set(parts) == {"all", "both", "A", "B", "neither"}
        for key in ("totalTests", "totalTrue", "totalFalse"):
            assert int(parts["all"].get(key)) == sum(int(parts[x].get(key)) for x in ("both", "A", "B", "neither"))
        listed = tests.findall("homologyPairTests/homologyTest")
        assert len(listed) == result.where(F.col("direction") == direction).count()
        assert all(t.find("singleHomologyTests/singleHomologyTest/aggregateResults/all").attrib == t.find("aggregateResults/all").attrib for t in listed)
    wiggles = root.findall("wigglePairs/wigglePair")
    assert len(wiggles) == wanted.count() and all(len(w.find("presentMaf1ToMaf2").text.split(",")) == 3 == int(w.get("numberOfBins")) for w in wiggles)


def rules(spark, tmp_path, texts, **options):
    """The rules that each text breaks, as files of one folder."""
    for k, text in enumerate(texts):
        (tmp_path / f"{k:03}.maf").write_text(text)
    found = defaultdict(set)
    for r in validate.validate_files(spark, str(tmp_path), **options).collect():
        found[int(r.path[-7:-4])].add(r.rule)
    return [found[k] for k in range(len(texts))]


GOOD = "##maf version=1 scoring=none\n\na score=0\ns a.chr1 0 3 + 9 ACG\ni a.chr1 C 0 I 4\ns b.chr1 0 3 - 9 ACG\nq b.chr1 99F\ne c.chr2 0 5 - 9 n\n\n"


BAD = {
    "EmptyInput": "", "Footer": GOOD[:-1], "KeyValuePair": GOOD.replace("score=0", "score"), "MissingAlignmentBlockLine": GOOD.replace("a score=0\n", ""), "FieldNumber": GOOD.replace("9 ACG\ni", "9 ACG x\ni"),
    "StrandCharacter": GOOD.replace("3 - 9", "3 x 9"), "StartField": GOOD.replace("b.chr1 0", "b.chr1 -1"), "SourceSizeField": GOOD.replace("- 9 ACG", "- -9 ACG"), "OutOfRange": GOOD.replace("b.chr1 0 3", "b.chr1 7 3"),
    "AlignmentLength": GOOD.replace("0 3 -", "0 4 -"), "SpeciesField": GOOD.replace("b.chr1", "b"), "SourceLength": GOOD + "a score=1\ns a.chr1 5 3 + 10 CGT\n\n", "DuplicateColumn": GOOD + "a score=1\ns a.chr1 1 3 + 9 CGT\n\n",
    "ILine": GOOD.replace("I 4", "I 0"), "ELine": GOOD.replace("- 9 n", "- 9 X"), "QLine": GOOD.replace("99F", "9G9"),
}
HEADERS = ("##maf", "##maf version = 1", "##maf version", "track x\n##maf version=1", "# note\n##maf version=1", "##maf scoring=none", "version=1")


def test_every_rule_by_itself(spark, tmp_path):
    good = [GOOD, "track name=x\n" + GOOD, GOOD + "# done\n"]
    got = rules(spark, tmp_path, [*good, *BAD.values(), *(GOOD.replace("##maf version=1 scoring=none", h) for h in HEADERS)], chrom_names=True)
    assert got[:3] == [set()] * 3 and got[-len(HEADERS) :] == [{"Header"}] * len(HEADERS)
    assert all(rule in found for rule, found in zip(BAD, got[3:], strict=False))


def test_sequences_that_disagree(spark, tmp_path):
    text = GOOD.replace("s b.chr1 0 3 - 9 ACG\nq b.chr1 99F\n", "s a.chr1 0 3 + 9 ATG\n")
    assert rules(spark, tmp_path, [GOOD, text], check_sequence=True) == [set(), {"SequenceConsistency"}]


def test_duplicates_over_tiles(spark, monkeypatch):
    rows = made(9, 60, size=90)
    want = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(tuple, validate.duplicate_columns(want).collect()))
    monkeypatch.setattr(validate, "TILE", 7)
    assert sorted(map(tuple, validate.duplicate_columns(want).collect())) == whole and len(whole) > 20


def test_stitching_over_tiles(spark, monkeypatch):
    rows, seen = [], set()
    for r in made(10, 60, size=400):
        if (r[0], r[2].split(".")[0]) not in seen:
            seen.add((r[0], r[2].split(".")[0]))
            rows.append(r)
    df = spark.createDataFrame(rows, SCHEMA)
    fasta = df.select("name").distinct().withColumn("seq", F.expr("repeat('ACGT', 100)"))
    events, texts = sorted(map(tuple, stitch.events(df, 6, 20).collect())), sorted(map(tuple, stitch.stitch(df, fasta, 6, 20).collect()))
    assert len({len(t[6]) for t in texts}) == 1
    monkeypatch.setattr(stitch, "TILE", 4)
    assert sorted(map(tuple, stitch.events(df, 6, 20).collect())) == events and sorted(map(tuple, stitch.stitch(df, fasta, 6, 20).collect())) == texts


def test_stitched_file(spark):
    rows = [(1, 0, "r.c", 0, 4, "+", 99, "ACGT"), (1, 1, "quite.long", 90, 3, "-", 1000, "AC-T"), (2, 0, "r.c", 6, 2, "-", 99, "GG")]
    fasta = spark.createDataFrame([("r.c", "A" * 99)], "name string, seq string")
    done = stitch.stitch(spark.createDataFrame(rows, SCHEMA), fasta, 3, 5)
    got = [r.value for r in stitch.stitched_text(done).orderBy("place").collect()]
    assert got == ["##maf version=1", "", "a stitched=true", f"s {'r.c':<12} {0:>3} {9:>2} + {99:>5} ACGTNNNGG", f"s {'quite.long':<12} {90:>3} {3:>2} - {1000:>5} AC-T-----", ""]
    assert [r.value for r in stitch.stitched_text(done.where("false")).orderBy("place").collect()] == ["##maf version=1", ""]


def test_sorted_and_extracted_lines(spark):
    text = "##maf version=1\n\na score=1\ns t.c 20 3 + 90 ACG\n# kept\ns q.c 0 2 + 90 A-G\n\na score=2\ns q.c 5 2 + 90 AC\n\na score=3\ns t.c 80 3 - 90 AAC\n\na score=4\ns t.c 10 6 + 90 ACGTAC\ne z.c 0 5 + 9 I\n\n"
    lines = maf.parse_lines(spark.createDataFrame([("x", text)], "path string, value string"))
    got = blocks.sorted_lines(lines, "t").orderBy("place", "line_idx").collect()
    assert [r.raw for r in got if r.type in "ah"] == ["##maf version=1", "a score=2", "a score=3", "a score=4", "a score=1"]
    cut = blocks.extract_lines(lines, "t.c", 12, 21).orderBy("block_id", "splice", "line_idx").collect()
    assert [r.raw for r in cut] == ["a score=0 spliced=true splice_id=1_0", "s t.c 20 2 + 90 AC", "# kept", "s q.c 0 1 + 90 A-", "a score=0 spliced=true splice_id=4_0", "s t.c 12 4 + 90 GTAC", "e z.c 0 5 + 9 I"]


def test_complement_of_strange_characters(spark):
    texts = spark.createDataFrame([("ACGTMRWSYKVHDBNX-nxa",), ("AC*T",)], "t string")
    back = texts.select(X.reverse_complement(F.col("t")).alias("r"))
    assert texts.where("t LIKE '%NX%'").select(X.reverse_complement(F.col("t")).alias("r")).first().r == "txn-XNVHDBMRSWYKACGT"
    with pytest.raises(Exception, match="no nucleotide code"):
        back.collect()


def test_files_stay_apart_when_written(spark):
    lines = maf.parse_lines(spark.createDataFrame([("x", "##maf version=1\n\na score=0\ns a.b 0 1 + 5 A\n"), ("y", "##maf version=1\n# second\n")], "path string, value string"))
    assert {(r.path, r.block_id) for r in maf.blocks_text(lines).collect()} == {("x", 0), ("x", 1), ("y", 0)}


def test_fasta_text_and_near(spark):
    seqs = spark.createDataFrame([("a", "ACGTACGTAC"), ("b", "ACG")], "name string, seq string")
    assert [r.value for r in maf.fasta_text(seqs, 5).collect()] == ["> a\nACGTA\nCGTAC", "> b\nACG"]
    assert [r.n for r in spark.range(4).select(X.close_enough(F.col("id"), F.lit(1), 1).alias("n")).collect()] == [True, True, True, False]


def test_stored_tables_can_be_removed(spark):
    table = stored(spark.range(3))
    assert table.count() == 3 and "tables" in table.inputFiles()[0] and table.inputFiles()[0].removeprefix("file://").startswith(shared_folder(spark).removeprefix("file:"))
    clear(spark)
    with pytest.raises(Exception):  # noqa: B017
        spark.catalog.clearCache()
        table.count()
