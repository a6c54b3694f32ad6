"""Nulls in every column, empty and very long texts, repeated rows, empty tables and clashing extra columns."""

import re
from collections import defaultdict

import pytest

pytest.importorskip("colinear.llm.queries")
import corpus_pipeline  # noqa: E402
from colinear.llm import decontaminate, language, media, mixing, near, pii, quality, repeats, secrets, tokens  # noqa: E402

CLASH = ("spans", "parts", "id", "hash", "row", "own", "n", "rep", "label", "band", "kind", "start", "copy", "mix_key", "mix_source", "cdf", "low", "clean", "component_id", "kept", "item_id", "items", "value", "votes")
WORDS = "amber birch cedar dune ember fjord grove heath islet jetty knoll ledge marsh north ocean plain quarry ridge shore trail".split()
LONG = " ".join(WORDS[(i * i + 3 * i) % 19] + str(i % 977) for i in range(40_000))
PASSAGE = " ".join(WORDS[:14])
ROWS = [
    (1, LONG, "en", "a", 5), (2, LONG, "en", None, None), (3, None, "en", "a", None), (4, "", None, "a", 0), (None, "no id here at all", None, None, None), (None, None, None, None, None),
    (5, "password=hunter22 mail a.b@c.de", "en", "b", 1), (5, "password=hunter22 mail a.b@c.de", "en", "b", 1), (6, "one", "fr", "b", 3), (7, "\u0000\u0001 ퟿ \U0001f600 é", "fr", "b", 3),
    (8, "Before " + PASSAGE.upper() + " after", "en", "c", 2), (9, " \t\n\r", "xx", "c", 4), (10, "12 34 !!", "en", "c", 4), (2**60, LONG + " changed", "en", "a", 9),
]
HEAD = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *("x",) * len(CLASH)) for r in ROWS], HEAD + "".join(f", {c} string" for c in CLASH))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, PASSAGE, "x"), (2, None, "x"), (3, "", "x"), (None, "solo text", "x")], "item_id long, text string, doc_id string")


def operators(bench):
    import public_tokenizers

    path = public_tokenizers.path(tokens.TOKENIZER)
    return {
        "pii": pii.detect, "media": lambda d: media.describe(media.store(d)), "secrets": secrets.scan, "redact": secrets.redact, "repeats": repeats.removed,
        "tokens": lambda d: tokens.count(d, path), "near": near.groups, "decontaminate": lambda d: decontaminate.matches(d, bench),
        "quality": quality.classify, "language": lambda d: language.predict(d, language.learn(d)),
    }


@pytest.mark.parametrize("name", ["pii", "media", "secrets", "redact", "repeats", "tokens", "near", "decontaminate", "quality", "language"])
def test_one_row_each(docs, bench, name):
    got = operators(bench)[name](docs).collect()
    ids = lambda rows: sorted((r[0] is None, r[0] or 0) for r in rows)
    assert ids(got) == ids(ROWS)
    assert operators(bench)[name](docs.where("false")).collect() == []


def test_masking_keeps_the_rest(docs):
    got = {r.doc_id: r for r in secrets.redact(docs).collect()}
    assert got[5].text == "[secret] mail a.b@c.de" and got[5].hash == "x" and got[3].text is None and got[1].text == LONG


def test_mixing_edges(docs):
    got = mixing.replicate(docs, {"a": 1.0, "unknown": 5.0})
    assert got.columns == [c for c in docs.columns if c not in ("copy", "mix_key")] + ["copy", "mix_key"]
    assert {r.source for r in got.collect()} <= {"a"}


def test_near_against_all_pairs(spark):
    """Chains, copies and pairs at the very threshold, against components of all pairs."""
    texts = {}
    for g in range(12):
        base = [f"{w}{g}" for w in WORDS * 5]
        for k in range(6):
            own = list(base)
            for j in range(k * 2):
                own[(j * 17 + k * g) % len(own)] = f"edit{g}k{k}j{j}"
            texts[g * 10 + k] = " ".join(own)
    texts[500] = texts[0].upper()
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[j : j + 4]) for j in range(len(w) - 3)}
    reach = {i: i for i in texts}
    changed = True
    while changed:
        changed = False
        for a in texts:
            for b in texts:
                both = len(sets[a] & sets[b])
                if reach[a] < reach[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    reach[b], changed = reach[a], True
    got = near.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), width=4).collect()
    assert {r.doc_id: r.component_id for r in got} == reach
    assert all(r.n_shingles == len(sets[r.doc_id]) and r.kept == (r.component_id == r.doc_id) for r in got)


def test_near_of_one_id_with_different_texts(spark):
    """One result row each, of one component, whichever text is linked; other documents find the linked one."""
    texts = [" ".join(f"{w}{k}" for w in WORDS) for k in range(3)]
    rows = [(1, texts[0]), (2, texts[1]), (2, texts[2]), (2, texts[2]), (2, ""), (3, texts[1]), (4, texts[2]), (None, texts[0]), (None, texts[1])]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id) for r in near.groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r[:2] for r in got] == sorted((str(i), len(t) and 16) for i, t in rows)
    assert {r[2] for r in got if r[0] == "2"} == {2} and {r[2] for r in got if r[0] == "1"} == {1}
    assert sorted(r[2] for r in got if r[0] in "34") in ([2, 4], [2, 3], [3, 4])


def test_decontamination_against_plain_search(spark):
    items = {1: WORDS[:10], 2: WORDS[3:16], 3: WORDS[:2], 4: ["amber"] * 11, 5: WORDS[5:15]}
    texts = {i: [WORDS[(j * (i + 1) + (j // 7) * i) % 20] for j in range(90)] for i in range(25)}
    texts |= {100: WORDS * 3, 101: ["amber"] * 30, 102: WORDS[:2], 103: WORDS[4:14], 104: []}
    want = {}
    for d, words in texts.items():
        hit, found = set(), set()
        for item, other in items.items():
            width = min(10, len(other))
            windows = {tuple(other[k : k + width]) for k in range(len(other) - width + 1)}
            for k in range(len(words) - width + 1):
                if tuple(words[k : k + width]) in windows:
                    hit.update(range(k, k + width))
                    found.add(str(item))
        want[d] = (len(words), len(hit), sorted(found))
    docs = spark.createDataFrame([(d, ", ".join(w).title()) for d, w in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    got = {r.doc_id: (r.n_words, sum(x["end"] - x["start"] for x in r.runs), sorted(r.items)) for r in decontaminate.matches(docs, bench).collect()}
    assert got == want


def test_pipeline_stages(spark, docs, bench, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = defaultdict(set)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if k < 4:
            assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r.doc_id for r in now.collect()}
    assert 3 not in kept["language_id"] and 10 not in kept["language_id"] and 1 in kept["language_id"]
    assert 1 in kept["near_dedup"] and not kept["near_dedup"] & {2, 2**60}
    assert 8 in kept["near_dedup"] and 8 not in kept["decontamination"] and kept["secret_scan"] == kept["decontamination"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 0


def test_pipeline_of_an_empty_table(spark, docs, bench, tmp_path):
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    bench.where("false").write.parquet(str(tmp_path / "benchmark.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        assert out.collect() == [] and (k == 4 or out.columns == now.columns)
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_parts_of_stages_on_empty_tables(docs, bench):
    none = docs.where("false")
    assert decontaminate.remove(none, bench).collect() == [] and decontaminate.remove(docs, bench.where("false")).count() == len(ROWS)
    assert language.known(none, language.learn(docs), 0.5).collect() == [] and language.known(docs, language.learn(none), 0.5).collect() == []
    assert mixing.replicate(none).collect() == [] and mixing.replicate(docs.where("text IS NULL OR text = ''")).collect() == []


def test_mixing_without_given_weights(docs):
    """Null sources are one source, null and empty texts are drawn as others of their source, repeated rows alike."""
    got = mixing.replicate(docs).collect()
    assert {r.source for r in got} <= {"a", "b", "c", None} and len(got) > 5
    per = defaultdict(set)
    for r in got:
        per[r.doc_id, r.source, r.text].add(r.copy)
    assert all(copies == set(range(1, len(copies) + 1)) for copies in per.values())
    fives = [r.copy for r in got if r.doc_id == 5]
    assert all(fives.count(k) == 2 for k in fives)
