"""Repeated windows against a plain search: crowded grams, rows without an id, rows of one id, long and repeated texts."""

import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("colinear.llm.queries")
from pyspark.sql import functions as F  # noqa: E402

from colinear.llm import repeats  # noqa: E402


def rows():
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghij é\n") for _ in range(n))
    passage, other, wave = noise(320), noise(260), "0123456789" * 40
    out = [(i, noise(rng.randrange(0, 90)) + passage + noise(rng.randrange(0, 150))) for i in range(40)]
    out += [(None, noise(50) + passage[40:] + noise(40) + other) for _ in range(12)]
    out += [(7, noise(130) + other + noise(130)), (7, noise(30) + other), (7, noise(30) + other + passage + other)]
    out += [(100, wave), (99, wave[3:]), (101, wave), (101, wave), (-5, passage[:150]), (None, None), (None, ""), (102, None), (103, "x" * 99), (104, "x" * 100), (105, "x" * 350)]
    out += [(None, other + noise(20)), (200, noise(150_000) + passage), (201, noise(9) + passage + noise(9) + passage + noise(2))]
    long = "".join(noise(997) for _ in range(600))
    return [*out, (300, long + other + long[5000:9000]), (301, noise(11) + long[250_000:300_000] + noise(7))]


def plain(made, key):
    """(id, n_removed, spans, digest) by a table of all windows: of which key it first is, and where in which row."""
    first: dict[bytes, int] = {}
    texts = [(t or "").encode() for _, t in made]
    for i in sorted(range(len(made)), key=lambda i: key[i]):
        for s in range(len(texts[i]) - 99):
            first.setdefault(texts[i][s : s + 100], key[i])
    out = []
    for i, t in enumerate(texts):
        gone, own = bytearray(len(t)), set()
        for s in range(len(t) - 99):
            w = t[s : s + 100]
            if first[w] < key[i] or w in own:
                gone[s : s + 100] = b"\1" * 100
            own.add(w)
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = len(bytes(gone).split(b"\0")) - bytes(gone).split(b"\0").count(b"")
        out.append((str(made[i][0]), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("crowd", [repeats.CROWD, 6])
def test_against_plain_search(spark, crowd):
    made = rows()
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(made)], "k int, doc_id long, text string")
    late = F.lit(1 << 62) + F.xxhash64("text").bitwiseAND((1 << 62) - 1)
    key = [r.key for r in df.select("k", F.coalesce("doc_id", late).alias("key")).orderBy("k").collect()]
    got = repeats.removed(df, crowd=crowd).collect()
    assert sorted((str(r.doc_id), sum(x.end - x.start for x in r.runs), len(r.runs), r.kept_sha256) for r in got) == plain(made, key)


def test_radix_passes_against_dictionary():
    rng = np.random.default_rng(4)
    data = np.tile(rng.integers(0, 3, 400).astype(np.uint8), 6)
    data[rng.integers(0, len(data), 25)] = 9
    start, group = rng.integers(0, len(data) - 100, 900), rng.integers(0, 5, 900)
    at, kind = repeats.equal_windows(data, start, group)
    want: dict = {}
    for i in range(900):
        want.setdefault((group[i], data[start[i] : start[i] + 100].tobytes()), []).append(i)
    classes: dict = {}
    for i, k in zip(at.tolist(), kind.tolist(), strict=True):
        classes.setdefault(k, []).append(i)
    assert sorted(classes.values()) == sorted(x for x in want.values() if len(x) > 1)


def test_many_rows_without_an_id(spark):
    """Their lists stay apart: one document's are no other's."""
    df = spark.range(1500).selectExpr("cast(null AS long) AS doc_id", "concat(repeat(concat('text ', id, ' '), 20), repeat(sha2(cast(id AS string), 256), 6)) AS text")
    got = repeats.removed(df)
    assert got.where("n_bytes > 0 AND doc_id IS NULL").count() == 1500


def test_query_columns(spark, tmp_path):
    from colinear.llm.queries import queries

    made = [(1, "ab" * 80), (2, "ab" * 80 + "tail"), (3, None), (4, "é")]
    spark.createDataFrame(made, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries()["op4_repeats"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and [t for _, t in got.dtypes] == ["bigint"] * 4 + ["string"]
    want = plain(made, [i for i, _ in made])
    assert sorted((str(r.doc_id), r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want


def test_segments_do_not_depend_on_company():
    """A document has the same segments alone, behind others and before others, wherever blocks end."""
    rng = random.Random(9)
    sizes = [0, 50, 99, 100, 3_000, 200_000, 70_000, repeats.BLOCK, repeats.BLOCK + 99, repeats.BLOCK + 100, 2 * repeats.BLOCK + 250, 120, 40_000, 0, 230_000, 99, 3 * repeats.BLOCK]
    texts = [rng.randbytes(n) for n in sizes]
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1), rng.sample(range(len(texts)), len(texts))):
        both = repeats.Segments([texts[i] for i in order])
        for k, i in enumerate(order):
            alone, own = repeats.Segments([texts[i]]), both.doc == k
            for a, b in ((alone.start, both.start[own] - both.begin[k]), (alone.n, both.n[own]), (alone.gram, both.gram[own]), (alone.hash, both.hash[own])):
                assert (len(a) == len(b)) and (a == b).all()
            assert alone.n.sum() == max(len(texts[i]) - 99, 0)
