import hashlib
import re
from collections import defaultdict

import pytest

pytest.importorskip("colinear.llm.queries")
from colinear.llm import decontaminate, jpeg, language, media, mixing, near, pii, quality, repeats, secrets, tokens  # noqa: E402

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon " * 3
TEXTS = [(1, LONG), (2, LONG), (3, LONG + "one more"), (4, "x " + LONG[40:] + " tail é"), (5, None), (6, ""), (7, "short"), (8, "aé" * 400), (2, LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "src0", 0, "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_pii_spans(spark, docs, empty):
    text = "mail a.b@c.de, ip 1.2.3.4 or 1.2.3.999, card 4111 1111 1111 1111, call +49 (30) 1234567"
    got = [(s["kind"], text[s["start"] : s["end"]]) for s in pii.spans_of(text)]
    assert got == [("email", "a.b@c.de"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+49 (30) 1234567")]
    assert pii.detect(docs).count() == len(TEXTS) and pii.detect(empty).count() == 0


def test_email_equals_plain_pattern():
    plain = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    for t in ("a@b.c_d@e.f", "x@@y.z", "a@b c@d.e.f@g.h", "@a.b", "a.b@c"):
        assert list(pii.emails(t)) == [m.span() for m in plain.finditer(t)]


def test_media_round_trip(docs):
    payloads = [media.padded(t) for t in (b"", b"abc", bytes(range(256)) * 9)] + [bytes(576 * 400)]
    assert [b"".join(x.tobytes() for x in d) for d in jpeg.decode(jpeg.encode(payloads))] == payloads
    for r in media.describe(media.store(docs)).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.payload_sha256 == hashlib.sha256(media.padded((r.text or "").encode())).hexdigest()


def test_secrets_base_and_links(spark):
    text = 'secret=abc token: "abcdefgh" http://a.b AKIA' + "A" * 16
    row = secrets.scan(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(s.kind, text[s.start : s.end]) for s in row[0].spans] == [("assign", 'token: "abcdefgh'), ("endpoint", "http://a.b"), ("access", "AKIA" + "A" * 16)]
    assert row[1].spans == []


def test_secret_links_against_all_pairs(spark):
    """Every gap around SCOPE, at shifted places, for short and long parts on either side of long and short candidates."""
    texts, shift = [], 0
    jwt, path = "Ab1." * 500, "a1/" * 700
    for size in (8, 190, 250, 600, 2000):
        for gap in (1, 199, 200, 201, 390):
            shift = (shift * 7 + 61) % 400
            token, url, blob = f"token={jwt[:size]}", f"https://{path[:size]}", ("aB3" * 700)[: max(size, 33)]
            name, apart = "username=someone", " " + "-" * (gap - 2) + " " if gap > 1 else " "
            for a, b in ((token, name), (name, token), (token, url), (url, token), (blob, url), (url, blob), (token, "http://b.c"), ("http://b.c", token)):
                texts.append(" " * shift + a + apart + b)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = secrets._with_parts(docs).select("doc_id", "parts").collect()
    want = {}
    for r in every:
        near = lambda s, p: p.start - s.end <= 200 and s.start - p.end <= 200
        linked = lambda s, r=r: any(secrets.ROLE[p.kind] in secrets.NEEDS[s.kind] and near(s, p) for p in r.parts)
        want[r.doc_id] = [(s.kind, s.start, s.end) for s in r.parts if s.kind in secrets.BASE or linked(s)]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in secrets.scan(docs).collect()}
    assert got == want
    assert sum(len(r.parts) for r in every) > sum(map(len, want.values())) > len(texts)


def test_repeats_against_brute_force(docs, empty):
    first, want = {}, defaultdict(list)
    for i, t in sorted({(i, t or "") for i, t in TEXTS}):
        b = t.encode()
        gone = [False] * len(b)
        for s in range(len(b) - 99):
            if first.setdefault(b[s : s + 100], (i, s)) != (i, s):
                gone[s : s + 100] = [True] * 100
        want[i] = hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()
    got = repeats.removed(docs).collect()
    assert len(got) == len(TEXTS) and all(want[r.doc_id] == r.kept_sha256 for r in got)
    assert repeats.removed(empty).count() == 0


def test_tokens_equal_library(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.TOKENIZER)
    texts = ["", "Hello  world's\n\n 12ab<|endoftext|>x", "日本語 text", "naïve café x", LONG]
    library = Tokenizer.from_file(path)
    assert tokens.Counter(path).counts(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_near_groups(docs, empty):
    got = {r.doc_id: (r.component_id, r.kept) for r in near.groups(docs, width=4).collect()}
    assert got[1] == (1, True) and got[2] == (1, False) and got[3] == (1, False)
    assert got[5] == (5, True) and got[6] == (6, True) and got[7] == (7, True)
    assert near.groups(empty).count() == 0


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, "beta gamma DELTA epsilon zeta eta theta iota kappa lambda mu"), (2, "short"), (3, None)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.matches(docs, bench).collect()}
    assert got[1].items == ["1"] and (got[1].runs[0].start, got[1].runs[0].end) == (1, 12)
    assert got[7].items == ["2"] and got[5].n_words == 0
    assert {r.doc_id for r in decontaminate.remove(docs, bench).collect()} == {5, 6, 8}


@pytest.mark.parametrize("block_bytes", [decontaminate.BLOCK_BYTES, 40])
def test_decontamination_by_items_without_id(spark, monkeypatch, block_bytes):
    """They count as hits and remove documents, but are in no list of items, in one block or in many."""
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    bench = spark.createDataFrame([(None, LONG[:60]), (None, "only this"), (None, None), (4, "only that"), (4, LONG[:60] + "more")], "item_id long, text string")
    d = spark.createDataFrame([(1, "x " + LONG[:60]), (2, "Only THIS"), (3, "only that, only this"), (4, "other")], "doc_id long, text string")
    got = {r.doc_id: (sum(x["end"] - x["start"] for x in r.runs), r.items) for r in decontaminate.matches(d, bench).collect()}
    assert got == {1: (11, ["4"]), 2: (2, []), 3: (4, ["4"]), 4: (0, [])}
    assert [r.doc_id for r in decontaminate.remove(d, bench).collect()] == [4]


def test_mixing_counts_follow_rates(spark):
    d = spark.range(4000).selectExpr("id AS doc_id", "'some text' AS text", "IF(id % 4 = 0, 'small', 'big') AS source")
    n = {r.source: r["count"] for r in mixing.replicate(d, {"small": 1.0, "big": 1.0}).groupBy("source").count().collect()}
    assert abs(n["small"] - 2000) < 200 and abs(n["big"] - 2000) < 200
    assert mixing.replicate(d.where("false")).count() == 0


def test_mixing_query_of_whole_rows(spark, tmp_path):
    """A registered query gives the documents themselves, each as often as the query of ids says."""
    from colinear.llm.queries import queries

    d = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('text ', id, ' '), 1 + id % 5) AS text", "'en' AS lang", "IF(id % 4 = 0, 'small', 'big') AS source", "id * 3 AS n_chars")
    d.write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries()["op8_mixing_rows"](spark, str(tmp_path))
    assert rows.columns == [*d.columns, "copy", "mix_key"]
    rows, ids = rows.collect(), queries()["op8_mixing"](spark, str(tmp_path)).collect()
    assert [(r.doc_id, r.source, r.copy, r.mix_key) for r in rows] == [tuple(r) for r in ids] and len(rows) > 200
    own = {r.doc_id: tuple(r) for r in d.collect()}
    assert all(tuple(r)[:5] == own[r.doc_id] for r in rows)


def test_quality_separates_noise():
    posterior = quality.posteriors({"+0+++++": 900, "-0+-+++": 50, "-----+-": 50})
    assert posterior["+0+++++"] > 0.9 and posterior["-----+-"] < 0.1


def test_language_unknown_without_letters(docs, empty):
    names, log_p = language.learn(docs)
    assert names == ["en"]
    got = {r.doc_id: r.lang_pred for r in language.predict(docs, (names, log_p)).collect()}
    assert got[5] == got[6] == "und" and got[1] == "en"
    assert {r.lang_pred for r in language.predict(docs, language.learn(empty)).collect()} == {"und"}


def test_language_of_four_and_more():
    """Every size of set is open, and the bound that ends the search loses nothing against trying all sizes."""
    import numpy as np

    rng = np.random.default_rng(5)
    words = {k: ["".join(chr(97 + (5 * k + j) % 26) for j in rng.integers(0, 9, 6)) for _ in range(300)] for k in range(6)}
    counts = np.full((language.CELLS, 6), 0.5)
    for k, w in words.items():
        np.add.at(counts[:, k], language.features([" ".join(w * 3)])[0], 1)
    log_p = np.log(counts / counts.sum(axis=0)).astype(np.float32)
    mixes = ([400], [300, 300], [200] * 3, [250] * 4, [400, 200, 200, 200], [150] * 5, [200] * 6, [3, 2], [900, 30, 25, 20])
    texts = [" ".join(" ".join(rng.choice(words[k], n)) for k, n in enumerate(m)) for m in mixes]
    share, size = language.mixtures(texts, log_p)
    assert size[:7].tolist() == [1, 2, 3, 4, 4, 5, 6]
    assert np.allclose(share[3].max(), 0.25, atol=0.03) and np.allclose(share[4].max(), 0.4, atol=0.03)
    for text, own, n in zip(texts, share, size, strict=True):
        alone, n_alone = language.mixtures([text], log_p)
        assert n_alone[0] == n and np.allclose(alone[0], own, atol=1e-5)
        assert n == plain_size(text, log_p)


def plain_size(text, log_p):
    """The best set's size by the definition, trying every size."""
    import numpy as np

    cell, starts, _ = language.features([text])
    like = np.add.reduceat(log_p[cell], starts, axis=0).astype(float)
    chance = np.exp(np.maximum(like - like.max(axis=1, keepdims=True), -60))

    def em(share, rounds):
        for _ in range(rounds):
            share = (chance * share / (chance * share).sum(axis=1, keepdims=True)).mean(axis=0)
        return share

    full = em(np.full(log_p.shape[1], 1 / log_p.shape[1]), language.ROUNDS)
    fits = [(like - like.max(axis=1, keepdims=True)).sum(axis=0).max()]
    for k in range(2, len(full) + 1):
        start = np.where(np.isin(np.arange(len(full)), np.argsort(-full, kind="stable")[:k]), full + 1e-3, 0)
        share = em(start / start.sum(), language.SET_ROUNDS)
        fits.append(np.log((chance * share).sum(axis=1)).sum() - language.PENALTY * (k - 1) * np.log(len(chance) + 1))
    return int(np.argmax(fits)) + 1
