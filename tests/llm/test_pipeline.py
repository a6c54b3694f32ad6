"""Every stage of the pipeline against a plain version of it, over all rows and texts."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("colinear.llm.queries")
import corpus_pipeline  # noqa: E402
from colinear.llm import language, secrets  # noqa: E402


def made():
    """Four languages, mixes of them, chains of near copies, benchmark passages, long credentials and a hot source."""
    rng = random.Random(3)
    vocabulary = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[k * 5 : k * 5 + 9]) for _ in range(6)) for _ in range(400)] for k in range(4)]
    prose = lambda k, n: " ".join(rng.choice(vocabulary[k]) for _ in range(n))
    rows = [(i, prose(i % 4, 120), f"l{i % 4}", "hot" if i % 10 else f"s{i % 3}") for i in range(60)]
    for i, parts in enumerate(([240, 120, 120, 120], [150] * 4, [400, 100, 100, 0], [300, 90, 90, 90], [270, 110, 110, 110])):
        rows.append((100 + i, " ".join(prose(k, n) for k, n in enumerate(parts)), None, "hot"))
    for g in range(3):
        words = prose(g, 120).split()
        for k in range(6):
            rows.append((200 + 10 * g + k, " ".join(words), f"l{g}", "s1"))
            words[(17 * k + 11) % 110] = vocabulary[g][k]
    item = prose(1, 14)
    rows.append((300, prose(1, 40) + " " + item + " " + prose(1, 40), "l1", "hot"))
    for i, n in enumerate((250, 600, 2000)):
        rows.append((310 + i, f"{prose(2, 600)} token={'Ab1.' * (n // 4)} username=someone {prose(2, 60)} https://a.b/c {prose(2, 9)}", "l2", "hot"))
    return [(*r, len(r[1])) for r in rows], [(1, item)]


def plain_main(text, log_p):
    """The largest proportion of the best set, trying every size."""
    cell, starts, _ = language.features([text])
    like = np.add.reduceat(log_p[cell], starts, axis=0).astype(float)
    like -= like.max(axis=1, keepdims=True)
    chance = np.exp(np.maximum(like, -60))

    def em(share, rounds):
        for _ in range(rounds):
            share = (chance * share / (chance * share).sum(axis=1, keepdims=True)).mean(axis=0)
        return share

    full = em(np.full(log_p.shape[1], 1 / log_p.shape[1]), language.ROUNDS)
    found = [(like.sum(axis=0).max(), 1.0)]
    for k in range(2, len(full) + 1):
        start = np.where(np.isin(np.arange(len(full)), np.argsort(-full, kind="stable")[:k]), full + 1e-3, 0)
        share = em(start / start.sum(), language.SET_ROUNDS)
        found.append((np.log((chance * share).sum(axis=1)).sum() - language.PENALTY * (k - 1) * math.log(len(chance) + 1), share.max()))
    return max(found)[1]


def plain_dedup(rows):
    sets = {r[0]: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for r in rows for w in [r[1].lower().split()]}
    reach, changed = {i: i for i in sets}, True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if reach[a] < reach[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    reach[b], changed = reach[a], True
    return [r for r in rows if reach[r[0]] == r[0]]


def plain_masked(text):
    holds = {"assign": lambda m: len(m.group(2)) >= 6, "access": lambda m: len(m.group()) >= 20, "blob": lambda m: all(re.search(x, m.group()) for x in ("[0-9]", "[a-z]", "[A-Z]"))}
    patterns = {k: getattr(secrets, k.upper()) for k in secrets.KINDS}
    spans = [(m.start(), m.end(), k) for k, p in patterns.items() for m in re.finditer(p, text) if holds.get(k, bool)(m)]
    near = lambda a, b: b[0] - a[1] <= secrets.SCOPE and a[0] - b[1] <= secrets.SCOPE
    kept = sorted(a for a in spans if a[2] in secrets.BASE or any(secrets.ROLE[b[2]] in secrets.NEEDS[a[2]] and near(a, b) for b in spans))
    out, at = "", 0
    for start, end, _ in kept:
        if start >= at:
            out += text[at:start] + secrets.MASK
        at = max(at, end)
    return out + text[at:]


def plain_mix(rows):
    chars = Counter()
    for r in rows:
        chars[r[3]] += len(r[1])
    roots = sum(math.sqrt(n) for n in chars.values())
    out = []
    for r in rows:
        rate = math.sqrt(chars[r[3]]) / roots * sum(chars.values()) / chars[r[3]]
        u = int(hashlib.md5(f"mix-1-{r[0]}".encode()).hexdigest()[:13], 16) / (1 << 52)
        n, p, total = 0, math.exp(-rate), math.exp(-rate)
        while total <= u:
            n += 1
            p *= rate / n
            total += p
        out += [(*r, k, hashlib.md5(f"mix-1-order-{r[0]}-{k}".encode()).hexdigest()) for k in range(1, n + 1)]
    return out


def test_stages_equal_plain_versions(spark, tmp_path):
    rows, items = made()
    now = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    now.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    log_p = language.learn(now)[1]
    windows = {tuple(w[k : k + 10]) for _, t in items for w in [t.split()] for k in range(len(w) - 9)}
    plain = {
        "language_id": lambda x: [r for r in x if plain_main(r[1], log_p) >= corpus_pipeline.MAIN_SHARE],
        "near_dedup": plain_dedup,
        "decontamination": lambda x: [r for r in x if not windows & {tuple(w[k : k + 10]) for w in [r[1].split()] for k in range(len(w) - 9)}],
        "secret_scan": lambda x: [(r[0], plain_masked(r[1]), *r[2:]) for r in x],
        "mix": plain_mix,
    }
    for name, stage in corpus_pipeline.STAGES:
        want = plain[name](rows)
        assert want != rows, name
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert sorted(map(repr, map(tuple, now.collect()))) == sorted(map(repr, want)), name
        rows = want
    assert sorted(map(repr, map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()))) == sorted(map(repr, rows))
