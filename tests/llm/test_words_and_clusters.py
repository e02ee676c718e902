"""Spelling variants, integer clusters and languages against brute force and held-out texts."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from sediment.llm import clusters, language, spelling

DOCS = "doc_id long, text string, lang string, word string, n long, judged string"


def _docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, g, "w", 3, "x") for i, t, g in rows], DOCS)


# ---- Spelling


def _counts(rows, every=97):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def _near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def _forms(counts):
    near = {w: [v for v in counts if v != w and _near(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def _texts(seed, n):
    rng = random.Random(seed)
    syllables = ["an", "be", "chä", "d÷", "ee", "ss", "ÿ", "À", "Mo", "tt"]
    words = ["".join(rng.choices(syllables, k=rng.randint(2, 4))) for _ in range(60)]
    words += [w[:i] + c + w[i + 1 :] for w in words for i, c in ((1, "x"), (3, "é"))]
    words += [w[:2] + w[3:] for w in words] + ["aaaaaa", "aaaaa", "aaaaaaa", "Z" * 90, "Z" * 89, "Z" * 90 + "y"]
    often = [2.0 ** -(i % 9) for i in range(len(words))]
    return [
        (None if i % 40 == 7 else i, rng.choice([" ", "\n", "中", "1"]).join(rng.choices(words, often, k=40)), "en")
        for i in range(n)
    ]


SPELLING = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.mark.parametrize("seed", [1, 2])
def test_spelling_groups_equal_brute_force(spark, seed):
    rows = [*_texts(seed, 150), (900, None, "en"), (901, "", "en"), (902, "1 2 ,", "en")]
    rows += [(5, "Hello hallo", "en")] * 4 + [(6, "stone " * 40 + "stonee " * 12 + "stoneey " * 4, "en")]
    words = spelling.word_counts(_docs(spark, rows))
    counts = _counts([r[:2] for r in rows])
    assert {(r["word"], r["n"]) for r in words.collect()} == set(counts.items())
    found = spelling.spelling_groups(words)
    assert found.columns == SPELLING
    expected = _forms(counts)
    assert sum(r[1] is not None for r in expected) > 12
    assert any(r[1] is not None and r[1] != r[2] for r in expected)
    collected = [tuple(r) for r in found.collect()]
    assert len(collected) == len(expected) and set(collected) == expected


def test_more_passes_find_the_same_pairs(spark, monkeypatch):
    words = spelling.word_counts(_docs(spark, _texts(3, 300)), every=5)
    whole = {tuple(r) for r in spelling.spelling_groups(words).collect()}
    monkeypatch.setattr(spelling, "PASS_BLOCKS", 8)
    monkeypatch.setattr(spelling, "_CHUNK", 4)
    seen = []
    prober = spelling._prober
    monkeypatch.setattr(spelling, "_prober", lambda *a: seen.append(1) or prober(*a))
    assert {tuple(r) for r in spelling.spelling_groups(words).collect()} == whole
    assert len(seen) > 2


def test_filters_have_no_misses_and_few_false_hits():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(4000)]
    layout = spelling._layout({9: len(words)})
    codes = spelling._letters(words, 9)
    block, low = layout.slots(spelling.word_hashes(codes), 9)
    parts = np.zeros(layout.blocks * 8, np.uint32)
    for lane in range(8):
        np.bitwise_or.at(
            parts, block.astype(int) * 8 + lane, (np.uint64(1) << spelling._bit(low, lane)).astype(np.uint32)
        )
    filters = spelling.Filters(layout, 0, parts)
    assert len(filters.hits(spelling.word_hashes(codes), 9)) == len(words)
    others = ["".join(rng.choices("ijklmnop", k=9)) for _ in range(100_000)]
    assert len(filters.hits(spelling.word_hashes(spelling._letters(others, 9)), 9)) < 300


def test_a_very_long_word_and_one_frequent_word(spark):
    long = "ab" * 4000
    rows = [(i, f"{long} {long[:-1]}c common", "en") for i in range(4)] + [(i, "common " * 2000, "en") for i in range(50)]
    found = {r["word"]: r for r in spelling.spelling_groups(spelling.word_counts(_docs(spark, rows), every=10**9)).collect()}
    assert found[long]["n_near"] == 1 and found[long]["form"] is None
    assert found["common"]["n"] == 100_004


def test_spelling_of_an_empty_table(spark):
    assert spelling.spelling_groups(spelling.word_counts(_docs(spark, []))).collect() == []
    with pytest.raises(ValueError):
        spelling.spelling_groups(spelling.word_counts(_docs(spark, [])), ratio=1)


# ---- Clusters


def _lloyd(vectors, k=16, rounds=3):
    """Rows of (vec_id, vector) by plain integer arithmetic."""
    kept = []
    for i, v in vectors:
        if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(64 * x) for x in v]))

    def name(i):
        return hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()

    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assigned():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assigned()
        for c in range(len(centroids)):
            mine = [v for (_, v), (a, _) in zip(kept, at, strict=True) if a == c]
            if mine:
                centroids[c] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    rows = []
    at = assigned()
    for (i, _), (c, d) in zip(kept, at, strict=True):
        sha = hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
        rows.append((i, c, d, sum(e for a, e in at if a == c), sum(e for _, e in at), sha))
    return rows


CLUSTERS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
VECTORS = "vec_id long, embedding array<float>, grid string, cluster int"


def _vectors(spark, rows):
    return spark.createDataFrame([(i, v, "g", 5) for i, v in rows], VECTORS)


def _sample(seed, n):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.1 + (i % 7) / 5, 64) + i % 5]) for i in range(n)]
    rows += [(n, None), (n + 1, []), (n + 2, [0.5] * 63), (n + 3, [None] + [0.5] * 63), (n + 4, [math.nan] * 64)]
    rows += [(n + 5, [math.inf] + [0.0] * 63), (n + 6, [0.0] * 64), (None, rows[0][1]), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_equal_plain_arithmetic(spark, seed):
    rows = _sample(seed, 150)
    found = clusters.with_inertia(clusters.cluster_vectors(_vectors(spark, rows)))
    assert found.columns == CLUSTERS
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_lloyd(rows), key=repr)


def test_large_components_are_exact(spark):
    rows = [(i, [float(np.float32(x)) * 2.0**15 for x in np.random.default_rng(i).normal(0, 3, 64)]) for i in range(60)]
    found = clusters.with_inertia(clusters.cluster_vectors(_vectors(spark, rows), k=5))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_lloyd(rows, 5), key=repr)


@pytest.mark.parametrize("n", [0, 1, 9])
def test_fewer_vectors_than_centroids_and_ties(spark, n):
    rows = [(i, [float(i % 2)] * 64) for i in range(n)]
    found = clusters.with_inertia(clusters.cluster_vectors(_vectors(spark, rows)))
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(_lloyd(rows), key=repr)


def test_search_equals_all_distances_and_leaves_centroids_out():
    rng = np.random.default_rng(3)
    rows, centroids = rng.integers(-40, 40, (500, 64)), rng.integers(-40, 40, (16, 64))
    rows[:16] = centroids
    rows[16] = (centroids[2] + centroids[5]) // 2
    number, distance = clusters.nearest(rows, centroids)
    every = ((rows[:, None] - centroids[None]) ** 2).sum(axis=2)
    assert (number == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    energy = (clusters.transform(rows) ** 2).sum(axis=1)
    assert (energy == 64 * (rows**2).sum(axis=1)).all()


# ---- Languages


ALPHABETS = {
    "aa": ["tha", "on", "ed", "ing", "was", "er"], "bb": ["sch", "ü", "ein", "ung", "der", "tz"],
    "cc": ["中", "文", "字", "的"],
}


def _prose(rng, kind, n):
    return " ".join("".join(rng.choices(ALPHABETS[kind], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    kinds = rng.choices(["aa", "bb", "cc"], weights=[8, 3, 1], k=400)
    return [(i, _prose(rng, k, rng.randint(3, 120)), k if i % 11 else None) for i, k in enumerate(kinds)], kinds


def test_held_out_texts_get_their_language(spark, prose):
    rows, kinds = prose
    docs = _docs(spark, rows)
    model = language.fit(docs, pieces=600)
    found = language.languages(docs, model)
    assert found.columns == [*DOCS.replace(",", "").split()[::2], "lang_pred", "score", "rejected"]
    held = [r for r in found.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    right = [r["lang_pred"] == kinds[r["doc_id"]] for r in held]
    assert len(right) > 100 and sum(right) >= 0.98 * len(right)
    assert all(0 <= r["score"] <= 1 for r in held)
    assert sum(r["rejected"] for r in held) <= 0.05 * len(held)


def test_only_learnable_rows_are_learned_from(spark, prose):
    rows, kinds = prose
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 == 1]
    others = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 3 != 1]
    lied = [*others, *[(i, t, "zz") for i, t, _ in held]]
    a, b = (language.fit(_docs(spark, r), pieces=300) for r in (others, lied))
    assert a.languages == b.languages == ["aa", "bb", "cc"]
    assert (a.table == b.table).all() and a.heat == b.heat


def test_texts_without_letters_unknown_ones_and_long_ones(spark, prose):
    rows, _ = prose
    model = language.fit(_docs(spark, rows), pieces=600)
    rng = random.Random(1)
    long = _prose(rng, "bb", 60_000)
    odd = [(None, None, None), (1, "", "aa"), (1, "12 \n-- !", "aa"), (2, long, None), (2, long, None), (3, "qqq xkx jvj " * 9, None)]
    found = [tuple(r)[-3:] for r in language.languages(_docs(spark, odd), model).collect()]
    assert found[:3] == [("und", 0.0, True)] * 3
    assert found[3][0] == "bb" and not found[3][2] and found[3] == found[4]
    assert found[5][0] in model.languages and found[5][2]


def test_long_texts_are_judged_in_blocks_as_in_one(spark, prose, monkeypatch):
    rows, _ = prose
    model = language.fit(_docs(spark, rows), pieces=300)
    text = _prose(random.Random(2), "aa", 900) + " , " + _prose(random.Random(2), "cc", 900)
    whole = model.judge(text)
    monkeypatch.setattr(language, "_BLOCK", 7)
    assert model.judge(text)[0] == whole[0]
    assert np.allclose(model.judge(text)[1:], whole[1:], atol=1e-9)


def test_empty_tables_and_no_languages(spark):
    empty = _docs(spark, [])
    assert language.languages(empty, language.fit(empty)).collect() == []
    nameless = _docs(spark, [(1, "some text", None)])
    row = language.languages(nameless, language.fit(nameless)).collect()[0]
    assert row["lang_pred"] == "und" and row["score"] == 0 and row["rejected"]


def test_a_step_follows_the_derivative():
    rng = np.random.default_rng(0)
    inner, outer, bias = rng.normal(size=(20, 3)), rng.normal(size=(4, 3)), rng.normal(size=4)
    at, weight, label = np.array([2, 5, 11]), np.array([0.5, 0.3, 0.2]), 2

    def loss(parameters):
        inner, outer, bias = parameters
        return -math.log(language.softmax(outer @ (8 * (weight @ inner[at])) + bias)[label])

    before = [inner.copy(), outer.copy(), bias.copy()]
    language.descend(inner, outer, bias, at, weight, label, 1.0)
    for n, after in enumerate((inner, outer, bias)):
        for cell in np.ndindex(after.shape):
            sides = []
            for d in (1e-6, -1e-6):
                moved = [p.copy() for p in before]
                moved[n][cell] += d
                sides.append(loss(moved))
            slope = (sides[0] - sides[1]) / 2e-6
            assert math.isclose(before[n][cell] - after[cell], slope, abs_tol=1e-6)
