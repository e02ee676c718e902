"""SimHash groups, repeated strings, components and vectors against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from sediment.llm import graph, queries, repeats, simhash, vectors

DOCS = "doc_id long, text string, source string, fp long, id string, component_id long"


def _docs(spark, rows):
    """Documents with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "s", 7, "x", 9) for i, t in rows], DOCS)


def _prose(rng, n):
    return " ".join(rng.choice(["Ab", "cé", "the", "of", "in", "x1", "-"]) + rng.choice("abcdef") for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    base = [_prose(rng, n) for n in (0, 1, 2, 3, 40, 80, 300, 300)]
    near = [base[6] + " tail", base[7].replace("the", "The", 1), base[7][:-4] + " zz"]
    passage = _prose(rng, 70)
    shared = [_prose(rng, 30) + passage + _prose(rng, 30) for _ in range(4)]
    periodic = ["ab" * 400, "é" * 500, "\x00" * 64 + base[5]]
    return [None, "", "  \n", *base, *near, base[6], *shared, *periodic]


def _fingerprint(text):
    words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(prints, distance):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in prints}


@pytest.mark.parametrize("distance", [0, 2, 3, 5])
def test_simhash_against_brute_force(spark, texts, distance):
    got = simhash.simhash_groups(_docs(spark, enumerate(texts)), distance=distance).collect()
    prints = {i: _fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fp % (1 << 64) for r in got} == prints
    assert {r.doc_id: r.component_id for r in got} == _groups(prints, distance)


def test_every_pair_within_the_distance_is_linked(spark):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    flips = [(a, b) for a in range(64) for b in range(a, 64)]
    prints = {centre} | {centre ^ (1 << a) ^ (1 << b) * (a != b) for a, b in flips}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), 2)
    linked = {r.v for r in found.filter(found.u == (centre - (1 << 64) if centre >> 63 else centre)).collect()}
    assert len(linked) == len(prints) - 1


def test_one_document_of_a_group_stays(spark, texts):
    rows = [*enumerate(texts), (1, ""), (None, texts[-1]), (99, texts[6])]
    docs = _docs(spark, rows)
    stay = simhash.drop_near_copies(docs)
    assert stay.columns == docs.columns
    prints = {i: _fingerprint(t) for i, t in enumerate(texts)}
    assert sorted(r.doc_id for r in stay.collect()) == sorted(set(_groups(prints, 2).values()))


def test_fingerprints_are_made_once_where_copies_go(spark):
    """A second evaluation in one task would also take a second Python worker for it."""
    docs = _docs(spark, [(1, "some words"), (2, "other words"), (3, None)])
    stay = simhash.drop_near_copies(docs)
    assert stay._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert sorted(r.doc_id for r in stay.collect()) == [1, 2, 3]


def _covered(datas, length):
    starts = Counter(d[p : p + length] for d in datas for p in range(len(d) - length + 1))
    out = []
    for d in datas:
        covered = np.zeros(len(d) + 1, int)
        for p in range(len(d) - length + 1):
            if starts[d[p : p + length]] > 1:
                covered[p] += 1
                covered[p + length] -= 1
        out.append(np.cumsum(covered)[: len(d)] > 0)
    return out


@pytest.mark.parametrize("length", [400, 64, 16])
def test_repeats_against_brute_force(spark, texts, length):
    _check_repeats(spark, [*enumerate(texts), (3, texts[3]), (None, texts[8])], length)


@pytest.mark.parametrize("length", [400, 100])
def test_a_passage_with_other_neighbours_in_every_text(spark, length):
    """Edges of one passage: a hot bucket with many kinds, of which some share more bytes."""
    rng = random.Random(9)
    passage = _prose(rng, 150)
    around = [_prose(rng, 40) for _ in range(6)]
    rows = []
    for i in range(120):
        before, after = _prose(rng, 30), _prose(rng, 30)
        if i % 3 == 0:
            before += around[i % 6][-(i + 1) :]
        if i % 5 == 0:
            after = around[i % 4][: 2 * i + 1] + after
        rows.append((i, before + passage[i % 7 :] + after))
    _check_repeats(spark, [*rows, *rows[:3]], length)


def test_rounds_agree_with_hot_identifiers_and_small_cells(spark, texts, monkeypatch):
    """Every identifier with over a third of the rows is split; results stay the same."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        _check_repeats(spark, [(i, texts[7] + "é" * (i % 4)) for i in range(40)], 64)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def _check_repeats(spark, rows, length):
    datas = [(t or "").encode() for _, t in rows]
    expected = []
    for (i, _), data, gone in zip(rows, datas, _covered(datas, length), strict=True):
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        expected.append((i, len(data), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    got = repeats.remove_repeats(_docs(spark, rows), length=length).collect()
    found = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in got]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize(("length", "shorter"), [(400, 256), (100, 16), (64, 64)])
def test_shorter_repeats_are_told_and_stay(spark, texts, length, shorter):
    """A long repeat, touching short ones, rows that repeat, and texts with both kinds."""
    rng = random.Random(4)
    passages = [_prose(rng, 80)[:n] for n in (length, length - 1, shorter, shorter, shorter - 1)]
    mixed = [_prose(rng, 20) + "".join(rng.sample(passages, k)) + _prose(rng, 20) for k in (1, 2, 3, 4, 5) * 4]
    mixed += [passages[2] + passages[3], passages[2], passages[3], *passages]
    rows = [*enumerate([*texts, *mixed]), (3, texts[3]), (None, texts[8]), (30, mixed[4])]
    datas = [(t or "").encode() for _, t in rows]
    expected = []
    covered = zip(rows, datas, _covered(datas, length), _covered(datas, shorter), strict=True)
    for (i, _), data, gone, told in covered:
        left = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        expected.append((i, len(data), int(gone.sum()), hashlib.sha256(left).hexdigest(), int(told.sum())))
    got = repeats.remove_repeats(_docs(spark, rows), length=length, shorter=shorter).collect()
    found = [(r.doc_id, r.n_bytes, r.n_removed, hashlib.sha256(r.kept).hexdigest(), r.n_repeated) for r in got]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_planted_passages_of_over_50_words_are_told(spark, tmp_path):
    """Passages too short for the 400 bytes of the contract: they stay, and are counted."""
    rng = random.Random(6)
    passages = [_prose(rng, 85) for _ in range(5)]
    assert all(256 <= len(p.encode()) < 400 for p in passages)
    rows = [(i, _prose(rng, 50) + " " + passages[i % 5] + " " + _prose(rng, 50)) for i in range(20)]
    rows += [(20 + i, _prose(rng, 160)) for i in range(20)]
    _docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    for r in queries.op9_repeats(spark, str(tmp_path)).collect():
        assert r.n_removed == 0 and (r.n_repeated > 0) == (r.doc_id < 20)


def test_runs_of_long_texts_are_cut_at_blocks(monkeypatch):
    data = np.random.default_rng(1).integers(97, 123, 5000, dtype=np.uint8).tobytes()
    whole = repeats.runs_of(data, 64)
    monkeypatch.setattr(repeats, "_BLOCK", 1000)
    cut = repeats.runs_of(data, 64)
    assert whole[4].sum() == cut[4].sum() == 5000 - 63
    assert set(cut[0].tolist()) == set(whole[0].tolist())


def test_repeats_of_empty_tables_and_names_that_operators_use(spark, texts):
    empty = _docs(spark, [])
    assert repeats.remove_repeats(empty).collect() == [] and repeats.drop_repeats(empty).collect() == []
    names = ["__starts", "__id", "starts", "doc", "rest", "of", "print", "data"]
    docs = spark.createDataFrame([(i, t, *["own"] * len(names)) for i, t in enumerate(texts)],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = repeats.drop_repeats(docs, length=64)
    plain = {r.doc_id: r.text for r in repeats.drop_repeats(_docs(spark, enumerate(texts)), length=64).collect()}
    assert out.columns == docs.columns and {r.doc_id: r.text for r in out.collect()} == plain
    assert all(r[n] == "own" for r in out.collect() for n in names)


def test_dropping_repeats_keeps_rows_and_columns(spark, texts):
    docs = _docs(spark, enumerate(texts))
    out = repeats.drop_repeats(docs, length=64)
    assert out.columns == docs.columns and out.count() == len(texts)
    assert out.filter("doc_id = 0").first().text is None


def test_components(spark):
    rng = random.Random(2)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(50)]
    loose = [(2000 + rng.randrange(40), 2000 + rng.randrange(40)) for _ in range(30)]
    edges = chain + star + loose + [(7, 7), (5000, 5000)] + chain[:5]
    root = {n: n for e in edges for n in e}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    alone = {n for n in root if all(a == b or n not in (a, b) for a, b in edges)}
    got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {r.node: r.root for r in got} == {n: find(n) for n in root if n not in alone}


def test_components_without_edges(spark):
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((260, 16))
    for start, size in ((0, 2), (10, 40), (100, 15)):
        x[start : start + size] = x[start] + 0.12 * rng.standard_normal((size, 16))
    x[200:206] = x[200]
    rows = [(i, v.tolist(), "a", 1) for i, v in enumerate(x.astype(np.float32))]
    odd = [None, [], [0.0] * 16, [None] + [1.0] * 15, [float("nan")] * 16, [float("inf")] * 16]
    rows += [(300 + i, v, "a", 1) for i, v in enumerate(odd)]
    unit = np.array([r[1] for r in rows[:260]], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    np.fill_diagonal(near, False)
    root = list(range(260))
    for _ in range(260):
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(260)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, node string, n_links int")
    found = vectors.near_vectors(frame, settings=vectors.Settings(neighbours=6))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found.rows.collect()}
    assert found.recall >= 0.97
    expected = {i: (int(near[i].sum()), root[i], root[i] == i) for i in range(260)}
    expected |= {300 + i: (0, 300 + i, True) for i in range(len(odd))}
    assert got == expected


def _tight_clusters(rng, centres, size, spread):
    """Vectors close around each centre, shuffled."""
    x = np.repeat(centres, size, axis=0) + spread * rng.standard_normal((len(centres) * size, centres.shape[1]))
    return rng.permutation(x)


def _links_and_roots(x, threshold=0.9):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.array([min([root[i], *root[near[i]]]) for i in range(len(x))])
    return near.sum(1), root


@pytest.mark.parametrize("clusters", [2, 5])
def test_links_between_clusters_that_fill_their_lists(spark, clusters):
    """Lists of 10 hold none of the links to another cluster, nor longer ones all of those to several."""
    rng = np.random.default_rng(11)
    base = np.linalg.qr(rng.standard_normal((32, 32)))[0]
    # Every two centres have the cosine 0.905.
    centres = np.sqrt(0.905) * base[0] + np.sqrt(0.095) * base[1 : clusters + 1]
    x = np.concatenate((_tight_clusters(rng, centres, 20, 0.01), rng.standard_normal((300, 32))))
    links, root = _links_and_roots(x)
    assert len(set(root[: clusters * 20])) == 1 and links.sum() > clusters * 20 * 19
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_vectors(frame).rows.collect()}
    assert got == {i: (links[i], root[i]) for i in range(len(x))}


def test_partitions_keep_up_with_the_length_of_codes():
    settings = vectors.Settings()
    for count in (100, 10_000, 10**6, 10**8):
        bits = vectors._bits(count)
        shared = (1 - np.arccos(0.9) / np.pi) ** bits
        assert 1 - (1 - shared) ** vectors._tables(bits, 0.9, settings) >= settings.recall


def test_a_hot_cluster_does_not_hide_missed_pairs():
    truth = {0: 5000, 1: 4000} | {i: 1 for i in range(2, 12)}
    got = {0: 5000, 1: 4000, 2: 1}
    assert vectors._recall(truth, got, 10) == 0.1
    assert vectors._recall({}, {}, 10) is None


def test_missed_recall_is_an_error(spark):
    """A recall that cannot be reached stops the job."""
    x = np.random.default_rng(3).standard_normal((40, 8)).repeat(2, axis=0) + np.tile([[0.0], [0.01]], (40, 8))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    with pytest.raises(RuntimeError, match="audited links"):
        vectors.near_vectors(frame, settings=vectors.Settings(recall=1.01, rounds=0, tries=1))


def test_recall_is_measured_where_no_vector_has_a_link(spark):
    x = np.random.default_rng(6).standard_normal((300, 64))
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = vectors.near_vectors(frame, settings=vectors.Settings(audited=64))
    assert 0.97 <= found.recall <= 1
    assert {(r.n_links, r.kept) for r in found.rows.collect()} == {(0, True)}


def test_planted_copies(spark):
    settings = vectors.Settings(neighbours=2, audited=8)
    x = np.random.default_rng(7).standard_normal((8, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    nodes = spark.createDataFrame([(i, bytearray(v.tobytes())) for i, v in enumerate(x)], "node long, vector binary")
    planted = vectors._planted(nodes, 0.9, settings)
    rows = planted.collect()
    cosines = sorted(float(np.frombuffer(r.vector) @ x[r.origin]) for r in rows)
    assert len(rows) == 8 and cosines[0] >= 0.9 and cosines[-1] <= 0.95
    # One has its origin in its list, one has a list full of other links, one a list without its origin.
    lists = [
        (rows[0].node, [(-0.9, rows[0].origin, False)]),
        (rows[1].node, [(-0.95, 100, False), (-0.94, 101, False)]),
        (rows[2].node, [(-0.2, 100, False)]),
    ]
    graph = spark.createDataFrame(lists, "u long, list array<struct<far: double, v: long, new: boolean>>")
    assert vectors._planted_recall(graph, planted, 0.9, settings) == 1 / 7
    flat = spark.createDataFrame([(1, bytearray(np.ones(1).tobytes()))], "node long, vector binary")
    assert vectors._planted(flat, 0.9, settings) is None


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    found = vectors.near_vectors(empty)
    assert found.rows.count() == 0 and found.recall == 1
