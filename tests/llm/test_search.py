"""Nearest neighbours and near duplicates against brute force, with the awkward rows of each."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import ann, near_dup

VECTORS = "vec_id long, embedding array<float>, query string, sim double"


def vectors():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(25, 24))
    near = [c + 0.15 * rng.normal(size=24) for c in centres for _ in range(14)]
    far = list(rng.normal(size=(150, 24)))
    return [(i, x.astype(np.float32).tolist()) for i, x in enumerate(near + far)] + [(900, near[0].tolist()), (901, near[0].tolist())]


def test_neighbours_reach_the_recall_of_brute_force(spark):
    rows = vectors()
    nan, inf = float("nan"), float("inf")
    awkward = [(None, rows[0][1]), (950, None), (951, []), (952, [1.0] * 23), (953, [nan] * 24), (954, [0.0] * 24), (955, [inf] + [1.0] * 23), (956, [None] + [1.0] * 23), rows[5]]
    df = spark.createDataFrame([(i, v, "q", 0.5) for i, v in rows + awkward], VECTORS)
    found = defaultdict(list)
    for r in ann.nearest_neighbours(df).collect():
        found[r["query"]].append((r["rank"], r.neighbour, r.cosine))
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -9)
    assert set(found) == set(ids.tolist())
    named = df.select(__import__("pyspark.sql.functions", fromlist=["x"]).concat("query", "vec_id").alias("vec_id"), "embedding")
    strings = ann.nearest_neighbours(named.where("vec_id IN ('q1', 'q2', 'q900', 'q901')")).collect()
    assert {(r["query"], r.neighbour) for r in strings} == {(a, b) for a in ("q1", "q2", "q900", "q901") for b in ("q1", "q2", "q900", "q901") if a != b}
    hits = 0
    for k, i in enumerate(ids.tolist()):
        got = sorted(found[i])
        assert [r for r, *_ in got] == list(range(1, 11)) and i not in [n for _, n, _ in got]
        for _, n, c in got:
            assert abs(c - sims[k, np.flatnonzero(ids == n)[0]]) < 2e-5
        kth = np.sort(sims[k])[-10]
        hits += sum(c >= kth - 2e-5 for *_, c in got)
    assert hits >= 0.9 * 10 * len(ids)


def test_few_vectors(spark):
    few = [(i, v) for i, v in vectors()[:3]]
    make = lambda rows: spark.createDataFrame([(i, v, "q", 0.5) for i, v in rows], VECTORS)
    assert {(r["query"], r.neighbour) for r in ann.nearest_neighbours(make(few)).collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    assert ann.nearest_neighbours(make(few[:1])).collect() == [] and ann.nearest_neighbours(make([])).collect() == []


def test_equal_vectors_are_neighbours_by_least_ids(spark):
    same = [0.6, 0.8]
    rows = [(i, same) for i in range(40)] + [(100, [1.0, 0.0]), (101, [0.0, 1.0])]
    out = ann.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3).collect()
    got = defaultdict(list)
    for r in sorted(out, key=lambda r: r["rank"]):
        got[r["query"]].append(r.neighbour)
    assert all(got[i] == [j for j in range(4) if j != i][:3] for i in range(40))
    assert got[101] == [0, 1, 2] and len(got) == 42


def test_stated_queries_are_answered_from_the_index(spark):
    """Recall on a given table; the queries of near vectors are done at the first radius."""
    from pyspark.sql import functions as F

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    x = np.array([r.embedding for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    out, wider = ann.search(df, queries=F.col("vec_id") % 100 == 0)
    found = defaultdict(dict)
    for r in out.collect():
        found[r["query"]][r.neighbour] = r.cosine
    assert set(found) == {i for i in ids.tolist() if i % 100 == 0}
    hits = 0
    for q, near in found.items():
        sims = x @ x[ids == q][0]
        sims[ids == q] = -9
        hits += sum(c >= np.sort(sims)[-10] - 2e-5 for c in near.values())
    assert hits >= 0.9 * 10 * len(found)
    assert "CartesianProduct" not in out._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString()
    near = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>")
    _, wider = ann.search(near)
    grouped = {r["query"] for r in wider.collect()}
    assert len(grouped & set(range(350))) < 350


def test_search_in_many_shards_and_blocks_is_exact(spark, monkeypatch):
    """Far queries read widely, by bounded parts: small shards, some partitions of several, and blocks of queries give what brute force gives."""
    monkeypatch.setattr(ann, "SHARD_VALUES", 64 * 20)
    monkeypatch.setattr(ann, "QUERY_VALUES", 64 * 200)
    rows = [(f"{i:03d}", v) for i, v in vectors()]
    out, wider = ann.search(spark.createDataFrame(rows, "vec_id string, embedding array<float>"))
    found = defaultdict(list)
    for r in sorted(out.collect(), key=lambda r: r["rank"]):
        found[r["query"]].append((-r.cosine, r.neighbour))
    x = np.array([v for _, v in rows], np.float32).astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    sims = x @ x.T
    np.fill_diagonal(sims, -9)
    assert set(found) == {i for i, _ in rows}
    for k, (i, _) in enumerate(rows):
        assert found[i] == sorted(found[i]) and i not in [n for _, n in found[i]] and len({n for _, n in found[i]}) == 10
        assert np.allclose([-c for c, _ in found[i]], np.sort(sims[k])[::-1][:10], atol=3e-6)
    assert [n for _, n in found["901"][:2]] == ["000", "900"]
    assert wider.count() == wider.select("query").distinct().count() > 0


def test_probes_of_far_queries_are_not_shuffled(spark, request):
    """What is written for shuffles stays near the size of vectors and answers, though nearly all queries need a wide radius."""
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty(60_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    # as with tables that are too large to broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    before = written()
    out, wider = ann.search(df)
    assert out.count() == 20_000 and wider.count() > 1500
    assert written() - before < 10e6


@pytest.mark.parametrize("radius", [26, ann.BITS])
def test_memory_of_a_search_does_not_grow_with_its_radius(radius):
    """Probes aren't listed: at such radii the keys that these queries read would take more."""
    import tracemalloc

    rng = np.random.default_rng(2)
    x = rng.normal(size=(8000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    fitted, own = ann.Fit(x[:2000], 1 << 20), np.arange(len(x))
    reach, codes = ann._reach(np.full(len(x), radius), fitted.parts), fitted.codes(x)
    keys = len(ann.probe_keys(int(codes[0]), radius, fitted.parts, {}))
    assert keys * 8 * len(x) > 250e6
    tracemalloc.start()
    best = ann.Best(x, np.full(len(x), -np.inf), 10)
    ann._search_shard(fitted, x, own, 0, own, codes, reach, best)
    best.settle()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
    sims = x[:50] @ x.T
    sims[np.arange(50), np.arange(50)] = -9
    hits = (best.sim[:50] >= np.sort(sims, axis=1)[:, -10:-9] - 2e-5).mean()
    assert hits > 0.95 if radius == ann.BITS else hits > 0.5


@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1), st.integers(0, 63))
@settings(max_examples=100, deadline=None)
def test_buckets_read_are_those_of_the_keys_probed(a, b, radius):
    parts = ann.substrings(5000)
    own = {(j << 32) + (b >> at & (1 << length) - 1) for j, (at, length) in enumerate(parts)}
    probed = bool(set(ann.probe_keys(a, radius, parts, {}).tolist()) & own)
    reach = ann._reach(np.array([radius]), parts)[0]
    read = any(((a ^ b) >> at & (1 << length) - 1).bit_count() <= e for (at, length), e in zip(parts, reach))
    assert read == probed or (reach[0] == parts[0][1] and read)


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=20), st.integers(2, 10**9))
@settings(max_examples=100, deadline=None)
def test_probing_finds_every_code_within_the_radius(code, flips, n):
    other = code ^ sum(1 << b for b in flips)
    parts = ann.substrings(n)
    assert sum(length for _, length in parts) == ann.BITS
    own = {(j << 32) + (other >> at & (1 << length) - 1) for j, (at, length) in enumerate(parts)}
    assert set(ann.probe_keys(code, len(flips), parts, {}).tolist()) & own


@given(st.lists(st.integers(0, 65535), min_size=near_dup.K, max_size=near_dup.K), st.sets(st.integers(0, near_dup.K - 1), max_size=near_dup.MAX_DIFF))
@settings(max_examples=200, deadline=None)
def test_every_pair_under_the_distance_shares_a_key(values, places):
    a = np.array(values, np.uint16)
    b = a.copy()
    for p in places:
        b[p] ^= 1
    keys = near_dup.chunk_keys(np.stack([a, b]))
    assert set(keys[0].tolist()) & set(keys[1].tolist())


def texts():
    r = random.Random(4)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))) for _ in range(4000)]
    rows, planted = [], []
    for g in range(30):
        base = r.choices(words, k=r.choice([40, 200, 900]))
        rows.append((10 * g, " ".join(base)))
        for k in range(1, 1 + g % 4):
            copy = list(base)
            for at in r.sample(range(len(copy)), max(1, len(copy) // 100) if k > 1 else 0):
                copy[at] = r.choice(words)
            rows.append((10 * g + k, " ".join(copy)))
            planted.append((10 * g, 10 * g + k))
    rows += [(1000 + i, "the very same short text of all these rows") for i in range(40)]
    rows += [(2000, "word"), (2001, "word"), (2002, "other"), (2003, "x y " * 30_000), (2004, "x y " * 30_000)]
    return rows, planted


AWKWARD = [(3000, None), (3001, ""), (3002, " ?! \n"), (None, "the very same short text of all these rows"), (None, "free"), (0, None)]


def brute_groups(rows):
    signed = [(i, s) for i, t in rows if i is not None and (s := near_dup.signature(t)) is not None]
    root = {i: i for i, _ in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = set()
    for k, (i, s) in enumerate(signed):
        for j, t in signed[:k]:
            if i != j and (s != t).sum() <= near_dup.MAX_DIFF:
                pairs.add((min(i, j), max(i, j)))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {i: find(i) for i in root}
    size = defaultdict(int)
    for g in groups.values():
        size[g] += 1
    return {i: g for i, g in groups.items() if size[g] > 1}, pairs


def brute_links(rows):
    """Other signatures within the distance of each document's own, and documents of its own."""
    signed = defaultdict(set)
    for i, t in rows:
        if i is not None and (s := near_dup.signature(t)) is not None:
            signed[i].add(s.tobytes())
    every = np.array([np.frombuffer(s, np.uint16) for s in sorted(set().union(*signed.values()))])
    links = {s.tobytes(): int((((every != s).sum(axis=1)) <= near_dup.MAX_DIFF).sum()) - 1 for s in every}
    holders = defaultdict(int)
    for ss in signed.values():
        for s in ss:
            holders[s] += 1
    return {i: (sum(links[s] for s in ss), max(holders[s] for s in ss)) for i, ss in signed.items()}


@pytest.mark.parametrize("block", [2, near_dup.BLOCK])
def test_near_duplicates_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rows, planted = texts()
    df = spark.createDataFrame([(i, t, "k", b"s", 1) for i, t in rows + AWKWARD], "doc_id long, text string, key string, sig binary, a int")
    groups, pairs = brute_groups(rows + AWKWARD)
    out = near_dup.near_duplicate_groups(df).collect()
    found, links = {r.doc_id: r.group_id for r in out}, brute_links(rows + AWKWARD)
    assert found == groups
    assert {r.doc_id: (r.n_links, r.n_copies) for r in out} == {i: links[i] for i in groups}
    assert all(found.get(a) == found.get(b) is not None for a, b in planted)
    assert {(r.a, r.b) for r in near_dup.near_duplicate_pairs(df).collect()} == pairs
    kept = near_dup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({i for i, _ in rows + AWKWARD if i is not None and groups.get(i, i) == i})
    assert ids.count(None) == 2
    empty = df.where("false")
    assert near_dup.near_duplicate_groups(empty).collect() == [] and near_dup.drop_near_duplicates(empty).collect() == []


def test_near_duplicates_of_ids_that_are_strings(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), ("c", "something else here"), ("d", "one two three four"), ("e", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    assert {(r.doc_id, r.group_id, r.n_links, r.n_copies) for r in near_dup.near_duplicate_groups(df).collect()} == {(i, "a", 0, 3) for i in "abd"}
    assert sorted(r.doc_id for r in near_dup.drop_near_duplicates(df).collect()) == ["a", "c", "e"]


def test_components_of_a_long_chain(spark):
    n = 200
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(900, 901)], "a long, b long")
    assert {r.id: r.root for r in near_dup.components(edges).collect()} == {**{i: 0 for i in range(n + 1)}, 900: 900, 901: 900}
