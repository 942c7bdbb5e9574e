"""Operators that have no SQL against brute force on small fixtures, and readers and records on hand-made rows."""

from __future__ import annotations

import difflib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import address
from quern.operators import dedup, graph, records, rows, series, stats, vectors
from quern.sources import files
from quern.streaming import rates


def random_graph(seed, n=40, m=35):
    r = random.Random(seed)
    return {tuple(sorted(r.sample(range(n), 2))) for _ in range(m)}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_a_search(spark, seed):
    edges = random_graph(seed)
    nodes, canonical = graph.build(spark.createDataFrame([*edges, (0, 0)] + [(b, a) for a, b in edges], "src int, dst int"), spark.createDataFrame([(i,) for i in range(40)], "node int"))
    root = {i: i for i in range(40)}
    for _ in range(40):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.component for r in graph.components(nodes, canonical).collect()} == root
    near = {i: {a + b - i for a, b in edges if i in (a, b)} for i in range(40)}
    for r in graph.clustering(nodes, canonical).collect():
        tied = sum(tuple(sorted(p)) in edges for p in itertools.combinations(near[r.node], 2))
        pairs = len(near[r.node]) * (len(near[r.node]) - 1) / 2
        assert (r.degree, r.triangles) == (len(near[r.node]), tied) and abs(r.coefficient - (tied / pairs if pairs else 0)) < 1e-12


def test_least_cut_matches_all_splits():
    for seed in range(8):
        n = 6
        edges = list(random_graph(seed, n, 9))
        cuts = [sum((a in s) != (b in s) for a, b in edges) for k in range(1, n) for s in map(set, itertools.combinations(range(n), k))]
        assert graph.min_cut(n, edges) == min(cuts)


def test_similar_rows_lose_no_pair(spark):
    r = random.Random(5)
    names = ["Anna Kowal", "Anna Kowalska", "Jan Nowak", "", "Jan Nowacki"]
    data = [(i, f"{r.choice(['May', 'June'])} {r.randint(1, 9)}, 193{r.randint(5, 6)}", r.choice(names), r.choice(["Town", "Towns", "City"]), r.choice(["A fire.", "A fire broke out."]), r.choice(["fire; town", "town;fire ", "", "x"])) for i in range(30)]
    df = spark.createDataFrame(data, "idx int, date string, names string, location string, description string, tags string")
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    tags = lambda t: {x.strip() for x in t.lower().split(";") if x.strip()}
    expected = {}
    for a, b in itertools.combinations(data, 2):
        x, y = tags(a[5]), tags(b[5])
        same = len(x & y) / len(x | y) if x | y else 1.0
        s = 0.1 * same + 0.3 * ratio(a[1], b[1]) + sum(w * ratio(a[k].lower(), b[k].lower()) for k, w in ((2, 0.3), (3, 0.2), (4, 0.1)))
        if s >= 0.85 + 1e-9:
            expected[a[0], b[0]] = round(s, 9)
    pairs = dedup.similar_rows(df, "idx")
    found = {(p.i, p.j): round(p.similarity, 9) for p in pairs.collect() if p.similarity >= 0.85 + 1e-9}
    assert found == expected and found
    assert {x.idx for x in dedup.keep_first(df, pairs, "idx").collect()} == set(range(30)) - {p.j for p in pairs.collect()}


def test_house_numbers(spark):
    got = spark.createDataFrame([("3 Maja 14",), ("3 Maja",), ("Łucka 12",), ("",), (None,), ("51°12'57.70\"N",)], "a string")
    a = got.a
    out = got.select(address.first_number(a).alias("f"), address.last_token_number(a).alias("l"), address.street_and_number(a).alias("s"), address.dms_degrees(a).alias("d")).collect()
    assert [r.f for r in out] == [3.0, 3.0, 12.0, None, None, 51.0] and [r.l for r in out] == [14, None, 12, None, None, None]
    assert (out[0].s.street, out[0].s.number) == ("3 Maja", 14) and out[2].s.street == "Łucka" and abs(out[5].d - 51.21602777) < 1e-6 and out[0].d is None


def test_ragged_rows_and_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"two\nlines",3,4\n000\n', encoding="utf-8")
    ragged = sorted((r.row_idx, list(r.fields)) for r in files.read_ragged_csv(spark, f"{tmp_path}/a.csv").collect())
    assert ragged == [(0, ["x", "y"]), (1, ["1", "two\nlines", "3", "4"]), (2, ["000"])]
    (tmp_path / "b.txt").write_text("one\ntwo", encoding="utf-8")
    assert sorted((r.line_no, r.line) for r in files.read_lines(spark, f"{tmp_path}/b.txt").collect()) == [(0, "one"), (1, "two")]
    assert files.load_records(spark, [{"a": "1"}], files.strings("a")).collect()[0].a == "1"
    with pytest.raises(ValueError):
        files.load_records(spark, "x.xml", files.strings("a"))
    assert files.read_csv_or_none(spark, f"{tmp_path}/none.csv", files.strings("a")) is None
    (tmp_path / "p.ply").write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nend_header\n1 2 3\n4 5 6\n")
    assert sorted((r.x, r.y, r.z) for r in files.read_ply(spark, f"{tmp_path}/p.ply").collect()) == [(1, 2, 3), (4, 5, 6)]


def test_people_and_dead_letters(spark):
    df = spark.createDataFrame([("Konrad BERGMANN", "9.1.1928", " polen ", None), ("Ada", "1.1.1900", "x", None), ("Jan NOWAK", "31.02.1928", "x", "n"), (None, "1.1.1900", "x", None), ("Eva ROTH", "UNBEKANNT", "x", None)], "name string, birthdate string, country string, nickname string")
    valid, errors = records.people(df)
    got = {r.surname: (list(r.given_names), r.birthdate, r.nationality, r.nickname) for r in valid.collect()}
    assert got == {"BERGMANN": (["Konrad"], "09.01.1928", "POLEN", ""), "ROTH": (["Eva"], "UNBEKANNT", "X", "")}
    assert sorted((r.error, r.error_type) for r in errors.collect()) == [("invalid date", "validation_error"), ("missing value", "processing_error"), ("no surname", "validation_error")]
    s = records.people_statistics(valid, errors).collect()[0]
    assert (s.total, s.errors, s.by_nationality, s.by_birth_year) == (5, 3, {"POLEN": 1, "X": 1}, {"1928": 1})


def test_records_are_assembled_in_order(spark):
    text = ["ignored", "-----", "Konrad BERGMANN  9.1.1928  Polen", "Anna sister", " Jan", "Eva ROTH UNBEKANNT Wien", "Max"]
    out = series.assemble_records(spark.createDataFrame([("d", i, t) for i, t in enumerate(text)], "path string, line_no int, line string")).orderBy("record_no").collect()
    assert [(r.name, r.date, r.rest, list(r.names)) for r in out] == [("Konrad BERGMANN", "9.1.1928", "Polen", ["Anna", "Jan"]), ("Eva ROTH", "UNBEKANNT", "Wien", ["Max"])]


def test_numbered_rows_are_dense(spark):
    df = spark.createDataFrame([(i * 7 % 101,) for i in range(101)], "x int")
    assert sorted((r.x, r.row_no) for r in rows.numbered(df, [df.x]).collect()) == [(i, i) for i in range(101)]


def test_two_nearest_of_a_table_leave_out_the_row_itself(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [1.0]), (3, [5.0])], "id int, v array<double>")
    assert {r["query"]: (r.best, r.d1, r.d2) for r in vectors.nearest_two(df, df, "id", "v", others=True).collect()} == {1: (2, 1.0, 5.0), 2: (1, 1.0, 4.0), 3: (2, 4.0, 5.0)}


def test_streamed_rate(spark, tmp_path):
    batch = spark.sql("SELECT 'a' AS job, TIMESTAMP'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,0,10 * id) AS ts, CAST(id AS DOUBLE) AS v FROM range(60)")
    batch.write.parquet(f"{tmp_path}/in")
    stream = rates.windowed_rate(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in"), ["job"], "ts", "v")
    rates.to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert out and all(r.rate is None or abs(r.rate - 0.1) < 1e-9 for r in out)


def test_two_nearest_match_all_pairs_and_never_shuffle_them(spark):
    r = np.random.default_rng(3)
    base = r.normal(size=(300, 8)).astype(np.float32)
    data = [*base, *base[:40], *base[:40], *(base[:60] + np.float32(1e-4)), *(base[:20] * np.float32(1e-5)), *(base[:20] * np.float32(1e5))]
    data = [(i, v.tolist()) for i, v in enumerate(data)] + [(1000, [float("nan")] * 8), (1001, None), (1002, [float("inf")] * 8)]
    df = spark.createDataFrame(data, "id long, v array<float>")
    x = np.array([[np.nan] * 8 if v is None else v for _, v in data])
    with np.errstate(all="ignore"):
        d = np.round(np.sqrt(sum(np.square(x[:, None, j].astype(np.float64) - x[None, :, j]) for j in range(8))), 9)
    ids = np.array([i for i, _ in data])
    expected = {}
    for k, i in enumerate(ids):
        # numbers, then NaN, then null; ties by id
        order = sorted((j for j in range(len(ids)) if j != k), key=lambda j: (2 if 1001 in (i, ids[j]) else int(np.isnan(d[k, j])), 0 if np.isnan(d[k, j]) else d[k, j], ids[j]))[:2]
        expected[int(i)] = (int(ids[order[0]]), *(None if 1001 in (i, ids[j]) else float(d[k, j]) for j in order))
    out = vectors.nearest_two(df, df, "id", "v", others=True)
    found = {q["query"]: (q.best, q.d1, q.d2) for q in out.collect()}
    assert {k: repr(v) for k, v in found.items()} == {k: repr(v) for k, v in expected.items()}
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan
    assert vectors.nearest_two(df.where("id < 1"), df.where("id < 1"), "id", "v", others=True).count() == 0


def test_triangles_of_hubs_and_of_named_nodes_without_pairs_of_neighbours(spark, monkeypatch):
    monkeypatch.setattr(graph, "RANGE_EDGES", 100)
    r = random.Random(4)
    edges = {tuple(sorted(r.sample(range(90), 2))) for _ in range(500)} | {(0, i) for i in range(1, 90)} | {(1, i) for i in range(2, 90)}
    near = {i: {a + b - i for a, b in edges if i in (a, b)} for i in range(90)}
    expected = {i: (len(near[i]), sum(tuple(sorted(p)) in edges for p in itertools.combinations(near[i], 2))) for i in range(90)}
    for kind, name in (("int", int), ("string", lambda i: f"n{i:02}")):
        nodes, canonical = graph.build(spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"src {kind}, dst {kind}"))
        out = graph.clustering(nodes, canonical)
        assert {q.node: (q.degree, q.triangles) for q in out.collect()} == {name(i): v for i, v in expected.items()}
        assert "`x` < `y`" not in out._jdf.queryExecution().toString() and "(x#" not in out._jdf.queryExecution().toString()


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_percentiles_are_exact_without_the_values_of_a_key_in_one_task(spark, monkeypatch, broadcast):
    monkeypatch.setattr(stats, "BROADCAST", broadcast)
    r = random.Random(6)
    data = [(r.choice(["a", "b", None]), r.choice([r.gauss(0, 1e3), 5.0, float(r.randint(0, 3))])) for _ in range(4000)]
    data += [("one", 7.0), ("two", 1.0), ("two", 2.0), ("none", None), ("same", 3.0), ("same", 3.0), ("nan", float("nan")), ("nan", 1.0), ("nan", 2.0)]
    df = spark.createDataFrame(data, "k string, v double")
    expected = {q.k: (q.lo, q.hi) for q in df.groupBy("k").agg(F.percentile("v", 0.25).alias("lo"), F.percentile("v", 0.9).alias("hi")).collect()}
    out = stats.percentiles(df, ["k"], "v", {"lo": 0.25, "hi": 0.9})
    assert {k: repr(v) for k, v in ((q.k, (q.lo, q.hi)) for q in out.collect())} == {k: repr(v) for k, v in expected.items()}
    fences = stats.iqr_fences(df, ["k"], "v")
    assert "percentile(" not in fences._jdf.queryExecution().toString()
    assert {q.k: (q.lower, q.upper) for q in fences.collect()}["none"] == (0.0, float("inf"))
    assert [tuple(q) for q in stats.percentiles(df.where("false"), [], "v", {"m": 0.5}).collect()] == [(None,)]


def test_outliers_in_space_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vectors, "TASK_POINTS", 150)
    monkeypatch.setattr(vectors, "LEAF_POINTS", 8)
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(500, 2)), r.normal(size=(60, 2)) * 50, np.repeat([[3.0, 3.0]], 300, axis=0), np.column_stack([r.integers(0, 3, 100), r.normal(size=100)])])
    d = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    mean = np.sort(d, axis=1)[:, :5].mean(axis=1)
    limit = mean.mean() + 2 * mean.std(ddof=1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)] + [(-1, None, 1.0)], "id long, x double, y double")
    out = vectors.statistical_outliers(df, "id", ["x", "y"], 5)
    found = {q.id: (q.mean_distance, q.outlier) for q in out.collect()}
    assert found.pop(-1) == (None, None)
    assert len(found) == len(x) and all(abs(found[i][0] - mean[i]) < 1e-9 and found[i][1] == (mean[i] > limit) for i in range(len(x)))
    assert "NestedLoopJoin LeftOuter" not in (plan := out._jdf.queryExecution().toString()) and "row_number" not in plan


@pytest.mark.parametrize("size", [1 << 21, 16])
def test_components_from_contracted_edges(spark, monkeypatch, size):
    monkeypatch.setattr(graph, "FOREST_EDGES", size)
    r = random.Random(9)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in [*((i, i + 1) for i in range(120)), *(r.sample(range(200, 290), 2) for _ in range(60))]]
    nodes, canonical = graph.build(spark.createDataFrame(edges, "src string, dst string"), spark.createDataFrame([("alone",)], "node string"))
    root = {n: n for e in edges for n in e} | {"alone": "alone"}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert {q.node: q.component for q in graph.components(nodes, canonical).collect()} == root
    assert {q.node: q.component for q in graph.components(nodes, graph.contracted(canonical.coalesce(1))).collect()} == root
    assert graph.contracted(canonical.coalesce(1)).count() <= (len(root) if size > 16 else len(edges))
    assert {(q.src, q.dst) for q in graph.guarded_edges(canonical, nodes.where("node < 'n003'")).collect()} == {("n000", "n001"), ("n001", "n002")}


def test_guarded_edges_filter_lines_before_they_are_paired(spark):
    from quern.plans import catalogue

    plan = catalogue.QUERIES["guarded_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    lines = [x for x in plan.splitlines() if "Join" in x]
    assert "Inner" in lines[0] and any("LeftSemi" in x for x in lines[1:])
