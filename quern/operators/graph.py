"""Undirected graphs as two tables: nodes(node) and edges(src, dst) with src < dst."""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from quern.operators.rows import materialise, numbered, stored


def build(edges: DataFrame, nodes: DataFrame | None = None, a: str = "src", b: str = "dst") -> tuple[DataFrame, DataFrame]:
    """nodes and canonical edges: no loops, no repeats; ends of edges are nodes even where no list names them."""
    canonical = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst")).distinct()
    ends = edges.select(F.col(a).alias("node")).union(edges.select(F.col(b).alias("node")))
    if nodes is not None:
        ends = ends.union(nodes.select("node"))
    return ends.where("node IS NOT NULL").distinct(), canonical


def guarded_edges(edges: DataFrame, nodes: DataFrame, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """Edges of which both ends exist; or rows of which the ends named do."""
    out = edges
    for end in ends:
        out = out.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    return out.select(*edges.columns)


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree; 0 for nodes without an edge."""
    n = both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.join(n, "node", "left").select("node", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


#: Oriented edges in the range of nodes that a task holds.
RANGE_EDGES = 1 << 22


def _triangles(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """node, triangles (of nodes in any) of stored edges between whole numbers.

    An edge leads from the lesser node to the greater, but always to a hub, and between hubs by degree. Hubs have more
    than sqrt(2 * edges) neighbours, so there are few and no list of successors is longer. Ranges of nodes are dealt to
    tasks with their lists; every list visits the ranges in which its members are, once each, where it meets
    their lists. Pairs of neighbours are never written.
    """
    n = edges.count()
    limit = max(16, math.isqrt(2 * n))
    hubs = np.array(sorted((r.degree, r.node) for r in degree.where(F.col("degree") > limit).select("degree", "node").collect()), dtype=np.int64).reshape(-1, 2)  # at most sqrt(2 * edges)
    by_node = np.argsort(hubs[:, 1])
    hub, rank = hubs[by_node, 1], by_node + 1  # 0 is no hub
    parts = n // RANGE_EDGES + 1
    bounds = np.array(sorted(set(edges.approxQuantile("src", [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else [], dtype=np.float64)

    def ranked(x: np.ndarray) -> np.ndarray:
        if not len(hub):
            return np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(hub, x), len(hub) - 1)
        return np.where(hub[at] == x, rank[at], 0)

    def oriented(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v = (batch.column(i).to_numpy() for i in (0, 1))
            a, b = ranked(u), ranked(v)
            up = (a < b) | ((a == b) & (u < v))
            yield pa.RecordBatch.from_arrays([pa.array(np.where(up, u, v)), pa.array(np.where(up, v, u))], ["lo", "hi"])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each list of successors to the range of its node (asks 0), and to the ranges of its members (asks 1)."""
        for batch in batches:
            lo, flat, at = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(), pc.list_value_length(batch.column(1)).to_numpy()
            row = np.repeat(np.arange(len(lo)), at)
            visits = np.unique(row * (len(bounds) + 1) + np.searchsorted(bounds, flat, "right"))
            visits = visits[at[visits // (len(bounds) + 1)] > 1]  # a single successor closes nothing
            rows = np.concatenate([np.arange(len(lo)), visits // (len(bounds) + 1)])
            part = np.concatenate([np.searchsorted(bounds, lo, "right"), visits % (len(bounds) + 1)])
            asks = np.repeat(np.array([0, 1], np.int32), [len(lo), len(visits)])
            for i in range(0, len(rows), 4096):
                c = slice(i, i + 4096)
                take = pa.array(rows[c])
                yield pa.RecordBatch.from_arrays([pa.array(part[c].astype(np.int32)), pa.array(asks[c]), batch.column(0).take(take), batch.column(1).take(take)], ["part", "asks", "lo", "his"])

    def closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, held = None, [], None

        def total() -> Iterator[pa.RecordBatch]:
            if held is not None:
                names, count, *_ = held
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(names[some]), pa.array(count[some])], ["node", "triangles"])

        for batch in batches:
            at, asks = (batch.column(i).to_numpy() for i in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(at) != 0) | (np.diff(asks) != 0)) + 1), batch.num_rows]
            for first, last in zip(cuts, cuts[1:]):
                if first == last:
                    continue
                if at[first] != part:
                    yield from total()
                    part, waiting, held = at[first], [], None
                lo, lists = (batch.column(i).slice(first, last - first) for i in (2, 3))
                lo, flat, size = lo.to_numpy(), lists.flatten().to_numpy(), pc.list_value_length(lists).to_numpy()
                if asks[first] == 0:
                    waiting.append((lo, flat, size))
                    continue
                if held is None:
                    if not waiting:
                        continue
                    x, y, size_x = (np.concatenate([w[i] for w in waiting]) for i in range(3))
                    waiting = []
                    names = np.unique(np.concatenate([x, y]))
                    start, length = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
                    place = np.searchsorted(names, x)
                    length[place] = size_x
                    start[place] = np.cumsum(size_x) - size_x
                    held = names, np.zeros(len(names), np.int64), np.searchsorted(names, y), start, length, np.zeros(len(names), np.int64)
                names, count, after, start, length, stamp = held
                mine = np.searchsorted(names, flat)
                known = names[np.minimum(mine, len(names) - 1)] == flat
                ends = np.cumsum(size)
                tops, middles, lows = [], [], np.zeros(len(lo), np.int64)
                for i in range(len(lo)):
                    cut = slice(ends[i] - size[i], ends[i])
                    m = mine[cut][known[cut]]
                    z = m[length[m] > 0]
                    if not len(z):
                        continue
                    stamp[m] = 1
                    n_z = length[z]
                    ends_z = np.cumsum(n_z)
                    y = after[np.arange(ends_z[-1]) + np.repeat(start[z] - ends_z + n_z, n_z)]
                    hit = np.flatnonzero(stamp[y])
                    stamp[m] = 0
                    if len(hit):
                        tops.append(y[hit])
                        middles.append(z[np.searchsorted(ends_z, hit, "right")])
                        lows[i] = len(hit)
                if tops:
                    for found in (tops, middles):
                        count += np.bincount(np.concatenate(found), minlength=len(names))
                    some = lows > 0
                    yield pa.RecordBatch.from_arrays([pa.array(lo[some]), pa.array(lows[some])], ["node", "triangles"])
        yield from total()

    tasks = max(parts, 4)
    successors = edges.select(F.col("src").cast("long"), F.col("dst").cast("long")).mapInArrow(oriented, "lo long, hi long").repartition(4 * tasks, "lo").groupBy("lo").agg(F.collect_list("hi").alias("his"))
    lists = successors.mapInArrow(routed, "part int, asks int, lo long, his array<long>")
    met = lists.repartition(tasks, "part").sortWithinPartitions("part", "asks").mapInArrow(closed, "node long, triangles long")
    return met.groupBy("node").agg(F.sum("triangles").alias("triangles"))


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree, triangles, coefficient: the share of a node's pairs of neighbours that are tied; 0 under two neighbours."""
    kind = nodes.schema["node"].dataType
    if not isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        name = materialise(numbered(nodes, [F.col("node")], "no"))
        no = lambda end: name.select(F.col("node").alias(end), F.col("no").cast("long").alias(f"n_{end}"))
        e = edges.join(no("src"), "src").join(no("dst"), "dst").select(F.least("n_src", "n_dst").alias("src"), F.greatest("n_src", "n_dst").alias("dst"))
        return clustering(name.select(F.col("no").cast("long").alias("node")), e).withColumnRenamed("node", "no").join(name, "no").select("node", "degree", "triangles", "coefficient")
    edges = stored(edges)
    deg = stored(degrees(nodes, edges))
    out = deg.join(_triangles(edges, deg), "node", "left").select("node", "degree", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))
    pairs = F.col("degree") * (F.col("degree") - 1)
    return out.withColumn("coefficient", F.when(pairs > 0, 2.0 * F.col("triangles") / pairs).otherwise(0.0))


#: Edges that a task contracts at once.
FOREST_EDGES = 1 << 21


def _forest(edges: DataFrame) -> DataFrame:
    """a, b: stars that tie what the edges (a, b) of each partition tie; at most an edge for each node of it. Batches are contracted with the stars so far."""

    def stars(a: pa.Array, b: pa.Array) -> tuple[pa.Array, pa.Array]:
        coded = pa.chunked_array([a, b]).combine_chunks().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        x, y = code[: len(a)], code[len(a) :]
        root = np.arange(len(coded.dictionary))
        while len(x):
            # the greater root of an edge goes under the least that it meets, then paths are halved until flat
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
            x, y = root[x], root[y]
            open_ = x != y
            x, y = x[open_], y[open_]
        tied = np.flatnonzero(root != np.arange(len(root)))
        return coded.dictionary.take(pa.array(tied)), coded.dictionary.take(pa.array(root[tied]))

    def contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            waiting.append((batch.column(0), batch.column(1)))
            size += batch.num_rows
            if size >= FOREST_EDGES:
                a, b = stars(*(pa.concat_arrays([w[i] for w in waiting]) for i in (0, 1)))
                waiting, size = [(a, b)], len(a)
                if size > FOREST_EDGES // 2:  # so many nodes: they go as they are
                    yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])
                    waiting, size = [], 0
        if size:
            a, b = stars(*(pa.concat_arrays([w[i] for w in waiting]) for i in (0, 1)))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    kind = edges.schema["a"].dataType.simpleString()
    return edges.mapInArrow(contracted, f"a {kind}, b {kind}")


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (src < dst) of fewer number that tie the same nodes: each partition's are contracted to stars."""
    return _forest(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component (its least node).

    Tasks first contract their edges to stars, by ranges of nodes, as long as that leaves fewer; what one task can hold
    is then done. Else alternating stars: each round ties a node's neighbours to its least one; rounds grow with the
    logarithm of the longest path."""
    tied = stored(_forest(edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))
    left, before = tied.count(), None
    while left > 0 and (before is None or left < 0.7 * before):
        few = left <= FOREST_EDGES
        pairs = tied.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        tied = stored(_forest(pairs.coalesce(1) if few else pairs.repartitionByRange(math.ceil(left / FOREST_EDGES), "a")))
        before, left = left, tied.count()
        if few:
            least = tied.groupBy("b").agg(F.min("a").alias("m")).select("b", F.least("b", "m").alias("m"))
            roots = tied.join(least, "b").select(F.col("a").alias("node"), F.col("m").alias("_root")).union(least.select(F.col("b").alias("node"), F.col("m").alias("_root")))
            return nodes.join(roots, "node", "left").select("node", F.coalesce("_root", "node").alias("component"))
    pairs = materialise(both_ways(tied.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("src").alias("a"), F.col("dst").alias("b")))
    while True:
        least = pairs.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = pairs.join(least, "a").where("b > a AND b <> m").select(F.col("b").alias("x"), F.col("m").alias("y")).distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        stars = materialise(large.join(least, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y")).union(least.select("x", F.col("m").alias("y"))).distinct())
        twice = stars.groupBy("x").count().where("count > 1")
        if twice.isEmpty() and stars.join(stars.select(F.col("y").alias("x")), "x", "left_semi").isEmpty():
            return nodes.join(stars.select(F.col("x").alias("node"), F.col("y").alias("_root")), "node", "left").select("node", F.coalesce("_root", "node").alias("component"))
        pairs = stars.select(F.col("x").alias("a"), F.col("y").alias("b")).union(stars.select(F.col("y").alias("a"), F.col("x").alias("b")))


def is_connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: n_components, connected."""
    return components(nodes, edges).agg(F.countDistinct("component").alias("n_components")).withColumn("connected", F.col("n_components") == 1)


def min_cut(n: int, edges: list[tuple[int, int]]) -> int:
    """Least number of edges whose removal splits a graph of n nodes; 0 if it is split. Merging phases over a weight matrix."""
    if n < 2:
        return 0
    w = np.zeros((n, n))
    for a, b in edges:
        w[a, b] = w[b, a] = 1
    left, best = list(range(n)), np.inf
    while len(left) > 1:
        weight, order = w[left[0]][left].copy(), [0]
        weight[0] = -1
        while len(order) < len(left):
            k = int(weight.argmax())
            last = weight[k]
            order.append(k)
            weight[k] = -1
            free = weight >= 0
            weight[free] += w[left[k]][left][free]
        best = min(best, last)
        s, t = left[order[-2]], left[order[-1]]
        w[s] += w[t]
        w[:, s] += w[:, t]
        w[s, s] = 0
        left.remove(t)
    return int(best)


def edge_connectivity(graphs: DataFrame) -> DataFrame:
    """graph, connectivity of tables of edges (graph, src, dst), one task a graph. Each graph is held by one worker: for small graphs, many at once."""

    def cut(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        names = {v: i for i, v in enumerate(sorted({*rows.src, *rows.dst}))}
        return pd.DataFrame({"graph": [key[0]], "connectivity": [min_cut(len(names), [(names[a], names[b]) for a, b in zip(rows.src, rows.dst) if a != b])]})

    return graphs.groupBy("graph").applyInPandas(cut, f"graph {graphs.schema['graph'].dataType.simpleString()}, connectivity int")


def _measures(n: int, edges: set[tuple[int, int]]) -> tuple[float, float, int]:
    near: list[set[int]] = [set() for _ in range(n)]
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    coefficient = [2 * sum(v in near[u] for i, u in enumerate(sorted(s)) for v in sorted(s)[i + 1 :]) / (len(s) * (len(s) - 1)) if len(s) > 1 else 0.0 for s in near]
    return sum(map(len, near)) / n, sum(coefficient) / n, min_cut(n, list(edges))


def layout_score(n: int, edges: set[tuple[int, int]]) -> float:
    """0.4 mean degree + 0.3 mean clustering + 0.3 edge connectivity; 0 under two nodes."""
    if n < 2:
        return 0.0
    degree, cluster, connectivity = _measures(n, edges)
    return 0.4 * degree + 0.3 * cluster + 0.3 * connectivity


def score_layouts(layouts: DataFrame) -> DataFrame:
    """graph, score of layouts (graph, n, edges array<struct<src,dst>>), scored in parallel."""

    def scored(batches):
        for rows in batches:
            yield pd.DataFrame({"graph": rows.graph, "score": [layout_score(int(n), {(min(e["src"], e["dst"]), max(e["src"], e["dst"])) for e in es if e["src"] != e["dst"]}) for n, es in zip(rows.n, rows.edges)]})

    return layouts.mapInPandas(scored, "graph long, score double")


def evolve_layouts(spark: SparkSession, n: int, population: int = 50, generations: int = 100, seed: int = 1) -> tuple[set[tuple[int, int]], float]:
    """The best layout of a genetic search: tournaments of 3, each edge of either parent inherited by half, one elite.

    A generation is bred on the driver and scored by the executors; the seed makes it repeatable.
    """
    r = random.Random(seed)
    every = [(a, b) for a in range(n) for b in range(a + 1, n)]
    layouts = [{e for e in every if r.random() < 2.5 / max(n - 1, 1)} for _ in range(population)]
    schema = "graph long, n int, edges array<struct<src:int,dst:int>>"
    best: tuple[set[tuple[int, int]], float] = (set(), -1.0)
    for _ in range(generations):
        rows = [(i, n, sorted(es)) for i, es in enumerate(layouts)]
        scores = {x.graph: x.score for x in score_layouts(spark.createDataFrame(rows, schema)).collect()}  # one row a layout
        top = max(range(population), key=lambda i: (scores[i], -i))
        if scores[top] > best[1]:
            best = (set(layouts[top]), scores[top])
        pick = lambda: layouts[max(r.sample(range(population), min(3, population)), key=lambda i: scores[i])]
        children = [set(best[0])]
        while len(children) < population:
            child = {e for e in sorted(pick() | pick()) if r.random() < 0.5}
            if r.random() < 0.2 and every:
                child ^= {r.choice(every)}
            children.append(child)
        layouts = children
    return best
