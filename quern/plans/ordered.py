"""Queries of ordered data, grids, graphs and decoded pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import dedup, graph, grid, raster, scoring, series
from quern.operators.rows import numbered
from quern.plans.registry import query, table

_PHASE = "CASE event_id % 3 WHEN 0 THEN 'align' WHEN 1 THEN 'stack' ELSE 'merge' END"
_SAMPLES = f"SELECT event_id, ts, user_id % 10 AS job, {_PHASE} AS phase, CAST(event_id * 7 % 101 AS DOUBLE) AS percent FROM events"


@query(f"""WITH s AS ({_SAMPLES}), w AS (SELECT *, min((epoch_us(ts), percent)) OVER r AS f, max((epoch_us(ts), percent)) OVER r AS l FROM s WINDOW r AS (PARTITION BY job, phase ORDER BY epoch_us(ts) RANGE BETWEEN 30000000 PRECEDING AND CURRENT ROW)),
 q AS (SELECT *, CASE WHEN l[1] > f[1] THEN (l[2] - f[2]) / ((l[1] - f[1]) / 1000000.0) END AS rate FROM w)
SELECT event_id, round(rate, 6) AS rate, round(CASE WHEN rate > 0 THEN (100 - percent) / rate END, 4) AS phase_eta,
 round(CASE WHEN rate > 0 THEN (1 - CASE phase WHEN 'align' THEN 0.2 * percent / 100 WHEN 'stack' THEN 0.2 + 0.4 * percent / 100 ELSE 0.6 + 0.4 * percent / 100 END) / CASE phase WHEN 'align' THEN 0.2 ELSE 0.4 END * 100 / rate END, 4) AS total_eta FROM q""")
def progress_eta(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    samples = e.select("event_id", "ts", (F.col("user_id") % 10).alias("job"), F.expr(_PHASE).alias("phase"), (F.col("event_id") * 7 % 101).cast("double").alias("percent"))
    out = series.with_eta(samples)
    return out.select("event_id", F.round("rate", 6).alias("rate"), F.round("phase_eta", 4).alias("phase_eta"), F.round("total_eta", 4).alias("total_eta"))


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS record_no, 'Nazwa ' || c_mktsegment AS name,
 CASE c_custkey % 3 WHEN 0 THEN 'UNBEKANNT' WHEN 1 THEN '1.12.1928' ELSE '24.3.1901' END AS date, 'nr ' || c_custkey AS rest, CASE WHEN c_custkey % 2 = 0 THEN ['Łucja', 'also'] ELSE CAST([] AS VARCHAR[]) END AS names FROM customer""")
def assembled_records(spark, sf_dir):
    """Records of listings of one nation each: a head, dashes, then records of one line or more."""
    c = table(spark, sf_dir, "customer")
    date = F.when(F.col("c_custkey") % 3 == 0, "UNBEKANNT").when(F.col("c_custkey") % 3 == 1, "1.12.1928").otherwise("24.3.1901")
    record = F.concat(F.lit("Nazwa "), "c_mktsegment", F.lit("  "), date, F.lit("  nr "), F.col("c_custkey").cast("string"))
    more = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit(" (Łucja), born"), F.lit("also known"), F.lit(" ... "))).otherwise(F.expr("cast(array() as array<string>)"))
    body = c.select(F.col("c_nationkey").cast("string").alias("path"), "c_custkey", F.posexplode(F.concat(F.array(record), more)).alias("k", "line"))
    body = body.select("path", (F.col("c_custkey") * 10 + F.col("k") + 2).alias("line_no"), "line")
    heads = c.select(F.col("c_nationkey").cast("string").alias("path")).distinct().select("path", F.posexplode(F.array(F.lit("Head 1.1.1900 of it"), F.lit("-----"))).alias("line_no", "line"))
    return series.assemble_records(heads.unionByName(body))


@query("""WITH h AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2), k AS (SELECT *, CAST(least(n, 100) AS DOUBLE) + sum(n - least(n, 100)) OVER b / count(*) OVER b AS mass FROM h WINDOW b AS (PARTITION BY l_returnflag))
SELECT l_returnflag, l_quantity, n, CAST(floor(sum(mass) OVER u / sum(mass) OVER b * 255 + 1e-9) AS INT) AS level FROM k WINDOW b AS (PARTITION BY l_returnflag), u AS (PARTITION BY l_returnflag ORDER BY l_quantity ROWS UNBOUNDED PRECEDING)""")
def clipped_levels(spark, sf_dir):
    return series.cumulative_levels(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", clip=100)


@query("SELECT c_custkey, c_name, row_number() OVER (ORDER BY c_mktsegment, c_custkey) - 1 AS row_no FROM customer")
def sorted_rows(spark, sf_dir):
    """Rows by one key, ties by the index, with their place."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return numbered(c, [F.col("c_mktsegment"), F.col("c_custkey")]).select("c_custkey", "c_name", "row_no")


@query("""WITH d AS (SELECT c_custkey, c_mktsegment || ' ' || c_custkey % 90 AS address FROM customer), s AS (SELECT DISTINCT '  ' || c_mktsegment || ' (old)' AS street, length(c_mktsegment) % 4 AS district FROM customer WHERE c_mktsegment <> 'MACHINERY')
SELECT c_custkey, lower(regexp_extract(address, '^(.*?) ?\\d+$', 1)) AS street, CAST(regexp_extract(address, '(\\d+)$', 1) AS INT) AS number, district FROM d LEFT JOIN s ON lower(trim(regexp_replace(street, '\\s+\\(.*?\\)', ''))) = lower(regexp_extract(address, '^(.*?) ?\\d+$', 1))""")
def directory_links(spark, sf_dir):
    """Directory entries with the district of their street, by its normalised name."""
    c = table(spark, sf_dir, "customer")
    directory = c.select("c_custkey", F.concat_ws(" ", "c_mktsegment", F.col("c_custkey") % 90).alias("address"))
    streets = c.where("c_mktsegment <> 'MACHINERY'").select(F.concat(F.lit("  "), "c_mktsegment", F.lit(" (old)")).alias("street"), (F.length("c_mktsegment") % 4).alias("district")).distinct()
    return dedup.link_by_street(directory, "address", streets, "street").select("c_custkey", "street", "number", "district")


@query("""WITH c AS (SELECT CAST(floor((p_size - 1) / 7.0 - (SELECT min((p_size - 1) / 7.0) FROM part)) AS BIGINT) AS gx, CAST(floor(p_retailprice / 40 - (SELECT min(p_retailprice / 40) FROM part)) AS BIGINT) AS gy, p_partkey FROM part),
 g AS (SELECT gx, gy, count(*) AS n, avg(p_partkey) AS m FROM c GROUP BY 1, 2), e AS (SELECT unnest(range(max(gx) + 1)) AS gx, max(gy) AS my FROM g), f AS (SELECT gx, unnest(range(my + 1)) AS gy FROM e)
SELECT f.gx, f.gy, n, round(m, 4) AS mean_z, n IS NOT NULL AS filled FROM f LEFT JOIN g USING (gx, gy)""")
def flagged_grid(spark, sf_dir):
    """A grid with its empty cells."""
    p = table(spark, sf_dir, "part").select(((F.col("p_size") - 1) / 7).alias("x"), (F.col("p_retailprice") / 40).alias("y"), "p_partkey")
    return grid.full_grid(grid.bin_mean(p, "x", "y", "p_partkey", 1.0)).withColumn("mean_z", F.round("mean_z", 4))


#: A forest of binary trees over the customers: each is tied to half its number, but for every seventh.
_FOREST = "WITH RECURSIVE t AS (SELECT c_custkey AS node, c_custkey AS up FROM customer UNION ALL SELECT node, CAST(floor(up / 2) AS BIGINT) FROM t WHERE up % 7 <> 0 AND up > 1), c AS (SELECT node, min(up) AS component FROM t GROUP BY 1)"


def _forest(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"))
    edges = c.where("node % 7 <> 0 AND node > 1").select("node", F.floor(F.col("node") / 2).cast("long").alias("other"))
    return graph.build(edges, c, "node", "other")


@query(f"{_FOREST} SELECT node, component FROM c")
def forest_components(spark, sf_dir):
    return graph.components(*_forest(spark, sf_dir))


@query(f"{_FOREST} SELECT count(DISTINCT component) AS n_components, count(DISTINCT component) = 1 AS connected FROM c")
def forest_connectedness(spark, sf_dir):
    return graph.is_connected(*_forest(spark, sf_dir))


_RING = 8


@query(f"""WITH r AS (SELECT s_suppkey AS graph, CAST(3 + s_suppkey % {_RING} AS DOUBLE) AS n FROM supplier)
SELECT graph, round(CASE WHEN graph % 2 = 0 THEN 0.4 * 2 + 0.3 * (CASE WHEN n = 3 THEN 1 ELSE 0 END) + 0.3 * 2 ELSE 0.4 * 2 * (n - 1) / n + 0.3 * 1 END, 9) AS score FROM r""")
def layout_scores(spark, sf_dir):
    """Rings (cut by two edges) and stars or paths (cut by one) of 3 to 10 crossings."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("graph"), (3 + F.col("s_suppkey") % _RING).cast("int").alias("n"))
    path = F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.struct(i.alias("src"), (i + 1).alias("dst")))
    star = F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda i: F.struct(F.lit(0).alias("src"), i.alias("dst")))
    ring = F.concat(path, F.array(F.struct((F.col("n") - 1).alias("src"), F.lit(0).alias("dst"))))
    edges = F.when(F.col("graph") % 2 == 0, ring).when(F.col("graph") % 3 == 0, star).otherwise(path)
    return graph.score_layouts(s.select("graph", "n", edges.alias("edges"))).withColumn("score", F.round("score", 9))


_PIXELS = "SELECT l_linenumber AS image, l_orderkey % 40 AS y, l_partkey % 40 AS x, max(CASE WHEN l_quantity > 5 THEN l_quantity ELSE 0 END) AS v FROM lineitem GROUP BY 1, 2, 3"


def _pixels(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    by = [F.col("l_linenumber").alias("image"), (F.col("l_orderkey") % 40).alias("y"), (F.col("l_partkey") % 40).alias("x")]
    return li.groupBy(*by).agg(F.max(F.when(F.col("l_quantity") > 5, F.col("l_quantity")).otherwise(0.0)).alias("v"))


@query(f"WITH p AS ({_PIXELS}) SELECT image, y, x, CASE WHEN v > avg(v) OVER (PARTITION BY image) THEN 1 ELSE 0 END AS v FROM p")
def mean_threshold(spark, sf_dir):
    return raster.mean_threshold(_pixels(spark, sf_dir)).select("image", "y", "x", F.col("v").cast("int").alias("v"))


@query(f"""WITH p AS ({_PIXELS}), q AS (SELECT image, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM p GROUP BY 1)
SELECT image, y, x, CAST(CASE WHEN hi > lo THEN round(least(1.0, greatest(0.0, (v - lo) / (hi - lo))) * 255) ELSE v END AS INT) AS v FROM p JOIN q USING (image)""")
def stretched(spark, sf_dir):
    return raster.stretch(_pixels(spark, sf_dir))


@query(f"WITH p AS ({_PIXELS}), k AS (SELECT y, x FROM p WHERE v > 0 GROUP BY 1, 2 HAVING count(DISTINCT image) = (SELECT count(DISTINCT image) FROM p)) SELECT min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM k")
def common_area(spark, sf_dir):
    return raster.common_area(_pixels(spark, sf_dir))


@query("SELECT p_partkey, CASE WHEN m < 20 OR i < 0.15 OR e > 20 THEN 'D' WHEN m >= 100 AND i >= 0.5 AND e <= 3 THEN 'A' WHEN m >= 50 AND i >= 0.3 AND e <= 8 THEN 'B' ELSE 'C' END AS class, CASE WHEN greatest(length(p_name), length(p_type)) = 0 THEN 1.0 ELSE round(1 - levenshtein(p_name, p_type) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE), 9) END AS alike FROM (SELECT *, p_partkey * 13 % 160 AS m, p_size / 50.0 AS i, p_partkey * 7 % 23 AS e FROM part)")
def match_quality(spark, sf_dir):
    """The class of a match, and how alike two texts are."""
    p = table(spark, sf_dir, "part")
    matches, inliers, error = F.col("p_partkey") * 13 % 160, F.col("p_size") / 50.0, F.col("p_partkey") * 7 % 23
    return p.select("p_partkey", scoring.quality_class(matches, inliers, error).alias("class"), F.round(text.edit_similarity(F.col("p_name"), F.col("p_type")), 9).alias("alike"))
