"""Queries of joins, aggregates, windows, grids, graphs and vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import dedup, graph, grid, records, rows, scoring, series, stats, vectors
from quern.plans.registry import query, table

_SENTENCES = "list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array({0}, '[.!?]+'), lambda x: trim(x)), lambda x: x <> '')))"


@query("SELECT upper(trim(c_mktsegment)) AS segment, count(*) AS n FROM customer GROUP BY 1")
def normalize_category_counts(spark, sf_dir):
    return stats.frequencies(table(spark, sf_dir, "customer"), F.upper(F.trim("c_mktsegment")), "segment")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders WHERE year(o_orderdate) <> 1995 GROUP BY 1")
def order_year_distribution(spark, sf_dir):
    return stats.frequencies(table(spark, sf_dir, "orders"), F.year("o_orderdate"), "year", exclude=1995)


@query("SELECT count(*) AS total, count_if(n_chars > 2000) AS errors FROM documents")
def total_and_errors(spark, sf_dir):
    return stats.totals(table(spark, sf_dir, "documents"), F.col("n_chars") > 2000)


@query("""WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT l_returnflag, round(q1, 4) AS q1, round(q3, 4) AS q3, round(q1 - 1.5 * (q3 - q1), 4) AS lower, round(q3 + 1.5 * (q3 - q1), 4) AS upper FROM q""")
def iqr_fences(spark, sf_dir):
    out = stats.iqr_fences(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return out.select("l_returnflag", *(F.round(c, 4).alias(c) for c in ("q1", "q3", "lower", "upper")))


@query("""WITH q AS (SELECT l_shipmode, q1 - 0.5 * (q3 - q1) AS lo, q3 + 0.5 * (q3 - q1) AS hi FROM (SELECT l_returnflag AS l_shipmode, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1))
SELECT l_orderkey, l_linenumber FROM lineitem JOIN q ON l_returnflag = l_shipmode WHERE l_extendedprice < q1_lo(lo) OR l_extendedprice > hi""".replace("q1_lo(lo)", "lo"))
def outside_narrow_fences(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice")
    return stats.outside_fences(li, ["l_returnflag"], "l_extendedprice", 0.5).select("l_orderkey", "l_linenumber")


@query("""WITH t AS (SELECT median(s_acctbal) AS m, coalesce(stddev_samp(s_acctbal), 0) AS s FROM supplier),
 g AS (SELECT s_suppkey, s_acctbal, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey DESC) AS place, count(*) OVER () AS n FROM supplier, t WHERE s_acctbal >= m - s)
SELECT s_suppkey, s_acctbal, place FROM g WHERE place <= greatest(2, floor(n * 20 / 100))""")
def median_std_topfraction(spark, sf_dir):
    return stats.best_fraction(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey", 20).select("s_suppkey", "s_acctbal", F.col("place").cast("long").alias("place"))


@query("SELECT o_orderpriority, max((o_totalprice, o_orderkey))[2] AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1")
def arg_max_order(spark, sf_dir):
    return stats.arg_max(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_orderkey", "o_totalprice")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def last_write_wins(spark, sf_dir):
    return stats.last_write_wins(table(spark, sf_dir, "events"), ["user_id"], "event_type", ["ts", "event_id"])


@query("SELECT p_brand, count(p_retailprice) AS n, min(p_retailprice) AS least, max(p_retailprice) AS greatest, round(avg(p_retailprice), 6) AS mean, round(stddev_pop(p_retailprice), 6) AS deviation FROM part GROUP BY 1")
def spread_by_brand(spark, sf_dir):
    out = stats.spread_by_key(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")
    return out.select("p_brand", "n", "least", "greatest", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("""WITH g AS (SELECT o_custkey, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS d FROM orders GROUP BY 1), a AS (SELECT avg(c_acctbal) AS am, stddev_pop(c_acctbal) AS ad FROM customer)
SELECT c_custkey, round(coalesce(m, am), 6) AS mean, round(coalesce(d, ad), 6) AS deviation FROM customer LEFT JOIN g ON o_custkey = c_custkey, a""")
def mean_with_fallback(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    by_customer = stats.spread_by_key(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice"), "c_custkey", "o_totalprice")
    out = stats.with_fallback(c, by_customer, "c_custkey", "c_acctbal")
    return out.select("c_custkey", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@query("""WITH l AS (SELECT p_partkey, p_retailprice / length(p_name) AS r, unnest(list_distinct(regexp_extract_all(p_name, '.'))) AS letter FROM part WHERE length(p_name) > 0)
SELECT letter, round(avg(r), 6) AS mean_ratio, count(*) AS n FROM l GROUP BY 1""")
def letter_ratios(spark, sf_dir):
    return stats.letter_ratios(table(spark, sf_dir, "part"), "p_name", "p_retailprice").select("letter", F.round("mean_ratio", 6).alias("mean_ratio"), "n")


@query("SELECT l_returnflag, round(avg((l_quantity + l_discount) / 2), 6) AS cx, round(avg((l_tax + l_extendedprice) / 2), 4) AS cy FROM lineitem GROUP BY 1")
def box_centroid(spark, sf_dir):
    out = stats.centroid(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return out.select("l_returnflag", F.round("cx", 6).alias("cx"), F.round("cy", 4).alias("cy"))


@query("SELECT p_brand, first_idx, row_number() OVER (ORDER BY first_idx, p_brand) - 1 AS ordinal, (row_number() OVER (ORDER BY first_idx, p_brand) - 1) % 20 AS slot FROM (SELECT p_brand, min(p_partkey) AS first_idx FROM part GROUP BY 1)")
def first_seen_ordinals(spark, sf_dir):
    return rows.first_seen(table(spark, sf_dir, "part"), "p_brand", "p_partkey")


@query("SELECT c_mktsegment AS street, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, street LIMIT 3")
def street_counts(spark, sf_dir):
    return stats.top_n(stats.frequencies(table(spark, sf_dir, "customer"), F.col("c_mktsegment"), "street"), "n", "street", 3)


@query("SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber) - 1 AS nth FROM lineitem")
def running_counter(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return stats.running_index(li, "l_suppkey", ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.col("nth").cast("long").alias("nth"))


@query("""SELECT event_id, round(CASE WHEN l.at > f.at THEN (l.v - f.v) / ((l.at - f.at) / 1e6) END, 9) AS rate FROM (
 SELECT event_id, min({'at': epoch_us(ts), 'v': value}) OVER w AS f, max({'at': epoch_us(ts), 'v': value}) OVER w AS l
 FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts RANGE BETWEEN INTERVAL 86400 SECONDS PRECEDING AND CURRENT ROW))""")
def trailing_rate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return series.trailing_rate(e, ["event_type", "user_id"], "ts", "value", 86400).select("event_id", F.round("rate", 9).alias("rate"))


@query("SELECT conv_id, CAST(count(*) AS INTEGER) AS n_turns, string_agg(text, chr(10) ORDER BY turn) AS body FROM conversations GROUP BY 1")
def conversation_assembly(spark, sf_dir):
    return series.assemble_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")


@query("""WITH h AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, l_quantity, n, CAST(floor(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) / sum(n) OVER (PARTITION BY l_returnflag) * 255 + 1e-9) AS INTEGER) AS level FROM h""")
def cumulative_levels(spark, sf_dir):
    return series.cumulative_levels(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("""WITH o AS (SELECT DISTINCT p_brand, p_size FROM part WHERE p_size >= 1)
SELECT b.p_brand, CAST(s.n AS INTEGER) AS number, EXISTS (SELECT 1 FROM o WHERE o.p_brand = b.p_brand AND o.p_size = s.n) AS occupied FROM (SELECT DISTINCT p_brand FROM o) b, range(1, 51) s(n)""")
def dense_sequence_occupancy(spark, sf_dir):
    return grid.dense_occupancy(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 50)


@query("""WITH r AS (SELECT p_partkey, p_size AS number, p_brand FROM part WHERE p_size IS NOT NULL), q AS (SELECT quantile_cont(number, 0.25) AS q1, quantile_cont(number, 0.75) AS q3 FROM r),
 i AS (SELECT r.* FROM r, q WHERE number BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)),
 h AS (SELECT number, arg_max(p_brand, p_partkey) AS p_brand FROM i GROUP BY 1),
 e AS (SELECT (greatest(coalesce(max(number) FILTER (number % 2 = 1), 100), coalesce(max(number) FILTER (number % 2 = 0), 100)) + 10) // 2 AS last FROM i)
SELECT s.side, CAST(t.slot AS INTEGER) AS slot, CAST(2 * t.slot + s.odd AS INTEGER) AS number, coalesce(h.p_brand, 'Unknown') AS p_brand
FROM e, (VALUES ('even', 0), ('odd', 1)) s(side, odd), range(0, 200) t(slot) LEFT JOIN h ON h.number = 2 * t.slot + s.odd WHERE t.slot <= e.last""".replace("FROM e, (VALUES ('even', 0), ('odd', 1)) s(side, odd), range(0, 200) t(slot)", "FROM e CROSS JOIN (VALUES ('even', 0), ('odd', 1)) s(side, odd) CROSS JOIN range(0, 200) t(slot)"))
def two_sided_street(spark, sf_dir):
    return grid.street_grid(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), "p_size", "p_brand", "p_partkey")


@query("""WITH s AS (SELECT b.p_brand, r.n AS slot FROM (SELECT DISTINCT p_brand FROM part) b, range(1, 61) r(n)),
 f AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY slot) AS k FROM s WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = s.p_brand AND p.p_size = s.slot AND p.p_partkey % 3 <> 0)),
 w AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_partkey % 3 = 0)
SELECT f.p_brand, CAST(f.slot AS INTEGER) AS p_size, w.p_partkey FROM f JOIN w USING (p_brand, k)""")
def first_free_slot(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey")
    slots = p.select("p_brand").distinct().select("p_brand", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("p_size"))
    return grid.first_free_slots(slots, p.where("p_partkey % 3 <> 0"), p.where("p_partkey % 3 = 0"), ["p_brand"], "p_size", "p_partkey")


@query("""SELECT CAST(floor((l_quantity - x0) / 5.0) AS BIGINT) AS gx, CAST(floor((l_tax - y0) / 5.0) AS BIGINT) AS gy, count(*) AS n, round(avg(l_extendedprice), 4) AS mean_z
FROM lineitem, (SELECT min(l_quantity) AS x0, min(l_tax) AS y0 FROM lineitem) GROUP BY 1, 2""")
def grid_bin_mean(spark, sf_dir):
    out = grid.bin_mean(table(spark, sf_dir, "lineitem"), "l_quantity", "l_tax", "l_extendedprice", 5.0)
    return out.select("gx", "gy", "n", F.round("mean_z", 4).alias("mean_z"))


@query("""SELECT CAST(floor(l_quantity / 4) AS BIGINT) AS v_l_quantity, CAST(floor(l_extendedprice / 4) AS BIGINT) AS v_l_extendedprice, round(avg(l_quantity), 6) AS l_quantity, round(avg(l_extendedprice), 4) AS l_extendedprice, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def voxel_downsample(spark, sf_dir):
    out = grid.voxel_downsample(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], 4.0)
    return out.select("v_l_quantity", "v_l_extendedprice", F.round("l_quantity", 6).alias("l_quantity"), F.round("l_extendedprice", 4).alias("l_extendedprice"), "n")


def _cells(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_quantity", F.pmod("l_partkey", F.lit(40)).alias("y"), "l_extendedprice")
    return grid.bin_mean(li, "l_quantity", "y", "l_extendedprice", 1.0)


_CELLS_SQL = "c AS (SELECT CAST(floor(l_quantity - x0) AS BIGINT) AS gx, l_partkey % 40 - y0 AS gy, avg(l_extendedprice) / 1000 AS z FROM lineitem, (SELECT min(l_quantity) AS x0, min(l_partkey % 40) AS y0 FROM lineitem) GROUP BY 1, 2)"


@query(f"""WITH {_CELLS_SQL}, s AS (SELECT gx, gy,
 CASE WHEN xb IS NULL AND xa IS NULL THEN 0 WHEN xb IS NULL THEN xa - z WHEN xa IS NULL THEN z - xb ELSE (xa - xb) / 2 END AS dx,
 CASE WHEN yb IS NULL AND ya IS NULL THEN 0 WHEN yb IS NULL THEN ya - z WHEN ya IS NULL THEN z - yb ELSE (ya - yb) / 2 END AS dy
 FROM (SELECT *, lag(z) OVER x AS xb, lead(z) OVER x AS xa, lag(z) OVER y AS yb, lead(z) OVER y AS ya FROM c WINDOW x AS (PARTITION BY gy ORDER BY gx), y AS (PARTITION BY gx ORDER BY gy)))
SELECT gx, gy, round(greatest(0, sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(135) - atan2(-dx, dy))), 5) AS shade FROM s""")
def hill_shade(spark, sf_dir):
    return grid.hill_shade(_cells(spark, sf_dir).withColumn("mean_z", F.col("mean_z") / 1000)).select("gx", "gy", F.round("shade", 5).alias("shade"))


@query()
def filled_grid(spark, sf_dir):
    cells = _cells(spark, sf_dir).withColumn("mean_z", F.when(F.pmod(F.col("gx") + F.col("gy"), F.lit(5)) != 0, F.col("mean_z")))
    return grid.fill_gaps(cells)


@query(f"""WITH g AS (SELECT lower(trim(text)) AS norm, list(doc_id ORDER BY doc_id) AS members FROM documents GROUP BY 1 HAVING count(*) > 1) SELECT norm, members FROM g""")
def duplicate_groups(spark, sf_dir):
    return dedup.duplicate_groups(table(spark, sf_dir, "documents"), F.lower(F.trim("text")), "doc_id")


@query(f"""WITH p AS (SELECT p_partkey AS idx, p_brand AS name, CASE WHEN p_size % 3 = 0 THEN 'Yes' ELSE 'No' END AS inside, CASE WHEN p_size % 5 = 0 THEN 'Not specified' ELSE CAST(1800 + p_size AS VARCHAR) || ' and 19th Century' END AS years, p_name || '. ' || p_type || '! ' AS descr, CASE WHEN p_size % 2 = 0 THEN p_type END AS extra FROM part),
 b AS (SELECT lower(name) AS norm, count(*) AS n, arg_max(idx, (CASE WHEN extra IS NULL THEN 0 ELSE 1 END, -idx)) AS base, max(inside) AS inside, list(years) AS ys, list(descr) AS ds FROM p GROUP BY 1),
 y AS (SELECT norm, list_sort(list_distinct(flatten(list_transform(list_filter(ys, lambda v: v <> 'Not specified'), lambda v: regexp_extract_all(v, '\\d{{2}}th Century|\\d{{4}}'))))) AS found, {_SENTENCES.format("array_to_string(ds, '.')")} AS sents, * EXCLUDE (norm) FROM b)
SELECT p.idx, p.name, CASE WHEN n = 1 THEN p.inside ELSE y.inside END AS inside,
 CASE WHEN n = 1 THEN p.years WHEN len(found) = 0 THEN 'Not specified' ELSE array_to_string(list_concat(list_filter(found, lambda v: length(v) = 4), list_filter(found, lambda v: length(v) > 4)), ', ') END AS years,
 CASE WHEN n = 1 THEN p.descr ELSE array_to_string(sents, '. ') || '.' END AS descr, p.extra FROM y JOIN p ON p.idx = y.base""")
def dup_groups_merge(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("idx"), F.col("p_brand").alias("name"), F.when(F.col("p_size") % 3 == 0, "Yes").otherwise("No").alias("inside"),
        F.when(F.col("p_size") % 5 == 0, "Not specified").otherwise(F.concat((1800 + F.col("p_size")).cast("string"), F.lit(" and 19th Century"))).alias("years"),
        F.concat("p_name", F.lit(". "), "p_type", F.lit("! ")).alias("descr"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("extra"),
    )
    return dedup.merge_duplicates(p, F.lower("name"), "idx", "years", "descr", "inside")


@query(r"""WITH w AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '\w+')) AS s FROM benchmark),
 p AS (SELECT a.item_id AS i, b.item_id AS j, len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE) AS jaccard FROM w a JOIN w b ON a.item_id < b.item_id WHERE len(a.s) > 0 AND len(b.s) > 0)
SELECT i, j, round(jaccard, 9) AS jaccard FROM p WHERE jaccard >= 0.3""")
def near_dup_pairs(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(r"\w+"), F.lit(0)).alias("words"))
    return dedup.set_similar_pairs(b, "item_id", "words", 0.3).select("i", "j", F.round("jaccard", 9).alias("jaccard"))


def _news(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("idx"), F.concat(F.lit("May "), (F.col("n_nationkey") % 3 + 1).cast("string"), F.lit(", 1936")).alias("date"), F.col("n_name").alias("names"), F.lit("Town").alias("location"), F.lit("A fire.").alias("description"), F.lit("fire; town").alias("tags"))


@query()
def similar_rows(spark, sf_dir):
    return dedup.similar_rows(_news(spark, sf_dir), "idx", 0.75)


@query()
def keep_first(spark, sf_dir):
    news = _news(spark, sf_dir)
    return dedup.keep_first(news, dedup.similar_rows(news, "idx", 0.75), "idx")


@query("""SELECT p_partkey, p_name, levenshtein(lower(p_name), 'red widget') / CAST(greatest(length(p_name), 10) AS DOUBLE) AS score FROM part WHERE levenshtein(lower(p_name), 'red widget') / CAST(greatest(length(p_name), 10) AS DOUBLE) <= 0.3""")
def edit_distance_search(spark, sf_dir):
    return dedup.edit_search(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", "red widget")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_members(spark, sf_dir):
    return dedup.members(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_members(spark, sf_dir):
    return dedup.not_members(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def concatenated_rows(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).unionByName(s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


def _edges(li):
    """Distinct pairs of parts (src < dst) that share an order.

    Tasks are numbered by rows and pairs: by the bytes of lines a task would be given far more pairs than it can hold.
    """
    count = li.groupBy("l_orderkey").agg(F.count("*").alias("n")).agg(F.sum("n"), F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()  # one row
    n, pairs = int(count[0] or 0), int(count[1] or 0)
    lines = li.select("l_orderkey", "l_partkey").repartition(max(n // 500_000, pairs // 1_000_000) + 1, "l_orderkey")
    other = lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    edges = lines.join(other, "l_orderkey").where("l_partkey < dst").select(F.col("l_partkey").alias("src"), "dst")
    return edges.repartition(pairs // 1_000_000 + 1, "src", "dst").distinct()


def _graph(spark, sf_dir):
    edges = rows.stored(_edges(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")))
    nodes, _ = graph.build(edges, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))
    return nodes, edges


_GRAPH_SQL = "l AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM l a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey), n AS (SELECT p_partkey AS node FROM part UNION SELECT src FROM e UNION SELECT dst FROM e), bi AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e)"


@query(f"""WITH {_GRAPH_SQL}, d AS (SELECT node, count(dst) AS degree FROM n LEFT JOIN bi ON src = node GROUP BY 1),
 t AS (SELECT a.src AS node, count(*) AS triangles FROM bi a JOIN bi b ON a.src = b.src AND a.dst < b.dst JOIN e ON e.src = a.dst AND e.dst = b.dst GROUP BY 1)
SELECT node, degree, coalesce(triangles, 0) AS triangles, round(CASE WHEN degree > 1 THEN 2.0 * coalesce(triangles, 0) / (degree * (degree - 1)) ELSE 0 END, 9) AS coefficient FROM d LEFT JOIN t USING (node)""")
def degree_clustering(spark, sf_dir):
    return graph.clustering(*_graph(spark, sf_dir)).withColumn("coefficient", F.round("coefficient", 9))


@query()  # a recursive query over the whole graph is too slow; the tests compare with brute force
def connected_components(spark, sf_dir):
    # parts of an order are tied to its least one, which joins the same parts as all their pairs
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").where("l_orderkey IS NOT NULL")
    least = F.min("l_partkey").over(Window.partitionBy("l_orderkey"))
    edges = li.withColumn("src", least).where("src < l_partkey").select("src", F.col("l_partkey").alias("dst"))
    edges = rows.stored(graph.contracted(edges.repartitionByRange(rows.pieces(li), "src")))
    nodes, _ = graph.build(edges, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))
    return graph.components(nodes, edges)


@query(f"WITH {_GRAPH_SQL} SELECT src, dst FROM e SEMI JOIN (SELECT p_partkey FROM part WHERE p_size > 15) a ON a.p_partkey = src SEMI JOIN (SELECT p_partkey FROM part WHERE p_size > 15) b ON b.p_partkey = dst")
def guarded_edges(spark, sf_dir):
    # the guard holds for lines already: an edge has both ends where both lines have theirs
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").where("p_size > 15").select(F.col("p_partkey").alias("node"))
    lines = graph.guarded_edges(li.repartition(rows.pieces(li), "l_partkey"), parts, ("l_partkey",))
    return _edges(lines)


@query()
def layout_connectivity(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 8).alias("graph"), (F.col("l_partkey") % 30).alias("src"), (F.col("l_orderkey") % 30).alias("dst")).where("src <> dst").distinct()
    return graph.edge_connectivity(li)


_QUERY_VECTOR = [round(0.01 * ((i * 7) % 13 - 6), 2) for i in range(64)]


@query(f"SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST({_QUERY_VECTOR} AS DOUBLE[])), 6) AS cosine FROM embeddings ORDER BY cosine DESC, vec_id LIMIT 10")
def cosine_topk(spark, sf_dir):
    return vectors.cosine_top_k(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", _QUERY_VECTOR, 10).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query("""WITH d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS d FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY d, neighbour) AS k FROM d)
SELECT query, max(CASE WHEN k = 1 THEN neighbour END) AS best, round(max(CASE WHEN k = 1 THEN d END), 6) AS d1, round(max(CASE WHEN k = 2 THEN d END), 6) AS d2, max(CASE WHEN k = 1 THEN d END) < 0.97 * max(CASE WHEN k = 2 THEN d END) AS clear FROM r WHERE k <= 2 GROUP BY query""")
def knn2_ratio_test(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    out = vectors.nearest_two(e, e, "vec_id", "embedding", others=True)
    return out.select("query", "best", F.round("d1", 6).alias("d1"), F.round("d2", 6).alias("d2"), (F.col("d1") < 0.97 * F.col("d2")).alias("clear"))


@query("""WITH p AS (SELECT s_suppkey, s_acctbal / 1000 AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier), d AS (SELECT a.s_suppkey, sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS d FROM p a JOIN p b ON a.s_suppkey <> b.s_suppkey),
 k AS (SELECT s_suppkey, avg(d) AS m FROM (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY d) AS r FROM d) WHERE r <= 5 GROUP BY 1)
SELECT s_suppkey, round(m, 6) AS mean_distance, m > (SELECT avg(m) + 2.0 * stddev_samp(m) FROM k) AS outlier FROM k""")
def point_outliers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return vectors.statistical_outliers(s, "s_suppkey", ["x", "y"], 5).withColumn("mean_distance", F.round("mean_distance", 6))


@query("""SELECT error, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'missing_label' WHEN d.n_chars <> length(d.text) THEN 'length_mismatch' END AS error FROM documents d LEFT JOIN labels l USING (doc_id)) WHERE error IS NOT NULL GROUP BY 1""")
def dead_letters(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    _, failed = records.dead_letters(d, {"missing_label": F.col("quality").isNotNull(), "length_mismatch": F.col("n_chars") == F.length("text")})
    return failed.groupBy("error").agg(F.count("*").alias("n"))


@query()
def subsequence_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.split("p_name", "").alias("a"), F.split("p_type", "").alias("b"))
    return p.select("p_partkey", F.round(scoring.sequence_score("a", "b"), 6).alias("score"))


@query("""WITH m AS (SELECT p_partkey, p_name AS name, length(p_name) AS n FROM part), s AS (SELECT *, len(list_distinct(regexp_extract_all(name, '.'))) AS k FROM m)
SELECT p_partkey, round(0.4 * exp(-pow((n - 10.0) / 2, 2) / 2) / (2 * sqrt(2 * pi())) + 0.3 * exp(-pow((100.0 / n - 9.0) / 3, 2) / 2) / (3 * sqrt(2 * pi()))
 + 0.2 * exp(-pow((k / CAST(n AS DOUBLE) - 0.7) / 0.2, 2) / 2) / (0.2 * sqrt(2 * pi())) + 0.1 * ((CASE WHEN contains(lower(name), 'e') THEN 1 ELSE 0 END) + (CASE WHEN contains(lower(name), 'w') THEN 1 ELSE 0 END)) / 2.0, 9) AS score FROM s""")
def candidate_scores(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("name"))
    model = {"length": 10.0, "length_dev": 2.0, "width": 100.0, "density": 9.0, "density_dev": 3.0, "variety": 0.7, "variety_dev": 0.2}
    scored = scoring.candidate_scores(p.select("name").distinct(), model, "ew")
    return p.join(scored, "name").select("p_partkey", F.round("score", 9).alias("score"))
