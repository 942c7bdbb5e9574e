"""Queries of scans, filters and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import address, text
from quern.operators import dedup, rows, stats
from quern.plans.registry import query, table
from quern.sources import files

CATEGORIES = {"PROMO": "trade", "STANDARD": "trade", "ECONOMY": "craft", "SMALL": "craft", "MEDIUM": "services", "LARGE": "services"}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("""SELECT CAST(regexp_extract(p_brand, '(\\d+)', 1) AS DOUBLE) AS brand_no, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, brand_no LIMIT 10""")
def brand_number_topk(spark, sf_dir):
    by = table(spark, sf_dir, "part").groupBy(address.first_number(F.col("p_brand")).alias("brand_no")).agg(F.count("*").alias("n"))
    return stats.top_n(by, "n", "brand_no", 10)


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, 'widget', 'i')")
def contains_ci(spark, sf_dir):
    return table(spark, sf_dir, "part").where(text.contains_pattern(F.col("p_name"), "widget")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_brand, p_brand AS label FROM part")
def column_copy(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_brand").alias("label"))


@query(r"""SELECT c_custkey, TRY_CAST(regexp_extract(c_name, '(\d+)', 1) AS DOUBLE) AS first_no,
 TRY_CAST(list_last(regexp_split_to_array(trim(replace(c_name, '#', ' ')), '\s+')) AS INTEGER) AS last_no,
 trim(substr(c_name, 1, length(c_name) - length(regexp_extract(c_name, '(\d+)$', 1)))) AS street,
 TRY_CAST(regexp_extract(c_name, '(\d+)$', 1) AS INTEGER) AS number,
 CASE WHEN starts_with(replace(c_name, '#', ' '), 'Customer') AND replace(c_name, '#', ' ') <> 'Customer'
   THEN coalesce(TRY_CAST(list_last(regexp_split_to_array(trim(replace(c_name, '#', ' ')), '\s+')) AS INTEGER), 1000) ELSE 1000 END AS or_sentinel,
 regexp_split_to_array(trim(replace(c_name, '#', ' ')), '\s+')[1] AS token0 FROM customer""")
def house_numbers(spark, sf_dir):
    c, spaced = F.col("c_name"), F.replace("c_name", F.lit("#"), F.lit(" "))
    s = address.street_and_number(c)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", address.first_number(c).alias("first_no"), address.last_token_number(spaced).alias("last_no"), s["street"].alias("street"), s["number"].alias("number"),
        address.number_in_street(spaced, "Customer").alias("or_sentinel"), address.first_two_tokens(spaced)["street"].alias("token0"),
    )


@query("SELECT category, count(*) AS n FROM (SELECT CASE split_part(p_type, ' ', 1) WHEN 'PROMO' THEN 'trade' WHEN 'STANDARD' THEN 'trade' WHEN 'ECONOMY' THEN 'craft' WHEN 'SMALL' THEN 'craft' WHEN 'MEDIUM' THEN 'services' WHEN 'LARGE' THEN 'services' ELSE 'other' END AS category FROM part) GROUP BY category")
def category_lookup_default(spark, sf_dir):
    first = table(spark, sf_dir, "part").select(F.element_at(F.split("p_type", " "), 1).alias("kind"))
    return dedup.lookup(first, "kind", CATEGORIES, "other", "category").groupBy("category").agg(F.count("*").alias("n"))


@query("SELECT p_size % 2 = 0 AS even, count(*) AS n, sum(p_size) AS total FROM part GROUP BY 1")
def parity_split(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(address.is_even(F.col("p_size")).alias("even")).agg(F.count("*").alias("n"), F.sum("p_size").alias("total"))


@query("SELECT c_custkey, round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 9) AS c_acctbal_scaled FROM customer")
def minmax_scale(spark, sf_dir):
    out = stats.min_max_scale(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"])
    return out.select("c_custkey", F.round("c_acctbal_scaled", 9).alias("c_acctbal_scaled"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS INT) AS deg, CAST(l_partkey % 60 AS INT) AS m, l_suppkey % 60 + 0.5 AS s FROM lineitem)
SELECT l_orderkey, l_linenumber, round((CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END) * (deg + m / 60.0 + s / 3600.0), 9) AS degrees FROM d""")
def dms_to_degrees(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    dms = F.concat(
        F.floor("l_quantity").cast("int").cast("string"), F.lit("°"), (F.col("l_partkey") % 60).cast("string"), F.lit("'"),
        F.format_string("%.2f", F.col("l_suppkey") % 60 + F.lit(0.5)), F.lit('"'), F.when(F.col("l_linenumber") % 2 == 0, "S").otherwise("N"),
    )
    return li.select("l_orderkey", "l_linenumber", F.round(address.dms_degrees(dms), 9).alias("degrees"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower(p_name || '''s  (' || p_brand || ') ' || p_type), '''s', ''), '\s+\(.*?\)', '', 'g'), '\s+', ' ', 'g')) AS norm FROM part""")
def normalise_names(spark, sf_dir):
    name = F.concat("p_name", F.lit("'s  ("), "p_brand", F.lit(") "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", text.normalise_name(name).alias("norm"))


@query(r"""WITH r AS (SELECT doc_id, 'May ' || (doc_id % 28 + 1) || ' 1936 x' AS d, lang || ' ;  ' || source AS n, source AS p, regexp_replace(text, '\s', ' ', 'g') AS t, ' ' || lang || ' ; ' || source || ' ' AS g FROM documents)
SELECT doc_id, 'May ' || (doc_id % 28 + 1) || ', 1936' AS date, regexp_replace(n, '\s*;\s*', ' & ', 'g') AS names, p AS place,
 trim(regexp_replace(regexp_replace(regexp_replace(replace(t, '"', ''''), '([,;.])(\S)', '\1 \2', 'g'), '([,;.])(\S)', '\1 \2', 'g'), '\s+', ' ', 'g')) AS description, lang || ';' || source AS tags
FROM r JOIN documents USING (doc_id)""")
def clean_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    plain = F.regexp_replace("text", r"\s", " ")
    fields = F.array(F.concat(F.lit("May "), (F.col("doc_id") % 28 + 1).cast("string"), F.lit(" 1936 x")), F.concat("lang", F.lit(" ;  "), "source"), F.col("source"), plain, F.concat(F.lit(" "), "lang", F.lit(" ; "), "source", F.lit(" ")), F.lit("extra"))
    r = text.clean_newspaper_row(fields)
    return d.select("doc_id", *(r[i].alias(n) for i, n in enumerate(["date", "names", "place", "description", "tags"])))


@query("SELECT s_suppkey, 'S' || s_suppkey AS surname, ['An', 'Jo'] AS given FROM supplier")
def split_names(spark, sf_dir):
    n = text.split_name(F.concat(F.lit("An S"), F.col("s_suppkey").cast("string"), F.lit(" Jo")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", n["surname"].alias("surname"), n["given"].alias("given"))


@query()
def names_title_nfkc(spark, sf_dir):
    n = text.split_name_last(F.lower(F.concat(F.lit("(o'neil-ﬁ "), "s_name")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", n["first"].alias("first"), n["last"].alias("last"), text.nfkc(F.concat(F.lit("  ﬁ ①"), "s_name")).alias("nfkc"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'UNBEKANNT' WHEN o_orderkey % 11 = 0 THEN NULL ELSE strftime(o_orderdate, '%d.%m.%Y') END AS parsed,
 CASE WHEN o_orderkey % 7 = 0 THEN false ELSE true END AS shaped, upper(trim(o_orderpriority)) AS nationality FROM orders""")
def validate_dates(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    raw = F.when(F.col("o_orderkey") % 7 == 0, "UNBEKANNT").when(F.col("o_orderkey") % 11 == 0, "31.02.1928").otherwise(F.date_format("o_orderdate", "d.M.yyyy"))
    return o.select("o_orderkey", text.parse_date(raw).alias("parsed"), text.looks_like_date(raw).alias("shaped"), text.upper_trimmed(F.col("o_orderpriority")).alias("nationality"))


@query(r"""SELECT page_id, substr(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g'), 1, 150) || '.pdf' AS file FROM pages""")
def safe_filenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.safe_filename(F.col("url")).alias("file"))


@query("""WITH n AS (SELECT doc_id, n_chars * 37 AS b, n_chars AS s FROM documents)
SELECT doc_id, CASE WHEN b < 1024 THEN printf('%.1f B', b / 1.0) WHEN b < 1048576 THEN printf('%.1f KB', b / 1024.0) ELSE printf('%.1f MB', b / 1048576.0) END AS size,
 CASE WHEN s < 60 THEN printf('%ds', s) WHEN s < 3600 THEN printf('%dm %ds', s // 60, s % 60) ELSE printf('%dh %dm', s // 3600, (s % 3600) // 60) END AS time FROM n""")
def human_units(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.human_size(F.col("n_chars") * 37).alias("size"), text.human_time(F.col("n_chars")).alias("time"))


@query("""SELECT c_custkey, [CASE lower(c_mktsegment) WHEN 'building' THEN 'house' ELSE lower(c_mktsegment) END, CAST(c_nationkey AS VARCHAR)] AS items FROM customer""")
def parse_lists(spark, sf_dir):
    raw = F.concat(F.lit('["'), "c_mktsegment", F.lit("\", , '"), F.col("c_nationkey").cast("string"), F.lit(" ']"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.parse_query_list(raw, {"building": "house"}).alias("items"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion')")
def nested_contains(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(text.contains_text(F.col("text"), "TION")).select("doc_id")


@query("SELECT p_partkey, p_type FROM part WHERE length(p_type) BETWEEN 10 AND 11 AND contains(p_type, 'A') AND contains(p_type, 'E')")
def length_and_letters(spark, sf_dir):
    return table(spark, sf_dir, "part").where(text.length_and_letters(F.col("p_type"), 10.5, ["A", "E"])).select("p_partkey", "p_type")


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r % 7 = 0")
def every_nth(spark, sf_dir):
    return rows.every_nth(table(spark, sf_dir, "orders").select("o_orderkey"), [F.col("o_orderkey")], 7)


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS x, l_partkey % 50 + 1.0 AS y, l_suppkey % 7 - 3.0 AS z, radians(15.0) AS h, radians(5.0) AS t FROM lineitem),
 q AS (SELECT *, x * cos(h) - y * sin(h) AS r, x * sin(h) + y * cos(h) AS f FROM p), a AS (SELECT *, f * cos(t) + z * sin(t) AS ahead, z * cos(t) - f * sin(t) AS up FROM q)
SELECT l_orderkey, l_linenumber, round(CASE WHEN ahead > 1e-4 THEN r / (ahead * tan(radians(30.0)) * 1.5) END, 6) AS u,
 round(CASE WHEN ahead > 1e-4 THEN up / (ahead * tan(radians(30.0))) END, 6) AS v,
 coalesce(ahead > 1e-4 AND abs(r / (ahead * tan(radians(30.0)) * 1.5)) <= 1 AND abs(up / (ahead * tan(radians(30.0)))) <= 1, false) AS visible,
 round(atan2(x, y) - h - 2 * pi() * floor((atan2(x, y) - h + pi()) / (2 * pi())), 6) AS bearing, round(atan2(z, sqrt(x * x + y * y)), 6) AS elevation FROM a""")
def project_points(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    x, y, z = F.col("l_quantity") - 25, F.col("l_partkey") % 50 + F.lit(1.0), F.col("l_suppkey") % 7 - F.lit(3.0)
    p = address.projected(x, y, z, F.lit(15.0), F.lit(5.0))
    return li.select(
        "l_orderkey", "l_linenumber", F.round(p["u"], 6).alias("u"), F.round(p["v"], 6).alias("v"), p["visible"].alias("visible"),
        F.round(address.bearing(x, y, F.radians(F.lit(15.0))), 6).alias("bearing"), F.round(address.elevation(x, y, z), 6).alias("elevation"),
    )


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES))
def count_tables(spark, sf_dir):
    return files.table_counts({t: table(spark, sf_dir, t) for t in TABLES})


@query("""SELECT page_id, len(h) AS n_links, len(list_filter(h, lambda x: starts_with(x, '/'))) AS n_local FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]*)"', 1) AS h FROM pages)""")
def html_links(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", files.hrefs(F.col("html")).alias("h"))
    return p.select("page_id", F.size("h").cast("long").alias("n_links"), F.size(F.filter("h", lambda x: F.startswith(x, F.lit("/")))).cast("long").alias("n_local"))


@query("""SELECT page_id AS id, regexp_extract(url, '^(https?://[^/]+)', 1) || regexp_extract(html, '(?s)<nav>.*?<a href="([^"]*)">', 1) AS url, trim(regexp_extract(html, '(?s)<nav>.*?<a href="[^"]*">([^<]*)</a>', 1)) AS title
FROM pages WHERE regexp_matches(html, '(?s)<nav>.*?<a href="[^"]*">')""")
def box_first_links(spark, sf_dir):
    """The first link of each page's menu, which stands in a box here."""
    boxed = F.replace(F.replace("html", F.lit("<nav>"), F.lit('<div class="menu box">')), F.lit("</nav>"), F.lit("</div>"))
    return files.box_links(table(spark, sf_dir, "pages").select("page_id", "url", boxed.alias("html")), "page_id", "url", "html", "box")


@query("SELECT page_id, url FROM pages WHERE page_id NOT IN (SELECT doc_id FROM labels)")
def pending_fetches(spark, sf_dir):
    return files.not_yet_fetched(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")), "page_id")


@query("SELECT event_id, user_id FROM events WHERE event_id BETWEEN 100 AND 250")
def frame_range(spark, sf_dir):
    return files.frame_range(table(spark, sf_dir, "events").select("event_id", "user_id"), 100, 250, "event_id")
