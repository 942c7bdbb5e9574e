"""Queries of the readers and writers: a table is written to the shared folder in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.operators import grid
from quern.operators.rows import shared_path
from quern.plans.registry import query, table
from quern.sources import files


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    path = shared_path(spark, "customers.csv")
    files.write_csv(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment"), path)
    return files.read_csv(spark, path, files.strings("c_custkey", "c_name", "c_mktsegment"))


@query("SELECT CASE WHEN p_size % 3 = 0 THEN 2 ELSE 3 END AS n_fields, CAST(p_partkey AS VARCHAR) AS first, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type || ', \"' || p_brand || '\"' END AS last FROM part")
def raw_csv_rows(spark, sf_dir):
    """Records of two and of three fields in one file, some quoted, read as they are."""
    path = shared_path(spark, "ragged")
    p = table(spark, sf_dir, "part")
    quoted = F.concat(F.lit('"'), F.replace(F.concat("p_type", F.lit(', "'), "p_brand", F.lit('"')), F.lit('"'), F.lit('""')), F.lit('"'))
    p.select(F.when(F.col("p_size") % 3 == 0, F.concat_ws(",", "p_partkey", "p_name")).otherwise(F.concat_ws(",", "p_partkey", "p_name", quoted)).alias("value")).write.text(path)
    rows = files.read_ragged_csv(spark, path)
    return rows.select(F.size("fields").alias("n_fields"), F.col("fields")[0].alias("first"), F.element_at("fields", -1).alias("last"))


@query("SELECT kind, CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation, (SELECT unnest(['csv', 'json', 'list']) AS kind)")
def loaded_records(spark, sf_dir):
    """The same records from a CSV, a JSON array and a list."""
    schema = files.strings("n_nationkey", "n_name")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name")
    as_csv, as_json = shared_path(spark, "nations.CSV"), shared_path(spark, "nations.json")
    files.write_csv(n, as_csv)
    n.agg(F.to_json(F.collect_list(F.struct("*"))).alias("value")).write.text(as_json)
    loaded = {"csv": as_csv, "json": as_json, "list": [r.asDict() for r in n.collect()]}  # a list is the driver's own
    parts = [files.load_records(spark, source, schema).select(F.lit(kind).alias("kind"), "*") for kind, source in loaded.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE line <> '' GROUP BY 1")
def text_lines(spark, sf_dir):
    path = shared_path(spark, "lines")
    table(spark, sf_dir, "conversations").select(F.col("text").alias("value")).write.text(path)
    return files.read_lines(spark, path).where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES ('Apteka', 'Lutzka 3'), ('Hotel \"Rex\"', 'Rynek, 7'), ('Kino', NULL)) AS t(name, address)")
def inline_csv(spark, sf_dir):
    out = files.csv_literal(spark, 'name, address\nApteka, Lutzka 3\n"Hotel ""Rex""","Rynek, 7"\nKino,\n')
    return out.select("name", F.nullif("address", F.lit("")).alias("address"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, s_acctbal AS x, CAST(s_nationkey AS DOUBLE) AS y FROM supplier WHERE s_suppkey % 4 <> 0")
def geojson_points(spark, sf_dir):
    """Points of collections of one nation each; features of other shapes are left out."""
    path = shared_path(spark, "geojson")
    kind = F.when(F.col("s_suppkey") % 4 == 0, "Polygon").otherwise("Point")
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name")).alias("properties"), F.struct(kind.alias("type"), F.array("s_acctbal", F.col("s_nationkey").cast("double")).alias("coordinates")).alias("geometry"))
    by_nation = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(feature).alias("features"))
    by_nation.select("s_nationkey", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value")).write.partitionBy("s_nationkey").text(path)
    return files.read_geojson_points(spark, f"{path}/*/*.txt")


@query("SELECT CAST(s_suppkey AS DOUBLE) AS x, s_acctbal AS y, CAST(s_nationkey AS DOUBLE) AS z FROM supplier")
def ply_points(spark, sf_dir):
    """Vertices of files of one nation each."""
    path = shared_path(spark, "ply")
    line = F.concat_ws(" ", F.col("s_suppkey").cast("double"), "s_acctbal", F.col("s_nationkey").cast("double"))
    by_nation = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list(line).alias("v"))
    head = F.concat(F.lit("ply\nformat ascii 1.0\nelement vertex "), F.size("v").cast("string"), F.lit("\nproperty double x\nproperty double y\nproperty double z\nend_header\n"))
    by_nation.select("s_nationkey", F.concat(head, F.array_join("v", "\n")).alias("value")).write.partitionBy("s_nationkey").text(path)
    return files.read_ply(spark, f"{path}/*/*.txt").select("x", "y", "z")


@query("SELECT r_name || chr(10) AS content, length(r_name) + 1 AS length FROM region")
def folder_files(spark, sf_dir):
    """Files of an ending, in either case; those of other endings in the same folders are left out."""
    path = shared_path(spark, "pictures")
    r = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("value"))
    r.write.partitionBy("r_regionkey").text(path)
    r.write.mode("append").partitionBy("r_regionkey").json(path)
    return files.read_binary(spark, path, ("txt",)).select(F.col("content").cast("string").alias("content"), "length")


@query("SELECT CAST(c_custkey AS BIGINT) AS id, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '' END AS nickname, (SELECT count(*) FROM customer WHERE c_acctbal < 0) AS errors FROM customer WHERE c_acctbal >= 0")
def json_records(spark, sf_dir):
    path = shared_path(spark, "records")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("nickname"), "c_acctbal")
    bad = c.where("c_acctbal < 0")
    files.write_records(c.where("c_acctbal >= 0").drop("c_acctbal"), bad.agg(F.count("*").alias("errors")), bad, path)
    stats = spark.read.schema("errors long").json(f"{path}/stats")  # one row
    return spark.read.schema("id long, name string, nickname string").json(f"{path}/records").crossJoin(F.broadcast(stats))


@query("""WITH p AS (SELECT CAST(floor((l_quantity - (SELECT min(l_quantity) FROM lineitem)) / 5) AS BIGINT) AS gx, CAST(floor((l_discount - (SELECT min(l_discount) FROM lineitem)) / 5) AS BIGINT) AS gy, l_extendedprice AS z FROM lineitem)
SELECT gx, gy, n, mean_z, max(gx) OVER () AS max_gx FROM (SELECT gx, gy, count(*) AS n, round(avg(z), 4) AS mean_z FROM p GROUP BY 1, 2)""")
def grid_round_trip(spark, sf_dir):
    path = shared_path(spark, "grid")
    cells = grid.bin_mean(table(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", "l_extendedprice", 5.0)
    files.write_grid(cells, cells.agg(F.max("gx").alias("max_gx")), path)
    bounds = spark.read.schema("max_gx long").json(f"{path}/bounds")  # one row
    return spark.read.parquet(f"{path}/cells").crossJoin(F.broadcast(bounds)).withColumn("mean_z", F.round("mean_z", 4))


@query("""SELECT '<rect x="' || printf('%.1f', 20 + n_nationkey / 25.0 * 940) || '" y="' || CASE WHEN n_nationkey % 2 = 0 THEN '60.0' ELSE '180.0' END || '" width="20" height="40" fill="#336"><title>' || n_name || '</title></rect>' AS line FROM nation
UNION ALL SELECT unnest(['<svg xmlns="http://www.w3.org/2000/svg" width="1000" height="300">', '</svg>'])""")
def street_picture(spark, sf_dir):
    """The lines of a street's picture."""
    n = table(spark, sf_dir, "nation")
    layout = n.select(F.col("n_name").alias("label"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise("odd").alias("side"), (F.col("n_nationkey") / 25.0).alias("x"), F.lit("#336").alias("colour"))
    return spark.createDataFrame([(x,) for x in files.render_svg(layout).split("\n")], "line string")


_DATES = "CASE s_suppkey % 5 WHEN 0 THEN '1938' WHEN 1 THEN '1938-09' WHEN 2 THEN '1938-09-01' WHEN 3 THEN 'about 1938' END"


@query(f"""WITH s AS (SELECT s_suppkey, s_nationkey, {_DATES} AS d FROM supplier)
SELECT s_suppkey, CASE WHEN regexp_full_match(d, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'day' WHEN regexp_full_match(d, '\\d{{4}}-\\d{{2}}') THEN 'month' WHEN regexp_full_match(d, '\\d{{4}}') THEN 'year' END AS precision,
 CASE WHEN s_nationkey % 4 <> 0 THEN [CAST(s_nationkey AS INT), CAST(s_nationkey + 1 AS INT)] END AS districts, CASE WHEN s_nationkey % 3 = 0 THEN CAST(s_nationkey AS INT) END AS start_year FROM s""")
def archive_cells(spark, sf_dir):
    """Cells as they stand in the tables: partial dates, district lists, nested values in Python's notation."""
    from quern.functions import text

    s = table(spark, sf_dir, "supplier").withColumn("d", F.expr(_DATES))
    districts = F.when(F.col("s_nationkey") % 4 == 0, "X").otherwise(F.concat_ws(":", "s_nationkey", F.col("s_nationkey") + 1))
    cell = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("{'start': ["), "s_nationkey", F.lit("], 'end': []}"))).otherwise("{'start': [], 'end': []}")
    found = files.parse_python_cell(cell, "start array<int>, end array<int>")
    return s.select("s_suppkey", text.date_precision(F.col("d")).alias("precision"), files.district_list(districts).alias("districts"), F.try_element_at(found["start"], F.lit(1)).alias("start_year"))


_ICON = "CASE WHEN page_id % 3 = 0 THEN '<a href=\"/x\">no</a>' WHEN page_id % 3 = 1 THEN '<a class=\"big icon-file\" href=\"/f/' || page_id || '.pdf\">f</a>' ELSE '<a class=\"icon-file\" href=\"https://other.org/' || page_id || '\">f</a>' END"


@query(f"SELECT page_id, CASE page_id % 3 WHEN 1 THEN 'https://library.org/f/' || page_id || '.pdf' WHEN 2 THEN 'https://other.org/' || page_id END AS link FROM (SELECT page_id, html || {_ICON} AS html FROM pages)")
def file_links(spark, sf_dir):
    """The first link of a class on each page, as an absolute address."""
    p = table(spark, sf_dir, "pages").select("page_id", F.concat("html", F.expr(_ICON)).alias("html"))
    return p.select("page_id", files.first_link_of_class(F.col("html"), "https://library.org/docs/list", "icon-file").alias("link"))
