"""Readers and writers. Schemas are declared, never inferred: inference would turn ``000`` into 0."""

from __future__ import annotations

import csv
import io
import json
import os
import struct
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def strings(*names: str) -> T.StructType:
    """A schema of strings, the raw layer of every source."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def read_csv(spark: SparkSession, path: str, schema: T.StructType, sep: str = ",") -> DataFrame:
    """CSV with a header line; quoted fields may hold line ends."""
    return spark.read.schema(schema).options(header=True, escape='"', multiLine=True, sep=sep, encoding="UTF-8").csv(path)


def read_csv_or_none(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """As read_csv; None where the path can't be read."""
    try:
        return read_csv(spark, path, schema)
    except AnalysisException:
        return None


def csv_literal(spark: SparkSession, text: str) -> DataFrame:
    """A table written as CSV in the code; all columns are strings."""
    rows = list(csv.reader(io.StringIO(text.strip())))
    return spark.createDataFrame([tuple(x.strip() for x in r) for r in rows[1:]], strings(*(n.strip() for n in rows[0])))


def read_ragged_csv(spark: SparkSession, path: str) -> DataFrame:
    """path, row_idx, fields: every record of CSV files with as many fields as it has.
    The header is row 0. A file is read by one task, as quoted fields may hold line ends."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"]):
                records = list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")))
                yield pd.DataFrame({"path": name, "row_idx": range(len(records)), "fields": records})

    return files.mapInPandas(rows, "path string, row_idx long, fields array<string>")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no, line of text files, as split at line ends; a file is read by one task."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return files.select("path", F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def load_records(spark: SparkSession, source: str | list, schema: T.StructType) -> DataFrame:
    """Records of a list, a .json file or a .csv or .txt file; anything else is a ValueError."""
    if isinstance(source, list):
        return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in source], schema)
    ending = os.path.splitext(str(source))[1].lower()
    if ending == ".json":
        return spark.read.schema(schema).option("multiLine", True).json(str(source))
    if ending in (".csv", ".txt"):
        return read_csv(spark, str(source), schema)
    raise ValueError(f"no loader for {source!r}")


def read_binary(spark: SparkSession, path: str, endings: tuple[str, ...] = ("jpg", "jpeg", "png", "tif", "tiff")) -> DataFrame:
    """path, modificationTime, length, content of files with one of the endings, in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*endings))


def frame_range(frames: DataFrame, first: int, last: int, number: str = "frame") -> DataFrame:
    """Frames first to last, both included."""
    return frames.where(F.col(number).between(first, last))


def read_geojson_points(spark: SparkSession, path: str) -> DataFrame:
    """id, name, x, y of the points of a FeatureCollection."""
    schema = "type string, features array<struct<type:string, properties:struct<id:string,name:string>, geometry:struct<type:string,coordinates:array<double>>>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    at = lambda i: F.try_element_at(F.col("f.geometry.coordinates"), F.lit(i))
    return found.where("f.geometry.type = 'Point'").select("f.properties.id", "f.properties.name", at(1).alias("x"), at(2).alias("y"))


_PLY = {"char": "b", "uchar": "B", "short": "h", "ushort": "H", "int": "i", "uint": "I", "float": "f", "double": "d", "float32": "f", "float64": "d", "int32": "i", "uint8": "B"}


def _ply_points(content: bytes) -> np.ndarray:
    head, _, body = content.partition(b"end_header\n")
    lines = [x.split() for x in head.decode("ascii").splitlines()]
    form = next(x[1] for x in lines if x[:1] == ["format"])
    at = next(i for i, x in enumerate(lines) if x[:2] == ["element", "vertex"])
    names = []
    for x in lines[at + 1 :]:
        if x[:1] != ["property"]:
            break
        names.append((x[2], _PLY[x[1]]))
    n, order = int(lines[at][2]), [k for k, _ in names]
    if form == "ascii":
        rows = [list(map(float, x.split()[: len(names)])) for x in body.decode("ascii").splitlines()[:n]]
    else:
        layout = struct.Struct(("<" if "little" in form else ">") + "".join(c for _, c in names))
        rows = list(layout.iter_unpack(body[: layout.size * n]))
    return np.array([[r[order.index(a)] for a in "xyz"] for r in rows], float).reshape(-1, 3)


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """path, x, y, z of the vertices of PLY files, ascii or binary."""

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"]):
                xyz = _ply_points(content)
                yield pd.DataFrame({"path": name, "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(points, "path string, x double, y double, z double")


class _Links(HTMLParser):
    def __init__(self, base: str, box: str):
        super().__init__()
        self.base, self.box, self.found = base, box, []
        self.depth, self.link, self.done = 0, None, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "div":
            if self.depth:
                self.depth += 1
            elif self.box in (a.get("class") or "").split():
                self.depth, self.done = 1, False
        elif tag == "a" and self.depth and not self.done and a.get("href"):
            self.link = [urljoin(self.base, a["href"]), ""]

    def handle_data(self, data):
        if self.link:
            self.link[1] += data

    def handle_endtag(self, tag):
        if tag == "a" and self.link:
            self.found.append((self.link[0], self.link[1].strip()))
            self.link, self.done = None, True
        elif tag == "div" and self.depth:
            self.depth -= 1


def box_links(pages: DataFrame, id_col: str, url: str, html: str, box: str) -> DataFrame:
    """id, url, title of the first link in each ``div`` of a class; boxes without a link are skipped."""

    def links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i, base, page in zip(rows["id"], rows["url"], rows["html"]):
                p = _Links(base or "", box)
                p.feed(page or "")
                out += [(i, u, t) for u, t in p.found]
            yield pd.DataFrame(out, columns=["id", "url", "title"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(links, f"id {kind}, url string, title string")


def first_link_of_class(html: Column, base: str, css: str) -> Column:
    """Absolute address of the first link of a class, null without one."""
    tag = F.regexp_extract(html, rf"""(<a\b[^>]*class=["'][^"']*\b{css}\b[^"']*["'][^>]*>)""", 1)
    href = F.regexp_extract(tag, r"""href=["']([^"']+)["']""", 1)
    root = "/".join(base.split("/")[:3])
    absolute = F.when(href.rlike("^https?:"), href).when(F.startswith(href, F.lit("/")), F.concat(F.lit(root), href)).otherwise(F.concat(F.lit(base.rsplit("/", 1)[0] + "/"), href))
    return F.when(href != "", absolute)


def hrefs(html: Column) -> Column:
    """All double-quoted link targets of a page."""
    return F.regexp_extract_all(html, F.lit('href="([^"]*)"'), F.lit(1))


def not_yet_fetched(wanted: DataFrame, fetched: DataFrame, key: str) -> DataFrame:
    """What an incremental fetch has still to do; the fetch itself isn't a query."""
    return wanted.join(fetched.select(key), key, "left_anti")


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """table, n of several tables."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header, quoted only where needed; one file if ``single``."""
    (df.coalesce(1) if single else df).write.mode("overwrite").options(header=True, escape='"', emptyValue="").csv(path)


def write_records(valid: DataFrame, stats: DataFrame, errors: DataFrame, path: str) -> None:
    """records, stats and, where there are any, errors as JSON lines in three folders."""
    if "nickname" in valid.columns:
        valid = valid.withColumn("nickname", F.coalesce("nickname", F.lit("")))
    valid.write.mode("overwrite").json(f"{path}/records")
    stats.write.mode("overwrite").json(f"{path}/stats")
    if not errors.isEmpty():
        errors.write.mode("overwrite").json(f"{path}/errors")


def write_grid(cells: DataFrame, bounds: DataFrame, path: str) -> None:
    """A grid as Parquet and its bounds as one JSON row."""
    cells.write.mode("overwrite").parquet(f"{path}/cells")
    bounds.coalesce(1).write.mode("overwrite").json(f"{path}/bounds")


def render_svg(layout: DataFrame, width: int = 1000, height: int = 300) -> str:
    """An SVG picture of a street layout (label, side, x from 0 to 1, colour), one rectangle a house.
    The layout is that of one street and is fetched whole."""
    parts = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">']
    for r in layout.orderBy("side", "x", "label").collect():
        x, y = 20 + r["x"] * (width - 60), height * (0.2 if r["side"] == "even" else 0.6)
        label = str(r["label"]).replace("&", "&amp;").replace("<", "&lt;")
        parts.append(f'<rect x="{x:.1f}" y="{y:.1f}" width="20" height="40" fill="{r["colour"]}"><title>{label}</title></rect>')
    return "\n".join([*parts, "</svg>"])


def parse_python_cell(text: Column, schema: str) -> Column:
    """A cell in Python's notation, which is JSON with single quotes."""
    return F.from_json(text, schema, {"allowSingleQuotes": "true"})


def district_list(text: Column) -> Column:
    """Districts of ``7:8``; X stands for unknown and gives null."""
    return F.when(F.upper(F.trim(text)) != "X", F.transform(F.split(text, ":"), lambda d: F.trim(d).try_cast("int")))


def to_json_text(row: dict) -> str:
    return json.dumps(row, ensure_ascii=False, sort_keys=True)
