"""Line dedup with a log-template tree of fixed depth.

A line's leaf is its token count and its first ``LEAD`` tokens, where a token
with a digit counts as a variable field. Within a leaf a token further right is
constant where it recurs at its position in at least ``MIN_DOCS`` documents; all
others are variable fields. A line whose constant tokens (leading ones included)
make up at least ``SIMILARITY`` of it has a template; tokens with a digit count
with them where a constant token holds a letter, so that short footers, dates and
page lines have one too. A line without any word has itself as its template. The
result doesn't depend on any order of the lines.

A template recurs where it is in ``MIN_DOCS`` documents. It is boilerplate, and
its lines are dropped from all documents, where it recurs in ``MIN_DOCS`` documents
with text of their own: those whose recurring lines hold at most ``COPY_SHARE`` of
their characters. So the text of copies, which recurs among copies only, stays and
is left to near-duplicate removal, while the boilerplate in copies, and in
documents made of little else, goes as everywhere.

Scale: a leaf in fewer than ``MIN_DOCS`` documents can't hold a recurring
template, so the first pass counts documents by a 64-bit leaf key, and a bitmap of
fixed size (see ``keep_likely``) ends nearly all lines of other leaves at the scan;
those that pass are harmless. Equal lines are one from there on: tokens are
counted over distinct lines, and only those of lines in fewer than ``MIN_DOCS``
documents once for each document. A 64-bit key of id and text stands for the
document, one of the line for the line. The text is joined once with the line
numbers to drop.

Nulls and edges: a null or empty text has no lines and stays as it is; blank
lines are never dropped. Rows count as one document by ``doc_id`` (null is one
document of its own), so repeated rows don't make a template recur. Lines
compare after trimming spaces; tokens are split at single spaces. A document that
is boilerplate throughout becomes an empty text. Extra columns pass through
``drop_recurring_lines`` unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import fresh, keep_likely, materialise

LEAD, MIN_DOCS, SIMILARITY, COPY_SHARE = 3, 5, 0.8, 0.6
VARIABLE = "<*>"
#: What a constant token must hold to make up for tokens with a digit.
WORDED = r"[\p{L}©]"


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, tk (hash of id and text), whole (characters in the text's lines), pos, line (trimmed, not blank), leaf."""
    whole = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    out = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("tk"), (F.length("text") - whole).alias("whole"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    out = out.withColumn("line", F.trim("line")).where(F.col("line") != "")
    n = F.length("line") - F.length(F.replace("line", F.lit(" "), F.lit("")))
    lead = F.regexp_replace(F.substring_index("line", " ", LEAD), r"\S*\d\S*", VARIABLE)
    return out.withColumn("leaf", F.xxhash64(n, lead))


def _n_docs(doc_id: str = "doc_id") -> Column:
    """Distinct documents; null counts as one."""
    return F.countDistinct(doc_id) + F.max(F.col(doc_id).isNull().cast("int"))


def _templates(kept: DataFrame) -> DataFrame:
    """lk, template of the lines (doc_id, lk, leaf, line) that have one."""
    lines = kept.groupBy("lk").agg(F.first("leaf").alias("leaf"), F.first("line").alias("line"))
    lines = materialise(lines.join(kept.groupBy("lk").agg((_n_docs() >= MIN_DOCS).alias("many")), "lk"))
    split = F.split("line", " ")
    rest = F.slice(split, F.lit(LEAD + 1), F.greatest(F.size(split) - LEAD, F.lit(0)))
    tokens = lines.select("lk", "many", "leaf", F.posexplode(rest).alias("at", "token")).where(~F.col("token").rlike(r"\d"))
    # the key's lowest bit tells whether the token is worded
    worded = F.when(F.col("token").rlike(WORDED), 1).otherwise(0).cast("long")
    tokens = tokens.select("lk", "many", F.shiftleft(F.xxhash64("leaf", "at", "token"), 1).bitwiseOR(worded).alias("key"))
    # a token of a line in many documents is constant; the others' are counted over their documents, which are few
    few = tokens.where("NOT many").join(kept.select("lk", "doc_id").distinct(), "lk").select("key", "doc_id", F.lit(False).alias("many"))
    counted = few.groupBy("key").agg(_n_docs().alias("n"), F.lit(False).alias("many"))
    constant = counted.unionByName(tokens.where("many").select("key", F.lit(0).cast("long").alias("n"), "many")).groupBy("key").agg(F.max((F.col("n") >= MIN_DOCS) | F.col("many")).alias("ok")).where("ok").select("key")
    # the template is the set of its constant tokens' keys, which hold leaf and position
    found = tokens.select("lk", "key").join(constant, "key", "left_semi").groupBy("lk")
    found = found.agg(F.countDistinct("key").alias("n_const"), F.max(F.col("key").bitwiseAND(F.lit(1))).alias("worded"), F.xxhash64(F.sort_array(F.collect_set("key"))).alias("template"))

    lead = F.slice(split, 1, LEAD)
    n_lead = F.aggregate(lead, F.lit(0), lambda a, t: a + F.when(t.rlike(r"\d"), 0).otherwise(1))
    is_word = lambda t: t.rlike(WORDED) & ~t.rlike(r"\d")
    # only a line without any word can recur word for word and have no template
    verbatim = F.when(~F.exists(split, is_word), F.xxhash64(split))
    bare = lines.select("lk", "leaf", F.size(split).alias("n_tokens"), F.regexp_count("line", F.lit(r"\d[^ ]*")).alias("n_digit"), n_lead.alias("n_lead"), F.exists(lead, is_word).alias("lead_worded"), verbatim.alias("verbatim"))
    n_const = F.col("n_lead") + F.coalesce("n_const", F.lit(0))
    enough = SIMILARITY * F.col("n_tokens")
    alike = (n_const >= enough) | ((n_const + F.col("n_digit") >= enough) & (F.col("lead_worded") | (F.coalesce("worded", F.lit(0)) > 0)))
    template = F.when(alike, F.xxhash64("leaf", F.coalesce("template", F.lit(0)))).otherwise(F.xxhash64("leaf", "verbatim", F.lit(1)))
    return bare.join(found, "lk", "left").where(alike | F.col("verbatim").isNotNull()).select("lk", template.alias("template"))


def recurring_lines(docs: DataFrame) -> DataFrame:
    """tk, pos and length of each line that is boilerplate."""
    lines = _lines(docs.select("doc_id", "text"))
    leaves = lines.groupBy("leaf").agg(_n_docs().alias("n")).where(F.col("n") >= MIN_DOCS).select("leaf")
    kept = materialise(keep_likely(lines, "leaf", leaves).withColumn("lk", F.xxhash64("line")))
    hits = kept.select("doc_id", "tk", "pos", "whole", F.length("line").alias("len"), "lk").join(_templates(kept.select("doc_id", "lk", "leaf", "line")), "lk").drop("lk")
    hits = materialise(hits)
    recurs = lambda rows: rows.groupBy("template").agg(_n_docs().alias("n")).where(F.col("n") >= MIN_DOCS).select("template")
    hits = hits.join(recurs(hits), "template", "left_semi")
    # rows that repeat id and text have equal lines; a document's lines come together once
    hits = hits.repartition("tk").groupBy("tk", "pos").agg(*(F.first(c).alias(c) for c in ("doc_id", "whole", "len", "template")))
    lost = F.sum("len").over(Window.partitionBy("tk"))
    hits = materialise(hits.select("doc_id", "tk", "pos", "len", "template", (lost <= COPY_SHARE * F.col("whole")).alias("own")))
    return hits.join(recurs(hits.where("own")), "template", "left_semi").select("tk", "pos", "len")


def _with_drops(docs: DataFrame, drop: str, n_lines: str, lost: str, text: str) -> DataFrame:
    """docs with the line numbers to drop, counts, and the text that is left."""
    key = fresh(docs, "tk")
    drops = recurring_lines(docs).groupBy("tk").agg(F.sort_array(F.collect_list("pos")).alias(drop), F.sum("len").alias(lost))
    drops = drops.withColumnRenamed("tk", key)
    out = docs.join(drops, F.xxhash64(docs.doc_id, docs.text) == drops[key], "left").drop(key)
    out = out.withColumn(lost, F.coalesce(lost, F.lit(0)).cast("long"))
    out = out.withColumn(n_lines, F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains(F.col(drop), i)), "\n")
    return out.withColumn(text, F.when(F.col(drop).isNull(), F.col("text")).otherwise(left))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """docs without the lines of recurring templates; ``n_chars``, where there is
    such a column, is counted anew for the documents that change. A document
    of which nothing but blank lines is left stays as an empty text."""
    names = {n: fresh(docs, n) for n in ("drop", "n", "lost", "text")}
    out = _with_drops(docs, names["drop"], names["n"], names["lost"], names["text"])
    cols = []
    for c in docs.columns:
        if c == "text":
            cols.append(F.col(names["text"]).alias("text"))
        elif c == "n_chars":
            cols.append(F.when(F.col(names["n"]) > 0, F.length(names["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars"))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: the number of lines dropped, their characters, the text that is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = _with_drops(docs, "dropped", "n_dropped", "recurring_chars", "kept_text")
    return out.select("doc_id", "n_dropped", "recurring_chars", F.col("kept_text").alias("text"))


SQL = {
    "op7_line_dedup": rf"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
, lines AS (SELECT DISTINCT doc_id, text, pos, trim(line, ' ') AS line, string_split(trim(line, ' '), ' ') AS tokens FROM raw WHERE trim(line, ' ') <> '')
, keyed AS (SELECT *, len(tokens) AS n, len(list_filter(tokens, lambda t: regexp_matches(t, '\d'))) AS n_digit,
    len(list_filter(tokens, lambda t: regexp_matches(t, '{WORDED}') AND NOT regexp_matches(t, '\d'))) > 0 AS has_word,
    list_transform(tokens[1:{LEAD}], lambda t: CASE WHEN regexp_matches(t, '\d') THEN '{VARIABLE}' ELSE t END) AS lead FROM lines)
, leaves AS (SELECT n, lead FROM keyed GROUP BY n, lead HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= {MIN_DOCS})
, kept AS (SELECT keyed.* FROM keyed SEMI JOIN leaves USING (n, lead))
, tok AS (SELECT doc_id, text, pos, n, lead, unnest(tokens[{LEAD + 1}:]) AS token, unnest(range(greatest(n - {LEAD}, 0))) AS place FROM kept)
, word AS (SELECT * FROM tok WHERE NOT regexp_matches(token, '\d'))
, constant AS (SELECT n, lead, place, token FROM word GROUP BY ALL HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= {MIN_DOCS})
, found AS (SELECT doc_id, text, pos, count(*) AS n_const, bool_or(regexp_matches(token, '{WORDED}')) AS worded, list((place, token) ORDER BY place) AS template FROM word SEMI JOIN constant USING (n, lead, place, token) GROUP BY ALL)
, l AS (SELECT k.*, length(k.line) AS len, f.template, len(list_filter(k.lead, lambda t: t <> '{VARIABLE}')) + coalesce(f.n_const, 0) AS n_const,
    coalesce(f.worded, false) OR len(list_filter(k.lead, lambda t: t <> '{VARIABLE}' AND regexp_matches(t, '{WORDED}'))) > 0 AS worded
    FROM kept k LEFT JOIN found f ON k.doc_id IS NOT DISTINCT FROM f.doc_id AND k.text = f.text AND k.pos = f.pos)
, alike AS (SELECT *, n_const >= {SIMILARITY} * n OR (n_const + n_digit >= {SIMILARITY} * n AND worded) AS is_alike FROM l)
, t AS (SELECT doc_id, text, pos, len, n, lead, CASE WHEN is_alike THEN template END AS template, CASE WHEN NOT is_alike THEN line END AS verbatim FROM alike WHERE is_alike OR NOT has_word)
, hits AS (SELECT *, count(DISTINCT doc_id) OVER w + max(CAST(doc_id IS NULL AS INT)) OVER w AS d FROM t WINDOW w AS (PARTITION BY n, lead, template, verbatim))
, h AS (SELECT *, sum(len) OVER (PARTITION BY doc_id, text) <= {COPY_SHARE} * length(replace(text, chr(10), '')) AS own FROM hits WHERE d >= {MIN_DOCS})
, sure AS (SELECT n, lead, template, verbatim FROM h WHERE own GROUP BY ALL HAVING count(DISTINCT doc_id) + max(CAST(doc_id IS NULL AS INT)) >= {MIN_DOCS})
, drops AS (SELECT h.doc_id, h.text, list(h.pos) AS dropped, sum(h.len) AS lost FROM h JOIN sure s ON h.n = s.n AND h.lead = s.lead AND h.template IS NOT DISTINCT FROM s.template AND h.verbatim IS NOT DISTINCT FROM s.verbatim GROUP BY h.doc_id, h.text)
, judged AS (SELECT documents.doc_id, documents.text, dropped, coalesce(lost, 0) AS lost
    FROM documents LEFT JOIN drops ON documents.doc_id IS NOT DISTINCT FROM drops.doc_id AND documents.text = drops.text)
SELECT doc_id, CAST(coalesce(len(dropped), 0) AS INTEGER) AS n_dropped, CAST(lost AS BIGINT) AS recurring_chars,
    CASE WHEN dropped IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(dropped, i - 1)), lambda i: string_split(text, chr(10))[i]), chr(10)) END AS text
FROM judged""",
}
QUERIES = {"op7_line_dedup": op7_line_dedup}
