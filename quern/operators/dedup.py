"""Entity dedup: groups of equal names and their merge, fuzzy row pairs, set-similarity pairs."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import jaccard, join_sentences, normalise_name, sentence_set, tag_set, years_mentioned

#: Weights of a row's fields in its similarity to another.
WEIGHTS = {"date": 0.3, "names": 0.3, "location": 0.2, "description": 0.1, "tags": 0.1}
THRESHOLD = 0.85
NOT_SPECIFIED = "Not specified"


def duplicate_groups(df: DataFrame, norm: Column, idx: str) -> DataFrame:
    """norm, members (ascending) of every normalised value with more than one row."""
    out = df.select(norm.alias("norm"), idx).groupBy("norm").agg(F.sort_array(F.collect_list(idx)).alias("members"))
    return out.where(F.size("members") > 1)


def merged_years(years: Column) -> Column:
    """Distinct years and centuries of a list of texts: years first, then centuries, joined; none gives the sentinel."""
    found = F.array_distinct(F.flatten(F.transform(F.filter(years, lambda y: y.isNotNull() & (y != NOT_SPECIFIED)), years_mentioned)))
    ordered = F.array_sort(F.transform(found, lambda y: F.struct(F.length(y).alias("n"), y.alias("y"))))
    joined = F.array_join(F.transform(ordered, lambda s: s["y"]), ", ")
    return F.when(joined == "", F.lit(NOT_SPECIFIED)).otherwise(joined)


def merged_sentences(texts: Column) -> Column:
    """One text as it is; of more the distinct sentences in the order of their characters."""
    full = F.filter(texts, lambda t: t.isNotNull() & (F.trim(t) != ""))
    sentences = F.array_sort(F.array_distinct(F.flatten(F.transform(full, sentence_set))))
    return F.when(F.size(full) < 2, F.coalesce(F.try_element_at(full, F.lit(1)), F.lit(""))).otherwise(join_sentences(sentences))


def merge_duplicates(df: DataFrame, norm: Column, idx: str, years: str, text: str, flag: str) -> DataFrame:
    """One row for each normalised value. A single row stays as it is. Of several the
    one with most values that aren't null is the base (ties: the first); years and
    sentences are united and the flag is ``Yes`` if one is."""
    others = [c for c in df.columns if c != idx]
    filled = sum((F.col(c).isNotNull().cast("int") for c in others), F.lit(0))
    rows = df.withColumn("_norm", norm).withColumn("_row", F.struct(*df.columns))
    by_idx = lambda c: F.transform(F.sort_array(F.collect_list(F.struct(idx, c))), lambda s: s[c])
    out = rows.groupBy("_norm").agg(
        F.max_by("_row", F.struct(filled, -F.col(idx))).alias("_base"), F.count("*").alias("_n"),
        by_idx(years).alias("_years"), by_idx(text).alias("_texts"), F.max((F.col(flag) == "Yes").cast("int")).alias("_yes"),
    )
    one = F.col("_n") == 1

    def column(c: str) -> Column:
        base = F.col("_base")[c]
        if c == years:
            return F.when(one, base).otherwise(merged_years(F.col("_years")))
        if c == text:
            return F.when(one, base).otherwise(merged_sentences(F.col("_texts")))
        if c == flag:
            return F.when(one | (F.coalesce(F.col("_yes"), F.lit(0)) == 0), base).otherwise(F.lit("Yes"))
        return base

    return out.select(*(column(c).alias(c) for c in df.columns))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts; not symmetric, so call it with the earlier row first. Null for null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


_DATE = r"(?U)\b\w+ \d+,? \d{4}\b"


def _bound(a: Column, b: Column) -> Column:
    """The ratio can't be greater than this."""
    both = F.length(a) + F.length(b)
    return F.when(both == 0, 1.0).otherwise(2.0 * F.least(F.length(a), F.length(b)) / both)


def similar_rows(df: DataFrame, idx: str, threshold: float = THRESHOLD) -> DataFrame:
    """i, j, similarity of row pairs i < j of at least the threshold.

    The condition of the join already holds an upper bound of the similarity,
    made of text lengths and the exact share of common tags, so the text
    comparison in Python only sees pairs that could qualify; none is lost. A
    pair that can't be compared (null field) is left out.
    """

    def side(p: str) -> DataFrame:
        date = F.regexp_extract("date", _DATE, 0)
        return df.select(F.col(idx).alias(p), F.col("date").alias(f"{p}_raw"), date.alias(f"{p}_date"), *(F.lower(c).alias(f"{p}_{c}") for c in ("names", "location", "description")), tag_set(F.col("tags")).alias(f"{p}_tags"))

    c = F.col
    both_dates = (c("i_date") != "") & (c("j_date") != "")
    dates = [F.when(both_dates, c(f"{p}_date")).otherwise(c(f"{p}_raw")) for p in "ij"]
    tags = jaccard(c("i_tags"), c("j_tags")) * WEIGHTS["tags"]
    bound = tags + _bound(*dates) * WEIGHTS["date"]
    for f in ("names", "location", "description"):
        bound = bound + _bound(c(f"i_{f}"), c(f"j_{f}")) * WEIGHTS[f]
    pairs = side("i").join(side("j"), (c("i") < c("j")) & (bound >= threshold - 1e-9))
    total = tags + sequence_ratio(*dates) * WEIGHTS["date"]
    for f in ("names", "location", "description"):
        total = total + sequence_ratio(c(f"i_{f}"), c(f"j_{f}")) * WEIGHTS[f]
    return pairs.select("i", "j", total.alias("similarity")).where(c("similarity") >= threshold)


def keep_first(df: DataFrame, pairs: DataFrame, idx: str) -> DataFrame:
    """Rows that aren't the second of a pair; also a row whose own first goes is removed."""
    return df.join(pairs.select(F.col("j").alias(idx)).distinct(), idx, "left_anti")


def set_similar_pairs(df: DataFrame, idx: str, items: str, threshold: float) -> DataFrame:
    """i, j, jaccard of rows i < j whose item sets have at least this Jaccard similarity; exact.

    Prefix filter: with items in one order, rarest first, two sets so similar
    share an item among the first ``n - ceil(threshold * n) + 1`` of each, so only
    these are join keys, and frequent items are keys of few rows. Empty sets pair
    with nothing.
    """
    rows = df.select(F.col(idx).alias("id"), F.array_distinct(items).alias("set")).where(F.size("set") > 0)
    item = rows.select("id", F.size("set").alias("n"), F.explode("set").alias("item")).where(F.col("item").isNotNull())
    ranked = item.join(item.groupBy("item").agg(F.count("*").alias("df")), "item")
    place = F.row_number().over(Window.partitionBy("id").orderBy("df", "item"))
    keys = ranked.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("id", "n", "item")
    a, b = keys.select(F.col("id").alias("i"), F.col("n").alias("ni"), "item"), keys.select(F.col("id").alias("j"), F.col("n").alias("nj"), "item")
    near = a.join(b, "item").where((F.col("i") < F.col("j")) & (F.least("ni", "nj") >= threshold * F.greatest("ni", "nj") - 1e-9)).select("i", "j").distinct()
    out = near.join(rows.select(F.col("id").alias("i"), F.col("set").alias("x")), "i").join(rows.select(F.col("id").alias("j"), F.col("set").alias("y")), "j")
    return out.select("i", "j", jaccard(F.col("x"), F.col("y")).alias("jaccard")).where(F.col("jaccard") >= threshold)


def edit_search(df: DataFrame, column: str, wanted: str, most: float = 0.3) -> DataFrame:
    """Rows whose text is within ``most`` of the wanted one, as edits over the longer length, with the score.

    The lengths alone already rule most rows out before the edit distance is computed.
    """
    a, b = F.lower(column), F.lit(wanted.lower())
    longest = F.greatest(F.length(a), F.length(b))
    near = df.where(F.abs(F.length(a) - F.length(b)) <= most * longest)
    return near.withColumn("score", F.levenshtein(a, b) / longest).where(F.col("score") <= most)


def lookup(df: DataFrame, key: str, mapping: dict[str, str], default: str, name: str) -> DataFrame:
    """Category of a key, or the default. The mapping is a literal, so no join is needed."""
    known = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv))
    return df.withColumn(name, F.coalesce(F.try_element_at(known, F.col(key)), F.lit(default)))


def members(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return df.join(others.select(key).distinct(), key, "left_semi")


def not_members(df: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return df.join(others.select(key).distinct(), key, "left_anti")


def link_by_street(directory: DataFrame, address: str, streets: DataFrame, street: str) -> DataFrame:
    """directory with street, number and the other columns of its street, null where none has the name.

    Both names are normalised, and an address is cut at its trailing number. The
    table of streets should name each once; of equal names each gives a row."""
    text = F.trim(address)
    number = F.regexp_extract(text, r"(\d+)$", 1)
    left = directory.withColumn("number", number.try_cast("int")).withColumn("_name", normalise_name(F.regexp_replace(text, r"\s*\d+$", "")))
    right = streets.withColumn("_name", normalise_name(F.col(street))).drop(street)
    return left.join(right, "_name", "left").withColumnRenamed("_name", "street")
