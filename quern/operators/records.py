"""People records: parsing, validation, dead letters, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import looks_like_date, nfkc, parse_date, split_name, split_name_last, upper_trimmed

UNKNOWN_DATE = "UNBEKANNT"


def dead_letters(df: DataFrame, checks: dict[str, Column], kind: str = "validation_error") -> tuple[DataFrame, DataFrame]:
    """Rows that pass, and rows that fail as (record, error, error_type); ``error``
    is the name of the first check that isn't true."""
    error = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))
    marked = df.withColumn("_error", error)
    failed = marked.where("_error IS NOT NULL").select(F.to_json(F.struct(*df.columns)).alias("record"), F.col("_error").alias("error"), F.lit(kind).alias("error_type"))
    return marked.where("_error IS NULL").drop("_error"), failed


def people(df: DataFrame, name: str = "name", birthdate: str = "birthdate", country: str = "country", nickname: str = "nickname") -> tuple[DataFrame, DataFrame]:
    """Valid people and dead letters.

    A name is split into surname and given names, a date must be ``d.M.yyyy`` or
    the sentinel and is written with leading zeros, a country is in capitals. A
    null name or country is a processing error, a bad date or a name without
    surname a validation error.
    """
    parsed = df.select(
        F.struct(*df.columns).alias("record"), split_name(nfkc(F.col(name))).alias("n"), parse_date(F.trim(birthdate)).alias("birthdate"),
        upper_trimmed(F.col(country)).alias("nationality"), F.coalesce(nickname, F.lit("")).alias("nickname"), (F.col(name).isNull() | F.col(country).isNull()).alias("broken"),
    )
    no_surname = F.coalesce(F.col("n.surname"), F.lit("")) == ""
    error = F.when(F.col("broken"), "processing_error").when(F.col("birthdate").isNull() | no_surname, "validation_error")
    reason = F.when(F.col("broken"), "missing value").when(F.col("birthdate").isNull(), "invalid date").when(no_surname, "no surname")
    marked = parsed.withColumn("error_type", error).withColumn("error", reason)
    valid = marked.where("error_type IS NULL").select(F.col("n.surname").alias("surname"), F.col("n.given").alias("given_names"), "birthdate", "nationality", "nickname", F.to_json("record").alias("additional_info"))
    return valid, marked.where("error_type IS NOT NULL").select(F.to_json("record").alias("record"), "error", "error_type")


def people_simple(df: DataFrame, name: str = "name", birthdate: str = "birthdate", country: str = "country") -> DataFrame:
    """The older form: the name around its last space, and a date only checked for its shape (the sentinel is invalid)."""
    n = split_name_last(F.col(name))
    return df.select(n["first"].alias("first_name"), n["last"].alias("last_name"), birthdate, country, looks_like_date(F.col(birthdate)).alias("valid"))


def people_statistics(valid: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: total, errors, by_nationality and by_birth_year (maps of counts; unknown years aside)."""

    def counts(df: DataFrame, key: Column, name: str) -> DataFrame:
        by = df.select(key.alias("k")).where("k IS NOT NULL").groupBy("k").agg(F.count("*").alias("n"))
        return by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(name))

    year = F.when(F.col("birthdate") != UNKNOWN_DATE, F.element_at(F.split("birthdate", r"\."), -1))
    n_valid, n_errors = valid.agg(F.count("*").alias("valid")), errors.agg(F.count("*").alias("errors"))
    out = n_valid.crossJoin(n_errors).crossJoin(counts(valid, F.col("nationality"), "by_nationality")).crossJoin(counts(valid, year, "by_birth_year"))
    return out.select((F.col("valid") + F.col("errors")).alias("total"), "errors", "by_nationality", "by_birth_year")
