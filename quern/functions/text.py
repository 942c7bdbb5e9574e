"""Column functions on text. All are null for null unless stated.

Regex dialects: Java's ``\\w \\d \\s \\b`` only know ASCII, so every pattern that
meets names in other alphabets carries ``(?U)``.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def contains_pattern(c: Column, pattern: str) -> Column:
    """Case-insensitive regex search; null counts as no match."""
    return F.coalesce(c.rlike("(?iu)" + pattern), F.lit(False))


def contains_text(c: Column, part: str) -> Column:
    """Case-insensitive search of a fixed text."""
    return F.contains(F.lower(c), F.lit(part.lower()))


def normalise_name(c: Column) -> Column:
    """Lower case without possessive endings and parenthesised remarks, blanks collapsed."""
    out = F.replace(F.lower(c), F.lit("'s"), F.lit(""))
    out = F.regexp_replace(out, r"(?U)\s+\(.*?\)", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC of the stripped text; the JVM's functions have none."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t.strip()))


@F.pandas_udf(T.StringType())
def title_case(s: pd.Series) -> pd.Series:
    """A capital after every character that isn't a letter, unlike ``initcap``."""
    return s.map(lambda t: None if t is None else t.title())


def is_upper(c: Column) -> Column:
    """Has a cased character and no lower-case one."""
    return (c == F.upper(c)) & (c != F.lower(c))


def split_name(c: Column) -> Column:
    """struct(surname, given): upper-case or hyphenated words are the surname, all others given names."""
    words = F.filter(F.split(F.trim(c), r"(?U)\s+"), lambda w: w != "")
    family = lambda w: is_upper(w) | F.contains(w, F.lit("-"))
    return F.struct(F.array_join(F.filter(words, family), " ").alias("surname"), F.filter(words, lambda w: ~family(w)).alias("given"))


def split_name_last(c: Column) -> Column:
    """struct(first, last) around the last space, an opening parenthesis stripped, in title case; one word is the first name."""
    head = F.when(F.contains(c, F.lit(" ")), F.regexp_extract(c, "(?s)^(.*) ([^ ]*)$", 1)).otherwise(c)
    tail = F.when(F.contains(c, F.lit(" ")), F.regexp_extract(c, "(?s)^(.*) ([^ ]*)$", 2)).otherwise(F.lit(""))
    return F.struct(title_case(F.ltrim(head, F.lit("("))).alias("first"), title_case(F.ltrim(tail, F.lit("("))).alias("last"))


def parse_date(c: Column, sentinel: str = "UNBEKANNT") -> Column:
    """``d.M.yyyy`` written with leading zeros; the sentinel as it is; null where it is neither."""
    return F.when(c == sentinel, c).otherwise(F.date_format(F.try_to_date(c, "d.M.yyyy"), "dd.MM.yyyy"))


def looks_like_date(c: Column) -> Column:
    """Digits in the places of a date, whatever their values; the sentinel isn't one."""
    return F.coalesce(c.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.lit(False))


def date_precision(c: Column) -> Column:
    """day, month or year for full and partial ISO dates, null for anything else."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(c.rlike(r"^\d{4}-\d{2}$"), "month").when(c.rlike(r"^\d{4}$"), "year")


def upper_trimmed(c: Column) -> Column:
    return F.upper(F.trim(c))


def safe_filename(c: Column, ending: str = ".pdf", most: int = 150) -> Column:
    return F.concat(F.substring(F.regexp_replace(c, r'[<>:"/\\|?*]', "_"), 1, most), F.lit(ending))


def human_size(n: Column) -> Column:
    """Bytes in steps of 1024 up to TB, with one decimal; a tie goes to the even digit, as in C and Python."""
    shown = lambda power, unit: F.concat(F.format_string("%.1f", F.bround(n / F.lit(1024.0**power), 1)), F.lit(f" {unit}"))
    out = shown(4, "TB")
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < 1024.0 ** (power + 1), shown(power, unit)).otherwise(out)
    return F.when(n.isNotNull(), out)


def human_time(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    minutes, hours = F.floor(s / 60), F.floor(s / 3600)
    return (
        F.when(s < 60, F.format_string("%ds", s))
        .when(s < 3600, F.format_string("%dm %ds", minutes, F.pmod(s, F.lit(60))))
        .when(s.isNotNull(), F.format_string("%dh %dm", hours, F.floor(F.pmod(s, F.lit(3600)) / 60)))
    )


def parse_query_list(c: Column, aliases: dict[str, str]) -> Column:
    """Items of a bracketed, quoted, comma-separated list: trimmed, lower case, aliases resolved, empty ones gone."""
    items = F.transform(F.split(F.regexp_replace(c, r"""[\[\]"']""", ""), ","), lambda x: F.lower(F.trim(x)))
    known = F.create_map(*(F.lit(x) for kv in aliases.items() for x in kv))
    return F.filter(F.transform(items, lambda x: F.coalesce(F.try_element_at(known, x), x)), lambda x: x != "")


def length_and_letters(c: Column, length: float, letters: list[str]) -> Column:
    """Length within the whole numbers around ``length``, and every letter contained."""
    n = F.char_length(c)
    return n.between(F.floor(F.lit(length)), F.ceil(F.lit(length))) & F.forall(F.array(*map(F.lit, letters)), lambda x: F.contains(c, x))


def clean_newspaper_row(fields: Column) -> Column:
    """Six fields from a ragged row: date, names, place, description, tags, empty.

    Missing fields are empty, those past the fifth are dropped. A date without a
    comma gets one before its year. Names are joined by `` & ``. In the
    description double quotes become single ones, a blank follows , ; and . and
    blanks are collapsed. Tags are trimmed.
    """
    f = lambda i: F.coalesce(F.try_element_at(fields, F.lit(i)), F.lit(""))
    # what follows the year is lost where the comma is put in
    found = F.regexp_extract(f(1), r"(?U)^(\w+ \d+) (\d{4})", 0) != ""
    date = F.when(~F.contains(f(1), F.lit(",")) & found, F.concat(F.regexp_extract(f(1), r"(?U)^(\w+ \d+) (\d{4})", 1), F.lit(", "), F.regexp_extract(f(1), r"(?U)^(\w+ \d+) (\d{4})", 2))).otherwise(f(1))
    names = F.regexp_replace(f(2), r"(?U)\s*;\s*", " & ")
    text = F.regexp_replace(F.regexp_replace(F.replace(f(4), F.lit('"'), F.lit("'")), r"(?U)([,;.])(?=\S)", "$1 "), r"(?U)\s+", " ")
    tags = F.array_join(F.transform(F.split(f(5), ";"), lambda t: F.trim(t)), ";")
    return F.array(date, names, f(3), F.trim(text), tags, F.lit(""))


def sentence_set(c: Column) -> Column:
    """Distinct stripped sentences in the order of their characters."""
    parts = F.transform(F.split(c, "[.!?]+"), lambda s: F.trim(s))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda s: s != "")))


def join_sentences(sentences: Column) -> Column:
    return F.when(F.size(sentences) > 0, F.concat(F.array_join(sentences, ". "), F.lit("."))).otherwise(F.lit(""))


def years_mentioned(c: Column) -> Column:
    """Years and centuries in a text, such as ``1847`` and ``19th Century``."""
    return F.regexp_extract_all(c, F.lit(r"(\d{2}th Century|\d{4})"), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets of items; two empty sets are equal."""
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / either)


def tag_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(c), ";"), lambda t: F.trim(t)), lambda t: t != ""))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 for equal texts, 0 for texts of which no character can stay."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)
