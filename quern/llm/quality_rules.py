"""Quality rules: Jensen-Shannon distance of a document's character-class and
common-word histograms to those of its language.

The language references are the summed histograms of *all* documents of that
language: one aggregate with a handful of rows, whatever the input. Everything
else is a projection over the scan, so the text is never shuffled.

Nulls and edges: a null, empty or blank text has no histogram and is rejected.
Documents under ``min_chars`` are never rejected by the character rule, those
under ``min_words`` never by the word rule. A language without a word list
has a reference of its own from ``MIN_LANG_DOCS`` documents on, and the words that
are most frequent in them as its list. Below that, and without a language (null),
documents share the references ``other``, one for each script, by characters only.
``SQL`` has one reference for all of these; the given tables have no such language.
Repeated rows are judged one by one and alike; extra columns are ignored by
``quality_scores`` and kept as they are by ``keep_quality``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import prefix

#: Frequent function words by language; the words are fixed, their shares come from the corpus.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "with", "on"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "du", "que", "dans"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por"],
}
MIN_CHARS, MIN_WORDS = 200, 60
MAX_JS_CHARS, MAX_JS_WORDS = 0.25, 0.27

#: Documents from which a language without a word list is judged by itself.
MIN_LANG_DOCS = 20
#: Scripts without case, by the first such letter of a document in which they prevail.
_SCRIPTS = {"han": r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]", **{x.lower(): rf"\p{{Is{x}}}" for x in ("Arabic", "Hebrew", "Devanagari", "Bengali", "Tamil", "Thai", "Hangul")}}
_N = 12


def own_languages(docs: DataFrame) -> dict[str, list[str]]:
    """Languages without a word list in ``MIN_LANG_DOCS`` documents or more, with their most frequent words."""
    rest = docs.where(~F.col("lang").isin(*COMMON_WORDS))
    found = sorted(r[0] for r in rest.groupBy("lang").count().where(F.col("count") >= MIN_LANG_DOCS).collect())
    if not found:
        return {}
    words = rest.where(F.col("lang").isin(*found)).select("lang", F.explode(F.regexp_extract_all("text", F.lit(r"\p{L}+"), F.lit(0))).alias("word"))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "word")
    top = words.groupBy("lang", "word").count().withColumn("k", F.row_number().over(order)).where(F.col("k") <= _N).orderBy("lang", "k").collect()
    return {x: [r["word"] for r in top if r["lang"] == x] for x in found}


def _language(text: Column, lang: Column, own: dict[str, list[str]]) -> Column:
    out = F.when(lang.isin(*COMMON_WORDS), lang)
    for i, code in enumerate(own):
        out = out.when(lang == code, F.lit(f"own{i}"))
    out = out.when(F.regexp_count(text, F.lit(r"\p{Lo}")) <= F.regexp_count(text, F.lit(r"[\p{Lu}\p{Ll}]")), "other")
    for name, letters in _SCRIPTS.items():
        out = out.when(F.regexp_extract(text, r"\p{Lo}", 0).rlike(letters), f"other {name}")
    return out.otherwise("other")


def _counted(docs: DataFrame, text: str, lang: str, at: str, own: dict[str, list[str]]) -> DataFrame:
    """docs with the columns <at>language, <at>c0-5 (character classes) and
    <at>w0-12 (the language's common words, then all other words)."""
    lists = COMMON_WORDS | {f"own{i}": ws for i, ws in enumerate(own.values())}
    all_words = sorted({w for ws in lists.values() for w in ws}, key=lambda w: (-len(w), w))
    common = r"(?<!\p{L})(?:" + "|".join(all_words) + r")(?!\p{L})"
    names = [f"{at}t{i}" for i in range(5)]
    # each pattern removes a class, so that the next one has less to read
    shrink = [r"[\p{Ll}]+", r"\s+", r"[\p{L}]+", r"[\p{Nd}]+", r"""[.,;:?!'"()-]+"""]
    out = docs.select("*", F.coalesce(F.col(text), F.lit("")).alias(f"{at}t"), _language(F.col(text), F.col(lang), own).alias(f"{at}language"))
    for before, name, pattern in zip([f"{at}t", *names], names, shrink):
        out = out.select("*", F.regexp_replace(before, pattern, "").alias(name))
    # SQL text from here on: hundreds of Column objects would take the driver seconds to build
    lengths = [f"length({at}t)", *(f"length({x})" for x in names)]
    chars = [*(f"{a} - {b}" for a, b in zip(lengths, lengths[1:])), lengths[-1]]
    # the common words one after another, each between two spaces
    hits = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(f"{at}t", F.lit(common), F.lit(0)), "  "), F.lit(" "))
    out = out.select(*docs.columns, f"{at}language", F.regexp_count(f"{at}t", F.lit(r"\p{L}+")).alias(f"{at}n"), hits.alias(f"{at}hits"), *(F.expr(c).alias(f"{at}c{i}") for i, c in enumerate(chars)))
    gone = lambda w: f"CAST((length({at}hits) - length(replace({at}hits, ' {w} ', ''))) / {len(w) + 2} AS INT)"
    words = [f"CASE {at}language {' '.join(f"WHEN '{code}' THEN {gone(ws[k])}" for code, ws in lists.items() if k < len(ws))} ELSE 0 END" for k in range(_N)]
    out = out.select(*(c for c in out.columns if c != f"{at}hits"), *(F.expr(w).alias(f"{at}w{k}") for k, w in enumerate(words)))
    return out.select("*", F.expr(f"{at}n - ({' + '.join(f'{at}w{k}' for k in range(_N))})").alias(f"{at}w{_N}"))


def js_distance(p: Column, total_p: Column, q: Column, total_q: Column) -> Column:
    """Square root of the base-2 Jensen-Shannon divergence of two arrays of
    counts with their totals; an empty histogram has no share anywhere."""

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(F.lit(2.0) * a / (a + b))).otherwise(F.lit(0.0))

    shares = lambda xs, total: F.transform(xs, lambda x: F.when(total > 0, x / total).otherwise(F.lit(0.0)))
    parts = F.zip_with(shares(p, total_p), shares(q, total_q), lambda a, b: term(a, b) + term(b, a))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / 2, F.lit(0.0)))


def language_references(docs: DataFrame, own: dict[str, list[str]], at: str = "_q_") -> DataFrame:
    """Summed histograms by language and their totals: at most one row per word list and one per script for all the rest."""
    counted = _counted(docs.select(F.col("text").alias(f"{at}text"), F.col("lang").alias(f"{at}lang")), f"{at}text", f"{at}lang", at, own)
    sums = {kind: ", ".join(f"sum(CAST({at}{kind}{i} AS BIGINT))" for i in range(n)) for kind, n in (("c", 6), ("w", _N + 1))}
    out = counted.groupBy(f"{at}language").agg(*(F.expr(f"array({cols})").alias(f"{at}{kind}_ref") for kind, cols in sums.items()))
    return out.select("*", *(F.expr(f"aggregate({at}{kind}_ref, 0L, (s, x) -> s + x)").alias(f"{at}{kind}_all") for kind in sums))


def _judged(docs: DataFrame, at: str) -> DataFrame:
    """docs with <at>n (words), <at>js_chars, <at>js_words, <at>keep."""
    c = lambda name: F.col(f"{at}{name}")
    own = own_languages(docs.select("lang", "text"))
    out = _counted(docs, "text", "lang", at, own)
    chars, words = ([f"{at}{kind}{i}" for i in range(n)] for kind, n in (("c", 6), ("w", _N + 1)))
    out = out.select(*docs.columns, c("language"), c("n"), c("c1"), F.expr(" + ".join(chars)).alias(f"{at}len"), F.array(*chars).alias(f"{at}c"), F.array(*words).alias(f"{at}w"))
    # a row per language and script
    out = out.join(F.broadcast(language_references(docs, own, at)), f"{at}language")
    js_chars, js_words = js_distance(c("c"), c("len"), c("c_ref"), c("c_all")), js_distance(c("w"), c("n"), c("w_ref"), c("w_all"))
    out = out.select(*docs.columns, c("language"), c("n"), c("c1"), c("len"), F.round(js_chars, 6).alias(f"{at}js_chars"), F.round(js_words, 6).alias(f"{at}js_words"))
    off_chars = (c("len") >= MIN_CHARS) & (c("js_chars") > MAX_JS_CHARS)
    off_words = (c("n") >= MIN_WORDS) & ~c("language").startswith("other") & (c("js_words") > MAX_JS_WORDS)
    # one CASE: conjuncts would be pushed under the join one by one, each with a copy of all the patterns above
    return out.select("*", F.when(c("len") <= c("c1"), False).when(off_chars, False).when(off_words, False).otherwise(True).alias(f"{at}keep"))


def quality_scores(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, lang, n_words, js_chars, js_words, keep."""
    out = _judged(docs.select("doc_id", "lang", "text"), "_q_")
    return out.select("doc_id", "lang", F.col("_q_n").alias("n_words"), F.col("_q_js_chars").alias("js_chars"), F.col("_q_js_words").alias("js_words"), F.col("_q_keep").alias("keep"))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = prefix(docs)
    return _judged(docs, at).where(F.col(f"{at}keep")).select(*docs.columns)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    langs = ", ".join(f"'{x}'" for x in COMMON_WORDS)
    lists = " ".join(f"WHEN '{code}' THEN [{', '.join(repr(w) for w in ws)}]" for code, ws in COMMON_WORDS.items())
    steps, last = [], "t"
    for i, p in enumerate([r"[\p{Ll}]+", r"[\t\n\v\f\r ]+", r"[\p{L}]+", r"[\p{Nd}]+", r"""[.,;:?!''"()-]+"""]):
        steps.append(f"regexp_replace({last}, '{p}', '', 'g') AS t{i}")
        last = f"t{i}"
    nested = "\n".join(f", s{i} AS (SELECT *, {s} FROM {'base' if i == 0 else f's{i - 1}'})" for i, s in enumerate(steps))
    js = lambda p, q: f"round(sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), lambda i: (CASE WHEN {p}[i] > 0 THEN {p}[i] * log2(2.0 * {p}[i] / ({p}[i] + {q}[i])) ELSE 0 END) + (CASE WHEN {q}[i] > 0 THEN {q}[i] * log2(2.0 * {q}[i] / ({p}[i] + {q}[i])) ELSE 0 END))) / 2, 0)), 6)"
    share = lambda x: f"list_transform({x}, lambda v: CASE WHEN list_sum({x}) > 0 THEN v / CAST(list_sum({x}) AS DOUBLE) ELSE 0.0 END)"
    return rf"""
WITH base AS (SELECT doc_id, lang, coalesce(text, '') AS t,
    CASE WHEN lang IN ({langs}) THEN lang ELSE 'other' END AS language FROM documents)
{nested}
, h0 AS (SELECT doc_id, lang, language,
    [length(t)-length(t0), length(t0)-length(t1), length(t1)-length(t2), length(t2)-length(t3), length(t3)-length(t4), length(t4)] AS c,
    regexp_extract_all(t, '\p{{L}}+') AS ws, CASE language {lists} ELSE [] END AS common FROM s4)
, h1 AS (SELECT * EXCLUDE (ws, common), len(ws) AS n_words,
    list_transform(range(1, {_N + 1}), lambda k: len(list_filter(ws, lambda x: x = common[k]))) AS counts FROM h0)
, h AS (SELECT *, list_concat(counts, [CAST(n_words - list_sum(counts) AS BIGINT)]) AS w FROM h1)
, refs AS (SELECT language, [{", ".join(f"sum(c[{i + 1}])" for i in range(6))}] AS rc, [{", ".join(f"sum(w[{i + 1}])" for i in range(_N + 1))}] AS rw FROM h GROUP BY language)
, p AS (SELECT h.*, {share("c")} AS pc, {share("w")} AS pw, {share("rc")} AS qc, {share("rw")} AS qw FROM h JOIN refs USING (language))
, s AS (SELECT *, {js("pc", "qc")} AS js_chars, {js("pw", "qw")} AS js_words FROM p)
SELECT doc_id, lang, CAST(n_words AS INTEGER) AS n_words, js_chars, js_words,
    NOT (list_sum(c) - c[2] <= 0) AND NOT (list_sum(c) >= {MIN_CHARS} AND js_chars > {MAX_JS_CHARS})
    AND NOT (n_words >= {MIN_WORDS} AND language <> 'other' AND js_words > {MAX_JS_WORDS}) AS keep FROM s"""


QUERIES = {"op10_quality_rules": op10_quality_rules}
SQL = {"op10_quality_rules": _sql()}
