"""The pipeline against its stages by brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

from test_filters import brute_line_dedup, brute_mix, histograms, js
from test_search import brute_groups

import corpus_pipeline
from quern.llm import mixing, packing, quality_rules, token_counts


def documents():
    own = lambda i, n: " ".join(f"the {hashlib.md5(f'{i}-{k}'.encode()).hexdigest().translate(str.maketrans('0123456789', 'ghijklmnop'))[:7]} of it" for k in range(n))
    rows = [(i, f"{own(i, 30)}\nAll rights of this page are with the great atlas of towns\n{own(i + 500, 20)}", "en", "ab"[i % 3 == 0]) for i in range(40)]
    rows += [(100 + i, own(7, 60), "en", "a") for i in range(4)]  # copies
    rows += [(200 + i, "#$%^&*{}[]<>" * 60, "en", "b") for i in range(3)]  # junk
    rows += [(300, None, "en", "a"), (301, "", "en", None), (302, own(9, 900), "en", None), (None, own(11, 20), "en", "b")]
    return rows


def brute_quality(rows):
    counted = [(r, r[2] if r[2] in quality_rules.COMMON_WORDS else "other", *histograms(r[1] or "", r[2])) for r in rows]
    refs = {}
    for _, key, c, w in counted:
        refs.setdefault(key, ([0] * 6, [0] * 13))
        refs[key] = ([x + y for x, y in zip(refs[key][0], c)], [x + y for x, y in zip(refs[key][1], w)])
    for row, key, c, w in counted:
        off = (sum(c) >= quality_rules.MIN_CHARS and js(c, refs[key][0]) > quality_rules.MAX_JS_CHARS) or (sum(w) >= quality_rules.MIN_WORDS and key != "other" and js(w, refs[key][1]) > quality_rules.MAX_JS_WORDS)
        if sum(c) > c[1] and not off:
            yield row


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")

    good = list(brute_quality(rows))
    assert {r[0] for r in good} == {r[0] for r in rows} - {200, 201, 202, 300, 301}
    after = brute_line_dedup(good)
    meta = {r[0]: r for r in good}
    lined = [(i, t, *meta[i][2:]) for (i, t), n in after.items() for _ in range(n)]
    assert all("atlas" not in t for i, t, *_ in lined)
    groups, _ = brute_groups([(i, t) for i, t, *_ in lined])
    unique = [r for r in lined if r[0] is None or groups.get(r[0], r[0]) == r[0]]
    assert sum(100 <= r[0] < 104 for r in unique if r[0] is not None) == 1
    length = lambda t: 0 if t is None else token_counts.counter().total(t)
    taken = brute_mix(unique, None, mixing.BUDGET_SHARE, length)
    words = {(i, s): length(t) for i, t, _, s in unique}
    wanted = Counter()
    for (i, s), n in taken.items():
        wanted[i] += n * words[i, s]

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    got, fill = Counter(), defaultdict(int)
    for r in out:
        got[r.doc_id] += r.tokens
        fill[r.bin_id] += r.tokens
    assert got == wanted
    assert max(fill.values()) <= packing.CAPACITY and len(fill) <= sum(wanted.values()) / packing.CAPACITY + 2


def test_all_stages_but_the_last_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.dtypes == docs.dtypes and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count() == 0


def test_pipeline_of_string_ids_clashing_columns_and_repeated_rows(spark, tmp_path):
    rows = [(None if i is None else f"d{i}", t, lang, s, 7, "x", 1.0) for i, t, lang, s in documents()]
    rows += rows[:3] + [("lone", "w " * 9000, None, None, None, None, None)]
    schema = "doc_id string, text string, lang string, source string, n_chars long, tk string, _q_key double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    fill = Counter()
    for r in out:
        fill[r.bin_id] += r.tokens
    assert out and max(fill.values()) <= packing.CAPACITY and {r.doc_id for r in out} <= {r[0] for r in rows}
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").dtypes == docs.dtypes


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
