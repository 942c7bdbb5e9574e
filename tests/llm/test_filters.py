"""Quality rules, line dedup and mixing against brute force, with the awkward rows of each."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import line_dedup, mixing, quality_rules

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = {
    "en": "It is known that the mill of the town is on the river and that a road leads to it. ",
    "de": "Die Mühle der Stadt liegt auf der Höhe und in den Bergen, das weiß man von den Alten. ",
}


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], SCHEMA)


AWKWARD = [(900, None, "en", "a"), (901, "", "en", "a"), (902, " \n ", None, None), (None, "A line of no id.", "en", "b"), (903, "x", "xx", "c"), (903, "x", "xx", "c")]


def js(p, q):
    tp, tq = sum(p), sum(q)
    out = 0.0
    for x, y in zip(p, q):
        a, b = (x / tp if tp else 0.0), (y / tq if tq else 0.0)
        out += (a * math.log2(2 * a / (a + b)) if a else 0) + (b * math.log2(2 * b / (a + b)) if b else 0)
    return round(math.sqrt(max(out / 2, 0)), 6)


def histograms(text, lang):
    def kind(c):
        if c.isalpha():
            return 0 if c.islower() else 2
        return 1 if c in " \t\n\r\f\v" else 3 if c.isdecimal() else 4 if c in ".,;:?!'\"()-" else 5

    n = Counter(map(kind, text))
    words = re.findall(r"[^\W\d_]+", text)
    common = quality_rules.COMMON_WORDS.get(lang, [])
    w = [words.count(x) for x in common] or [0] * 12
    return [n[i] for i in range(6)], [*w, len(words) - sum(w)]


def test_quality_rules_match_brute_force(spark):
    rows = [(i, PROSE["en"] * (3 + i % 4), "en", "s") for i in range(20)] + [(50 + i, PROSE["de"] * 4, "de", "s") for i in range(10)]
    rows += [(100, "WORDS!! CAPS!! ONLY!! " * 20, "en", "s"), (101, "word*** other### thing%%% " * 20, "de", "s"), (102, "one | two | three | " * 40, "en", "s"), (103, "!!! " * 5, "en", "s"), (104, PROSE["en"] * 3000, "en", "s")]
    rows += AWKWARD
    refs = defaultdict(lambda: ([0] * 6, [0] * 13))
    for _, t, lang, _ in rows:
        c, w = histograms(t or "", lang)
        r = refs[lang if lang in quality_rules.COMMON_WORDS else "other"]
        r[0][:] = map(sum, zip(r[0], c))
        r[1][:] = map(sum, zip(r[1], w))
    expected = Counter()
    for i, t, lang, _ in rows:
        c, w = histograms(t or "", lang)
        key = lang if lang in quality_rules.COMMON_WORDS else "other"
        a, b = js(c, refs[key][0]), js(w, refs[key][1])
        bad = sum(c) - c[1] <= 0 or (sum(c) >= quality_rules.MIN_CHARS and a > quality_rules.MAX_JS_CHARS) or (sum(w) >= quality_rules.MIN_WORDS and key != "other" and b > quality_rules.MAX_JS_WORDS)
        expected[i, a, b, not bad] += 1
    docs = docs_of(spark, rows).selectExpr("*", "1 AS keep", "'z' AS _q_len")
    assert Counter((r.doc_id, r.js_chars, r.js_words, r.keep) for r in quality_rules.quality_scores(docs).collect()) == expected
    kept = quality_rules.keep_quality(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert Counter(ids) == Counter({k[0]: n for k, n in expected.items() if k[3]})
    assert not {100, 101, 102, 900, 901, 902} & set(ids) and {0, 50, 104} <= set(ids) and ids.count(903) == 2
    assert quality_rules.quality_scores(docs.where("false")).collect() == [] and quality_rules.keep_quality(docs.where("false")).collect() == []


def brute_line_dedup(rows):
    """The template rules of line_dedup on lists."""
    lines = {}
    for i, t, *_ in rows:
        for pos, line in enumerate(t.split("\n") if t is not None else []):
            if line.strip(" "):
                lines[i, t, pos] = line.strip(" ").split(" ")
    digit = lambda w: bool(re.search(r"[0-9]", w))
    leaf = {k: (len(w), *("<*>" if digit(x) else x for x in w[: line_dedup.LEAD])) for k, w in lines.items()}
    holders = defaultdict(set)
    for k, w in lines.items():
        for p, x in enumerate(w[line_dedup.LEAD :]):
            holders[leaf[k], p, x].add(k[0])
    template, docs_of_template = {}, defaultdict(set)
    for k, w in lines.items():
        rest = tuple((p, x) for p, x in enumerate(w[line_dedup.LEAD :]) if not digit(x) and len(holders[leaf[k], p, x]) >= line_dedup.MIN_DOCS)
        constant = len(rest) + sum(x != "<*>" for x in leaf[k][1:])
        worded = any(re.search(r"[^\W\d_]|©", x) for x in [x for x in leaf[k][1:] if x != "<*>"] + [x for _, x in rest])
        if constant >= line_dedup.SIMILARITY * len(w) or (constant + sum(map(digit, w)) >= line_dedup.SIMILARITY * len(w) and worded):
            template[k] = (leaf[k], rest)
        elif not any(re.search(r"[^\W\d_]|©", x) and not digit(x) for x in w):
            template[k] = tuple(w)
        if k in template:
            docs_of_template[template[k]].add(k[0])
    recurring = {k for k, x in template.items() if len(docs_of_template[x]) >= line_dedup.MIN_DOCS}
    size = lambda k: len(" ".join(lines[k]))
    lost = defaultdict(int)
    for k in recurring:
        lost[k[:2]] += size(k)
    # only documents with text of their own tell what is boilerplate
    tellers = defaultdict(set)
    for k in recurring:
        if lost[k[:2]] <= line_dedup.COPY_SHARE * len(k[1].replace("\n", "")):
            tellers[template[k]].add(k[0])
    out = []
    for i, t, *_ in rows:
        if t is None:
            out.append((i, None))
            continue
        drop = [p for p in range(t.count("\n") + 1) if (i, t, p) in recurring and len(tellers[template[i, t, p]]) >= line_dedup.MIN_DOCS]
        out.append((i, "\n".join(x for p, x in enumerate(t.split("\n")) if p not in drop)))
    return Counter(out)


def test_line_dedup_matches_brute_force(spark):
    own = lambda i: " ".join(hashlib.md5(f"{i}-{k}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(12))
    shared = "a passage of many words that several documents share because it was copied from one to the next"
    rows = [(i, f"{own(i)}\nPage {i} of the great atlas of towns\n{own(i + 500)}\n{own(i + 700)}", "en", "s") for i in range(8)]
    rows += [(20 + i, f"{own(20 + i)}\n{shared} {own(i)[:4]}\n{own(60 + i)}", "en", "s") for i in range(6)]
    rows += [(40 + i, f"{own(40)}\n{own(41)}\n{own(42)}", "en", "s") for i in range(7)]  # copies stay whole
    rows += [(60 + i, f"{own(44)}\nPage {i} of the great atlas of towns\n{own(45)}", "en", "s") for i in range(7)]  # but for boilerplate
    rows += [(70, "Page 70 of the great atlas of towns\nPage 71 of the great atlas of towns", "en", "s")]  # nothing else
    rows += [(80 + i, f"{own(80 + i)}\nThis line is in four texts only\n{own(90 + i)}", "en", "s") for i in range(4)]
    rows += [(95, "  spaced line  of two  \n" * 3, "en", "s"), (96, own(96) + "\n" + "word " * 3000, "en", "s"), *AWKWARD]
    docs = docs_of(spark, rows).selectExpr("*", "7 AS tk", "'p' AS pos")
    out = line_dedup.drop_recurring_lines(docs)
    assert out.columns == docs.columns
    found = out.collect()
    assert Counter((r.doc_id, r.text) for r in found) == brute_line_dedup(rows)
    text = {r.doc_id: r.text for r in found}
    assert all("atlas" not in text[i] for i in range(8)) and all("passage" not in text[20 + i] for i in range(6))
    assert all(text[40 + i].count("\n") == 2 for i in range(7)) and all("four texts" in text[80 + i] for i in range(4))
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in found)
    assert line_dedup.drop_recurring_lines(docs.where("false")).collect() == []


def brute_mix(rows, targets, budget_share, tokens=lambda t: len(re.findall(r"\S+", t or "", re.ASCII))):
    def key(i, t):
        u = (int(hashlib.md5(f"{'' if i is None else i}|{mixing.SEED}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
        plain = sum(c.islower() or c == " " for c in t or "")
        return round(-math.log(u) / max(mixing.WEIGHT_FLOOR, round((plain / max(len(t or ""), 1)) ** 2, 6)), 12)

    by = defaultdict(list)
    for i, t, _, s in rows:
        by[s].append((key(i, t), tokens(t), i))
    total = {s: sum(n for _, n, _ in r) for s, r in by.items()}
    weight = {s: (total[s] ** mixing.ALPHA if targets is None else targets.get(s, 0.0)) for s in by}
    out = Counter()
    for s, r in by.items():
        if not total[s]:
            continue
        budget = math.floor(round(sum(total.values()) * budget_share * weight[s] / sum(weight.values()), 3))
        epochs, rest = divmod(budget, total[s])
        for k, _, i in r:
            taken = epochs + (sum(n for k2, n, _ in r if k2 <= k) <= rest)
            if taken:
                out[i, s] += taken
    return out


@pytest.mark.parametrize(("targets", "share"), [(None, 0.8), (None, 3.0), ({"a": 1.0, "b": 3.0}, 1.0)])
def test_mixing_matches_brute_force(spark, targets, share):
    rows = [(i, f"some words of text {'and more ' * (i % 9)}{'X9' * (i % 5)}", "en", "abc"[i % 7 % 3]) for i in range(60)] + [(70, "long " * 4000, "en", "b"), (71, "dup", "en", "a"), (71, "dup", "en", "a"), (72, None, None, "empty"), *AWKWARD]
    docs = docs_of(spark, rows).selectExpr("*", "0 AS key", "1 AS tokens", "2 AS bucket")
    out = mixing.mix(docs, targets, share)
    assert out.columns == docs.columns
    assert Counter((r.doc_id, r.source) for r in out.collect()) == brute_mix(rows, targets, share)
    assert mixing.mix(docs.where("false")).collect() == []


def test_mixing_with_given_weights_and_targets_of_no_source(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i % 4 else None, float("nan") if i % 5 == 0 else (None if i % 7 == 0 else i / 100), i) for i in range(100)], "doc_id long, text string, source string, w double, n int")
    assert mixing.mix(docs, {"nowhere": 2.0}).count() == 0 and mixing.mix(docs.where("false")).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"s": -1.0})
    out = mixing.mix(docs, {"s": 1.0}, budget_share=0.3, weight=F.col("w"), tokens=F.col("n")).collect()
    total, own = sum(range(100)), sum(i for i in range(100) if i % 4)
    assert {r.source for r in out} == {"s"} and 0.9 * 0.3 * total - 100 <= sum(r.n for r in out) <= 0.3 * total < own
    # the documents of greater weight come first
    assert sum(r.doc_id for r in out) / len(out) > 49
