"""Quality rules on languages without a word list."""

from __future__ import annotations

import random

from quern.llm import quality_rules


def test_languages_without_word_lists(spark):
    r = random.Random(3)
    # a third of the words are frequent ones, the others are many
    make = lambda words, n: " ".join(r.choice(words) if r.random() < 0.35 else "".join(r.choices("".join(words), k=5)) for _ in range(n)) + ". "
    ru = "и в не на что с по как это город река мельница дорога мост люди".split()
    it = "il e che di la un per non una sono fiume ponte strada mulino gente".split()
    hi = "और में की है से को यह नगर नदी पुल सड़क लोग".split()
    rows = [(i, make(ru, 150), "ru") for i in range(200)] + [(200 + i, make(it, 150), "it") for i in range(200)]
    rows += [(400 + i, "".join(r.choices("这是城市的河流和道路人们在桥上", k=300)), "zh") for i in range(25)]
    rows += [(500 + i, make(hi, 150), "hi") for i in range(5)] + [(510 + i, "".join(r.choices("这是城市的河流和道路", k=300)), None) for i in range(3)]
    rows += [(600, " ".join(r.choices([f"{a}{b}ov" for a in "bcdf" for b in "aeiou"], k=150)), "it"), (601, "{}[]<>|#" * 60, "it"), (602, "{}[]<>|#" * 30, "sv"), (603, "{}[]<>|#" * 30, None)]
    rows += [(700 + i, make(it, 150), "sv") for i in range(15)]
    scores = {x.doc_id: x for x in quality_rules.quality_scores(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    rejected = {i for i, x in scores.items() if not x.keep}
    assert rejected == {600, 601, 602, 603}, [tuple(scores[i]) for i in sorted(rejected ^ {600, 601, 602, 603})][:8]
