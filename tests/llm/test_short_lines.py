"""Line dedup on short lines with variable fields."""

from __future__ import annotations

import hashlib

from quern.llm import line_dedup


def test_short_lines_with_variable_fields_recur(spark):
    own = lambda i: " ".join(hashlib.md5(f"{i}-{k}".encode()).hexdigest().translate(str.maketrans("0123456789", "ghijklmnop")) for k in range(12))
    shapes = ["(c) 20{0} Acme", "Copyright 2019-20{0} Example Corp.", "Page {0} of 4{0}", "Version 2.{0}", "Tel: 555-12{0}", "12/05/2021 | 7", "Printed {0} {0} by the press"]
    rows = [(i, "\n".join([own(i), *(s.format(10 + i) for s in shapes), f"{i} | {i}7 | 8", own(i + 100)])) for i in range(6)]
    rows += [(20 + i, f"{own(20 + i)}\nEdition {i}\n{own(60 + i)}") for i in range(4)]  # in four documents only
    out = line_dedup.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    text = {r.doc_id: r.text for r in out}
    # a row of figures is no template, and recurs only word for word
    assert all(text[i] == f"{own(i)}\n{i} | {i}7 | 8\n{own(i + 100)}" for i in range(6))
    assert all(text[20 + i] == rows[6 + i][1] for i in range(4))
