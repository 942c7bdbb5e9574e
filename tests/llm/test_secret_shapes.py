"""The secret scan on documents of every shape that it is trained on."""

from __future__ import annotations

from collections import defaultdict

from quern.llm import secrets

KEY = "q9Zt3LmX7bKw2RvNc8Hd5Yp1"
SHAPES = [
    ("password=hunter22", "hunter22"), ('{"password": "hunter22"}', "hunter22"), ("pwd: 'hunter22'", "hunter22"), ("passphrase = hunter22x", "hunter22x"), (f"private_key: {KEY}", KEY),
    ("postgres://user:hunter22@host/db", "hunter22"), (f"API_KEY={KEY}", KEY), (f"export TOKEN={KEY}", KEY), ('api_key = "QwErTyUiOpAsDfGhJkLzXc"', "QwErTyUiOpAsDfGhJkLzXc"), (f"secret={KEY}==", f"{KEY}=="),
    (f"auth: token={KEY}", KEY),
]
HARMLESS = ["token: everything", "password: required", "author: somebody", "postgres://user:password@localhost/db", "Authorization: Bearer of news"]


def test_scan_finds_each_shape(spark):
    held = secrets.sample_findings(800, seed=91)
    rows = [(i, t) for i, (t, _) in enumerate(SHAPES)] + [(100 + i, t) for i, t in enumerate(HARMLESS)] + [(1000 + i, f"{b}{v}{a}") for i, (v, b, a, _) in enumerate(held)]
    found = defaultdict(set)
    for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), secrets.train()).collect():
        found[x.doc_id].add((x.start, x.secret))
    text = dict(rows)
    assert all(text[i][a : a + len(v)] == v for i, xs in found.items() for a, v in xs)
    assert all(found[i] == {(t.index(v), v)} for i, (t, v) in enumerate(SHAPES))
    assert not any(found[100 + i] for i in range(len(HARMLESS)))
    positive = [found[1000 + i] == {(len(b), v)} for i, (v, b, _, y) in enumerate(held) if y]
    negative = [bool(found[1000 + i]) for i, (*_, y) in enumerate(held) if not y]
    assert sum(positive) > 0.97 * len(positive) and sum(negative) < 0.03 * len(negative)
