"""Quality classifier by compression.

Two zstandard dictionaries are built, one from good and one from bad labelled
texts. A text that resembles the good ones compresses better with their
dictionary; the difference of the two compressed sizes, over their sum, is the
score. Labelled texts that the dictionaries haven't seen calibrate it: a logistic
curve maps the score to the probability of a good text, and the cut-off is the
greatest that keeps ``KEEP_GOOD`` of the good ones.

Training is bounded: at most ``MAX_LABELLED`` labelled documents of each class
(those of least hashed id) are fetched, so the driver and the two dictionaries
of ``DICT_BYTES`` each, which travel with the tasks, don't grow with the corpus.
Scoring reads every document whole, in one pass, without a shuffle.

Nulls and edges: a null, empty or blank text has no score: score and probability
are null and it isn't kept. Texts under ``MIN_BYTES`` are scored but always kept,
as a few bytes tell nothing. Repeated rows score alike. Labels with a null
doc_id or quality are ignored, also labels without a document; a document with
two labels counts as bad if one of them says so. With fewer than two labelled
texts of either class (empty tables among them) there is nothing to learn from:
``train`` raises a ValueError, ``fit`` gives no model, and without a model score
and probability are null and all but blank texts are kept. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_LABELLED, DICT_BYTES, LEVEL = 1500, 112_640, 3
MIN_BYTES, KEEP_GOOD = 200, 0.995


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    cutoff: float  # least probability that is kept

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * score + self.intercept, -60, 60)))


class Scorer:
    def __init__(self, good: bytes, bad: bytes):
        self.good, self.bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_FULLDICT)) for d in (good, bad))

    def score(self, text: str) -> float:
        raw = text.encode("utf-8", "replace")
        g, b = len(self.good.compress(raw)), len(self.bad.compress(raw))
        return (b - g) / (b + g)


def _dictionary(texts: list[str]) -> bytes:
    samples = [t.encode("utf-8", "replace") for t in texts]
    size = min(DICT_BYTES, max(1024, sum(map(len, samples)) // 8))
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples to choose from: their own text serves, split to be enough
        parts = [s[i : i + 64] for s in samples for i in range(0, len(s), 64)]
        return zstandard.train_dictionary(1024, parts * (1 + 64 // max(1, len(parts)))).as_bytes()


def _logistic(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Newton's method for a curve of one variable, with a small ridge, so that separable classes end too."""
    x = np.stack([score / max(float(np.std(score)), 1e-9), np.ones_like(score)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), x.T @ (good - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / max(float(np.std(score)), 1e-9)), float(w[1])


def train(good: list[str], bad: list[str]) -> Model:
    """Every second text of each class makes the dictionaries, the others calibrate."""
    if len(good) < 2 or len(bad) < 2:
        raise ValueError("two labelled texts of each class are needed at least")
    dictionaries = _dictionary(good[::2]), _dictionary(bad[::2])
    scorer = Scorer(*dictionaries)
    held = [(scorer.score(t), 1.0) for t in good[1::2]] + [(scorer.score(t), 0.0) for t in bad[1::2]]
    score, is_good = np.array(held).T
    slope, intercept = _logistic(score, is_good)
    model = Model(*dictionaries, slope, intercept, 0.0)
    of_good = np.sort(model.probability(score[is_good == 1]))
    return Model(*dictionaries, slope, intercept, min(0.5, float(of_good[int((1 - KEEP_GOOD) * len(of_good))])))


def labelled_texts(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> tuple[list[str], list[str]]:
    """Good and bad texts, in the order of their hashed ids."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = []
    for bad in (False, True):
        of_class = marks.where((F.col("quality") == 0) if bad else (F.col("quality") != 0))
        # twice as many ids, as some labels have no document that can be scored
        chosen.append(of_class.select("doc_id", F.lit(bad).alias("bad"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").limit(2 * most))
    ids = F.broadcast(chosen[0].union(chosen[1]))  # at most 4 * most rows
    rows = docs.select("doc_id", "text").where(F.octet_length("text") >= MIN_BYTES).join(ids, "doc_id")
    rows = rows.groupBy("doc_id", "bad", "h").agg(F.min("text").alias("text"))
    found = rows.collect()  # bounded by the ids
    out: list[list[str]] = [[], []]
    for r in sorted(found, key=lambda r: (r["h"], r["doc_id"])):
        if len(out[r["bad"]]) < most:
            out[r["bad"]].append(r["text"])
    return out[0], out[1]


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model of the labelled documents; None where they are too few."""
    good, bad = labelled_texts(docs, labels)
    return train(good, bad) if min(len(good), len(bad)) >= 2 else None


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score, probability, keep: one row for each row of docs."""
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", none.alias("score"), none.alias("probability"), F.coalesce(F.col("text").rlike(r"[^\s]"), F.lit(False)).alias("keep"))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model.good, model.bad)
        for rows in batches:
            blank = np.array([t is None or not t.strip() for t in rows["text"]], dtype=bool)
            score = np.array([np.nan if b else scorer.score(t) for b, t in zip(blank, rows["text"])], dtype=float)
            p = model.probability(score)
            short = np.array([not b and len(t.encode("utf-8", "replace")) < MIN_BYTES for b, t in zip(blank, rows["text"])], dtype=bool)
            keep = ~blank & (short | (p >= model.cutoff))
            none = lambda x: pd.Series(np.where(blank, None, np.round(x, 6)), index=rows.index, dtype=object)
            yield pd.DataFrame({"doc_id": rows["doc_id"], "score": none(score), "probability": none(p), "keep": keep})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(scored, f"doc_id {kind}, score double, probability double, keep boolean")


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_documents(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {"op9_compression_quality": op9_compression_quality}
SQL: dict[str, str] = {}
