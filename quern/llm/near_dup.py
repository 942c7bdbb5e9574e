"""MinHash near-dedup by a multi-index Hamming join.

A document's signature holds ``K`` MinHash values of its word pairs, cut to
``BITS`` bits. Two documents are near duplicates where at most ``MAX_DIFF`` of
their ``K`` values differ. The signature is split into ``CHUNKS`` chunks; by the
pigeonhole principle two such signatures differ in at most ``CHUNK_ERRORS``
values of some chunk (``MAX_DIFF < CHUNKS * (CHUNK_ERRORS + 1)``). Every way of
leaving out that many values of a chunk is a join key, so each pair under the
distance shares a key: no pair is missed, and the keys of a document are fixed
in number.

Equal signatures collapse first to one class. A key's classes are counted, and
keys with the same classes count as one bucket. A pair of classes is compared in
each bucket that holds both and counted in the one of its first common key, so
that every link counts once. Groups are the connected components of all links.

Scale: no list of a bucket is ever collected. A bucket of more than ``BLOCK``
classes is dealt to blocks, and each two blocks are a unit of work of their own,
so a crowded bucket is spread over tasks of bounded size (its comparisons still
grow with the square of its classes; copies don't count among them). A unit
returns a row for each of its classes, not its pairs. Components are found by
min-label rounds over the shared checkpoint folder.

Nulls and edges: texts without a word (null, empty, punctuation) have no
signature and are in no group; so are rows with a null doc_id, which nothing
could name. One word makes a signature of its own. Rows that repeat a doc_id are
one document, and its texts are linked; ``drop_near_duplicates`` keeps one row of each id, whichever of
rows that differ sorts first, and all rows with a null id. Ties go to the
smallest doc_id, which may be of any type that has an order. Extra columns are
ignored or kept as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import fresh, keep_likely, materialise

K, BITS, CHUNKS, CHUNK_ERRORS = 50, 16, 10, 1
PER_CHUNK = K // CHUNKS
MAX_DIFF = CHUNKS * (CHUNK_ERRORS + 1) - 1
_WORDS = re.compile(r"\w+")
_RNG = np.random.default_rng(20240607)
_MUL = (_RNG.integers(1, 1 << 62, K, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _RNG.integers(0, 1 << 62, K, dtype=np.uint64)
_STEP = 4096
#: Classes of a bucket that one unit compares with each other, or with as many more.
BLOCK = 1024
_INDEX = 63  # the lowest bits of a key tell the chunk and the value left out


def signature(text: str | None) -> np.ndarray | None:
    """K values of 16 bits; None for a text without a word."""
    words = _WORDS.findall(text.lower()) if text else []
    if not words:
        return None
    hashed = dict.fromkeys(words)
    for w in hashed:
        hashed[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(hashed.__getitem__, words), np.uint64, len(words))
    pairs = np.unique(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + (h[1:] ^ (h[1:] >> np.uint64(29)))) if len(h) > 1 else h
    pairs ^= pairs >> np.uint64(32)
    least = np.full(K, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(pairs), _STEP):
        np.minimum(least, (pairs[i : i + _STEP, None] * _MUL + _ADD).min(axis=0), out=least)
    # of the least value the middle bits, as its high bits are near 0 for long texts
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """The join keys of each signature (rows): one for each chunk and choice of values left out."""
    out = []
    sig = signatures.astype(np.uint64)
    for c in range(CHUNKS):
        for n, kept in enumerate(combinations(range(PER_CHUNK), PER_CHUNK - CHUNK_ERRORS)):
            key = np.full(len(sig), (c * 64 + n + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
            for j in kept:
                key = (key ^ sig[:, c * PER_CHUNK + j]) * np.uint64(0xFF51AFD7ED558CCD)
                key ^= key >> np.uint64(33)
            out.append(key & ~np.uint64(_INDEX) | np.uint64(len(out)))
    return np.stack(out, axis=1).view(np.int64)


@F.pandas_udf(T.BinaryType())
def signature_udf(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if (s := signature(t)) is None else s.tobytes())


@F.pandas_udf(T.ArrayType(T.LongType()))
def keys_udf(signatures: pd.Series) -> pd.Series:
    if not len(signatures):
        return pd.Series([], dtype=object)
    return pd.Series(list(chunk_keys(np.frombuffer(b"".join(signatures), np.uint16).reshape(-1, K))), index=signatures.index)


def _links(sigs: np.ndarray, end: np.ndarray, side: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of row numbers, each within a unit, that are near duplicates and whose
    first common key is the bucket's. end: of each row's unit; side: rows of equal
    side 1 or 2 aren't compared; mask: the bucket's keys by their index."""
    rows, found = np.arange(len(sigs)), []
    for d in range(1, len(sigs)):
        rows = rows[rows + d < end[rows]]
        if not len(rows):
            break
        a = rows[(side[rows] == 0) | (side[rows] != side[rows + d])]
        differ = sigs[a] != sigs[a + d]
        near = differ.sum(axis=1) <= MAX_DIFF
        a, chunks = a[near], differ[near].reshape(-1, CHUNKS, PER_CHUNK)
        if len(a):
            errors, each = chunks.sum(axis=2), np.arange(len(a))
            first = (errors <= CHUNK_ERRORS).argmax(axis=1)
            # the choices leave out the last value first; without an error all choices are common
            choice = np.where(errors[each, first] == 0, 0, PER_CHUNK - 1 - chunks[each, first].argmax(axis=1))
            a = a[mask[a] >> first * PER_CHUNK + choice & 1 == 1]
            found.append((a, a + d))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (rows[:0], rows[:0])


def _unit_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """node, links (counted here), root (least node that it is tied to here): of rows sorted by unit."""

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        unit = rows[["bucket", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (unit[1:] != unit[:-1]).any(axis=1)])
        end = np.repeat(np.r_[starts[1:], len(rows)], np.diff(np.r_[starts, len(rows)]))
        sigs = np.frombuffer(b"".join(rows["sig"]), np.uint16).reshape(-1, K)
        a, b = _links(sigs, end, rows["side"].to_numpy(), rows["mask"].to_numpy())
        node = rows["node"].to_numpy()
        root, before = node.copy(), None
        while before is None or (root != before).any():
            before = root.copy()
            np.minimum.at(root, a, root[b])
            np.minimum.at(root, b, root[a])
        links = np.bincount(a, minlength=len(rows)) + np.bincount(b, minlength=len(rows))
        out = pd.DataFrame({"node": node, "links": links, "root": root})
        return out[links > 0]

    left = None
    for rows in batches:
        rows = rows if left is None else pd.concat([left, rows], ignore_index=True)
        if len(rows):
            # the last unit may go on in the next batch; a unit has two blocks at most
            last = rows[["bucket", "i", "j"]].iloc[-1]
            whole = ((rows["bucket"] != last["bucket"]) | (rows["i"] != last["i"]) | (rows["j"] != last["j"])).to_numpy()
            left = rows[~whole]
            if whole.any():
                yield of(rows[whole])
    if left is not None and len(left):
        yield of(left)


def components(edges: DataFrame) -> DataFrame:
    """id, root: each end of an edge (a, b) with the least id of its component."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(both.where("a <> b").distinct())
    while True:
        # each node and its neighbours are tied to the least among them (large star), then the lesser ones to their least (small star)
        least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = edges.join(least, "a").where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").union(least.select("x", F.col("m").alias("y"))).distinct()
        small = materialise(small)
        # stars: no node is both tied and a centre, none is tied twice
        tied = small.groupBy("x").agg(F.count("*").alias("n"))
        if tied.where("n > 1").isEmpty() and tied.join(small.select(F.col("y").alias("x")), "x", "left_semi").isEmpty():
            roots = small.select("y").distinct()
            return small.select(F.col("x").alias("id"), F.col("y").alias("root")).union(roots.select(F.col("y").alias("id"), F.col("y").alias("root")))
        edges = small.select(F.col("x").alias("a"), F.col("y").alias("b")).union(small.select(F.col("y").alias("a"), F.col("x").alias("b")))


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, sig of the documents that have both."""
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    return rows.select("doc_id", signature_udf("text").alias("sig")).where(F.col("sig").isNotNull())


def _class_links(classes: DataFrame) -> DataFrame:
    """node, links, root: rows of the units, for classes (node, sig)."""
    keyed = classes.select("node", F.explode(keys_udf("sig")).alias("key"))
    # equal sums of two hashes, equal counts and least nodes: the same classes
    same = [F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.min("node").alias("lo")]
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), *same).where("n > 1")
    index = F.col("key").bitwiseAND(F.lit(_INDEX)).cast("int")
    buckets = buckets.groupBy("n", "x", "y", "lo").agg(F.min("key").alias("key"), F.expr(f"bit_or(shiftleft(1L, cast(key & {_INDEX} as int)))").alias("mask"))
    buckets = materialise(buckets.select("key", "mask", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    members = keep_likely(keyed, "key", buckets.select("key")).join(buckets, "key").join(classes, "node")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    members = members.select(F.col("key").alias("bucket"), "node", "sig", "mask", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    side = F.when(F.col("b") == F.col("o"), 0).when(F.col("b") < F.col("o"), 1).otherwise(2)
    units = members.select("bucket", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), side.alias("side"), "node", "sig", "mask")
    units = units.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "side")
    return units.mapInPandas(_unit_links, "node long, links long, root long")


def near_duplicate_groups(docs: DataFrame) -> DataFrame:
    """doc_id, group_id, n_links, n_copies for every document that has a near duplicate.

    group_id: the group's least doc_id; n_links: other signatures within the
    distance of the document's own; n_copies: documents of its own signature, itself included."""
    signed = materialise(_signed(docs).distinct())
    # the class's number is written with it
    classes = signed.groupBy("sig").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n_copies"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()))
    linked = materialise(_class_links(classes.select("node", "sig")))
    members = materialise(signed.join(classes.select("sig", "node"), "sig").select("doc_id", "node"))
    # rows that repeat an id with other texts
    again = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("doc_id", "a")
    edges = linked.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")).union(members.join(again, "doc_id").where("node <> a").select("a", F.col("node").alias("b")))
    roots = components(edges.distinct())
    links = linked.groupBy("node").agg(F.sum("links").alias("n_links"))
    nodes = classes.join(roots.withColumnRenamed("id", "node"), "node", "left").join(links, "node", "left")
    nodes = materialise(nodes.select("node", "lo", "hi", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("root", "node").alias("root")))
    groups = nodes.groupBy("root").agg(F.min("lo").alias("group_id"), F.max("hi").alias("last")).where("group_id <> last").select("root", "group_id")
    named = nodes.join(groups, "root").select("node", "group_id", "n_links", "n_copies")
    out = members.join(named, "node").groupBy("doc_id").agg(F.min("group_id").alias("group_id"), F.sum("n_links").alias("n_links"), F.max("n_copies").alias("n_copies"))
    return out


def near_duplicate_pairs(docs: DataFrame) -> DataFrame:
    """a, b, diff: every pair of documents a < b whose signatures differ in at
    most MAX_DIFF values. The result itself grows with the square of a group."""
    signed = materialise(_signed(docs).distinct())
    keyed = signed.select("doc_id", "sig", F.explode(keys_udf("sig")).alias("key"))
    left, right = keyed.select("key", F.col("doc_id").alias("a"), F.col("sig").alias("x")), keyed.select("key", F.col("doc_id").alias("b"), F.col("sig").alias("y"))
    pairs = left.join(right, "key").where("a < b").select("a", "b", "x", "y").distinct()
    return pairs.select("a", "b", _diff("x", "y").alias("diff")).where(F.col("diff") <= MAX_DIFF).groupBy("a", "b").agg(F.min("diff").alias("diff"))


@F.pandas_udf(T.IntegerType())
def _diff(x: pd.Series, y: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype="int32")
    a, b = (np.frombuffer(b"".join(s), np.uint16).reshape(-1, K) for s in (x, y))
    return pd.Series((a != b).sum(axis=1).astype("int32"), index=x.index)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, the one with the least id, and all others."""
    losers = materialise(near_duplicate_groups(docs).where("doc_id <> group_id").select(F.col("doc_id").alias(fresh(docs, "loser"))))
    kept = docs.join(losers, docs["doc_id"] == losers[losers.columns[0]], "left_anti")
    repeated = kept.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 AND doc_id IS NOT NULL").select("doc_id")
    repeated = materialise(repeated.withColumnRenamed("doc_id", fresh(docs, "again")))
    if repeated.isEmpty():
        return kept
    on = kept["doc_id"] == repeated[repeated.columns[0]]
    others = [c for c in docs.columns if c != "doc_id"]
    again = kept.join(repeated, on, "left_semi").groupBy("doc_id").agg(F.min_by(F.struct(*others), F.to_json(F.struct(*others))).alias("row"))
    again = again.select(*(F.col("doc_id") if c == "doc_id" else F.col("row").getField(c).alias(c) for c in docs.columns))
    return kept.join(repeated, on, "left_anti").unionByName(again)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the group's least doc_id, links and copies, for every document with a near duplicate."""
    return near_duplicate_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op2_minhash_near_dedup": op2_minhash_near_dedup}
SQL: dict[str, str] = {}
