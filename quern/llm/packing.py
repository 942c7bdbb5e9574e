"""Best-fit packing into sequences of ``CAPACITY`` tokens, with a local search.

The unit is the token of the vocabulary in ``token_counts``, counted exactly over
whole texts (another column of lengths can be given). A document longer than a
sequence fills whole sequences with its first pieces and leaves its rest to be
packed with others. Rests are placed best-fit first, largest first. A swap-based
search then works on the bins that aren't full: it moves a document, exchanges
one for one, or two for one, always from an emptier bin to a fuller one, so that
the sum of squared fills grows with every step and the emptiest bins run out. It
ends when no such step is left in the shard.

Scale: only ids and token counts are dealt out, no text is shuffled. Items are
dealt evenly to shards of about ``SHARD_ITEMS``, a number that follows from the
count of items; shards are packed independently, and each can waste the room of
a last few bins at most, which is a fixed small share. A step is found by a
table of the greatest room beside each size, not by a look at all items.

Nulls and edges: null and empty texts have no tokens and are in no bin. A null
doc_id is packed like any other. Repeated rows are packed once each, in bins or
places of their own. Ties in size go by id and then order of arrival, which
changes only names of equal items. Very long texts become whole bins, however
many. Extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialise
from quern.llm.token_counts import token_count

CAPACITY, SHARD_ITEMS = 2048, 16384


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers: largest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []  # (free, bin), sorted
    for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            insort(room, (capacity - sizes[i], len(bins) - 1))
        else:
            free, b = room.pop(at)
            bins[b].append(i)
            insort(room, (free - sizes[i], b))
    return bins


class _Takers:
    """The bins that can take tokens: for each size of item, the bin of most room among those that hold one; size 0 stands for no item."""

    def __init__(self, bins: list[list[int]], fill: list[int], sizes: list[int], capacity: int):
        self.bins, self.fill, self.sizes, self.capacity = bins, fill, sizes, capacity
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity)]
        # the size and the room beside it: what an item may have that comes in its place
        self.reach = np.full(capacity, -1, np.int64)
        self.inside = [0 < f < capacity for f in fill]
        for b, there in enumerate(self.inside):
            if there:
                for t in {0, *(sizes[i] for i in bins[b])}:
                    self.heaps[t].append((-(capacity - fill[b]), b))
        for t, heap in enumerate(self.heaps):
            heapify(heap)
            if heap:
                self.reach[t] = t - heap[0][0]

    def _settle(self, t: int) -> None:
        heap = self.heaps[t]
        while heap:
            room, b = heap[0]
            if self.inside[b] and self.capacity - self.fill[b] == -room and (t == 0 or any(self.sizes[i] == t for i in self.bins[b])):
                break
            heappop(heap)
        self.reach[t] = t - heap[0][0] if heap else -1

    def changed(self, b: int, before: set[int]) -> None:
        """Bin b has other items or left; before: the sizes it held."""
        now = set()
        self.inside[b] = self.inside[b] and 0 < self.fill[b] < self.capacity
        if self.inside[b]:
            now = {0, *(self.sizes[i] for i in self.bins[b])}
            for t in now:
                heappush(self.heaps[t], (self.fill[b] - self.capacity, b))
        for t in before | now | {0}:
            self._settle(t)

    def exchange(self, s: int) -> int | None:
        """The least size that can go out for items of s tokens in all: the greatest gain."""
        end = min(s, self.capacity)
        ok = self.reach[:end] >= s
        t = int(ok.argmax()) if end else 0
        return t if end and ok[t] else None

    def holder(self, t: int) -> int:
        return self.heaps[t][0][1]


def _step(donor: int, takers: _Takers) -> tuple[list[int], int] | None:
    """The items to give and the size to get back: a move before an exchange, one for one before two for one, then by gain."""
    sizes, mine = takers.sizes, sorted(takers.bins[donor], key=lambda i: -takers.sizes[i])
    room = int(takers.reach[0])
    for i in mine:
        if sizes[i] <= room:
            return [i], 0
    for n in (1, 2):
        sums: dict[int, list[int]] = {}
        if n == 1:
            for i in mine:
                sums.setdefault(sizes[i], [i])
        else:
            for x, i in enumerate(mine):
                for j in mine[x + 1 :]:
                    sums.setdefault(sizes[i] + sizes[j], [i, j])
        best = None
        for s, given in sums.items():
            t = takers.exchange(s)
            if t and (best is None or s - t > best[0]):
                best = (s - t, given, t)
        if best:
            return best[1], best[2]
    return None


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins until none raises the sum of squared fills."""
    bins = [list(b) for b in bins]
    fill = [sum(sizes[i] for i in b) for b in bins]
    stepped = True
    while stepped:
        stepped = False
        takers = _Takers(bins, fill, sizes, capacity)
        queue = [(f, b) for b, f in enumerate(fill) if 0 < f < capacity]
        heapify(queue)
        while queue:
            f, donor = heappop(queue)
            if f != fill[donor] or not takers.inside[donor]:
                continue  # a later entry has its present fill
            # the emptiest bin gives to all others; what it can't give stays, and the next one follows
            takers.inside[donor] = False
            takers.changed(donor, {0, *(sizes[i] for i in bins[donor])})
            while bins[donor] and (step := _step(donor, takers)):
                given, t = step
                taker = takers.holder(t)
                before = {sizes[i] for i in bins[taker]}
                back = next((i for i in bins[taker] if sizes[i] == t), None) if t else None
                for i in given:
                    bins[donor].remove(i)
                    bins[taker].append(i)
                moved = sum(sizes[i] for i in given)
                if back is not None:
                    bins[taker].remove(back)
                    bins[donor].append(back)
                    moved -= t
                fill[donor] -= moved
                fill[taker] += moved
                takers.changed(taker, before)
                if takers.inside[taker]:
                    heappush(queue, (fill[taker], taker))
                stepped = True
    return [b for b in bins if b]


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    return local_search(best_fit(sizes, capacity), sizes, capacity)


def _pack_shard(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["rest", "doc_id"], ascending=[False, True], kind="stable", na_position="last").reset_index(drop=True)
    sizes = rows["rest"].tolist()
    bins = pack(sizes)
    at, start = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for b, items in enumerate(bins):
        used = 0
        for i in sorted(items):
            at[i], start[i] = b, used
            used += sizes[i]
    return pd.DataFrame({"doc_id": rows["doc_id"], "piece": rows["whole"], "tokens": rows["rest"], "shard": key[0], "bin": at, "bin_start": start})


def pack_documents(docs: DataFrame, tokens: Column | None = None) -> DataFrame:
    """doc_id, piece (number within the document), doc_start (its first token there),
    tokens, bin_id, bin_start (its first token in the bin): one row a piece.

    tokens: the length of each row, the exact count of ``text`` by default."""
    dtype = docs.schema["doc_id"].dataType
    items = docs.select("doc_id", (token_count("text") if tokens is None else tokens.cast("long")).alias("n"))
    # the row's number is written with it; rows that repeat an id, or all of one, differ by it
    items = items.select("doc_id", F.floor(F.col("n") / CAPACITY).cast("int").alias("whole"), F.pmod("n", F.lit(CAPACITY)).cast("int").alias("rest"), F.monotonically_increasing_id().alias("row"))
    items = materialise(items.where("whole > 0 OR rest > 0"))
    shards = items.where("rest > 0").agg(F.greatest(F.ceil(F.count("*") / SHARD_ITEMS), F.lit(1)).cast("int").alias("shards"))  # one row
    dealt = items.where("rest > 0").crossJoin(F.broadcast(shards)).select("doc_id", "whole", "rest", F.pmod(F.xxhash64("row"), "shards").cast("int").alias("shard"))
    dealt = dealt.groupBy("shard").applyInPandas(_pack_shard, f"doc_id {dtype.simpleString()}, piece int, tokens int, shard int, bin long, bin_start long")
    packed = dealt.select("doc_id", "piece", (F.col("piece").cast("long") * CAPACITY).alias("doc_start"), "tokens", F.concat_ws("-", F.lit("s"), "shard", "bin").alias("bin_id"), F.col("bin_start").cast("int").alias("bin_start"))
    full = items.where("whole > 0").select("doc_id", "row", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("piece"))
    full = full.select("doc_id", "piece", (F.col("piece").cast("long") * CAPACITY).alias("doc_start"), F.lit(CAPACITY).alias("tokens"), F.concat_ws("-", F.lit("d"), "row", "piece").alias("bin_id"), F.lit(0).alias("bin_start"))
    return packed.union(full)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
SQL: dict[str, str] = {}
