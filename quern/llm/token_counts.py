"""Exact token counts at every prefix, by dynamic programming over the prefixes.

A byte-pair encoder splits a text into pieces by a pattern and merges each piece
on its own. Inside a piece the encoding of a prefix is the encoding of a shorter
prefix and one more token, the only one that stays unmerged next to the token
before it. So the state of a prefix is its count and last token, and the state
at a byte follows from earlier states. Where the encoding of the whole piece ends
a token, no merge crosses, so the prefix there has just the tokens up to it; only
the prefixes that end within a token are left to the recurrence. Pieces recur, so
their counts are kept in a bounded table.

The counts of a document are stored as one signed byte for each character: the
change of the count against the prefix before it (at most 4 up, and down by less
than the bytes of the longest token, which must be under 128). ``count_at``, ``cut_at`` and
``fits`` answer from that column alone and never see the text again.

The pattern looks ahead in two places, and the counts follow: a run of white
space is one piece as long as nothing comes after it, and an apostrophe with the
first letter of 'll, 've or 're is two pieces.

Scale: a projection over the scan; nothing is shuffled. Each Python worker loads
the vocabulary once from ``path``, which must name a file on every executor.

Nulls and edges: a null text gives null counts; an empty one counts 0. Lone
surrogates, which UTF-8 can't hold, count as the replacement character. Texts of
any length are counted whole. Repeated rows are counted alike. Other columns are
ignored.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BUDGETS = (128, 512, 2048)
_KEPT_PIECES = 1_000_000
_SPLIT = regex.compile(PATTERN)
_LOOKAHEAD = regex.compile(r"\s\s|'(?:ll|ve|re)")
#: White space as the encoder has it, and the places where a run of it leaves its last character to the piece after it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_SPACE}]{{2}}")
_RUN_END = re.compile(f"(?<=[{_SPACE}])(?=[{_SPACE}][^{_SPACE}])")


def _signed_bytes(changes: np.ndarray) -> bytes:
    if len(changes) and (changes.min() < -128 or changes.max() > 127):
        raise ValueError("a change of the count doesn't fit a byte")
    return changes.astype(np.int8).tobytes()


class PrefixCounter:
    """Counts of all prefixes under one vocabulary."""

    def __init__(self, path: str = VOCABULARY):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if max(map(len, self.ranks)) > 128:
            raise ValueError("a token of over 128 bytes: changes of the count may not fit a byte")
        #: Lengths of the tokens that end with these two bytes, or with the one.
        self.lengths: dict[bytes, list[int]] = {}
        for token in self.ranks:
            known = self.lengths.setdefault(token[-2:], [])
            if len(token) > 1 and len(token) not in known:
                known.append(len(token))
        # without the look-ahead, which is far slower, runs of white space are split beforehand
        self.encoder = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN.replace(r"|\s+(?!\S)", ""), mergeable_ranks=self.ranks, special_tokens={})
        self.token_bytes = {rank: len(token) for token, rank in self.ranks.items()}
        self.stays: dict[tuple[bytes, bytes], bool] = {}
        self.pieces: dict[str, bytes] = {}

    def total(self, text: str) -> int:
        """Tokens of the whole text."""
        if not text.isascii():
            text = text.encode("utf-8", "replace").decode("utf-8")
        parts = _RUN_END.split(text) if _RUN.search(text) else (text,)
        return sum(len(self.encoder.encode_ordinary(x)) for x in parts)

    def _unmerged(self, left: bytes, right: bytes) -> bool:
        """Whether the merges of left + right end with just these two tokens."""
        known = self.stays.get((left, right))
        if known is None:
            if len(self.stays) >= _KEPT_PIECES:
                self.stays.clear()
            known = self.stays[left, right] = self._merge(left + right) == [left, right]
        return known

    def _merge(self, piece: bytes) -> list[bytes]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        rank = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def piece_counts(self, piece: str) -> list[int]:
        """Token counts of the piece's prefixes of 1, 2, ... characters."""
        raw = piece.encode("utf-8", "replace")
        n = len(raw)
        count: list[int] = [0] * (n + 1)
        last: list[bytes | None] = [b"", *[None] * n]
        at = 0
        for k, token in enumerate(self.encoder._core_bpe.encode_single_piece(raw)):
            start, at = at, at + self.token_bytes[token]
            count[at], last[at] = k + 1, raw[start:at]
        ranks, unmerged, lengths = self.ranks, self._unmerged, self.lengths
        for i in range(1, n + 1):
            if last[i] is None:
                for m in (1, *lengths.get(raw[i - 2 : i], ())) if i > 1 else (1,):
                    j = i - m
                    # the token of a prefix is unique, see the module's text
                    if j >= 0 and (token := raw[j:i]) in ranks and (j == 0 or unmerged(last[j], token)):
                        count[i], last[i] = count[j] + 1, token
                        break
        return [count[i] for i in range(1, n + 1) if i == n or raw[i] & 0xC0 != 0x80]

    def _deltas(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        if known is None:
            if len(self.pieces) >= _KEPT_PIECES:
                self.pieces.clear()
            counts = self.piece_counts(piece)
            if len(piece) <= 64:
                # a change is over -128 and under 5, by the recurrence
                known = self.pieces[piece] = bytes([b - a & 0xFF for a, b in zip([0, *counts], counts)])
            else:
                known = _signed_bytes(np.diff(np.array(counts, np.int64), prepend=0))
        return known

    def deltas(self, text: str) -> bytes:
        """Change of the count at each character, as signed bytes."""
        if not text.isascii():
            text = text.encode("utf-8", "replace").decode("utf-8")
        pieces = _SPLIT.findall(text)
        kept = self.pieces
        try:
            out = b"".join([kept[p] for p in pieces])
        except KeyError:
            out = b"".join([self._deltas(p) for p in pieces])
        if _LOOKAHEAD.search(text):
            out = self._patched(pieces, np.frombuffer(out, np.int8).astype(np.int64))
        return out

    def _patched(self, pieces: list[str], delta: np.ndarray) -> bytes:
        count, at = np.cumsum(delta), 0
        fixed = count.copy()
        for before, piece in zip([""] + pieces, pieces):
            base = int(count[at - 1]) if at else 0
            if before.isspace() and piece[0].isspace():
                # so far the run is one piece
                start = at - len(before)
                fixed[at] = (int(count[start - 1]) if start else 0) + self.piece_counts(before + piece[0])[-1]
            elif len(piece) == 3 and piece in ("'ll", "'ve", "'re"):
                fixed[at + 1] = base + self.piece_counts("'")[-1] + self.piece_counts(piece[1])[-1]
            at += len(piece)
        return _signed_bytes(np.diff(fixed, prepend=0))


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str = VOCABULARY) -> PrefixCounter:
    """One counter for each vocabulary and Python worker."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(os.fspath(path))
    return _COUNTERS[path]


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """Tokens of the whole text, as a long; null for null."""

    @F.pandas_udf("long")
    def total(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else c.total(t)).astype("Int64")

    return total(text)


def prefix_deltas(text: Column | str, path: str = VOCABULARY) -> Column:
    """The stored form: a binary with one signed byte for each character."""

    @F.pandas_udf("binary")
    def deltas(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for texts in batches:
            yield texts.map(lambda t: None if t is None else c.deltas(t))

    return deltas(text)


def _counts(stored: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(stored, np.int8), dtype=np.int64)


def count_at(stored: Column | str, n: int | Column) -> Column:
    """Tokens of the first n characters (all, where the text is shorter)."""

    @F.pandas_udf("long")
    def at(s: pd.Series, k: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or pd.isna(m) else int(np.frombuffer(b, np.int8)[: max(int(m), 0)].sum(dtype=np.int64)) for b, m in zip(s, k)], dtype="Int64")

    return at(stored, F.lit(n) if isinstance(n, int) else n)


def _cuts(stored: bytes, budgets: tuple[int, ...]) -> list[int]:
    """The longest prefixes, in characters, whose counts are within the budgets."""
    counts = _counts(stored)
    out = []
    for b in budgets:
        if not len(counts) or counts.max() <= b:
            out.append(len(counts))
        else:
            fits = np.flatnonzero(counts <= b)
            out.append(int(fits[-1]) + 1 if len(fits) else 0)
    return out


def cut_at(stored: Column | str, budget: int) -> Column:
    """Length in characters of the longest prefix of at most ``budget`` tokens."""

    @F.pandas_udf("long")
    def cut(s: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else _cuts(b, (budget,))[0] for b in s], dtype="Int64")

    return cut(stored)


def fits(stored: Column | str, budget: int) -> Column:
    """Whether the whole text is within ``budget`` tokens."""
    return F.coalesce(count_at(stored, 2**31 - 1) <= budget, F.lit(False))


def prefix_index(docs: DataFrame, path: str = VOCABULARY, budgets: tuple[int, ...] = BUDGETS) -> DataFrame:
    """doc_id, n_chars, n_tokens, cut_<budget> for each budget, prefix_deltas: one row a document."""
    cuts = [f"cut_{b}" for b in budgets]

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = counter(path)
        for rows in batches:
            stored = [None if t is None else c.deltas(t) for t in rows["text"]]
            counts = [None if s is None else (len(s), int(np.frombuffer(s, np.int8).sum(dtype=np.int64)), *_cuts(s, budgets)) for s in stored]
            out = pd.DataFrame({"doc_id": rows["doc_id"]})
            for k, name in enumerate(["n_chars", "n_tokens", *cuts]):
                out[name] = pd.array([None if x is None else x[k] for x in counts], dtype="Int64")
            out["prefix_deltas"] = pd.Series(stored, index=rows.index, dtype=object)
            yield out

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars long, n_tokens long, {', '.join(f'{c} long' for c in cuts)}, prefix_deltas binary"
    return docs.select("doc_id", "text").mapInPandas(index, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_index(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
