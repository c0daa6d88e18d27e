"""Token counts of byte-level BPE by heap-and-linked-list merging, without identifiers.

A text is cut at the vocabulary's special strings (each counts one), then into
pretokens by the vocabulary's pattern. A pretoken starts as its bytes, linked
left to right; a heap holds adjacent pairs by merge rank, and the lowest rank
(leftmost on ties) is merged until no pair has a rank. Its count is the bytes
less the merges. Counts of pretokens are kept per worker in a table of at most
``CACHE`` entries, which is emptied when full; that changes speed only.

Rows are independent: no shuffle, memory bounded by one Arrow batch and the
table. Null and empty texts count 0; ties, repeated rows and very long texts
need nothing special. Extra columns are dropped.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from gridloom.llm._run import map_arrow

CACHE = 1_000_000


def byte_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files.

    Printable Latin-1 bytes stand for themselves; the others are numbered on from U+0100.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class PretokenCounts(dict):
    """Pretoken string to its number of tokens, filled by merging on a miss."""

    def __init__(self, ranks: dict[tuple[bytes, bytes], int], limit: int = CACHE):
        self.ranks, self.limit = ranks, limit

    def __missing__(self, token: str) -> int:
        raw = token.encode()
        n = merged_length([raw[i : i + 1] for i in range(len(raw))], self.ranks)
        if len(self) >= self.limit:
            self.clear()
        self[token] = n
        return n


def merged_length(symbols: list[bytes], ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left when the lowest-ranked adjacent pair is merged for as long as there is one."""
    n = len(symbols)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        rank = ranks.get((symbols[i], symbols[i + 1]))
        if rank is not None:
            heap.append((rank, i, symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    alive, merges = symbols, 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] is a else n
        if j >= n or alive[j] is not b:
            continue  # one of the two has been merged since
        alive[i], alive[j] = a + b, None
        merges += 1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            rank = ranks.get((alive[i], alive[k]))
            if rank is not None:
                heapq.heappush(heap, (rank, i, alive[i], alive[k]))
        h = left[i]
        if h >= 0:
            rank = ranks.get((alive[h], alive[i]))
            if rank is not None:
                heapq.heappush(heap, (rank, h, alive[h], alive[i]))
    return n - merges


class Vocabulary:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_symbols()
        single = {}

        def raw(symbol: str) -> bytes:
            made = bytes(to_byte[c] for c in symbol)
            return single.setdefault(made, made)

        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.counts = PretokenCounts({(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)})
        #: The pattern of the byte-level pretokenizer (fixed value).
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None

    def count(self, text: str) -> int:
        if self.special is not None and self.special.search(text):
            parts = self.special.split(text)
            return len(parts) - 1 + sum(self.plain(p) for p in parts)
        return self.plain(text)

    def plain(self, text: str) -> int:
        return sum(map(self.counts.__getitem__, self.pattern.findall(text)))


_OPEN: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """A worker opens a vocabulary once."""
    if path not in _OPEN:
        _OPEN[path] = Vocabulary(path)
    return _OPEN[path]


def token_counts(
    docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512
) -> DataFrame:
    """``id_col``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > ``limit``) of every row.

    ``vocabulary_path`` names a byte-level BPE ``tokenizer.json`` that every executor can open.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "")
            n = np.fromiter((vocab.count(t.as_py()) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.cast(pc.binary_length(texts), pa.int64()), pa.array(n), pa.array(n > limit)],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return map_arrow(
        docs.select(id_col, text_col), count, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
