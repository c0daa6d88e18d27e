"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Texts are lower-cased (A-Z only) and cut into runs of ASCII letters, digits and
non-ASCII characters. Patterns are the windows of ``window`` consecutive words
of each benchmark item; an item of fewer words, but not none, is one pattern.
Patterns of one length m are searched together, as Wu and Manber do it, with
words as the symbols: a shift table, indexed by a hash of a block of B = 2
words (1 where m = 1), says how far a position may jump, 0 meaning that some
pattern ends in that block; a bucket by the hash of the last words selects the
patterns to test; the words' bytes are then compared directly. Many stretches
of a batch advance at once, so a step is an array operation.

Scale. A document is searched where it is read: no shuffle, and the text is
never moved. The benchmark is read in blocks of about ``BLOCK`` bytes, each of
them broadcast alone (the bound of what is broadcast); a benchmark that needs
more blocks adds a pass over the documents per block, without any shuffle.

Cases. Null texts have no words. An item with a null id marks words but is not
listed or counted. Items with the same text, and repeated item rows, are found
together and listed once an id. Empty tables give no rows, or no hits. Very
long texts are searched whole. Extra columns are dropped; clashing names can't
clash. Repeated documents are answered row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text as tx
from gridloom.llm._run import map_arrow, packed

BLOCK = 16 << 20
TABLE = 1 << 18
STRETCH = 128


class Patterns:
    """Tables of the patterns of one length, in words."""

    def __init__(self, m: int):
        self.m, self.b = m, min(2, m)
        self.ids: dict[bytes, set[str]] = {}

    def add(self, pattern: bytes, item: str | None) -> None:
        self.ids.setdefault(pattern, set()).update([] if item is None else [item])

    def build(self) -> Patterns:
        self.texts = list(self.ids)
        self.items = [sorted(self.ids[t]) for t in self.texts]
        del self.ids
        arr = pa.array([t.decode() for t in self.texts], pa.large_string())
        m, b = self.m, self.b
        self.shift = np.full(TABLE, m - b + 1, np.int16)
        tails = []
        for _, _, raw, off in tx.chunks(arr):
            _, _, _, first, h = tx.words(raw, off)
            start = first[:-1]
            for q in range(b, m + 1):  # blocks that end at word q of the pattern
                at = block_hash(h, start + q - 1, b)
                np.minimum.at(self.shift, (at & tx._U(TABLE - 1)).astype(np.int64), np.int16(m - q))
            tails.append(tail_hash(h, start + m - 1, m))
        tail = np.concatenate(tails) if tails else np.zeros(0, np.uint64)
        self.order = np.argsort(tail, kind="stable")
        self.tail = tail[self.order]
        return self


def block_hash(h: np.ndarray, last: np.ndarray, b: int) -> np.ndarray:
    return tx.splitmix(h[last] ^ (h[last - 1] * tx._U(3) if b == 2 else tx._U(0)))


def tail_hash(h: np.ndarray, last: np.ndarray, m: int) -> np.ndarray:
    """The suffix of up to three words that chooses a bucket."""
    out = h[last].copy()
    for k in range(1, min(3, m)):
        out = out * tx._U(0xF1357AEA2E62A9C5) + h[last - k]
    return tx.splitmix(out)


def search(p: Patterns, low: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, h: np.ndarray):
    """(first word, pattern) of every occurrence of ``p`` in a chunk's words."""
    m, n = p.m, len(h)
    rows = np.flatnonzero(np.diff(first) >= m)
    if not len(rows):
        return
    # stretches of last-word positions, so that long and short documents advance alike
    lo, hi = first[rows] + m - 1, first[rows + 1]
    parts = (hi - lo + STRETCH - 1) // STRETCH
    at = np.repeat(lo, parts)
    nth = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    pos = at + nth * STRETCH
    stop = np.minimum(pos + STRETCH, np.repeat(hi, parts))
    block = np.zeros(n, np.uint64)
    ends = np.arange(p.b - 1, n)
    block[p.b - 1 :] = block_hash(h, ends, p.b)
    jump = p.shift[(block & tx._U(TABLE - 1)).astype(np.int64)].astype(np.int64)
    ripe = []
    while len(pos):
        step = jump[pos]
        zero = step == 0
        if zero.any():
            ripe.append(pos[zero])
        pos = pos + np.maximum(step, 1)
        keep = pos < stop
        pos, stop = pos[keep], stop[keep]
    if not ripe:
        return
    last = np.concatenate(ripe)
    key = tail_hash(h, last, m)
    a, b = np.searchsorted(p.tail, key, "left"), np.searchsorted(p.tail, key, "right")
    for i in np.flatnonzero(b > a):
        w = int(last[i]) - m + 1
        words = b" ".join(low[s:e].tobytes() for s, e in zip(start[w : w + m], end[w : w + m]))
        for k in p.order[a[i] : b[i]]:
            if p.texts[k] == words:
                yield w, k


def normal_words(text: str) -> list[bytes]:
    """The words of one text; the plain form of what the kernels do in arrays."""
    low = tx.LOWER[np.frombuffer(text.encode(), np.uint8)]
    start, end, _ = tx.spans(low, np.array([0, len(low)]), tx.WORD)
    return [low[s:e].tobytes() for s, e in zip(start, end)]


def pattern_blocks(benchmark: DataFrame, window: int, block_bytes: int = BLOCK) -> Iterator[list[Patterns]]:
    """Pattern tables of successive blocks of items, each block of about ``block_bytes`` of pattern text."""
    kinds: dict[int, Patterns] = {}
    size = 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text is not null")
    for row in rows.toLocalIterator():
        words = normal_words(row["text"])
        m = min(window, len(words))
        for i in range(len(words) - m + 1 if m else 0):
            pattern = b" ".join(words[i : i + m])
            kinds.setdefault(m, Patterns(m)).add(pattern, row["item_id"])
            size += len(pattern)
            if size >= block_bytes:
                yield [p.build() for p in kinds.values()]
                kinds, size = {}, 0
    if kinds:
        yield [p.build() for p in kinds.values()]


def _scan(shared: Broadcast, columns: list[str], first_pass: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[Patterns] = shared.value
        for batch in batches:
            text = batch.column("text")
            spans: list[list[int]] = [[] for _ in range(batch.num_rows)]
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            n_words = np.zeros(batch.num_rows, np.int64)
            for a, b, raw, off in tx.chunks(text):
                low, start, end, first, h = tx.words(raw, off)
                n_words[a:b] = np.diff(first)
                for p in kinds:
                    for w, k in search(p, low, start, end, first, h):
                        row = int(np.searchsorted(first, w, "right")) - 1
                        spans[a + row] += (w - int(first[row]), w - int(first[row]) + p.m)
                        items[a + row].update(p.items[k])
            if not first_pass:
                for i, (s, t) in enumerate(zip(batch.column("_spans").to_pylist(), batch.column("_items").to_pylist())):
                    spans[i] += s
                    items[i].update(t)
            own = {
                "_words": pa.array(n_words),
                "_spans": pa.array(spans, pa.list_(pa.int64())),
                "_items": pa.array([sorted(x) for x in items], pa.list_(pa.string())),
            }
            yield pa.RecordBatch.from_arrays([own.get(c, None) if c in own else batch.column(c) for c in columns], names=columns)

    return scan


def find_occurrences(
    docs: DataFrame, benchmark: DataFrame, window: int = 10, block_bytes: int = BLOCK
) -> DataFrame:
    """The columns of ``docs``, which has a text, with _words (count), _spans (word ranges of
    occurrences, flat) and _items (ids of the items found)."""
    spark = docs.sparkSession
    out = docs
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    columns = [*kinds, "_words", "_spans", "_items"]
    schema = ", ".join(f"`{c}` {t}" for c, t in kinds.items()) + ", _words long, _spans array<long>, _items array<string>"
    first = True
    for block in pattern_blocks(benchmark, window, block_bytes):
        out = map_arrow(out, _scan(spark.sparkContext.broadcast(block), columns, first), schema)
        first = False
    if first:  # no patterns at all
        out = map_arrow(out, _scan(spark.sparkContext.broadcast([]), columns, True), schema)
    return out


def _hit_words(spans: np.ndarray) -> int:
    """Words inside any of the ranges."""
    if not len(spans):
        return 0
    lo, hi = spans[0::2], spans[1::2]
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    prev = np.concatenate([[0], hi[:-1]])
    return int(np.maximum(hi - np.maximum(lo, prev), 0).sum())


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    found = find_occurrences(docs.select("doc_id", "text"), benchmark, window).drop("text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [_hit_words(np.asarray(s.values)) if len(s.values) else 0 for s in b.column("_spans")]
            items = b.column("_items").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("_words"), pa.array(hit, pa.int64()),
                    pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]),
                    pa.array([x > 0 for x in hit], pa.bool_()),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(
        found, digest, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents in which no benchmark window occurs, with all their columns."""
    found = find_occurrences(packed(docs).drop("doc_id"), benchmark, window)
    return found.filter(F.size("_spans") == 0).select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


ORACLE = r"""
WITH iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL
), p AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i + 1 : i + least(len(w), 10)], ' ') AS pat
  FROM (SELECT item, w, unnest(range(len(w) - least(len(w), 10) + 1)) AS i FROM iw WHERE len(w) > 0)
), dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents
), win AS (
  SELECT rid, i, m, array_to_string(w[i + 1 : i + m], ' ') AS pat
  FROM (SELECT rid, w, m, unnest(range(len(w) - m + 1)) AS i FROM dw, (SELECT DISTINCT m FROM p) WHERE len(w) >= m)
), hit AS (SELECT rid, i, win.m AS m, item FROM win JOIN p ON win.pat = p.pat AND win.m = p.m),
hw AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + m)) AS k FROM hit) GROUP BY rid),
it AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (rid) LEFT JOIN it USING (rid)
"""
