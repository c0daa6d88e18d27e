"""Substring dedup by unit hashing: repeated passages, all but the earliest removed.

A unit is a sentence or line, whatever its length. Every two neighbours of a text
are hashed as one, and so is a unit of ``min_words`` words alone; neighbouring
repeated pairs are joined, and a run is a passage if it has ``min_words`` words.
Units so hang on their own text alone: what surrounds a passage hides only the
pieces of sentences at its two ends. ``lines=True`` takes whole lines of
``min_words`` words as passages instead. Words are lowered (A-Z) and spaces made
one before they are hashed to 64 bits. Of equal pairs or units the earliest, by
(doc_id, place), is kept; every other is cut, overlapping cuts joined, and
reported with its byte range in the original UTF-8 text and the keeper's id.

Scale. One pass over the texts writes a row or two a unit (four longs). Rows that a
batch holds several times are settled there, all but the least being certain to
go, so a passage that a third of all units repeat is one row a batch in the one
shuffle that groups digests; what is settled is dealt by document. Texts meet their
marks by a shuffle at every size, as the marks grow with the texts.

Cases. Null, empty and shorter texts have no passages. A repeated row (same id and
text) is one document and both rows are treated alike. Rows with a null id are
unchanged and take no part. Empty tables give no rows. :func:`dedup_units`
keeps all other columns; a document may be left with an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm import _text as tx
from gridloom.llm._run import map_arrow, multi_runs, packed, unpacked, written
from gridloom.llm.line_dedup import cut

MIN_WORDS = 20
_END = tx.class_table(b".!?")
_CLOSE = tx.class_table(b"\"')]}")
#: Sentence ends of other scripts, as the last three (or two) bytes of a word.
_ENDS3 = [int.from_bytes(c.encode(), "big") for c in "\u3002\uff01\uff1f\u0964\u2026"]
_ENDS2 = [int.from_bytes(c.encode(), "big") for c in "\u06d4\u061f"]
_U = np.uint64


def _sentence_ends(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that end a sentence, closing quotes and brackets aside."""
    stop = end.copy()
    for mark in (b"\xe2\x80\x9d", b"\xc2\xbb"):
        n = len(mark)
        on = stop - start > n
        for k in range(n):
            on[on] = low[stop[on] - n + k] == mark[k]
        stop[on] -= n
    for _ in range(2):
        stop -= _CLOSE[low[stop - 1]] & (stop - start > 1)
    last = _END[low[stop - 1]]
    wide = np.flatnonzero((low[stop - 1] >= 128) & (stop - start >= 2))
    z = stop[wide]
    two = (low[z - 2].astype(np.int64) << 8) | low[z - 1]
    three = two | np.where(z - start[wide] >= 3, low[np.maximum(z - 3, 0)].astype(np.int64) << 16, 0)
    last[wide] = np.isin(two, _ENDS2) | np.isin(three, _ENDS3)
    return last


def unit_spans(raw: np.ndarray, off: np.ndarray, min_words: int, lines: bool):
    """First and last word, digest, row and pair (0 or 1) of each long unit and pair of units, and words' start and end bytes."""
    low = tx.LOWER[raw]
    start, end, first = tx.spans(low, off, tx.NONSPACE)
    n = len(start)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none, none, start, end
    feeds = np.concatenate([[0], np.cumsum(low == 10)])
    last = np.ones(n, bool)
    last[:-1] = feeds[start[1:]] > feeds[end[:-1]]
    if not lines:
        last |= _sentence_ends(low, start, end)
    rows = np.flatnonzero(np.diff(first))
    last[first[rows + 1] - 1] = True
    begins = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    stop = np.flatnonzero(last)
    row = np.searchsorted(first, begins, "right") - 1
    pick = np.flatnonzero(stop - begins + 1 >= min_words)
    pair = np.zeros(len(pick), np.int64)
    if not lines:
        two = np.flatnonzero(row[1:] == row[:-1])
        pick, pair = np.concatenate([pick, two]), np.concatenate([pair, np.ones(len(two), np.int64)])
    begins, stop, row = begins[pick], stop[pick + pair], row[pick]
    h = tx.span_hashes(low, start, end)
    power, inverse = tx._powers(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(h * power[:n], out=run[1:])
    digest = tx.splitmix((run[stop + 1] - run[begins]) * inverse[begins] + (stop - begins).astype(np.uint64))
    return begins, stop, digest, row, pair, start, end


def _unit_rows(min_words: int, lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            th = b.column("th").to_numpy()
            digest, doc, at = [], [], []
            for a, _, raw, off in tx.chunks(b.column("text")):
                begins, _, d, row, pair, start, _ = unit_spans(raw, off, min_words, lines)
                digest.append(d.view(np.int64))
                doc.append(ids[row + a])
                at.append((th[row + a] << 32) | ((start[begins] - off[row]) << 1) | pair)
            if not digest:
                continue
            digest, doc, at = map(np.concatenate, (digest, doc, at))
            order = np.lexsort((at, doc, digest))
            digest, doc, at = digest[order], doc[order], at[order]
            head = np.concatenate([[True], digest[1:] != digest[:-1]]) if len(digest) else np.zeros(0, bool)
            keeper = doc[head][np.cumsum(head) - 1] if len(digest) else doc
            yield pa.RecordBatch.from_arrays(
                [pa.array(digest), pa.array(doc), pa.array(at), pa.array(keeper, mask=head)], names=["digest", "doc_id", "at", "keeper"]
            )

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows to cut (doc_id, at, keeper) from unit rows sorted by digest and place."""
    passed: list[pa.RecordBatch] = []

    def heads() -> Iterator[pa.RecordBatch]:
        for b in batches:
            null = b.column("keeper").is_null()
            if b.column("keeper").null_count < b.num_rows:
                passed.append(b.filter(pc.invert(null)).select(["doc_id", "at", "keeper"]))
                b = b.filter(null)
            yield b.select(["digest", "doc_id", "at"])

    for g in multi_runs(heads(), "digest"):
        while passed:
            yield passed.pop()
        order = np.lexsort((g["at"], g["doc_id"]))
        doc, at = g["doc_id"][order], g["at"][order]
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[1:]), pa.array(at[1:]), pa.array(np.full(len(doc) - 1, doc[0]))], names=["doc_id", "at", "keeper"]
        )
    while passed:
        yield passed.pop()


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, lines: bool = False) -> DataFrame:
    """(doc_id, th, marks): repeated units and pairs of each text, as twice their first byte (plus one for a pair)
    and the id that keeps them; ``th`` is the low half of the text's xxhash64.
    """
    docs = docs.filter("doc_id is not null and text is not null")
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("th"), "text")
    rows = map_arrow(rows, _unit_rows(min_words, lines), "digest long, doc_id long, at long, keeper long")
    rows = rows.withColumn("to", F.when(F.col("keeper").isNull(), F.col("digest")).otherwise(F.col("doc_id")))
    rows = rows.repartition("to").drop("to").sortWithinPartitions("digest", "doc_id")
    gone = map_arrow(rows, _settle, "doc_id long, at long, keeper long")
    th = F.shiftrightunsigned("at", 32)
    gone = gone.groupBy("doc_id", th.alias("th")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at"), "keeper"))).alias("marks")
    )
    return written(gone)


def _with_cuts(docs: DataFrame, gone: DataFrame, min_words: int, lines: bool, how: str) -> DataFrame:
    """``docs`` with _cuts (byte ranges, joined) and _keepers; both null where nothing is cut.
    ``how`` is left, or inner for those documents alone that hold a mark."""
    gone = gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("marks").alias("_marks"))
    match = (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)) == F.col("_th"))
    out = docs.join(gone, match, how).drop("_id", "_th")
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    names = [c for c in kinds if c != "_marks"] + ["_cuts", "_keepers"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            cuts: list[list[dict[str, int]] | None] = [None] * b.num_rows
            keepers: list[list[int] | None] = [None] * b.num_rows
            text = b.column("text")
            for i, m in enumerate(b.column("_marks").to_pylist()):
                if m:
                    raw, off = tx.buffers(text.slice(i, 1))
                    begins, stop, _, _, pair, start, end = unit_spans(raw, off, min_words, lines)
                    spot = {k: (x, y) for k, x, y in zip(((start[begins] << 1) | pair).tolist(), begins.tolist(), stop.tolist())}
                    runs: list[tuple[int, int, set[int]]] = []  # first word, last word, keepers
                    for x, y, keeper in sorted((*spot[g["at"]], g["keeper"]) for g in m):
                        if runs and x <= runs[-1][1]:
                            runs[-1] = (runs[-1][0], max(y, runs[-1][1]), runs[-1][2] | {keeper})
                        else:
                            runs.append((x, y, {keeper}))
                    long = [r for r in runs if r[1] - r[0] + 1 >= min_words]
                    if long:
                        cuts[i] = [{"first": int(start[x]), "end": int(end[y])} for x, y, _ in long]
                        keepers[i] = sorted(set().union(*(k for *_, k in long)))
            new = {"_cuts": pa.array(cuts, kind), "_keepers": pa.array(keepers, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_arrays([new[c] if c in new else b.column(c) for c in names], names=names)

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names[:-2]) + ", _cuts array<struct<first:long,end:long>>, _keepers array<long>"
    return map_arrow(out, run, schema)


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS, lines: bool = False) -> DataFrame:
    """The documents without repeated units; all columns are kept, and n_chars, if there, follows the text."""
    return unpacked(cut(_with_cuts(packed(docs), repeats(docs, min_words, lines), min_words, lines, "left"), "text", "_cuts"), docs)


def repeat_report(docs: DataFrame, min_words: int = MIN_WORDS, lines: bool = False) -> DataFrame:
    """One row for each document that loses something: doc_id, n_removed, n_bytes_removed, removed (byte
    ranges in the original text), kept_ids (documents that keep the passages) and text_sha256 of what is left."""
    out = _with_cuts(docs.select("doc_id", "text"), repeats(docs, min_words, lines), min_words, lines, "inner")
    out = out.filter(F.size("_cuts") > 0)
    size = F.aggregate("_cuts", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["first"])
    out = out.withColumns({"removed": F.col("_cuts"), "n_removed": F.size("_cuts").cast("long"), "n_bytes_removed": size})
    return cut(out, "text", "_cuts").select(
        "doc_id", "n_removed", "n_bytes_removed", "removed", F.col("_keepers").alias("kept_ids"), F.sha2("text", 256).alias("text_sha256")
    )
