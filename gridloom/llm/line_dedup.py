"""Fuzzy line dedup: MinHash bands, exact Jaccard checks, distributed union-find.

Lines are runs of bytes between line feeds, compared in lower case (A-Z); lines
without letters, digits or non-ASCII characters are left alone. A line's set is
its ``SHINGLE`` consecutive bytes (five; a shorter line is one shingle). Lines
equal in lower case are one line from the start, identified by a 64-bit hash.

1. Signatures. One permutation dealt over ``ROWS * BANDS`` bins gives each
   distinct line its minima (empty bins take the next one's), and each band of
   ``ROWS`` minima a bucket. At similarity 0.8 a pair shares one of 12 buckets
   of 5 rows with probability 0.99, at 0.3 with 0.03.
2. Groups. Each line carries 60 bits of its minima, and lines of a bucket that agree
   on so many of them as similarity 0.8 gives (less three standard errors) may be
   near. Within a batch a line that passes the exact check with the first of its
   bucket leaves the bucket; all others meet globally, and each is linked to the
   first of its bucket that it agrees with.
3. Checks. Each link is checked by the exact Jaccard similarity of the lines' bytes.
   Then, in buckets whose lines are not all in one component, each line is compared
   with those of other components that it agrees with, in pairs of blocks where
   a bucket is large. No pairs are emitted but those that are near and join two.
4. Union-find on the checked links; the earliest occurrence (by doc_id, then
   place) of each component stays, all others are cut out with their line feed.

Texts are read three times: for signatures, for the places (and bytes) of the lines
that occur twice or may be near, and for the cuts. The second reading knows those
lines by Bloom filters that are sized by their count, up to a bound; a fuller filter
only lets more lines through. What a batch holds of a line after its first place is
sure to go and is not joined, so a line that a third of all texts hold is a row a batch.

Cases. A null text stays null, an empty text empty. A document whose lines all
go stays, with an empty text, unless :func:`dedup_lines` is told to drop it. A repeated row (same id and text) is one document
and both rows keep the same lines. Rows with a null id are unchanged and take
no part. Empty tables give no rows. All other columns are kept, whatever their
names, as one struct that travels beside the text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from gridloom.llm import _text as tx
from gridloom.llm._run import map_arrow, packed, sized, unpacked, written
from gridloom.llm._run import runs as run_tables
from gridloom.llm.components import components

SHINGLE, ROWS, BANDS = 5, 5, 12
_BINS = ROWS * BANDS
_LINE = tx.class_table(bytes(x for x in range(256) if x != 10))
_U = np.uint64
_NONE = _U(0xFFFFFFFFFFFFFFFF)


def line_spans(raw: np.ndarray, off: np.ndarray, ids: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lowered bytes, start, end, lines before each row, and (if wanted) ids of the lines that hold a word."""
    low = tx.LOWER[raw]
    start, end, first = tx.spans(low, off, _LINE)
    if len(start):
        some = np.maximum.reduceat(tx.WORD[low].view(np.uint8), start) > 0  # a line and the line feeds after it
        first = np.concatenate([[0], np.cumsum(some)])[first]
        start, end = start[some], end[some]
    view = memoryview(low.tobytes())
    spots = zip(start.tolist(), end.tolist()) if ids else ()
    return low, start, end, first, np.fromiter((xxh3_64_intdigest(view[a:b]) for a, b in spots), np.uint64)


def _codes(low: np.ndarray) -> np.ndarray:
    """The five bytes from each place on, as one number."""
    padded = np.concatenate([low, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(low),), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    return eight & _U((1 << (8 * SHINGLE)) - 1)


def _shingles(low: np.ndarray) -> np.ndarray:
    code = np.sort(_codes(low)[: max(len(low) - SHINGLE + 1, 1)])
    return code[np.concatenate([[True], code[1:] != code[:-1]])]


def line_set(line: bytes) -> np.ndarray:
    """The sorted distinct shingles of one line."""
    return _shingles(np.frombuffer(line, np.uint8))


def band_keys(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``BANDS`` bucket keys of each line, and its sketch: a bit of each minimum above four bits of size."""
    n = len(start)
    sizes = np.maximum(end - start - SHINGLE + 1, 1)
    code = _codes(low)
    short = end - start < SHINGLE
    edge = np.zeros(len(low) + 1, np.int8)
    edge[start] = 1
    edge[start + sizes] -= 1
    v = code[np.cumsum(edge[:-1], dtype=np.int8).view(bool)]
    if short.any():  # a short line's one shingle ends with the line
        place = (np.cumsum(sizes) - sizes)[short]
        v[place] &= (_U(1) << (_U(8) * (end - start)[short].astype(np.uint64))) - _U(1)
    v *= _U(0xD6E8FEB86659FD93)
    v ^= v >> _U(32)
    v *= _U(0xD6E8FEB86659FD93)
    cell = np.repeat(np.arange(n) * _BINS, sizes) + ((v >> _U(32)) * _U(_BINS) >> _U(32)).astype(np.int64)
    least = np.full(n * _BINS, _NONE)
    np.minimum.at(least, cell, v)
    # an empty bin takes the next full one of its line, moved by the distance
    gaps = np.flatnonzero(least == _NONE)
    base, row, own = least.copy(), gaps // _BINS * _BINS, gaps % _BINS
    todo, far = np.arange(len(gaps)), 0
    while len(todo):
        far += 1
        value = base[row[todo] + (own[todo] + far) % _BINS]
        full = value != _NONE
        least[gaps[todo[full]]] = value[full] + _U(far * 0x9E3779B97F4A7C15 % 2**64)
        todo = todo[~full]
    least = least.reshape(n, _BINS)
    bits = (tx.splitmix(least) & _U(1)) << (np.arange(_BINS, dtype=np.uint64) + _U(4))[None, :]
    sketch = np.bitwise_or.reduce(bits, 1) | np.minimum(sizes // 4, 15).astype(np.uint64)
    least = least.reshape(n, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for r in range(ROWS):
        key = tx.splitmix(key * _U(0xF1357AEA2E62A9C5) + least[:, :, r])
    return key & ~_U(15) | np.arange(BANDS, dtype=np.uint64), sketch  # the low bits tell the band


#: Bits of 60 on which sketches must agree, by the smaller size class: three standard errors under what
#: similarity 0.8 gives, where a line of few shingles has only so many bins of its own.
_AGREE = np.array([math.floor(_BINS * (0.9 - 3 * math.sqrt(0.09 / min(max(4 * k, 2), _BINS)))) for k in range(16)])


def sketches_agree(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    same = _BINS - np.bitwise_count((x ^ y) >> _U(4)).astype(np.int64)
    return same >= _AGREE[np.minimum(x & _U(15), y & _U(15)).astype(np.int64)]


def _rows(key: np.ndarray, line: np.ndarray, mark: np.ndarray, null: bool = False) -> pa.RecordBatch:
    first = pa.nulls(len(line), pa.int64()) if null else pa.array(key)
    return pa.RecordBatch.from_arrays([first, pa.array(line), pa.array(mark)], names=["key", "line", "mark"])


def _first_of_run(key: np.ndarray) -> np.ndarray:
    head = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
    return np.flatnonzero(head)[np.cumsum(head) - 1] if len(key) else np.zeros(0, np.int64)


def bucket_rows(t: float):
    """(key, line, sketch) of each batch's lines, and (null, line, other) of each that is known to be near a
    line of its batch, or (null, line, line) if the batch holds it twice.

    Only a line that passed the exact check with the first of its bucket leaves the bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lines, marks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
            seen, twice = np.zeros(0, np.uint64), [np.zeros(0, np.uint64)]
            held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # bytes, starts and ends of new lines
            chunk, place = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for _, _, raw, off in tx.chunks(batch.column(0)):
                low, start, end, _, ids = line_spans(raw, off)
                ids, at, n = np.unique(ids, return_index=True, return_counts=True)
                new = ~np.isin(ids, seen, assume_unique=True)
                twice.append(ids[(n > 1) | ~new])
                order = np.argsort(at[new])  # by place, as band_keys takes them
                ids, at = ids[new][order], at[new][order]
                seen = np.concatenate([seen, ids])
                if len(ids):
                    key, sketch = band_keys(low, start[at], end[at])
                    keys.append(key.ravel().view(np.int64))
                    lines.append(np.repeat(ids.view(np.int64), BANDS))
                    marks.append(np.repeat(sketch, BANDS))
                    chunk.append(np.full(len(ids) * BANDS, len(held)))
                    place.append(np.repeat(np.arange(len(ids)), BANDS))
                    held.append((low, start[at], end[at]))
            key, line, mark, chunk, place = map(np.concatenate, (keys, lines, marks, chunk, place))
            order = np.lexsort((line, key))
            key, line, mark = key[order], line[order], mark[order]
            first = _first_of_run(key)
            near = np.zeros(len(key), bool)
            maybe = np.flatnonzero(first != np.arange(len(key)))
            maybe = maybe[sketches_agree(mark[maybe], mark[first[maybe]])]
            if len(maybe):
                pairs, at, back = np.unique(np.stack([line[maybe], line[first[maybe]]]), axis=1, return_index=True, return_inverse=True)

                def of(i: int) -> np.ndarray:
                    low, start, end = held[chunk[order[i]]]
                    k = place[order[i]]
                    return _shingles(low[start[k] : end[k]])

                sets: dict[int, np.ndarray] = {}
                ok = np.zeros(len(at), bool)
                for j, i in enumerate(maybe[at].tolist()):
                    lead = int(first[i])
                    if int(line[lead]) not in sets:
                        sets[int(line[lead])] = of(lead)
                    ok[j] = _alike(of(i), sets[int(line[lead])], t)
                near[maybe[ok[back.ravel()]]] = True
                yield _rows(pairs[0], pairs[0][ok], pairs[1][ok], null=True)
            again = np.unique(np.concatenate(twice)).view(np.int64)
            yield _rows(again, again, again, null=True)
            yield _rows(key[~near], line[~near], mark[~near].view(np.int64))

    return run


def _leaders(key: np.ndarray, line: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's leader in its run: the first line, or the first that agrees of those left; and the rows that
    have one, are one, or agree with any other of their run."""
    lead = np.arange(len(key))
    first = _first_of_run(key)
    rest = np.flatnonzero(first != lead)
    while len(rest):
        near = sketches_agree(mark[rest], mark[first[rest]])
        lead[rest[near]] = first[rest[near]]
        rest = rest[~near]
        if len(rest):
            first = first.copy()
            first[rest] = rest[_first_of_run(key[rest])]
            rest = rest[first[rest] != rest]
    some = np.zeros(len(key), bool)
    on = np.flatnonzero(lead != np.arange(len(key)))
    some[on], some[lead[on]] = True, True
    return lead, some


def bucket_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, line, lead, mark) of every line that agrees with a line of its bucket, from bucket rows sorted by key and
    line; (null, line, other, null) for what is known, with other = line for a line that several batches hold."""

    def out(key, line, mark) -> Iterator[pa.RecordBatch]:
        again = np.flatnonzero((key[1:] == key[:-1]) & (line[1:] == line[:-1])) + 1
        if len(again):
            twice = np.unique(line[again[key[again] & 15 == 0]])
            yield known(twice, twice)
            keep = np.ones(len(key), bool)
            keep[again] = False
            key, line, mark = key[keep], line[keep], mark[keep]
        lead, some = _leaders(key, line, mark)
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(line[some]), pa.array(line[lead[some]]), pa.array(mark[some].view(np.int64))], names=names)

    def known(line, other) -> pa.RecordBatch:
        null = pa.nulls(len(line), pa.int64())
        return pa.RecordBatch.from_arrays([null, pa.array(line), pa.array(other), null], names=names)

    names = ["key", "line", "lead", "mark"]
    held: list[np.ndarray] | None = None
    for b in batches:
        if b.column("key").null_count:
            null = b.column("key").is_null()
            k = b.filter(null)
            yield known(k.column("line").to_numpy(), k.column("mark").to_numpy())
            b = b.filter(pc.invert(null))
        if not b.num_rows:
            continue
        new = [b.column("key").to_numpy(), b.column("line").to_numpy(), b.column("mark").to_numpy().view(np.uint64)]
        held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
        last = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on
        if last:
            yield from out(*(x[:last] for x in held))
            held = [x[last:] for x in held]
    if held is not None:
        yield from out(*held)


def _similar(t: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_id, kept_set = None, None
        for b in batches:
            ok = np.zeros(b.num_rows, bool)
            lead = b.column("lead").to_numpy()
            for i, (x, y) in enumerate(zip(b.column("x").to_pylist(), b.column("y").to_pylist())):
                if lead[i] != kept_id:
                    kept_id, kept_set = lead[i], line_set(y)
                ok[i] = _alike(line_set(x), kept_set, t)
            yield pa.RecordBatch.from_arrays([b.column("line").filter(pa.array(ok)), b.column("lead").filter(pa.array(ok))], names=["a", "b"])

    return check


def _alike(x: np.ndarray, y: np.ndarray, t: float) -> bool:
    if min(len(x), len(y)) < t * max(len(x), len(y)) - 1e-9:
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= t * (len(x) + len(y) - both) - 1e-9


def _filter_words(ids: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of ``2 ** bits`` bits over ``id``, with two hashes."""
    at = [F.pmod(F.col("id"), F.lit(1 << bits)), F.pmod(F.shiftrightunsigned("id", bits), F.lit(1 << bits))]
    rows = ids.select(F.explode(F.array(*at)).alias("at"))
    rows = rows.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("m"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(1 << (bits - 6), np.int64)
        for b in batches:
            out[b.column("w").to_numpy()] = b.column("m").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["words"])

    # one row of a bounded size, whatever the number of ids
    got = map_arrow(rows.select(F.col("w").cast("long"), F.col("m").cast("long")).coalesce(1), join, "words binary").first()
    return np.frombuffer(got["words"], np.uint64) if got else np.zeros(1 << (bits - 6), np.uint64)


def filter_bits(n: int) -> int:
    """Eight bits an id, within 2 ** 20 and 2 ** 28 bits (32 MB): past that a fuller filter lets more lines through, and drops none."""
    return min(max((8 * max(n, 1) - 1).bit_length(), 20), 28)


def occurrences(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(line, doc_id, th, first, end, sure, bytes) of lines that occur twice or agree with another, and of some that
    pass the filters by chance. ``sure``: the batch holds the line at an earlier place, so this one goes whatever
    else is found. ``bytes`` come once a batch, for lines that agree with another."""
    spark = docs.sparkSession
    near = groups.filter("key is not null").select(F.col("line").alias("id"), F.lit(0).alias("k"))
    twice = groups.filter("key is null").select(F.explode(F.array("line", "lead")).alias("id"), F.lit(1).alias("k"))
    n = {r["k"]: r["n"] for r in near.unionByName(twice).groupBy("k").agg(F.approx_count_distinct("id").alias("n")).collect()}
    bits = [filter_bits(n.get(0, 0)), filter_bits(n.get(1, 0))]
    filters = [spark.sparkContext.broadcast(_filter_words(ids, b)) for ids, b in zip((near, twice), bits)]

    def within(h: np.ndarray, k: int) -> np.ndarray:
        w, b = filters[k].value, bits[k]
        hit = np.ones(len(h), bool)
        for at in (h & _U((1 << b) - 1), (h >> _U(b)) & _U((1 << b) - 1)):
            hit &= (w[(at >> _U(6)).astype(np.int64)] >> (at & _U(63))) & _U(1) == 1
        return hit

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, th = batch.column("doc_id"), batch.column("th")
            order = pc.sort_indices(pa.table({"doc_id": ids, "th": th}), [("doc_id", "ascending"), ("th", "ascending")])
            s_ids, s_th = ids.take(order), th.take(order)
            step = np.zeros(len(order), np.int64)
            if len(order) > 1:
                step[1:] = pc.or_(pc.not_equal(s_ids[1:], s_ids[:-1]), pc.not_equal(s_th[1:], s_th[:-1])).to_numpy(zero_copy_only=False)
            rank = np.empty(len(order), np.int64)  # equal rows have one rank
            rank[order.to_numpy()] = np.cumsum(step)
            parts, text = [], []
            for a, z, raw, off in tx.chunks(batch.column("text")):
                low, start, end, first, h = line_spans(raw, off)
                close = within(h, 0)
                hit = np.flatnonzero(close | within(h, 1))
                row = np.repeat(np.arange(a, z), np.diff(first))[hit]
                base = off[row - a]
                parts.append(np.stack([h[hit].view(np.int64), row, start[hit] - base, end[hit] - base, close[hit]]))
                text += [low[x:y].tobytes() if c else None for x, y, c in zip(start[hit].tolist(), end[hit].tolist(), close[hit].tolist())]
            if not parts:
                continue
            line, row, first, end, close = np.concatenate(parts, axis=1)
            by = np.lexsort((first, rank[row], line))
            l, r, f = line[by], rank[row][by], first[by]
            head = _first_of_run(l)
            sure = np.zeros(len(by), bool)
            sure[by] = (r != r[head]) | (f != f[head])
            shown = np.zeros(len(by), bool)
            shown[by[head]] = close[by[head]] == 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(line), ids.take(pa.array(row)), th.take(pa.array(row)), pa.array(first), pa.array(end), pa.array(sure),
                 pa.array([x if s else None for x, s in zip(text, shown.tolist())], pa.binary())],
                names=["line", "doc_id", "th", "first", "end", "sure", "bytes"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return written(map_arrow(rows, run, f"line long, doc_id {kind}, th long, first long, end long, sure boolean, bytes binary"))


#: Lines of a bucket that one task compares with each other or with as many; larger buckets are dealt in pairs of such blocks.
BLOCK = 1024


def _pairs_within(t: float):
    """Links (a, b) between lines of one bucket (or pair of its blocks) that are in different components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in run_tables(batches, ["key", "i", "j"]):
            line, lead, root, own = (g[c].to_numpy() for c in ("line", "lead", "root", "own"))
            mark, raw = g["mark"].to_numpy().view(np.uint64), g["bytes"].to_pylist()
            group = {r: r for r in root.tolist()}
            sets: dict[int, np.ndarray] = {}

            def top(x: int) -> int:
                while group[x] != x:
                    group[x] = group[group[x]]
                    x = group[x]
                return x

            a, b = [], []
            across = g["i"][0].as_py() != g["j"][0].as_py()
            for x in range(len(line)):
                other = np.arange(x + 1, len(line))
                other = other[(root[other] != root[x]) & ((own[other] != own[x]) if across else True)]
                other = other[(lead[other] != line[x]) & (line[other] != lead[x])]  # those pairs have been checked
                for y in other[sketches_agree(mark[other], mark[x])].tolist():
                    p, q = top(int(root[x])), top(int(root[y]))
                    if p == q:
                        continue
                    for k in (x, y):
                        if k not in sets:
                            sets[k] = line_set(raw[k])
                    if _alike(sets[x], sets[y], t):
                        group[max(p, q)] = min(p, q)
                        a.append(int(line[x]))
                        b.append(int(line[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def near_lines(groups: DataFrame, lines: DataFrame, t: float = 0.8) -> DataFrame:
    """(node, root) of every line that is near another; ``lines`` holds (line, bytes)."""
    known = groups.filter("key is null and line <> lead").select(F.col("line").alias("a"), F.col("lead").alias("b"))
    members = groups.filter("key is not null")
    links = members.filter("line <> lead").select("line", "lead").distinct()
    links = links.join(lines.select("line", F.col("bytes").alias("x")), "line")
    links = links.join(lines.select(F.col("line").alias("lead"), F.col("bytes").alias("y")), "lead")
    edges = written(map_arrow(links.select("line", "lead", "x", "y"), _similar(t), "a long, b long").unionByName(known))
    joined = components(edges)
    # buckets whose lines are not all in one component: each is compared with those of the others
    rooted = members.join(joined.select(F.col("node").alias("line"), "root"), "line", "left").select("key", "line", "lead", F.coalesce("root", "line").alias("root"), "mark")
    split = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).filter("low <> high and n > 2")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    left = rooted.join(split.select("key", parts.alias("parts")), "key").withColumn("own", F.pmod(F.xxhash64("line"), F.col("parts")).cast("int"))
    left = left.join(lines, "line").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    left = left.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "line", "lead", "root", "mark", "bytes")
    left = left.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "line")
    more = written(map_arrow(left, _pairs_within(t), "a long, b long"))
    if more.isEmpty():
        return joined
    return components(more.unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def removals(docs: DataFrame, t: float = 0.8) -> DataFrame:
    """(doc_id, th, cuts): byte ranges of lines to cut from each text, th being its xxhash64."""
    docs = docs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    rows = map_arrow(docs.select("text"), bucket_rows(t), "key long, line long, mark long")
    rows = rows.withColumn("to", F.coalesce("key", "line")).repartition("to").drop("to").sortWithinPartitions("key", "line")
    groups = written(map_arrow(rows, bucket_groups, "key long, line long, lead long, mark long"))
    spots = occurrences(docs, groups)
    near = near_lines(groups, spots.filter("bytes is not null").select("line", "bytes").dropDuplicates(["line"]), t)
    spots = spots.select("line", "doc_id", "th", "first", "end", "sure")
    place = F.struct("doc_id", "th", "first")
    open_ = spots.filter("not sure").join(near.select(F.col("node").alias("line"), "root"), "line", "left")
    open_ = open_.select("doc_id", "th", "first", "end", F.coalesce("root", "line").alias("root"))
    heads = open_.groupBy("root").agg(F.min(place).alias("head"), F.max(place).alias("tail")).filter("head <> tail")
    gone = open_.join(heads.select("root", "head"), "root").filter(place != F.col("head"))
    gone = gone.select("doc_id", "th", "first", "end").unionByName(spots.filter("sure").select("doc_id", "th", "first", "end"))
    gone = gone.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("first", "end"))).alias("cuts"))
    return written(gone)


def without(raw: bytes, cuts) -> bytes:
    """``raw`` without byte ranges, each with its line feed."""
    at, parts = 0, []
    for c in cuts or ():
        parts.append(raw[at : c["first"]])
        at = c["end"] + (raw[c["end"] : c["end"] + 1] == b"\n")
    parts.append(raw[at:])
    return b"".join(parts)


def cut(df: DataFrame, text_col: str, cuts_col: str) -> DataFrame:
    """Replaces ``text_col`` by the text without the byte ranges of ``cuts_col``, each with its line feed."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    names = [c for c in kinds if c != cuts_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text, cuts = b.column(text_col).to_pylist(), b.column(cuts_col).to_pylist()
            for i, c in enumerate(cuts):
                if c:
                    text[i] = without(text[i].encode(), c).decode()
            new = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([new if c == text_col else b.column(c) for c in names], names=names)

    return map_arrow(df, run, ", ".join(f"`{c}` {kinds[c]}" for c in names))


def with_cuts(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Adds ``cuts`` to rows (doc_id, text, ...) by id and text."""
    gone = gone.select(F.col("doc_id").alias("cut_id"), F.col("th").alias("cut_th"), "cuts")
    match = (F.col("doc_id") == F.col("cut_id")) & (F.xxhash64("text") == F.col("cut_th"))
    return rows.join(sized(gone, 64, "cuts", 40), match, "left").drop("cut_id", "cut_th")


def dedup_lines(docs: DataFrame, t: float = 0.8, drop_emptied: bool = False) -> DataFrame:
    """The documents without their repeated lines; all columns are kept, and n_chars, if there, follows the text.
    With ``drop_emptied`` a document that loses lines and has no word left goes; one that had none stays."""
    rows = with_cuts(packed(docs), removals(docs, t)).withColumn("lost", F.col("cuts").isNotNull())
    rows = cut(rows, "text", "cuts")
    if drop_emptied:
        rows = rows.filter(~F.col("lost") | F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"))
    return unpacked(rows, docs)


def line_report(docs: DataFrame, t: float = 0.8) -> DataFrame:
    """doc_id, n_lines (that hold a word), n_removed, removed (first bytes) and text_sha256 of what is left."""
    out = with_cuts(docs.select("doc_id", "text"), removals(docs, t)).select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column("text")
            n = np.concatenate([np.zeros(0, np.int64), *(np.diff(line_spans(raw, off, False)[3]) for _, _, raw, off in tx.chunks(text))])
            cuts = b.column("cuts").to_pylist()
            removed = [[c["first"] for c in x or ()] for x in cuts]
            raw, off = tx.buffers(text)
            whole, null = memoryview(np.ascontiguousarray(raw)), text.is_null().to_pylist()
            parts = (whole[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist()))
            left = [None if z else without(bytes(p), c) if c else p for p, c, z in zip(parts, cuts, null)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), pa.array(n), pa.array([len(x) for x in removed], pa.int64()), pa.array(removed, pa.list_(pa.int64())),
                    pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in left], pa.string()),
                ],
                names=["doc_id", "n_lines", "n_removed", "removed", "text_sha256"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(out, run, f"doc_id {kind}, n_lines long, n_removed long, removed array<long>, text_sha256 string")
