"""N-gram Jaccard self-join by chosen paths.

Documents are sets of hashes of ``n`` consecutive words (five). Equal sets are
one class, so copies are compared once however many they are. For each of
several independent runs a set is placed in a tree of chosen paths (Christiani
and Pagh 2017; Christiani, Pagh and Sivertsen 2018): at a node a set of size s
follows each of its tokens with probability 1 / (t * s), by a hash of path and
token, so that sets which share tokens go down together. Two sets of
similarity t or more share at least one child of a shared node on average, and
reach a common leaf of a given depth with the survival probability of a
branching process, from which the number of runs for ``recall`` is computed.
Leaves with two or more classes are brute-forced on 512-bit sketches (one bit
of each of 512 minimum hashes), a large leaf in pairs of blocks that are dealt
over tasks. Pairs within three standard errors of the threshold are candidates;
each leaf (or pair of blocks) gives spanning stars.

Candidates' components (distributed union-find) are then verified exactly on
the sets themselves, all pairs within a component in blocks of ``block``
classes, so each document meets every document that may be near it. From that
come each class's number of links and the final groups. No pairs leave a task,
only one row a class and block; sets move once a block pair.

Scale. One narrow pass over the texts, a shuffle of leaf rows (about 20 a
class, 90 bytes each), and one shuffle of texts and sets, of near documents
only. Leaves are dealt by path; common passages thin out by
(shared part / t) ^ depth, and ``depth`` grows with the logarithm of the number of
documents, the runs following so that the recall stays. A component of M classes
is compared in about M * M / 2 pairs, by blocks: large families cost so much.

Cases. Fewer than n words: one shingle of all words. Null text or no words: no
links, a group of its own. Copies in one class are linked to each other. Rows
with a null id take no part and come out with a null group and no links. A
repeated row counts as another document. Empty tables give no rows. Extra
columns are dropped by :func:`ngram_groups` and kept by :func:`keep_one`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm import _text as tx
from gridloom.llm._run import local_roots, map_arrow, multi_runs, packed, runs, sized, sorted_groups, written
from gridloom.llm.components import components

_U = np.uint64
BITS = 512
_ODD = tx.splitmix(np.arange(BITS, dtype=np.uint64)) | _U(1)


def runs_needed(depth: int, recall: float) -> int:
    """Runs after which two sets at the threshold have met in a leaf with probability ``recall``."""
    p = 1.0
    for _ in range(depth):
        p = 1.0 - math.exp(-p)  # one shared child on average
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def class_hash(s: np.ndarray) -> int:
    """A 64-bit hash of a sorted set."""
    mixed = tx.splitmix(s * _U(0x9FB21C651E98DF25) + _U(1))
    parts = np.array([mixed.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed), len(s)], np.uint64)
    return int(tx.windows(parts, 3)[0].astype(np.int64))


def sketch(s: np.ndarray) -> bytes:
    """One bit of the minimum of each of ``BITS`` hashes of the set, from one permutation in bins.

    A token's high bits choose its bin, the least token of a bin is the bin's
    minimum, and an empty bin borrows from others by a hash of its number and the attempt.
    """
    bins = (s >> _U(55)).astype(np.int64)  # 512 bins; s is sorted, so a bin's first is its least
    first = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]]))
    least = np.zeros(BITS, np.uint64)
    full = np.zeros(BITS, bool)
    least[bins[first]], full[bins[first]] = s[first], True
    have = full.copy()
    attempt = 0
    while not have.all():
        todo = np.flatnonzero(~have)
        attempt += 1
        pick = (tx.splitmix(todo.astype(np.uint64) * _U(1009) + _U(attempt)) >> _U(55)).astype(np.int64)
        ok = full[pick]
        least[todo[ok]] = tx.splitmix(least[pick[ok]] + _U(attempt))
        have[todo[ok]] = True
        if attempt == 64:  # a set of very few tokens: the least token by each bin's own hash
            rest = np.flatnonzero(~have)
            least[rest] = (s[None, :] * _ODD[rest][:, None]).min(1)
            break
    bit = (tx.splitmix(least ^ _ODD) & _U(1)).astype(np.uint8)
    return np.packbits(bit).tobytes()


def leaves(s: np.ndarray, t: float, depth: int, n_runs: int) -> np.ndarray:
    """The leaf paths of a set in all runs."""
    path = tx.splitmix(np.arange(1, n_runs + 1, dtype=np.uint64))
    p = 1.0 / (t * len(s))
    limit = _U(0xFFFFFFFFFFFFFFFF) if p >= 1 else _U(int(p * 2.0**64))
    for _ in range(depth):
        v = (s[None, :] ^ path[:, None]) * _U(0xD6E8FEB86659FD93)
        node, token = np.nonzero((v ^ (v >> _U(32))) * _U(0xD6E8FEB86659FD93) <= limit)
        path = np.unique(tx.splitmix(path[node] * _U(0xA24BAED4963EE407) + s[token]))
        if not len(path):
            break
    return path


def profile(docs: DataFrame, n: int, t: float, depth: int, recall: float) -> DataFrame:
    """doc_id, cls (hash of the set; null without words), size, sketch and leaves of every row."""
    n_runs = runs_needed(depth, recall)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cls, size, sk, lv = [], [], [], []
            for s in tx.shingle_sets(b.column(1), n):
                some = len(s) > 0
                cls.append(class_hash(s) if some else None)
                size.append(len(s))
                sk.append(sketch(s) if some else None)
                lv.append(leaves(s, t, depth, n_runs).view(np.int64) if some else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(cls, pa.int64()), pa.array(size, pa.int32()), pa.array(sk, pa.binary()), pa.array(lv, pa.list_(pa.int64())), b.column(2)],
                names=["doc_id", "cls", "size", "sketch", "leaves", "th"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    return map_arrow(rows, run, f"doc_id {kind}, cls long, size int, sketch binary, leaves array<long>, th long")


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return BITS - np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(2, dtype=np.int32)


def leaf_stars(sk: np.ndarray, least: int, part: np.ndarray | None = None) -> np.ndarray:
    """Each row's least partner-by-chain among rows whose sketches agree in ``least`` bits; all pairs are
    compared, or, where rows are of two parts, all pairs across."""
    n = len(sk)
    root = np.arange(n)
    for i in range(0, n, 256):
        near = _agree(sk[i : i + 256], sk) >= least
        if part is not None:
            near &= part[i : i + 256, None] != part[None, :]
        a, b = np.nonzero(near)
        if n <= 256:
            return local_roots(n, a, b) if (a != b).any() else root
        root = local_roots(n, np.concatenate([np.arange(n), a + i]), np.concatenate([root, b]))
    return root


def candidate_edges(classes: DataFrame, t: float, block: int) -> DataFrame:
    """Spanning stars (a, b) of each leaf's candidates.

    A leaf of more than ``block`` classes is dealt over tasks in pairs of blocks of about so many, each pair
    of classes meeting in one of them, so that every leaf is compared in all pairs whatever its size.
    """
    agree = (1 + t) / 2
    least = math.floor(BITS * (agree - 3 * math.sqrt(agree * (1 - agree) / BITS)))
    rows = classes.select(F.explode("leaves").alias("path"), "cls", "sketch")
    parts = rows.groupBy("path").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    parts = written(parts.select(F.col("path").alias("large"), F.ceil(F.col("n") / block).cast("int").alias("parts")))
    rows = rows.join(sized(parts, 32), F.expr("path = large"), "left").drop("large")
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    cell = F.when(F.col("parts") > 1, F.xxhash64("path", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("path"))
    rows = rows.select(cell.alias("path"), "cls", "own", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in multi_runs(batches, "path"):
            sk = np.frombuffer(b"".join(g["sketch"]), np.uint64).reshape(-1, BITS // 64)
            part = g["own"]
            root = leaf_stars(sk, least, part if (part != part[0]).any() else None)
            off = np.flatnonzero(root != np.arange(len(root)))
            if len(off):
                cls = g["cls"]
                yield pa.RecordBatch.from_arrays([pa.array(cls[off]), pa.array(cls[root[off]])], names=["a", "b"])

    return map_arrow(sorted_groups(rows, ["path"], ["cls"]), run, "a long, b long").distinct()


def depth_for(classes: int) -> int:
    """Levels of the trees: three up to a million documents, and one more for each fourfold, so that leaves stay small."""
    return 3 + max(0, math.ceil(math.log(max(classes, 1) / 1e6, 4)))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    out = np.zeros((n, n), np.float32)
    uses = np.bincount(inverse, minlength=len(values))
    new = np.cumsum(uses > 1) - 1  # only tokens that two sets have can be shared
    keep = uses[inverse] > 1
    owner, col = owner[keep], new[inverse[keep]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    width = max(1, min(8192, (1 << 24) // max(n, 1)))
    at = 0
    while at < len(col):
        base = col[at]
        end = int(np.searchsorted(col, base + width))
        m = np.zeros((n, width), np.float32)
        m[owner[at:end], col[at:end] - base] = 1
        out += m @ m.T
        at = end
    return out


def verified(docs: DataFrame, classes: DataFrame, comps: DataFrame, n: int, t: float, block: int) -> DataFrame:
    """(cls, links, root): exact links of each class by part of its component, and a star of what is linked."""
    size = comps.groupBy("root").agg(F.count("*").alias("members"))
    parts = F.ceil(F.col("members") / F.lit(block)).cast("int")
    mine = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    members = (
        comps.join(size, "root").select(F.col("node").alias("cls"), "root", parts.alias("parts"))
        .join(classes.select("cls", "copies", F.col("rep").alias("doc_id")), "cls").withColumn("own", mine)
    )
    rows = docs.select("doc_id", "text").join(members, "doc_id")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(tx.shingle_sets(b.column("text"), n))
            ok, cls = [], b.column("cls").to_pylist()
            for i, s in enumerate(got):  # an id may come with several texts
                ok.append(len(s) > 0 and class_hash(s) == cls[i])
            keep = np.flatnonzero(ok)
            t_ = b.take(pa.array(keep)) if len(keep) else b.slice(0, 0)
            yield pa.RecordBatch.from_arrays(
                [t_.column("root"), t_.column("parts"), t_.column("own"), t_.column("cls"), t_.column("copies"), pa.array([got[i].tobytes() for i in keep], pa.binary())],
                names=["root", "parts", "own", "cls", "copies", "s"],
            )

    held = map_arrow(rows, sets, "root long, parts int, own int, cls long, copies long, s binary")
    held = (
        held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})
        .drop("parts", "other")
    )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in runs(batches, ["root", "i", "j"]):
            cls, at = np.unique(g["cls"].to_numpy(), return_index=True)  # repeated rows of one document
            g = g.take(pa.array(at))
            own, copies = g["own"].to_numpy(), g["copies"].to_numpy()
            s = [np.frombuffer(x, np.uint64) for x in g["s"].to_pylist()]
            both = overlaps(s)
            size = np.array([len(x) for x in s], float)
            near = both * (1 + t) >= t * (size[:, None] + size[None, :]) - 1e-6
            np.fill_diagonal(near, False)
            if g["i"][0] != g["j"][0]:
                near &= own[:, None] != own[None, :]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            links = (near * copies[None, :]).sum(1)
            root = local_roots(len(cls), a, b)
            on = np.flatnonzero(near.any(1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls[on]), pa.array(links[on].astype(np.int64)), pa.array(cls[root[on]])], names=["cls", "links", "root"]
            )

    return map_arrow(sorted_groups(held, ["root", "i", "j"], ["cls"]), compare, "cls long, links long, root long")


def _grouped(docs: DataFrame, n: int, t: float, depth: int | None, recall: float, block: int, leaf: int) -> DataFrame:
    """doc_id, th, group_id and n_links of every row with an id."""
    docs = docs.filter(F.col("doc_id").isNotNull())
    rows = written(profile(docs, n, t, depth or depth_for(docs.count()), recall))
    classes = rows.filter("cls is not null").groupBy("cls").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.first("leaves").alias("leaves"), F.first("sketch").alias("sketch")
    )
    comps = components(candidate_edges(classes, t, leaf))
    classes = classes.select("cls", "copies", "rep")
    linked = written(verified(docs, classes, comps, n, t, block))
    final = components(linked.select(F.col("cls").alias("a"), F.col("root").alias("b")))
    links = linked.groupBy("cls").agg(F.sum("links").alias("links"))
    table = (
        classes.join(final.select(F.col("node").alias("cls"), "root"), "cls", "left").join(links, "cls", "left")
        .select("cls", F.coalesce("root", "cls").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "rep")
    )
    group = table.groupBy("root").agg(F.min("rep").alias("group_id"))
    table = table.join(group, "root").select("cls", "n_links", "group_id")
    return rows.select("doc_id", "cls", "th").join(table, "cls", "left").select(
        "doc_id", "th", F.coalesce("group_id", "doc_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def ngram_groups(
    docs: DataFrame, n: int = 5, t: float = 0.8, depth: int | None = None, recall: float = 0.995, block: int = 512, leaf: int = 4096
) -> DataFrame:
    """doc_id, group_id (the least id of its group) and n_links (other documents of similarity >= ``t``)."""
    out = _grouped(docs, n, t, depth, recall, block, leaf).select("doc_id", "group_id", "n_links")
    null_ids = docs.filter(F.col("doc_id").isNull())
    return out.unionByName(null_ids.select("doc_id", F.col("doc_id").alias("group_id"), F.lit(0).cast("long").alias("n_links")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each group, that of the least id, with all its columns; rows with a null id stay."""
    o = {"n": 5, "t": 0.8, "depth": None, "recall": 0.995, "block": 512, "leaf": 4096} | options
    marked = _grouped(docs, **o)
    # drop is by (id, text); of rows that are equal in both, one stays
    lost = written(marked.filter("doc_id <> group_id").select(F.col("doc_id").alias("lost_id"), F.col("th").alias("lost_th")).distinct())
    twice = marked.filter("doc_id = group_id").groupBy("group_id").agg(F.count("*").alias("k")).filter("k > 1")
    out = packed(docs).withColumn("th", F.xxhash64("text"))
    out = out.join(sized(lost, 40), F.expr("doc_id = lost_id AND th = lost_th"), "left_anti")
    if twice.take(1):
        nth = F.row_number().over(Window.partitionBy("doc_id", "th").orderBy(F.lit(1)))
        out = out.withColumn("nth", F.when(F.col("doc_id").isNull(), 1).otherwise(nth)).filter("nth = 1")
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
