"""Mixing sources to target weights by systematic sampling.

Targets. Sources in code-point order (null last) weigh ``weights`` in turn,
repeating; together they are to have ``share`` of all words. A target stops at
``cap`` times its source's size and the excess is reshared by weight, which
ends at ``target = min(cap * size, level * weight)`` for one common level.

Sampling. A document of a source is expected ``target / size of the source``
times. In a fixed order (size class, then a keyed digest of id and text) those
expectations are summed up within the source, one offset in [0, 1) drawn from
the seed and the source is added, and the document is emitted once for each
integer that the sum crosses. So a document is taken floor or ceil of its
expectation times, at most ``ceil(cap)``, and a source's words come near its
target, as all sizes are thinned alike.

Scale. Expectations are equal within a source, so the prefix sum is a rank
times a rate. Ranks come from counts of buckets (source, size class, two
digits of the digest), summed up over at most 16 * 64 * 256 buckets a source,
plus a rank within one bucket. A source that holds a third of all rows is so
split over its buckets; texts are not shuffled by the operator's narrow form.

Cases. Null text has size 0. A null source is a source of its own, last. Rows
of one id (or of none) with several texts are told apart by the texts, so reruns and other
orders of the input agree; rows equal in id, text and source are interchangeable. Sources without words have target 0 and are not
taken. An empty table gives no rows. Extra columns are dropped by
:func:`mix_sizes` and kept by :func:`mix`, whose own names are prefixed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._run import written

WEIGHTS = (5, 2, 1)
WORDS = r"[^\x20\x09-\x0D]+"


def word_size(text: Column) -> Column:
    """Runs of characters other than the six ASCII spaces: each made one letter and the spaces dropped, with no array of words."""
    letters = F.translate(F.regexp_replace(text, F.lit(WORDS), F.lit("a")), "\t\n\x0b\x0c\r ", "")
    return F.coalesce(F.length(letters).cast("long"), F.lit(0).cast("long"))


def text_md5() -> Column:
    return F.coalesce(F.md5("text"), F.lit("-")).alias("text_md5")


def size_class(size: Column) -> Column:
    """An integer that grows with size: its binary digits, and its five leading ones."""
    digits = F.bin(size + 1)
    return (F.length(digits) * 100_000 + F.substring(digits, 1, 5).cast("int")).cast("int")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0
) -> DataFrame:
    """source, source_size, target and rate from a table of (source, size); one row a source.

    Sources are few; they are ranked and levelled in one task from one row each,
    after a partial sum in every task that read them.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    t = by_source.withColumn("w", weight.cast("long")).withColumn("total", F.sum("source_size").over(everything))
    # sources in the order in which a rising level fills them; before(i): those filled by then
    fill = Window.orderBy((F.col("source_size") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    t = (
        t.withColumn("full", F.coalesce(F.sum("source_size").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("level", (F.lit(share) * F.col("total") - F.lit(cap) * F.col("full")) / F.col("w_left"))
        # the level rises until the first source that it does not fill, and falls after it
        .withColumn("level", F.max("level").over(everything))
        .withColumn("target", F.least(F.lit(cap) * F.col("source_size"), F.col("level") * F.col("w")))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return t.select("source", "source_size", F.col("target").cast("double").alias("target"), rate.alias("rate"))


def with_copies(keyed: DataFrame, weights: Sequence[int], share: float, cap: float, seed: str) -> DataFrame:
    """(doc_id, source, size, text_md5) with source_size, target and copies, by systematic sampling."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.col("text_md5")))
    keyed = (
        keyed.withColumn("cls", size_class(F.col("size")))
        .withColumn("digest", digest)
        .drop("text_md5")
        .withColumn("bin", F.substring("digest", 1, 2))
    )
    if "_row" not in keyed.columns:
        keyed = written(keyed)  # narrow: texts are read and counted once
    counts = keyed.groupBy("source", "cls", "bin").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    counts = written(counts)  # small: one row a bucket; read for the targets and for the offsets
    ahead = Window.partitionBy("source").orderBy("cls", "bin").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    targets = source_targets(counts.select("source", "size"), weights, share, cap)
    buckets = (
        buckets.alias("b")
        .join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
        .select("b.source", "b.cls", "b.bin", "ahead", "source_size", "target", "rate")
    )
    within = Window.partitionBy("source", "cls", "bin").orderBy("digest", "doc_id")
    ranked = keyed.withColumn("rank", F.row_number().over(within))
    ranked = ranked.alias("k").join(
        buckets.alias("b"),
        F.col("k.source").eqNullSafe(F.col("b.source"))
        & F.col("k.cls").eqNullSafe(F.col("b.cls"))  # never null: no filter that would count the words again
        & F.col("k.bin").eqNullSafe(F.col("b.bin")),
    )
    start = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("k.source"), F.lit("\x00"))))
    offset = F.conv(F.substring(start, 1, 8), 16, 10).cast("double") / 4294967296.0
    rank = (F.col("ahead") + F.col("rank")).cast("double")
    crossed = F.floor(offset + F.col("rate") * rank) - F.floor(offset + F.col("rate") * (rank - 1.0))
    return ranked.select(
        *[F.col(f"k.{c}") for c in keyed.columns if c not in ("cls", "digest", "bin", "text_md5")],
        "source_size", "target", crossed.cast("long").alias("copies"),
    )


def mix_sizes(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of every document."""
    keyed = docs.select("doc_id", "source", word_size(F.col("text")).alias("size"), text_md5())
    out = with_copies(keyed, weights, share, cap, seed)
    taken = (F.col("copies") * F.col("size")).cast("long")
    return out.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "copies")


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: str = "mix"
) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with ``copy`` from 1.

    All columns are kept; a column that is called ``copy`` is replaced.
    """
    own = [c for c in docs.columns if c != "copy"]
    keyed = docs.select(
        "doc_id", "source", word_size(F.col("text")).alias("size"), text_md5(), F.struct(*[F.col(f"`{c}`") for c in own]).alias("_row")
    )
    out = with_copies(keyed, weights, share, cap, seed)
    out = out.filter("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in own], "copy")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS BIGINT) AS w,
         sum(source_size) OVER () AS total FROM s
), l AS (
  SELECT *, (1.5::DOUBLE * CAST(total AS DOUBLE) - 2.0::DOUBLE * CAST(coalesce(sum(source_size) OVER f, 0) AS DOUBLE))
            / CAST(sum(w) OVER () - coalesce(sum(w) OVER f, 0) AS DOUBLE) AS lvl
  FROM w
  WINDOW f AS (ORDER BY CAST(source_size AS DOUBLE) / CAST(w AS DOUBLE), source NULLS LAST
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, max(lvl) OVER () * w) AS target FROM l
), k AS (
  SELECT d.*, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '-') || ':' || coalesce(md5(text), '-')) AS digest,
         length(bin(size + 1)) * 100000 + CAST(substr(bin(size + 1), 1, 5) AS INTEGER) AS cls
  FROM d
), r AS (
  SELECT k.doc_id, k.source, k.size, k.cls, k.digest, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
         CAST(row_number() OVER (PARTITION BY k.source ORDER BY cls, digest, doc_id) AS DOUBLE) AS rank,
         CAST(CAST('0x' || substr(md5('mix/' || coalesce(k.source, chr(0))), 1, 8) AS BIGINT) AS DOUBLE)
           / 4294967296.0::DOUBLE AS u
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, CAST(floor(u + rate * rank) - floor(u + rate * (rank - 1.0::DOUBLE)) AS BIGINT) AS copies FROM r
)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, copies * size AS taken, copies FROM c
"""
