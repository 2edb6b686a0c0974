"""Mixing sources to target weights by hash-threshold histograms.

1. Sizes (words) are counted once per document and stored with a 60-bit hash of
   the document; later passes read only this small table.
2. Targets: a source's share of the total by weight, capped at a multiple of its
   size; the excess is shared anew by weight until no source is above its cap.
   Each round needs only two sums, however many sources there are.
3. A source takes every document floor(target / size) times and, of the rest,
   the documents whose hash lies below a threshold. The threshold comes from a
   histogram: words by source and bucket of the hash's leading 12 bits, the
   bucket where the running sum passes the budget, then the same again for that
   bucket only, with the next 12 bits, five times in all. Thresholds are nested:
   a larger budget keeps every document of a smaller one.
4. The one hash at the boundary takes the words that are left of the budget, so
   a source misses its target by less than a word, or less than one word a row
   if identical rows share that hash.

No step sorts documents or gathers a source in one task: histograms are partial
sums. The per-source table has a row per source and is broadcast only if it has
at most ``BROADCAST_SOURCES`` rows; beyond that it is joined by a shuffle.

Null and empty texts have size 0 and are taken 0 times; a null source is a
source of its own that comes last; a null id counts as an empty one; identical
rows are taken alike; an empty table gives an empty result. Other columns,
whatever their names, are not read, or kept by mix(), but for one of the name of
its own column, which it replaces.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.llm.common import stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
BITS, LEVELS = 12, 5
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash60(*cols: Column) -> Column:
    """The first 60 bits of the md5 of the columns as text."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("")) for c in cols))), 1, 15), 16, 10).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Sources with their rank from 0 by code point, null last: ranges are sorted each for itself and offset by the rows of those before."""
    parts = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before, at = [], 0
    for part, n in sorted(map(tuple, parts.groupBy("part").count().collect())):
        before.append((part, at))
        at += n
    offsets = sources.sparkSession.createDataFrame(before, "part int, before long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1
    return parts.withColumn("inside", inside).join(F.broadcast(offsets), "part").withColumn("rank", F.col("inside") + F.col("before")).drop("part", "inside", "before")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, weight, target of every source in sizes (source, size)."""
    found = _ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    found = stored(found.withColumn("weight", weight).withColumn("most", F.lit(float(most)) * F.col("source_size")).drop("rank"))
    total = found.agg(F.sum("source_size")).first()[0] or 0
    budget, level, last = share * total, 0.0, -1
    while True:
        full = F.col("most") <= F.lit(level) * F.col("weight")
        capped, n, rest = found.agg(F.sum(F.when(full, F.col("most"))), F.count(F.when(full, 1)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == last or not rest:
            break
        last, level = n, (budget - (capped or 0.0)) / rest
    full = F.col("most") <= F.lit(level) * F.col("weight")
    return found.withColumn("target", F.when(full | F.lit(not rest), F.col("most")).otherwise(F.lit(level) * F.col("weight"))).drop("most")


def _join_sources(df: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    side = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    return df.join(side, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def thresholds(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> tuple[DataFrame, int]:
    """What every source of rows (source, size, hash) takes, a row a source, and how many sources there are."""
    sources = targets(rows, weights, share, most).withColumnRenamed("source", "s").drop("weight")
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    sources = stored(sources.withColumn("budget", F.floor("target") - F.col("whole") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")))
    n = sources.count()
    bits = BITS * LEVELS
    for level in range(1, LEVELS + 1):
        shift = bits - BITS * level
        inside = _join_sources(rows.select("source", "size", "hash"), sources.select("s", "budget", "prefix"), n)
        inside = inside.where(F.shiftright("hash", shift + BITS) == F.col("prefix")) if level > 1 else inside
        histogram = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("copies"))
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        boundary = _join_sources(histogram.withColumn("running", running), sources.select("s", "budget"), n).where(F.col("running") > F.col("budget"))
        # the first bucket whose running sum passes the budget, and what is left when it begins
        boundary = boundary.groupBy(F.col("source").alias("s2")).agg(F.min_by(F.struct("bucket", (F.col("budget") - F.col("running") + F.col("words")).alias("left"), "copies"), "bucket").alias("b"))
        step = sources.drop("copies").join(boundary, F.col("s").eqNullSafe(F.col("s2")), "left")
        beyond = F.lit((1 << (BITS * level)) if level == 1 else 0)
        sources = stored(
            step.select(
                "s", "source_size", "target", "whole",
                F.coalesce("b.left", F.lit(0) if level == 1 else F.col("budget")).alias("budget"),
                F.coalesce("b.bucket", beyond if level == 1 else F.shiftleft("prefix", BITS)).alias("prefix"),
                F.coalesce("b.copies", F.lit(1)).alias("copies"),
            )
        )
    return sources, n


def take(rows: DataFrame, sources: DataFrame, n: int) -> DataFrame:
    """rows (source, size, hash, any others) with source_size, target and taken. Nothing is shuffled unless there are very many sources."""
    whole = F.col("whole") * F.col("size")
    extra = F.when(F.col("hash") < F.col("prefix"), F.col("size")).when(F.col("hash") == F.col("prefix"), F.floor(F.col("budget") / F.col("copies"))).otherwise(0)
    return _join_sources(rows, sources, n).withColumn("taken", (whole + extra).cast("long")).drop("whole", "budget", "prefix", "copies")


def mix_report(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    rows = stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash60(F.col("doc_id"), F.col("text")).alias("hash")))
    return take(rows, *thresholds(rows, weights, share, most)).select("doc_id", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, taken_col: str = "taken") -> DataFrame:
    """docs with the column taken_col: how many of its words the mix takes, repeats counted (the text once or twice, then its first words). Documents of which it takes none go."""
    names = docs.columns
    cells = docs.toDF(*(f"c{i}" for i in range(len(names))))
    at = {n: F.col(f"c{names.index(n)}") for n in ("doc_id", "text", "source")}
    cells = cells.select("*", at["source"].alias("source"), word_count(at["text"]).alias("size"), hash60(at["doc_id"], at["text"]).alias("hash"))
    rows = stored(cells.select("source", "size", "hash"))
    out = take(cells, *thresholds(rows, weights, share, most)).where(F.col("taken") > 0)
    kept = [F.col(f"c{i}").alias(n) for i, n in enumerate(names) if n.lower() != taken_col.lower()]
    return out.select(*kept, F.col("taken").alias(taken_col))


def oracle(documents: str = "documents", select: str = "doc_id, size, source_size, target, taken") -> str:
    """The same rule in DuckDB, by a running sum in hash order."""
    return rf"""
WITH RECURSIVE d0 AS (SELECT *, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || chr(31) || coalesce(text, '')), 1, 15) AS BIGINT) AS h FROM {documents}),
s AS (SELECT source, source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 2.0::DOUBLE * source_size AS cap FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d0 GROUP BY source)),
lv AS (SELECT 0 AS i, 0.0::DOUBLE AS lam, -1::BIGINT AS n UNION ALL
  SELECT i + 1, (SELECT (1.5::DOUBLE * sum(source_size) - coalesce(sum(CASE WHEN cap <= lam * w THEN cap END), 0)) / sum(CASE WHEN cap <= lam * w THEN NULL ELSE w END) FROM s), (SELECT count(*) FROM s WHERE cap <= lam * w)
  FROM lv WHERE n <> (SELECT count(*) FROM s WHERE cap <= lam * w) AND EXISTS (SELECT 1 FROM s WHERE cap > lam * w)),
l AS (SELECT max_by(lam, i) AS lam FROM lv),
t AS (SELECT source, source_size, CASE WHEN cap <= lam * w OR NOT EXISTS (SELECT 1 FROM s WHERE cap > lam * w) THEN cap ELSE lam * w END AS target FROM s, l),
r AS (SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
b AS (SELECT *, CAST(floor(target) AS BIGINT) - whole * source_size AS budget FROM r),
g AS (SELECT source, h, sum(size) AS words, count(*) AS n, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d0 GROUP BY source, h),
m AS (SELECT source, min_by(h, h) AS h, min_by(n, h) AS n, min_by(left_, h) AS left_ FROM (SELECT g.*, budget - upto + words AS left_ FROM g JOIN b ON g.source IS NOT DISTINCT FROM b.source WHERE upto > budget) GROUP BY source),
x AS (SELECT d0.*, b.source_size, b.target, CAST(b.whole * d0.size + CASE WHEN m.h IS NULL OR d0.h < m.h THEN d0.size WHEN d0.h = m.h THEN CAST(floor(left_ / n) AS BIGINT) ELSE 0 END AS BIGINT) AS taken
  FROM d0 JOIN b ON d0.source IS NOT DISTINCT FROM b.source LEFT JOIN m ON m.source IS NOT DISTINCT FROM d0.source)
SELECT {select} FROM x
"""


