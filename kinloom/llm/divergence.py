"""How far the sources of a language differ in their words: an audit by plain relational steps.

Terms are exploded and counted by language, source and term; each language keeps
the terms of enough documents; groups are crossed with their language's kept
terms, so that absent ones count as zero; a self-join by language and term gives
the divergence of every two sources; windows rank.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.llm.common import ascii_lower, stored, words_of

_BETWEEN = r"\x00-\x40\x5B-\x60\x7B-\x7F"
TERM = f"[^{_BETWEEN}]+"
#: Documents of a language that a term must be in.
MIN_DOCS = 10
#: Smoothed shares are whole parts of so many.
SCALE = 1_000_000_000
#: Terms listed of a group.
TOP = 10
#: Groups that are broadcast, and the parts of a language otherwise.
BROADCAST_GROUPS = 50_000
SALTS = 64
#: Kept terms that are broadcast; more of them meet the counts by a shuffle.
BROADCAST_TERMS = 500_000


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """lang, source, term, n occurrences, docs that hold it; and a row without a term for each group that has a document without terms.

    A document's terms are sorted, and each different one is exploded once, with the length of its run as its count. Each task adds up its own
    counts before the shuffle, so neither a frequent term nor a large source meets in one task row by row.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = docs.select(blank("lang").alias("lang"), blank("source").alias("source"), F.sort_array(words_of(ascii_lower(blank(text_col)), _BETWEEN)).alias("terms"))
    begins = F.filter(F.sequence(F.lit(0), F.size("terms") - 1), lambda i: (i == 0) | (F.get("terms", i) != F.get("terms", i - 1)))
    rows = rows.withColumn("begins", F.when(F.size("terms") > 0, begins))
    # the outer form, which also keeps documents without terms: from the inner one Spark would infer a filter and work out the runs, with the terms, anew for each element
    each = rows.select("lang", "source", "terms", "begins", F.posexplode_outer("begins").alias("k", "at"))
    n = F.coalesce(F.get("begins", F.col("k") + 1), F.size("terms")) - F.col("at")
    each = each.select("lang", "source", F.get("terms", F.col("at")).alias("term"), n.alias("n"))
    return each.groupBy("lang", "source", "term").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("term").alias("docs"))


@contextlib.contextmanager
def _one_map(spark: SparkSession) -> Iterator[None]:
    """Aggregation without the small map that Spark asks before the large one: most terms of a task are in the large one, so that it is asked in vain. The session's setting comes back afterwards."""
    key = "spark.sql.codegen.aggregate.map.twolevel.enabled"
    own = spark.conf.getAll.get(key)
    spark.conf.set(key, "false")
    try:
        yield
    finally:
        if own is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, own)


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (n + 2) / (total + 2 terms)), in decimals, so that no count is too large."""
    whole = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(n + 2), whole(total + 2 * terms))).cast("long")


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)): shares are at most SCALE + 1, so the square fits in a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _by_language(groups: DataFrame, many: DataFrame, key: str, few: bool) -> DataFrame:
    """Rows of a language's groups beside its rows of many. Few groups are broadcast; more of them are copied to SALTS parts of their language, which many is dealt to by its key, as one language may hold most rows."""
    if few:
        return F.broadcast(groups).join(many, "lang")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    return groups.withColumn("salt", salts).join(many.withColumn("salt", F.pmod(F.xxhash64(key), F.lit(SALTS)).cast("int")), ["lang", "salt"]).drop("salt")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: how far each source is from each other source of its language (part pair), and the terms that it has most above the language (part term).

    Null text, lang or source is ''. A term is kept if min_docs documents of its language hold it; repeated rows are documents of their
    own. A group without terms takes part with counts of zero; a language without kept terms gives pairs of value 0 and no terms. An only
    source has no pairs. Ties rank by the item's UTF-8 bytes. Other columns are ignored, an empty table gives an empty result. Sums, shares
    and quotients are whole numbers throughout.

    The counts are stored once. What follows grows with kept terms x sources; the self-join makes each two sources of a term once, adds
    them up in the task that has them, and shuffles one row for each two sources and task.
    """
    with _one_map(docs.sparkSession):
        counts = stored(term_counts(docs, text_col))
    groups = stored(counts.select("lang", "source").distinct())
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).select("lang", "term", "n")
    kept = stored(kept)
    names = kept.select("lang", "term")
    own = counts.join(F.broadcast(names) if kept.count() <= BROADCAST_TERMS else names, ["lang", "term"]).select("lang", "source", "term", "n")
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    totals = own.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    described = groups.join(sizes, "lang").join(totals, ["lang", "source"], "left").withColumn("total", F.coalesce("total", F.lit(0)))  # languages with kept terms
    few = groups.count() <= BROADCAST_GROUPS
    dense = _by_language(described, kept.withColumnRenamed("n", "lang_n"), "term", few).join(own.hint("shuffle_hash"), ["lang", "source", "term"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    dense = stored(
        dense.select("lang", "source", "term", "n", _share(F.col("n"), F.col("total"), F.col("terms")).alias("p"), _share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"))
    )

    shares = dense.select("lang", "term", "source", "p")
    two = shares.join(shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q")), ["lang", "term"]).where(F.col("source") < F.col("item"))
    sums = two.groupBy("lang", "source", "item").agg(F.sum(_apart(F.col("p"), F.col("q"))).alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    sums = sums.select("lang", F.explode(both).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    others = _by_language(groups, groups.withColumnRenamed("source", "item"), "item", few).where(F.col("source") != F.col("item"))
    pairs = others.join(sums, ["lang", "source", "item"], "left").select("lang", "source", "item", F.coalesce("value", F.lit(0)).alias("value"))

    above = dense.where((F.col("n") > 0) & (F.col("p") > F.col("q"))).select("lang", "source", F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = lambda df, part: df.withColumn("rank", rank).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return out(pairs, "pair").unionByName(out(above, "term").where(F.col("rank") <= top))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}') AS terms FROM documents),
w AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {MIN_DOCS}),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
totals AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
    1 + {SCALE}::HUGEINT * (coalesce(o.n, 0) + 2) // (coalesce(t.total, 0) + 2 * s.v) AS p, 1 + {SCALE}::HUGEINT * (k.n + 2) // (s.total + 2 * s.v) AS q
  FROM groups g JOIN kept k ON k.lang = g.lang JOIN sizes s ON s.lang = g.lang LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS r FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR r <= {TOP}
"""
