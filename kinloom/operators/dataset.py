"""Training pairs: negatives, balanced classes, splits, chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.draws import uniform
from kinloom.operators.golden import placed
from kinloom.operators.graph import materialize


def _indexed(records: DataFrame) -> DataFrame:
    """records with i, their place from 0 by id, at any number of records the same."""
    return placed(records, "record_id").select("record_id", "true_patient_id", (F.col("place") - 1).alias("i"))


def _smallest(pairs: DataFrame, n: int, top: int) -> DataFrame:
    """The n pairs of smallest id, from 0 to top - 1: whole blocks of ids, and a part of one."""
    ids = pairs.withColumn("block", F.floor(F.col("id") / F.lit(-(-top // 1000))))
    upto = 0
    for block, there in sorted(map(tuple, ids.groupBy("block").count().collect())):
        if upto + there > n:
            edge = ids.where(F.col("block") == block).orderBy("id", "record_id_1", "record_id_2").limit(n - upto)
            return ids.where(F.col("block") < block).unionByName(edge).select("record_id_1", "record_id_2")
        upto += there
    return ids.select("record_id_1", "record_id_2")


def negatives(records: DataFrame, n: int | None = None, seed: int = 42, least: int = 0) -> DataFrame:
    """n different pairs (record_id_1, record_id_2) of different people; if n is not given, as many as there are true pairs, and least at least; all if there are fewer.
    Both records are drawn by hash from the places of all records, and more are drawn until there are n; if n is more than half of all such pairs, they are listed and chosen by hash."""
    people = records.where("record_id IS NOT NULL AND true_patient_id IS NOT NULL").groupBy("record_id").agg(F.min("true_patient_id").alias("true_patient_id"))
    sizes = people.groupBy("true_patient_id").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("c"))
    total, squares = (int(x or 0) for x in sizes.agg(F.sum("c"), F.sum(F.expr("CAST(c * c AS DECIMAL(38,0))"))).first())
    possible, true = (total * total - squares) // 2, (squares - total) // 2
    n = min(max(true, least) if n is None else n, possible)
    at = materialize(_indexed(people))
    a, b = (at.select(F.col("i").alias(f"i{s}"), F.col("record_id").alias(f"r{s}"), F.col("true_patient_id").alias(f"p{s}")) for s in (1, 2))
    least, greatest = F.least("r1", "r2").alias("record_id_1"), F.greatest("r1", "r2").alias("record_id_2")
    if 2 * n >= possible:
        top = 1 << 53
        return _smallest(a.join(b, F.expr("i1 < i2 AND p1 <> p2")).select(least, greatest, F.pmod(F.xxhash64(F.lit(seed), "i1", "i2"), F.lit(top)).alias("id")), n, top)
    draws = n + n // 5 + 32
    draws = draws * total * total // (2 * possible)
    while True:
        drawn = records.sparkSession.range(draws).select("id", *(F.floor(uniform(seed, F.col("id"), s) * total).alias(f"i{s}") for s in (1, 2)))
        pairs = drawn.join(a, "i1").join(b, "i2").where("p1 <> p2").groupBy(least, greatest).agg(F.min("id").alias("id"))
        if pairs.count() >= n:
            return _smallest(pairs, n, draws)
        draws *= 2


#: Rows of a class that one task puts in order, about.
RANK_ROWS = 200_000


def ranked(df: DataFrame, label: str, key: Column) -> DataFrame:
    """df with rn, each row's place from 1 in its class (label) by key, a text of even spread such as a hash. A class is cut by the key's first four hexadecimal digits; pieces are put in order each for itself, and the counts of those before are added."""
    total = df.count()
    pieces = max(1, min(65536, -(-total // RANK_ROWS)))
    cut = df.withColumn("_key", key).withColumn("_piece", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("long") * pieces / 65536))
    sizes = cut.groupBy(label, "_piece").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(label, "_piece", (F.sum("_n").over(Window.partitionBy(label).orderBy("_piece")) - F.col("_n")).alias("_before"))  # a row a piece
    inside = F.row_number().over(Window.partitionBy(label, "_piece").orderBy("_key"))
    return cut.withColumn("_in", inside).join(F.broadcast(before), [label, "_piece"]).withColumn("rn", F.col("_in") + F.col("_before")).drop("_key", "_piece", "_in", "_before")


def split(df: DataFrame, label: str, key: Column, shares: tuple[float, float] = (0.7, 0.15)) -> DataFrame:
    """df, as many rows of either class, with split: by the key's order, train, validation, test in each class. Rows beyond the smaller class go: balancing is the operator."""
    n = df.groupBy(label).count().agg(F.min("count").alias("n"))
    rows = ranked(df, label, key).crossJoin(F.broadcast(n)).where("rn <= n")  # n has one row
    a, b = F.floor(F.col("n") * F.lit(shares[0])), F.floor(F.col("n") * F.lit(shares[1]))
    return rows.withColumn("split", F.when(F.col("rn") <= a, "train").when(F.col("rn") <= a + b, "validation").otherwise("test")).drop("rn", "n").select(*df.columns, "split")


def balanced_subsample(df: DataFrame, label: str, key: Column, n: int) -> DataFrame:
    """n // 2 rows of each class, the first by key; fewer where a class has fewer."""
    return ranked(df, label, key).where(F.col("rn") <= n // 2).select(*df.columns)


def truth_loss(truth: DataFrame, most: float = 0.10) -> float:
    """The share of truth rows without a record_id; an error if it is more than most."""
    lost, n = truth.agg(F.count(F.when(F.col("record_id").isNull(), 1)), F.count(F.lit(1))).first()
    share = lost / n if n else 0.0
    if share > most:
        raise ValueError(f"{share:.1%} of the truth's rows have no record")
    return share


def shortfall(found: int, target: int, least: float = 0.9) -> int:
    """How many pairs of the target are missing; an error if fewer than its share least were found."""
    if found < target * least:
        raise ValueError(f"{found} of {target} pairs were found")
    return max(0, target - found)


def length_statistics(df: DataFrame, length: Column, *by: str) -> DataFrame:
    """mean, median, least, most and the 95th percentile, interpolated, of a length; by groups if any."""
    return df.groupBy(*by).agg(F.avg(length).alias("mean"), F.percentile(length, 0.5).alias("median"), F.min(length).alias("least"), F.max(length).alias("most"), F.percentile(length, 0.95).alias("p95"))


def chat(prompt: Column, label: Column) -> Column:
    row = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(row("user", prompt), row("assistant", F.when(label == 1, "True").otherwise("False")))


def decode_label(messages: Column) -> Column:
    return F.when(F.get(messages, F.lit(1))["content"] == "True", 1).otherwise(0)


def preview(c: Column, most: int = 200) -> Column:
    return F.when(F.length(c) > most, F.concat(F.left(c, F.lit(most)), F.lit("..."))).otherwise(c)
