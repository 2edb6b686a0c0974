"""Pairs against truth."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.operators.linkage import canonical


def truth_pairs(truth: DataFrame) -> DataFrame:
    """All pairs of records of one person."""
    a = truth.dropna().select("true_patient_id", F.col("record_id").alias("a")).distinct()
    return a.join(a.withColumnRenamed("a", "b"), "true_patient_id").where("a < b").select(F.col("a").alias("record_id_1"), F.col("b").alias("record_id_2")).distinct()


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def metrics(df: DataFrame) -> DataFrame:
    """df (tp, fp, fn) with precision, recall, f1; 0 where a denominator is 0."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = df.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", ratio(2 * p * r, p + r))


def confusion(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    keys = ["record_id_1", "record_id_2"]
    both = canonical(predicted, *keys).withColumn("p", F.lit(1)).join(canonical(truth, *keys).withColumn("t", F.lit(1)), keys, "full")
    return both.agg(F.count(F.when(F.col("p").isNotNull() & F.col("t").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("t").isNull(), 1)).alias("fp"), F.count(F.when(F.col("p").isNull(), 1)).alias("fn"))


#: The sweep's thresholds; a sweep for the baseline takes multiples of 0.01 as repeated steps make them (BASELINE_GRID).
GRID = tuple(i / 100 for i in range(1, 100))
BASELINE_GRID = tuple(0.01 + i * 0.01 for i in range(99))


def _reached(p: Column, grid: tuple[float, ...]) -> Column:
    """How many thresholds of an ascending, nearly even grid p reaches: a guess from its step, put right by the thresholds around it."""
    n = len(grid)
    step = (grid[-1] - grid[0]) / (n - 1) if n > 1 else 1.0
    guess = F.greatest(F.lit(0), F.least(F.lit(n), (F.floor((p - grid[0]) / step) + 1).cast("int")))
    values = F.array(*map(F.lit, grid))
    above = F.coalesce((p >= F.get(values, guess)).cast("int"), F.lit(0))
    below = F.coalesce((p < F.get(values, guess - 1)).cast("int"), F.lit(0))
    return guess + above - below


def truth_size(truth: DataFrame) -> DataFrame:
    """One row, total: how many pairs truth_pairs makes of truth with one person a record, without making them."""
    n = truth.dropna().select("true_patient_id", "record_id").distinct().groupBy("true_patient_id").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(F.coalesce(F.sum(F.expr("n * (n - 1) DIV 2")), F.lit(0)).alias("total"))


def counted_confusion(counted: DataFrame, total: DataFrame) -> DataFrame:
    """What confusion gives, from rows (hit, n) that each stand for n predicted pairs, all true or all not, and the number of true pairs."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    found = counted.agg(n(F.col("hit")).alias("tp"), n(~F.col("hit")).alias("fp"))
    return found.crossJoin(F.broadcast(total)).select("tp", "fp", (F.col("total") - F.col("tp")).alias("fn"))  # one row each


def threshold_sweep(scored: DataFrame, truth: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1 of each threshold of an ascending grid, its steps nearly even. Pairs are counted by the last threshold that they reach; sums over those few counts make the sweep."""
    keys = ["record_id_1", "record_id_2"]
    flagged = scored.select(*keys, F.col("p")).join(truth.select(*keys, F.lit(1).alias("t")), keys, "left")
    return counted_sweep(flagged.select("p", F.col("t").isNotNull().alias("hit"), F.lit(1).cast("long").alias("n")), truth.agg(F.count(F.lit(1)).alias("total")), grid)


def counted_sweep(counted: DataFrame, total: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """What threshold_sweep gives, from rows (p, hit, n) that each stand for n pairs, and the number of true pairs."""
    counts = counted.select(_reached(F.col("p"), grid).alias("k"), "hit", "n").groupBy("k").agg(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)).alias("hit"), F.sum("n").alias("n"))
    steps = counted.sparkSession.range(1, len(grid) + 1, 1, 1).select(F.col("id").cast("int").alias("k"), F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("n"))
    few = counts.unionByName(steps).groupBy("k").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))  # a row a threshold
    upward = Window.orderBy(F.desc("k"))
    sums = few.select("k", F.sum("hit").over(upward).alias("tp"), F.sum(F.col("n") - F.col("hit")).over(upward).alias("fp")).where("k > 0")
    sums = sums.crossJoin(F.broadcast(total)).select(F.element_at(F.array(*map(F.lit, grid)), F.col("k")).alias("threshold"), "tp", "fp", (F.col("total") - F.col("tp")).alias("fn"))
    return metrics(sums)


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.orderBy(F.desc("f1"), "threshold").limit(1)


def matches_at(scored: DataFrame, threshold: float) -> DataFrame:
    """Pairs that reach the threshold, the smaller id first."""
    return canonical(scored.where(F.col("p") >= threshold), "record_id_1", "record_id_2")


def match_metrics(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 and the sizes of both sets of pairs."""
    return with_sizes(metrics(confusion(predicted, truth)))


def with_sizes(out: DataFrame) -> DataFrame:
    return out.withColumn("predicted_pairs", F.col("tp") + F.col("fp")).withColumn("true_pairs", F.col("tp") + F.col("fn"))


def blocking_recall(candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true pairs, those among the candidates, and their share; 0 without true pairs."""
    keys = ["record_id_1", "record_id_2"]
    found = canonical(truth, *keys).join(canonical(candidates, *keys).withColumn("x", F.lit(1)), keys, "left")
    out = found.agg(F.count(F.lit(1)).alias("true_pairs"), F.count("x").alias("found"))
    return out.withColumn("blocking_recall", ratio(F.col("found"), F.col("true_pairs")))


def counted_recall(counted: DataFrame, total: DataFrame) -> DataFrame:
    """What blocking_recall gives, from rows (hit, n) that each stand for n candidates, and the number of true pairs."""
    found = counted.agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("found")).crossJoin(F.broadcast(total))  # one row each
    return found.select(F.col("total").alias("true_pairs"), "found", ratio(F.col("found"), F.col("total")).alias("blocking_recall"))


def golden_counts(golden: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: golden records, true patients, whether they are as many, the difference, and records per golden record."""
    a = golden.agg(F.count(F.lit(1)).alias("num_golden_records"), F.avg("num_records").alias("avg_records_per_patient"), F.max("num_records").alias("max_records_per_patient"))
    b = truth.agg(F.countDistinct("true_patient_id").alias("num_true_patients"))
    difference = F.col("num_golden_records") - F.col("num_true_patients")
    return a.crossJoin(b).withColumn("count_accuracy", difference == 0).withColumn("count_difference", difference)


def failure_rates(scenarios: DataFrame, base: str, other: str) -> DataFrame:
    """metric, base rate, other rate, reduction of what fails, from rows (scenario, completeness, perfect_resolution_rate, recall). reduction is null where the base never fails."""
    names = {"fragmentation": "completeness", "unresolved": "perfect_resolution_rate", "missed_matches": "recall"}
    long = scenarios.select("scenario", F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), (1 - F.col(v)).alias("rate")) for k, v in names.items()))).alias("x")).select("scenario", "x.*")
    a, b = (long.where(F.col("scenario") == s).select("metric", F.col("rate").alias(n)) for s, n in ((base, "base_rate"), (other, "other_rate")))
    return a.join(b, "metric").withColumn("reduction", F.when(F.col("base_rate") > 0, (F.col("base_rate") - F.col("other_rate")) / F.col("base_rate")))


def probability_matrix(pairs: DataFrame, ids: list, rows: Callable[[Column], Column] | None = None) -> DataFrame:
    """i and a column for each of the given records: the pair's probability either way, 1 on the diagonal, null where blocking found no pair. Few records: the matrix is a report. With rows, a condition on a record id, paired records that it holds for have a row as well."""
    among = rows or (lambda c: c.isin(ids))
    both = pairs.where(among(F.col("record_id_1")) & among(F.col("record_id_2")))
    sides = both.select(F.col("record_id_1").alias("i"), F.col("record_id_2").alias("j"), "p").unionByName(both.select(F.col("record_id_2").alias("i"), F.col("record_id_1").alias("j"), "p"))
    kind = pairs.schema["record_id_1"].dataType.simpleString()
    own = pairs.sparkSession.createDataFrame([(x,) for x in ids], f"i {kind}").select("i", F.col("i").alias("j"), F.lit(1.0).alias("p"))
    return sides.unionByName(own).groupBy("i").pivot("j", ids).agg(F.max("p"))


def tier_counts(tiers: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: candidate pairs and pairs by tier, from a column tier. A row counts as often as its weight says."""
    w = F.col(weight) if weight else F.lit(1).cast("long")
    n = lambda t: F.coalesce(F.sum(F.when(F.col("tier") == t, w)), F.lit(0))
    return tiers.agg(F.coalesce(F.sum(w), F.lit(0)).alias("candidate_pairs"), *(n(t).alias(f"{t}_count") for t in ("auto_match", "gray_zone", "auto_reject")))


def scoring_cost(counts: DataFrame, pairs_per_second: float, price_per_hour: float, shares: tuple[float, ...] = (0.2, 0.1, 0.05)) -> DataFrame:
    """scenario, share of candidates, pairs, seconds, cost of scoring the gray zone: as it is (counts from tier_counts), and at other shares."""
    own = F.when(F.col("candidate_pairs") > 0, F.col("gray_zone_count") / F.col("candidate_pairs"))
    rows = F.array(F.struct(F.lit("measured").alias("scenario"), own.alias("share"), F.col("gray_zone_count").alias("pairs")), *(F.struct(F.lit(f"{s:.0%}").alias("scenario"), F.lit(s).alias("share"), F.floor(F.col("candidate_pairs") * s).alias("pairs")) for s in shares))
    out = counts.select(F.explode(rows).alias("x")).select("x.*").withColumn("seconds", F.col("pairs") / pairs_per_second)
    return out.withColumn("cost", F.col("seconds") / 3600 * price_per_hour)


def correct(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """df with correct, 1 or 0, a row."""
    return df.withColumn("correct", (F.col(label) == F.col(prediction)).cast("int"))


def error_summary(df: DataFrame, label: str, prediction: str, confidence: str) -> DataFrame:
    """One row: errors, their share, false positives and negatives, and mean confidence of wrong and right rows (null without any)."""
    l, p, c = F.col(label), F.col(prediction), F.col(confidence)
    n = lambda x: F.count(F.when(x, 1))
    out = df.agg(F.count(F.lit(1)).alias("n"), n(l != p).alias("errors"), n((l == 0) & (p == 1)).alias("false_positives"), n((l == 1) & (p == 0)).alias("false_negatives"), F.avg(F.when(l != p, c)).alias("confidence_wrong"), F.avg(F.when(l == p, c)).alias("confidence_right"))
    return out.withColumn("error_share", ratio(F.col("errors"), F.col("n")))


def class_report(df: DataFrame, label: str, prediction: str, classes: tuple[int, ...] = (0, 1)) -> DataFrame:
    """class, precision, recall, f1, support of each class."""
    l, p = F.col(label), F.col(prediction)
    n = lambda x: F.count(F.when(x, 1))
    sums = df.agg(F.array(*(F.struct(F.lit(k).alias("class"), n((l == k) & (p == k)).alias("tp"), n((l != k) & (p == k)).alias("fp"), n((l == k) & (p != k)).alias("fn"), n(l == k).alias("support")) for k in classes)).alias("x"))
    return metrics(sums.select(F.explode("x").alias("x")).select("x.*")).select("class", "precision", "recall", "f1", "support")


def classification(df: DataFrame, label: str, prediction: str) -> DataFrame:
    l, p = F.col(label), F.col(prediction)
    n = lambda c: F.count(F.when(c, 1))
    out = metrics(df.agg(n((l == 1) & (p == 1)).alias("tp"), n((l == 0) & (p == 1)).alias("fp"), n((l == 1) & (p == 0)).alias("fn"), n(l == p).alias("right"), F.count(F.lit(1)).alias("n")))
    return out.withColumn("accuracy", ratio(F.col("right"), F.col("n")))
