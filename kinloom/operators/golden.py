"""Clusters to golden records, and how good clusters are."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions.text import is_title, trim
from kinloom.operators.graph import connected_components, materialize

FIELDS = ("first_name", "last_name", "maiden_name", "ssn", "birthdate", "gender", "address", "city", "state", "zip")


def singletons(records: DataFrame, matches: DataFrame) -> DataFrame:
    """record_id of the records in no match."""
    matched = matches.select(F.col("record_id_1").alias("record_id")).unionByName(matches.select(F.col("record_id_2").alias("record_id")))
    return records.select("record_id").join(matched, "record_id", "left_anti")


def assign_clusters(records: DataFrame, matches: DataFrame) -> DataFrame:
    """records with cluster: their component, or themselves."""
    c = connected_components(matches, "record_id_1", "record_id_2")
    return records.join(c.select(F.col("node").alias("record_id"), "component"), "record_id", "left").withColumn("cluster", F.coalesce("component", "record_id")).drop("component")


STRATEGIES = ("most_frequent", "most_recent", "least_errors", "field_specific")


def _votes(clustered: DataFrame, fields: tuple[str, ...], strategy: str, order: str) -> DataFrame:
    """cluster and each field's winner: all fields are stacked, voted on by value and by cluster in two partial aggregations, and put side by side again."""
    kinds = dict(clustered.dtypes)
    stacked = clustered.select("cluster", order, F.explode(F.array(*(F.struct(F.lit(f).alias("f"), F.col(f).cast("string").alias("v")) for f in fields))).alias("x"))
    votes = stacked.select("cluster", order, "x.*").where(F.col("v").isNotNull() & (F.trim("v") != "")).groupBy("cluster", "f", "v").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"))
    frequent, early = F.col("n").cast("long"), -F.col("first")
    if strategy == "most_recent":
        # the first key is the same for all, so that all strategies share one form
        rank = F.struct(F.lit(0).cast("long").alias("a"), F.col("last").alias("b"))
    elif strategy == "field_specific":
        own = F.when(F.col("f") == "address", F.length("v")).when(F.col("f") == "ssn", F.contains("v", F.lit("-")).cast("int")).when(F.col("f").isin("first_name", "last_name"), is_title(F.col("v")).cast("int"))
        rank = F.struct(F.coalesce(own.cast("long"), frequent).alias("a"), early.alias("b"))
    else:
        rank = F.struct(frequent.alias("a"), early.alias("b"))
    best = votes.groupBy("cluster", "f").agg(F.max_by("v", rank).alias("v"))
    return best.groupBy("cluster").agg(*(F.max(F.when(F.col("f") == f, F.col("v"))).cast(kinds[f]).alias(f) for f in fields))


def merge(clustered: DataFrame, strategy: str = "most_frequent", fields: tuple[str, ...] = FIELDS, order: str = "ord", provenance: bool = True) -> DataFrame:
    """One row a cluster. Blank values never win; ties go to the value seen first by ``order``, a number. most_recent takes the last, field_specific the longest address, a dashed SSN and title-cased names; least_errors counts as most_frequent, and so, with a warning, does an unknown strategy. With provenance, the facilities and the records of a cluster are listed."""
    if strategy not in STRATEGIES:
        warnings.warn(f"unknown strategy {strategy}: most_frequent is used", stacklevel=2)
    fields = tuple(f for f in fields if f in clustered.columns)
    facility = "facility_id" if "facility_id" in clustered.columns else "record_id"
    listed = [
        F.array_join(F.array_sort(F.collect_set(F.col(facility).cast("string"))), ",").alias("facilities"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col("record_id").cast("string").alias("r")))), lambda x: x["r"]), ",").alias("source_record_ids"),
    ]
    out = clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("num_records"), F.countDistinct(facility).alias("num_facilities"), *(listed if provenance else []))
    return out.join(_votes(clustered, fields, strategy, order), "cluster", "left") if fields else out


def placed(df: DataFrame, *order: str) -> DataFrame:
    """df with place, from 1 in the given order without gaps. Ranges are numbered each for itself and offset by the rows of those before."""
    parts = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    at, offsets = 0, []
    for part, n in sorted(map(tuple, parts.groupBy("_part").count().collect())):  # a row a partition
        offsets.append((part, at))
        at += n
    before = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.join(before, "_part").withColumn("place", inside + F.col("_before")).drop("_part", "_before")


def number(golden: DataFrame, order: str = "cluster") -> DataFrame:
    """golden with golden_id: clusters of several records before single ones, each by order, numbered from 0 without gaps."""
    ranked = placed(golden.withColumn("_single", F.when(F.col("num_records") > 1, 0).otherwise(1)), "_single", order)
    return ranked.withColumn("golden_id", F.format_string("golden_%06d", F.col("place") - 1)).drop("_single", "place")


def listed_records(golden: DataFrame) -> DataFrame:
    """cluster, record_id of a table of golden records: what source_record_ids lists, blanks left out."""
    ids = F.filter(F.transform(F.split("source_record_ids", ","), lambda x: trim(x)), lambda x: x != "")
    return golden.select("cluster", F.explode(ids).alias("record_id"))


def cluster_quality(clustered: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: clusters, purity, completeness, split patients, impure clusters, perfect resolution. truth: record_id, true_patient_id; records without truth count for clusters only. Shares are rounded to four places, halves to even as floating point rounds them."""
    known = clustered.join(truth.groupBy("record_id").agg(F.max("true_patient_id").alias("true_patient_id")), "record_id").groupBy("cluster", "true_patient_id").agg(F.count(F.lit(1)).alias("n"))
    clusters = known.groupBy("cluster").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("patients"))
    spread = known.join(clusters.select("cluster", "patients"), "cluster").groupBy("true_patient_id").agg(F.count(F.lit(1)).alias("in"), F.sum("n").alias("n"), F.max("patients").alias("mixed"))
    every = clustered.agg(F.countDistinct("cluster").alias("n_clusters"))
    a = clusters.agg(F.sum(F.when(F.col("patients") == 1, F.col("n")).otherwise(0)).alias("pure"), F.sum("n").alias("records"), F.count(F.when(F.col("patients") > 1, 1)).alias("impure_clusters"))
    many = F.col("n") > 1
    b = spread.agg(F.count(F.lit(1)).alias("patients"), F.count(F.when(F.col("in") > 1, 1)).alias("split_patients"), F.count(F.when(many, 1)).alias("many"), F.count(F.when(many & (F.col("in") == 1) & (F.col("mixed") == 1), 1)).alias("perfect"))
    share = lambda x, y: F.when(F.col(y) > 0, F.bround(x / F.col(y), 4)).otherwise(0.0)
    return every.crossJoin(a).crossJoin(b).select("n_clusters", share(F.col("pure"), "records").alias("purity"), share(F.col("patients") - F.col("split_patients"), "patients").alias("completeness"), "split_patients", "impure_clusters", share(F.col("perfect"), "many").alias("perfect_resolution_rate"))
